"""Small awkward inputs that every operator has to take."""

from pyspark.sql import Row


def long_words(n, seed=0):
    """n invented words, the same for the same seed."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("w" + format(x >> 40, "x"))
    return out


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns of documents and some whose names clash with those inside operators."""
    full = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=None if t is None else len(t), node=1, label="x", key="k", id=2, score=0.5, n=3, a="a", b="b", p="p") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, node int, label string, key string, id int, score double, n int, a string, b string, p string")


def empty(spark):
    return documents(spark, [])
