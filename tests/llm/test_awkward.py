"""Very long texts and tables whose other columns clash with names inside the operators."""

from pyspark.sql import functions as F

from tamarack.llm import decontaminate, quality, sharding, substring, tokens, toxicity

from .helpers import documents, long_words

CLASH = ("node", "hash", "text_md5", "own", "h", "shift", "size", "id", "fold", "n", "label", "key", "gram", "logp", "lead", "at", "part")


def clashing(df):
    """The table with columns named as those inside operators."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


def long_text(n=60_000, seed=1):
    return " ".join(long_words(n, seed))


def test_contamination_of_a_very_long_text_with_clashing_columns(spark):
    item = " ".join(long_words(20, 99))
    items = clashing(spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = [(1, f"{long_text()} {item} {long_text(5000, 2)}"), (2, long_text(40_000, 3)), (3, "short")]
    docs = documents(spark, rows)
    got = [tuple(r) for r in decontaminate.contamination(spark, docs, items).select("doc_id", "start_word", "matched").collect()]
    assert got == [(1, 60_000, 20)]
    left = decontaminate.decontaminate(spark, docs, items)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3] and left.columns == docs.columns


def test_shards_of_very_long_and_repeated_texts(spark):
    rows = [(i, long_text(30_000, i % 3)) for i in range(7)] + [(20 + i, f"few words {i}") for i in range(40)]
    out = sharding.shard_documents(spark, clashing(documents(spark, rows)), 4).collect()
    per = [sum(r["shard"] == s for r in out) for s in range(4)]
    assert len(out) == 47 and max(per) - min(per) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))
    assert {r["doc_id"]: r["size"] for r in out}[0] == len(rows[0][1].encode()) + 16


def test_quality_of_a_very_long_text_with_clashing_labels(spark):
    rows = [(i, " ".join(long_words(30, i % 11))) for i in range(60)] + [(100, " ".join(long_words(30, 4)) + " " + long_text(40_000, 5)), (101, None), (102, "")]
    trusted = clashing(spark.createDataFrame([(i,) for i in range(50)], "doc_id long"))
    got = {r["doc_id"]: r for r in quality.quality(spark, clashing(documents(spark, rows)), trusted).collect()}
    assert len(got) == 63 and got[100]["n_chars"] == len(rows[60][1]) and got[100]["perplexity"] > got[1]["perplexity"]
    assert got[101]["perplexity"] is None and not got[101]["kept"]


def test_toxicity_of_one_endless_sentence_with_clashing_labels(spark):
    rows, labels = [], []
    for i in range(80):
        w = long_words(20, 300 + i)
        w[5] = "vile" if i % 4 == 0 else w[5]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    ldf = clashing(spark.createDataFrame(labels, "doc_id long, toxic int"))
    endless = long_words(60_000, 8)
    docs = documents(spark, [*rows, (500, " ".join(endless)), (501, " ".join([*endless[:30_000], *["vile"] * 40, *endless[30_000:]]))])
    model = toxicity.learn(docs, ldf)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[500]["score"] < 0.5 < got[501]["score"] and not got[500]["spans"] and got[501]["spans"]
    text = " ".join([*endless[:30_000], *["vile"] * 40, *endless[30_000:]])
    assert {w for s in got[501]["spans"] for w in text[s["start"] : s["end"]].split()} == {"vile"}


def test_token_counts_and_passages_of_very_long_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = long_text(80_000, 6)
    docs = clashing(documents(spark, [(1, text), (2, text + " tail"), (3, "x" * 300_000)]))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, path).collect()}
    library = Tokenizer.from_file(path)
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in ((1, text), (2, text + " tail"), (3, "x" * 300_000))}
    found = [tuple(r) for r in substring.repeated_passages(spark, docs).select("doc_id", "start_word", "end_word", "first_doc_id", "exact").collect()]
    assert found == [(2, 0, 80_000, 1, True)]
