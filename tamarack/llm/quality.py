"""Quality by perplexity under an interpolated modified Kneser-Ney model.

Grams are runs of ``ORDER`` characters (A-Z as a-z, white space as one blank, every other code point as itself), named by a
64-bit polynomial over their symbols. A row of a distinct gram carries the names of its suffixes and of their contexts, so the
orders below it are groupings of the same table. The model is trained on trusted documents (quality 1)
outside a held-out fold; counts of the highest order and continuation counts below it are Spark tables,
sharded by hash, of any size: nothing of the model is capped or sent to the driver but 3 discounts
an order.

Scoring needs the log probability of each distinct gram of the corpus. It comes from joins of these grams with
the model's tables, order by order. While there are at most ``HELD_GRAMS`` of them (counted first) they go
to every executor; beyond that each input task writes its texts as compressed blocks together with their
distinct grams, and each block meets the log probabilities of its own grams in a join. Both ways give
the same numbers. The trusted ids likewise mark rows from memory up to ``HELD_IDS``, else by a join.

A document is kept unless its perplexity is over its language's threshold: the quantile of the language's held-out trusted
documents, from a histogram of exact counts, drawn towards that of all languages as if ``PRIOR`` documents had it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, passing, table
from .words import U, chunks, column_bytes, mix

ORDER, QUANTILE, BINS, PRIOR = 5, 0.99, 1000, 20
BLOCK = 24 << 20  # bytes of text in a block
HELD_GRAMS, HELD_IDS = 4_000_000, 4_000_000  # 16 and 8 bytes each
FIRST = 1  # the symbol in front of every text; a code point is its number and 2
_MUL = 0x9E3779B97F4A7C15 - (1 << 64)  # odd
_SPACE = (32, 9, 10, 11, 12, 13)


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of UTF-8 texts, each with ORDER - 1 starting symbols in front."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = data[at].astype(np.int64)
    size = np.where(b < 0x80, 1, np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4)))
    cp = np.where(size == 1, b, b & (0xFF >> (size + 1)))
    for j in range(1, 4):
        more = size > j
        cp[more] = (cp[more] << 6) | (data[np.minimum(at[more] + j, len(data) - 1)] & 0x3F)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    cp[np.isin(cp, _SPACE)] = 32
    s = cp + FIRST + 1
    count = np.searchsorted(at, off)
    n = np.diff(count)
    out_off = np.concatenate([[0], np.cumsum(n + ORDER - 1)])
    out = np.full(out_off[-1], FIRST, np.int64)
    where = np.arange(len(s)) - np.repeat(count[:-1], n) + np.repeat(out_off[:-1] + ORDER - 1, n)
    out[where] = s
    return out, out_off


def _places(o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each character's place among the symbols, offsets of the characters) for the symbols' offsets."""
    keep = np.diff(o) - ORDER + 1
    out = np.concatenate([[0], np.cumsum(keep)])
    return np.arange(out[-1]) - np.repeat(out[:-1], keep) + np.repeat(o[:-1], keep) + ORDER - 1, out


def top_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, offsets by text) of the grams of ORDER symbols that end in each character."""
    s, o = symbols(data, off)
    at, out = _places(o)
    g = s
    for _ in range(1, ORDER):
        longer = s.copy()
        longer[1:] += g[:-1] * np.int64(_MUL)
        g = longer
    return g[at], out


def grams(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(names, offsets by text): for each order n the names of the n symbols that end in each character, then those of their contexts."""
    s, o = symbols(data, off)
    at, out = _places(o)
    names = [s]
    for _ in range(1, ORDER):
        g = s.copy()
        g[1:] += names[-1][:-1] * np.int64(_MUL)
        names.append(g)
    # contexts are the names one place earlier
    return [g[at] for g in names] + [g[at - 1] for g in names[:-1]], out


def columns(n: int) -> list[str]:
    """Names of a gram of order ``n``: g<k> its last k symbols, c<k> the first k - 1 of these."""
    return [f"g{k}" for k in range(1, n + 1)] + [f"c{k}" for k in range(2, n + 1)]


TOP = columns(ORDER)
_TOP = ", ".join(f"{c} long" for c in [*TOP, "n"])


def _count(held):
    """(names, n): how often trusted rows hold a gram, 0 if only others do; summed over each task's rows as far as its memory goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # names of distinct grams, a row each, and their counts
        size = 0

        def out() -> pa.RecordBatch:
            rows = np.concatenate([x for x, _ in kept], axis=1)
            _, first, at = np.unique(rows[ORDER - 1], return_index=True, return_inverse=True)
            n = np.bincount(at, np.concatenate([x for _, x in kept]), len(first)).astype(np.int64)
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows[:, first]), pa.array(n)], names=[*TOP, "n"])

        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                names, off = grams(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
                if held is None:
                    own = batch.column(batch.schema.get_field_index("trusted")).to_numpy() == 1
                else:
                    own = np.isin(batch.column(batch.schema.get_field_index("doc_id")).fill_null(-(1 << 62)).to_numpy(), held.value)
                mine = np.repeat(own, np.diff(off))
                _, first, at = np.unique(names[ORDER - 1], return_index=True, return_inverse=True)
                if not len(first):
                    continue
                kept.append((np.stack([c[first] for c in names]), np.bincount(at[mine], minlength=len(first))))
                size += len(first)
                if size > 500_000:
                    yield out()
                    kept, size = [], 0
        if kept:
            yield out()

    return run


def model_tables(spark: SparkSession, top: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order 1..ORDER: (gram, disc: the discounted count over its context's sum) and (ctx, gamma: what the context leaves to the order below), from ``top(names, c)``."""
    counts = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols stand in front
        counts[n] = Scratch(spark, counts[n + 1].groupBy(*columns(n)).agg(F.count("*").alias("c")), "grams").df
    probs, gammas = [], []
    for n in range(1, ORDER + 1):
        t = counts[n].select(F.col(f"g{n}").alias("gram"), (F.col(f"c{n}") if n > 1 else F.lit(0).cast("long")).alias("ctx"), "c")
        n1, n2, n3, n4 = (int(x or 0) for x in t.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [min(max(v, 0.0), k) for k, v in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        c = F.col("c")
        disc = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        sums = t.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(disc).alias("off"))
        sums = Scratch(spark, sums, "contexts").df
        probs.append(t.join(sums, "ctx").select("gram", (F.greatest(F.lit(0.0), c - disc) / F.col("total")).alias("disc")))
        gammas.append(sums.select("ctx", (F.col("off") / F.col("total")).alias("gamma")))
    return probs, gammas


def log_probs(wanted: DataFrame, probs: list[DataFrame], gammas: list[DataFrame], letters: int) -> DataFrame:
    """(gram, logp) of every distinct gram of ``wanted(names)``: interpolated from order 1 up; below it all is uniform over ``letters`` symbols."""
    last = None
    for n in range(1, ORDER + 1):
        g = wanted.select(*columns(n))
        g = g.distinct() if n < ORDER else g
        g = g.select(F.col(f"g{n}").alias("gram"), (F.col(f"c{n}") if n > 1 else F.lit(0).cast("long")).alias("ctx"), *([F.col(f"g{n - 1}").alias("low")] if n > 1 else []))
        g = g.join(gammas[n - 1], "ctx", "left").join(probs[n - 1], "gram", "left")
        if last is None:
            g = g.withColumn("below", F.lit(1.0 / letters))
        else:
            g = g.join(last.select(F.col("gram").alias("low"), F.col("p").alias("below")), "low")
        last = g.select("gram", (F.coalesce("disc", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p"))
    return last.select("gram", F.log("p").alias("logp"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, kind, data): the rows of a block as compressed Arrow (kind 0) and its distinct grams (kind 1)."""
    import uuid

    import zstandard

    rows: list[pa.RecordBatch] = []
    seen: list[np.ndarray] = []
    size = 0
    pack = zstandard.ZstdCompressor(level=3)

    def out() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema) as w:
            for r in rows:
                w.write_batch(r)
        g = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        name = uuid.uuid4().int >> 65
        kinds, data = [0], [pack.compress(sink.getvalue().to_pybytes())]
        for a in range(0, len(g), 1 << 17):
            kinds.append(1)
            data.append(g[a : a + (1 << 17)].tobytes())
        return pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "data"])

    for whole in batches:
        for batch in chunks(whole, "text", 4 << 20):
            data, off = column_bytes(batch.column(batch.schema.get_field_index("text")))
            rows.append(batch)
            seen.append(np.unique(top_grams(data, off)[0]))
            size += len(data)
            if size >= BLOCK:
                yield out()
                rows, seen, size = [], [], 0
    if rows:
        yield out()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        for block, data in zip(t.column(0).to_pylist(), t.column(1), strict=True):
            g = np.frombuffer(data.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block)), pa.array(g)], names=["block", "gram"])


class Lookup:
    """Log probabilities by gram in an open-addressing table."""

    def __init__(self, g: np.ndarray, p: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(g)).bit_length())
        self.key, self.val = np.zeros((1 << self.bits) + 64, np.int64), np.zeros((1 << self.bits) + 64)
        used = np.zeros(len(self.key), bool)
        todo, at = np.arange(len(g)), self._slot(g)
        while len(todo):  # all at once: of those that want a free slot one has it, the others go on
            free = ~used[at]
            self.key[at[free]] = g[todo[free]]
            used[at[free]] = True
            won = self.key[at] == g[todo]
            self.val[at[won]] = p[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) % len(self.key)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (mix(g.view(U)) >> U(64 - self.bits)).astype(np.int64)

    def sums(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities, number of characters) of each text; all its grams must be in the table."""
        total, count = [], []
        for batch in chunks(rows, "text", 2 << 20):
            q, off = top_grams(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
            at = self._slot(q)
            score = self.val[at]
            todo = np.flatnonzero(self.key[at] != q)
            at = at[todo]
            while len(todo):
                at = (at + 1) % len(self.key)
                ok = self.key[at] == q[todo]
                score[todo[ok]] = self.val[at[ok]]
                todo, at = todo[~ok], at[~ok]
            n = np.diff(off)
            sums, has = np.zeros(len(n)), np.flatnonzero(n)
            if len(has):
                sums[has] = np.add.reduceat(score, off[:-1][has])
            total.append(sums)
            count.append(n)
        return (np.concatenate(total), np.concatenate(count)) if total else (np.zeros(0), np.zeros(0, np.int64))


_SCORED = "doc_id long, lang string, logp double, n long"


def _scored(rows: pa.RecordBatch, look: Lookup) -> pa.RecordBatch:
    total, count = look.sums(rows)
    cols = [rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "lang")]
    return pa.RecordBatch.from_arrays([*cols, pa.array(total), pa.array(count, pa.int64())], names=["doc_id", "lang", "logp", "n"])


_looks: dict[int, Lookup] = {}


def _score_all(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.id not in _looks:
            _looks.clear()
            _looks[held.id] = Lookup(*held.value)
        for batch in batches:
            yield _scored(batch, _looks[held.id])

    return run


class _Held:
    """A broadcast with a name of its own, by which a worker knows the table it has built."""

    def __init__(self, spark: SparkSession, value: tuple[np.ndarray, np.ndarray]) -> None:
        import uuid

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self) -> tuple[np.ndarray, np.ndarray]:
        return self.held.value


def _score_block(texts: pa.Table, known: pa.Table) -> pa.Table:
    import zstandard

    look = Lookup(*(known.column(c).to_numpy() for c in ("gram", "logp")))
    out = []
    for one in texts.column("data").to_pylist():
        out += [_scored(rows, look) for rows in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(one))]
    kinds = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("logp", pa.float64()), ("n", pa.int64())])
    return pa.Table.from_batches(out) if out else kinds.empty_table()


def perplexities(spark: SparkSession, docs: DataFrame, trusted: DataFrame, held_grams: int = HELD_GRAMS, held_ids: int = HELD_IDS) -> DataFrame:
    """(doc_id, lang, trusted, n_chars, perplexity): ``trusted`` is 0 for other rows, 1 for those trained on, 2 for the held-out ones.

    ``trusted(doc_id)`` names the trusted rows. Null or empty texts have no characters and perplexity
    null. Rows come one for one, repeated or null ids too; other columns, of both tables, are ignored. Texts are taken whole at any length.
    """
    fold = F.when(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 0, 2).otherwise(1)
    own = trusted.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").distinct().withColumn("fold", fold)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(text as string) text")
    own = Scratch(spark, own, "trusted").df
    learn = own.filter("fold = 1").select("id")
    if learn.count() <= held_ids:
        ids = np.sort(learn.toArrow().column("id").to_numpy())
        counted = rows.mapInArrow(_count(spark.sparkContext.broadcast(ids)), _TOP)
    else:
        marks = rows.join(learn.withColumn("trusted", F.lit(1)), F.col("doc_id") == F.col("id"), "left")
        counted = marks.select("text", F.coalesce("trusted", F.lit(0)).alias("trusted")).mapInArrow(_count(None), _TOP)
    # the other names are functions of the gram's
    every = Scratch(spark, counted.groupBy(*TOP).agg(F.sum("n").alias("c")), "grams").df
    probs, gammas = model_tables(spark, every.filter("c > 0"))
    letters = max(1, probs[0].count()) + 1
    lp = Scratch(spark, log_probs(every.select(*TOP), probs, gammas, letters), "logp").df
    if lp.count() <= held_grams:
        t = lp.toArrow()
        order = np.argsort(t.column("gram").to_numpy())
        look = _Held(spark, (t.column("gram").to_numpy()[order], t.column("logp").to_numpy()[order]))
        scored = rows.mapInArrow(_score_all(look), _SCORED)
    else:
        blocks = Scratch(spark, rows.mapInArrow(_blocks, "block long, kind int, data binary"), "blocks", "none").df
        held = blocks.filter("kind = 1").select("block", "data").mapInArrow(_unpack, "block long, gram long")
        known = held.join(lp, "gram").select("block", "gram", "logp")
        scored = blocks.filter("kind = 0").select("block", "data").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score_block, _SCORED)
    scored = scored.join(own, F.col("doc_id") == F.col("id"), "left")
    ppl = F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.greatest("n", F.lit(1))))
    return scored.select("doc_id", "lang", F.coalesce("fold", F.lit(0)).alias("trusted"), F.col("n").alias("n_chars"), ppl.alias("perplexity"))


def quality(spark: SparkSession, docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept): see :func:`perplexities`.

    Thresholds come from the held-out trusted rows of a language and of all languages; rows without perplexity are not kept. Without any held-out trusted row everything with text is kept.
    """
    with passing() as keep:  # the counts and the model go as soon as all texts are scored
        p = keep(Scratch(spark, perplexities(spark, docs, trusted), "perplexity"))
    held = p.filter("trusted = 2 and perplexity is not null").withColumn("bin", F.floor(F.log("perplexity") * BINS))
    bins = held.groupBy("lang", "bin").agg(F.count("*").alias("n"))  # counts, not rows, are put in order

    def cut(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        run = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("run", run).withColumn("all", F.sum("n").over(w)).filter(F.col("run") >= quantile * F.col("all"))
        return rows.groupBy(*keys).agg(F.exp((F.min("bin") + 1) / F.lit(float(BINS))).alias("t"), F.max("all").alias("all"))

    whole = cut(bins.groupBy("bin").agg(F.sum("n").alias("n")), []).select(F.col("t").alias("t0"))
    own = cut(bins, ["lang"]).select(F.col("lang").alias("l"), F.col("t").alias("t1"), "all")
    joined = p.join(own, p["lang"].eqNullSafe(F.col("l")), "left").join(F.broadcast(whole), how="cross")  # whole has one row
    mean = F.exp((F.col("all") * F.log("t1") + PRIOR * F.log("t0")) / (F.col("all") + PRIOR))
    threshold = F.coalesce(mean, "t0", F.lit(float("inf")))
    return joined.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), (F.coalesce(F.col("perplexity"), F.lit(float("nan"))) <= threshold).alias("kept"))


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision for every whole document; trusted are those labelled quality 1."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality(spark, table(spark, sf_dir, "documents"), trusted)
