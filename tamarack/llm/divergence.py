"""Source divergence audit: how far the word use of each source of a language lies from that of the others.

Sort-based streaming. Texts become rows (lang, term, source, document, docs, n), added up inside a task before they
are shuffled, so a row speaks for a stretch of documents (``document`` is the first). They are partitioned by (lang, term), sorted by
(lang, term, source, document) and read once as a stream of runs: a run of (lang, term) gives the term's document
frequency, its parts by source the counts. What a task holds is one run's counts by source.

Terms of at least ``DOCS`` documents are kept. Their rows are dealt by a hash of the term and sorted again by (lang, blocks of
sources, term, source); the second scan turns each term's run into probabilities and adds up partial values for all pairs of two
blocks, one array of ``SOURCES`` x ``SOURCES`` numbers a task, whatever the number of sources. Terms that no source of the
two blocks has are not sent: they add one number each, known from the sizes of the sources alone. Nothing is broadcast by hand or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table
from .words import chunks, column_bytes, release

DOCS, TOP, UNIT, ADD = 10, 10, 1_000_000_000, 2
SOURCES = 128  # sources of a block
HELD = 1_000_000  # rows that a task adds up before it sends them
CELLS = 1 << 20  # numbers of one array in the second scan

_ROWS = "lang string, term string, source string, document long, docs long, n long"
_KEPT = "lang string, term string, source string, n long, everywhere long, lead boolean"
_PAIRS = "lang string, a int, b int, value long, seen long"

#: bytes of a term stay, A-Z as a-z; all others part terms
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


def _added(t: pa.Table) -> pa.Table:
    t = t.group_by(["lang", "term", "source"], use_threads=False).aggregate([("document", "min"), ("docs", "sum"), ("n", "sum")])
    return t.rename_columns([c.removesuffix("_min").removesuffix("_sum") for c in t.column_names]).select(["lang", "term", "source", "document", "docs", "n"])


def counted(batch: pa.RecordBatch) -> pa.Table:
    """Rows (see _ROWS) of the documents of a batch (lang, source, document, text)."""
    data, off = column_bytes(batch.column("text"))
    lists = pc.split_pattern(_strings(_FOLD[data], off), " ")
    doc = pc.list_parent_indices(lists).to_numpy()
    words = pc.list_flatten(lists).dictionary_encode()
    code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    size = len(names)
    some = code != pc.index(names, "").as_py()
    each, n = np.unique(doc[some] * size + code[some], return_counts=True)
    groups = batch.select(["lang", "source"])
    rows = pa.table({"doc": each // max(size, 1), "code": each % max(size, 1), "n": n})
    out = {c: groups.column(c).take(rows["doc"]) for c in ("lang", "source")}
    out |= {"term": names.cast(pa.string()).take(rows["code"]), "document": batch.column("document").take(rows["doc"]), "docs": pa.array(np.ones(len(n), np.int64)), "n": rows["n"]}
    return _added(pa.table(out))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for whole in batches:
        for batch in chunks(whole, "text"):
            held.append(counted(batch))
            rows += held[-1].num_rows
            if rows > HELD:
                one = _added(pa.concat_tables(held))
                held, rows = [one], one.num_rows
                if 2 * rows > HELD:  # adding up doesn't help any more
                    yield from one.to_batches(1 << 16)
                    held, rows = [], 0
    if held:
        yield from _added(pa.concat_tables(held)).to_batches(1 << 16)
    release()


def _starts(t: pa.Table, names: list[str]) -> np.ndarray:
    """Places where a run of equal ``names`` begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in names:
        col = t.column(c)
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False) if t.num_rows > 1 else False
    return np.flatnonzero(new)


def _frequencies(least: int):
    """Sorted rows to the counts of terms that at least ``least`` documents hold (see _KEPT)."""

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        runs = _starts(t, ["lang", "term"])
        size = np.diff(np.append(runs, t.num_rows))
        docs, n = (np.add.reduceat(t.column(c).to_numpy(), runs) for c in ("docs", "n"))
        lead = np.zeros(t.num_rows, bool)
        lead[runs] = True
        out = t.select(["lang", "term", "source", "n"]).append_column("everywhere", pa.array(np.repeat(n, size))).append_column("lead", pa.array(lead))
        yield from out.filter(pa.array(np.repeat(docs >= least, size))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the run that the last batch ended in, one row a source
        for batch in batches:
            t = pa.Table.from_batches([batch]).select(["lang", "term", "source", "docs", "n"])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            at = _starts(t, ["lang", "term", "source"])
            sums = [pa.array(np.add.reduceat(t.column(c).to_numpy(), at)) for c in ("docs", "n")]
            t = pa.table([*t.select(["lang", "term", "source"]).take(pa.array(at)).columns, *sums], names=["lang", "term", "source", "docs", "n"])
            last = int(_starts(t, ["lang", "term"])[-1])
            held = t.slice(last).combine_chunks()
            if last:
                yield from emit(t.slice(0, last))
        if held is not None:
            yield from emit(held)
        release()

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + ADD) / total), exact: the product is taken in two steps that stay below 2**63 for totals up to 2**48."""
    step = 31_250
    high, rest = np.divmod((count + ADD) * step, total)
    return 1 + high * (UNIT // step) + rest * (UNIT // step) // total


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, i, j, salt, term, source, n, total) to partial values of all pairs of two blocks of ``size`` sources (see _PAIRS).

    Each stretch of (lang, i, j, salt) begins with a row without a term for each of its sources.
    """
    names = ["lang", "i", "j", "salt", "term", "source", "n", "total"]
    state: dict | None = None

    def close() -> Iterator[pa.RecordBatch]:
        if state is None or not state["seen"]:
            return
        left, right = state["left"], state["right"]
        own = left[:, None] < right[None, :]
        a, b = (x[own] for x in np.broadcast_arrays(left[:, None], right[None, :]))
        k = len(a)
        cols = [pa.array([state["lang"]] * k, pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(state["sum"][own]), pa.array(np.full(k, state["seen"], np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "a", "b", "value", "seen"])

    def feed(t: pa.Table) -> None:
        """Whole terms of one stretch."""
        nonlocal state
        term = t.column("term")
        seed = pc.is_null(term).to_numpy(zero_copy_only=False)
        source, n, total = (t.column(c).to_numpy() for c in ("source", "n", "total"))
        if seed.any():
            state["sources"] = np.concatenate([state["sources"], source[seed]])
            state["totals"] = np.concatenate([state["totals"], total[seed]])
        if seed.all():
            return
        if "sum" not in state:
            i, j = state["blocks"]
            state["left"], state["right"] = (state["sources"][state["sources"] // size == x] for x in (i, j))
            state["sum"] = np.zeros((len(state["left"]), len(state["right"])), np.int64)
        t, source, n = t.filter(pa.array(~seed)), source[~seed], n[~seed]
        runs = _starts(t, ["term"])
        at = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(n))))
        width = len(state["sources"])
        place = np.searchsorted(state["sources"], source)
        lo, hi = (np.searchsorted(state["sources"], x) for x in (state["left"], state["right"]))
        step = max(1, CELLS // width)
        for first in range(0, len(runs), step):
            a, b = np.searchsorted(at, [first, first + step])
            count = np.zeros((min(step, len(runs) - first), width), np.int64)
            count[at[a:b] - first, place[a:b]] = n[a:b]
            p = shares(count, state["totals"][None, :])
            for k, x in enumerate(lo):
                state["sum"][k] += divergences(p[:, x : x + 1], p[:, hi]).sum(axis=0)
        state["seen"] += len(runs)

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]).select(names)
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        keys = ["lang", "i", "j", "salt"]
        last = int(_starts(t, [*keys])[-1])
        # the last term of the last stretch may go on; a term has one row a source at most
        tail = t.slice(last)
        known = tail.column("term").fill_null("")  # terms are never empty
        last += int(_starts(pa.table({"term": known}), ["term"])[-1])
        rest, t = t.slice(last).combine_chunks(), t.slice(0, last)
        if not t.num_rows:
            continue
        stretches = _starts(t, keys)
        for a, b in zip(stretches, np.append(stretches[1:], t.num_rows), strict=True):
            key = [t.column(c)[int(a)].as_py() for c in keys]
            if state is None or state["key"] != key:
                yield from close()
                state = {"key": key, "lang": key[0], "blocks": key[1:3], "sources": np.zeros(0, np.int64), "totals": np.zeros(0, np.int64), "seen": 0}
            feed(t.slice(int(a), int(b - a)))
    if rest is not None:
        key = [rest.column(c)[0].as_py() for c in ("lang", "i", "j", "salt")]
        if state is None or state["key"] != key:
            yield from close()
            state = {"key": key, "lang": key[0], "blocks": key[1:3], "sources": np.zeros(0, np.int64), "totals": np.zeros(0, np.int64), "seen": 0}
        feed(rest)
    yield from close()
    release()


def _share(count: Column, total: Column) -> Column:
    """The same as :func:`shares` as a column of longs."""
    whole = (F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + ADD)).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", whole, total.cast("decimal(38,0)"))


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(spark: SparkSession, docs: DataFrame, least: int = DOCS, top: int = TOP, block: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs(text, lang, source)``; see the module for the method.

    Part ``pair`` has a row for every other source of the language, part ``term`` the ``top`` terms that the source uses more than its
    language. A null text, lang or source counts as ''; a row is a document, so repeated ids and repeated rows all count; groups
    without terms take part with counts of zero, a language's only source has no pairs, and where no term is kept all pairs have
    value 0. An empty table gives no rows. Texts are taken whole at any length. Ties go by the item's bytes. Other columns are ignored. Counts are exact up
    to 2**48 terms a language.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    sent = docs.withColumn("document", F.monotonically_increasing_id()).mapInArrow(_terms, _ROWS)
    runs = sent.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    kept = scratch(spark, runs.mapInArrow(_frequencies(least), _KEPT), "term-counts")

    by_lang = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(by_lang, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = groups.select(
        "lang", "source", zero(F.col("v")).alias("v"), (zero(F.col("own_n")) + 2 * zero(F.col("v"))).alias("total"), (zero(F.col("lang_n")) + 2 * zero(F.col("v"))).alias("lang_total"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("no"),
    )
    groups = scratch(spark, groups, "groups")

    # the sources of a language in blocks; a source meets every block, the pair of blocks is named with the smaller first
    own_block = F.expr(f"no div {block}")
    sizes = groups.groupBy("lang").agg((F.max(own_block) + 1).alias("blocks"))
    placed = groups.filter("v > 0").join(sizes, "lang").withColumn("own", own_block)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = [F.col("lang"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seeds = placed.select(*unit, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("string").alias("term"), F.col("no").alias("source"), F.lit(0).cast("long").alias("n"), "total")
    counts = kept.join(placed, ["lang", "source"]).select(*unit, F.pmod(F.xxhash64("term"), F.lit(salts)).cast("long").alias("salt"), "term", F.col("no").alias("source"), "n", "total")
    dealt = counts.union(seeds).repartition(salts, "lang", "i", "j", "salt").sortWithinPartitions("lang", "i", "j", "salt", F.asc_nulls_first("term"), "source")
    sums = dealt.mapInArrow(partial(_pair_sums, block), _PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))

    one = groups.select("lang", "source", F.col("no").alias("x"), F.col("total").alias("p_total"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("y"), F.col("total").alias("q_total"))
    pairs = one.join(two, "lang").filter("x <> y").withColumn("a", F.least("x", "y").cast("int")).withColumn("b", F.greatest("x", "y").cast("int"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left")
    nothing = F.lit(0).cast("long")
    absent = _value(_share(nothing, F.col("p_total")), _share(nothing, F.col("q_total")))
    value = F.when(F.col("v") == 0, nothing).otherwise(zero(F.col("value")) + (F.col("v") - zero(F.col("seen"))) * absent)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    used = kept.join(groups.filter("v > 0").select("lang", "source", "total", "lang_total"), ["lang", "source"])
    used = used.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("everywhere"), F.col("lang_total")).alias("q")).filter("p > q")
    terms = used.select("lang", "source", F.lit("term").alias("part"), "item", _value(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    best = terms.select("*", rank).filter(F.col("rank") <= top)  # Spark keeps the best of each task before it shuffles
    return pairs.select("*", rank).union(best)


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language of ``documents``: (lang, source, part, item, value, rank)."""
    return audit(spark, table(spark, sf_dir, "documents"))


#: op11 term by term and pair by pair
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
own AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
size_ AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups_ AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT g.lang, g.source, coalesce(max(s.v), 0) AS v, coalesce(sum(o.n), 0) AS total FROM groups_ g LEFT JOIN size_ s ON g.lang = s.lang LEFT JOIN own o ON g.lang = o.lang AND g.source = o.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 2) // (s.total + 2 * s.v)) AS p FROM sums s JOIN kept k ON s.lang = k.lang LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000::hugeint * (k.n + 2) // (s.total + 2 * s.v)) AS q FROM kept k JOIN size_ s ON k.lang = s.lang),
pair_values AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0) AS value FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_values v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
