"""MinHash near-duplicates by min-max hashing.

Each of ``PERMS`` permutations of the shingle hashes gives two signature values, its minimum and its
maximum, so a signature of ``2 * PERMS`` values costs ``PERMS`` hash evaluations. ``ROWS`` values make a
band. With 32 bands of 5 a pair at similarity 0.8 misses every band with probability 3e-6.

Links are confirmed on the full shingle sets. No bucket is expanded into pairs:

1. texts with equal sets are one class with a number of its own, so rows that share an id don't mix;
2. in each bucket every class is compared with the bucket's pivot, and components are formed;
3. buckets that still hold several components get another pivot;
4. what remains (classes outside their bucket's main component) is compared with all the rest of the
   bucket block by block; a block pair ships at most 2 * BLOCK sets and returns spanning links only.

Step 4 is exact, so pivots decide cost and never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .words import U, Words, chunks, column_bytes, mix, release, shingles, signed

PERMS, ROWS, TURNS = 80, 5, 1
BANDS = 2 * PERMS // ROWS
BLOCK, BLOCK_SHINGLES = 256, 1_000_000  # classes and shingles of one block
_RNG = np.random.default_rng(20240613)
_MUL = _RNG.integers(1, 1 << 63, PERMS, dtype=np.uint64) * U(2) + U(1)
_XOR = _RNG.integers(1, 1 << 63, PERMS, dtype=np.uint64)


def distinct_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets by row) of a batch's text column."""
    h, off = shingles(Words(*column_bytes(batch.column(batch.schema.get_field_index("text")))), size)
    own = [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    out = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(x) for x in own], out=out[1:])
    return (np.concatenate(own) if own else h), out


def _signature(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """2 * PERMS values for each row that has shingles (off: only such rows)."""
    at = off[:-1]
    out = np.empty((len(at), 2 * PERMS), U)
    for p in range(PERMS):
        y = (x ^ _XOR[p]) * _MUL[p]
        y ^= y >> U(32)
        out[:, p] = np.minimum.reduceat(y, at)
        out[:, PERMS + p] = np.maximum.reduceat(y, at)
    return out


def _digests(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set; off: only rows that have shingles."""
    return np.add.reduceat(x, off[:-1]), np.bitwise_xor.reduceat(mix(x), off[:-1])


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                x, off = distinct_sets(batch, size)
                n = np.diff(off)
                has = np.flatnonzero(n > 0)
                d1, d2 = np.zeros(len(n), U), np.zeros(len(n), U)
                keys = np.zeros((len(n), BANDS), U)
                if len(has):
                    packed = np.concatenate([off[:-1][has], off[-1:]])
                    d1[has], d2[has] = _digests(x, packed)
                    sig = _signature(x, packed)
                    k = np.zeros((len(has), BANDS), U)
                    for r in range(ROWS):
                        k = mix(k * U(0xD1342543DE82EF95) + sig[:, r::ROWS])
                    keys[has] = mix(k + np.arange(BANDS, dtype=U))
                bands = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)),
                    pa.array(signed(keys[has].ravel())),
                )
                own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(signed(d1)), pa.array(signed(d2)), bands], names=["doc_id", "hash", "n_shingles", "d1", "d2", "bands"])

    return run


def _sets(size: int):
    """(node, words): the sets of rows whose text is that of their class; another text of a repeated id is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                x, off = distinct_sets(batch, size)
                b = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * 8).tobytes()), pa.py_buffer(x.tobytes())])
                node, hash_, own = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "hash", "own"))
                out = pa.RecordBatch.from_arrays([node, b.cast(pa.binary())], names=["node", "words"])
                yield out.filter(pa.array(hash_.to_numpy() == own.to_numpy()))
                del x, b, out

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    na, nb = len(a), len(b)
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (na + nb - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            left, right = t.column(2), t.column(3)
            keep = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(left, right, strict=True)]
            t = t.filter(pa.array(keep, pa.bool_()))
            yield t.select(["a", "b"])

    return run


def _block_links(percent: int):
    """Links between the rows of side 0 and those of side 1 (side 2: also among themselves) that join labels."""

    def run(t: pa.Table) -> pa.Table:
        node, label, side = (t.column(c).to_numpy() for c in ("node", "label", "side"))
        sets = [np.frombuffer(x.as_buffer(), U) for c in t.column("words").chunks for x in c]
        n = len(sets)
        size = np.array([len(s) for s in sets])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        who = np.repeat(np.arange(n), size)
        both = np.zeros((n, n), np.float32)
        width = 1 << 12  # columns of the product at a time
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            a, b = np.searchsorted(at, [lo, lo + width])
            m = np.zeros((n, width), np.float32)
            m[who[a:b], at[a:b] - lo] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        ok &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
            x, y = find(label[i]), find(label[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((node[i], node[j]))
        del sets, both, at, who, order
        release()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _classes(spark: SparkSession, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, labels): ``rows(doc_id, hash, n_shingles, d1, d2)`` of all documents, one node for each set of
    shingles in ``classes(n_shingles, d1, d2, first, node)`` and the least node reachable of those with links in ``labels(node, label)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    feats = Scratch(spark, docs.mapInArrow(_features(size), "doc_id long, hash long, n_shingles long, d1 long, d2 long, bands array<long>"), "minmax")
    alive = feats.df.filter("n_shingles > 0 and doc_id is not null")
    lead = F.min(F.struct("doc_id", "hash")).alias("first")
    # nodes are numbered once, in a written table, so they stay what they are
    classes = Scratch(spark, alive.groupBy("n_shingles", "d1", "d2").agg(lead).withColumn("node", F.monotonically_increasing_id()), "classes").df
    own = classes.select("n_shingles", "d1", "d2", "node", F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("own"))
    # only one row of each class carries its bands on; equal rows carry equal ones
    carriers = alive.withColumnRenamed("hash", "own").join(own, ["n_shingles", "d1", "d2", "doc_id", "own"])
    bands = carriers.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("n")).filter("pivot <> last")
    shared = Scratch(spark, bands.join(buckets.drop("last"), "key").distinct(), "buckets")
    needed = shared.df.select("node").distinct().join(own.select("node", "doc_id", "own"), "node")
    texts = docs.join(needed.withColumn("hash", F.col("own")), ["doc_id", "hash"]).select("node", "hash", "own", "text")  # by text, so that rows of one id meet their own class alone
    sets = Scratch(spark, texts.mapInArrow(_sets(size), "node long, words binary").dropDuplicates(["node"]), "sets", "none")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = sets.df.select(F.col("node").alias("a"), F.col("words").alias("x"))
        two = sets.df.select(F.col("node").alias("b"), F.col("words").alias("y"))
        rows = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y")
        return rows.mapInArrow(_confirm(percent), "a long, b long")

    links = Scratch(spark, confirmed(shared.df.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "links").df
    labels = connected_components(spark, links)

    def unresolved() -> DataFrame:
        """Members, with their labels, of buckets that may hold links nobody has looked for."""
        named = shared.df.filter("n > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        return named.join(open_, "key")

    for turn in range(1, TURNS + 1):
        rest = Scratch(spark, unresolved(), "rest").df
        if not rest.head(1):
            break
        seat = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "label")
        pivots = rest.groupBy("key").agg(F.min(seat).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.label").alias("own"))
        pairs = rest.join(pivots, "key").filter("label <> own").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        links = links.union(Scratch(spark, confirmed(pairs), "links").df)
        labels = Scratch(spark, connected_components(spark, links), "labels").df

    else:
        rest = Scratch(spark, unresolved(), "rest").df
    if rest.head(1):
        rest = rest.join(classes.select("node", "n_shingles"), "node")
        per = rest.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
        main = per.groupBy("key").agg(F.max(F.struct("m", "label", "w")).alias("top"), F.sum("m").alias("n"), F.sum("w").alias("all"))

        def blocks(m: str, w: str) -> Column:
            return F.ceil(F.greatest(F.expr(m) / BLOCK, F.expr(w) / BLOCK_SHINGLES)).cast("int")

        main = main.select("key", F.col("top.label").alias("main"), blocks("top.m", "top.w").alias("c0"), blocks("n - top.m", "all - top.w").alias("c1"))
        rest = rest.join(main, "key").withColumn("major", F.col("label") == F.col("main"))
        slot = F.pmod(F.xxhash64("node"), F.when(F.col("major"), F.col("c0")).otherwise(F.col("c1")).cast("long")).cast("int")
        rest = rest.withColumn("s", slot)
        # a unit is (minor block i, block j of the main component), or (minor block i, minor block j >= i)
        main_unit = F.lit(True).alias("cross")
        a = rest.filter("major").select("key", "node", "label", F.explode(F.sequence(F.lit(0), F.col("c1") - 1)).alias("i"), F.col("s").alias("j"), main_unit, F.lit(0).alias("side"))
        b = rest.filter("not major").select("key", "node", "label", F.col("s").alias("i"), F.explode(F.sequence(F.lit(0), F.col("c0") - 1)).alias("j"), main_unit, F.lit(1).alias("side"))
        other = F.explode(F.sequence(F.lit(0), F.col("c1") - 1)).alias("o")
        c = rest.filter("not major").select("key", "node", "label", "s", other).select(
            "key", "node", "label", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), F.lit(False).alias("cross"),
            F.when(F.col("s") == F.col("o"), 2).when(F.col("s") < F.col("o"), 0).otherwise(1).alias("side"),
        )
        units = a.union(b).union(c).join(sets.df, "node")
        found = units.groupBy("key", "i", "j", "cross").applyInArrow(_block_links(percent), "a long, b long")
        links = links.union(Scratch(spark, found, "links").df)
        labels = Scratch(spark, connected_components(spark, links), "labels").df

    labels = Scratch(spark, labels, "labels").df
    shared.drop()
    sets.drop()
    return feats.df.drop("bands"), classes, labels


def components(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs(doc_id, text)``.

    ``size`` words make a shingle; two documents are linked if their sets of distinct shingles have
    ``100 * intersection >= percent * union``. ``component_id`` is the smallest ``doc_id`` reachable.
    Null or empty texts have no shingles and are linked with nothing; a text of fewer than ``size`` words
    has its whole sequence as its one shingle. Rows with a null ``doc_id`` take no part and come back with
    a null component, kept. Repeated ids stay repeated rows; rows that share an id are one document with all their
    texts' links. Texts are taken whole at any length. Other columns of ``docs`` are ignored.
    """
    rows, classes, labels = _classes(spark, docs, size, percent)
    named = classes.join(labels, "node", "left").select("n_shingles", "d1", "d2", "first", "node", F.coalesce("label", "node").alias("label"))
    # texts of one id that are not linked themselves
    own = rows.filter("n_shingles > 0 and doc_id is not null").join(named, ["n_shingles", "d1", "d2"])
    ids = own.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("doc_id", "a")
    ties = Scratch(spark, own.join(ids, "doc_id").select("a", F.col("label").alias("b")).filter("a <> b").distinct(), "ties")
    if ties.df.head(1):
        joined = connected_components(spark, ties.df).select(F.col("node").alias("label"), F.col("label").alias("least"))
        named = named.join(joined, "label", "left").withColumn("label", F.coalesce("least", "label")).drop("least")
    named = Scratch(spark, named, "named").df
    least = named.groupBy("label").agg(F.min("first.doc_id").alias("c"))
    part = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return (
        rows.join(named.join(least, "label").select("n_shingles", "d1", "d2", "c"), ["n_shingles", "d1", "d2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), part).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def near_dedup(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are near copies of an earlier row; all columns stay.

    Here a row is judged by its own text: of each group of linked rows exactly one stays, that with the smallest id
    and, of repeated ids, the smallest hash of its text; of rows equal in both any one, taken by the hash of all
    columns. Rows that share an id and are no near copies of each other all stay. Rows without words or without an id
    have no copies and stay as they are.
    """
    rows, classes, labels = _classes(spark, docs, size, percent)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    winners = named.groupBy("label").agg(F.min("first").alias("w"))
    alive = rows.filter("n_shingles > 0 and doc_id is not null")
    judged = alive.join(named.join(winners, "label").select("n_shingles", "d1", "d2", "w"), ["n_shingles", "d1", "d2"])
    lost = judged.filter(F.struct("doc_id", "hash") != F.col("w")).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    lost = Scratch(spark, lost, "lost").df
    on = (F.col("doc_id") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    kept = docs.join(lost, on, "left_anti")
    twice = alive.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    twice = Scratch(spark, twice, "twice").df
    if not twice.head(1):
        return kept
    again = kept.join(twice, on).select(docs["*"], F.col("__id"), F.col("__hash"))
    plain = [c for c, t in docs.dtypes if not t.startswith("map")]
    one = again.groupBy("__id", "__hash").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("r")).select("r.*")
    return kept.join(twice, on, "left_anti").unionByName(one)


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles over whole ``documents`` at 0.8: (doc_id, n_shingles, component_id, kept)."""
    from .common import table

    return components(spark, table(spark, sf_dir, "documents"), size=2, percent=80)


#: op6 by comparing all documents that share a shingle
ORACLE = r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM split),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (total - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::bigint AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_ USING (doc_id)
"""
