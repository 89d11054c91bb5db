"""Embedding near-duplicates by Euclidean p-stable hashing.

Equal vectors are one class. Unit vectors are projected on Gaussian directions; ``k`` quantised projections
``floor((a.u + b) / WIDTH)`` make a bucket key, and as many tables are made as a pair at the least cosine needs to meet in one of
them with probability 1 - ``MISS``. ``k`` follows the number of vectors, so buckets keep their size as the table grows.
Candidates are confirmed by exact cosines in double precision.

Dense groups are not expanded into pairs. Classes within half the least angle of a pivot form a *ball*: any two of them are linked,
which the triangle inequality proves, so a ball needs no comparison inside and is one candidate outside. Pivots are found in
finer buckets (the keys of two tables together) in ``TURNS`` rounds; what joins no ball is a ball alone. Two balls are
linked whole, apart, or compared member by member in blocks, which their radii decide. Balls change cost and never results.

A bucket is compared in blocks of ``BLOCK`` balls. Its rows carry 8-bit copies of the centres with the copies' error, so only
pairs that may be linked leave a bucket, each with the exact check still to come.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, passing, scratch, table
from .words import U, mix, release, signed

LEAST, MISS = 0.9, 1e-4
WIDTH = 2.0  # of a quantised projection; a unit vector's projections have deviation 1
TARGET, BLOCK, SMALL = 64, 1024, 24  # balls of an average bucket, of a block, of a bucket compared by shifts
TURNS, FINE = 2, 8  # rounds of ball finding and the fine tables of each
MEMBERS = 1024  # members of a block of a ball
SLACK = 1e-6  # radians


def meeting(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance fall into the same cell of one quantised projection."""
    c = width / distance
    return erf(c / sqrt(2)) - 2 / (sqrt(2 * pi) * c) * (1 - exp(-c * c / 2))


def plan(n: int, least: float = LEAST) -> tuple[int, int]:
    """(projections of a key, tables) for ``n`` vectors."""
    far, near = meeting(sqrt(2)), meeting(sqrt(2 - 2 * least))
    k = max(1, round(log(max(n, 1) / TARGET) / -log(far))) if n > TARGET else 1
    return k, ceil(log(MISS) / log(1 - near**k))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows are scaled by their largest entry first, so neither huge nor tiny vectors leave double precision."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _by_length(batch: pa.RecordBatch, col: str) -> Iterator[pa.RecordBatch]:
    size = np.array(pc.list_value_length(batch.column(col)))
    for d in np.unique(size):
        yield batch if (size == d).all() else batch.filter(pa.array(size == d))


def keys_of(u: np.ndarray, k: int, tables: int, tag: int = 0) -> np.ndarray:
    """(rows x tables) bucket keys; vectors of another length never share one."""
    dim = u.shape[1]
    rng = np.random.default_rng(7_368_787 + dim)
    a, b = rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables)
    cell = np.floor((u @ a + b) / WIDTH).astype(np.int64).view(U).reshape(len(u), tables, k)
    key = np.full((len(u), tables), U(dim * 2 + 1)) + np.arange(tables, dtype=U) * U(0x9E3779B97F4A7C15)
    for j in range(k):
        key = mix(key * U(0xD1342543DE82EF95) + cell[:, :, j])
    return key


def _hashed(k: int, tables: int):
    """(node, weight, u, keys) of classes (node, weight, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for one in _by_length(whole, "v"):
                for at in range(0, one.num_rows, 1024):
                    batch = one.slice(at, 1024)
                    u = unit(_matrix(batch.column("v")).astype(np.float64))
                    key = keys_of(u, k, tables)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (u, signed(key))]
                    yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), *lists], names=["node", "weight", "u", "keys"])
        release()

    return run


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of rows (a, b, x, y)."""
    for batch in batches:
        for one in _by_length(batch, "x"):
            cos = (_matrix(one.column("x")) * _matrix(one.column("y"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([one.column("a"), one.column("b"), pa.array(cos)], names=["a", "b", "cosine"])


def compact(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit copies of unit vectors: (whole numbers, scale, error), u = scale * number but for a vector of length ``error``."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in _by_length(batch, "u"):
            q, scale, error = compact(_matrix(one.column("u")))
            off = pa.py_buffer((np.arange(len(q) + 1) * q.shape[1]).astype(np.int32).tobytes())
            copies = pa.BinaryArray.from_buffers(pa.binary(), len(q), [None, off, pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([one.column("node"), copies, pa.array(scale), pa.array(error)], names=["node", "copy", "scale", "error"])


def _may_link(theta: float):
    """Pairs (a, b) of a bucket's balls that may hold a link. Rows come sorted by (key, i, j); ``side`` 0 meets side 1, side 2 its own."""

    def compare(q: np.ndarray, node: np.ndarray, side: np.ndarray, start: np.ndarray, scale: np.ndarray, error: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def near(i: np.ndarray, j: np.ndarray, dot: np.ndarray) -> np.ndarray:
            return dot * scale[i] * scale[j] + error[i] + error[j] * (1 + error[i]) >= np.cos(np.minimum(theta + radius[i] + radius[j], pi)) - 1e-9

        size = np.diff(np.append(start, len(node)))
        own = np.repeat(size, size)
        place = np.arange(len(node)) - np.repeat(start, size)
        few = own <= SMALL
        for shift in range(1, SMALL):
            i = np.flatnonzero(few & (place + shift < own))
            if not len(i):
                break
            j = i + shift
            ok = (side[i] != side[j]) | (side[i] == 2)
            i, j = i[ok], j[ok]
            ok = near(i, j, np.einsum("ij,ij->i", q[i], q[j]))
            yield i[ok], j[ok]
        for s, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
            x = q[s : s + m]
            dot = x @ x.T
            one, two = np.arange(s, s + m)[:, None], np.arange(s, s + m)[None, :]
            ok = near(one, two, dot) & ((side[one] != side[two]) | (side[one] == 2)) & (one < two)
            i, j = np.nonzero(ok)
            yield i + s, j + s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            node, side, scale, error, radius = (t.column(c).to_numpy() for c in ("node", "side", "scale", "error", "radius"))
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            col = t.column("copy").combine_chunks()
            width = len(col[0].as_py())  # a key's vectors have one length
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            if (np.diff(off) != width).any():
                size = np.diff(off)
                for w in np.unique(size):
                    yield from pairs(t.filter(pa.array(size == w)))
                return
            q = np.frombuffer(col.buffers()[2], np.int8)[off[0] : off[-1]].reshape(len(node), width).astype(np.float32 if width <= 1024 else np.float64)
            for i, j in compare(q, node, side, start, scale, error, radius):
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            last = int(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))[-1])
            held = t.slice(last).combine_chunks()
            if last:
                yield from pairs(t.slice(0, last))
        if held is not None:
            yield from pairs(held)
        release()

    return run


def _members(least: float):
    """(node, more, a, b): for each member of two blocks of balls a and b, the rows it is linked with on the other side, if any."""

    def run(t: pa.Table) -> pa.Table:
        node, weight, ball, a, b = (t.column(c).to_numpy() for c in ("node", "weight", "ball", "a", "b"))
        u = _matrix(t.column("u"))
        x, y = np.flatnonzero(ball == a), np.flatnonzero(ball == b)
        ok = u[x] @ u[y].T >= least
        more = np.zeros(len(node), np.int64)
        more[x], more[y] = ok @ weight[y], weight[x] @ ok
        some = more > 0
        return pa.table({"node": node[some], "more": more[some], "a": a[some], "b": b[some]})

    return run


def _balls(spark: SparkSession, hashed: DataFrame, k: int, tables: int, theta: float) -> DataFrame:
    """(node, ball, angle) of the classes in balls of two and more; the pivot's own angle is 0."""
    fine = min(FINE, tables // 2)
    near = float(np.cos(theta / 2 - SLACK))
    left, out = hashed, None
    for turn in range(TURNS):
        first = 2 * fine * turn % max(1, tables - 2 * fine + 1)
        both = F.array(*[F.xxhash64(F.lit(i), F.element_at("keys", first + 2 * i + 1), F.element_at("keys", first + 2 * i + 2)) for i in range(fine)])
        if not fine:
            break
        cells = left.select("node", F.explode(both).alias("cell"))
        pivots = cells.groupBy("cell").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last").drop("last")
        stars = cells.join(pivots, "cell").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
        one, two = (hashed.select(F.col("node").alias(c), F.col("u").alias(u)) for c, u in (("a", "x"), ("b", "y")))
        stars = scratch(spark, stars.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_angles, "a long, b long, cosine double").filter(F.col("cosine") >= near), "stars")
        # a pivot that is itself near a smaller one waits for the next turn
        roots = stars.select("b").distinct().join(stars.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        joined = stars.join(roots, "b").groupBy("a").agg(F.min(F.struct("b", "cosine")).alias("p"))
        joined = joined.select(F.col("a").alias("node"), F.col("p.b").alias("ball"), (F.acos(F.least(F.col("p.cosine"), F.lit(1.0))) + SLACK / 4).alias("angle"))
        own = joined.select(F.col("ball").alias("node"), F.col("ball"), F.lit(0.0).alias("angle")).distinct()
        made = scratch(spark, joined.union(own), "balls")
        out = made if out is None else out.union(made)
        if not made.head(1):
            break
        left = left.join(made.select("node"), "node", "left_anti")
    return spark.createDataFrame([], "node long, ball long, angle double") if out is None else out


def links(spark: SparkSession, classes: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(counts, labels) of ``classes(node, weight, v)``: ``counts(node, more)`` rows of other classes linked with each class
    that has any, ``labels(node, label)`` the smallest ball reachable for all classes."""
    theta = float(np.arccos(least))
    k, tables = plan(classes.count(), least)
    hashed = scratch(spark, classes.mapInArrow(_hashed(k, tables), "node long, weight long, u array<double>, keys array<long>"), "hashed")
    dense = scratch(spark, _balls(spark, hashed, k, tables, theta), "dense")
    copies = hashed.select("node", "u").mapInArrow(_copied, "node long, copy binary, scale double, error double")
    alone = hashed.select("node", "keys").join(dense.select("node"), "node", "left_anti").select("node", F.explode("keys").alias("key"), F.lit(0.0).alias("radius"))
    radii = dense.groupBy("ball").agg(F.max("angle").alias("radius"))
    inside = hashed.select("node", "keys").join(dense, "node").select(F.col("ball"), F.explode("keys").alias("key")).distinct().join(radii, "ball").select(F.col("ball").alias("node"), "key", "radius")
    placed = scratch(spark, alone.union(inside), "placed")

    wide = placed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    met = placed.join(wide, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    met = met.select("node", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "radius")
    met = met.join(copies, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = scratch(spark, met.mapInArrow(_may_link(theta), "a long, b long").distinct(), "pairs")

    one = hashed.select(F.col("node").alias("a"), F.col("u").alias("x"))
    two = hashed.select(F.col("node").alias("b"), F.col("u").alias("y"))
    measured = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_angles, "a long, b long, cosine double")
    sizes = dense.join(hashed.select("node", "weight"), "node").groupBy("ball").agg(F.max("angle").alias("r"), F.sum("weight").alias("w"), F.count("*").alias("c"))
    units = hashed.select(F.col("node").alias("ball"), "weight").join(sizes, "ball", "left")
    units = units.select("ball", F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("w", "weight").alias("w"), F.coalesce("c", F.lit(1)).alias("c"))
    sized = units.select(F.col("ball").alias("a"), F.col("r").alias("ra"), F.col("w").alias("wa"), F.col("c").alias("ca"))
    other = units.select(F.col("ball").alias("b"), F.col("r").alias("rb"), F.col("w").alias("wb"), F.col("c").alias("cb"))
    angle, reach = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))), F.col("ra") + F.col("rb")
    single = (F.col("ca") == 1) & (F.col("cb") == 1)
    whole = F.when(single, F.col("cosine") >= least).otherwise(angle + reach <= theta - SLACK)
    judged = measured.join(sized, "a").join(other, "b").withColumn("whole", whole).withColumn("part", ~F.col("whole") & ~single & (angle - reach <= theta + SLACK))
    judged = scratch(spark, judged.filter("whole or part"), "judged")

    # balls linked whole: every member counts all of the other side
    full = judged.filter("whole")
    gains = full.select(F.col("a").alias("ball"), F.col("wb").alias("more")).union(full.select(F.col("b").alias("ball"), F.col("wa").alias("more")))
    gains = gains.groupBy("ball").agg(F.sum("more").alias("more"))
    membership = hashed.select("node", "weight").join(dense.select("node", "ball"), "node", "left").select("node", "weight", F.coalesce("ball", "node").alias("ball"))
    outside = membership.join(gains, "ball").select("node", "more")
    within = membership.join(sizes.select("ball", "w"), "ball").select("node", (F.col("w") - F.col("weight")).alias("more"))

    # balls that may be linked in part: blocks of members against blocks of members
    part = judged.filter("part").select("a", "b", F.ceil(F.col("ca") / MEMBERS).cast("int").alias("na"), F.ceil(F.col("cb") / MEMBERS).cast("int").alias("nb"))
    rows = membership.join(hashed.select("node", "u"), "node")

    def dealt(me: str, mine: str, theirs: str) -> DataFrame:
        got = part.withColumn("ball", F.col(me)).join(rows, "ball").withColumn("own", F.pmod(F.xxhash64("node"), F.col(mine).cast("long")).cast("int"))
        got = got.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
        i, j = ("own", "other") if me == "a" else ("other", "own")
        return got.select("a", "b", F.col(i).alias("i"), F.col(j).alias("j"), "ball", "node", "weight", "u")

    compared = dealt("a", "na", "nb").union(dealt("b", "nb", "na"))
    checked = scratch(spark, compared.groupBy("a", "b", "i", "j").applyInArrow(_members(least), "node long, more long, a long, b long"), "members")
    counts = outside.union(within).union(checked.select("node", "more")).groupBy("node").agg(F.sum("more").alias("more"))
    edges = full.select("a", "b").union(checked.select("a", "b").distinct())
    labels = connected_components(spark, edges).select(F.col("node").alias("ball"), "label")
    return counts, membership.join(labels, "ball", "left").select("node", F.coalesce("label", "ball").alias("label"))


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors(vec_id, embedding)``.

    Two rows are linked if their vectors, of one length, have a cosine of ``least`` or more; ``n_links`` counts the other rows that a row is linked
    with, ``component_id`` is the smallest ``vec_id`` reachable. Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing; so do rows with a null id, whose component is null and which are kept. Repeated ids stay rows of
    their own, linked by their vectors alone. Pairs are found with probability 1 - ``MISS`` at the least cosine, above it
    more surely; none below it is linked. Other columns are ignored.
    """
    with passing() as keep:
        v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
        good = F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()
        v = v.withColumn("good", good).withColumn("v", F.when(good, F.transform("v", lambda c: c + F.lit(0.0))))  # -0.0 is 0.0
        v = v.withColumn("row", F.monotonically_increasing_id())
        v = scratch(spark, v.withColumn("d1", F.xxhash64("v")).withColumn("d2", F.xxhash64(F.lit(1), "v")), "vectors")
        alive = v.filter("good")
        groups = alive.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("vec_id").alias("first"), F.count("*").alias("weight"))
        groups = scratch(spark, groups, "classes")
        carriers = alive.select(F.col("row").alias("node"), "v").join(groups.select("node", "weight"), "node")
        counts, labels = links(spark, carriers.select("node", "weight", "v"), least)
        named = scratch(spark, groups.join(labels, "node").join(counts, "node", "left").select("d1", "d2", "first", "weight", "more", "label"), "named")
        lowest = named.groupBy("label").agg(F.min("first").alias("lowest"))
        judged = named.join(lowest, "label").select("d1", "d2", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "lowest")
        out = v.withColumn("d1", F.when(F.col("good"), F.col("d1"))).drop("v").join(judged, ["d1", "d2"], "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("lowest", "vec_id").alias("component_id"))
        out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
        return keep(Scratch(spark, out, "linked"))


def op13_pstable_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 between all rows of ``embeddings``: (vec_id, n_links, component_id, kept)."""
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


#: op13 by comparing all pairs
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_ AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept FROM least_ LEFT JOIN n USING (vec_id)
"""
