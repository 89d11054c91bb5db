"""Approximate nearest neighbours by collision counting (query-aware LSH).

Each of ``LINES`` random directions gives one sorted array of the vectors' projections. A query opens a
window around its own projection on every line; a vector collides once for each window that holds it.
Windows widen step by step (virtual rehashing: same arrays, larger radius) until enough vectors have
collided on at least ``LEAST`` of the lines; those are verified by exact inner products in double
precision, most collisions first. Inner products become distances by one added coordinate that makes all norms of a range (a factor of 2) equal. A window
is a stretch of ranks, so collisions are counted by comparing each vector's ranks with the windows' ends.

Enough are ``VERIFY`` times the square root of the number of vectors, so the share that is verified falls as the table grows.
How many that has to be depends on the data (on norms, dimension and clusters), so each block measures it: the exact neighbours of ``SAMPLE`` queries
among all its vectors are known, and the number is doubled until ``SURE`` of them are found, at worst until every vector is verified.

Vectors are indexed in blocks of about ``BLOCK`` rows, all of them; queries visit every block in groups of
``QUERIES``, so a task holds one block and one group, whatever the table's size. The best of all blocks
are merged by rank. Each block verifies its part of the candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

LINES, LEAST, VERIFY, FIRST, WIDEN = 128, 0.8, 6.0, 1.6, 1.1  # radii in standard deviations of a line's projections
BLOCK, QUERIES, NEAREST, EVERY = 8192, 1024, 20, 20
SAMPLE, SURE = 24, 0.96
WHOLE = 512  # vectors of a range that is verified whole


def candidates(n: int) -> int:
    """How many of ``n`` vectors a query verifies at least."""
    return int(np.ceil(VERIFY * np.sqrt(n)))


def directions(dim: int, lines: int = LINES) -> np.ndarray:
    """``lines`` unit directions in stacked random orthonormal bases, the same in every task."""
    rng = np.random.default_rng(7919 + dim)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-lines // dim))]
    return np.concatenate(bases, axis=1)[:, :lines]


class Lines:
    """The sorted projections of a block's vectors and each vector's rank on every line."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.x, self.ids, self.rows = x, ids, rows
        n = len(ids)
        norm = np.sqrt((x * x).sum(axis=1))
        self.top = norm.max()
        lift = np.concatenate([x, np.sqrt(np.maximum(self.top * self.top - norm * norm, 0))[:, None]], axis=1)
        self.line = directions(lift.shape[1])
        proj = lift @ self.line
        order = np.argsort(proj, axis=0, kind="stable").astype(np.int32)
        self.base = np.ascontiguousarray(np.take_along_axis(proj, order, axis=0).T)
        self.rank = np.empty((proj.shape[1], n), np.uint16 if n < 65536 else np.uint32)
        np.put_along_axis(self.rank, order.T, np.arange(n, dtype=self.rank.dtype)[None, :], axis=1)
        self.spread = proj.std(axis=0)

    def enough(self, q: np.ndarray, qrows: np.ndarray, k: int, least: int, bound: np.ndarray, there: int) -> int:
        """The number of vectors to verify, ``least`` or more, at which SURE of the ``there`` neighbours at ``bound`` or nearer are found for these queries."""
        while least < len(self.ids):
            i, _, score, _ = self.find(q, qrows, k, least)
            if (score >= bound[i]).sum() >= SURE * there:
                break
            least *= 2
        return min(least, len(self.ids))

    def find(self, q: np.ndarray, qrows: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score, verified): places of queries and of their best ``k`` verified vectors of this block, the query's own row aside."""
        x, ids, rows, rank, base = self.x, self.ids, self.rows, self.rank, self.base
        n, m = len(ids), self.line.shape[1]
        qn = np.sqrt((q * q).sum(axis=1))
        mine = (np.concatenate([q * (self.top / qn)[:, None], np.zeros((len(q), 1))], axis=1)) @ self.line
        enough = min(n, max(enough, k + 1))
        least = int(np.ceil(LEAST * m))
        out: list[tuple[np.ndarray, ...]] = []
        radius = [FIRST * WIDEN**step for step in range(200)]
        live = np.arange(len(q))
        for step in range(len(radius) + 1):
            if not len(live):
                break
            wide = self.spread * (radius[step] if step < len(radius) else np.inf)
            left, size = np.empty((len(live), m, 1), rank.dtype), np.empty((len(live), m, 1), rank.dtype)
            for j in range(m):  # the window of every live query on this line
                left[:, j, 0] = np.searchsorted(base[j], mine[live, j] - wide[j], "left")
                size[:, j, 0] = np.searchsorted(base[j], mine[live, j] + wide[j], "right") - left[:, j, 0]
            rest = []
            for i, a, b in zip(live.tolist(), left, size, strict=True):
                count = (rank - a < b).sum(axis=0, dtype=np.uint16)  # whole numbers without a sign: what lies in front is large
                hit = np.flatnonzero(count >= least)
                if len(hit) < enough and step < len(radius):
                    rest.append(i)
                    continue
                # the last step may have brought far more: the threshold rises as long as enough are left, ties at it stay
                most = count[hit]
                hit = hit[most >= np.partition(most, len(most) - min(enough, len(most)))[len(most) - min(enough, len(most))]]
                best, score = nearest_of(x, ids, rows, q[i], qrows[i], hit, k)
                out.append((np.full(len(best), i), best, score, np.full(len(best), len(hit))))
            live = np.array(rest, np.int64)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_of(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, qrow: int, hit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` nearest of the places ``hit`` but for the query's own row, ties to the smaller id."""
    hit = hit[rows[hit] != qrow]
    if len(hit) > k:
        rough = x[hit] @ q
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        hit = hit[rough >= kth - 1e-9 * (1 + abs(kth))]
    score = (x[hit] * q).sum(axis=1)  # added up alike for every row, so equal vectors tie
    best = np.lexsort((rows[hit], ids[hit], -score))[:k]
    return hit[best], score[best]


def search_block(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, qrows: np.ndarray, k: int, enough: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score, verified): places of queries and of their best ``k`` verified vectors of this block, the query's own row aside.

    Vectors are indexed by ranges of norms, a factor of 2 each, the largest norms first; a query leaves out the ranges whose largest norm can't
    reach its ``k``-th score any more. As many are verified as a sample of the queries asks for; ``depth`` of a block's nearest matter (all ``k``, if none is given).
    """
    norm, qn = (np.sqrt((v * v).sum(axis=1)) for v in (x, q))
    depth = min(k if depth is None else depth, k, len(x) - 1)
    some = np.unique(np.linspace(0, len(q) - 1, SAMPLE).astype(int))
    exact = q[some] @ x.T
    exact[rows[None, :] == qrows[some][:, None]] = -np.inf
    bound = np.partition(exact, len(x) - depth, axis=1)[:, len(x) - depth] if depth > 0 else np.full(len(some), np.inf)
    bound = bound - 1e-9 * (1 + np.abs(bound))
    level = np.floor(np.log2(norm.max() / norm)).astype(int)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
    verified = np.zeros(len(q), np.int64)
    kth = np.full(len(q), -np.inf)
    for one in np.unique(level):
        own = np.flatnonzero(level == one)
        ask = np.flatnonzero(kth <= norm[own].max() * qn * (1 + 1e-9))
        if not len(ask):
            continue
        if len(own) <= max(WHOLE, k):
            got = [(i, *nearest_of(x, ids, rows, q[i], qrows[i], own, k), len(own)) for i in ask.tolist()]
        else:
            part = Lines(x[own], ids[own], rows[own])
            least = min(len(own), max(k + 1, -(-enough * len(own) // len(x))))
            least = part.enough(q[some], qrows[some], k, least, bound, int((exact[:, own] >= bound[:, None]).sum()))
            i, j, score, many = part.find(q[ask], qrows[ask], k, least)
            cut = np.searchsorted(i, np.arange(len(ask) + 1)) if (np.diff(i) >= 0).all() else None
            if cut is None:
                order = np.argsort(i, kind="stable")
                i, j, score, many = i[order], j[order], score[order], many[order]
                cut = np.searchsorted(i, np.arange(len(ask) + 1))
            got = [(int(ask[n]), own[j[a:b]], score[a:b], int(many[a]) if b > a else 0) for n, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
        for i, places, score, many in got:
            found[i].append((places, score))
            verified[i] += many
            best = np.concatenate([s for _, s in found[i]])
            if len(best) >= k:
                kth[i] = np.partition(best, len(best) - k)[len(best) - k]
    out = []
    for i, parts in enumerate(found):
        if parts:
            places, score = (np.concatenate(v) for v in zip(*parts, strict=True))
            best = np.lexsort((rows[places], ids[places], -score))[:k]
            out.append((np.full(len(best), i), places[best], score[best], np.full(len(best), verified[i])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_FOUND = "query_id long, query_row long, vec_id long, vec_row long, score double, verified long"


def _pairs(k: int, enough: int, depth: int):
    def run(t: pa.Table) -> pa.Table:
        ids, rows, isq = t.column("vec_id").to_numpy(), t.column("row").to_numpy(), t.column("query").to_numpy().astype(bool)
        flat = t.column("v").combine_chunks()
        if isinstance(flat, pa.ChunkedArray):
            flat = pa.concat_arrays(flat.chunks)
        v = flat.flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
        names = [c.split()[0] for c in _FOUND.split(", ")]
        if isq.all() or not isq.any():
            return pa.table([pa.array([], pa.float64() if c == "score" else pa.int64()) for c in names], names=names)
        # rows in order of id, so results don't hang on how they came
        x, q = np.flatnonzero(~isq), np.flatnonzero(isq)
        x, q = x[np.lexsort((rows[x], ids[x]))], q[np.lexsort((rows[q], ids[q]))]
        i, j, score, many = search_block(v[x], ids[x], rows[x], v[q], rows[q], k, enough, depth)
        return pa.table([pa.array(c) for c in (ids[q][i], rows[q][i], ids[x][j], rows[x][j], score, many)], names=names)

    return run


def nearest(spark: SparkSession, vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the ``k`` best inner products found for each row whose id ``every`` divides.

    Vectors that are null, zero, or hold a null or non-finite component take no part, neither do rows with a null
    id; a query meets the vectors of its own length. A query with fewer than ``k`` candidates gets all of them;
    ties go to the smaller id. Repeated ids are rows of their own: each that ``every`` divides asks, and meets the
    others of its id. ``verified`` counts the vectors of all blocks that the query was compared with, as far as they had a row among
    the best. Other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    v = v.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).filter(F.exists("v", lambda c: c != 0))
    v = Scratch(spark, v.withColumn("row", F.monotonically_increasing_id()), "vectors").df  # rows are numbered once
    n, q = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-q // QUERIES))
    own = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(groups)).cast("int")
    data = v.select("vec_id", "row", "v", F.lit(False).alias("query"), own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    asks = v.filter(F.col("vec_id") % every == 0)
    asks = asks.select("vec_id", "row", "v", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group.alias("grp"))
    enough = -(-candidates(n) // blocks) + (k if blocks > 1 else 0)
    depth = k if blocks == 1 else min(k, 2 * -(-k // blocks) + 2)  # a block has its share of the nearest
    found = data.union(asks).withColumn("dim", F.size("v")).groupBy("block", "grp", "dim").applyInArrow(_pairs(k, enough, depth), _FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    total = F.sum(F.when(F.col("nth") == 1, F.col("verified"))).over(Window.partitionBy("query_id", "query_row"))
    nth = F.row_number().over(Window.partitionBy("query_id", "query_row", "vec_block").orderBy(F.desc("score"), "vec_id", "vec_row"))
    found = found.withColumn("vec_block", F.pmod(F.xxhash64("vec_row", F.lit(3)), F.lit(blocks)).cast("int"))
    found = found.withColumn("nth", nth).withColumn("verified", total).withColumn("rank", F.row_number().over(best))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def op5_collision_counting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` for every row whose id 20 divides."""
    return nearest(spark, table(spark, sf_dir, "embeddings"))
