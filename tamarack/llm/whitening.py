"""Embedding whitening by a randomised range finder.

A random orthonormal basis Q of the wanted components and ``OVER`` more directions is multiplied with the covariance again and again;
each multiplication is one pass over all centred rows (a task adds up C'(CQ) over its rows, Spark adds up the tasks),
followed by a QR step. A Rayleigh-Ritz step on the last product gives components and eigenvalues. If a residual
``|Vc - ec|``, measured against the gap to the next eigenvalue, is above ``RESIDUAL``, the basis is doubled (up to the full dimension,
where the product is the covariance itself and the step is exact) and the passes go on.

Entries are made whole numbers, so sums and deviations are exact. The driver holds matrices of dimension x basis only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .words import release

SCALE, WANTED, OVER, PASSES = 256, 4, 12, 2
RESIDUAL = 1e-13
ROWS = 4096  # rows of one product

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"
_CELLS = "cell long, value double"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.slice(at, ROWS).column("x"), dim)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in double precision; whole numbers are subtracted before the division, where they fit."""
    total = np.array(sums, object)
    if n * max(1, int(np.abs(x.astype(np.float64)).max(initial=0))) < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return (n * x - np.array(sums, np.int64)) / n
    return x.astype(np.float64) - (total / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(value, fits): the sums over dimensions of (n*x - S)**2. Products are taken modulo 2**64, so a sum that fits a long is exact."""
    wrap = np.array([s & ((1 << 64) - 1) for s in sums], np.uint64)
    d = np.uint64(n & ((1 << 64) - 1)) * x.astype(np.int64).view(np.uint64) - wrap
    rough = n * x.astype(np.float64) - np.array(sums, np.float64)
    return (d * d).sum(axis=1, dtype=np.uint64).view(np.int64), (rough * rough).sum(axis=1) < 9.2e18


def _sums(dim: int):
    """Exact sums of each dimension, its upper and lower 32 bits apart, so that no task's sum leaves a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for x in _blocks(batches, dim):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * dim + 1)), pa.array(np.concatenate([[n], high, low]))], names=["cell", "value"])
        release()

    return run


def _product(dim: int, n: int, sums: list[int], q: np.ndarray | None, scale: np.ndarray | None = None):
    """Cells of V q (of V itself without q; with ``scale`` of the covariance of the rows' scaled coordinates on q), then V's trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = None, 0.0
        for x in _blocks(batches, dim):
            c = centred(x, n, sums)
            left = c if scale is None else c @ q / scale
            part = left.T @ (left if scale is not None or q is None else c @ q)
            total, squares = part if total is None else total + part, squares + float((c * c).sum())
        if total is not None:
            flat = np.append(total.ravel(), squares) / n
            for at in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(len(flat), at + (1 << 16)))), pa.array(flat[at : at + (1 << 16)])], names=["cell", "value"])
        release()

    return run


def _gather(fit: DataFrame, run, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
    """(the matrix whose cells the tasks have added up, V's trace); rows x columns numbers come to the driver, however many rows there are."""
    out = np.zeros(shape[0] * shape[1] + 1)
    for cell, value in fit.mapInArrow(run, _CELLS).groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out[:-1].reshape(shape), float(out[-1])


def range_finder(product, dim: int, wanted: int, over: int = OVER, passes: int = PASSES, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(eigenvalues, components as columns, the basis sizes tried) of the symmetric matrix that ``product(q)`` multiplies by; q None asks for the matrix."""
    size, tried = min(dim, wanted + over), []
    q = np.linalg.qr(np.random.default_rng(40_503 + dim).standard_normal((dim, size)))[0]
    while True:
        tried.append(size)
        if size == dim:
            v = product(None)
            e, c = np.linalg.eigh((v + v.T) / 2)
            return e[::-1][:wanted], c[:, ::-1][:, :wanted], tried
        for _ in range(passes):
            q = np.linalg.qr(product(q))[0]
        y = product(q)
        h = q.T @ y
        e, c = np.linalg.eigh((h + h.T) / 2)
        e, c = e[::-1], c[:, ::-1]
        left = np.linalg.norm(y @ c - (q @ c) * e, axis=0)[:wanted]
        # an eigenvector is off by about the residual over the gap to the nearest other eigenvalue
        gap = np.array([min(abs(e[i] - x) for j, x in enumerate(e) if j != i) for i in range(wanted)])
        if (left <= residual * np.maximum(gap, 1e-300)).all():
            return e[:wanted], (q @ c)[:, :wanted], tried
        more = min(dim, 2 * size)
        fresh = np.random.default_rng(40_503 + dim + more).standard_normal((dim, more - size))
        q, size = np.linalg.qr(np.concatenate([np.linalg.qr(y)[0], fresh], axis=1))[0], more


def _whitened(dim: int, n: int, sums: list[int], c: np.ndarray, e: np.ndarray, explained: np.ndarray):
    k = len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, m = _matrix(part.column("x"), dim), part.num_rows
                value, fits = deviations(x, n, sums)
                white = centred(x, n, sums) @ c / np.sqrt(e)
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                own = pa.array(np.repeat(value, k), mask=np.repeat(~fits, k))
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), own, pa.array(white.ravel()), pa.array(np.tile(explained, m))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])
        release()

    return run


def whole_entries(embedding: Column) -> Column:
    """Entries times SCALE, floored; those beyond a long's range become its ends."""
    top = 9.223372036854774e18
    return F.transform(embedding.cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-top)), F.lit(top))).cast("long") + F.lit(0).cast("long"))


def whiten(spark: SparkSession, vectors: DataFrame, wanted: int = WANTED) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``vectors(vec_id, embedding)`` and component.

    Rows whose vector is null, empty or holds a null or non-finite entry are dropped; a null id stays null. Every distinct vector of whole numbers
    counts once in the fit, however often it comes; each row, repeated or not, has its results. Vectors of different lengths are fitted apart,
    each length by itself. A component is given only if the vectors vary along it, so one distinct vector, or none, gives no rows.
    ``deviation`` is null where it doesn't fit a long. Other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
    v = v.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = scratch(spark, v.select("vec_id", whole_entries(F.col("v")).alias("x")).withColumn("dim", F.size("x")), "whole")
    fits = scratch(spark, rows.select("dim", "x").distinct(), "fit")
    out = []
    for dim in sorted(r["dim"] for r in fits.select("dim").distinct().collect()):
        fit = fits.filter(F.col("dim") == dim).select("x")
        cells = {r[0]: int(r[1]) for r in fit.mapInArrow(_sums(dim), "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect()}
        n, sums = cells[0], [(cells[1 + i] << 32) + cells[1 + dim + i] for i in range(dim)]

        traces: list[float] = []

        def product(q: np.ndarray | None, fit=fit, dim=dim, n=n, sums=sums, traces=traces) -> np.ndarray:
            v, trace = _gather(fit, _product(dim, n, sums, q), (dim, dim if q is None else q.shape[1]))
            traces.append(trace)
            return v

        e, c, _ = range_finder(product, dim, min(wanted, dim))
        trace = traces[-1]
        real = e > max(trace, 0) * 1e-14  # what lies below is rounding
        e, c = e[real], c[:, real]
        if not len(e):
            continue
        white, _ = _gather(fit, _product(dim, n, sums, c, np.sqrt(e)), (len(e), len(e)))
        error = float(np.abs(white - np.eye(len(e))).max())
        mine = rows.filter(F.col("dim") == dim).select("vec_id", "x").mapInArrow(_whitened(dim, n, sums, c, e, e / trace), OUT)
        out.append(mine.withColumn("identity_error", F.lit(error)))
    if not out:
        return spark.createDataFrame([], f"{OUT}, identity_error double")
    both = out[0]
    for one in out[1:]:
        both = both.union(one)
    return both


def op12_randomised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of all rows of ``embeddings``."""
    return whiten(spark, table(spark, sf_dir, "embeddings"))
