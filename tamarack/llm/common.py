"""Shared pieces of the training-data operators: scratch tables, table reading, components.

Everything that cuts lineage goes through :func:`scratch`, which writes a Parquet table under the
folder that ``spark.checkpoint.dir`` names, so a lost executor costs a re-read and never a whole job.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, _BATCH_KEY = "16m", "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOTS: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
_OPEN: ContextVar[list[Scratch] | None] = ContextVar("_OPEN", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any file system works.

    Arrow batches are held to BATCH bytes, so that a Python worker's memory is bounded by bytes and not by rows.
    DataFrames run after this returns, so the setting stays; a value the session has been given is left alone.
    """
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application's own below the shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:  # only a local run has a folder that driver and executors share anyway
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="tamarack-")
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/tamarack-{uuid.uuid4().hex}"
    return _ROOTS[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A written table: ``df`` reads it, ``drop()`` deletes its files once nothing needs them."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str, codec: str = "zstd") -> None:
        self.spark, self.path = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", codec).parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        _MADE.append((spark, self.path))
        if _OPEN.get() is not None:
            _OPEN.get().append(self)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _MADE[:] = [m for m in _MADE if m[1] != self.path]


@contextmanager
def passing() -> Iterator[Callable[[Scratch], DataFrame]]:
    """Scratch tables written inside are deleted at its end, but those handed to the function it gives, which returns their DataFrame."""
    mine: list[Scratch] = []
    outer = _OPEN.get()

    def keep(one: Scratch) -> DataFrame:
        mine.remove(one)
        if outer is not None:
            outer.append(one)
        return one.df

    token = _OPEN.set(mine)
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for one in mine:
            one.drop()


def scratch(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and return a DataFrame over the files."""
    return Scratch(spark, df, tag).df


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - this session's JVM may have gone already
            continue


def with_nodes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, names): ``docs(doc_id, text)`` without null ids or texts as ``rows(node, text)``, one node for each (doc_id, text).

    Where no id is repeated the node is the id and ``names`` is None. Else nodes are numbered in the order of
    (doc_id, hash of the text), and ``names(node, doc_id, hash)`` tells them; then texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").head(1):
        return docs.withColumnRenamed("doc_id", "node"), None
    docs = docs.withColumn("hash", F.xxhash64("text"))
    order = docs.select("doc_id", "hash").distinct().repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    names = Scratch(spark, order.withColumn("node", F.monotonically_increasing_id()), "names").df
    return docs.dropDuplicates(["doc_id", "hash"]).join(names, ["doc_id", "hash"]).select("node", "text"), names


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over undirected ``edges``.

    Alternating large-star and small-star joins (Kiveris et al.); each round is written to the shared
    folder. Minima are combined before the shuffle and the join back is a plain equi-join, so a hub
    with a third of all edges is split by the skew-join rule and never meets in one task. Nodes
    without an edge do not appear. Self loops and repeated or null edges are ignored.
    """
    e = (
        edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    held = Scratch(spark, e, "cc")
    before = None
    while True:
        both = held.df.select("u", "v").union(held.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (  # every larger neighbour of u points at the least of u's neighbourhood
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        )
        large = large.filter("u <> v")  # repeats do no harm to minima and go with the last distinct
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        new = Scratch(spark, small.filter("u <> v").distinct(), "cc")
        held.drop()
        held = new
        now = held.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = held.df.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return top.union(held.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
