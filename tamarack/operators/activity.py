"""Activity log and dead letters as derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 200


def recent(events: DataFrame, seq: str, most: int = KEPT) -> DataFrame:
    """The ``most`` latest events, newest first: a top-k, so no full sort and no single-task window."""
    return events.orderBy(F.desc(seq)).limit(most)


def follow_events(spark, path: str, publish, checkpoint: str):
    """Hands the activity rows (type, at, detail) that are appended from now on to ``publish``, batch by batch; what was there at the first start belongs to it too."""
    live = spark.readStream.schema("type string, at string, detail map<string, string>").parquet(path)
    return live.writeStream.foreachBatch(lambda batch, _: publish(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_issues(letters: DataFrame, resolved: DataFrame, key: str = "id") -> DataFrame:
    """Dead letters that nobody has resolved, newest first."""
    return letters.join(resolved.select(key).distinct(), key, "left_anti").orderBy(F.desc("created_at"), key)


def count_open(letters: DataFrame, resolved: DataFrame, key: str = "id") -> DataFrame:
    return letters.join(resolved.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))


def typed(letters: DataFrame) -> DataFrame:
    """Dead letters as read back: code and time are numbers, all else is text."""
    numbers = {"code": "int", "created_at": "long"}
    return letters.select(*[F.col(c).cast(numbers.get(c, "string")).alias(c) for c in letters.columns])


def event(kind: str, at: str, **detail: str) -> tuple[str, str, dict[str, str]]:
    """An activity row (type, at, detail) for an append-only event table."""
    return kind, at, detail


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))
