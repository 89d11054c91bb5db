"""The request journal: append, pending rows, acknowledgement, and the links between writes and requests.

A row holds the original request and the steps it means for one row of a table, so one append commits both or neither.
"""

from __future__ import annotations

import io
import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog

REQUEST = "id string, method string, path string, body string, created_at string"
STEPS = "array<struct<op: string, set: map<string, string>>>"
COLUMNS = f"{REQUEST}, table_name string, row_id string, steps {STEPS}"
#: rows as commits hold them: ``seq`` is the commit's number and the row's place in it
NUMBERED = f"{COLUMNS}, seq long"
PLACES = 32  # bits of a place in a commit


class JournalError(ValueError):
    pass


def entry(request_id: str, method: str, path: str, body: object, created_at: str, table: str | None = None, row_id: str | None = None, steps: Sequence[tuple[str, Mapping[str, object]]] = ()) -> tuple:
    """A journal row: the request as it came, query string included, and its (op, columns) steps on the row ``row_id`` of ``table``."""
    text = lambda v: None if v is None else json.dumps(v) if isinstance(v, bool) else str(v)
    own = [(op, {c: text(v) for c, v in values.items()}) for op, values in steps]
    return request_id, method.upper(), path, None if body is None else json.dumps(body), created_at, table, row_id, own


def mutations_of(journal: DataFrame, table: str, seq: Column | None = None) -> DataFrame:
    """(id, seq, op, set) of the steps on one table, in the order they were written; a mark sets its column like an update."""
    order = F.struct("created_at", F.col("id").alias("request")) if seq is None else seq
    rows = journal.filter(F.col("table_name") == table).select("row_id", order.alias("at"), F.posexplode("steps").alias("nth", "step"))
    op = F.when(F.col("step.op") == "mark", "update").otherwise(F.col("step.op"))
    return rows.select(F.col("row_id").alias("id"), F.struct("at", "nth").alias("seq"), op.alias("op"), F.col("step.set").alias("set"))


def append(journal: DataFrame, path: str) -> None:
    """One Parquet append is one commit."""
    journal.write.mode("append").parquet(path)


def commit_bytes(rows: Sequence[tuple], number: int) -> bytes:
    """The Parquet file of one commit: the rows of one write, or of one transaction in their order."""
    if len(rows) >> PLACES:
        raise JournalError(f"{len(rows)} rows are too many for one commit")
    step = pa.struct([("op", pa.string()), ("set", pa.map_(pa.string(), pa.string()))])
    text = ["id", "method", "path", "body", "created_at", "table_name", "row_id"]
    schema = pa.schema([*((c, pa.string()) for c in text), ("steps", pa.list_(step)), ("seq", pa.int64())])
    full = [(*r[:7], [{"op": op, "set": list(values.items())} for op, values in r[7]], (number << PLACES) + i) for i, r in enumerate(rows)]
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in full], schema=schema), out)
    return out.getvalue()


def append_table(rows: DataFrame, log: CommitLog) -> int:
    """A table of requests (see COLUMNS) as one commit, in the order of (created_at, id); returns its number."""
    from .reads import numbered

    placed = numbered(rows.orderBy("created_at", "id"))

    def write(number: int, path: str) -> None:
        seq = F.lit(number << PLACES).cast("long") + F.col("place") - 1
        placed.select(*rows.columns, seq.alias("seq")).write.parquet(path)

    return log.append_table(write)


def committed(spark: SparkSession, log: CommitLog, after: int = 0, upto: int | None = None) -> DataFrame:
    """Journal rows (see NUMBERED) of the commits in (after, upto]; only their files are read."""
    files = log.files(after, upto)
    if not files:
        return spark.createDataFrame([], NUMBERED)
    rows = spark.read.schema(NUMBERED).parquet(*files).filter(F.col("seq") >= (after + 1) << PLACES)
    return rows if upto is None else rows.filter(F.col("seq") < (upto + 1) << PLACES)


def pending(journal: DataFrame, acks: DataFrame, key: str = "id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Journal rows that nobody has acknowledged, oldest first; no acknowledgement means all rows."""
    return journal.join(acks.select(key).distinct(), key, "left_anti").orderBy(*order)


def linked(writes: DataFrame, journal: DataFrame) -> DataFrame:
    """Writes with their journal row by the id in ``metadata``; empty metadata and the older JSON form have none."""
    own = F.when((F.col("metadata") != "") & ~F.col("metadata").startswith("{"), F.col("metadata"))
    j = journal.select(F.col("id").alias("journal_id"), F.col("method").alias("journal_method"), F.col("path").alias("journal_path"), F.col("body").alias("journal_body"))
    return writes.withColumn("_own", own).join(j, F.col("_own") == F.col("journal_id"), "left").drop("_own")


def body_of(text: str | None) -> object:
    """The stored body; text that doesn't parse is an error, a missing body is none."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError as e:
        raise JournalError(f"stored body is not JSON: {text[:80]!r}") from e
