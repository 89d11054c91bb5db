"""Replay of pending writes: classification of answers, what a pass sends, completes, blocks and discards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, RETRY, REAUTH, REJECT = "ok", "retry", "reauth", "reject"


def classify(status: Column, custom: Callable[[Column], Column] | None = None) -> Column:
    """ok for 2xx, reauth for 401, retry for 408, 429, 5xx and no answer, else reject; ``custom`` may decide first."""
    plain = F.when(status.isNull(), RETRY).when((status >= 200) & (status < 300), OK).when(status == 401, REAUTH).when(status.isin(408, 429) | (status >= 500), RETRY).otherwise(REJECT)
    return plain if custom is None else F.coalesce(custom(status), plain)


def crud_op(op: Column) -> Column:
    """PUT and DELETE in any case; everything else is PATCH."""
    return F.when(F.upper(op).isin("PUT", "DELETE"), F.upper(op)).otherwise("PATCH")


def send_once(writes: DataFrame, tx: str = "tx_id", key: str = "journal_id", seq: str = "seq") -> DataFrame:
    """The first write of each journal row in a transaction; writes without one (null key) are all kept."""
    first = F.row_number().over(Window.partitionBy(tx, key).orderBy(seq)) == 1
    return writes.withColumn("_first", first | F.col(key).isNull()).filter("_first").drop("_first")


def outcomes(sends: DataFrame, stream: str | None = None, tx: str = "tx_id", seq: str = "seq", status: str = "http_status") -> DataFrame:
    """``sends`` with (kind, attempted, completed) of one pass over transactions in order.

    The first retry or reauth of a stream stops it there: that call still reaches the server, its transaction and
    all later ones wait. Rejected writes are discarded and let their transaction go on. ``stream``
    names the column that parts independent uploaders; the windows run within a stream and need none of
    the rows of others in one task.
    """
    keys = [stream] if stream else []
    kinds = sends.withColumn("kind", classify(F.col(status)))
    stop = F.when(F.col("kind").isin(RETRY, REAUTH), F.struct(tx, seq))
    first = kinds.groupBy(*keys).agg(F.min(stop).alias("stop"))  # one row a stream
    out = kinds.join(first, keys) if keys else kinds.crossJoin(F.broadcast(first))  # a single row
    here = F.struct(tx, seq)
    attempted = F.col("stop").isNull() | (here <= F.col("stop"))
    completed = F.col("stop").isNull() | (F.col(tx) < F.col("stop")[tx])
    return out.withColumn("attempted", attempted).withColumn("completed", completed).drop("stop")


def latch(events: DataFrame, stream: str, seq: str, kind: str = "kind", resume: str = "resume") -> DataFrame:
    """``events`` with ``blocked``: after a reauth nothing goes out until a resume; both are states of the stream."""
    mark = F.when(F.col(resume), "open").when(F.col(kind) == REAUTH, "shut")
    before = F.last(mark, ignorenulls=True).over(Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("blocked", F.coalesce(before == "shut", F.lit(False)) & ~F.col(resume))


def kind_of(status: int | None) -> str:
    """The same for one answer."""
    if status is None:
        return RETRY
    return OK if 200 <= status < 300 else REAUTH if status == 401 else RETRY if status in (408, 429) or status >= 500 else REJECT


def metadata_json(method: Column, path: Column, operation: Column, body: Column | None = None, own: Column | None = None) -> Column:
    """The write's metadata as JSON, nulls left out; ``path`` has its query string. What a handler makes itself (``own``) wins."""
    if own is not None:
        return F.coalesce(own, metadata_json(method, path, operation, body))
    fields = [method.alias("method"), path.alias("path"), operation.alias("operationId")]
    return F.to_json(F.struct(*fields, *([body.alias("body")] if body is not None else [])))


def usable_metadata(text: Column) -> Column:
    """(method, path, operationId, body) if the text is JSON with a method and a path, else null."""
    parsed = F.from_json(text, "method string, path string, operationId string, body string")
    return F.when(parsed["method"].isNotNull() & parsed["path"].isNotNull(), parsed)


def request_of(writes: DataFrame, token: str | None = None, marker: str = "X-Replay", base: str | None = None) -> DataFrame:
    """The request to send: journal row first, else usable metadata; headers mark the replay (``marker`` is the server's name for it) and carry the stable idempotency key.

    Without either ``send_method`` is null: nobody can tell which service to call. The body is that of the request,
    else the write's data; a relative path is put behind ``base``.
    """
    meta = usable_metadata(F.col("metadata"))
    out = writes.withColumn("_m", meta)
    headers = [F.lit(marker), F.lit("1"), F.lit("Idempotency-Key"), F.coalesce("journal_id", F.get_json_object("data", "$.idempotencyKey"))]
    if token:
        headers += [F.lit("Authorization"), F.lit(f"Bearer {token}")]
    head = F.map_filter(F.create_map(*headers), lambda _, v: v.isNotNull())
    out = out.withColumn("send_method", F.coalesce("journal_method", "_m.method")).withColumn("send_path", F.coalesce("journal_path", "_m.path")).withColumn("headers", head)
    body = F.when(F.col("journal_method").isNotNull(), F.coalesce("journal_body", "data") if "journal_body" in writes.columns else F.col("data")).otherwise(F.coalesce("_m.body", "data"))
    url = F.col("send_path")
    if base is not None:
        url = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(url, "^/+", "")))
    return out.withColumn("send_body", F.when(F.col("send_method").isNotNull(), body)).withColumn("url", url).drop("_m")


def dead_letters(discarded: DataFrame) -> DataFrame:
    """(id, operation_id, payload, code, reason, created_at) of rejected writes: keyed by the client's id, code 0 without an answer."""
    return discarded.select(
        F.col("client_id").cast("string").alias("id"), F.coalesce("operation_id", "table_name").alias("operation_id"), F.col("data").alias("payload"),
        F.coalesce("http_status", F.lit(0)).alias("code"), F.col("reason"), F.col("created_at"),
    )


def latest_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Upsert: of each key the row with the greatest ``seq``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("r")).select(key, "r.*")


def dispatched(letters: DataFrame, handlers: ErrorHandlers, operation: str = "operation_id") -> DataFrame:
    """``letters`` with ``heard``: handled by their operation's handler, by the default one, or failed in either; every handler runs where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            yield batch.assign(heard=[handlers.handle(r[operation], r) for r in rows])

    return letters.mapInPandas(run, f"{letters.schema.simpleString()[7:-1]}, heard string")


class ErrorHandlers:
    """Handlers by operation; a name twice is an error, a handler's own failure is swallowed, unknown operations go to ``default``."""

    def __init__(self, default: Callable[[dict], None]) -> None:
        self._own: dict[str, Callable[[dict], None]] = {}
        self._default = default

    def add(self, operation: str, handler: Callable[[dict], None]) -> None:
        if operation in self._own:
            raise ValueError(f"{operation} has a handler already")
        self._own[operation] = handler

    def handle(self, operation: str, error: dict) -> str:
        """Which handler heard of it: ``own``, ``default``, or ``failed``, whichever it was."""
        try:
            self._own.get(operation, self._default)(error)
        except Exception:  # noqa: BLE001 - a handler never breaks the replay
            return "failed"
        return "own" if operation in self._own else "default"
