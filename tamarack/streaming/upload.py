"""Uploading the journal: every micro-batch wakes one pass over all that is pending.

A pass sends each stream's requests in order from one task and stops the stream at the first retry or reauth, before
anything behind it goes out. Every answer is written down first; what is acknowledged, discarded or left follows from
that table, so nothing is sent again to find out what came of it. A task that is lost sends its requests again
under the same idempotency keys. A reauth shuts its stream until :func:`resume`.
Writes that nobody can tell a service for are rejected unsent. Rejected writes become dead letters and let their transaction go on.

A pass belongs to an epoch. Each attempt writes its tables into folders of its own; they count from the moment that the epoch's
manifest names them, which one attempt alone can put there. An epoch that is run again after that sends nothing and answers what was answered;
one that died before it left nothing that readers see.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from queue import SimpleQueue

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import replay
from ..sources.commits import Folder

#: (method, url, body, headers) to the answer's status, None without an answer; runs in the executors
Send = Callable[[str, str, str | None, dict[str, str]], int | None]

ACKS = "id string, kind string"
ANSWERS = "stream string, tx_id long, seq long, id string, http_status int, kind string"
SHUT = "stream string, at long, shut boolean"
ACTIVITY = "type string, subject string, at long"


def http_sender(timeout: float = 10.0) -> Send:
    """Sends over HTTP; no connection is no answer."""

    def send(method: str, url: str, body: str | None, headers: dict[str, str]) -> int | None:
        from ..sources import http

        try:
            return http.send("", method, url, body, {"Content-Type": "application/json", **headers}, timeout)[0]
        except http.NetworkError:
            return None

    return send


class Passes:
    """The passes below a folder, by their manifests."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.epochs = Folder(spark, f"{self.path}/epochs")

    def attempt_of(self, epoch: str) -> str | None:
        return self.epochs.read(epoch).decode() if epoch in self.epochs.names() else None

    def commit(self, epoch: str, attempt: str) -> str:
        """Make the attempt count unless another one does already; returns the one that does."""
        return attempt if self.epochs.create(epoch, attempt.encode()) else self.attempt_of(epoch)

    def table(self, kind: str, schema: str | None = None, epoch: str | None = None) -> DataFrame:
        """Rows of a kind of one epoch, or of all; with no epoch yet there are none, of the schema given."""
        if epoch is not None:
            attempts = [self.attempt_of(epoch)]
        elif self.epochs.names():  # a small file for each pass
            attempts = [r[0] for r in self.spark.read.text(self.epochs.path, wholetext=True).collect()]
        else:
            return self.spark.createDataFrame([], schema or "id string")
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{kind}/{a}" for a in attempts])


def acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind) of all passes so far."""
    return Passes(spark, path).table("acks", ACKS)


def letters(spark: SparkSession, path: str, epoch: str | None = None) -> DataFrame:
    """Dead letters of an epoch, or of all: the writes with (http_status, reason)."""
    return Passes(spark, path).table("letters", None, epoch)


def activity(spark: SparkSession, path: str, epoch: str | None = None) -> DataFrame:
    """(type, subject, at) of what an epoch, or all, had to tell."""
    return Passes(spark, path).table("activity", ACTIVITY, epoch)


def shut_streams(spark: SparkSession, path: str) -> DataFrame:
    """(stream) of streams whose last event is a reauth."""
    rows = Passes(spark, path).table("latch", SHUT)
    opened = Folder(spark, f"{path}/opened").names()
    if opened:
        rows = rows.union(spark.read.schema(SHUT).parquet(*[f"{path}/opened/{n}" for n in opened]))
    return rows.groupBy("stream").agg(F.max_by("shut", "at").alias("shut")).filter("shut").select("stream")


def resume(spark: SparkSession, path: str, streams: DataFrame | None = None) -> None:
    """A valid session exists again: open the given streams (``stream``), or all."""
    rows = shut_streams(spark, path) if streams is None else streams.select("stream")
    at = time.time_ns() // 1000
    rows.select("stream", F.lit(at).alias("at"), F.lit(False).alias("shut")).write.parquet(f"{path}/opened/open-{at}-{uuid.uuid4().hex}")


def _deliver(send: Send, streams: int, waiting: int):
    """Answers of a partition's requests. Up to ``streams`` requests are out at a time, one of each stream, so a slow stream keeps nobody else waiting.

    Rows come by their place in their stream, all first ones first; what has to wait for the answer before it is held, ``waiting`` rows at most.
    A thread gets all rows that its stream has by then and sends them one after the other, so handing over costs little where answers come quickly.
    """

    def drain(rows: Iterable) -> list[tuple]:
        out = []
        for r in rows:
            status = None if r.send_method is None else send(r.send_method, r.url, r.send_body, json.loads(r.headers or "{}"))
            kind = replay.REJECT if r.send_method is None else replay.kind_of(status)
            out.append((r.stream, r.tx_id, r.seq, r.id, status, kind))
            if kind in (replay.RETRY, replay.REAUTH):
                break
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queues: dict[str, deque] = {}  # rows that are held, by stream
        ready: deque[str] = deque()  # streams that have rows and no thread
        flying: dict[str, int] = {}  # how many rows wait behind the first one that a thread has
        landed: SimpleQueue[tuple[str, Future]] = SimpleQueue()
        stopped: set[str] = set()
        held = 0

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["stream", "tx_id", "seq", "id", "http_status", "kind"]).astype({"http_status": "Int32"})

        with ThreadPoolExecutor(streams) as pool:

            def launch() -> None:
                nonlocal held
                while ready and len(flying) < streams:
                    stream = ready.popleft()
                    rows = queues.pop(stream)
                    held -= 1
                    flying[stream] = len(rows) - 1
                    pool.submit(drain, rows).add_done_callback(lambda f, s=stream: landed.put((s, f)))

            def land() -> list[tuple]:
                """Wait for a stream's answers; it goes on if it has more rows."""
                nonlocal held
                stream, done = landed.get()
                held -= flying.pop(stream)
                out = done.result()
                if out[-1][-1] in (replay.RETRY, replay.REAUTH):
                    stopped.add(stream)
                    held -= len(queues.pop(stream, ()))
                elif stream in queues:
                    ready.append(stream)
                launch()
                return out

            for batch in batches:
                out: list[tuple] = []
                for r in batch.itertuples(index=False):
                    if r.stream in stopped:
                        continue
                    if r.stream in queues:
                        queues[r.stream].append(r)
                    else:
                        queues[r.stream] = deque([r])
                        if r.stream not in flying:
                            ready.append(r.stream)
                    held += 1
                    if held >= waiting:
                        launch()
                    while held >= waiting:
                        out += land()
                launch()
                while not landed.empty():
                    out += land()
                yield frame(out)
            out = []
            while flying:
                out += land()
                if len(out) >= waiting:
                    yield frame(out)
                    out = []
            yield frame(out)

    return run


def one_pass(spark: SparkSession, writes: DataFrame, send: Send, path: str, name: str, stream: str | None = None, token: str | None = None, base: str | None = None, handlers: replay.ErrorHandlers | None = None, at_once: int = 16, waiting: int = 10_000) -> DataFrame:
    """Send what is pending once and write what came of it; returns the answers (see ANSWERS). ``name`` is the epoch.

    ``writes`` has (id, tx_id, seq) and the columns of :func:`replay.request_of`; ``stream`` names the column that parts independent
    uploaders, each of which is sent in order by one task, with one request out at a time; a task has requests of up to ``at_once`` streams out and
    holds up to ``waiting`` rows whose stream isn't ready, so ``send`` is called from several threads. Without ``stream`` all writes are one stream and go through one task. ``handlers`` hear of every rejected write, in the executors.
    """
    passes = Passes(spark, path)
    if passes.attempt_of(name) is not None:
        return passes.table("answers", ANSWERS, name)
    attempt = f"{name}.{uuid.uuid4().hex}"
    own = F.col(stream).cast("string") if stream else F.lit("")
    rows = writes.join(acknowledged(spark, path).select("id"), "id", "left_anti").withColumn("stream", own)
    rows = rows.join(shut_streams(spark, path), "stream", "left_anti")
    rows = replay.request_of(replay.send_once(rows, key="id"), token, base=base)
    rows = rows.select("stream", "tx_id", "seq", "id", "send_method", "url", "send_body", F.to_json("headers").alias("headers"))
    place = F.row_number().over(Window.partitionBy("stream").orderBy("tx_id", "seq"))
    ready = rows.withColumn("_place", place).repartition("stream").sortWithinPartitions("_place", "stream").drop("_place")
    ready.mapInPandas(_deliver(send, at_once, waiting), ANSWERS).write.parquet(f"{path}/answers/{attempt}")
    answers = spark.read.schema(ANSWERS).parquet(f"{path}/answers/{attempt}")
    stops = answers.filter(F.col("kind").isin(replay.RETRY, replay.REAUTH)).select("stream", F.col("tx_id").alias("stop"), F.col("kind").alias("why"))
    # a transaction with a stop in it waits as a whole
    done = answers.join(stops, "stream", "left").filter("stop is null or tx_id < stop")
    done.select("id", "kind").write.parquet(f"{path}/acks/{attempt}")
    rejected = writes.join(done.filter(F.col("kind") == replay.REJECT).select("id", "http_status"), "id")
    reason = F.when(F.col("http_status").isNull(), "no usable metadata: nobody can tell which service to call").otherwise("rejected")
    rejected.withColumn("reason", reason).write.parquet(f"{path}/letters/{attempt}")
    at = F.lit(time.time_ns() // 1000)
    shut = stops.filter(F.col("why") == replay.REAUTH).select("stream", at.alias("at"), F.lit(True).alias("shut"))
    shut.write.parquet(f"{path}/latch/{attempt}")
    kept = spark.read.parquet(f"{path}/letters/{attempt}")
    events = kept.select(F.lit("dead-letter").alias("type"), F.col("id").cast("string").alias("subject"), at.alias("at"))
    events.union(shut.select(F.lit("reauth-required"), "stream", "at")).write.parquet(f"{path}/activity/{attempt}")
    if passes.commit(name, attempt) == attempt and handlers is not None:
        kept.foreach(lambda r: handlers.handle(r.asDict().get("operation_id") or r.asDict().get("table_name"), r.asDict(recursive=True)))
    return passes.table("answers", ANSWERS, name)


def follow(journal_path: str, schema: str, send: Send, path: str, spark: SparkSession, stream: str | None = None):
    """A running query that makes a pass whenever the journal grows."""
    live = spark.readStream.schema(schema).parquet(journal_path)

    def wake(batch: DataFrame, epoch: int) -> None:
        one_pass(batch.sparkSession, batch.sparkSession.read.schema(schema).parquet(journal_path), send, path, f"pass-{epoch}", stream)

    return live.writeStream.foreachBatch(wake).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
