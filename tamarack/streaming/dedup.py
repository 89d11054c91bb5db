"""Structured Streaming forms of the duplicate guard, the session latch and the bounded activity list.

Each key holds one number (the time of its last request that passed) in RocksDB state. A timer takes it away when the
watermark has left the window behind, so the guard's state is bounded by the requests of that time and not by history; the
latch keeps one flag for each stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.activity import KEPT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Guard(StatefulProcessor):
    """Lets a request pass if none of its key passed less than ``window_us`` before it."""

    def __init__(self, window_us: int, names: list[str]) -> None:
        self.window_us, self.names = window_us, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def _over(self, us: int) -> int:
        """The first millisecond at which no request can fall into the window that ``us`` opened."""
        return (us + self.window_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            if last is None or r["us"] - last >= self.window_us:
                last = r["us"]
                yield Row(*self.names)(*key, r["seq"], r["us"])
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(self._over(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.last.exists() and self._over(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Latch(StatefulProcessor):
    """Marks events that come after a reauth and before a resume of their stream."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shut = handle.getValueState("shut", StructType([StructField("shut", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        shut = self.shut.get()[0] if self.shut.exists() else 0
        for r in sorted(rows, key=lambda r: r["seq"]):
            yield Row(*self.names)(*key, r["seq"], bool(shut) and not r["resume"])
            shut = 0 if r["resume"] else 1 if r["kind"] == "reauth" else shut
        self.shut.update((shut,))

    def close(self) -> None:
        pass


class Recent(StatefulProcessor):
    """Holds the ``most`` latest rows of each key and tells what comes and goes."""

    def __init__(self, most: int, names: list[str]) -> None:
        self.most, self.names = most, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", StructType([StructField("seq", LongType())]), StructType([StructField("value", StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = {k[0]: v[0] for k, v in self.rows.iterator()}
        held = dict(before)
        heap = list(held)
        heapq.heapify(heap)
        for r in rows:  # at most ``most`` rows are held, however many come
            seq = r["seq"]
            if seq in held:
                held[seq] = r["value"]
            elif len(heap) < self.most:
                heapq.heappush(heap, seq)
                held[seq] = r["value"]
            elif seq > heap[0]:
                held.pop(heapq.heappushpop(heap, seq))
                held[seq] = r["value"]
        for seq in sorted(before.keys() - held.keys()):
            self.rows.removeKey((seq,))
            yield Row(*self.names)(*key, seq, before[seq], False)
        for seq in sorted(s for s in held if held[s] != before.get(s) or s not in before):
            self.rows.updateValue((seq,), (held[seq],))
            yield Row(*self.names)(*key, seq, held[seq], True)

    def close(self) -> None:
        pass


def recent_stream(events: DataFrame, key: str, seq: str, value: str, most: int = KEPT) -> DataFrame:
    """(key, seq, value, held) of a stream: rows that come among the ``most`` latest of their key (held) and rows that are no longer (not held), batch by batch.

    What a key holds after any number of batches is what :func:`~tamarack.operators.activity.recent` takes of all its rows. A row of a ``seq``
    that is held already takes its place; rows without ``seq`` are left out.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.col(seq).cast("long").alias("seq"), F.col(value).cast("string").alias("value")).filter("seq is not null")
    return rows.groupBy(key).transformWithState(Recent(most, [key, "seq", "value", "held"]), f"{key} {kind}, seq long, value string, held boolean", "append", "none")


def held_rows(changes: DataFrame, key: str) -> DataFrame:
    """(key, seq, value) that are held after the ``changes`` (with ``batch``, their order) of :func:`recent_stream`."""
    last = changes.groupBy(key, "seq").agg(F.max_by(F.struct("value", "held"), "batch").alias("r"))
    return last.filter("r.held").select(key, "seq", "r.value")


def guard_stream(requests: DataFrame, keys: list[str], at: str, seq: str, window_us: int, late: str = "1 hour") -> DataFrame:
    """(keys..., seq, us) of requests that pass, from a stream; needs the RocksDB provider.

    Requests that come more than ``late`` behind the newest are not judged any more; keys are forgotten that much after their window.
    """
    timed = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = timed.select(*keys, F.col(at), F.unix_micros(at).alias("us"), F.col(seq).cast("long").alias("seq"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.groupBy(*keys).transformWithState(Guard(window_us, [*keys, "seq", "us"]), f"{kinds}, seq long, us long", "append", "eventTime")


def latch_stream(events: DataFrame, stream: str) -> DataFrame:
    """(stream, seq, blocked) of ``events(stream, seq, kind, resume)``."""
    kind = events.schema[stream].dataType.simpleString()
    return events.groupBy(stream).transformWithState(Latch([stream, "seq", "blocked"]), f"{stream} {kind}, seq long, blocked boolean", "append", "none")
