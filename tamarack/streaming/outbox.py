"""The upload as one stateful operator: each stream's pending writes live in its state.

A batch brings new writes (or a resume) and costs what they cost; what is pending already is neither read again nor joined. A stream sends
in order and stops at the first retry or reauth, its transaction waiting as a whole. A retry sets a timer and is tried again when it fires, also if
nothing new has come; a reauth shuts the stream until a resume. A task that is run again sends again under the same keys.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import replay
from .upload import Send

ANSWERS = "stream string, tx_id long, seq long, id string, http_status int, kind string, done boolean"
_CHUNK = StructType([StructField("writes", StringType())])
_NUMBER = StructType([StructField("n", LongType())])
_PLACE = StructType([StructField(c, LongType()) for c in ("head", "skip", "tail", "shut")])
_ANSWER = Row("stream", "tx_id", "seq", "id", "http_status", "kind", "done")
CHUNK = 256  # writes of a state row


class Outbox(StatefulProcessor):
    """Pending writes as JSON lists of up to CHUNK, numbered from ``head`` to ``tail``; the first ``skip`` writes of the head are through.

    What goes out at once is never put into the state, and what waits is put and read a list at a time: each call of the state
    is a round trip between Python and the JVM.
    """

    def __init__(self, send: Send, wait_ms: int | None) -> None:
        self.send, self.wait_ms = send, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", _NUMBER, _CHUNK)
        self.place = handle.getValueState("place", _PLACE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh, resume = [], False  # the writes of one batch
        for _, tx, seq, write in rows:
            if write is None:
                resume = True
            else:
                fresh.append((tx, seq, write))
        fresh.sort(key=lambda w: w[:2])
        yield from self._deliver(key, timerValues, [w for _, _, w in fresh], resume)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._deliver(key, timerValues, [], False)

    def _deliver(self, key, timer, fresh: list[str], resume: bool) -> Iterator[Row]:
        before = self.place.get()
        head, skip, old, shut = before or (0, 0, 0, 0)
        new = {old + i // CHUNK: fresh[i : i + CHUNK] for i in range(0, len(fresh), CHUNK)}
        tail, first, stop = old + len(new), head, None
        if resume:
            shut = 0

        def pending(at: int) -> Iterator[tuple[int, int, dict]]:
            """Writes with the place behind each."""
            for n in range(first, tail):
                writes = [json.loads(w) for w in new[n]] if n in new else json.loads(self.rows.getValue((n,))[0])
                for i in range(at, len(writes)):
                    yield (n, i + 1, writes[i]) if i + 1 < len(writes) else (n + 1, 0, writes[i])
                at = 0

        if not shut:
            for _, writes in itertools.groupby(pending(skip), lambda p: p[2].get("tx_id")):  # one transaction
                sent, answers = set(), []
                for n, i, w in writes:
                    own = w.get("id")
                    if own in sent:
                        continue
                    sent.add(own)
                    method = w.get("send_method")
                    status = None if method is None else self.send(method, w.get("url"), w.get("send_body"), w.get("headers") or {})
                    kind = replay.REJECT if method is None else replay.kind_of(status)
                    answers.append((w.get("tx_id"), w.get("seq"), own, status, kind))
                    if kind in (replay.RETRY, replay.REAUTH):
                        stop = kind
                        break
                for a in answers:
                    yield _ANSWER(*key, *a, stop is None)
                if stop is not None:
                    break
                head, skip = n, i
        for n in range(first, min(head, old)):
            self.rows.removeKey((n,))
        for n, writes in new.items():
            if n >= head:
                self.rows.updateValue((n,), (f"[{','.join(writes)}]",))
        after = (head, skip, tail, 1 if shut or stop == replay.REAUTH else 0)
        if head < tail or after[3]:
            if before is None or tuple(before) != after:
                self.place.update(after)
        elif before is not None:  # nothing waits
            self.place.clear()
        if stop == replay.RETRY and self.wait_ms is not None:
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.wait_ms)

    def close(self) -> None:
        pass


def outbox_stream(writes: DataFrame, send: Send, stream: str, token: str | None = None, base: str | None = None, wait_ms: int | None = 5_000, resumes: DataFrame | None = None) -> DataFrame:
    """Answers (see ANSWERS) of a stream of ``writes`` (id, tx_id, seq and the columns of :func:`~tamarack.operators.replay.request_of`); needs the RocksDB provider.

    ``stream`` names the column that parts independent uploaders; ``resumes(stream)`` opens the streams it names. ``done``: the write's transaction is through, so
    the done rows are the acknowledgements and those of them that are rejected the dead letters. After a retry a stream is tried again ``wait_ms`` later, with None only when it gets new writes.
    """
    sent = replay.request_of(writes, token, base=base)
    tx, seq = F.col("tx_id").cast("long").alias("tx_id"), F.col("seq").cast("long").alias("seq")
    write = F.to_json(F.struct(tx, seq, F.col("id").cast("string").alias("id"), "send_method", "url", "send_body", "headers"))
    rows = sent.select(F.col(stream).cast("string").alias("stream"), tx, seq, write.alias("write"))
    if resumes is not None:
        none = F.lit(None).cast("long")
        rows = rows.unionByName(resumes.select(F.col("stream").cast("string").alias("stream"), none.alias("tx_id"), none.alias("seq"), F.lit(None).cast("string").alias("write")))
    return rows.groupBy("stream").transformWithState(Outbox(send, wait_ms), ANSWERS, "append", "none" if wait_ms is None else "processingTime")
