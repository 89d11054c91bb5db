"""Duplicate suppression in a time window that starts at the last request that was let through.

Whether a request passes hangs on the last one that passed, so this is no lag() and no session window: a fold
over each key's requests in order. Partitions are sorted by key and time and read as a stream that carries one time, so
a key of any length takes no memory.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_MS, REMEMBERED = 5000, 500


def canonical(body: Column) -> Column:
    """JSON text with the keys of all levels in order; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(body)), body)


def fingerprint(method: Column, url: Column, body: Column) -> Column:
    """One digest of a request; a missing body differs from an empty one, the order of a body's keys makes no difference."""
    return digest(method, url, canonical(body))


def digest(method: Column, url: Column, body: Column) -> Column:
    """The fingerprint for a body that is canonical already; it names the body twice, so over a table the canonical body should be a column."""
    return F.sha2(F.concat_ws("\n", F.upper(method), url, F.coalesce(F.concat(F.length(body).cast("string"), F.lit("\n"), body), F.lit("-"))), 256)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, us, window, seq, ...) sorted by key and time, with ``by``: the seq of the request that was let through last, the row's own if it passes."""
    key, last, by = None, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k = batch.column(0)
        us, window = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        seq = batch.column(3).to_numpy()
        edge = np.flatnonzero(pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
        out = np.empty(n, np.int64)
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), n], strict=True):
            name, at = k[a].as_py(), a
            if name != key:
                key, by = name, None
            while at < b:
                if by is not None:  # up to the first row outside the window all rows have the same answer
                    to = at + int(np.searchsorted(us[at:b], last + window[at], "left"))
                    out[at:to] = by
                    at = to
                if at < b:
                    last, by = int(us[at]), int(seq[at])
                    out[at] = by
                    at += 1
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(out)], names=[*batch.schema.names[3:], "by"])


def answered(requests: DataFrame, keys: list[str], at: str, seq: str, window_us: int | Column) -> DataFrame:
    """``requests`` with ``by``: the ``seq`` (a long) of the request whose answer this one gets, its own if it passes.

    The first request of a key passes, and each one ``window_us`` or more after the last that passed. A window of 0 lets
    all pass. The window may be a column that is the same for all rows of a key.
    """
    window = F.lit(window_us) if isinstance(window_us, int) else window_us
    head = [F.to_json(F.struct(*keys)).alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"), window.cast("long").alias("_window"), F.col(seq).cast("long").alias(seq)]
    rest = [c for c in requests.columns if c != seq]
    rows = requests.select(*head, *rest)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.repartition("_key").sortWithinPartitions("_key", "_us", seq).mapInArrow(_fold, out + ", by long")


def suppress(requests: DataFrame, keys: list[str], at: str, seq: str, window_us: int) -> DataFrame:
    """``requests`` of each key that pass, as (keys..., seq, at)."""
    rows = answered(requests.select(*keys, seq, at), keys, at, seq, window_us)
    return rows.filter(F.col("by") == F.col(seq)).select(*keys, F.col(seq).cast(requests.schema[seq].dataType).alias(seq), at)


class Guard:
    """The same for single requests on the driver: answers by fingerprint, at most REMEMBERED of them, the oldest going first."""

    def __init__(self, window_ms: int = WINDOW_MS, most: int = REMEMBERED) -> None:
        self.window_ms, self.most = window_ms, most
        self._seen: OrderedDict[str, tuple[int, object]] = OrderedDict()

    def find(self, key: str, now_ms: int, window_ms: int | None = None) -> object | None:
        """The answer of an equal request inside the window; an expired one is forgotten, a hit does not prolong it."""
        if key not in self._seen:
            return None
        at, answer = self._seen[key]
        if now_ms - at >= (self.window_ms if window_ms is None else window_ms):
            del self._seen[key]
            return None
        return answer

    def copy(self) -> Guard:
        out = Guard(self.window_ms, self.most)
        out._seen.update(self._seen)
        return out

    def remember(self, key: str, answer: object, now_ms: int) -> None:
        self._seen.pop(key, None)
        self._seen[key] = (now_ms, answer)
        while len(self._seen) > self.most:
            self._seen.popitem(last=False)


def fingerprint_of(method: str, url: str, body: object = None) -> str:
    """A driver-side digest of one request, with the keys of its body in order."""
    import hashlib
    import json

    text = "-" if body is None else json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(f"{method.upper()}\n{url}\n{len(text)}\n{text}".encode()).hexdigest()


def answered_in_time(pairs: DataFrame, asked: str, answered: str, limit_us: int = 2_000_000) -> DataFrame:
    """``pairs`` with ``in_time``: an answer within the limit; a late or missing one doesn't count."""
    d = F.unix_micros(F.col(answered).cast("timestamp")) - F.unix_micros(F.col(asked).cast("timestamp"))
    return pairs.withColumn("in_time", F.coalesce((d >= 0) & (d < limit_us), F.lit(False)))
