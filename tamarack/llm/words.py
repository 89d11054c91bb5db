"""Words and shingles of whole Arrow string columns as numpy arrays.

A word is a maximal run of bytes other than space and the controls 9 to 13; A-Z count as a-z. Each word
gets a 64-bit polynomial hash from prefix sums, so a batch costs a few passes over its bytes and no
Python loop over words. Texts are taken whole; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SEG = 1 << 20
_pw = _ipw = _value = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers, ``n`` or more, of the hashes' base and of its inverse."""
    global _pw, _ipw, _value
    if _pw is None or len(_pw) < n:
        n = max(n, _SEG + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        full = np.full(n, U(_BASE))
        full[0] = 1
        _pw = np.cumprod(full, dtype=U)
        full[1:] = U(inverse)
        _ipw = np.cumprod(full, dtype=U)
        _value = mix(_FOLD.astype(U) + U(1))
    return _pw, _ipw


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
    else:
        col = col.cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, col: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text makes a slice alone."""
    i = batch.schema.get_field_index(col)
    _, off = column_bytes(batch.column(i))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give freed memory back to the system, so that a worker that later stages reuse starts small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Words:
    """``h`` the word hashes of all texts in order, ``start``/``end`` byte places, ``first`` the index of each text's first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, trim: bool = False) -> None:
        """``trim``: hash words without ASCII punctuation at their ends (``core`` has these bounds); words of nothing else stay whole."""
        n = len(data)
        sep = _SEP[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.ones(n, bool)
        before[1:] = sep[:-1]
        before |= edge[:n]
        after = np.ones(n, bool)
        after[:-1] = sep[1:]
        after |= edge[1:]
        word = ~sep
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, off, "left")
        self.core = (self.start, self.end)
        if trim:
            self.core = self._trimmed(data)
        self.h = self._hash(data, *self.core)

    def _trimmed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.start.copy(), self.end.copy()
        for step, at in ((-1, e), (1, s)):
            live = np.arange(len(s))
            while len(live):
                live = live[e[live] > s[live]]
                live = live[_PUNCT[data[at[live] - (step < 0)]]]
                at[live] += step
        none = s >= e
        s[none], e[none] = self.start[none], self.end[none]
        return s, e

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each stretch; stretches come in order and don't overlap."""
        out = np.empty(len(start), U)
        at, n = 0, len(start)
        while at < n:
            to = max(at + 1, int(np.searchsorted(start, start[at] + _SEG, "left")))
            lo, hi = int(start[at]), int(end[to - 1])
            pw, ipw = powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, U)
            np.cumsum(_value[data[lo:hi]] * pw[: hi - lo], out=total[1:])
            s, e = start[at:to] - lo, end[at:to] - lo
            out[at:to] = (total[e] - total[s]) * ipw[s] + (e - s).astype(U)
            at = to
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of all n-word shingles in order; a text of fewer words has its whole sequence as its one shingle, an empty text none."""
    count = w.counts()
    if not len(w.h):
        return np.zeros(0, U), np.zeros(len(count) + 1, np.int64)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    off = np.zeros(len(count) + 1, np.int64)
    np.cumsum(many, out=off[1:])
    # the place of each shingle's first word
    place = np.arange(off[-1]) - np.repeat(off[:-1], many) + np.repeat(w.first[:-1], many)
    size = np.repeat(np.minimum(count, n), many)
    h = np.zeros(off[-1], U)
    short = size < n
    if not short.any():
        for j in range(n):
            h = h * U(0xD1342543DE82EF95) + w.h[place + j]
    else:
        last = len(w.h) - 1
        for j in range(n):
            use = j < size
            h = np.where(use, h * U(0xD1342543DE82EF95) + w.h[np.minimum(place + j, last)], h)
    return mix(h + size.astype(U)), off


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
