"""SentencePiece encoding with sampling, and decoding.

A text's segmentations are the paths of a lattice whose edges are the pieces of a public SentencePiece
vocabulary, plus byte pieces for characters that have none. The distribution over paths is a unigram one:
piece weights fall with the piece's rank. Exactly ``k`` *distinct* segmentations are drawn without
replacement by Gumbel top-k: a best-first (A*) search over perturbed upper bounds. The bound of a set of
paths is a Gumbel variable at the log of the set's whole mass, which forward sums give exactly, so the
search needs no heuristic. A popped path leaves, at each of its steps, the set of paths that part from it
there; each such set gets its own bound, truncated by the path's.

Pieces never hold a space mark after another character, so the lattice falls apart at words and the
forward sums are taken once for each distinct word of a batch, for all words of a length at once. Draws are
seeded by the row key and the place, so they don't depend on partitions or retries.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import U, chunks, mix, release

MARK, SPACE = 0x2581, 32
SAMPLES = 2
BATCH = 4 << 20  # bytes of text whose distinct words share one lattice
SHARPNESS = 2.0
FADED = -45.0  # log mass of a prefix beyond which no double-precision draw lets a branch compete
NEAR, PARTED = 128, 1024  # steps of a path that are looked at first, texts whose steps are looked at together
_C = U(0x9E3779B97F4A7C15)
BUCKETS = 16  # bits: pieces of one length are looked up in so many buckets
_SHIFT = U(64 - BUCKETS)


class Vocabulary:
    """Pieces by the hash of their code points, one sorted table for each length, with log weights."""

    def __init__(self, path: str, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int32)
        self.byte_of: dict[int, int] = {}
        normal: list[int] = []
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                normal.append(i)
        rank = np.arange(1, len(normal) + 1) + 2.7
        weight = -sharpness * np.log(rank)
        weight -= np.log(np.exp(weight).sum())
        self.logp = np.full(n, weight.min() - 2.0)  # a byte piece is likelier than no path, less likely than any piece
        self.logp[normal] = weight
        self.longest = max(len(self.piece[i]) for i in normal)
        rows: dict[int, list[tuple[int, int]]] = {}
        begins: list[set[int]] = [set() for _ in range(self.longest + 1)]
        for i in normal:
            h = 0
            for j, ch in enumerate(self.piece[i], 1):
                h = (h * int(_C) + ord(ch) + 1) & ((1 << 64) - 1)
                begins[j].add(h)
            rows.setdefault(len(self.piece[i]), []).append((h, i))
        self.table = {}
        for size in range(1, self.longest + 1):
            # every beginning of a piece stays in its length's table, with id -1 unless it is a piece: a trie by levels
            own = dict(rows.get(size, []))
            keys = np.array(sorted(begins[size]), U)
            bucket = keys * _C >> _SHIFT
            keys, bucket = keys[np.argsort(bucket, kind="stable")], np.sort(bucket)
            first = np.searchsorted(bucket, np.arange(1 << BUCKETS, dtype=U)).astype(np.int32)
            first = np.minimum(first, len(keys) - 1)
            self.table[size] = (keys, np.array([own.get(int(h), -1) for h in keys], np.int32), first, int(np.unique(bucket, return_counts=True)[1].max()))

    def find(self, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes ``h`` begin a piece after ``size`` characters, and the ids of these (-1: only begin one)."""
        keys, ids, first, most = self.table[size]
        at = first[h * _C >> _SHIFT]
        known = keys[at] == h
        for j in range(1, most):  # a bucket holds a few keys at most
            rest = np.flatnonzero(~known)
            more = np.minimum(at[rest] + j, len(keys) - 1)
            hit = keys[more] == h[rest]
            at[rest[hit]] = more[hit]
            known[rest[hit]] = True
        known = np.flatnonzero(known)
        return known, ids[at[known]]

    def decode_all(self, many: list[np.ndarray]) -> list[str]:
        """The texts of id sequences: pieces and byte pieces joined, marks turned into spaces, the added first space taken off."""
        if not hasattr(self, "_raw"):
            raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace("▁", " ").encode() for i, p in enumerate(self.piece)]
            self._raw = np.frombuffer(b"".join(raw), np.uint8)
            self._len = np.array([len(x) for x in raw])
            self._at = np.cumsum(self._len) - self._len
        ids = np.concatenate(many) if many else np.zeros(0, np.int32)
        n = self._len[ids]
        data = self._raw[_ragged(self._at[ids], n)].tobytes()
        end = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, many)])].tolist()
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(end[:-1], end[1:], strict=True))
        return [t[1:] if t[:1] == " " else t for t in texts]


_held: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, sharpness: float = SHARPNESS) -> Vocabulary:
    if (path, sharpness) not in _held:
        _held[path, sharpness] = Vocabulary(path, sharpness)
    return _held[path, sharpness]


class Lattice:
    """The lattices of distinct words. Nodes are places 0..n of each word, numbered place by place over all words long enough, longest words first; edges are sorted by their end node, so each step of the forward sums is one stretch."""

    def __init__(self, voc: Vocabulary, cp: np.ndarray, off: np.ndarray) -> None:
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        longest = int(size.max()) if len(size) else 0
        count = len(size) - np.searchsorted(np.sort(size), np.arange(longest + 1))  # words of at least so many characters
        self.base = np.concatenate([[0], np.cumsum(count)])
        self.words = len(size)
        nodes = int(self.base[-1])
        word = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(cp)) - off[:-1][word]
        place = (self.base[nth] + rank[word]).astype(np.int32)  # the node before each character
        self.last = self.base[size] + rank
        after = np.append(place[1:], np.int32(0))  # the node behind each character
        after[off[1:][size > 0] - 1] = self.last[size > 0]
        room = np.minimum(off[1:][word] - np.arange(len(cp)), voc.longest).astype(np.uint8)  # characters up to the word's end
        start, end, piece = [], [], []
        live = np.arange(len(cp), dtype=np.int32)
        h = np.zeros(len(cp), U)
        single = np.zeros(len(cp), bool)
        code = cp.astype(U) + U(1)
        long_ = []
        for n in range(1, voc.longest + 1):
            on = np.flatnonzero(room[live] >= n)
            live, h = live[on], h[on]
            if not len(live):
                break
            h = h * _C + code[live + n - 1]
            known, got = voc.find(n, h)
            live, h = live[known], h[known]
            hit = np.flatnonzero(got >= 0)
            of = live[hit]
            start.append(place[of])
            end.append(after[of + (n - 1)])
            piece.append(got[hit])
            long_.append(np.full(len(hit), n, np.uint8))
            if n == 1:
                single[of] = True
        lone = np.flatnonzero(~single)  # characters without a piece of their own: bytes
        self.has_bytes = bool(len(lone))
        if len(lone):
            odd, which = np.unique(cp[lone], return_inverse=True)
            seqs = [[int(voc.byte[b]) for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in odd]
            self.byte_len = np.array([len(s) for s in seqs])
            self.byte_at = np.cumsum(self.byte_len) - self.byte_len
            self.byte_ids = np.concatenate([np.array(s) for s in seqs])
            cost = np.array([sum(voc.logp[b] for b in s) for s in seqs])
            start.append(place[lone])
            end.append(after[lone])
            piece.append(-2 - which)
            long_.append(np.full(len(lone), 1, np.uint8))
        start, end, piece = (np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (start, end, piece))
        # an end and a length make one edge, so whole numbers of these and the edge's index need no stable sort
        bits = U(max(1, len(end).bit_length()))
        size = np.concatenate(long_) if long_ else np.zeros(0, np.uint8)
        key = np.sort((end.astype(U) * U(voc.longest + 1) + size << bits) | np.arange(len(end), dtype=U))
        order = (key & ((U(1) << bits) - U(1))).astype(np.int32)
        self.start, self.piece, end = start[order], piece[order], end[order]
        del start, piece, order, key, size, long_, place, after, room, word, nth, live, h, code
        score = np.where(self.piece >= 0, voc.logp[np.maximum(self.piece, 0)], 0.0)
        if len(lone):
            own = self.piece <= -2
            score[own] = cost[-2 - self.piece[own]]
        self.score = score
        self.into = np.searchsorted(end, np.arange(nodes + 1, dtype=np.int32))  # edges into node v: into[v]..into[v+1]
        self._forward(nodes)

    def _forward(self, nodes: int) -> None:
        """alpha: log mass of all ways from a word's first node to each node; prob, cum: each edge's share among the edges into its end."""
        alpha = np.zeros(nodes)
        total = np.empty(len(self.start))
        for a, b in zip(self.base[1:-1], self.base[2:], strict=True):
            lo, hi = self.into[a], self.into[b]
            first = self.into[a:b] - lo
            x = alpha[self.start[lo:hi]] + self.score[lo:hi]
            n = np.diff(self.into[a : b + 1])
            top = np.maximum.reduceat(x, first)
            alpha[a:b] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), first))
            total[lo:hi] = x - np.repeat(alpha[a:b], n)
        del self.score, alpha
        self.logshare = total
        self.share = np.exp(total)
        # cumulative shares inside each node, added in order, so that they don't depend on the batch
        self.end = ends = np.repeat(np.arange(nodes, dtype=np.int32), np.diff(self.into))
        self.cum = self.share.copy()
        best = np.full(nodes, -1, np.int32)
        top = np.zeros(nodes)
        left = np.diff(self.into)  # edges into each node from the one at hand on
        e = self.into[:-1][left > 0].astype(np.int32)
        left = left[left > 0]
        while len(e):
            v, share = ends[e], self.share[e]
            more = np.flatnonzero(share > top[v])
            top[v[more]] = share[more]
            best[v[more]] = e[more]
            on = np.flatnonzero(left > 1)
            e, left = e[on] + np.int32(1), left[on] - 1
            self.cum[e] += self.cum[e - 1]
        self.best = best

    def draw(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each node an edge into it, by shares; the likeliest edge owns the first stretch of the unit interval."""
        e = self.best[v].copy()
        p = self.share[e]
        rest = np.flatnonzero(u >= p)
        if len(rest):
            w = v[rest]
            lo, hi = self.into[w], self.into[w + 1]
            t = (u[rest] - p[rest])
            before = self.cum[e[rest]] - p[rest]  # mass of the edges in front of the likeliest
            t = np.where(t < before, t, t + p[rest])
            pick, n = lo.copy(), hi - lo
            for j in range(int(n.max()) - 1):
                pick += (j < n - 1) & (self.cum[np.minimum(lo + j, hi - 1)] <= t)
            bad = pick == e[rest]  # rounding at an edge's border
            pick[bad] = np.where(pick[bad] + 1 < hi[bad], pick[bad] + 1, np.maximum(pick[bad] - 1, lo[bad]))
            e[rest] = pick
        return e


def uniform(seed: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int = 0) -> np.ndarray:
    """Uniform doubles in [0, 1) from whole numbers."""
    with np.errstate(over="ignore"):
        x = mix(np.asarray(seed, U) + np.asarray(a, U) * _C + np.asarray(b, U) * U(0xC2B2AE3D27D4EB4F))
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def gumbels(u: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at - np.log(-np.log(np.maximum(u, 2.0**-53)))


def under(g: np.ndarray, top: float) -> np.ndarray:
    """Gumbel draws ``g`` made to lie under ``top``: -log(exp(-top) + exp(-g))."""
    m = np.maximum(-top, -g)
    return -(m + np.log(np.exp(-top - m) + np.exp(-g - m)))


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] numbers for each i, one after the other."""
    off = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(off, n) + np.repeat(first, n)


class Paths:
    """One whole path for each text of a batch: its steps (edges) in order of words, and from each word's end to its start."""

    def __init__(self, lat: Lattice, word: np.ndarray, text: np.ndarray, seed: np.ndarray, turn: int) -> None:
        v, live = lat.last[word], np.arange(len(word))
        at = np.arange(len(word)).astype(U)
        edges, who, j = [], [], 0
        own = mix(seed + np.array([turn + 1], U) * U(0x632BE59BD9B4E019))  # each turn has draws of its own, however many places a word has
        own, at = own[text], at - self._zero(text)
        steps = np.zeros(len(word), np.int32)
        while len(live):
            e = lat.draw(v, uniform(own, at, j))
            edges.append(e)
            who.append(live)
            steps[live] += 1
            v = lat.start[e]
            on = np.flatnonzero(v >= lat.words)
            live, v, own, at = live[on], v[on], own[on], at[on]
            j += 1
        self.off = np.concatenate([[0], np.cumsum(steps)])
        self.edge = np.empty(int(self.off[-1]), np.int32)
        for j, (e, w) in enumerate(zip(edges, who, strict=True)):
            self.edge[self.off[w] + j] = e

    @staticmethod
    def _zero(text: np.ndarray) -> np.ndarray:
        """The index of each word's text's first word, so that draws depend on places within the text only."""
        n = int(text[-1]) + 1 if len(text) else 0
        return np.searchsorted(text, np.arange(n)).astype(U)[text]


def sample_batch(voc: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations: (ids, log probability, perturbed log probability, inclusion score), best first.

    The inclusion score is the probability of being among the k under the threshold that the draw number
    k + 1 sets; 1 if all segmentations have come. An empty text has one segmentation, of no pieces.
    """
    marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
    flat = "".join(marked)
    cp = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in marked])
    toff = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(length, out=toff[1:])
    if not len(cp):
        return [[(np.zeros(0, np.int32), 0.0, 0.0, 1.0)] for _ in texts]
    mark = cp == MARK
    new = mark.copy()
    new[1:] &= ~mark[:-1]
    inside = toff[:-1][length > 0]
    new[inside] = True
    wstart = np.flatnonzero(new)
    wend = np.append(wstart[1:], len(cp))
    wlen = wend - wstart
    wtext = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(wstart, toff)))
    # distinct words of the batch by a 128-bit hash, some words at a time
    h, h2 = np.empty(len(wstart), U), np.empty(len(wstart), U)
    at = 0
    while at < len(wstart):
        to = max(at + 1, int(np.searchsorted(wstart, wstart[at] + (1 << 18), "left")))
        first = wstart[at:to] - wstart[at]
        c = cp[wstart[at] : wend[to - 1]].astype(U)
        place = (np.arange(len(c)) - np.repeat(first, wlen[at:to])).astype(U)
        h[at:to] = np.add.reduceat(mix(mix(c) + place * _C), first)
        h2[at:to] = np.add.reduceat(mix(mix(c + U(0x51ED270B)) ^ (place * U(0xD1342543DE82EF95))), first)
        at = to
    order = np.argsort(h)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    word = np.empty(len(order), np.int64)
    word[order] = np.cumsum(fresh) - 1
    rep = order[fresh]
    off = np.zeros(len(rep) + 1, np.int64)
    np.cumsum(wlen[rep], out=off[1:])
    lat = Lattice(voc, cp[_ragged(wstart[rep], wlen[rep])].astype(np.int64), off)
    del cp, h, h2, order, fresh, marked, flat
    seed = mix(keys.astype(np.int64).view(U) + U(77))
    paths = [Paths(lat, word, wtext, seed, s) for s in range(k)]
    first = np.searchsorted(wtext, np.arange(len(texts) + 1))
    drawn = _search(lat, paths, first, seed, k)
    ids = iter(_ids(lat, [x[0] for one in drawn for x in one]))
    return [[(next(ids), *x[1:]) for x in one] for one in drawn]


class _Text:
    """One text of a search: its words, the sets it has open, the paths found and the uniform draws it has ready."""

    def __init__(self, w0: int, w1: int, seed: int) -> None:
        self.w0, self.w1, self.seed = w0, w1, seed
        self.heap: list[tuple] = []
        self.found: list[tuple[np.ndarray, float, float]] = []
        self.ready: list[float] = []
        self.used = 0

    def u(self) -> float:
        if self.used == len(self.ready):
            self.ready.extend(uniform(self.seed ^ 0x5DEECE66D, np.arange(self.used, self.used + 16)).tolist())
        self.used += 1
        return self.ready[self.used - 1]

    def one(self, lat: Lattice, v: int, gone: tuple[int, ...]) -> tuple[int, float]:
        """An edge into ``v`` by shares, none of ``gone``; and the share that is left then."""
        lo, hi = int(lat.into[v]), int(lat.into[v + 1])
        share = lat.share[lo:hi].tolist()
        for e in gone:
            share[e - lo] = 0.0
        t = self.u() * math.fsum(share)
        pick = -1
        for i, p in enumerate(share):
            if p:
                pick = i
                t -= p
                if t < 0:
                    break
        share[pick] = 0.0
        return lo + pick, math.fsum(share)

    def next(self, lat: Lattice, paths: list[Paths]) -> tuple[int, float, float]:
        """Find the path of the best open set; returns the step behind the one it parts at, the mass before that step and the path's perturbed one."""
        g, name, step, before, gone = heapq.heappop(self.heap)
        g = -g
        old = self.found[name][0]
        e, rest = self.one(lat, int(lat.end[old[step]]), gone)
        # the word in which the paths part is finished by new draws; all later words are those of an own whole path
        word = self.w0 + int((lat.start[old[:step]] < lat.words).sum())
        head = [e]
        node = int(lat.start[e])
        while node >= lat.words:
            x, _ = self.one(lat, node, ())
            head.append(x)
            node = int(lat.start[x])
        own = paths[len(self.found)]
        edge = np.concatenate([old[:step], np.array(head, np.int32), own.edge[own.off[word + 1] : own.off[self.w1]]])
        if rest > 1e-15:
            again = under(gumbels(np.array([self.u()]), np.array([before + math.log(rest)])), g)
            heapq.heappush(self.heap, (-float(again[0]), name, step, before, (*gone, e)))
        self.found.append((edge, float(lat.logshare[edge].sum()), g))
        return step + 1, before + float(lat.logshare[e]), g


def _part(lat: Lattice, new: list[tuple[_Text, int, float, float]], k: int, size: int = NEAR) -> None:
    """For each (text, first step, mass before it, bound) push the sets that part from the text's newest path at its steps from the first on; of these at most k + 1 can come up.

    Masses fall along a path, so only ``size`` steps are looked at first, and four times as many where that doesn't do.
    """
    again = []
    for at in range(0, len(new), PARTED):
        block = new[at : at + PARTED]
        edges = [t.found[-1][0][frm : frm + size] for t, frm, _, _ in block]
        n = np.array([len(e) for e in edges])
        step = np.arange(max(1, int(n.max())))
        inside = step < n[:, None]
        grid = np.zeros(inside.shape, np.int32)
        grid[inside] = np.concatenate(edges)
        log = lat.logshare[grid]
        before = np.array([m for _, _, m, _ in block])[:, None] + np.cumsum(log, axis=1) - log
        inside &= before > FADED
        longer = (n == size) & inside[:, -1]
        again += [x for x, more in zip(block, longer.tolist(), strict=True) if more]
        rest = 1.0 - lat.share[grid]
        inside &= (rest > 1e-15) & ~longer[:, None]
        nth = len(block[0][0].found)
        seed = np.array([t.seed for t, _, _, _ in block], U) + U(nth)
        row, at_ = np.nonzero(inside)
        g = np.full(inside.shape, -np.inf)
        g[inside] = gumbels(uniform(seed[row], at_, 1), before[inside] + np.log(rest[inside]))
        most = k + 1 - nth + 1
        if g.shape[1] > most:
            col = np.argpartition(-g, most, axis=1)[:, :most]
        else:
            col = np.broadcast_to(step, g.shape)
        row = np.repeat(np.arange(len(block)), col.shape[1])
        col = col.reshape(-1)
        keep = inside[row, col]
        row, col = row[keep], col[keep]
        bound = under(g[row, col], np.array([x for _, _, _, x in block])[row])  # keeps their order
        for i, j, x, mass, e in zip(row.tolist(), col.tolist(), bound.tolist(), before[row, col].tolist(), grid[row, col].tolist(), strict=True):
            t, frm, _, _ = block[i]
            heapq.heappush(t.heap, (-x, nth - 1, frm + j, mass, (e,)))
    if again:
        _part(lat, again, k, 4 * size)


def _search(lat: Lattice, paths: list[Paths], first: np.ndarray, seed: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Best-first search over sets of paths, in all texts at once. A set is named by a path, a step, the log mass before the step and the edges at that step that are out of it."""
    first, out = first.tolist(), []
    texts = [_Text(a, b, x) for a, b, x in zip(first[:-1], first[1:], seed.tolist(), strict=True)]
    live = [t for t in texts if t.w1 > t.w0]
    new = []
    for t in live:
        whole = paths[0].edge[paths[0].off[t.w0] : paths[0].off[t.w1]]
        g = -math.log(-math.log(max(t.u(), 2.0**-53)))
        t.found.append((whole, float(lat.logshare[whole].sum()), g))
        new.append((t, 0, 0.0, g))
    while new:
        _part(lat, new, k)
        new = [(t, *t.next(lat, paths)) for t, *_ in new if t.heap and len(t.found) < k]
    for t in texts:
        threshold = -t.heap[0][0] if t.heap else None
        found = t.found or [(np.zeros(0, np.int32), 0.0, 0.0)]
        score = lambda x, limit=threshold: 1.0 if limit is None else -math.expm1(-math.exp(min(50.0, x - limit)))
        out.append([(edge, logp, g, score(logp)) for edge, logp, g in found])
    return out


def _ids(lat: Lattice, many: list[np.ndarray]) -> list[np.ndarray]:
    """Piece ids in reading order for whole paths: each word's edges run backwards."""
    edge = np.concatenate(many)
    stop = np.flatnonzero(lat.start[edge] < lat.words)  # the edge from a word's first node ends its stretch
    begin = np.concatenate([[0], stop[:-1] + 1])[: len(stop)]
    n = stop - begin + 1
    order = np.repeat(stop + begin, n) - np.arange(len(edge))
    p = lat.piece[edge[order]]
    off = np.concatenate([[0], np.cumsum([len(x) for x in many])])
    if lat.has_bytes:
        low = p < 0
        own = -2 - p[low]
        n = np.ones(len(p), np.int64)
        n[low] = lat.byte_len[own]
        off = np.concatenate([[0], np.cumsum(n)])[off]
        out = np.repeat(p, n)
        out[np.repeat(low, n)] = lat.byte_ids[_ragged(lat.byte_at[own], lat.byte_len[own])]
        p = out
    p = p.astype(np.int32)
    return [p[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _encode(path: str, k: int, digest: bool, size: int = BATCH):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        release()
        for whole in batches:
            for batch in chunks(whole, "text", size):
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                drawn = sample_batch(voc, texts, ids.fill_null(-1).to_numpy(), k)
                row = np.repeat(np.arange(len(texts)), [len(x) for x in drawn])
                flat = [x for one in drawn for x in one]
                cols = [ids.take(pa.array(row)), pa.array([j for one in drawn for j in range(len(one))], pa.int32())]
                cols += [pa.array([len(x[0]) for x in flat], pa.int64())]
                cols += [pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)]
                back = voc.decode_all([x[0] for x in flat])
                if digest:
                    cols += [pa.array([zlib.crc32(x[0].tobytes()) for x in flat], pa.int64())]
                    cols += [pa.array([back[i] == texts[r].replace("▁", " ") for i, r in enumerate(row.tolist())], pa.bool_())]
                else:
                    at = np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32)
                    every = np.concatenate([x[0] for x in flat]) if flat else np.zeros(0, np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(at), pa.array(every, pa.int32())), pa.array(back, pa.string())]
                del drawn, flat, back, texts
                yield pa.RecordBatch.from_arrays(cols, names=[n.split()[0] for n in (_DIGEST if digest else _FULL).split(", ")])
                del cols
                release()

    return run


_HEAD = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, "
_DIGEST = _HEAD + "ids_crc32 long, round_trip boolean"
_FULL = _HEAD + "ids array<int>, decoded string"


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, digest: bool = False, batch: int = BATCH) -> DataFrame:
    """Up to ``k`` distinct segmentations of each whole text: (doc_id, sample, n_pieces, log_prob, perturbed, inclusion, ids, decoded).

    ``digest`` puts (ids_crc32, round_trip) in place of the last two. Samples count from 0 in the order of
    their perturbed log probabilities. A null or empty text has one segmentation of no pieces; a text with
    fewer than ``k`` segmentations has all it has. Rows are keyed by ``doc_id`` (null counts as -1), so
    repeated rows get the same draws. A literal U+2581 in a text decodes to a space, as in the library.
    Texts are taken whole at any length. Other columns are ignored. ``batch`` bytes
    of text share a lattice: less takes less memory and more time, with the same draws. ``model`` is a SentencePiece file that every executor can read.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_encode(model, k, digest, batch), _DIGEST if digest else _FULL)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            i = batch.schema.get_field_index("ids")
            ids = batch.column(i)
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = voc.decode_all([flat[a:b].astype(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)])
            texts = [t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(batch.columns) if j != i), pa.array(texts, pa.string())], names=[*(n for n in batch.schema.names if n != "ids"), "text"])

    return run


def decode_segmentations(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``text`` in place of ``ids`` (array<int>): pieces and byte pieces joined, marks as spaces, the added first space off. Null ids give a null text."""
    rows = rows.drop("text")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.withColumn("ids", F.col("ids").cast("array<int>")).mapInArrow(_decode(model), f"{out}, text string" if out else "text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every whole document, as digests."""
    return sample_segmentations(table(spark, sf_dir, "documents"), model_path(), SAMPLES, digest=True)
