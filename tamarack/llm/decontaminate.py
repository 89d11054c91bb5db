"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders (``<num>``, ``<name>``, ``<unit>``), so a question whose
values were changed keeps its template. Windows of the documents are hash-joined with those of the benchmark. A window is two
pieces of ``PIECES`` tokens, six in all, with nothing or one token between them on either side; so an item is met around one word that was changed,
put in or left out, wherever it stands: a copy is met where six of its tokens agree around one edited place at most. Matches that lie on one diagonal, or on neighbouring ones in order,
form a region; its template tokens are compared as a whole, and the slots must be consistent: one benchmark value maps to one document
value all over the region, and the other way round. A document is contaminated by an item if the
consistent region covers ``COVER`` of the item.

Canonical rules, the same on both sides: a token of digits (with ``.,:/%+-`` inside or currency signs) is a
number; a fixed list of unit words behind a number are units; a capitalised word that doesn't start a
sentence or a line is a name, with the names behind it one token, and with the word in front of it that opens the
sentence unless that is a function word. Case and punctuation at the ends are dropped.

A window with fewer than ``LITERAL`` words that are no slots says little about a template, so its values are its hash. An item of fewer than
``LEAST`` tokens is one window of its own length, all of which must agree; only numbers are slots there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, with_nodes
from .words import U, Words, chunks, column_bytes, mix

PIECES = ((4, 2), (3, 3), (2, 4))
COVER, LEAST, LITERAL = 0.6, 8, 2
SWITCH = 4  # tokens: what a change of shift has to win, so that chance agreements don't add up
REQUESTS = 2000  # slices that one copy of a document serves
HELD_WINDOWS = 2_000_000  # distinct benchmark windows up to which their hashes (8 bytes each) go to every executor
# fixed values: unit words
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams "
    "kilogram kilograms pound pounds liter liters litre litres dollar dollars cent cents euro euros percent degree degrees mph kmh"
).split()
# fixed values: words that open a sentence without being part of a name
FUNCTION = (
    "a an and are as at but by can could did do does for from had has have he her his how i if in is it its my no not of on or our she should so "
    "some that the their then there these they this those to was we were what when where which while who whom whose why will with would yes you your"
).split()
_NUM, _NAME, _UNIT = (mix(np.array([i], U) * U(0xA24BAED4963EE407))[0] for i in (1, 2, 3))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMBER = _DIGIT.copy()
_NUMBER[[ord(c) for c in ".,:/%+-$"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(Words(*column_bytes(pa.array(words, pa.large_string())), trim=True).h)


_known: dict[str, np.ndarray] = {}


def _is(name: str, words: list[str], h: np.ndarray) -> np.ndarray:
    """Whether each hash is that of one of ``words``."""
    own = _known.setdefault(name, _hashes(words))
    return own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h


class Template:
    """Template token hashes ``t``, slot kinds (0 none, 1 number, 2 name, 3 unit), value hashes ``h``, each text's first token and each token's first word, counted from its text's start."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        w = Words(data, off, trim=True)
        first, h = w.first, w.h
        n = len(h)
        kind = np.zeros(n, np.int8)
        word = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        if n:
            s, e = w.core
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            numeric = np.concatenate([[0], np.cumsum(_NUMBER[data])])
            number = (digits[e] > digits[s]) & (numeric[e] - numeric[s] == e - s)
            kind[number] = 1
            head = data[s]
            capital = (head >= 65) & (head <= 90)
            opens = np.ones(n, bool)
            opens[1:] = _STOP[data[w.end[:-1] - 1]]
            opens[first[:-1][first[:-1] < n]] = True
            lines = np.concatenate([[0], np.cumsum(data == 10)])
            opens[1:] |= lines[w.start[1:]] > lines[w.end[:-1]]  # a line break in front also starts a sentence
            kind[capital & ~opens] = 2
            # a capitalised word that opens a sentence in front of a name is part of it
            leads = np.zeros(n, bool)
            leads[:-1] = capital[:-1] & opens[:-1] & (kind[1:] == 2) & (e[:-1] == w.end[:-1])
            kind[leads & ~_is("function", FUNCTION, h)] = 2
            behind = np.zeros(n, bool)
            behind[1:] = number[:-1]
            kind[_is("units", UNITS, h) & behind] = 3
            # names in a row, without a mark between them, are one
            more = np.zeros(n, bool)
            more[1:] = (kind[1:] == 2) & (kind[:-1] == 2) & (e[:-1] == w.end[:-1]) & ~opens[1:]
            if more.any():
                at = np.flatnonzero(~more)
                nth = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
                h = np.add.reduceat(mix(h + nth.astype(U) * U(0xD1342543DE82EF95)) * (nth > 0) + h * (nth == 0), at)
                kind, word = kind[at], word[at]
                first = np.searchsorted(at, first)
        self.h, self.first, self.kind, self.word = h, first, kind, word
        self.t = np.where(kind == 1, _NUM, np.where(kind == 2, _NAME, np.where(kind == 3, _UNIT, h)))

    def _pieces(self, size: int, slots: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template hash, value hash, words that are no slots) of every ``size`` tokens in a row; only kinds in ``slots`` are slots."""
        slot = np.isin(self.kind, slots)
        template = np.where(slot, self.t, self.h)
        n = max(0, len(self.t) - size + 1)
        h, plain, literal = np.zeros(n, U), np.zeros(n, U), np.zeros(n, np.int8)
        for j in range(size):
            h = h * U(0xD1342543DE82EF95) + template[j : j + n]
            plain = plain * U(0xD1342543DE82EF95) + self.h[j : j + n]
            literal += ~slot[j : j + n]
        return h, plain, literal

    def _inside(self, at: np.ndarray, size: int) -> np.ndarray:
        return at + size <= self.first[np.searchsorted(self.first, at, "right")]

    def seeds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tokens between, hash, index of first token) of all windows of two pieces inside a text, kind by kind."""
        made = {n: self._pieces(n) for n in {n for two in PIECES for n in two}}
        for kind, (a, b) in enumerate(PIECES):
            for gap in (0, 1):
                n = len(self.t) - a - b - gap + 1
                if n <= 0:
                    continue
                one, two = ([v[x : x + n] for v in made[size]] for size, x in ((a, 0), (b, a + gap)))
                enough = one[2] + two[2] >= LITERAL
                h = np.where(enough, one[0] * U(0x9FB21C651E98DF25) + two[0], one[1] * U(0x9FB21C651E98DF25) + two[1] + U(1))
                ok = np.flatnonzero(self._inside(np.arange(n), a + b + gap))
                yield gap, mix(h[ok] + U(2 * kind)), ok

    def whole(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of all windows of ``size`` tokens, fewer than LEAST. Only numbers are slots: another name makes a short question another question."""
        h, plain, literal = self._pieces(size, (1,))
        ok = np.flatnonzero(self._inside(np.arange(len(h)), size))
        return mix(np.where(literal > LITERAL, h, plain + U(1))[ok] + U(1000 + size)), ok


def _doc_windows(held, sizes: list[int]):
    """Windows of documents, (doc_id, place, gap, h): those whose hash ``held`` has, or all if it is None. ``sizes``: lengths of items under LEAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if held is None else held.value
        if keep is not None:
            likely = np.zeros(1 << 22, bool)
            likely[keep >> U(42)] = True
        for whole in batches:
            for batch in chunks(whole, "text", 2 << 20):
                t = Template(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
                for gap, h, at in chain(t.seeds(), ((0, *t.whole(n)) for n in sizes)):
                    if keep is not None:
                        if not len(keep):
                            continue
                        ok = likely[h >> U(42)]
                        h, at = h[ok], at[ok]
                        ok = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h
                        h, at = h[ok], at[ok]
                    text = np.searchsorted(t.first, at, "right") - 1
                    ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at - t.first[text]), pa.array(np.full(len(at), gap)), pa.array(h.view(np.int64))], names=["doc_id", "place", "gap", "h"])

    return run


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, ip, own_gap, h, short): the windows of items; an item under LEAST tokens (short: their number) is one window of its own length."""
    for whole in batches:
        for batch in chunks(whole, "text", 2 << 20):
            t = Template(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
            size = np.diff(t.first)
            for n, gap, h, at in chain(((0, *s) for s in t.seeds()), ((n, 0, *t.whole(n)) for n in range(1, LEAST))):
                text = np.searchsorted(t.first, at, "right") - 1
                ok = size[text] == n if n else size[text] >= LEAST
                h, at, text = h[ok], at[ok], text[ok]
                ids = batch.column(batch.schema.get_field_index("item_id")).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at - t.first[text]), pa.array(np.full(len(h), gap)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), n))], names=["item_id", "ip", "own_gap", "h", "short"])


def _tokens(name: str):
    """Template tokens, kinds and values of whole texts as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 2 << 20):
                t = Template(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
                cut = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(t.first[:-1], t.first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(name)), cut(t.t), cut(t.kind), cut(t.h)], names=[name, "t", "kind", "value"])

    return run


def _path(same: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The shift (as an index) of each item token on the best way through ``same`` (shift, token), -1 for tokens left out: document
    places only grow, and a change of shift has to win more than SWITCH tokens.

    Shifts ascend. A way to a larger shift takes the best of all smaller ones at the same token; one to a smaller shift goes on from the same document
    place, so the best of each place is kept. Time and memory are shifts x tokens.
    """
    many, size = same.shape
    best = np.zeros(many, np.int64)
    came, since = np.zeros((many, size), np.int32), np.zeros((many, size), np.int32)  # the shift and the token that a step comes from
    at = shifts - shifts[0]
    top = np.full(int(at[-1]) + size + 1, -(1 << 30), np.int64)  # of each document place
    who, when = np.zeros(len(top), np.int32), np.zeros(len(top), np.int32)
    own = np.arange(many)
    for j in range(size):
        lead = np.maximum.accumulate(best)
        leader = np.maximum.accumulate(np.where(best == lead, own, 0))
        below = np.concatenate([[-(1 << 30)], lead[:-1]]) - SWITCH
        place = at + j
        ways = np.stack([best, below, top[place] - SWITCH])
        pick = ways.argmax(axis=0)
        came[:, j] = np.choose(pick, [own, np.concatenate([[0], leader[:-1]]), who[place]])
        since[:, j] = np.where(pick == 2, when[place], j)
        new = ways.max(axis=0)
        grown = best > top[place]
        top[place[grown]], who[place[grown]], when[place[grown]] = best[grown], own[grown], j
        best = new + same[:, j]
    path = np.full(size, -1, np.int64)
    k, j = int(best.argmax()), size - 1
    while j >= 0:
        path[j] = k
        k, j = int(came[k, j]), int(since[k, j]) - 1
    return path


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (document slice, item): the tokens of the item whose template agrees with the slice and whose slots map one to one, on each shift alone and over neighbouring shifts."""
    for batch in batches:
        rows = batch.to_pydict()
        out: list[tuple] = []
        for i in range(batch.num_rows):
            size = len(rows["it"][i]) // 8
            it, dt = np.frombuffer(rows["it"][i], U), np.frombuffer(rows["dt"][i], U)
            ik, iv, dv = np.frombuffer(rows["ik"][i], np.int8), np.frombuffer(rows["iv"][i], U), np.frombuffer(rows["dv"][i], U)
            shifts = np.array(rows["shifts"][i], np.int64)
            place = np.arange(size) + shifts[:, None] - rows["lo"][i]  # of each item token in the slice, for each shift
            inside = (place >= 0) & (place < len(dt))
            place[~inside] = 0
            agree = inside & ((it == dt[place]) | (iv == dv[place])) if len(dt) else inside  # a name in small letters is still that name
            least = max(COVER * size, min(size, LEAST))
            ways = [np.full(size, k) for k in np.flatnonzero(agree.sum(axis=1) >= least)]
            if len(shifts) > 1:
                ways.append(_path(agree, shifts))
            for way in ways:
                on = np.flatnonzero(way >= 0)
                on = on[agree[way[on], on]]
                if len(on) < least:
                    continue
                forth: dict[int, int] = {}
                back: dict[int, int] = {}
                changed, good = 0, len(on)
                for j in on[ik[on] > 0].tolist():
                    x, y = int(iv[j]), int(dv[place[way[j], j]])
                    if forth.setdefault(x, y) != y or back.setdefault(y, x) != x:
                        good -= 1
                    else:
                        changed += x != y
                words = np.frombuffer(rows["dw"][i], np.int32)
                begin = int(words[min(max(int(shifts[way[on[0]]]) - rows["lo"][i], 0), len(words) - 1)])
                out.append((rows["doc_id"][i], rows["item_id"][i], begin, good, size, changed))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        names = ["doc_id", "item_id", "start_word", "matched", "item_words", "changed_slots"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slice of a document's tokens that each (item, shifts) asks for."""
    for whole in batches:
        for batch in chunks(whole, "text", 2 << 20):
            t = Template(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
            asked = batch.column(batch.schema.get_field_index("asked")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out = []
            for i, asks in enumerate(asked):
                a, b = int(t.first[i]), int(t.first[i + 1])
                for q in asks:
                    lo = max(0, q["shifts"][0])
                    x, y = a + lo, min(b, a + q["shifts"][-1] + q["size"])
                    if x < y:
                        out.append((ids[i], q["item_id"], q["shifts"], lo, t.t[x:y].tobytes(), t.h[x:y].tobytes(), t.word[x:y].astype(np.int32).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 2 + [pa.list_(pa.int64()), pa.int64()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "shifts", "lo", "dt", "dv", "dw"])


def _found(spark: SparkSession, rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(node, item_id, start_word, matched, item_words, changed_slots) of ``rows(node, text)``: see :func:`contamination`."""
    docs = rows.withColumnRenamed("node", "doc_id")
    texts = benchmark.selectExpr("cast(item_id as long) own_id", "cast(text as string) text").filter("own_id is not null and text is not null").distinct()
    # texts that share an item's id are items of their own until the end
    items = Scratch(spark, texts.withColumn("item_id", F.xxhash64("own_id", "text")), "benchmark").df
    own = Scratch(spark, items.mapInArrow(_item_windows, "item_id long, ip long, own_gap long, h long, short long"), "items").df
    sizes = sorted(r[0] for r in own.filter("short > 0").select("short").distinct().collect())  # fewer than LEAST
    hashes = own.select("h").distinct()
    held = None
    if hashes.count() <= HELD_WINDOWS:  # a bounded filter before the join; above it the join alone decides
        known = np.sort(hashes.toArrow().column("h").to_numpy().view(U))
        held = spark.sparkContext.broadcast(known)
    hits = docs.mapInArrow(_doc_windows(held, sizes), "doc_id long, place long, gap long, h long").join(own, "h")
    shift = F.col("place") - F.col("ip")  # of the first piece; that of the second differs by what was put in or left out
    hits = hits.select("doc_id", "item_id", F.explode(F.array_distinct(F.array(shift, shift + F.col("gap") - F.col("own_gap")))).alias("shift"))
    hits = Scratch(spark, hits.distinct(), "diagonals").df
    tokens = Scratch(spark, items.mapInArrow(_tokens("item_id"), "item_id long, t binary, kind binary, value binary"), "templates").df
    sized = tokens.select("item_id", (F.length("t") / 8).cast("long").alias("size"))
    # matched tokens are no function of the hits, so each diagonal is compared. Words put in or left out part a copy into several shifts: those
    # inside one item's length are compared together, in stretches that overlap, so that any two of them meet and no stretch is longer than two items
    worth = hits.join(sized, "item_id").withColumn("own", F.floor(F.col("shift") / F.col("size")))
    parts = worth.withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    chains = parts.groupBy("doc_id", "item_id", "size", "stretch").agg(F.sort_array(F.collect_list("shift")).alias("shifts")).drop("stretch").distinct()
    many = chains.groupBy("doc_id").agg(F.ceil(F.sum(F.size("shifts")) / REQUESTS).alias("parts"))
    lists = chains.join(many, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("item_id", "shifts"), "parts").alias("part")).agg(F.collect_list(F.struct("item_id", "shifts", "size")).alias("asked"))
    slices = docs.join(lists, "doc_id").select("doc_id", "text", "asked").mapInArrow(_cut, "doc_id long, item_id long, shifts array<long>, lo long, dt binary, dv binary, dw binary")
    named = tokens.select("item_id", F.col("t").alias("it"), F.col("kind").alias("ik"), F.col("value").alias("iv"))
    found = slices.join(named, "item_id").mapInArrow(_regions, "doc_id long, item_id long, start_word long, matched long, item_words long, changed_slots long")
    good = found.filter((F.col("matched") >= F.col("item_words") * COVER) & (F.col("matched") >= F.least(F.col("item_words"), F.lit(LEAST))))
    good = good.join(items.select("item_id", "own_id"), "item_id")
    order = F.struct(-F.col("matched"), "changed_slots", "start_word", "item_words")
    best = good.groupBy("doc_id", "own_id").agg(F.min_by(F.struct("start_word", "matched", "item_words", "changed_slots"), order).alias("b"))
    return best.select(F.col("doc_id").alias("node"), F.col("own_id").alias("item_id"), "b.start_word", "b.matched", "b.item_words", "b.changed_slots")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, matched, item_words, changed_slots): for each document and benchmark item the best consistent region that covers COVER of the item.

    Counts are of template tokens, ``start_word`` is a word of the text. At least LEAST tokens must agree; an item of fewer tokens is found where all
    of them stand in a row, with other numbers if it has more than LITERAL other words, but with the same names. Tokens may be put in or left out, in all up to the item's own length; items without words, null texts and null ids on either side match nothing. Of
    repeated ids, on either side, every text is compared and the best counts. Texts are taken whole at any length.
    ``changed_slots`` counts values that differ, so 0 is a copy. Other columns are ignored.
    """
    rows, names = with_nodes(spark, docs)
    found = _found(spark, rows, benchmark)
    if names is None:
        return found.withColumnRenamed("node", "doc_id")
    order = F.struct(-F.col("matched"), "changed_slots", "start_word", "item_words")
    best = found.join(names, "node").groupBy("doc_id", "item_id").agg(F.min_by(F.struct("start_word", "matched", "item_words", "changed_slots"), order).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay, rows with a null id or text stay. Of rows that share an id only those go whose own text holds an item."""
    rows, names = with_nodes(spark, docs)
    bad = _found(spark, rows, benchmark).select("node").distinct()
    if names is None:
        return docs.join(bad, docs["doc_id"] == bad["node"], "left_anti")
    bad = bad.join(names, "node").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    return docs.join(bad, (docs["doc_id"] == bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__hash"]), "left_anti")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against every benchmark item."""
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
