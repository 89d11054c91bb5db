"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved before counting, by encoding each of them with
the library. A text is split into pre-tokens by the tokenizer's own pattern; a pre-token that is such a
string counts one, and only the others are merged (byte-pair merges by rank, each distinct one once per
worker while the bounded memory of counts holds it). The sum over pre-tokens is the library's count, because
merges never cross a pre-token.

The pattern's character classes may come from another Unicode version than the library's. ``SETTLED`` lists
ranges whose classes have not changed for long (a test asks the library about every code point in them);
a text with any other code point goes to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .words import chunks

LIMIT, MEMORY, LONG = 1024, 1_000_000, 1_000_000  # over_limit bound; distinct pre-tokens whose counts a worker keeps; characters of a text that is read piece by piece
# fixed values: ranges of code points with settled classes, and the public byte-level pattern
SETTLED = ((0x0, 0x557), (0x620, 0x64A), (0x904, 0x939), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20B5), (0x2100, 0x214D), (0x2190, 0x23CF), (0x2500, 0x26B2), (0x3000, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x1F600, 0x1F640))
_OTHER = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" if a else "\\x00-" + chr(b) for a, b in SETTLED) + "]")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Counts(dict):
    """Pre-token to number of tokens; unknown ones are merged and kept while there is room."""

    def __init__(self, known: dict[str, int], merge) -> None:
        super().__init__(known)
        self._known, self._merge, self._room = known, merge, MEMORY

    def __missing__(self, piece: str) -> int:
        n = self._merge(piece)
        if len(self) >= len(self._known) + self._room:
            self.clear()
            self.update(self._known)
        self[piece] = n
        return n


class Counter:
    """Counts tokens of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` of the file does."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find, self.each = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        plain = {chr(b): b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
        code = dict(plain)
        code.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in plain)})
        special = set(self.special)
        strings = []
        for word in spec["model"]["vocab"]:
            if word in special:
                continue
            try:
                strings.append(bytes(code[c] for c in word).decode("utf-8"))
            except UnicodeDecodeError:
                continue  # a part of a character is never a pre-token
        # the proof: alone, each of these is one token, and one pre-token
        alone = self.library.encode_batch(strings, add_special_tokens=False)
        known = {s: 1 for s, e in zip(strings, alone, strict=True) if len(e.ids) == 1 and self.find(s) == [s]}
        model, byte = self.library.model, {b: c for c, b in code.items()}
        self.counts = _Counts(known, lambda piece: len(model.tokenize("".join([byte[b] for b in piece.encode("utf-8", "replace")]))))

    def _pieces(self, text: str):
        """Pre-tokens; those of a very long text one by one."""
        return self.find(text) if len(text) < LONG else (m.group() for m in self.each(text))

    def count(self, text: str) -> int:
        if not text.isascii() and _OTHER.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.split is None or not self.split.search(text):
            return sum(map(self.counts.__getitem__, self._pieces(text)))
        parts = self.split.split(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self._pieces(p))) for p in parts)


_held: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _held:
        _held[path] = Counter(path)
    return _held[path]


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for whole in batches:
            for batch in chunks(whole, "text", 8 << 20):
                n = [c.count(t) if t else 0 for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                size = pa.array(n, pa.int64())
                cols = [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n_bytes")), size, pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    Null texts count as empty: no bytes, no tokens. Repeated or null ids stay as they are; other columns
    are ignored. Texts are taken whole at any length, one that is longer than a batch by itself. ``path`` is a tokenizer file that every executor can read.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(coalesce(octet_length(cast(text as string)), 0) as long) n_bytes")
    return rows.mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document under the byte-level vocabulary of 50,257."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
