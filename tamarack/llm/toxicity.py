"""Toxic spans and document scores from a linear-chain conditional random field.

Documents carry labels, tokens do not, so a fitting step labels tokens first: in toxic documents those
words are toxic whose document counts differ between the classes beyond chance (log-likelihood ratio).
A two-state chain with emissions from the word, its first and its last bytes is fitted to these sequences
(whole sentences, however long; the cost of a token doesn't hang on its sentence). Forward-backward marginals give each token's probability;
a logistic layer over their maximum and the sum and density of likely ones gives the document's score, and runs of likely tokens
give offending offsets. The layer learns from marginals that a chain gives to texts it wasn't fitted to: two
chains, each fitted to one half, score the other half; the chain that is kept is fitted to all.

The fit sees whole texts, at most ``PER_CLASS`` labelled rows of each class with ``FIT_BYTES`` together, drawn by a
hash of their ids among the labelled rows that have a text; scoring reads every text whole, however long. Weights have a fixed size (2^18 floats a feature).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import U, Words, chunks, column_bytes, mix, release, shingles

PER_CLASS, FIT_BYTES, ROUNDS = 1200, 4 << 20, 25
BITS, FEATURES, PRIOR = 18, 3, -2.0
PIECE = 64  # tokens of a sentence that are walked one by one; longer sentences are pieces whose products are linked
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


@dataclass
class Model:
    weight: np.ndarray  # FEATURES x 2^BITS, score of the toxic state over the clean one
    step: np.ndarray  # 2 x 2 transition scores
    layer: np.ndarray  # logistic weights of (1, max, log(1 + sum), density)


class Tokens:
    """Tokens of a batch with feature slots, laid out step by step over sequences, longest first."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        w = Words(data, off, trim=True)
        self.words = w
        n = len(w.h)
        s, e = w.core
        self.h = w.h
        low = (U(1) << U(BITS)) - U(1)
        head = self._bytes(data, s, np.minimum(e, s + 4))
        tail = self._bytes(data, np.maximum(s, e - 4), e)
        self.slot = np.stack([(x >> U(20)) & low for x in (w.h, mix(head + U(1)), mix(tail + U(2)))]).astype(np.int32)
        self.text = np.repeat(np.arange(len(off) - 1), w.counts())
        new = np.ones(n, bool)
        if n:
            new[1:] = (self.text[1:] != self.text[:-1]) | _STOP[data[w.end[:-1] - 1]]
        self.behind = np.flatnonzero(~new)  # tokens with one before them in their sentence
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        pieces = -(-size // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(begin, pieces) + nth * PIECE
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        count = len(size) - np.searchsorted(np.sort(size), np.arange(1, int(size.max() if n else 0) + 1))
        self.base = np.concatenate([[0], np.cumsum(count)])
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        seq = np.repeat(np.arange(len(size)), size)
        self.at = self.base[np.arange(n) - begin[seq]] + rank[seq]  # each token's place in the layout
        # pieces that go on a sentence, the second ones first, each with the piece before it; those are whole and come first in the layout
        self.links = [(rank[k], rank[k - 1]) for j in range(1, int(pieces.max(initial=0))) if len(k := np.flatnonzero(nth == j))]

    @staticmethod
    def _bytes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Up to four bytes of each stretch, A-Z as a-z, as one number."""
        out = np.zeros(len(s), U)
        for j in range(4):
            p = s + j
            b = data[np.minimum(p, len(data) - 1)].astype(U) if len(data) else out
            b = np.where((b >= 65) & (b <= 90), b + U(32), b)
            out = (out << U(8)) | np.where(p < e, b + U(1), U(0))
        return out

    def emissions(self, weight: np.ndarray) -> np.ndarray:
        score = np.zeros(len(self.h), np.float64)
        for f in range(FEATURES):
            score += weight[f][self.slot[f]]
        out = np.empty(len(score))
        out[self.at] = score
        return out


def _odds(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x, -30, 30))


def _product(e: np.ndarray, base: np.ndarray, many: int, matrix) -> np.ndarray:
    """What the tokens behind the first of each of the first ``many`` pieces make of odds that come in, as 2 x 2 matrices; ``matrix`` gives a token's."""
    out = None
    for lo in base[1:PIECE]:
        m = matrix(_odds(e[lo : lo + many]))
        out = m if out is None else np.einsum("ijn,jkn->ikn", m, out)
        out = out / out.max(axis=(0, 1))
    return out


def _through(m: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (m[0, 0, at] * x + m[0, 1, at]) / (m[1, 0, at] * x + m[1, 1, at])


def forward_backward(e: np.ndarray, base: np.ndarray, step: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(r, b) in layout order: forward log odds with the token's own emission, and backward log odds without it.

    Of sentences in several pieces (``links``) the odds that enter each piece are found first, from the products of whole pieces, so the
    steps one after another are PIECE and the number of pieces, and not the sentence's tokens.
    """
    (a, b), (c, d) = np.exp(step)  # from clean: to clean, to toxic; from toxic: to clean, to toxic
    r, back = e.copy(), np.zeros(len(e))
    many = 1 + max((int(before.max()) for _, before in links), default=-1)
    flat = lambda *rows: np.array([[np.broadcast_to(v, many) for v in row] for row in rows])
    if links:
        ahead = _product(e, base, many, lambda x: flat((d * x, b * x), (c, a)))
        for piece, before in links:
            x = _through(ahead, before, _odds(r[before]))
            r[piece] += np.log((b + d * x) / (a + c * x))
    for lo, mid, hi in zip(base[:-2], base[1:-1], base[2:], strict=True):
        x = _odds(r[lo : lo + hi - mid])
        r[mid:hi] += np.log((b + d * x) / (a + c * x))

    def walk(width: int | None = None) -> None:
        for lo, mid, hi in zip(base[:-2][::-1], base[1:-1][::-1], base[2:][::-1], strict=True):
            hi = hi if width is None else min(hi, mid + width)
            x = _odds(e[mid:hi] + back[mid:hi])
            back[lo : lo + hi - mid] = np.log((c + d * x) / (a + b * x))

    walk()
    if links:
        behind = None  # the same from the last token to the first
        for lo in base[1:PIECE][::-1]:
            x = _odds(e[lo : lo + many])
            m = flat((d * x, c), (b * x, a))
            behind = m if behind is None else np.einsum("ijn,jkn->ikn", m, behind)
            behind = behind / behind.max(axis=(0, 1))
        last = int(base[PIECE - 1])
        for piece, before in links[::-1]:
            x = _odds(e[piece] + back[piece])
            y = (c + d * x) / (a + b * x)
            back[last + before] = np.log(y)
            back[before] = np.log(_through(behind, before, y))
        walk(many)
    return r, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def marginals(t: Tokens, model: Model) -> np.ndarray:
    e = t.emissions(model.weight)
    r, b = forward_backward(e, t.base, model.step, t.links)
    return _sigmoid(r + b)[t.at]


def summary(t: Tokens, p: np.ndarray, n: int) -> np.ndarray:
    """(1, max, log(1 + sum), density) of the marginals of each of ``n`` texts; an empty text has (1, 0, 0, 0).

    Sum and density are of tokens at 0.5 or more: the many small marginals of a long clean text must not add up.
    """
    top, total = np.zeros(n), np.zeros(n)
    count = t.words.counts()
    has = np.flatnonzero(count)
    if len(has):
        first = t.words.first[:-1][has]
        top[has], total[has] = np.maximum.reduceat(p, first), np.add.reduceat(np.where(p >= 0.5, p, 0.0), first)
    return np.stack([np.ones(n), top, np.log1p(total), 20 * total / np.maximum(count, 1)], axis=1)


def token_labels(t: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Whether each token is a word of toxic documents: its document counts by class differ beyond chance."""
    word, which = np.unique(t.h, return_inverse=True)
    pair = np.unique(which.astype(np.int64) * len(toxic) + t.text)
    df, doc = pair // len(toxic), pair % len(toxic)
    y = toxic[doc].astype(bool)
    bad, good = (np.bincount(df[m], minlength=len(word)).astype(float) for m in (y, ~y))
    nb, ng = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    share = (bad + good) / (nb + ng)

    def term(k: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.where(k > 0, k * np.log(k / (n * share)), 0.0)
            two = np.where(n - k > 0, (n - k) * np.log((n - k) / np.maximum(n * (1 - share), 1e-9)), 0.0)
        return one + two

    llr = 2 * (term(bad, nb) + term(good, ng))
    own = (llr > 16) & (bad / nb > 8 * (good + 0.25) / ng)
    return own[which] & toxic[t.text].astype(bool)


def originals(texts: list[str]) -> np.ndarray:
    """Indices of texts that share no two-value min-hash band over five-word shingles with an earlier text: copies would count their words again and again."""
    x, off = shingles(Words(*column_bytes(pa.array(texts, pa.large_string()))), 5)
    seen: set[int] = set()
    keep = []
    for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        low = [int(mix(x[a:b] + U(j)).min()) if b > a else -1 for j in range(12)]
        bands = {hash((j, low[j], low[j + 1])) for j in range(0, 12, 2)}
        if b == a or not bands & seen:
            keep.append(i)
        seen |= bands
    return np.array(keep, int)


def fit_chain(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, step) of a chain fitted to labelled texts; what no text has shown stays clean."""
    weight, step = np.full((FEATURES, 1 << BITS), PRIOR), np.zeros((2, 2))
    t = Tokens(*column_bytes(pa.array(texts, pa.large_string())))
    if not len(t.h):
        return weight, step
    n, base, links = len(t.h), t.base, t.links
    y = np.empty(n, np.float32)
    y[t.at] = token_labels(t, toxic)
    slot = np.empty_like(t.slot)
    slot[:, t.at] = t.slot
    right, left = t.at[t.behind].astype(np.int32), t.at[t.behind - 1].astype(np.int32)  # tokens and those before them
    del t
    seen = np.array([[np.sum((y[left] == i) & (y[right] == j)) for j in (0, 1)] for i in (0, 1)], float)
    heat = [np.full_like(weight, 1e-6), np.full_like(step, 1e-6)]
    for _ in range(ROUNDS):
        e = weight[0][slot[0]] + weight[1][slot[1]] + weight[2][slot[2]]
        r, b = forward_backward(e, base, step, links)
        pairs = np.zeros(4)
        for at in range(0, len(right), 1 << 17):
            own = right[at : at + (1 << 17)]
            x = e[own] + b[own]
            before = r[left[at : at + (1 << 17)]]
            z = np.stack([np.full(len(x), step[0, 0]), step[0, 1] + x, step[1, 0] + before, step[1, 1] + before + x])
            z = np.exp(z - z.max(axis=0))
            pairs += (z / z.sum(axis=0)).sum(axis=1)
        p = y - _sigmoid(r + b)
        grads = [np.stack([np.bincount(slot[f], p, 1 << BITS) for f in range(FEATURES)]) - 1e-3 * (weight - PRIOR), seen - pairs.reshape(2, 2) - 1e-3 * step]
        for v, g, h in zip((weight, step), grads, heat, strict=True):  # Adagrad
            h += g * g
            v += 0.5 * g / np.sqrt(h)
    return weight, step


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """A model from labelled texts; ``share`` is the part of toxic rows among all labelled ones.

    Without texts of both classes every text gets ``share``. With one text of a class, which can't be in both halves, the
    half without it knows no toxic words and scores the other as clean.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Model(np.zeros((FEATURES, 1 << BITS)), np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    if not (0 < toxic.sum() < len(toxic)):
        return model
    kept = [np.flatnonzero(toxic == c)[originals([texts[i] for i in np.flatnonzero(toxic == c)])] for c in (0, 1)]
    halves = [np.concatenate([k[h::2] for k in kept]) for h in (0, 1)]
    rows, target = [], []
    for own, other in (halves, halves[::-1]):
        if not len(other):
            continue
        chain = Model(*fit_chain([texts[i] for i in own], toxic[own]), model.layer)
        t = Tokens(*column_bytes(pa.array([texts[i] for i in other], pa.large_string())))
        rows.append(summary(t, marginals(t, chain), len(other)))
        target.append(toxic[other])
        del t, chain
        release()
    every = np.concatenate(kept)
    model.weight, model.step = fit_chain([texts[i] for i in every], toxic[every])
    s, target = np.concatenate(rows), np.concatenate(target).astype(float)
    layer = np.zeros(4)
    # each class weighs as much as among all labelled rows
    heavy = np.where(target == 1, share / target.mean(), (1 - share) / (1 - target.mean()))
    for _ in range(30):  # Newton with a small ridge
        q = _sigmoid(s @ layer)
        hess = (s * (heavy * q * (1 - q))[:, None]).T @ s + 0.01 * np.eye(4)
        layer += np.linalg.solve(hess, s.T @ (heavy * (target - q)) - 0.01 * layer)
    model.layer = layer
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most PER_CLASS labelled rows of each class with FIT_BYTES of text together.

    ``labels`` holds (doc_id, toxic) and only rows that may be learnt from. An id that has both labels is toxic; of its
    texts, if there are several, the smallest counts. Rows with a null label, id or text are left out before the draw, so
    are texts over FIT_BYTES.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    sizes = rows.select("id", F.octet_length("text").alias("n")).filter(F.col("n") <= FIT_BYTES).groupBy("id").agg(F.max("n").alias("n"))
    known = sizes.join(own, "id")
    drawn = []
    for c in (0, 1):
        room = FIT_BYTES
        for r in known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS).collect():  # at most PER_CLASS rows of numbers
            if r["n"] <= room:
                room -= r["n"]
                drawn.append((r["id"], c))
    few = F.broadcast(docs.sparkSession.createDataFrame(drawn, "id long, toxic int"))  # at most 2 * PER_CLASS rows, so no text is shuffled
    got = rows.filter(F.octet_length("text") <= FIT_BYTES).join(few, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values("id")
    got = got.iloc[np.argsort(mix(got["id"].to_numpy().astype(np.int64).view(U)), kind="stable")]
    texts, toxic = got["text"].tolist(), got["toxic"].to_numpy().astype(int)
    share = own.agg(F.avg("toxic")).first()[0]
    model = fit(texts, toxic, 0.5 if share is None else share)
    release()
    return model


def _score(held, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for batch in chunks(whole, "text", 2 << 20):
                data, off = column_bytes(batch.column(batch.schema.get_field_index("text")))
                t = Tokens(data, off)
                p = marginals(t, model)
                score = _sigmoid(summary(t, p, batch.num_rows) @ model.layer)
                cols = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(score)]
                names = ["doc_id", "score"]
                if spans:
                    cols.append(_runs(t, p, off))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _runs(t: Tokens, p: np.ndarray, off: np.ndarray) -> pa.Array:
    """Runs of tokens at 0.5 or more, as byte offsets into their text with the mean marginal."""
    hot = np.flatnonzero(p >= 0.5)
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) > 1) | (t.text[hot[1:]] != t.text[hot[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hot))[: len(first)] - 1
    text = t.text[hot[first]]
    begin, end = t.words.start[hot[first]] - off[text], t.words.end[hot[last]] - off[text]
    mean = np.add.reduceat(p[hot], first) / (last - first + 1) if len(first) else np.zeros(0)
    at = np.searchsorted(text, np.arange(len(off))).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(mean)], names=["start", "end", "marginal"])
    return pa.ListArray.from_arrays(pa.array(at), rows)


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """(doc_id, score, spans): every row's score from 0 to 1 and the byte ranges of its toxic runs.

    A null or empty text has no spans and the score of the empty summary. Rows come one for one, so
    repeated or null ids stay as they are; other columns are ignored. Texts are taken whole at any length, also as one sentence.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = "doc_id long, score double" + (", spans array<struct<start long, end long, marginal double>>" if spans else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_score(held, spans), out)


def train_fold(labels: DataFrame) -> DataFrame:
    """Label rows whose id is not held out."""
    return labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)


def remove_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without rows that score ``least`` or more; scores come from the texts alone. All columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, train_fold(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 2 << 20):
                t = Tokens(*column_bytes(batch.column(batch.schema.get_field_index("text"))))
                s = _sigmoid(summary(t, marginals(t, held.value), batch.num_rows) @ held.value.layer)
                yield batch.filter(pa.array(s < least))

    return docs.mapInArrow(run, docs.schema)


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every whole document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, train_fold(table(spark, sf_dir, "labels"))), spans=False)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
