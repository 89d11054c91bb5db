import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import decontaminate, quality, sampling, tokens, toxicity
from tamarack.llm.words import Words, column_bytes, shingles

from .helpers import documents, empty, long_words

BPE = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ODD = ["", " ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "  x\n\n y\t　z  ", "l'été I'll we've 'S 'll", "é" * 50, "\U0001f600‍ x", "१२३ ⅷ ²", "\x00\x85\xa0 x", "᠎​﻿ ", "日本語テキスト", "Ͳͳ᲏", "a " * 3000]


def test_words_are_the_pattern():
    texts = [None, "", " a\tB\x0b c ", "É x", "no", "\x1c\x1d a"]
    w = Words(*column_bytes(pa.array(texts)))
    assert w.counts().tolist() == [0, 0, 3, 2, 1, 2]
    same = Words(*column_bytes(pa.array(["b", "B", "a", "É"])))
    assert same.h[0] == same.h[1] == w.h[1] and same.h[2] == w.h[0] and same.h[3] == w.h[3]
    h, off = shingles(w, 2)
    assert np.diff(off).tolist() == [0, 0, 2, 1, 1, 1]


def test_token_counts_are_the_librarys(spark):
    c = tokens.counter(BPE)
    for t in ODD:
        assert c.count(t) == len(c.library.encode(t, add_special_tokens=False).ids), t
    long = "ab c1 " * 200_000
    assert c.count(long) == len(c.library.encode(long, add_special_tokens=False).ids)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, BPE).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == len(c.library.encode(r["text"], add_special_tokens=False).ids)
    rows = tokens.token_counts(documents(spark, [(1, None), (None, "a"), (2, "é"), (2, "é")]), BPE).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == [("1", 0, 0, False), ("2", 2, 1, False), ("2", 2, 1, False), ("None", 1, 1, False)]
    assert tokens.token_counts(empty(spark), BPE).count() == 0


def test_settled_ranges_agree_with_the_library():
    c = tokens.counter(BPE)
    for a, b in tokens.SETTLED:
        for cp in range(a, b + 1, 1 if b - a < 2000 else 13):
            p = f"a{chr(cp)}1{chr(cp)}!{chr(cp)}a {chr(cp)}"
            at, own = 0, []
            for piece in c.find(p):
                own.append((at, at + len(piece)))
                at += len(piece)
            assert own == [x[1] for x in c.library.pre_tokenizer.pre_tokenize_str(p)], hex(cp)


def test_samples_are_distinct_and_decode(spark):
    path = sampling.model_path()
    voc = sampling.vocabulary(path)
    texts = ["", "the a", " x  y", "héllo \n\t wörld 日本語 \U0001f600", "a" * 2000, "   "]
    drawn = sampling.sample_batch(voc, texts, np.arange(len(texts)), 4)
    for t, one in zip(texts, drawn, strict=True):
        assert len({tuple(x[0]) for x in one}) == len(one) and all(s == t for s in voc.decode_all([x[0] for x in one]))
        assert [x[2] for x in one] == sorted((x[2] for x in one), reverse=True) and all(0 <= x[3] <= 1 for x in one)
    # alone or among others, a row draws the same
    again = sampling.sample_batch(voc, texts[3:4], np.array([3]), 4)[0]
    assert [tuple(x[0]) for x in again] == [tuple(x[0]) for x in drawn[3]]
    rows = [(1, None), (None, "ab"), (2, "the a"), (2, "the a"), (3, "x")]
    out = sampling.sample_segmentations(documents(spark, rows), path, 3)
    assert all((r["decoded"] or "") in ("", "ab", "the a", "x") for r in out.collect()) and out.filter("doc_id = 1").count() == 1
    assert sampling.sample_segmentations(empty(spark), path).count() == 0
    back = sampling.decode_segmentations(out.select("doc_id", "decoded", "ids").union(spark.createDataFrame([(9, None, None)], "doc_id long, decoded string, ids array<int>")), path).collect()
    assert all((r["text"] or "") == (r["decoded"] or "") for r in back) and [r["text"] for r in back if r["doc_id"] == 9] == [None]


def test_samples_follow_the_distribution():
    voc = sampling.vocabulary(sampling.model_path())
    n = 4000
    drawn = sampling.sample_batch(voc, ["the a"] * n, np.arange(n), 2)
    first, p = {}, {}
    for one in drawn:
        first[tuple(one[0][0])] = first.get(tuple(one[0][0]), 0) + 1
        p.update({tuple(x[0]): math.exp(x[1]) for x in one})
    for ids, count in first.items():
        assert abs(count / n - p[ids]) < 4 * math.sqrt(p[ids] / n) + 1e-3


def every_way(voc, text):
    """Log probability of each segmentation of a text, by enumeration over the pieces that the sampler itself has drawn or could draw."""
    index = {p: i for i, p in enumerate(voc.piece) if i not in voc.byte_of}
    out = {}

    def go(at, ids, logp):
        if at == len(text):
            out[tuple(ids)] = logp
        for end in range(at + 1, min(len(text), at + voc.longest) + 1):
            i = index.get(text[at:end])
            if i is not None and voc.logp[i] > -1e9:
                go(end, [*ids, i], logp + voc.logp[i])

    go(0, [], 0.0)
    top = max(out.values())
    total = top + math.log(sum(math.exp(v - top) for v in out.values()))
    return {k: v - total for k, v in out.items()}


def test_second_draws_and_inclusion_follow_the_law():
    """Draws without replacement: the second follows the renormalised rest; inverse inclusion scores give the masses back without bias."""
    voc = sampling.vocabulary(sampling.model_path())
    n, text = 6000, "house"
    law = {k: math.exp(v) for k, v in every_way(voc, "\u2581" + text).items()}
    drawn = sampling.sample_batch(voc, [text] * n, np.arange(n), 2)
    first, second, weight = {}, {}, {}
    for one in drawn:
        a, b = tuple(one[0][0].tolist()), tuple(one[1][0].tolist())
        first[a] = first.get(a, 0) + 1 / n
        second[b] = second.get(b, 0) + 1 / n
        for x in one:
            k = tuple(x[0].tolist())
            weight[k] = weight.get(k, 0) + math.exp(x[1]) / x[3] / n
    assert set(first) | set(second) <= set(law)
    for k, p in law.items():
        want = sum(q * p / (1 - q) for j, q in law.items() if j != k)
        assert abs(first.get(k, 0) - p) < 5 * math.sqrt(p / n) + 1e-3 and abs(second.get(k, 0) - want) < 5 * math.sqrt(want / n) + 1e-3
        if p > 0.02:
            assert abs(weight.get(k, 0) - p) < 0.25 * p



def test_texts_of_a_batch_are_searched_together(monkeypatch):
    voc = sampling.vocabulary(sampling.model_path())
    rng = np.random.default_rng(3)
    texts = ["", " ", "a", "日本 ü"] + [" ".join(rng.choice(["the", "erstwhile", "thing", "onhalyti", "é1"], n)) for n in (1, 2, 40, 700) for _ in range(20)]
    keys = np.arange(len(texts))
    calls = []
    plain = sampling.uniform
    monkeypatch.setattr(sampling, "uniform", lambda *a: calls.append(1) or plain(*a))
    drawn = sampling.sample_batch(voc, texts, keys, 2)
    assert len(calls) < 1.5 * len(texts)  # one for a text and those of the batch
    part = sampling._part
    for size, block in ((1, 1), (3, 7), (4096, 4096)):
        monkeypatch.setattr(sampling, "PARTED", block)
        monkeypatch.setattr(sampling, "_part", lambda lat, new, k, near=size: part(lat, new, k, near))
        for a, b in zip(drawn, sampling.sample_batch(voc, texts, keys, 2), strict=True):
            assert [(x[0].tolist(), *x[1:]) for x in a] == [(x[0].tolist(), *x[1:]) for x in b]


def test_draws_of_a_very_long_word_are_independent():
    voc = sampling.vocabulary(sampling.model_path())
    one, two = sampling.sample_batch(voc, ["the" * 9000], np.array([5]), 2)[0]
    a, b = one[0].tolist(), two[0].tolist()
    assert a != b and voc.decode_all([one[0], two[0]]) == ["the" * 9000] * 2


def test_toxicity(spark):
    bad = ["vile", "scum", "rot"]
    rows, labels = [], []
    for i in range(400):
        w = long_words(40, i)
        toxic = i % 5 == 0
        if toxic:
            for j, b in enumerate(bad):
                w[7 * j + i % 5] = b
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    ldf = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, rows + [(1000, None), (1001, ""), (None, "vile scum rot"), (1002, "vile, " * 2000)])
    model = toxicity.learn(docs, toxicity.train_fold(ldf))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, y in labels)
    text = rows[0][1].encode()
    assert {text[s["start"] : s["end"]] for s in got[0]["spans"]} == {b.encode() for b in bad}
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[None]["score"] > 0.5 and got[1002]["score"] > 0.5
    kept = toxicity.remove_toxic(docs, ldf)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, y in labels if not y} | {1000, 1001} and kept.columns == docs.columns
    none = toxicity.learn(docs, ldf.limit(0))
    assert all(r["score"] == pytest.approx(0.5) for r in toxicity.score(docs, none).collect()) and toxicity.score(empty(spark), none).count() == 0


def test_long_texts_teach_and_labels_settle(spark):
    rows, labels = [], []
    for i in range(120):
        w = long_words(2500, 5000 + i)  # no full stop: one sentence of 2,500 tokens, 16 KB and more
        if i % 3 == 0:
            w[100 + 7 * i] = "vile"
            w[101 + 7 * i] = "scum"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs = documents(spark, rows + [(0, "aaa"), (500, None)])
    ldf = spark.createDataFrame(labels + [(0, 0), (500, 1), (None, 1), (501, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, ldf)
    assert model.layer[1:].any()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, rows[1:] + [(900, "clean words only"), (901, "so vile scum")]), model).collect()}
    assert got[901] > 0.5 > got[900] and sum((got[i] >= 0.5) == bool(y) for i, y in labels[1:]) >= 115


def test_scores_equal_a_plain_model():
    rng = np.random.default_rng(2)
    texts = ["a b. c d", "b", "", "x y z! a", "b " * 30]
    model = toxicity.Model(rng.normal(size=(3, 1 << toxicity.BITS)), rng.normal(size=(2, 2)), np.array([0.1, 1.0, 0.5, -0.2]))
    t = toxicity.Tokens(*column_bytes(pa.array(texts)))
    got = toxicity.summary(t, toxicity.marginals(t, model), len(texts))
    for i, text in enumerate(texts):
        p = []
        for sentence in [s for s in re.split(r"(?<=[.!?])\s", text) if s.split()]:
            one = toxicity.Tokens(*column_bytes(pa.array([sentence])))
            e = sum(model.weight[f][one.slot[f]] for f in range(3))
            f = [np.array([1.0, np.exp(e[0])])]
            for x in e[1:]:
                f.append((f[-1] @ np.exp(model.step)) * np.array([1.0, np.exp(x)]))
            b = [np.ones(2)]
            for x in e[:0:-1]:
                b.append(np.exp(model.step) @ (np.array([1.0, np.exp(x)]) * b[-1]))
            for u, v in zip(f, b[::-1], strict=True):
                p.append((u * v)[1] / (u * v).sum())
        hot = sum(x for x in p if x >= 0.5)
        want = [1, max(p, default=0), math.log1p(hot), 20 * hot / max(len(p), 1)]
        assert np.allclose(got[i], want)


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    e, step = rng.normal(size=6), rng.normal(size=(2, 2))
    r, b = toxicity.forward_backward(e, np.arange(7), step)
    total, on = 0.0, np.zeros(6)
    for m in range(64):
        y = [(m >> i) & 1 for i in range(6)]
        w = math.exp(sum(e[i] * y[i] for i in range(6)) + sum(step[y[i], y[i + 1]] for i in range(5)))
        total += w
        on += w * np.array(y)
    assert np.allclose(1 / (1 + np.exp(-(r + b))), on / total)


def test_decontamination(spark):
    q = "Tom Baker bought 12 apples for 3 dollars each and then sold 12 apples again at 5 dollars."
    items = spark.createDataFrame([(1, q), (1, q), (2, None), (None, q), (3, "too short to count"), (4, "What is the capital of France"), (4, "the other text of item four"), (5, " ")], "item_id long, text string")
    other = " ".join(long_words(30, 4))
    rows = [
        (1, q), (2, f"{other} Ann Miller bought 40 apples for 7 dollars each and then sold 40 apples again at 9 dollars. {other}"), (3, other), (4, None), (5, ""), (None, q),
        (6, " ".join(q.split()[:8])), (7, "Ann Miller bought 1 apples for 1 dollars each and then sold 2 apples again at 3 dollars."),
        (8, f"{other} what is the capital of france? {other}"), (9, f"{other} what is the capital of Spain? {other}"), (10, "The OTHER text of item four"), (11, other), (11, q),
    ]
    docs = documents(spark, rows)
    got = {r["doc_id"]: (r["item_id"], r["start_word"], r["matched"], r["changed_slots"]) for r in decontaminate.contamination(spark, docs, items).collect()}
    assert got[8] == (4, 30, 6, 0) and got[10] == (4, 0, 6, 0) and got[11][0] == 1 and 9 not in got
    assert got[1] == (1, 0, 17, 0) and got[2][:2] == (1, 30) and got[2][3] > 0 and set(got) >= {1, 2} and not set(got) & {3, 4, 5, 6, None}
    assert got.get(7, (0, 0, 0))[2] < 17  # its values don't map one to one
    left = decontaminate.decontaminate(spark, docs, items)
    assert [(r["doc_id"]) for r in left.collect() if r["doc_id"] in (8, 9, 11)] in ([9, 11], [11, 9]) and other in [r["text"] for r in left.collect() if r["doc_id"] == 11]
    assert {r["doc_id"] for r in left.collect()} >= {3, 4, 5, 6, None} and left.columns == docs.columns
    assert decontaminate.contamination(spark, empty(spark), items).count() == 0 and decontaminate.contamination(spark, docs, items.limit(0)).count() == 0


def test_decontamination_without_the_filter(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HELD_WINDOWS", 0)
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    joined = {tuple(r) for r in decontaminate.contamination(spark, docs, items).collect()}
    monkeypatch.setattr(decontaminate, "HELD_WINDOWS", 1 << 30)
    assert joined == {tuple(r) for r in decontaminate.contamination(spark, docs, items).collect()} != set()


def plain_perplexity(texts, learn):
    from collections import Counter, defaultdict

    def sym(x):
        code = lambda c: 32 if c in (32, 9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c
        return [1] * 4 + [c + 2 for c in map(code, map(ord, x))]

    counts = {5: Counter(g for x in learn for g in zip(*(sym(x)[i:] for i in range(5)), strict=False))}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, ctx = {}, {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.0
        raw = (1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5)
        cut[n] = [min(max(v, 0.0), i + 1) for i, v in enumerate(raw)]
        ctx[n] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            ctx[n][g[:-1]][0] += v
            ctx[n][g[:-1]][1] += cut[n][min(v, 3) - 1]
    letters = len(counts[1]) + 1

    def p(g):
        low = 1 / letters if len(g) == 1 else p(g[1:])
        c, h = counts[len(g)].get(g, 0), ctx[len(g)].get(g[:-1])
        return low if h is None else max(0.0, c - (cut[len(g)][min(c, 3) - 1] if c else 0)) / h[0] + h[1] / h[0] * low

    return [math.exp(-sum(math.log(p(tuple(s[j - 4 : j + 1]))) for j in range(4, len(s))) / len(x)) for x in texts for s in [sym(x)]]


def test_quality_equals_a_plain_model(spark):
    import zlib

    rows = [(i, " ".join(long_words(8, i % 7))) for i in range(40)] + [(100, "Zürich 日本 \U0001f600"), (104, "a" + chr(0) + "日"), (101, "zzzz qqqq"), (102, None), (103, ""), (None, "w1")]
    docs = documents(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in range(0, 30)], "doc_id long")
    learn = [t for i, t in rows if i is not None and i < 30 and zlib.crc32(str(i).encode()) % 5]
    for sizes in ((10**6, 10**6), (0, 0)):
        got = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(spark, docs, trusted, *sizes).collect()}
        own = [(i, t) for i, t in rows if t]
        for (i, _), want in zip(own, plain_perplexity([t for _, t in own], learn), strict=True):
            assert got[i] == pytest.approx(want, rel=1e-9)
        assert got[102] is None and got[103] is None
    out = {r["doc_id"]: r["kept"] for r in quality.quality(spark, docs, trusted).collect()}
    assert out[0] and not out[101] and not out[102] and len(out) == len(rows)
    assert quality.quality(spark, empty(spark), trusted).count() == 0 and quality.quality(spark, docs, trusted.limit(0)).filter("kept").count() == 44


def test_decontamination_with_many_short_runs(spark):
    words = long_words(40, 71)
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    ninth = [f"other{i}" if i % 9 == 8 else w for i, w in enumerate(words)]
    got = [(r["doc_id"], r["matched"], r["item_words"]) for r in decontaminate.contamination(spark, documents(spark, [(1, " ".join(ninth)), (2, " ".join(long_words(60, 72)))]), items).collect()]
    assert got == [(1, 36, 40)]


def test_decontamination_over_inserted_and_removed_words(spark):
    words = long_words(60, 81)
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    pad = long_words(15, 82)
    rows = [
        (1, " ".join(pad + words[:30] + ["more"] + words[30:] + pad)), (2, " ".join(words[:30] + words[31:])), (3, " ".join(pad + words[:20] + ["one"] + words[20:40] + words[41:])),
        (4, " ".join(words[30:] + words[:30])),
    ]
    got = {r["doc_id"]: (r["start_word"], r["matched"]) for r in decontaminate.contamination(spark, documents(spark, rows), items).collect()}
    assert got == {1: (15, 60), 2: (0, 59), 3: (15, 59)}  # halves in swapped order are no copy


def test_names_of_any_length_are_one_slot(spark):
    tail = "went by train with 7 friends and paid 30 dollars for the whole trip in the end"
    items = spark.createDataFrame([(1, f"Last week Paris {tail}."), (2, "1 2 3 4 5 6 7 8 9 10")], "item_id long, text string")
    other = " ".join(long_words(20, 9))
    rows = [(1, f"{other} last week New York City {tail}"), (2, f"{other} Last week Ann, Bob {tail}"), (3, "9 9 9 9 9 9 9 9 9 9"), (4, f"{other} 1 2 3 4 5 6 7 8 9 10")]
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["matched"], r["item_words"]) for r in decontaminate.contamination(spark, documents(spark, rows), items).collect()}
    assert got[1, 1] == (20, 20, 20) and (3, 2) not in got and got[4, 2] == (20, 10, 10) and (2, 1) in got


def aligned(item, text):
    """Most tokens of ``item`` that agree with ``text`` on one shift."""
    return max((sum(a == b for a, b in zip(item, text[s:], strict=False)) for s in range(len(text))), default=0)


def test_random_copies_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    bank = {j: long_words(rng.randint(3, 40), 300 + j) for j in range(12)}
    rows = []
    for i in range(60):
        words = list(bank[rng.randrange(12)])
        for k in range(len(words)):
            if rng.random() < rng.choice([0, 0.05, 0.12]):
                words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(long_words(rng.randint(0, 30), 800 + i) + words + long_words(rng.randint(0, 30), 900 + i))))
    items = spark.createDataFrame([(j, " ".join(w)) for j, w in bank.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(spark, documents(spark, rows), items).collect()}
    want = {(i, j) for i, t in rows for j, w in bank.items() if aligned(w, t.split()) >= max(0.6 * len(w), min(len(w), 8))}
    assert got <= want and len(got) >= 0.97 * len(want)  # what is edited in every third or fourth word may be missed


def test_any_single_edit_of_an_item_is_found(spark):
    rows, want = [], set()
    bank = {n: long_words(n, 700 + n) for n in range(3, 41)}
    for n, w in bank.items():
        for k in range(n):
            for kind, words in (("change", [*w[:k], "other", *w[k + 1 :]]), ("leave out", w[:k] + w[k + 1 :]), ("put in", [*w[:k], "other", *w[k:]])):
                i = len(rows)
                rows.append((i, " ".join(long_words(9, 5000 + i) + words + long_words(9, 9000 + i))))
                best = n - (kind != "put in")  # over both sides of the edit
                if kind == "put in" and k == 0:
                    best = n
                one_way = aligned(w, rows[-1][1].split())
                if one_way >= max(0.6 * n, min(n, 8)) or n >= 14 and best >= max(0.6 * n, 8):
                    want.add((i, n))
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in bank.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(spark, documents(spark, rows), items).collect()}
    assert want <= got and all(len(bank[j]) >= 8 or (i, j) in want for i, j in got)


def test_short_items_with_other_numbers(spark):
    items = spark.createDataFrame([(1, "What is 12 times 7"), (2, "12 and 7"), (3, "Is 12 more than 12 here")], "item_id long, text string")
    other = " ".join(long_words(12, 77))
    rows = [(1, f"{other}. What is 13 times 9? {other}"), (2, f"{other} 13 and 9"), (3, f"{other} is 4 more than 5 here"), (4, f"{other} is 4 more than 4 here"), (5, f"{other} what is 13 plus 9"), (6, "12 and 7")]
    got = {(r["doc_id"], r["item_id"], r["changed_slots"]) for r in decontaminate.contamination(spark, documents(spark, rows), items).collect()}
    assert got == {(1, 1, 2), (4, 3, 2), (6, 2, 0)}


def test_a_phrase_repeated_very_often_takes_bounded_memory(spark):
    phrase, rest = long_words(10, 41), long_words(10, 42)
    items = spark.createDataFrame([(1, " ".join(phrase + rest))], "item_id long, text string")
    rows = [(1, " ".join(phrase * 20_000)), (2, " ".join(phrase * 300 + rest))]
    got = {r["doc_id"]: r["matched"] for r in decontaminate.contamination(spark, documents(spark, rows), items).collect()}
    assert got == {2: 20}


def test_the_path_equals_its_definition():
    rng = np.random.default_rng(6)
    for _ in range(60):
        size, shifts = int(rng.integers(1, 14)), np.unique(rng.integers(-6, 12, int(rng.integers(1, 7))))
        same = rng.random((len(shifts), size)) < 0.5
        best = {}

        def most(k, j, same=same, shifts=shifts, best=best):
            """Tokens won by the best way that ends with token j on shift k."""
            if j < 0:
                return 0
            if (k, j) not in best:
                ways = [most(k, j - 1)]
                for x in range(len(shifts)):
                    if x != k:
                        before = j - max(0, int(shifts[x] - shifts[k])) - 1
                        ways.append((most(x, before) if before >= 0 else 0) - decontaminate.SWITCH)
                best[k, j] = max(ways) + int(same[k, j])
            return best[k, j]

        path = decontaminate._path(same, shifts)
        on = np.flatnonzero(path >= 0)
        won = int(same[path[on], on].sum()) - decontaminate.SWITCH * int((np.diff(path[on]) != 0).sum())
        assert won == max(most(k, size - 1) for k in range(len(shifts)))
        assert (np.diff(on + shifts[path[on]]) > 0).all()


def test_long_sentences_equal_a_plain_chain():
    rng = np.random.default_rng(8)
    sizes = (0, 1, 2, toxicity.PIECE - 1, toxicity.PIECE, toxicity.PIECE + 1, 5 * toxicity.PIECE, 1000, 3)
    texts = [" ".join(f"w{rng.integers(0, 300)}" + ("." if n < 9 and rng.random() < 0.3 else "") for _ in range(n)) for n in sizes]
    t = toxicity.Tokens(*column_bytes(pa.array(texts, pa.large_string())))
    weight, step = 2 * rng.standard_normal((toxicity.FEATURES, 1 << toxicity.BITS)), np.array([[1.5, -1.0], [-0.7, 1.2]])
    e = t.emissions(weight)
    r, back = (v[t.at] for v in toxicity.forward_backward(e, t.base, step, t.links))
    e = e[t.at]
    (a, b), (c, d) = np.exp(step)
    starts = np.append(np.setdiff1d(np.arange(len(t.h)), t.behind), len(t.h))
    assert np.diff(starts).max() == 1000
    for x, y in zip(starts[:-1], starts[1:], strict=True):
        p, q = e[x:y].copy(), np.zeros(y - x)
        for i in range(1, y - x):
            o = np.exp(p[i - 1])
            p[i] += np.log((b + d * o) / (a + c * o))
        for i in range(y - x - 2, -1, -1):
            o = np.exp(e[x + i + 1] + q[i + 1])
            q[i] = np.log((c + d * o) / (a + b * o))
        assert np.allclose(p, r[x:y], atol=1e-9) and np.allclose(q, back[x:y], atol=1e-9)


def test_the_fit_does_not_hang_on_the_longest_sentence():
    import time

    words, took = [f"w{i % 3001}" for i in range(20_000)], []
    for stop in (".", ""):
        texts = [" ".join(w + (stop if i % 12 == 11 else "") for i, w in enumerate(words)), *(f"short text here. toxic word{i}" for i in range(40))]
        began = time.perf_counter()
        toxicity.fit_chain(texts, np.array([1, *(i % 2 for i in range(40))]))
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1
