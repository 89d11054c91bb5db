"""Divergence audit, whitening and vector near-duplicates against plain versions and on awkward inputs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tamarack.llm import divergence, vectordup, whitening
from tests.llm.helpers import empty

DOCS = "doc_id long, text string, lang string, source string, n int, v string, term string, total int, document string, part string, rank int, item string"
VECTORS = "vec_id long, embedding array<float>, label int, node int, v string, x string, key int, u int, dim int, n int, row int, d1 int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "v", "t", 2, "d", "p", 3, "i") for i, t, lang, s in rows], DOCS)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 1, "v", "x", 1, 1, 1, 1, 1, 1) for i, v in rows], VECTORS)


def audit_plainly(rows, least, top=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((lang or ""), (s or ""), [w.translate(fold) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, lang, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        frequency = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, c in frequency.items() if c >= least}
        counts = defaultdict(Counter)
        for _, s, words in mine:
            counts[s].update(w for w in words if w in kept)
        everywhere = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(everywhere)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def word(i):
    return "".join("abcdefghijklmnopqrstuvwxyz"[i // 26**k % 26] for k in range(3))


@pytest.mark.parametrize("block", [128, 2])
def test_audit_equals_plain_version(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for i in range(160):
        words = [word(int(w)) for w in rng.zipf(1.4, int(rng.integers(0, 60))) % 200]
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + (" Été É7é_ß" if i % 3 == 0 else "")
        rows.append((i % 140, text, [None, "", "en", "de"][int(rng.integers(0, 4))], ["a", "b", "c", "d", None, "É"][int(rng.integers(0, 6))]))
    rows += [(1, None, "en", "only"), (2, "", "xx", "a"), (3, "123 --", "xx", "b"), (None, "lone words", "yy", None), (5, word(3) * 5000, "en", "a")]
    got = divergence.audit(spark, docs_of(spark, rows), least=5, block=block)
    assert {tuple(r) for r in got.collect()} == audit_plainly(rows, 5)


def test_audit_streams_runs_over_small_batches_and_takes_long_texts(spark):
    rows = [(i, " ".join([word(j % 300) for j in range(i, i + 40)]), "en", f"s{i % 7}") for i in range(300)] + [(999, "long " * 400_000, "en", "s1")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r) for r in divergence.audit(spark, docs_of(spark, rows), least=10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == audit_plainly(rows, 10)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark, empty(spark)).count() == 0


def test_shares_are_exact_for_large_counts():
    total = np.array([2**48 - 1, 12345678901234, 7])
    count = np.array([2**48 - 4, 9999999999999, 3])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(count, total, strict=True)]


def whitened_plainly(rows, wanted=4):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dim in {len(v) for _, v in good}:
        mine = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in good if len(v) == dim]
        x = np.array([v for _, v in mine], np.int64)
        fit = np.unique(x, axis=0)
        n, s = len(fit), fit.sum(axis=0)
        c = fit - s / n
        v = c.T @ c / n
        e, q = np.linalg.eigh(v)
        e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
        for k in range(min(wanted, dim)):
            if e[k] > 1e-9:
                for (i, _), a in zip(mine, x, strict=True):
                    out.append((i, k + 1, n, int(((n * a - s) ** 2).sum()), float((a - s / n) @ q[:, k] / math.sqrt(e[k])), e[k] / v.trace()))
    return out


def key_of(r):
    return (r[0] is None, r[0] or 0, r[1], r[2], r[3], round(abs(r[4]), 6))


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 40)) * np.linspace(3, 0.2, 40) + 1
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += rows[:50] + [(None, rows[3][1]), (7, rows[9][1]), (900, None), (901, []), (902, [1.0, None] * 20), (903, [float("nan")] * 40), (904, [float("inf")] + [0.0] * 39), (905, [-0.0] * 40)]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((9, 3)))]  # another length
    got = sorted((tuple(r) for r in whitening.whiten(spark, vectors_of(spark, rows)).collect()), key=key_of)
    want = sorted(whitened_plainly(rows), key=key_of)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r[4]) for r in got], [abs(r[4]) for r in want], atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert max(r[6] for r in got) < 1e-9


def test_whitening_of_vectors_that_do_not_vary(spark):
    assert whitening.whiten(spark, vectors_of(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert whitening.whiten(spark, vectors_of(spark, [])).count() == 0
    flat = whitening.whiten(spark, vectors_of(spark, [(i, [i, 2 * i, 0]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 9
    huge = whitening.whiten(spark, vectors_of(spark, [(1, [3e38, 1]), (2, [-3e38, 2]), (3, [0, 0])])).collect()
    assert all(math.isfinite(r["whitened"]) for r in huge) and {r["deviation"] for r in huge} == {None, 768**2}


def test_range_finder_stops_early_and_expands():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((100, 100)))[0]
    for e, early in ((4.0 ** -np.arange(100), True), (1 + np.arange(100)[::-1] / 100, False)):
        v = (q * e) @ q.T
        got, c, tried = whitening.range_finder(lambda x, v=v: v if x is None else v @ x, 100, 4)
        assert np.allclose(got, e[:4], rtol=1e-12)
        assert np.allclose(np.abs((c * q[:, :4]).sum(axis=0)), 1, atol=1e-12)
        assert (tried[-1] < 100) == early


def test_exact_deviation_wraps_and_tells_what_does_not_fit():
    x = np.array([[2**40, -3], [5, 7]], np.int64)
    value, fits = whitening.deviations(x, 3, [2**40 + 5, 4])
    assert not fits[0] and not fits[1]
    value, fits = whitening.deviations(np.array([[10, -3], [5, 7]], np.int64), 3, [15, 4])
    assert value.tolist() == [(30 - 15) ** 2 + 13**2, 0 + 17**2] and fits.all()


def linked_plainly(rows, least=0.9):
    good = {k: np.array(v, np.float32).astype(np.float64) for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    unit = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, v in good.items()}
    near = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= least] for k in unit}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            fresh = [j for j in near.get(todo.pop(), ()) if j not in seen]
            seen.update(fresh)
            todo += fresh
        low = None if i is None else min(rows[j][0] for j in seen)
        out.append((i, len(near.get(k, ())), low, i is None or i == low))
    return out


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "BLOCK", 40)
    monkeypatch.setattr(vectordup, "MEMBERS", 16)
    rng = np.random.default_rng(11)
    rows = []
    for dim, n in ((24, 300), (8, 60)):
        base = rng.standard_normal((n, dim))
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(base)]
        for noise, copies in ((0.02, 120), (0.3, 60), (0.45, 60), (0.6, 40)):  # balls, groups that are no balls, pairs near the least cosine
            v = base[int(rng.integers(0, n))]
            more = v + noise * rng.standard_normal((copies, dim)) * np.linalg.norm(v) / math.sqrt(dim)
            rows += [(len(rows) + i, (w * rng.uniform(0.1, 9)).tolist()) for i, w in enumerate(more)]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), v) for i, v in rows]
    rows += [(9000 + i, rows[5][1]) for i in range(70)] + [(3, rows[5][1]), (3, rows[200][1]), (None, rows[5][1]), (9999, None), (9998, []), (9997, [0.0] * 24), (9996, [None] * 24), (9995, [float("nan")] * 24)]
    rows += [(9990, [1e38] * 24), (9991, [3e38] * 24), (9992, [1e-40] * 24)]
    got = vectordup.near_vectors(spark, vectors_of(spark, rows)).collect()
    norm = lambda r: tuple(-1 if c is None else c for c in r)
    assert sorted(norm(r) for r in got) == sorted(norm(r) for r in linked_plainly(rows))


def test_near_vectors_of_an_empty_table(spark):
    assert vectordup.near_vectors(spark, vectors_of(spark, [])).count() == 0
    only = vectordup.near_vectors(spark, vectors_of(spark, [(None, [1.0]), (4, None)])).collect()
    assert sorted(map(tuple, only), key=str) == sorted([(None, 0, None, True), (4, 0, 4, True)], key=str)


def test_plan_meets_its_miss_probability():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(axis=1)[:, None] * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1)[:, None]
    k, tables = vectordup.plan(50_000)
    met = (vectordup.keys_of(a, k, tables) == vectordup.keys_of(b, k, tables)).any(axis=1)
    assert met.mean() > 0.999
