import re

import numpy as np
import pytest

from tamarack.llm import neardup, substring
from tamarack.llm.common import connected_components

from .helpers import documents, empty, long_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(rows, size):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(fold))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def brute(rows, size):
    s = sets(rows, size)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def family(first, n, seed):
    """Copies of one text with growing edits: many pairs on either side of 0.8, linked by chains only."""
    base = long_words(60, seed)
    return [(first + j, " ".join(base[:j] + [f"x{seed}{j}{k}" for k in range(j % 4)] + base[j + j % 4 :])) for j in range(n)]


def test_components_equal_brute_force(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "two one"), (9, "É one"), (10, "é one")]
    rows += family(100, 14, 1) + family(200, 5, 2) + [(300 + i, " ".join(long_words(30, 50 + i))) for i in range(6)] + [(400, " ".join(long_words(3000, 9)))]
    for size in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(spark, documents(spark, rows), size).collect()}
        assert got == brute(rows, size)


def test_block_step_alone_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = family(0, 40, 3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark, documents(spark, rows), 2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c"), (None, None), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)]
    out = neardup.components(spark, documents(spark, rows), 2)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out.collect()) == sorted([("None", "None", True)] * 2 + [("1", "1", True)] * 2 + [("2", "1", False), ("3", "3", True)])
    assert neardup.components(spark, empty(spark)).count() == 0
    kept = neardup.near_dedup(spark, documents(spark, rows), 2)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None", "None"] and kept.columns == empty(spark).columns


def test_links_of_rows_that_share_an_id(spark):
    a, b = long_words(40, 21), long_words(40, 22)
    near = b[:20] + ["other"] + b[21:]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near)), (4, " ".join(a[:39])), (3, " ".join(long_words(40, 23))), (3, None), (3, "")]
    out = neardup.components(spark, documents(spark, rows), 2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == [(1, 39, 1), (1, 39, 1), (2, 39, 1), (3, 0, 3), (3, 0, 3), (3, 39, 3), (4, 38, 1)]
    kept = neardup.near_dedup(spark, documents(spark, rows), 2).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted([(1, rows[0][1]), (1, rows[1][1]), (3, rows[4][1]), (3, ""), (3, "")])
    clash = [(1, "a b c"), (1, "a b c"), (5, "A b  c"), (5, "x y z")]
    assert sorted((r["doc_id"], r["text"]) for r in neardup.near_dedup(spark, documents(spark, clash), 2).collect()) == [(1, "a b c"), (5, "x y z")]


def test_random_repeated_ids_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.randint(0, 30), t) for _, t in family(0, 20, 5) + family(0, 20, 6) + family(0, 8, 7)]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [(i, sets([(0, t)], 2)[0]) for i, t in rows]
    for i, x in own:
        for j, y in own:
            if 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    got = {(r["doc_id"], r["component_id"]) for r in neardup.components(spark, documents(spark, rows), 2).collect()}
    assert got == {(i, find(i)) for i, _ in rows}


def test_connected_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (5, 4)], "a long, b long")
    assert {r["node"]: r["label"] for r in connected_components(spark, e).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}


def test_compact_windows_equal_definition():
    import numpy as np

    from tamarack.llm.words import mix

    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    off = np.array([0, 120, 160, 300])
    doc, c, l, r, key = substring.compact_windows(x, off, 1)
    got = set(zip(doc.tolist(), c.tolist(), l.tolist(), r.tolist(), strict=True))
    want = set()
    y = mix(x ^ substring._SEED[1])
    for d in range(3):
        v = y[off[d] : off[d + 1]].tolist()

        def tree(a, b, d=d, v=v):
            if b - a + 1 < substring.WIDE:
                return
            m = min(range(a, b + 1), key=lambda i: v[i])
            want.add((d, m, a, b))
            tree(a, m - 1)
            tree(m + 1, b)

        tree(0, len(v) - 1)
    assert got == want


def test_passages(spark):
    shared, other = long_words(70, 1), long_words(200, 2)
    edited = shared[:30] + ["changed"] + shared[31:]
    rows = [
        (1, " ".join(other[:80] + shared)), (2, " ".join(long_words(20, 3) + [w.upper() for w in shared] + long_words(20, 4))), (3, " ".join(shared[:49])), (4, " ".join(shared[:50])),
        (5, " ".join(long_words(9, 5) + edited)), (6, None), (7, ""), (None, " ".join(shared)), (8, " ".join(long_words(300, 6))), (9, " ".join(long_words(40, 7) * 3)),
    ]
    got = {r["doc_id"]: (r["start_word"], r["end_word"], r["first_doc_id"]) for r in substring.repeated_passages(spark, documents(spark, rows)).collect()}
    assert got == {2: (20, 90, 1), 4: (0, 50, 1), 5: (9, 79, 1)}
    out = substring.substring_dedup(spark, documents(spark, rows))
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == empty(spark).columns and 4 not in texts
    left = " ".join(long_words(20, 3) + long_words(20, 4))
    assert texts[2] == (left, len(left)) and texts[1][0] == rows[0][1] and texts[5][0].split() == long_words(9, 5) and texts[6] == (None, None) and texts[8][0] == rows[8][1]
    assert substring.repeated_passages(spark, empty(spark)).count() == 0 and substring.substring_dedup(spark, empty(spark)).count() == 0


def test_passages_at_other_distances_and_in_other_order(spark):
    rows, want = [], {}
    for j in range(12):
        a, b = 10 * j + 1, 10 * j + 2
        one, two = long_words(70, 400 + j), long_words(70, 450 + j)
        rows.append((a, " ".join(long_words(20, 500 + j) + one + long_words(15 + 3 * j, 600 + j) + two)))
        first, second = (two, one) if j % 2 else (one, two)
        gap = long_words(60 - 4 * j, 700 + j)
        rows.append((b, " ".join(first + gap + second + long_words(9, 800 + j))))
        want[b] = {(0, 70, a), (70 + len(gap), 140 + len(gap), a)}
    got = {}
    for r in substring.repeated_passages(spark, documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["start_word"], r["end_word"], r["first_doc_id"]))
    assert got == want


def covered(rows):
    """Words of each document that lie in 50 words which a document with a smaller id holds too."""
    grams = {i: ["\x00".join(w[k : k + 50]) for k in range(len(w) - 49)] for i, w in ((i, t.split()) for i, t in rows)}
    first = {}
    for i in sorted(grams):
        for g in grams[i]:
            first.setdefault(g, i)
    return {(i, k + j) for i, gs in grams.items() for k, g in enumerate(gs) if first[g] < i for j in range(50)}


def test_exact_passages_equal_brute_force_past_the_pivot_and_in_every_copy(spark):
    rows = []
    for j in range(12):
        line, tail = long_words(30, 900 + j), long_words(25, 930 + j)
        passage, other = line + tail, long_words(55, 960 + j)
        near = lambda n, k, j=j: long_words(n, 2000 + 40 * j + k)
        a = 10 * j
        rows.append((a + 1, " ".join(near(30, 1) + line + near(30, 2))))  # the pivot of the line only
        rows.append((a + 2, " ".join(near(30, 3) + passage + near(30, 4))))
        rows.append((a + 3, " ".join(near(20, 5) + passage + near(70, 6) + passage + near(10, 7))))  # two copies of an earlier passage
        rows.append((a + 4, " ".join(near(60, 8) + line + near(60, 9) + line + other)))
        rows.append((a + 5, " ".join(near(60, 10) + line + near(50, 11) + line + other + near(5, 12))))  # its centre may lie in a line that comes earlier
    got = {(r["doc_id"], w) for r in substring.repeated_passages(spark, documents(spark, rows)).collect() for w in range(r["start_word"], r["end_word"])}
    assert got == covered(rows)


def test_every_edited_copy_of_a_passage_goes(spark):
    rows, want = [], {}
    for j in range(8):
        shared = long_words(70, 3000 + j)
        edited = shared[:35] + ["changed"] + shared[36:]
        rows.append((2 * j, " ".join(long_words(40, 3100 + j) + shared)))
        rows.append((2 * j + 1, " ".join(edited + long_words(90, 3200 + j) + edited)))
        want[2 * j + 1] = {(0, 70), (160, 230)}
    got = {}
    for r in substring.repeated_passages(spark, documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["start_word"], r["end_word"]))
    assert got == want


def test_passages_of_rows_that_share_an_id(spark):
    shared, own = long_words(70, 5000), long_words(130, 5001)
    rows = [(1, " ".join(shared)), (2, " ".join(own[:60] + shared)), (2, "short text"), (2, "short text"), (3, " ".join(own[60:] + shared)), (3, " ".join(shared[:60])), (None, " ".join(shared))]
    found = substring.repeated_passages(spark, documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["first_doc_id"]) for r in found) == [(2, 70, 1), (3, 60, 1), (3, 70, 1)]
    out = substring.substring_dedup(spark, documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("1", rows[0][1]), ("2", " ".join(own[:60]) + " "), ("2", "short text"), ("2", "short text"), ("3", " ".join(own[60:]) + " "), ("None", rows[0][1])])


def test_random_exact_passages_equal_brute_force(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        pool = [long_words(rng.choice([12, 24, 30, 45, 55, 90]), 7000 + 100 * seed + j) for j in range(14)]
        rows = []
        for i in range(60):
            words = []
            for k in range(rng.randint(1, 7)):
                words += rng.choice(pool) if rng.random() < 0.6 else long_words(rng.randint(1, 40), 90000 + 1000 * seed + 10 * i + k)
            rows.append((i, " ".join(words)))
        found = substring.repeated_passages(spark, documents(spark, rows)).collect()
        got = {(r["doc_id"], w) for r in found for w in range(r["start_word"], r["end_word"])}
        want = covered(rows)
        assert want <= got
        # the others lie in edited passages, which hold a few words of their own
        assert {(r["doc_id"], w) for r in found if r["exact"] for w in range(r["start_word"], r["end_word"])} <= want


def test_a_passage_behind_65535_words(spark):
    tail = long_words(60, 8001)
    rows = [(1, " ".join(tail)), (2, " ".join(long_words(70_000, 8002) + tail + long_words(5, 8003)))]
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in substring.repeated_passages(spark, documents(spark, rows)).collect()] == [(2, 70_000, 70_060)]


def exact_words(docs, least=50):
    """Words of each document that lie in a run of 50 words which a smaller document holds."""
    seen, out = set(), {}
    for i, words in sorted(docs.items()):
        own = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        out[i] = {k + j for k, run in enumerate(own) if run in seen for j in range(least)}
        seen.update(own)
    return out


def found_words(rows, exact=None):
    out = {}
    for r in rows:
        if exact is None or r["exact"] == exact:
            out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_pieces_in_other_order_are_no_passage(spark):
    w = long_words(100, 7)
    other = [long_words(20, 50 + i) for i in range(4)]
    one = sum((other[i] + w[s : s + 30] for i, s in enumerate((70, 46, 23, 0))), [])
    df = documents(spark, [(1, " ".join(one)), (2, " ".join(long_words(50, 91) + w + long_words(50, 92)))])
    assert substring.repeated_passages(spark, df).count() == 0
    assert {r["doc_id"]: len(r["text"].split()) for r in substring.substring_dedup(spark, df).collect()} == {1: 200, 2: 200}


def test_an_edit_at_every_place_of_a_short_passage_is_found(spark):
    rows = []
    for place in range(50):
        w = long_words(50, 1000 + place)
        edited = w[:place] + ["edited"] + w[place + 1 :]
        rows += [(2 * place, " ".join(long_words(30, 2000 + place) + w + long_words(30, 3000 + place))), (2 * place + 1, " ".join(long_words(40, 4000 + place) + edited + long_words(20, 5000 + place)))]
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark, documents(spark, rows)).collect()}
    assert sorted(got) == [2 * p + 1 for p in range(50)]  # 49 of 50 words stay in order, wherever the edit lies
    for r in got.values():  # nothing outside of the passage, at most an edited end is left
        assert 40 <= r["start_word"] <= 45 and 85 <= r["end_word"] <= 90 and not r["exact"]


def test_edited_passages_that_only_later_documents_share(spark):
    """Every key of the shared passage lies in a smaller document that holds no more than a part of it."""
    rows, want = [], set()
    for j in range(12):
        w = lambda n, k: long_words(n, 70_000 + 100 * j + k)  # noqa: B023, E731
        left, right, base = w(22 + j, 1), w(44 - j, 2), 20 * j
        rows.append((base + 1, " ".join(w(40, 3) + left + w(40, 4))))
        rows.append((base + 2, " ".join(w(40, 5) + right + w(40, 6))))
        for i in range(3, 7):  # another word between the parts in each
            rows.append((base + i, " ".join(w(10 * i, 10 + i) + left + [f"edit{i}"] + right + w(30, 20 + i))))
            if i > 3:
                want.add((base + i, 10 * i, 10 * i + len(left) + 1 + len(right), base + 3))
    found = {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in substring.repeated_passages(spark, documents(spark, rows)).collect()}
    assert found == want


def test_an_edited_passage_of_a_document_that_an_earlier_one_covers(spark):
    """2 is near enough to 1, 3 is near enough to 2 only."""
    w = long_words(57, 81_000)
    edited = lambda *at: [f"e{i}" if i in at else x for i, x in enumerate(w)]
    texts = [edited(), edited(18), edited(18, 38), edited(18, 38, 8)]
    rows = [(i + 1, " ".join(long_words(30, 81_100 + i) + t + long_words(30, 81_200 + i))) for i, t in enumerate(texts)]
    found = {(r["doc_id"], r["first_doc_id"]) for r in substring.repeated_passages(spark, documents(spark, rows)).collect()}
    assert found == {(2, 1), (3, 2), (4, 3)}


def test_an_edited_passage_goes_beyond_what_an_earlier_document_covers(spark):
    """2 and 3 share 50 words with 1 and 46 more, which hold no unbroken run of 24 words."""
    w = lambda n, k: long_words(n, 83_000 + k)
    head, one, two = w(50, 1), w(22, 2), w(22, 3)
    texts = [w(40, 4) + head + w(40, 5)] + [w(30, 6 + 3 * i) + head + [f"a{i}"] + one + [f"b{i}"] + two + w(30, 7 + 3 * i) for i in range(2)]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    found = {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in substring.repeated_passages(spark, documents(spark, rows)).collect()}
    assert found == {(2, 30, 80, 1), (3, 30, 126, 1)}


def test_a_family_of_edited_copies_is_compared_in_one_step(spark, monkeypatch):
    """Each document is near enough to the one before it only."""
    w, places = long_words(57, 85_000), (18, 38, 8, 28, 48)
    texts = [[f"e{i}" if i in places[:n] else x for i, x in enumerate(w)] for n in range(len(places) + 1)]
    rows = [(i + 1, " ".join(long_words(30, 85_100 + i) + t + long_words(30, 85_200 + i))) for i, t in enumerate(texts)]
    steps, checked = [], substring._checked
    monkeypatch.setattr(substring, "_checked", lambda *a, **k: steps.append(1) or checked(*a, **k))
    found = {(r["doc_id"], r["first_doc_id"]) for r in substring.repeated_passages(spark, documents(spark, rows)).collect()}
    assert found == {(i + 1, i) for i in range(1, 6)} and len(steps) == 1


@pytest.mark.parametrize("words", [100_000, 3])
def test_stretches_that_are_left_out_hold_nothing_more(words):
    """Families of edited copies, of different words and of a few words: the comparisons that are made find what all pairs have."""
    rng = np.random.default_rng(words)
    for _ in range(6):
        base, texts = rng.integers(0, words, 160).tolist(), []
        for _ in range(24):
            t = base[: rng.integers(60, 161)]
            for _ in range(rng.integers(0, 12)):
                at = rng.integers(0, len(t))
                t[at : at + rng.integers(0, 3)] = rng.integers(0, words + 50, rng.integers(0, 4)).tolist()
            texts.append(t[rng.integers(0, 40) :])
        cuts = [np.array([hash(tuple(t[i : i + 5])) & 0xFFFFFFFF for i in range(len(t) - 4)], np.uint32) for t in texts]
        node = np.arange(len(cuts))
        keep = [j for j in node if len(cuts[j]) >= substring.RUN]
        node, cuts = node[: len(keep)], [cuts[j] for j in keep]
        want, got = ([np.zeros(len(c), bool) for c in cuts] for _ in range(2))
        for j in node:
            for i in node[:j]:
                for s, e, _ in substring.spans(cuts[i], cuts[j])[0]:
                    want[j][s : e + 1] = True
        for j, _, found in substring._among(node, cuts, [np.ones(len(c), bool) for c in cuts]):
            for s, e, _ in found:
                got[j][s : e + 1] = True
        assert all((a == b).all() for a, b in zip(want, got, strict=True))


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_texts_of_shuffled_pieces_equal_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    pieces = [long_words(rng.randint(8, 90), 100 * seed + i) for i in range(14)]
    docs = {}
    for i in range(40):
        words = []
        for _ in range(rng.randint(1, 7)):
            piece = list(rng.choice(pieces))
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = f"e{rng.random()}"
            if rng.random() < 0.15:
                del piece[rng.randrange(len(piece))]
            words += piece + (long_words(rng.randint(1, 30), rng.randrange(10**6)) if rng.random() < 0.5 else [])
        docs[i] = words
    rows = substring.repeated_passages(spark, documents(spark, [(i, " ".join(w)) for i, w in docs.items()])).collect()
    want, got = exact_words(docs), found_words(rows)
    for i in docs:
        assert want[i] <= got.get(i, set())  # every word of a run that an earlier document holds
        if not want[i] and i not in {r["doc_id"] for r in rows if not r["exact"]}:
            assert i not in got
    shingles_of = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for r in rows:
        own = docs[r["doc_id"]][r["start_word"] : r["end_word"]]
        if r["exact"]:
            assert set(range(r["start_word"], r["end_word"])) <= want[r["doc_id"]]
        else:  # four fifths of what is cut are shingles of earlier documents
            earlier = set().union(*(shingles_of(docs[k]) for k in docs if k < r["doc_id"]))
            assert len(shingles_of(own) & earlier) >= 0.8 * len(shingles_of(own)) and len(own) >= 45


def test_many_texts_of_one_id_join_once_each(spark):
    rows = [(7, f"common words of text {i} " + " ".join(long_words(12, i // 2))) for i in range(3000)]
    out = neardup.components(spark, documents(spark, rows), size=2, percent=80)
    assert {tuple(r) for r in out.select("doc_id", "component_id", "kept").distinct().collect()} == {(7, 7, True)} and out.count() == 3000
