"""Commits, merge on read, transactions and compaction against a sequential model."""

import itertools
import json
import random
import threading

import pytest

from tamarack.operators import handlers, journal, mutations
from tamarack.operators.overlay import Overlay
from tamarack.sources import declarations as d
from tamarack.sources.catalog import Catalog
from tamarack.sources.commits import CommitLog, Folder

DECL = d.load("entities: {tag: /api/tags, code: /api/codes}")


def engine(spark, path, tags=(("1", "b"), ("2", "c"), ("3", None)), ids=None, clock=None):
    tag = spark.createDataFrame([(i, n, None, None) for i, n in tags], "id string, name string, note string, _metadata string")
    code = spark.createDataFrame([(5, "five"), (7, "seven")], "id long, name string")
    ticks = itertools.count(0, 10_000)
    return handlers.Engine(Catalog(spark, {"tag": tag, "code": code}), DECL, [], handlers.Registry(), str(path), new_id=ids or handlers.Engine.__dataclass_fields__["new_id"].default, now=clock or (lambda: "2026-01-01T00:00:00.000Z"), clock_ms=lambda: next(ticks))


def names(df):
    return {r["id"]: r["name"] for r in df.collect()}


def test_reads_see_writes(spark, tmp_path):
    e = engine(spark, tmp_path / "j")
    made = e.run("POST", "/api/tags", {"name": "new"}).first()["id"]
    assert e.run("GET", f"/api/tags/{made}").first()["name"] == "new"
    assert e.run("PATCH", f"/api/tags/{made}", {"name": "newer"}).first()["name"] == "newer"  # a row made a moment ago
    before = e.run("GET", "/api/tags/1")
    assert e.run("PATCH", "/api/tags/1", {"name": "changed"}).first()["name"] == "changed"
    assert e.run("GET", "/api/tags/1").first()["name"] == "changed"
    assert before.first()["name"] == "b"  # an answer stays that of its version
    gone = e.run("DELETE", "/api/tags/1")
    assert gone.first()["name"] == "changed" and e.run("GET", "/api/tags/1").first() is None
    assert names(e.run("GET", "/api/tags")) == {"2": "c", "3": None, made: "newer"}
    assert e.run("PATCH", "/api/tags/none", {"name": "x"}).count() == 0
    assert names(engine(spark, tmp_path / "j").run("GET", "/api/tags")) == {"2": "c", "3": None, made: "newer"}  # another engine on the same journal


def test_ids_of_numbers(spark, tmp_path):
    e = engine(spark, tmp_path / "j")
    e.run("PATCH", "/api/codes/05", {"name": "v"})
    assert e.run("GET", "/api/codes/5").first()["name"] == "v" and e.run("GET", "/api/codes/abc").first() is None
    e.run("POST", "/api/codes", {"id": "9", "name": "nine"})
    assert names(e.run("GET", "/api/codes")) == {5: "v", 7: "seven", 9: "nine"}
    with pytest.raises(mutations.MutationError):
        e.run("POST", "/api/codes", {"name": "an id is drawn that isn't a number"})


def test_a_refused_insert_leaves_nothing(spark, tmp_path):
    e = engine(spark, tmp_path / "j")
    for indexed in (False, True):
        if indexed:
            e.overlay.index("tag")
        with pytest.raises(mutations.MutationError):
            e.run("POST", "/api/tags", {"id": "1", "name": "again"})
        assert e.overlay.log.last() == 0 and e.run("GET", "/api/tags/1").first()["name"] == "b" and all(x[0] != "local-write" for x in e.events)
    e.run("POST", "/api/tags", {"id": "x", "name": "own"})
    with pytest.raises(mutations.MutationError):
        e.run("POST", "/api/tags", {"id": "x", "name": "twice"})
    e.run("DELETE", "/api/tags/1")
    assert e.run("POST", "/api/tags", {"id": "1", "name": "back"}).first()["name"] == "back"
    assert names(e.run("GET", "/api/tags")) == {"1": "back", "2": "c", "3": None, "x": "own"}
    e.compact()
    with pytest.raises(mutations.MutationError):
        e.run("POST", "/api/tags", {"id": "x", "name": "after a snapshot"})


def test_one_millisecond_keeps_its_order(spark, tmp_path):
    ids = iter(["z9", "a1", "m5"])
    e = engine(spark, tmp_path / "j", ids=lambda: next(ids))
    for name in ("first", "second", "third"):
        e.run("PATCH", "/api/tags/2", {"name": name})
    assert e.run("GET", "/api/tags/2").first()["name"] == "third"


def test_two_writers_take_numbers_in_turn(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "j"))
    row = lambda w, i: journal.entry(f"{w}-{i}", "PATCH", f"/{w}", None, "same", "tag", w, [("update", {"name": str(i)})])
    took = {w: [] for w in "ab"}

    def write(w):
        own = CommitLog(spark, str(tmp_path / "j"))
        for i in range(12):
            took[w].append(own.append(lambda n, i=i: journal.commit_bytes([row(w, i)], n)))

    threads = [threading.Thread(target=write, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(took["a"] + took["b"]) == list(range(1, 25)) and took["a"] == sorted(took["a"])
    rows = journal.committed(spark, log).orderBy("seq").collect()
    assert [r["id"] for r in rows if r["row_id"] == "a"] == [f"a-{i}" for i in range(12)]


def test_the_slower_of_two_equal_inserts_is_refused(spark, tmp_path):
    a, b = engine(spark, tmp_path / "j"), engine(spark, tmp_path / "j")
    real, asked = b.overlay.log.folder.create, []

    def slow(name, data):
        if not asked:
            asked.append(name)
            a.run("POST", "/api/tags", {"id": "k", "name": "a"})  # comes between b's check and its commit
        return real(name, data)

    b.overlay.log.folder.create = slow
    with pytest.raises(mutations.MutationError):
        b.run("POST", "/api/tags", {"id": "k", "name": "b"})
    assert asked and a.run("GET", "/api/tags/k").first()["name"] == "a" and a.overlay.log.last() == 1


def test_a_transaction_is_one_commit_or_none(spark, tmp_path):
    e = engine(spark, tmp_path / "j")
    with e.transaction() as t:
        t.run("POST", "/api/tags", {"id": "n", "name": "made"})
        assert t.run("PATCH", "/api/tags/n", {"note": "x"}).first()["name"] == "made" and t.run("GET", "/api/tags/n").first()["note"] == "x"
        t.run("DELETE", "/api/tags/2")
    assert e.overlay.log.last() == 1 and names(e.run("GET", "/api/tags")) == {"1": "b", "3": None, "n": "made"}
    events = list(e.events)
    with pytest.raises(mutations.MutationError), e.transaction() as t:
        t.run("PATCH", "/api/tags/3", {"name": "lost"})
        t.run("POST", "/api/tags", {"id": "n", "name": "refused"})
    assert e.overlay.log.last() == 1 and e.events == events and e.run("GET", "/api/tags/3").first()["name"] is None


def apply_plainly(state, method, row_id, body):
    if method == "POST":
        state[row_id] = {"name": None, "note": None, **body}
    elif method == "DELETE":
        state.pop(row_id, None)
    elif row_id in state:
        state[row_id].update(body)


def test_state_equals_a_sequential_model_over_compactions(spark, tmp_path):
    rng = random.Random(2)
    start = [(str(i), f"n{i}") for i in range(6)]
    e = engine(spark, tmp_path / "j", tags=start)
    e.overlay.buckets = 4
    model = {i: {"name": n, "note": None} for i, n in start}
    kept = {}
    for step in range(30):
        method, row_id = rng.choice(["POST", "PATCH", "PATCH", "DELETE"]), str(rng.randrange(10))
        body = {k: rng.choice([None, f"v{step}"]) for k in ("name", "note") if rng.random() < 0.6} or {"name": f"v{step}"}
        if method == "POST" and row_id in model:
            with pytest.raises(mutations.MutationError):
                e.run("POST", "/api/tags", {"id": row_id, **body})
        else:
            e.run(method, "/api/tags" if method == "POST" else f"/api/tags/{row_id}", {"id": row_id, **body} if method == "POST" else None if method == "DELETE" else body)
            apply_plainly(model, method, row_id, body)
        if step in (9, 19, 25):
            e.compact()
        if step % 10 == 7:
            kept[e.overlay.log.last()] = {i: dict(v) for i, v in model.items()}
    read = lambda df: {r["id"]: {"name": r["name"], "note": r["note"]} for r in df.collect()}
    assert read(e.run("GET", "/api/tags")) == model
    for version, then in kept.items():  # older versions can still be read
        assert read(e.overlay.table("tag", version)) == then
    for i in range(10):
        row = e.run("GET", f"/api/tags/{i}").first()
        assert (row and {"name": row["name"], "note": row["note"]}) == model.get(str(i))
    assert e.overlay.log.vacuum() > 0 and read(e.overlay.table("tag")) == model
    assert journal.committed(spark, e.overlay.log).count() == e.overlay.log.last()


def test_one_row_reads_one_bucket(spark, tmp_path):
    e = engine(spark, tmp_path / "j")
    with e.transaction() as t:
        for i in range(40):
            t.run("POST", "/api/tags", {"id": f"k{i}", "name": "x"})
    e.compact()
    plan = e.overlay.mutations("tag", e.overlay.log.last(), "k7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,k7)]" in plan
    assert e.run("GET", "/api/tags/k7").first()["name"] == "x"


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path):
    e = engine(spark, tmp_path / "j")
    e.run("PATCH", "/api/tags/1", {"name": "x"})
    e.run("PATCH", "/api/tags/2", {"name": "y"})
    real = e.overlay.snapshots.create
    e.overlay.snapshots.create = lambda *a: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        e.compact()
    e.overlay.snapshots.create = real
    assert names(e.run("GET", "/api/tags")) == {"1": "x", "2": "y", "3": None}
    assert e.compact() == 2 and names(e.run("GET", "/api/tags")) == {"1": "x", "2": "y", "3": None}


def test_a_table_of_requests_is_one_commit(spark, tmp_path):
    c = Catalog(spark, {"tag": spark.createDataFrame([("1", "b")], "id string, name string")})
    rows = [journal.entry(f"r{i:03d}", "PATCH", "/api/tags/1", {"name": str(i)}, f"2026-01-01T00:00:{i // 10:02d}Z", "tag", "1", [("update", {"name": str(i)})]) for i in range(60)]
    log = CommitLog(spark, str(tmp_path / "j"))
    assert journal.append_table(spark.createDataFrame(rows, journal.COLUMNS).repartition(5), log) == 1
    assert journal.append_table(spark.createDataFrame(rows[:7], journal.COLUMNS), log) == 2
    over = Overlay(c, log)
    assert over.table("tag", 1).first()["name"] == "59" and over.table("tag").first()["name"] == "6"
    assert [r["id"] for r in journal.committed(spark, log, 0, 1).orderBy("seq").collect()] == [r[0] for r in rows]
    over.compact()
    log.vacuum()
    assert over.table("tag").first()["name"] == "6" and len(log.ranges()) == 1


def test_names_are_taken_once(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "f"))
    assert f.names() == [] and f.create("a", b"1") and not f.create("a", b"2") and f.names() == ["a"] and f.read("a") == b"1"
    assert json.loads(f.read("a")) == 1 and not [p for p in (tmp_path / "f").iterdir() if p.name.startswith("_tmp")]


def test_answers_count_their_rows(spark, tmp_path):
    e = engine(spark, tmp_path / "j")
    count = lambda *a: handlers.written(e.run(*a)).rows_affected
    assert [count("PATCH", "/api/tags/1", {"name": "x"}), count("PATCH", "/api/tags/none", {"name": "x"}), count("DELETE", "/api/tags/2"), count("DELETE", "/api/tags/2"), count("POST", "/api/tags", {"name": "n"})] == [1, 0, 1, 0, 1]
    assert handlers.written(e.run("POST", "/nowhere", {})) == ([], 0)
    assert [[tuple(r) for r in e.overlay.affected("tag", v).collect()] for v in (1, 2, 3, 5)] == [[("update", 1)], [], [("delete", 1)], [("insert", 1)]]
