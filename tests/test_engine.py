import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import naming
from tamarack.operators import dedup, handlers, journal, mutations, params, reads, replay, routing, rules
from tamarack.plans.registry import DECLARATION
from tamarack.sources import declarations as d
from tamarack.sources import http
from tamarack.sources.catalog import Catalog


def catalog(spark):
    return Catalog(
        spark,
        {
            "tag": spark.createDataFrame([("1", "b", "x"), ("2", "A", None), ("3", "é", "x")], "id string, name string, category_id string"),
            "note": spark.createDataFrame([("7", "hi", "2026-01-01"), ("8", "yo", "2026-02-01")], "id string, content string, created_at string"),
        },
    )


DECL = d.load("entities: {tag: /api/edu/tags, note: [{path: /api/notes}, {path: '/api/notes/{id}'}], gone: }")


def test_names():
    assert naming.to_snake("categoryId") == "category_id"
    assert naming.to_camel("line_1_no") == "line1No"
    assert naming.to_camel_key("line_1_no") == "line_1No"
    with pytest.raises(ValueError):
        naming.checked("a; drop")


def test_prefix_reads_and_order(spark):
    c = catalog(spark)
    df, single = reads.read(c, routing.resolve(DECL, "GET", "/api/edu/tags?name=b"))
    assert not single and [r["name"] for r in df.collect()] == ["A", "b", "é"]
    df, single = reads.read(c, routing.resolve(DECL, "GET", "/api/edu/tags/2"))
    assert single and reads.response(df, True) == {"id": "2", "name": "A", "categoryId": None}
    df, single = reads.read(c, routing.resolve(DECL, "GET", "/api/edu/tags/none"))
    assert reads.response(df, True) is None
    df, _ = reads.read(c, routing.resolve(DECL, "GET", "/api/notes"))
    assert [r["id"] for r in df.collect()] == ["8", "7"]
    assert routing.resolve(DECL, "GET", "/api/edu/tags/1/more") is None
    assert routing.resolve(DECL, "HEAD", "/api/notes") is None


def test_bad_id_finds_nothing(spark):
    c = Catalog(spark, {"t": spark.createDataFrame([(1, "a")], "id long, name string")})
    decl = d.load("entities: {t: /t}")
    assert reads.read(c, routing.resolve(decl, "GET", "/t/abc"))[0].count() == 0


def test_payload_and_envelope():
    assert reads.payload({"created_at": "[1]", "a_1": "{x", "n": [{"b_c": 1}]}) == {"createdAt": [1], "a_1": "{x", "n": [{"bC": 1}]}
    assert reads.envelope(None) == {"ok": True, "source": "local", "data": None}


@pytest.mark.parametrize(
    "text",
    ["entities: {a: x}", "entities: {a: /}", "entities: {a: /x, b: /x}", "entities: {a: [{path: /x, method: FETCH}]}", "entities: {a: [{path: /x, method: GET}, {path: /x, method: get}]}", "entities: {a: /x, b: [{path: /x/y}]}"],
)
def test_declaration_faults(text):
    with pytest.raises(d.DeclarationError):
        d.load(text)


def test_declared_lists():
    assert DECL.paths() == ["/api/edu/tags", "/api/notes", "/api/notes/{id}"]
    assert DECL.tables() == ["note", "tag"]
    assert len([r for r in DECL.routes if r.path == "/api/notes"]) == 5


def test_operations_and_config():
    ops = d.check_operations([{"operation_id": "o", "method": "get", "path": "/a/{id}", "connectivity": "offline"}])
    assert routing.resolve_operation(ops, "GET", "/a/x%20y?q=1")[1] == {"id": "x y"}
    with pytest.raises(d.DeclarationError):
        d.check_operations([{"operation_id": "o", "method": "GET", "path": "/a/{id}", "connectivity": "offline"}, {"operation_id": "p", "method": "GET", "path": "/a/{b}", "connectivity": "x"}])
    assert d.load_config("sync: {adminUrl: u, buckets: [a]}").buckets == ("a",)
    with pytest.raises(d.DeclarationError):
        d.load_config("sync:\nadminUrl: u")


def test_binder():
    assert params.positional("SELECT ':a', x::int, \"q:b\" -- :c\n FROM t WHERE a = :a AND b = :a /* :d", {"a": 1}) == ("SELECT ':a', x::int, \"q:b\" -- :c\n FROM t WHERE a = ? AND b = ? /* :d", [1, 1])
    for sql in ("a = ?", "a = 'x", "a = :missing"):
        with pytest.raises(params.BindingError):
            params.positional(sql, {"a": 1})
    assert params.merged({"id": "p"}, "/x?id=q&n=1&n=2", {"id": "b", "n": 3, "m": [1], "z": None}) == {"id": "p", "n": "1", "z": None}


def walk(routes, parts):
    """Literal first, back to the hole if nothing comes of it: the model of matching."""

    def go(live, i):
        if i == len(parts):
            return [r for r in live if len(r) == i]
        live = [r for r in live if len(r) > i]
        return go([r for r in live if r[i] == parts[i] and d.hole(r[i]) is None], i + 1) or go([r for r in live if d.hole(r[i]) is not None], i + 1)

    return go(routes, 0)


SEG = st.sampled_from(["a", "b", "{x}", "{y}"])


@given(st.lists(st.lists(SEG, min_size=1, max_size=4).map(tuple), min_size=1, max_size=8, unique=True), st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_matching_is_a_tree_walk(routes, parts):
    status, target, _ = routing.match([("GET", "/" + "/".join(r), r) for r in routes], "get", parts)
    found = walk(routes, parts)
    assert status == (routing.NOT_FOUND if not found else routing.MATCHED if len(found) == 1 else routing.AMBIGUOUS)
    assert target == (found[0] if len(found) == 1 else None)


def test_batch_matching_equals_driver(spark):
    routes = [(r.method, r.path, r.table) for r in DECLARATION.routes] + [("GET", "/api/{a}/{b}", "any")]
    urls = ["/api/geo/areas", "//api/geo/areas/", "/api/geo/areas/7?x=1", "/api/x/y", "/api/catalog/items/%41", "/", "/api/geo/typed/T"]
    df = routing.match_batch(spark.createDataFrame([("get", u) for u in urls], "method string, path string"), routes)
    for r in df.collect():
        status, target, got = routing.match(routes, "GET", d.segments(r["path"].split("?")[0]))
        assert (r["status"], r["target"], r["params"] or {}) == (status, target, got if status == routing.MATCHED else {})


def test_batch_prefix(spark):
    rows = spark.createDataFrame([("/a/b",), ("/a/b/x%20+y",), ("/a/b/c/d",), ("/a",), ("/z",), ("/a/b/%zz",)], "path string")
    got = {r["path"]: (r["table"], r["id"], r["collection"]) for r in routing.prefix_batch(rows, {"/a": "one", "/a/b": "two"}).collect()}
    assert got == {"/a/b": ("two", None, True), "/a/b/x%20+y": ("two", "x +y", False), "/a/b/c/d": (None, None, None), "/a": ("one", None, True), "/z": (None, None, None), "/a/b/%zz": ("two", "%zz", False)}


COLS = ["id", "name", "category_id", "tenant_id", "created_at", "updated_at", "_metadata"]


def test_insert_and_update():
    row = mutations.insert(COLS, {"id": 5, "categoryId": "b", "category_id": "c", "x": 1, "tenantId": "no", "tags": [1]}, {"categoryId": "p", "name": "p"}, {"name": "d"}, "new", "now", "t", "req")
    assert row == {"id": "new", "category_id": "c", "name": "p", "tenant_id": "t", "created_at": "now", "updated_at": "now", "_metadata": "req"}
    assert mutations.insert(COLS, {"id": "own", "name": None}, {}, {"name": "d"}, "new", "now")["name"] is None
    assert mutations.update(COLS, {"name": None}, "1", "now") == {"name": None, "updated_at": "now"}
    for args in ((COLS, {}, None, "now"), (["id", "content"], {"x": 1}, "1", "now")):
        with pytest.raises(mutations.MutationError):
            mutations.update(*args)
    assert mutations.kind_of("head") == "read"
    with pytest.raises(mutations.MutationError):
        mutations.kind_of("TRACE")


LOG = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["insert", "update", "delete"]), st.dictionaries(st.sampled_from(["a", "b"]), st.sampled_from([None, "1", "2"]))), max_size=30)


@given(LOG)
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_state_equals_a_sequential_model(spark, log):
    live, rejected = {}, set()
    for seq, (i, op, values) in enumerate(log):
        if op == "insert":
            if i in live:
                rejected.add(seq)
            else:
                live[i] = dict(values)
        elif op == "update" and i in live:
            live[i].update(values)
        elif op == "delete":
            live.pop(i, None)
    df = spark.createDataFrame([(i, s, op, v) for s, (i, op, v) in enumerate(log)], "id long, seq long, op string, set map<string, string>")
    got = {r["id"]: (r["a"], r["b"]) for r in mutations.state(df, ["a", "b"]).collect()}
    assert got == {i: (v.get("a"), v.get("b")) for i, v in live.items()}
    assert {r["seq"] for r in mutations.rejected_inserts(df).collect()} == rejected


def test_journal(spark, tmp_path):
    rows = [journal.entry("r1", "post", "/a?x=1", {"a": 1}, "2", "t", "1", [("mark", {"b": True}), ("delete", {})]), journal.entry("r2", "put", "/a", None, "1")]
    path = str(tmp_path / "j")
    for r in rows:
        journal.append(spark.createDataFrame([r], journal.COLUMNS), path)
    log = spark.read.parquet(path)
    assert [r["id"] for r in journal.pending(log, log.limit(0)).collect()] == ["r2", "r1"]
    assert [r["id"] for r in journal.pending(log, log.filter("id = 'r2'")).collect()] == ["r1"]
    assert [(r["id"], r["op"], r["set"]) for r in journal.mutations_of(log, "t").orderBy("seq").collect()] == [("1", "update", {"b": "true"}), ("1", "delete", {})]
    w = spark.createDataFrame([(1, "r1"), (2, ""), (3, "{}"), (4, None), (5, "gone")], "seq int, metadata string")
    assert {r["seq"]: r["journal_id"] for r in journal.linked(w, log).collect()} == {1: "r1", 2: None, 3: None, 4: None, 5: None}
    assert journal.body_of(rows[0][3]) == {"a": 1} and journal.body_of(None) is None
    with pytest.raises(journal.JournalError):
        journal.body_of("{")


def test_replay_pass(spark):
    rows = [(1, 1, 200), (1, 2, 422), (2, 3, 503), (2, 4, 200), (3, 5, 200)]
    out = replay.outcomes(spark.createDataFrame(rows, "tx_id long, seq long, http_status int"))
    got = {r["seq"]: (r["kind"], r["attempted"], r["completed"]) for r in out.collect()}
    assert got == {1: ("ok", True, True), 2: ("reject", True, True), 3: ("retry", True, False), 4: ("ok", False, False), 5: ("ok", False, False)}
    kinds = spark.createDataFrame([(s,) for s in (None, 200, 401, 403, 408, 409, 429, 500)], "s int").select(replay.classify(F.col("s")).alias("k"), replay.classify(F.col("s"), lambda s: F.when(s == 409, "retry")).alias("c"))
    assert [r["k"] for r in kinds.collect()] == ["retry", "ok", "reauth", "reject", "retry", "reject", "retry", "retry"]
    assert [r["c"] for r in kinds.collect()][5] == "retry"
    ops = spark.createDataFrame([("put",), ("Delete",), ("x",), (None,)], "o string").select(replay.crud_op(F.col("o")).alias("o"))
    assert [r["o"] for r in ops.collect()] == ["PUT", "DELETE", "PATCH", "PATCH"]


def test_requests_and_letters(spark):
    w = spark.createDataFrame([("c1", "req-1", "POST", "/a", "req-1", None, "tag", None, 1), ("c2", None, None, None, '{"method":"PUT","path":"/b"}', '{"idempotencyKey":"k"}', "tag", 409, 2), ("c3", None, None, None, "{bad", None, "tag", None, 3)], "client_id string, journal_id string, journal_method string, journal_path string, metadata string, data string, table_name string, http_status int, created_at long")
    got = {r["client_id"]: (r["send_method"], r["send_path"], r["headers"].get("Idempotency-Key")) for r in replay.request_of(w, "T").collect()}
    assert got == {"c1": ("POST", "/a", "req-1"), "c2": ("PUT", "/b", "k"), "c3": (None, None, None)}
    letters = replay.dead_letters(w.withColumn("operation_id", F.lit(None).cast("string")).withColumn("reason", F.lit("r")))
    assert {r["id"]: (r["operation_id"], r["code"]) for r in letters.collect()}["c1"] == ("tag", 0)


def test_error_handlers():
    seen = []
    h = replay.ErrorHandlers(lambda e: seen.append("default"))
    h.add("a", lambda e: 1 / 0)
    h.handle("a", {})
    h.handle("b", {})
    assert seen == ["default"]
    with pytest.raises(ValueError):
        h.add("a", print)


def guard(times, window):
    out, last = [], None
    for t in times:
        if last is None or t - last >= window:
            out.append(t)
            last = t
    return out


@given(st.lists(st.integers(0, 200), min_size=1, max_size=40), st.sampled_from([0, 1, 17, 60]))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_guard_equals_a_loop(spark, times, window):
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "k int, t long, seq int").withColumn("at", F.timestamp_micros("t"))
    kept = [r["at"].microsecond for r in dedup.suppress(df, ["k"], "at", "seq", window).collect()]
    assert sorted(kept) == guard(sorted(times), window)


def test_fingerprints(spark):
    rows = [("get", "/a", None), ("GET", "/a", ""), ("GET", "/a", "{}"), ("GET", "/a?x", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, u string, b string").select(dedup.fingerprint(F.col("m"), F.col("u"), F.col("b"))).collect()]
    assert len(set(got)) == 4


def test_streams_equal_batch(spark, tmp_path):
    from tamarack.streaming.dedup import guard_stream, latch_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", (F.col("event_id") % 7 == 3).alias("resume"), F.when(F.col("event_id") % 5 == 0, "reauth").otherwise("ok").alias("kind"))
    path = str(tmp_path / "in")
    events.repartition(1).write.parquet(path)
    live = spark.readStream.schema(events.schema).parquet(path)
    window = 12 * 3_600_000_000
    for name, df in (("guarded", guard_stream(live, ["user_id"], "ts", "event_id", window)), ("latched", latch_stream(live.withColumnRenamed("event_id", "seq"), "user_id"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    batch = dedup.suppress(events, ["user_id"], "ts", "event_id", window)
    assert {r["seq"] for r in spark.table("guarded").collect()} == {r["event_id"] for r in batch.collect()}
    shut = replay.latch(events, "user_id", "event_id")
    assert {(r["seq"], r["blocked"]) for r in spark.table("latched").collect()} == {(r["event_id"], r["blocked"]) for r in shut.collect()}


def test_rules(spark):
    doc = {"connections": [{"schemas": [{"name": "stock", "tables": [{"name": "balance", "columns": [{"name": "q", "sqlite_type": 8}, {"name": "n", "sqlite_type": 2}]}]}, {"name": None, "tables": [{"name": "tag", "columns": [{"name": "i", "sqlite_type": 6}]}]}, {"name": "x", "tables": None}]}]}
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(doc)]))
    assert {tuple(r) for r in rules.flatten(df).collect()} == {("stock.balance", "q", "real"), ("stock.balance", "n", "text"), ("public.tag", "i", "integer")}
    assert rules.read_query("b", 'SELECT t.a, b AS c FROM "x"."y" AS t WHERE a = 1').columns == (("a", "a"), ("b", "c"))
    assert rules.read_query("b", "select distinct x from y").columns is None
    assert rules.read_query("b", "nonsense") is None
    names = rules.device_names(spark.createDataFrame([("a.t",), ("b.t",), ("a.u",)], "source string"))
    assert {tuple(r) for r in names.collect()} == {("a.t", "a_t"), ("b.t", "b_t"), ("a.u", "u")}
    s = rules.Schema({"b": {"x": "text"}, "a": {}}, {"own": {"u": "text"}})
    assert rules.Schema.parse(s.text()) == s and s.renewed({}).local == s.local


def test_handlers(spark):
    own = handlers.Registry()
    own.add("h", lambda s, p: s.createDataFrame([(p["id"],)], "id string"))
    with pytest.raises(ValueError):
        own.add("h", None)
    with pytest.raises(KeyError):
        own.get("x")
    ops = d.check_operations([{"operation_id": "o", "method": "GET", "path": "/api/edu/tags/{id}", "connectivity": "offline", "handle": "h"}])
    e = handlers.Engine(catalog(spark), DECL, ops, own)
    assert e.run("GET", "/api/edu/tags/zz").first()["id"] == "zz"
    assert e.run("GET", "/nothing") is None and e.handles("POST", "/api/notes") and not e.handles("GET", "/nothing")
    with pytest.raises(mutations.MutationError):
        e.run("POST", "/api/notes", {})


def test_http_bodies():
    assert http.parse_body("", True) is None and http.parse_body("{", True) == "{" and http.parse_body("1", False) == "1" and http.parse_body("1", True) == 1
    assert http.strip_param("/a?_rsc=1&b=2") == "/a?b=2" and http.strip_param("/a?_rsc=1") == "/a"
    with pytest.raises(http.NetworkError):
        http.send("http://127.0.0.1:9", "GET", "/x", timeout=0.2)


def test_tenant(spark):
    t = spark.createDataFrame([("1", None)], "id string, tenant_id string")
    o = spark.createDataFrame([("2", "b"), ("1", "a")], "id string, tenant_id string")
    assert mutations.first_tenant(t, [o]).first()["tenant"] == "a"
    assert mutations.first_tenant(t, []).first()["tenant"] is None


WRITES = "id string, tx_id long, seq long, user string, journal_id string, journal_method string, journal_path string, journal_body string, metadata string, data string, operation_id string"


def writes(rows):
    """(id, tx, seq, user): journal requests to /<id>; a null journal row where ``id`` starts with x."""
    return [(i, t, q, u, i, *((None, None) if i[0] == "x" else ("POST", f"/{i}")), None, "", "{}", "op") for i, t, q, u in rows]


def recorder(folder, **status):
    """A sender that notes its calls in files, as it runs in workers."""

    def send(method, url, body, headers):
        import time

        name = url.strip("/").split("/")[-1]
        with open(f"{folder}/{time.time_ns()}-{name}", "w") as f:
            f.write(headers["Idempotency-Key"])
        got = status.get(name, 200)
        return got if got >= 0 else None

    return send


def calls(folder):
    return [p.name.split("-", 1)[1] for p in sorted(folder.iterdir())]


def test_upload_stops_where_the_server_does(spark, tmp_path):
    from tamarack.streaming.upload import acknowledged, one_pass, resume, shut_streams

    called, path = tmp_path / "called", str(tmp_path / "out")
    called.mkdir()
    df = spark.createDataFrame(writes([("a", 1, 1, "u"), ("a", 1, 2, "u"), ("b", 2, 3, "u"), ("c", 3, 4, "u"), ("d", 4, 5, "u"), ("x1", 5, 6, "v"), ("e", 5, 7, "v"), ("f", 6, 8, "v"), ("g", 7, 9, "v")]), WRITES)
    heard = replay.ErrorHandlers(lambda e: (called / "0-letter").write_text(e["id"]))
    one_pass(spark, df, recorder(called, b=503, e=422, f=401), path, "p0", "user", handlers=heard)
    assert sorted(calls(called)) == sorted(["a", "b", "e", "f", "letter"])  # c, d and g were not handed over
    assert {tuple(r) for r in acknowledged(spark, path).collect()} == {("a", "ok"), ("x1", "reject"), ("e", "reject")}
    letters = spark.read.parquet(f"{path}/letters/*").collect()
    assert {(r["id"], r["http_status"], r["reason"][:6]) for r in letters} == {("x1", None, "no usa"), ("e", 422, "reject")}
    assert [r["stream"] for r in shut_streams(spark, path).collect()] == ["v"]
    assert {r["type"] for r in spark.read.parquet(f"{path}/activity/*").collect()} == {"dead-letter", "reauth-required"}
    again = tmp_path / "again"
    again.mkdir()
    one_pass(spark, df, recorder(again, c=-1), path, "p1", "user")
    assert calls(again) == ["b", "c"]  # v is shut; c has no answer and stops u
    resume(spark, path)
    last = tmp_path / "last"
    last.mkdir()
    one_pass(spark, df, recorder(last), path, "p2", "user", base="http://h")
    assert sorted(calls(last)) == ["c", "d", "f", "g"] and one_pass(spark, df, recorder(last), path, "p3", "user").count() == 0


def test_an_epoch_that_runs_again_keeps_its_answers(spark, tmp_path):
    from tamarack.streaming.upload import acknowledged, letters, one_pass

    path, called = str(tmp_path / "out"), tmp_path / "called"
    called.mkdir()
    df = spark.createDataFrame(writes([("a", 1, 1, "u"), ("b", 2, 2, "u"), ("c", 3, 3, "u"), ("d", 4, 4, "u")]), WRITES)
    first = one_pass(spark, df, recorder(called, b=422, c=503), path, "pass-0", "user").collect()
    again = one_pass(spark, df, recorder(called), path, "pass-0", "user").collect()  # as Spark does after a failure
    assert sorted(first) == sorted(again) and calls(called) == ["a", "b", "c"]
    assert {tuple(r) for r in acknowledged(spark, path).collect()} == {("a", "ok"), ("b", "reject")}
    assert [r["id"] for r in letters(spark, path).collect()] == ["b"]
    one_pass(spark, df, recorder(called), path, "pass-1", "user")
    assert calls(called) == ["a", "b", "c", "c", "d"] and acknowledged(spark, path).count() == 4


@pytest.mark.parametrize("dies_at", ["answers", "acks", "letters", "latch", "activity", "epochs"])
def test_a_pass_killed_after_any_write_acknowledges_everything_once(spark, tmp_path, monkeypatch, dies_at):
    from pyspark.sql.readwriter import DataFrameWriter

    from tamarack.sources.commits import Folder
    from tamarack.streaming.upload import acknowledged, letters, one_pass, shut_streams

    path, called = str(tmp_path / "out"), tmp_path / "called"
    called.mkdir()
    df = spark.createDataFrame(writes([("a", 1, 1, "u"), ("b", 2, 2, "u"), ("c", 3, 3, "v")]), WRITES)
    parquet, create = DataFrameWriter.parquet, Folder.create

    def dying(self, where, *more, **options):
        parquet(self, where, *more, **options)
        if f"/{dies_at}/" in where:
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", dying)
        if dies_at == "epochs":
            m.setattr(Folder, "create", lambda self, *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            one_pass(spark, df, recorder(called, b=422, c=401), path, "pass-0", "user")
    assert Folder.create is create and acknowledged(spark, path).count() == 0 and shut_streams(spark, path).count() == 0
    one_pass(spark, df, recorder(called, b=422, c=401), path, "pass-0", "user")
    assert sorted(tuple(r) for r in acknowledged(spark, path).collect()) == [("a", "ok"), ("b", "reject")]
    assert [r["id"] for r in letters(spark, path).collect()] == ["b"] and [r[0] for r in shut_streams(spark, path).collect()] == ["v"]
    assert sorted(calls(called)) == ["a", "a", "b", "b", "c", "c"]  # sent again under the same keys


def test_upload_stream_retries_what_it_left(spark, tmp_path):
    from tamarack.streaming.upload import acknowledged, follow

    log, path, called = str(tmp_path / "log"), str(tmp_path / "out"), tmp_path / "called"
    called.mkdir()
    spark.createDataFrame(writes([("a", 1, 1, "u"), ("b", 2, 3, "u"), ("c", 3, 4, "u"), ("d", 4, 5, "u")]), WRITES).write.parquet(log)
    follow(log, WRITES, recorder(called, b=422, c=503), path, spark).awaitTermination()
    assert {tuple(r) for r in acknowledged(spark, path).collect()} == {("a", "ok"), ("b", "reject")}
    spark.createDataFrame(writes([("e", 5, 6, "u")]), WRITES).write.mode("append").parquet(log)
    follow(log, WRITES, recorder(called), path, spark).awaitTermination()
    assert {r["id"] for r in acknowledged(spark, path).collect()} == {"a", "b", "c", "d", "e"}
    assert calls(called) == ["a", "b", "c", "c", "d", "e"]


def test_composed_writes_are_one_append(spark, tmp_path):
    tag = spark.createDataFrame([("1", "b", None, None)], "id string, name string, tenant_id string, _metadata string")
    other = spark.createDataFrame([("9", "t9")], "id string, tenant_id string")
    c = Catalog(spark, {"tag": tag, "other": other})
    e = handlers.Engine(c, d.load("entities: {tag: /api/tags}"), [], handlers.Registry(), str(tmp_path / "j"))
    got = e.run("POST", "/api/tags?x=1", {"name": "n", "tenantId": "no"}).first()
    assert got["tenant_id"] == "t9" and got["name"] == "n" and len(got["id"]) == 36
    assert e.run("POST", "/api/tags?x=1", {"tenantId": "no", "name": "n"}).first()["id"] == got["id"]  # the same request: the same answer
    assert e.run("PUT", "/api/tags/1", {"name": "new"}).first()["name"] == "new"
    assert e.run("DELETE", "/api/tags/1").first()["name"] == "new"  # the row that goes, as the update before has left it
    for method, url in (("DELETE", "/api/tags"), ("PUT", "/api/tags")):
        with pytest.raises(mutations.MutationError):
            e.run(method, url, {"name": "x"})
    log = spark.read.schema(journal.COLUMNS).parquet(str(tmp_path / "j")).orderBy("created_at").collect()
    assert [(r["method"], [s["op"] for s in r["steps"]]) for r in log] == [("POST", ["insert"]), ("PUT", ["update"]), ("DELETE", ["mark", "delete"])]
    assert log[0]["path"] == "/api/tags?x=1" and log[0]["steps"][0]["set"]["_metadata"] == log[0]["id"] and json.loads(log[0]["body"]) == {"name": "n", "tenantId": "no"}
    assert [x[0] for x in e.events] == ["local-write"] * 3


def test_operations_online_and_metadata(spark):
    seen = []
    own = handlers.Registry()
    own.add("net", lambda s, p: seen.append(p) or s.range(1), "online")
    own.add("local", lambda s, p: seen.append(p) or s.range(2))
    own.add("self", lambda s, p: seen.append(p) or s.range(2), metadata=lambda p: "mine")
    rows = [("a", "/n/{id}", "online", "net"), ("b", "/l", "offline", "local"), ("c", "/s", "offline", "self"), ("e", "/bad", "offline", "net")]
    ops = d.check_operations([{"operation_id": o, "method": "POST", "path": p, "connectivity": c, "handle": h, "dedup_window_ms": 10 if o == "a" else None} for o, p, c, h in rows])
    now = [0]
    e = handlers.Engine(catalog(spark), DECL, ops, own, clock_ms=lambda: now[0])
    e.run("POST", "/n/1", {"x": 1})
    now[0] = 9
    e.run("POST", "/n/1", {"x": 1})
    now[0] = 10
    e.run("POST", "/n/1", {"x": 1})
    e.run("POST", "/l?q=1", {"_metadata": "no"})
    e.run("POST", "/s")
    assert len(seen) == 4 and json.loads(seen[2]["_metadata"]) == {"method": "POST", "path": "/l?q=1", "operationId": "b", "body": {"_metadata": "no"}} and seen[3]["_metadata"] == "mine"
    with pytest.raises(ValueError):
        e.run("POST", "/bad")


def test_guard_forgets_and_is_bounded():
    g = dedup.Guard(window_ms=10, most=2)
    g.remember("a", 1, 0)
    assert g.find("a", 9) == 1 and g.find("a", 9, 5) is None and g.find("a", 9) is None
    for i, k in enumerate("abc"):
        g.remember(k, k, i)
    assert g.find("a", 3) is None and g.find("b", 3) == "b"
    assert dedup.fingerprint_of("get", "/a", {"x": {"b": 1, "a": 2}}) == dedup.fingerprint_of("GET", "/a", {"x": {"a": 2, "b": 1}}) != dedup.fingerprint_of("GET", "/a")


def test_admin_source_and_strict_schema():
    answers = {"/schema": (200, {"data": {"connections": []}}), "/diagnostics": (200, {"active_sync_rules": {"content": "streams: {}"}})}
    assert rules.ask_admin("http://h", "t", lambda b, m, p, body, head: answers[p]) == ({"connections": []}, "streams: {}")
    for bad in ((401, None), (500, None), (200, {})):
        with pytest.raises(rules.SchemaError):
            rules.ask_admin("http://h", "t", lambda b, m, p, body, head, bad=bad: bad)
    with pytest.raises(rules.SchemaError):
        rules.ask_admin("http://127.0.0.1:9", "t")
    for text in ("{", "[]", '{"tables": []}', '{"tables": {"a": {"x": "blob"}}}', '{"tables": {}, "localTables": 1}'):
        with pytest.raises(rules.SchemaError):
            rules.Schema.parse(text)


def test_structure_levels_missing_everywhere(spark, tmp_path):
    for i, doc in enumerate(({}, {"connections": None}, {"connections": [{"schemas": [{"name": "s"}]}]}, {"data": {}})):
        f = tmp_path / f"{i}.json"
        f.write_text(json.dumps(doc))
        assert rules.flatten(rules.read_structure(spark, str(f))).count() == 0 and rules.flatten(spark.read.option("multiLine", True).json(str(f))).count() == 0


def test_structure_file_and_activity(spark, tmp_path):
    from tamarack.operators import activity

    f = tmp_path / "s.json"
    f.write_text(json.dumps({"data": {"connections": [{"schemas": [{"name": "s", "tables": [{"name": "t", "columns": [{"name": "c", "sqlite_type": 4}]}]}]}]}}))
    assert [tuple(r) for r in rules.flatten(rules.read_structure(spark, str(f))).collect()] == [("s.t", "c", "integer")]
    e = spark.createDataFrame([activity.event("local-write", "2026", table="t"), activity.event("replay", "2027")], "type string, at string, detail map<string, string>")
    assert activity.recent(e, "at", 1).first()["type"] == "replay" and activity.counts_by_type(e).count() == 2
    assert dict(activity.typed(spark.createDataFrame([("1", "5", "7")], "id string, code string, created_at string")).dtypes) == {"id": "string", "code": "int", "created_at": "bigint"}


def test_band_joins_equal_a_nested_loop(spark):
    import random

    rng = random.Random(4)
    points = [(i, rng.choice([None, float("nan"), 0.0, -5.5]) if i % 20 == 0 else rng.uniform(-100, 100) * 10 ** rng.randint(-3, 3)) for i in range(300)]
    spans = [(i, *([None, 1.0] if i % 30 == 0 else sorted((p := rng.choice(points)[1] or 1.0, p + rng.choice([0, 1e-9, 1, -20, 5e4])))[:: -1 if i % 29 == 0 else 1])) for i in range(200)] + [(900, -1e9, 1e9), (901, 0.0, 0.0)]
    c = Catalog(spark, {"p": spark.createDataFrame(points, "id long, v double"), "s": spark.createDataFrame(spans, "id long, lo double, hi double")})
    decl = d.load("entities: {p: [{path: /b, method: GET, joins: ['JOIN s ON p.v BETWEEN s.lo AND s.hi'], select: 'p.id AS a, s.id AS b'}], s: [{path: /r, method: GET, joins: ['INNER JOIN p t ON t.v BETWEEN s.lo AND s.hi'], select: 't.id AS a, s.id AS b'}]}")
    spark.sql("select 1")
    want = {tuple(r) for r in spark.sql("SELECT p.id, s.id FROM {p} p JOIN {s} s ON p.v BETWEEN s.lo AND s.hi WHERE NOT isnan(p.v) AND NOT isnan(s.lo) AND NOT isnan(s.hi)", p=c["p"], s=c["s"]).collect()}
    for url in ("/b", "/r"):
        df = reads.read(c, routing.resolve(decl, "GET", url))[0]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    other = d.load("entities: {p: [{path: /b, method: GET, joins: ['LEFT JOIN s ON p.v BETWEEN s.lo AND s.hi'], select: 'p.id AS a, s.id AS b'}]}")
    assert reads.read(c, routing.resolve(other, "GET", "/b"))[0].select("a").distinct().count() == 300


def test_routes_in_a_table_equal_routes_in_the_plan(spark):
    routes = [("get", "/a/{x}", "ax"), ("GET", "/a/b", "ab"), ("GET", "/{y}/b", "yb"), ("POST", "/a/{x}/c", "axc"), ("POST", "/a/{z}/c", "azc"), ("GET", "/", "root"), ("GET", "/{}/b", "braces"), ("GET", "/a/{x}/{y}/d", "deep")]
    asked = [("GET", p) for p in ("/a/b", "/a/q", "//a//q/", "/x/b", "/{}/b", "/", "", "/a/1/2/d", "/a/1/2/e", "/A/q?x=/b", None)] + [("post", "/a/1/c"), (None, "/a/b"), ("GET", "/%61/b"), ("GET", "/a/q")]
    df = spark.createDataFrame([(i, m, p) for i, (m, p) in enumerate(asked)], "i int, method string, path string")
    table = spark.createDataFrame(routes, "method string, path string, target string")
    for decode in (False, True):
        one, two = (f(df, r, decode=decode).select("i", "status", "target", "route_path", F.to_json("params").alias("p")).orderBy("i").collect() for f, r in ((routing.match_batch, routes), (routing.match_table, table)))
        assert one == two


def test_a_slow_stream_keeps_nobody_waiting(spark, tmp_path):
    import time

    from tamarack.streaming.upload import acknowledged, one_pass

    rows = [(f"s{u}-{i}", u * 100 + i, i, f"u{u}") for u in range(6) for i in range(5)]
    df = spark.createDataFrame([(i, t, q, u, i, "POST", f"/{i}", None, "", "{}", "op") for i, t, q, u in rows], WRITES).coalesce(1)
    called = tmp_path / "called"
    called.mkdir()

    def send(method, url, body, headers):
        time.sleep(0.4 if url.startswith("/s0") else 0.1)
        (called / f"{time.time_ns()}-{url[1:]}").write_text("")
        return 503 if url == "/s1-2" else 200

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        began = time.time()
        answers = one_pass(spark, df, send, str(tmp_path / "out"), "p", "user", waiting=4)
        took = time.time() - began
        answers = answers.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = calls(called)
    for u in range(6):  # order inside a stream, up to its stop
        assert [c for c in order if c.startswith(f"s{u}-")] == [f"s{u}-{i}" for i in range(3 if u == 1 else 5)]
    assert order.index("s5-0") < order.index("s0-0") and len(answers) == 28
    assert acknowledged(spark, str(tmp_path / "out")).count() == 27 and took < 30


def test_a_thread_gets_all_rows_that_its_stream_has(monkeypatch):
    """Few hand-overs and frames for many quick answers; order, stops and the limit on held rows stay."""
    import pandas as pd

    from tamarack.streaming import upload

    handed = []

    class Pool(upload.ThreadPoolExecutor):
        def submit(self, f, rows):
            handed.append(len(rows))
            return super().submit(f, rows)

    monkeypatch.setattr(upload, "ThreadPoolExecutor", Pool)
    rows = [(f"u{i % 50}", i, i, str(i), None if i % 7 == 0 else "PUT", str(i), None, None) for i in range(5000)]
    batches = [pd.DataFrame(rows[i : i + 1000], columns=["stream", "tx_id", "seq", "id", "send_method", "url", "send_body", "headers"]) for i in range(0, 5000, 1000)]
    for waiting in (10_000, 30):
        handed.clear()
        frames = list(upload._deliver(lambda m, url, b, h: {"1003": 503, "2010": 401, "2504": 422}.get(url, 200), 4, waiting)(iter(batches)))
        got = pd.concat(frames)
        for u, own in got.groupby("stream"):
            end = {"u3": 1003, "u10": 2010}.get(u, 4999)
            assert own["seq"].tolist() == [i for i in range(int(u[1:]), 5000, 50) if i <= end]
        assert dict(zip(got["seq"], got["kind"], strict=True))[2504] == "reject" and max(handed) <= waiting
        if waiting == 10_000:
            assert len(handed) < 1000 and len(frames) < 10


def test_the_outbox_retries_by_a_timer_and_opens_on_a_resume(spark, tmp_path):
    import time

    from tamarack.streaming.outbox import outbox_stream

    called, path = tmp_path / "called", str(tmp_path / "s")
    called.mkdir()

    def send(method, url, body, headers):
        name = url.strip("/")
        before = sum(p.name.endswith(f"-{name}") for p in called.iterdir())
        (called / f"{time.time_ns()}-{name}").write_text(headers["Idempotency-Key"])
        return {"b": [503, 503], "f": [401], "e": [422]}.get(name, [])[before] if before < len({"b": [503, 503], "f": [401], "e": [422]}.get(name, [])) else 200

    spark.createDataFrame(writes([("a", 1, 1, "u"), ("a", 1, 2, "u"), ("b", 2, 3, "u"), ("c", 2, 4, "u"), ("x1", 5, 6, "v"), ("e", 5, 7, "v"), ("f", 6, 8, "v"), ("g", 7, 9, "v")]), WRITES).write.parquet(f"{path}/in")
    spark.createDataFrame([], "stream string").write.parquet(f"{path}/open")
    live = spark.readStream.schema(WRITES).parquet(f"{path}/in")
    resumes = spark.readStream.schema("stream string").parquet(f"{path}/open")
    out = outbox_stream(live, send, "user", wait_ms=200, resumes=resumes)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(processingTime="200 milliseconds").start()

    def done(ids):
        until = time.time() + 90
        while time.time() < until:
            try:
                got = {(r["id"], r["kind"]) for r in spark.read.schema(out.schema).parquet(f"{path}/out").filter("done").collect()}
            except Exception:  # noqa: BLE001 - nothing is written yet
                got = set()
            if {i for i, _ in got} >= ids:
                return got
            time.sleep(0.3)
        raise AssertionError((got, query.exception()))

    try:
        assert done({"a", "b", "c", "x1", "e"}) == {("a", "ok"), ("b", "ok"), ("c", "ok"), ("x1", "reject"), ("e", "reject")}
        assert calls(called).count("b") == 3 and calls(called).count("a") == 1 and "g" not in calls(called)
        spark.createDataFrame([("v",)], "stream string").write.mode("append").parquet(f"{path}/open")
        assert {("f", "ok"), ("g", "ok")} <= done({"f", "g"})
    finally:
        query.stop()
    assert [c for c in calls(called) if c in "fg"] == ["f", "f", "g"]


def test_the_outbox_calls_its_state_by_lists_of_writes():
    """What goes out at once never meets the state; what waits is put and read by lists, over batches, inside a list and behind a transaction across two of them."""
    import json

    from tamarack.streaming import outbox

    calls, sent, codes = [], [], {}

    class State:
        def __init__(self):
            self.held = {}

        def getValue(self, key):  # noqa: N802
            calls.append("get")
            return (self.held[key],)

        def updateValue(self, key, value):  # noqa: N802
            calls.append("put")
            self.held[key] = value[0]

        def removeKey(self, key):  # noqa: N802
            calls.append("remove")
            del self.held[key]

        def get(self):
            calls.append("get")
            return self.held.get(0)

        def update(self, value):
            calls.append("put")
            self.held[0] = value

        def clear(self):
            calls.append("remove")
            self.held = {}

    def send(method, url, body, headers):
        sent.append(url)
        return codes.get(url, 200)

    box = outbox.Outbox(send, None)
    box.init(type("Handle", (), {"getMapState": lambda *_: State(), "getValueState": lambda *_: State()})())

    def batch(ids, resume=False):
        rows = [("u", i // 3, i, json.dumps({"tx_id": i // 3, "seq": i, "id": str(i), "send_method": "PUT", "url": str(i)})) for i in ids]
        calls.clear()
        sent.clear()
        return [(a["seq"], a["kind"], a["done"]) for a in box.handleInputRows(("u",), iter(rows + [("u", None, None, None)] * resume), None)]

    assert [a[0] for a in batch(reversed(range(900)))] == list(range(900)) and len(calls) == 1
    codes.update({"1300": 503, "1900": 401})
    got = batch(range(900, 2000))  # 1299 and 1300 are of one transaction, behind 399 writes
    assert got[-2:] == [(1299, "ok", False), (1300, "retry", False)] and len(got) == 401 and len(calls) < 12
    codes.pop("1300")
    got = batch(range(2000, 2002))
    assert [a[0] for a in got] == list(range(1299, 1901)) and got[-1] == (1900, "reauth", False) and all(a[2] for a in got[:-2]) and len(calls) < 16
    assert batch([2002]) == [] and sent == [] and len(calls) < 4
    codes.pop("1900")
    assert [a[0] for a in batch([], True)] == list(range(1899, 2003)) and not box.rows.held and not box.place.held


def test_the_interceptor_judges_each_method_and_path_once(spark):
    """Routes are held against distinct requests; missing methods and paths are judged too, and a body is parsed once."""
    from tamarack.operators.handlers import intercept
    from tamarack.sources.declarations import check_operations

    ops = check_operations([{"operation_id": "put_item", "method": "PUT", "path": "/items/{id}", "connectivity": "offline", "handle": "h", "dedup_window_ms": 0}])
    rows = [(1, "PUT", "/items/1", '{"a":1}'), (2, "PUT", "/items/1", '{"a":1}'), (3, "GET", "/items", None), (4, "GET", "/items", None), (5, None, "/items", None), (6, "GET", None, None), (7, "GET", "/none", "x")]
    asked = spark.createDataFrame([(i, 1.0 + i / 1000, *r) for i, *r in rows], "seq long, at double, method string, path string, body string").withColumn("at", F.col("at").cast("timestamp"))
    out = intercept(asked, ops, [("GET", "/items", "item")], {})
    assert {(r["seq"], r["source"], r["target"], r["by"]) for r in out.collect()} == {(1, "operation", "put_item", 1), (2, "operation", "put_item", 2), (3, "entity", "item", 3), (4, "entity", "item", 3), (5, "server", None, None), (6, "server", None, None), (7, "server", None, None)}
    plan = out.filter("source <> 'server'")._jdf.queryExecution().optimizedPlan().toString()
    mine = plan[: plan.index("MapInArrow", plan.index("MapInArrow") + 1)] if plan.count("MapInArrow") > 1 else plan
    assert mine.index("Join") < mine.index("array_min") and mine[mine.index("Join") :].count("Aggregate") and mine.count("parseJson") == 1


def test_rules_of_a_column_equal_rules_of_one_query(spark):
    texts = ["SELECT id, t.name AS n FROM todo t WHERE x = 1;", 'select "a" as "b" from "s"."t" as q', "select * from x.y.z", "select count(*) from t", "delete from t", " select id\nfrom t\norder by id limit 3", "select id from t group by id", "", None, "select a b from t"]
    got = {r["sql"]: r for r in rules.read_queries(spark.createDataFrame([(t,) for t in texts], "sql string")).collect()}
    for t in texts:
        one = rules.read_query("b", t) if t else None
        assert (t in got) == (one is not None)
        if one:
            assert got[t]["source"] == one.source and (None if got[t]["columns"] is None else tuple(map(tuple, got[t]["columns"]))) == one.columns


def test_declarations_in_tables_are_judged_as_the_yaml_is(spark):
    from tamarack.operators import declared

    prefixes = spark.createDataFrame([(1, "a", "/x"), (2, "b", "/x"), (3, "c", "y"), (4, "d", "//")], "place int, table string, prefix string")
    routes = spark.createDataFrame([(5, "e", "GET", "/x/1"), (6, "e", None, "/z"), (7, "f", "post", "/z"), (8, "f", "BREW", "/z"), (9, "a", "GET", "/x/2"), (10, "g", "GET", "z"), (11, "h", "GET", "/xy")], "place int, table string, method string, path string")
    got = {(r["fault"], r["table"], r["what"]) for r in declared.faults(prefixes, routes).collect()}
    assert got == {("bad prefix", "c", "y"), ("bad prefix", "d", "//"), ("prefix twice", "b", "/x"), ("unknown method", "f", "BREW /z"), ("request twice", "f", "POST /z"), ("bad path", "g", "z"), ("prefix covers", "a", "/x /x/1")}
    assert [r["path"] for r in declared.paths(prefixes, routes).orderBy("kind", "first").collect()] == ["/x", "y", "//", "/x/1", "/z", "/x/2", "z", "/xy"]
    assert declared.faults(prefixes.limit(0), routes.limit(0)).count() == 0


def test_an_ordered_band_join_sorts_blocks_and_no_pairs(spark):
    """Many equal prices and sizes: every pair comes, in order, and none of them is behind the join in a shuffle."""
    points = spark.range(2500).selectExpr("id", "CAST(100 + id % 2 AS double) AS price", "date_add(DATE'2020-01-01', CAST(id % 7 AS int)) AS created_at")
    items = spark.range(1200).selectExpr("id", "CAST(99 AS double) AS low", "CAST(1 + id % 3 AS int) AS size")
    cat = Catalog(spark, {"point": points, "item": items})
    own = d.load("entities: {point: [{path: /bands, method: GET, select: 'point.id AS id, item.id AS itemId, point.created_at AS day', joins: ['JOIN item ON point.price BETWEEN item.low AND item.low + item.size']}]}")
    got = reads.read(cat, routing.resolve(own, "GET", "/bands"))[0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Sort [") and "Sort" not in plan[: plan.index("Generate")]
    rows = got.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("itemId").alias("d"))
    assert {(r["id"] % 2, r["n"], r["d"]) for r in rows.collect()} == {(0, 1200, 1200), (1, 800, 800)} and rows.count() == 2500
    days = [r["day"] for r in got.filter("itemId < 9").collect()]
    assert days == sorted(days, reverse=True)


def test_an_ordered_band_join_sends_no_blocks_through_the_driver(spark):
    points = spark.range(900).selectExpr("id", "CAST(id AS double) AS price", "date_add(DATE'2020-01-01', CAST(id % 7 AS int)) AS created_at")
    items = spark.range(300).selectExpr("id", "CAST(3 * id AS double) AS low", "2 AS size")
    own = d.load("entities: {point: [{path: /bands, method: GET, select: 'point.id AS id, item.id AS itemId', joins: ['JOIN item ON point.price BETWEEN item.low AND item.low + item.size']}]}")
    got = reads.read(Catalog(spark, {"point": points, "item": items}), routing.resolve(own, "GET", "/bands"))[0]
    assert sorted((r["id"], r["itemId"]) for r in got.collect()) == [(i, i // 3) for i in range(900)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
