"""Registered queries over the engine's operators, and their DuckDB oracles.

Every query reads its whole tables. Sizes that look like limits (the last 200 activities, the row of one id)
are what the operator is for.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import activity, declared, dedup, journal, mutations, params, reads, replay, routing, rules
from ..operators.handlers import Engine, Registry, handled, intercept
from ..operators.overlay import Overlay
from ..sources import http
from ..sources.catalog import VIEWS, Catalog, shared_folder, view_sql
from ..sources.commits import CommitLog
from ..sources.declarations import check_operations, load
from ..streaming import dedup as guards
from ..streaming import outbox, upload

DECLARATION = load((Path(__file__).parent / "declaration.yaml").read_text())
ROUTES = [(r.method, r.path, r.table) for r in DECLARATION.routes]
PREFIXES = {"/api/catalog": "catalog", "/api/catalog/items": "item", "/api": "root"}
HOUR_US = 3_600_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_WITH = ", ".join(f"{name} AS ({view_sql(name)})" for name in VIEWS)


def query(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Register a query of a catalog; ``ctes`` come after the logical views."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog.of_folder(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_WITH}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


def get(cat: Catalog, url: str) -> DataFrame:
    return reads.read(cat, routing.resolve(DECLARATION, "GET", url))[0]


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in columns})


# -- composed reads ---------------------------------------------------------------------------------------------
_KIDS = "coalesce((SELECT to_json(list(struct_pack(id := c.id, name := c.name, areaId := c.area_id) ORDER BY c.id))::varchar FROM country c WHERE {on}), '[]') AS countries"


@query("Q01_nested_areas", f"SELECT id, name, {_KIDS.format(on='c.area_id = area.id')} FROM area")
def _(cat):
    return as_json(get(cat, "/api/geo/areas"), "countries")


@query("Q02_list_items", "SELECT id, name, brand, item_type AS \"itemType\", pack_size AS \"packSize\", retail_price AS \"retailPrice\" FROM item")
def _(cat):
    return get(cat, "/api/catalog/items?page=2")


@query("Q03_item_by_id", "SELECT id, name, brand, item_type AS \"itemType\", pack_size AS \"packSize\", retail_price AS \"retailPrice\" FROM item WHERE id = 5")
def _(cat):
    return get(cat, "/api/catalog/items/5")


@query("Q04_two_holes", "SELECT id, client_id AS \"clientId\", status, total_price AS \"totalPrice\" FROM purchase WHERE client_id = (SELECT min(client_id) FROM purchase WHERE id = 7) AND id = 7")
def _(cat):
    own = cat["purchase"].filter("id = 7").agg(F.min("client_id")).first()[0]  # one row: the id of a client that has purchase 7
    return get(cat, f"/api/sales/clients/{own}/purchases/7").drop("createdAt")


@query("Q05_mapped_param", "SELECT id, name, brand, item_type AS \"itemType\", pack_size AS \"packSize\", retail_price AS \"retailPrice\" FROM item WHERE item_type = 'PROMO'")
def _(cat):
    return get(cat, "/api/catalog/by-type/PROMO")


@query("Q06_unknown_hole_ignored", "SELECT id, name, brand, item_type AS \"itemType\", pack_size AS \"packSize\", retail_price AS \"retailPrice\" FROM item WHERE item_type = 'ECONOMY'")
def _(cat):
    return get(cat, "/api/xx/typed/ECONOMY")


@query("Q07_left_join_select", "SELECT client.id AS id, client.name AS name, country.name AS \"countryName\" FROM client LEFT JOIN country ON country.id = client.country_id")
def _(cat):
    return get(cat, "/api/sales/clients-with-country")


@query("Q08_multi_join", "SELECT purchase.id AS id, client.segment AS segment, country.name AS \"countryName\", area.name AS \"areaName\" FROM purchase JOIN client ON client.id = purchase.client_id JOIN country ON country.id = client.country_id LEFT JOIN area ON area.id = country.area_id")
def _(cat):
    return get(cat, "/api/sales/purchases-by-area")


@query("Q09_theta_join", "SELECT client.id AS id, area.name AS \"areaName\" FROM client JOIN area ON area.id < client.id")
def _(cat):
    return get(cat, "/api/sales/pairs")


@query("Q82_band_join", 'SELECT purchase.id AS id, item.id AS "itemId" FROM purchase JOIN item ON purchase.total_price BETWEEN item.retail_price * 100 AND item.retail_price * 100 + item.pack_size')
def _(cat):
    """A declared band between two tables becomes an equi-join on levels and bins."""
    own = load(
        "entities: {purchase: [{path: /bands, method: GET, select: 'purchase.id AS id, item.id AS itemId', "
        "joins: ['JOIN item ON purchase.total_price BETWEEN item.retail_price * 100 AND item.retail_price * 100 + item.pack_size']}]}"
    )
    return reads.read(cat, routing.resolve(own, "GET", "/bands"))[0]


@query("Q10_nested_empty", "SELECT id, name, '[]' AS countries FROM area")
def _(cat):
    return as_json(get(cat, "/api/geo/bare-areas"), "countries")


@query(
    "Q11_nested_two",
    "SELECT id, name, area_id AS \"areaId\", coalesce((SELECT to_json(list(struct_pack(id := c.id, segment := c.segment) ORDER BY c.id))::varchar FROM client c WHERE c.country_id = country.id), '[]') AS clients, "
    "coalesce((SELECT to_json(list(struct_pack(id := a.id, name := a.name) ORDER BY a.id))::varchar FROM area a WHERE a.id = country.area_id), '[]') AS areas FROM country",
)
def _(cat):
    df = get(cat, "/api/geo/countries")
    return as_json(df.withColumn("clients", F.transform("clients", lambda c: F.struct(c["id"].alias("id"), c["segment"].alias("segment")))), "clients", "areas")


@query("Q12_list_by_created", "SELECT id, client_id AS \"clientId\", status, total_price AS \"totalPrice\", created_at AS \"createdAt\" FROM purchase")
def _(cat):
    return get(cat, "/api/sales/purchases")


# -- request identification --------------------------------------------------------------------------------------
_ITEM_ID = "path LIKE '/api/catalog/items/%'"


@query("Q13_route_match", f"SELECT request_id, 'Matched' AS status, 'item' AS target, CASE WHEN {_ITEM_ID} THEN '/api/catalog/items/{{id}}' ELSE '/api/catalog/items' END AS route_path, CASE WHEN {_ITEM_ID} THEN split_part(path, '/', 5) END AS id FROM request_log")
def _(cat):
    out = routing.match_batch(cat["request_log"], ROUTES)
    return out.select("request_id", "status", "target", "route_path", F.element_at("params", F.lit("id")).alias("id"))


@query("Q14_prefix_match", f"SELECT request_id, 'item' AS \"table\", '/api/catalog/items' AS prefix, CASE WHEN {_ITEM_ID} THEN split_part(path, '/', 5) END AS id, NOT ({_ITEM_ID}) AS collection FROM request_log")
def _(cat):
    return routing.prefix_batch(cat["request_log"], PREFIXES).select("request_id", "table", "prefix", "id", "collection")


@query("Q15_ambiguous", f"SELECT CASE WHEN method <> 'GET' THEN 'NotFound' WHEN {_ITEM_ID} THEN 'Ambiguous' ELSE 'Matched' END AS status, count(*)::bigint AS n FROM request_log GROUP BY 1")
def _(cat):
    routes = [("GET", "/api/catalog/items", "item"), ("GET", "/api/catalog/items/{a}", "item"), ("GET", "/api/catalog/items/{b}", "other"), ("GET", "/api/{x}/items/{y}", "late")]
    return routing.match_batch(cat["request_log"], routes).groupBy("status").agg(F.count("*").alias("n"))


def many_routes(cat: Catalog) -> DataFrame:
    """Routes from tables: one for each client's path with its id spelled out, two with holes, one of them twice."""
    own = cat["client"].select(F.lit("get").alias("method"), F.concat(F.lit("/api/catalog/items/"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("client-"), F.col("id").cast("string")).alias("target"))
    rest = cat.spark.createDataFrame([("GET", "/api/catalog/items", "list"), ("PUT", "/api/catalog/items/{id}", "put"), ("GET", "/api/catalog/items/{id}", "get"), ("PATCH", "/api/catalog/{kind}/{id}", "a"), ("PATCH", "/api/catalog/{type}/{id}", "b")], "method string, path string, target string")
    return own.union(rest)


@query(
    "Q83_routes_from_tables",
    f"SELECT request_id, CASE WHEN {_ITEM_ID} AND method = 'PATCH' THEN 'Ambiguous' WHEN {_ITEM_ID} AND method IN ('GET', 'PUT') OR NOT ({_ITEM_ID}) AND method = 'GET' THEN 'Matched' ELSE 'NotFound' END AS status, "
    f"CASE WHEN NOT ({_ITEM_ID}) THEN CASE method WHEN 'GET' THEN 'list' END WHEN method = 'PUT' THEN 'put' WHEN method = 'GET' THEN coalesce('client-' || client.id, 'get') END AS target, "
    f"CASE WHEN {_ITEM_ID} AND (method = 'PUT' OR method = 'GET' AND client.id IS NULL) THEN split_part(path, '/', 5) END AS id FROM request_log LEFT JOIN client ON split_part(path, '/', 5) = client.id::varchar",
)
def _(cat):
    """As many routes as clients: literal segments win over holes, two equal shapes are ambiguous."""
    out = routing.match_table(cat["request_log"], many_routes(cat))
    return out.select("request_id", "status", "target", F.try_element_at("params", F.lit("id")).alias("id"))


@query("Q16_cache_flags", f"SELECT request_id, method <> 'GET' AS is_write, path = '/api/catalog/items/7' AS is_always_online, {_ITEM_ID} OR path = '/api/catalog/items' AS of_module, method <> 'GET' OR path LIKE '/api/catalog/items%' AS is_forbidden FROM request_log")
def _(cat):
    flags = routing.cache_flags(cat["request_log"], ["/api/catalog/items/7"], ["/api/catalog/items"])
    return flags.select("request_id", "is_write", "is_always_online", "of_module", "is_forbidden")


@query("Q17_duplicate_routes", "SELECT * FROM (VALUES ('GET', '/api/blogs/{}', 2::bigint)) t(method, shape, n)")
def _(cat):
    rows = [("get", "/api/blogs/{id}"), ("GET", "/api/blogs/{blogId}"), ("POST", "/api/blogs/{id}"), ("GET", "/api/blogs")]
    return routing.duplicate_routes(cat.spark.createDataFrame(rows, "method string, path string"))


@query("Q18_anti_declared", "SELECT DISTINCT client_id AS id FROM purchase p WHERE NOT EXISTS (SELECT 1 FROM client c WHERE c.id = p.client_id AND c.segment = 'BUILDING')")
def _(cat):
    return routing.undeclared(cat["purchase"].select(F.col("client_id").alias("id")), cat["client"].filter("segment = 'BUILDING'"), "id")


@query("Q19_param_precedence", "SELECT request_id, CASE WHEN path LIKE '/api/catalog/items/%' THEN split_part(path, '/', 5) WHEN k % 2 = 0 THEN 'q' || k ELSE 'b' || k END AS id, 'b' || k AS note FROM request_log")
def _(cat):
    k = F.col("k").cast("string")
    empty = F.expr("CAST(map() AS map<string, string>)")
    body = F.create_map(F.lit("id"), F.concat(F.lit("b"), k), F.lit("note"), F.concat(F.lit("b"), k))
    q = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("id"), F.concat(F.lit("q"), k))).otherwise(empty)
    p = F.when(F.col("path").like("/api/catalog/items/%"), F.create_map(F.lit("id"), F.element_at(F.split("path", "/"), -1))).otherwise(empty)
    m = params.merged_columns(body, q, p)
    return cat["request_log"].select("request_id", m["id"].alias("id"), m["note"].alias("note"))


# -- mutations ------------------------------------------------------------------------------------------------------
@query("Q20_insert_merge", "SELECT request_id AS id, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 7 = 0 THEN NULL ELSE 'body' END WHEN k % 3 = 0 THEN 'path' ELSE 'PROMO' END AS item_type FROM request_log WHERE method = 'POST'")
def _(cat):
    empty = F.expr("CAST(map() AS map<string, string>)")
    one = lambda v: F.create_map(F.lit("item_type"), v)
    body = F.when(F.col("k") % 2 == 0, one(F.when(F.col("k") % 7 != 0, "body"))).otherwise(empty)
    path = F.when(F.col("k") % 3 == 0, one(F.lit("path"))).otherwise(empty)
    row = mutations.presence_merge([body, path, one(F.lit("PROMO"))])
    return cat["request_log"].filter("method = 'POST'").select(F.col("request_id").alias("id"), F.element_at(row, "item_type").alias("item_type"))


def mutation_log(cat: Catalog, methods: list[str]) -> DataFrame:
    """request_log as mutations of 20 rows, with a base row of each at seq -1."""
    k = F.col("k").cast("string")
    empty = F.expr("CAST(map() AS map<string, string>)")
    name = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("name"), F.when(F.col("k") % 7 != 0, F.concat(F.lit("v"), k)))).otherwise(empty)
    size = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("pack_size"), k)).otherwise(empty)
    op = F.when(F.col("method") == "POST", "insert").when(F.col("method") == "DELETE", "delete").otherwise("update")
    full = F.create_map(F.lit("name"), F.concat(F.lit("ins"), k), F.lit("pack_size"), k)
    log = cat["request_log"].filter(F.col("method").isin(methods)).select(
        (F.col("client_id") % 20).alias("id"), F.col("request_id").alias("seq"), op.alias("op"), F.when(op == "insert", full).when(op == "update", F.map_concat(name, size)).otherwise(empty).alias("set")
    )
    base = cat.spark.range(20).select("id", F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), F.create_map(F.lit("name"), F.lit("base"), F.lit("pack_size"), F.lit("0")).alias("set"))
    return log.union(base)


def _log_ctes(methods: list[str]) -> str:
    listed = ", ".join(f"'{m}'" for m in methods)
    return f"""muts AS (
SELECT client_id % 20 AS id, request_id AS seq, CASE method WHEN 'POST' THEN 'insert' WHEN 'DELETE' THEN 'delete' ELSE 'update' END AS op,
  method = 'POST' OR (method <> 'DELETE' AND k % 2 = 0) AS has_name, CASE WHEN method = 'POST' THEN 'ins' || k WHEN k % 7 <> 0 THEN 'v' || k END AS name,
  method = 'POST' OR (method <> 'DELETE' AND k % 3 = 0) AS has_size, k::varchar AS size FROM request_log WHERE method IN ({listed})
UNION ALL SELECT range, -1, 'insert', true, 'base', true, '0' FROM range(20)),
born AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY id ORDER BY seq), 'delete') AS before FROM muts WHERE op IN ('insert', 'delete')),
span AS (SELECT id, max(seq) FILTER (WHERE op = 'insert' AND before = 'delete') AS since, max(seq) FILTER (WHERE op = 'delete') AS gone FROM born GROUP BY id),
living AS (SELECT m.* FROM muts m JOIN span s USING (id) WHERE s.since IS NOT NULL AND (s.gone IS NULL OR s.gone < s.since) AND (m.seq = s.since OR (m.seq > s.since AND m.op = 'update')))"""


_STATE = "SELECT id, (arg_max(struct_pack(v := name), seq) FILTER (WHERE has_name)).v AS name, (arg_max(struct_pack(v := size), seq) FILTER (WHERE has_size)).v AS pack_size FROM living GROUP BY id"


@query("Q21_update_state", _STATE, _log_ctes(["PUT", "PATCH"]))
def _(cat):
    return mutations.state(mutation_log(cat, ["PUT", "PATCH"]), ["name", "pack_size"])


@query("Q22_delete_state", "SELECT id, since, gone, (gone IS NULL OR gone < since) AS living FROM span", _log_ctes(["PUT", "PATCH", "DELETE"]))
def _(cat):
    log = mutation_log(cat, ["PUT", "PATCH", "DELETE"])
    gone = mutations.judged_inserts(log).groupBy("id").agg(F.max(F.when(F.col("valid"), F.col("seq"))).alias("since"), F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"))
    alive = mutations.state(log, ["name"]).select("id", F.lit(True).alias("living"))
    return gone.join(alive, "id", "left").select("id", "since", "gone", F.coalesce("living", F.lit(False)).alias("living"))


@query("Q23_reinsert_state", _STATE, _log_ctes(["POST", "PUT", "PATCH", "DELETE"]))
def _(cat):
    return mutations.state(mutation_log(cat, ["POST", "PUT", "PATCH", "DELETE"]), ["name", "pack_size"])


@query("Q24_pk_conflict", "SELECT id, seq FROM born WHERE op = 'insert' AND before = 'insert'", _log_ctes(["POST", "DELETE"]))
def _(cat):
    return mutations.rejected_inserts(mutation_log(cat, ["POST", "DELETE"])).select("id", "seq")


@query("Q25_returning_delete", "SELECT i.id, i.name FROM item i WHERE i.id IN (SELECT client_id FROM request_log WHERE method = 'DELETE')")
def _(cat):
    hits = cat["request_log"].filter("method = 'DELETE'").select(F.col("client_id").alias("id"))
    return mutations.returning_delete(cat["item"], hits).select("id", "name")


# -- journal, replay ---------------------------------------------------------------------------------------------------
@query("Q26_journal_pending", "SELECT 'req-' || request_id AS id, method, path FROM request_log WHERE method <> 'GET' AND NOT (http_status >= 200 AND http_status < 300)")
def _(cat):
    log = cat["request_log"].filter("method <> 'GET'").withColumn("id", F.concat(F.lit("req-"), "request_id"))
    return journal.pending(log, log.filter("http_status between 200 and 299"), order=("requested_at", "id")).select("id", "method", "path")


@query("Q27_tenant_lookup", "SELECT min(segment) AS tenant FROM client WHERE id = (SELECT min(id::varchar) FROM client WHERE segment IS NOT NULL)::bigint")
def _(cat):
    none = cat["item"].select("id", F.lit(None).cast("string").alias("tenant_id"))
    return mutations.first_tenant(none, [cat["client"].select("id", F.col("segment").alias("tenant_id")), cat["purchase"].select("id", F.col("status").alias("tenant_id"))])


_FOLD = """ordered AS (SELECT client_id, method, path, requested_at, row_number() OVER (PARTITION BY client_id, method, path ORDER BY requested_at, request_id) AS rn FROM request_log),
fold AS (SELECT *, requested_at AS last, 1 AS kept FROM ordered WHERE rn = 1
UNION ALL SELECT o.*, CASE WHEN o.requested_at - f.last >= INTERVAL 12 HOUR THEN o.requested_at ELSE f.last END, CASE WHEN o.requested_at - f.last >= INTERVAL 12 HOUR THEN 1 ELSE 0 END
FROM fold f JOIN ordered o ON o.client_id = f.client_id AND o.method = f.method AND o.path = f.path AND o.rn = f.rn + 1)"""


@query("Q28_dedup_window", "SELECT client_id, method, path, sum(kept)::bigint AS n FROM fold GROUP BY ALL", _FOLD, recursive=True)
def _(cat):
    kept = dedup.suppress(cat["request_log"], ["client_id", "method", "path"], "requested_at", "request_id", 12 * HOUR_US)
    return kept.groupBy("client_id", "method", "path").agg(F.count("*").alias("n"))


@query("Q29_dedup_zero", "SELECT client_id, count(*)::bigint AS n FROM request_log GROUP BY 1")
def _(cat):
    kept = dedup.suppress(cat["request_log"], ["client_id"], "requested_at", "request_id", 0)
    return kept.groupBy("client_id").agg(F.count("*").alias("n"))


@query("Q30_fingerprint", "SELECT request_id, sha256(method || chr(10) || path || chr(10) || CASE WHEN method = 'GET' THEN '-' ELSE length('{\"k\":' || k || '}')::varchar || chr(10) || '{\"k\":' || k || '}' END) AS fingerprint FROM request_log")
def _(cat):
    body = F.when(F.col("method") != "GET", F.to_json(F.struct("k")))
    return cat["request_log"].select("request_id", dedup.fingerprint(F.col("method"), F.col("path"), body).alias("fingerprint"))


_KIND = "CASE WHEN http_status BETWEEN 200 AND 299 THEN 'ok' WHEN http_status = 401 THEN 'reauth' WHEN http_status IN (408, 429) OR http_status >= 500 THEN 'retry' ELSE 'reject' END"


@query("Q31_classify", f"SELECT {_KIND} AS kind, count(*)::bigint AS n FROM request_log GROUP BY 1")
def _(cat):
    return cat["request_log"].groupBy(replay.classify(F.col("http_status")).alias("kind")).agg(F.count("*").alias("n"))


_PASS = f"""sends AS (SELECT *, {_KIND} AS kind FROM request_log),
stops AS (SELECT client_id, min((tx_id, request_id)) FILTER (WHERE kind IN ('retry', 'reauth')) AS stop FROM sends GROUP BY 1),
judged AS (SELECT s.*, stop IS NULL OR (tx_id, request_id) <= stop AS attempted, stop IS NULL OR tx_id < stop[1] AS completed FROM sends s JOIN stops USING (client_id))"""


def passed(cat: Catalog) -> DataFrame:
    return replay.outcomes(cat["request_log"].withColumn("seq", F.col("request_id")), "client_id")


@query("Q32_tx_outcome", "SELECT client_id, tx_id, count(*) FILTER (WHERE attempted)::bigint AS sent, bool_and(completed) AS completed FROM judged GROUP BY ALL", _PASS)
def _(cat):
    return passed(cat).groupBy("client_id", "tx_id").agg(F.count_if("attempted").alias("sent"), F.bool_and("completed").alias("completed"))


@query("Q33_head_of_line", "SELECT client_id, count(DISTINCT tx_id)::bigint AS blocked FROM judged WHERE NOT completed GROUP BY 1", _PASS)
def _(cat):
    return passed(cat).filter("not completed").groupBy("client_id").agg(F.countDistinct("tx_id").alias("blocked"))


@query(
    "Q34_reauth_latch",
    "SELECT request_id, coalesce(before = 'shut', false) AND NOT resume AS blocked FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marks)",
    f"marks AS (SELECT *, k % 25 = 24 AS resume, CASE WHEN k % 25 = 24 THEN 'open' WHEN {_KIND} = 'reauth' THEN 'shut' END AS mark FROM request_log)",
)
def _(cat):
    rows = cat["request_log"].withColumn("kind", replay.classify(F.col("http_status"))).withColumn("resume", F.col("k") % 25 == 24)
    return replay.latch(rows, "client_id", "request_id").select("request_id", "blocked")


@query("Q35_send_once", "SELECT tx_id, journal_id, min(request_id) AS request_id FROM (SELECT *, 'req-' || (request_id // 2) AS journal_id FROM request_log) GROUP BY ALL")
def _(cat):
    rows = cat["request_log"].withColumn("journal_id", F.concat(F.lit("req-"), F.expr("request_id div 2")))
    return replay.send_once(rows, seq="request_id").select("tx_id", "journal_id", "request_id")


def letters(cat: Catalog) -> DataFrame:
    bad = cat["request_log"].filter(replay.classify(F.col("http_status")) == replay.REJECT)
    bad = bad.select(F.col("client_id"), F.lit(None).cast("string").alias("operation_id"), F.lit("item").alias("table_name"), F.to_json(F.struct("k")).alias("data"), "http_status", F.lit("rejected").alias("reason"), F.col("request_id").alias("created_at"))
    return replay.latest_by_key(replay.dead_letters(bad), "id", "created_at")


_LETTERS = f"letters AS (SELECT client_id::varchar AS id, 'item' AS operation_id, '{{\"k\":' || arg_max(k, request_id) || '}}' AS payload, arg_max(http_status, request_id) AS code, 'rejected' AS reason, max(request_id) AS created_at FROM request_log WHERE {_KIND} = 'reject' GROUP BY client_id)"


@query("Q36_dead_letters", "SELECT * FROM letters", _LETTERS)
def _(cat):
    return letters(cat)


@query("Q37_dead_letter_count", "SELECT count(*)::bigint AS n FROM letters WHERE id::bigint % 3 <> 0", _LETTERS)
def _(cat):
    solved = cat["request_log"].filter("client_id % 3 = 0").select(F.col("client_id").cast("string").alias("id"))
    return activity.count_open(letters(cat), solved)


@query("Q38_activity_last200", "SELECT request_id, method FROM request_log ORDER BY request_id DESC LIMIT 200")
def _(cat):
    return activity.recent(cat["request_log"], "request_id").select("request_id", "method")


# -- schema derivation ----------------------------------------------------------------------------------------------------
@query("Q39_rename_collisions", "SELECT DISTINCT 's' || (id % 7) || '.' || brand AS source, CASE WHEN count(DISTINCT id % 7) OVER (PARTITION BY brand) > 1 THEN 's' || (id % 7) || '_' || brand ELSE brand END AS name FROM item".replace("count(DISTINCT id % 7) OVER (PARTITION BY brand)", "(SELECT count(DISTINCT j.id % 7) FROM item j WHERE j.brand = item.brand)"))
def _(cat):
    return rules.device_names(cat["item"].select(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"), F.lit("."), "brand").alias("source")))


@query("Q40_bucket_filter", "SELECT id, list_filter(['b' || (id % 5), 'team-' || (id % 3)], lambda x: x = 'b1' OR starts_with(x, 'team-2'))::varchar AS buckets FROM item WHERE id % 5 = 1 OR id % 3 = 2")
def _(cat):
    b = F.array(F.concat(F.lit("b"), (F.col("id") % 5).cast("string")), F.concat(F.lit("team-"), (F.col("id") % 3).cast("string")))
    kept = rules.bucket_filter(cat["item"].select("id", b.alias("buckets")), ["b1", "team-2*"])
    return kept.select("id", F.concat(F.lit("["), F.array_join("buckets", ", "), F.lit("]")).alias("buckets"))


@query(
    "Q41_column_merge",
    "SELECT 's.' || brand AS source, 'c' || (pack_size % 4) AS \"column\", min(id) AS nth, CASE WHEN pack_size % 4 = 0 THEN 'integer' WHEN pack_size % 4 = 1 THEN 'real' ELSE 'text' END AS type, list_sort(list(DISTINCT item_type))::varchar AS buckets FROM item GROUP BY brand, pack_size % 4",
)
def _(cat):
    col = F.concat(F.lit("c"), (F.col("pack_size") % 4).cast("string")).alias("column")
    cited = cat["item"].select(F.concat(F.lit("s."), "brand").alias("source"), col, F.col("id").alias("nth"), F.col("item_type").alias("bucket"))
    flags = F.when(F.col("column") == "c0", 4).when(F.col("column") == "c1", 8)
    known = cited.filter("column in ('c0', 'c1')").select("source", "column").distinct().withColumn("type", rules.type_column(flags))
    merged = rules.merge_buckets(cited, known)
    return merged.withColumn("buckets", F.concat(F.lit("["), F.array_join("buckets", ", "), F.lit("]")))


_RULES = """bucket_definitions:
  stock: {data: ["SELECT organization_id AS org, id FROM stock.stock_balance WHERE bucket.x = 1", "SELECT * FROM tag"]}
  made: {data: ["select count(x) from manufacturing.bill AS b limit 3"]}
"""


@query("Q42_rules_reader", "SELECT * FROM (VALUES ('stock', 'stock.stock_balance', 'organization_id>org,id>id'), ('stock', 'public.tag', NULL), ('made', 'manufacturing.bill', NULL)) t(bucket, source, columns)")
def _(cat):
    rows = [(c.bucket, c.source, None if c.columns is None else ",".join(f"{a}>{b}" for a, b in c.columns)) for c in rules.read_rules(_RULES)]
    return cat.spark.createDataFrame(rows, "bucket string, source string, columns string")


@query("Q43_crud_op", "SELECT CASE WHEN method IN ('PUT', 'DELETE') THEN method ELSE 'PATCH' END AS op, count(*)::bigint AS n FROM request_log GROUP BY 1")
def _(cat):
    return cat["request_log"].groupBy(replay.crud_op(F.lower("method")).alias("op")).agg(F.count("*").alias("n"))


@query("Q44_replay_metadata", "SELECT request_id, CASE WHEN k % 3 <> 0 THEN method END AS method, CASE WHEN k % 3 <> 0 THEN path END AS path FROM request_log")
def _(cat):
    text = replay.metadata_json(F.when(F.col("k") % 3 != 0, F.col("method")), F.col("path"), F.lit("op"))
    meta = replay.usable_metadata(text)
    return cat["request_log"].select("request_id", meta["method"].alias("method"), meta["path"].alias("path"))


@query("Q45_bridge_timeout", "SELECT k * 50 < 2000 AS in_time, count(*)::bigint AS n FROM request_log GROUP BY 1")
def _(cat):
    rows = cat["request_log"].withColumn("answered", F.expr("requested_at + make_dt_interval(0, 0, 0, k * 0.05)"))
    return dedup.answered_in_time(rows, "requested_at", "answered").groupBy("in_time").agg(F.count("*").alias("n"))


@query("Q46_snake_names", "SELECT id, lower(regexp_replace(replace(name, ' ', '') || 'IdOf', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name FROM item")
def _(cat):
    return cat["item"].select("id", naming.snake_column(F.concat(F.replace("name", F.lit(" "), F.lit("")), F.lit("IdOf"))).alias("name"))


@query("Q47_handler_agg", "SELECT item_id, min(quantity) AS capacity, count(*)::bigint AS lines FROM purchase_line GROUP BY 1")
def _(cat):
    ops = check_operations([{"operation_id": "capacity", "method": "GET", "path": "/api/production/capacity", "connectivity": "offline", "handle": "capacity"}])
    own = Registry()
    own.add("capacity", lambda spark, p: cat["purchase_line"].groupBy("item_id").agg(F.min("quantity").alias("capacity"), F.count("*").alias("lines")))
    return Engine(cat, DECLARATION, ops, own).run("GET", "/api/production/capacity?x=1")


# -- orders, with the place of each row ---------------------------------------------------------------------------------------
@query("Q48_list_order", "SELECT id, row_number() OVER (ORDER BY translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id) AS place FROM item")
def _(cat):
    """Names come in folded order; equal names are in order of id here only to have one answer."""
    rows = get(cat, "/api/catalog/items").orderBy(F.translate("name", naming.UPPER, naming.LOWER), "id")
    return reads.numbered(rows).select("id", "place")


@query("Q49_created_order", "SELECT place, created_at AS \"createdAt\" FROM (SELECT created_at, row_number() OVER (ORDER BY created_at DESC) AS place FROM purchase)")
def _(cat):
    return reads.numbered(get(cat, "/api/sales/purchases")).select("place", "createdAt")


@query("Q50_pending_order", "SELECT 'req-' || request_id AS id, row_number() OVER (ORDER BY requested_at, 'req-' || request_id) AS place FROM request_log WHERE method <> 'GET' AND NOT (http_status >= 200 AND http_status < 300)")
def _(cat):
    log = cat["request_log"].filter("method <> 'GET'").withColumn("id", F.concat(F.lit("req-"), "request_id"))
    rows = journal.pending(log, log.filter("http_status between 200 and 299"), order=("requested_at", "id"))
    return reads.numbered(rows).select("id", "place")


@query("Q51_issue_order", "SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM letters WHERE id::bigint % 3 <> 0", _LETTERS)
def _(cat):
    solved = cat["request_log"].filter("client_id % 3 = 0").select(F.col("client_id").cast("string").alias("id"))
    return reads.numbered(activity.open_issues(letters(cat), solved)).select("id", "place")


# -- the write path ----------------------------------------------------------------------------------------------------------------
def engine(cat: Catalog, path: str, times: list[str] | None = None) -> Engine:
    """An engine with its own journal and counted ids and times."""
    ids, clock = itertools.count(1), itertools.count(1)
    return Engine(cat, DECLARATION, [], Registry(), path, new_id=lambda: f"n{next(ids):03d}", now=lambda: f"2026-01-01T00:00:{next(clock):02d}Z", clock_ms=lambda: 0)


def marked(cat: Catalog) -> Catalog:
    """The catalog with a metadata column on items, as tables have it whose writes are to be replayed."""
    return Catalog(cat.spark, {**cat.tables, "item": cat["item"].withColumn("id", F.col("id").cast("string")).withColumn("_metadata", F.lit(None).cast("string"))})


def written(cat: Catalog) -> tuple[Catalog, DataFrame]:
    own = marked(cat)
    path = f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}"
    e = engine(own, path)
    e.run("POST", "/api/catalog/promos?from=app", {"name": "new", "packSize": 3, "nothing": 1})
    e.run("PUT", "/api/catalog/items/5", {"brand": "other", "name": None})
    e.run("PUT", "/api/catalog/items/5", {"name": None, "brand": "other"})  # the same request again
    e.run("DELETE", "/api/catalog/items/7")
    e.run("PATCH", "/api/catalog/items/n002", {"packSize": 4})
    return own, cat.spark.read.schema(journal.COLUMNS).parquet(path)


_WRITES = """(VALUES
('n001', 'POST', '/api/catalog/promos?from=app', 'n002', 'insert:_metadata=n001,id=n002,item_type=PROMO,name=new,pack_size=3'),
('n003', 'PUT', '/api/catalog/items/5', '5', 'update:_metadata=n003,brand=other,name='),
('n004', 'DELETE', '/api/catalog/items/7', '7', 'mark:_metadata=n004;delete:'),
('n005', 'PATCH', '/api/catalog/items/n002', 'n002', 'update:_metadata=n005,pack_size=4')) t(id, method, path, row_id, steps)"""


@query("Q52_write_journal", f"SELECT * FROM {_WRITES}")
def _(cat):
    """Composed writes: one row each with request and steps; an equal request inside the window writes nothing."""
    _, log = written(cat)
    pairs = lambda s: F.array_join(F.transform(F.array_sort(F.map_keys(s["set"])), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(s["set"], k), F.lit("")))), ",")
    return log.select("id", "method", "path", "row_id", F.array_join(F.transform("steps", lambda s: F.concat(s["op"], F.lit(":"), pairs(s))), ";").alias("steps"))


@query(
    "Q53_state_after_writes",
    "SELECT id::varchar AS id, CASE WHEN id = 5 THEN NULL ELSE name END AS name, CASE WHEN id = 5 THEN 'other' ELSE brand END AS brand, item_type, pack_size, CASE WHEN id = 5 THEN 'n003' END AS _metadata FROM item WHERE id <> 7 "
    "UNION ALL SELECT 'n002', 'new', NULL, 'PROMO', 4, 'n005'",
)
def _(cat):
    own, log = written(cat)
    return mutations.applied(own["item"], journal.mutations_of(log, "item")).drop("retail_price")


@query("Q54_delete_answer", "SELECT id::varchar AS id, name FROM item WHERE id = 7")
def _(cat):
    """What a DELETE answers: the row that goes."""
    return engine(marked(cat), f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}").run("DELETE", "/api/catalog/items/7").select("id", "name")


@query(
    "Q77_read_own_writes",
    "SELECT id::varchar AS id, CASE WHEN id = 5 THEN NULL ELSE name END AS name, CASE WHEN id = 5 THEN 'other' ELSE brand END AS brand, item_type AS \"itemType\", pack_size AS \"packSize\", retail_price AS \"retailPrice\" FROM item WHERE id <> 7 "
    "UNION ALL SELECT 'n002', 'new', NULL, 'PROMO', 4, NULL",
)
def _(cat):
    """A list read through the engine that wrote: inserted, updated, deleted and updated anew."""
    own, path = marked(cat), f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}"
    e = engine(own, path)
    e.run("POST", "/api/catalog/promos", {"name": "new", "packSize": 3})
    e.run("PUT", "/api/catalog/items/5", {"brand": "other", "name": None})
    e.run("DELETE", "/api/catalog/items/7")
    e.run("PATCH", "/api/catalog/items/n002", {"packSize": 4})
    return e.run("GET", "/api/catalog/items")


@query("Q78_refused_insert", "SELECT 'row' AS kind, id::varchar AS id, name FROM item WHERE id IN (5, 6) UNION ALL SELECT 'request', 'fresh', 'first' UNION ALL SELECT 'row', 'fresh', 'first'")
def _(cat):
    """An insert of an id that is there is refused, of a base row as of one just made, and leaves neither row nor request; so does a transaction that holds one."""
    e = engine(marked(cat), f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}")
    e.overlay.index("item")
    for body in ({"id": "5", "name": "again"}, {"id": "fresh", "name": "first"}, {"id": "fresh", "name": "second"}):
        with contextlib.suppress(mutations.MutationError):
            e.run("POST", "/api/catalog/promos", body)
    with contextlib.suppress(mutations.MutationError), e.transaction():
        e.run("PATCH", "/api/catalog/items/6", {"name": "lost"})
        e.run("POST", "/api/catalog/promos", {"id": "6", "name": "refused"})
    rows = e.overlay.table("item").filter(F.col("id").isin("5", "6", "fresh")).select(F.lit("row").alias("kind"), "id", "name")
    asked = journal.committed(cat.spark, e.overlay.log).select(F.lit("request"), "row_id", F.get_json_object("body", "$.name"))
    return rows.union(asked)


@query("Q79_one_millisecond", "SELECT id::varchar AS id, 'second' AS name, brand FROM item WHERE id = 5")
def _(cat):
    """Two updates in one millisecond, the later one with the smaller request id: the later one holds."""
    ids = iter(["z9", "a1"])
    e = engine(marked(cat), f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}")
    e.new_id, e.now = lambda: next(ids), lambda: "2026-01-01T00:00:00.000Z"
    for name in ("first", "second"):
        e.run("PATCH", "/api/catalog/items/5", {"name": name})
    return e.run("GET", "/api/catalog/items/5").select("id", "name", "brand")


_ON_ITEMS = _log_ctes(["POST", "PUT", "PATCH", "DELETE"]).replace("SELECT range, -1, 'insert', true, 'base', true, '0' FROM range(20)", "SELECT id, -1, 'insert', true, name, true, pack_size::varchar FROM item WHERE id < 20")


@query("Q80_snapshot_and_tail", f"SELECT id::varchar AS id, name, pack_size::int AS pack_size FROM ({_STATE}) UNION ALL SELECT id::varchar, name, pack_size FROM item WHERE id >= 20", _ON_ITEMS)
def _(cat):
    """All requests as two commits, the first of them folded into a snapshot: base table, snapshot and tail read as one."""
    own, log = marked(cat), cat["request_log"]
    op = F.when(F.col("method") == "POST", "insert").when(F.col("method") == "DELETE", "delete").otherwise("update")
    k = F.col("k").cast("string")
    empty = F.create_map().cast("map<string,string>")
    name = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("name"), F.when(F.col("k") % 7 != 0, F.concat(F.lit("v"), k)))).otherwise(empty)
    size = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("pack_size"), k)).otherwise(empty)
    values = F.when(op == "insert", F.create_map(F.lit("name"), F.concat(F.lit("ins"), k), F.lit("pack_size"), k)).when(op == "update", F.map_concat(name, size)).otherwise(empty)
    text = lambda c: F.col(c).cast("string")
    rows = log.filter("method <> 'GET'").select(
        "request_id", text("request_id").alias("id"), "method", "path", F.lit(None).cast("string").alias("body"), F.lpad(text("request_id"), 12, "0").alias("created_at"), F.lit("item").alias("table_name"),
        (F.col("client_id") % 20).cast("string").alias("row_id"), F.array(F.struct(op.alias("op"), values.alias("set"))).alias("steps"),
    )
    half = log.agg(F.max("request_id")).first()[0] // 2
    over = Overlay(own, CommitLog(cat.spark, f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}"))
    journal.append_table(rows.filter(F.col("request_id") <= half).drop("request_id"), over.log)
    over.compact()
    journal.append_table(rows.filter(F.col("request_id") > half).drop("request_id"), over.log)
    return over.table("item").select("id", "name", "pack_size")


_METADATA = "CASE k % 4 WHEN 0 THEN 'req-' || (request_id // 2) WHEN 1 THEN '{\"method\":\"' || method || '\",\"path\":\"' || path || '\"}' WHEN 2 THEN '' ELSE '{bad' END"


def journal_writes(cat: Catalog) -> DataFrame:
    """Writes that point at a journal of the even requests, carry metadata of their own, or neither."""
    log = cat["request_log"]
    meta = F.when(F.col("k") % 4 == 0, F.concat(F.lit("req-"), F.expr("request_id div 2"))).when(F.col("k") % 4 == 1, replay.metadata_json(F.col("method"), F.col("path"), F.lit(None).cast("string"))).when(F.col("k") % 4 == 2, "").otherwise("{bad")
    rows = log.select("request_id", "client_id", "k", meta.alias("metadata"), F.to_json(F.struct("k")).alias("data"))
    own = log.filter("request_id % 2 = 0").select(F.concat(F.lit("req-"), "request_id").alias("id"), "method", "path", F.when(F.col("method") == "POST", '{"full":1}').alias("body"))
    return journal.linked(rows, own)


_LINKED = f"writes AS (SELECT request_id, k, method, path, {_METADATA} AS metadata FROM request_log), kept AS (SELECT 'req-' || request_id AS jid, method AS jm, path AS jp FROM request_log WHERE request_id % 2 = 0), linked AS (SELECT w.*, j.* FROM writes w LEFT JOIN kept j ON w.metadata = j.jid)"


@query("Q55_journal_link", "SELECT request_id, jid AS journal_id, jm AS journal_method FROM linked", _LINKED)
def _(cat):
    return journal_writes(cat).select("request_id", "journal_id", "journal_method")


@query(
    "Q56_replay_request",
    "SELECT request_id, coalesce(jm, CASE WHEN k % 4 = 1 THEN method END) AS send_method, 'https://host' || coalesce(jp, CASE WHEN k % 4 = 1 THEN path END) AS url, CASE WHEN jm = 'POST' THEN '{\"full\":1}' WHEN jm IS NOT NULL OR k % 4 = 1 THEN '{\"k\":' || k || '}' END AS send_body, jid AS key FROM linked",
    _LINKED,
)
def _(cat):
    return replay.request_of(journal_writes(cat), "T", base="https://host/").select("request_id", "send_method", "url", "send_body", F.try_element_at("headers", F.lit("Idempotency-Key")).alias("key"))


# -- the interceptor over a table of requests ---------------------------------------------------------------------------------------
_JUDGED = """asked AS (SELECT request_id AS seq, requested_at AS t, method, path, CASE WHEN method = 'GET' THEN NULL ELSE k % 3 END AS body,
  CASE WHEN method = 'PUT' AND path LIKE '/api/catalog/items/%' THEN 'operation' WHEN client_id % 9 = 0 THEN 'server' ELSE 'entity' END AS source, CASE WHEN client_id % 9 = 0 THEN '/elsewhere' ELSE path END AS at_path FROM request_log),
known AS (SELECT * REPLACE (CASE WHEN at_path = '/elsewhere' THEN 'server' ELSE source END AS source) FROM asked),
numbered AS (SELECT *, row_number() OVER (PARTITION BY method, path, body ORDER BY t, seq) AS rn FROM known WHERE source <> 'server'),
fold AS (SELECT *, t AS last, seq AS answer FROM numbered WHERE rn = 1
UNION ALL SELECT o.*, CASE WHEN o.t - f.last >= (CASE WHEN o.source = 'operation' THEN INTERVAL 1 HOUR ELSE INTERVAL 6 HOUR END) THEN o.t ELSE f.last END,
  CASE WHEN o.t - f.last >= (CASE WHEN o.source = 'operation' THEN INTERVAL 1 HOUR ELSE INTERVAL 6 HOUR END) THEN o.seq ELSE f.answer END
FROM fold f JOIN numbered o ON o.method = f.method AND o.path = f.path AND o.body IS NOT DISTINCT FROM f.body AND o.rn = f.rn + 1)"""


@query(
    "Q57_intercepted",
    "SELECT seq, source, CASE source WHEN 'operation' THEN 'put_item' ELSE 'item' END AS target, answer AS by, CASE WHEN answer = seq THEN CASE WHEN method = 'GET' THEN 'request-handled' ELSE 'local-write' END END AS activity FROM fold UNION ALL SELECT seq, source, NULL, NULL, NULL FROM known WHERE source = 'server'",
    _JUDGED,
    recursive=True,
)
def _(cat):
    """Operation before entity, windows by operation, duplicates answered, the rest passed through. Bodies hold their keys in either order."""
    ops = check_operations([{"operation_id": "put_item", "method": "PUT", "path": "/api/catalog/items/{id}", "connectivity": "offline", "handle": "h", "dedup_window_ms": 3_600_000}])
    b = (F.col("k") % 3).cast("string")
    body = F.when(F.col("request_id") % 2 == 0, F.concat(F.lit('{"a":{"y":1,"x":'), b, F.lit('},"b":2}'))).otherwise(F.concat(F.lit('{"b":2,"a":{"x":'), b, F.lit(',"y":1}}')))
    rows = cat["request_log"].select(F.col("request_id").alias("seq"), F.col("requested_at").alias("at"), "method", F.when(F.col("client_id") % 9 == 0, "/elsewhere").otherwise(F.col("path")).alias("path"), F.when(F.col("method") != "GET", body).alias("body"))
    return intercept(rows, ops, ROUTES, {}, 6 * 3_600_000).select("seq", "source", "target", "by", "activity")


@query("Q58_decoded_segments", "SELECT request_id, 'Matched' AS status, 'a ' || k || '+' AS id FROM request_log")
def _(cat):
    rows = cat["request_log"].withColumn("path", F.concat(F.lit("/api/x%2Fy/%69tems/a%20"), F.col("k").cast("string"), F.lit("+?q=1"))).withColumn("method", F.lit("get"))
    out = routing.match_batch(rows, [("GET", "/api/{group}/items/{id}", "item")], decode=True)
    return out.select("request_id", "status", F.element_at("params", F.lit("id")).alias("id"))


@query("Q59_named_parameters", "SELECT id FROM item WHERE (pack_size < 20 OR pack_size = 20) AND item_type <> ':kind' AND brand <> 'none'")
def _(cat):
    """Named parameters bound by place: a name in a literal is none, one used twice comes twice."""
    sql, values = params.positional("SELECT id FROM {item} WHERE (pack_size < :size OR pack_size = :size) AND item_type <> ':kind' AND brand <> :brand -- :none", {"size": 20, "brand": "none"})
    return cat.spark.sql(sql, args=values, item=cat["item"])


@query("Q60_structure_flatten", "SELECT DISTINCT brand || '.' || item_type AS source, 'c' || (pack_size % 4) AS \"column\", CASE pack_size % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'integer' WHEN 2 THEN 'real' ELSE 'integer' END AS type FROM item")
def _(cat):
    flags = F.element_at(F.array(*map(F.lit, (0, 4, 8, 6))), (F.col("pack_size") % 4 + 1).cast("int"))
    column = F.struct(F.concat(F.lit("c"), (F.col("pack_size") % 4).cast("string")).alias("name"), flags.alias("sqlite_type"))
    tables = cat["item"].groupBy("brand", "item_type").agg(F.collect_set(column).alias("columns")).withColumn("tables", F.array(F.struct(F.col("item_type").alias("name"), "columns")))
    structure = tables.select(F.struct(F.array(F.struct(F.array(F.struct(F.col("brand").alias("name"), "tables")).alias("schemas"))).alias("connections")).alias("data"))
    return rules.flatten(structure)


@query("Q61_typed_letters", "SELECT id, code::int AS code, created_at + 1 AS next FROM letters", _LETTERS)
def _(cat):
    """Letters read back from text columns have numbers again."""
    text = letters(cat).select(*[F.col(c).cast("string").alias(c) for c in ("id", "operation_id", "payload", "code", "reason", "created_at")])
    return activity.typed(text).select("id", "code", (F.col("created_at") + 1).alias("next"))


@query("Q62_replay_flags", f"SELECT request_id, k % 2 = 0 AS is_replay, method <> 'GET' OR k % 2 = 0 OR {_ITEM_ID} AS is_forbidden FROM request_log")
def _(cat):
    rows = cat["request_log"].withColumn("mark", F.when(F.col("k") % 2 == 0, "1"))
    return routing.cache_flags(rows, [], ["/api/catalog/items/"], replay="mark").withColumn("own", F.col("path") == "/api/catalog/items").select("request_id", "is_replay", (F.col("is_forbidden") & ~(F.col("own") & (F.col("method") == "GET") & ~F.col("is_replay"))).alias("is_forbidden"))


# -- passes of the upload ---------------------------------------------------------------------------------------------------------------
_CODES = (200, 201, 401, 403, 408, 409, 422, 429, 500, 503)  # what the server answers, by the body


def answer(method: str, url: str, body: str | None, headers: dict[str, str]) -> int | None:
    return _CODES[json.loads(body)["k"] % 10]


def accept(method: str, url: str, body: str | None, headers: dict[str, str]) -> int | None:
    return 200


def uploads(cat: Catalog) -> DataFrame:
    """All requests as writes; every seventh value of k comes without usable metadata."""
    meta = F.when(F.col("k") % 7 != 0, replay.metadata_json(F.col("method"), F.col("path"), F.lit("op")))
    none = [F.lit(None).cast("string").alias(c) for c in ("journal_id", "journal_method", "journal_path")]
    return cat["request_log"].select(F.col("request_id").cast("string").alias("id"), "tx_id", F.col("request_id").alias("seq"), "client_id", meta.alias("metadata"), F.to_json(F.struct("k")).alias("data"), *none)


def uploaded(cat: Catalog, again: bool = False) -> tuple[str, DataFrame]:
    """(folder, answers) of one pass, or of a second one, in which the server takes everything."""
    path = f"{shared_folder(cat.spark)}/upload-{uuid.uuid4().hex}"
    answers = upload.one_pass(cat.spark, uploads(cat), answer, path, "first", stream="client_id")
    return path, upload.one_pass(cat.spark, uploads(cat), accept, path, "second", stream="client_id") if again else answers


_SENT = f"""sent AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'reject' ELSE {_KIND} END AS kind FROM request_log),
halts AS (SELECT client_id, min((tx_id, request_id, kind)) FILTER (WHERE kind IN ('retry', 'reauth')) AS stop FROM sent GROUP BY 1),
first AS (SELECT s.*, stop, stop IS NULL OR (tx_id, request_id) <= (stop[1], stop[2]) AS attempted, stop IS NULL OR tx_id < stop[1] AS done FROM sent s JOIN halts USING (client_id))"""


@query("Q63_upload_answers", "SELECT client_id::varchar AS stream, request_id AS seq, CASE WHEN k % 7 <> 0 THEN http_status END AS http_status, kind FROM first WHERE attempted", _SENT)
def _(cat):
    """What reaches the server: each client's requests in order, up to the first retry or reauth; unusable writes are rejected unsent."""
    return uploaded(cat)[1].select("stream", "seq", "http_status", "kind")


@query("Q64_upload_letters", "SELECT request_id::varchar AS id, CASE WHEN k % 7 <> 0 THEN http_status END AS http_status, k % 7 = 0 AS unsent FROM first WHERE done AND kind = 'reject'", _SENT)
def _(cat):
    """Dead letters of a pass: rejected writes of transactions that are through."""
    path, _ = uploaded(cat)
    return upload.letters(cat.spark, path, "first").select("id", "http_status", F.col("reason").startswith("no usable metadata").alias("unsent"))


@query("Q65_upload_activity", "SELECT 'dead-letter' AS type, request_id::varchar AS subject FROM first WHERE done AND kind = 'reject' UNION ALL SELECT 'reauth-required', client_id::varchar FROM halts WHERE stop[3] = 'reauth'", _SENT)
def _(cat):
    path, _ = uploaded(cat)
    return upload.activity(cat.spark, path, "first").select("type", "subject")


@query(
    "Q66_upload_second_pass",
    "SELECT client_id::varchar AS stream, coalesce(stop[3] = 'reauth', false) AS shut, count(*) FILTER (WHERE done OR stop[3] = 'retry')::bigint AS acked, count(*) FILTER (WHERE (done AND kind = 'reject') OR (stop[3] = 'retry' AND NOT done AND k % 7 = 0))::bigint AS rejected FROM first GROUP BY ALL",
    _SENT,
)
def _(cat):
    """A stream that met a retry goes on with what is left, one that met a reauth is shut until it is resumed."""
    return second_pass(cat, uploaded(cat, again=True)[0])


def second_pass(cat: Catalog, path: str) -> DataFrame:
    acks = upload.acknowledged(cat.spark, path)
    rows = uploads(cat).select("id", F.col("client_id").cast("string").alias("stream")).join(acks, "id", "left")
    shut = upload.shut_streams(cat.spark, path).withColumn("shut", F.lit(True))
    rows = rows.groupBy("stream").agg(F.count("kind").alias("acked"), F.count_if(F.col("kind") == replay.REJECT).alias("rejected"))
    return rows.join(shut, "stream", "left").select("stream", F.coalesce("shut", F.lit(False)).alias("shut"), "acked", "rejected")


@query(
    "Q81_epochs_twice",
    "SELECT client_id::varchar AS stream, coalesce(stop[3] = 'reauth', false) AS shut, count(*) FILTER (WHERE done OR stop[3] = 'retry')::bigint AS acked, count(*) FILTER (WHERE (done AND kind = 'reject') OR (stop[3] = 'retry' AND NOT done AND k % 7 = 0))::bigint AS rejected FROM first GROUP BY ALL",
    _SENT,
)
def _(cat):
    """Each epoch run twice, as after a failure, comes to what two epochs come to: what is acknowledged stays so and nothing is sent again."""
    path = f"{shared_folder(cat.spark)}/upload-{uuid.uuid4().hex}"
    for send, epoch in ((answer, "first"), (accept, "first"), (accept, "second"), (answer, "second")):
        upload.one_pass(cat.spark, uploads(cat), send, path, epoch, stream="client_id")
    return second_pass(cat, path)


# -- streams --------------------------------------------------------------------------------------------------------------------------
_STORE = "spark.sql.streaming.stateStore.providerClass"


def streamed(cat: Catalog, rows: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``f`` of a stream over ``rows`` has written once all of them are through."""
    path = f"{shared_folder(cat.spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/in")
    before = cat.spark.conf.get(_STORE, None)
    cat.spark.conf.set(_STORE, guards.PROVIDER)
    try:
        out = f(cat.spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        live = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        live.awaitTermination()
    finally:
        cat.spark.conf.unset(_STORE) if before is None else cat.spark.conf.set(_STORE, before)
    return cat.spark.read.schema(out.schema).parquet(f"{path}/out")


@query("Q67_guard_stream", "SELECT client_id, count(*)::bigint AS n FROM fold WHERE kept = 1 GROUP BY 1", _FOLD.replace(", method, path", "").replace(" AND o.method = f.method AND o.path = f.path", ""), recursive=True)
def _(cat):
    """The streaming guard lets the same requests pass as the batch fold."""
    rows = cat["request_log"].select("client_id", "requested_at", "request_id")
    kept = streamed(cat, rows, lambda live: guards.guard_stream(live, ["client_id"], "requested_at", "request_id", 12 * HOUR_US))
    return kept.groupBy("client_id").agg(F.count("*").alias("n"))


@query(
    "Q68_latch_stream",
    "SELECT request_id AS seq, coalesce(before = 'shut', false) AND NOT resume AS blocked FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marks)",
    f"marks AS (SELECT *, k % 25 = 24 AS resume, CASE WHEN k % 25 = 24 THEN 'open' WHEN {_KIND} = 'reauth' THEN 'shut' END AS mark FROM request_log)",
)
def _(cat):
    rows = cat["request_log"].select("client_id", F.col("request_id").alias("seq"), replay.classify(F.col("http_status")).alias("kind"), (F.col("k") % 25 == 24).alias("resume"))
    return streamed(cat, rows, lambda live: guards.latch_stream(live, "client_id")).select("seq", "blocked")


@query("Q84_recent_stream", "SELECT client_id, request_id AS seq, method AS value FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY request_id DESC) AS nth FROM request_log) WHERE nth <= 5")
def _(cat):
    """The five latest requests of each client, held by a stream over all of them in several batches."""
    rows = cat["request_log"].select("client_id", "request_id", "method").repartitionByRange(6, F.pmod(F.xxhash64("request_id"), F.lit(1000)))
    path = f"{shared_folder(cat.spark)}/changes-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/in")
    before = cat.spark.conf.get(_STORE, None)
    cat.spark.conf.set(_STORE, guards.PROVIDER)
    try:
        live = cat.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        changes = guards.recent_stream(live, "client_id", "request_id", "method", 5)
        keep = lambda batch, n: batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/out/n={n}")
        changes.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        cat.spark.conf.unset(_STORE) if before is None else cat.spark.conf.set(_STORE, before)
    return guards.held_rows(cat.spark.read.parquet(f"{path}/out"), "client_id").select("client_id", "seq", "value")


@query("Q85_rows_affected", "SELECT 'update' AS op, count(*)::bigint AS rows FROM item WHERE id IN (SELECT client_id % 20 FROM request_log WHERE method = 'PUT') UNION ALL SELECT 'delete', count(*) FROM item WHERE id IN (SELECT 20 + client_id % 20 FROM request_log WHERE method = 'DELETE')")
def _(cat):
    """What one commit of all updates and deletes has found in the table; ids that aren't there count nothing."""
    own = marked(cat)
    text = lambda c: F.col(c).cast("string")
    gone = F.col("method") == "DELETE"
    row_id = (F.col("client_id") % 20 + F.when(gone, 20).otherwise(0)).cast("string")
    step = F.struct(F.when(gone, "delete").otherwise("update").alias("op"), F.when(gone, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("brand"), F.lit("x"))).alias("set"))
    rows = cat["request_log"].filter(F.col("method").isin("PUT", "DELETE")).select(text("request_id").alias("id"), "method", "path", F.lit(None).cast("string").alias("body"), text("requested_at").alias("created_at"), F.lit("item").alias("table_name"), row_id.alias("row_id"), F.array(step).alias("steps"))
    over = Overlay(own, CommitLog(cat.spark, f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}"))
    return over.affected("item", journal.append_table(rows, over.log))


@query("Q86_outbox_stream", "SELECT client_id::varchar AS stream, request_id AS seq, CASE WHEN k % 7 <> 0 THEN http_status END AS http_status, kind, coalesce(done, false) AS done FROM first WHERE attempted", _SENT)
def _(cat):
    """The stateful upload answers what a pass over the same writes answers, and tells which transactions are through."""
    sent = streamed(cat, uploads(cat), lambda live: outbox.outbox_stream(live, answer, "client_id", wait_ms=None))
    return sent.select("stream", "seq", "http_status", "kind", "done")


@query("Q69_activity_stream", "SELECT CASE WHEN method = 'GET' THEN 'request-handled' ELSE 'local-write' END AS type, count(*)::bigint AS n FROM request_log GROUP BY 1")
def _(cat):
    """Activity rows reach a subscriber batch by batch."""
    path = f"{shared_folder(cat.spark)}/activity-{uuid.uuid4().hex}"
    kind = F.when(F.col("method") == "GET", "request-handled").otherwise("local-write")
    cat["request_log"].select(kind.alias("type"), F.col("requested_at").cast("string").alias("at"), F.create_map(F.lit("path"), "path").alias("detail")).write.parquet(f"{path}/events")
    activity.follow_events(cat.spark, f"{path}/events", lambda batch: batch.write.mode("append").parquet(f"{path}/seen"), f"{path}/checkpoint").awaitTermination()
    return activity.counts_by_type(cat.spark.read.parquet(f"{path}/seen"))


# -- bodies, answers, schema files ---------------------------------------------------------------------------------------------------
@query("Q70_cache_key", "SELECT request_id, path || CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '?a=' || k ELSE '?a=' || k || '&b=%3F' END AS key FROM request_log")
def _(cat):
    k = F.col("k").cast("string")
    query_ = F.when(F.col("k") % 4 == 0, "?_rsc=x").when(F.col("k") % 4 == 1, F.concat(F.lit("?_rsc=1&&a="), k)).otherwise(F.concat(F.lit("?a="), k, F.lit("&_rsc=y=z&b=%3F")))
    return cat["request_log"].select("request_id", http.without_param(F.concat("path", query_)).alias("key"))


@query("Q71_body_reader", "SELECT request_id, CASE k % 5 WHEN 0 THEN '{\"k\":' || k || '}' END AS value, CASE k % 5 WHEN 0 THEN '{\"k\": ' || k || '}' WHEN 1 THEN '{\"k\":' WHEN 2 THEN '[1]' END AS text FROM request_log")
def _(cat):
    """Parsed JSON beside the text; broken JSON and other types stay text, an empty body is none."""
    kind = F.col("k") % 5
    text = F.when(kind == 0, F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}"))).when(kind == 1, '{"k":').when(kind == 2, "[1]").when(kind == 3, "")
    rows = cat["request_log"].select("request_id", http.parsed_body(text, kind != 2).alias("b"))
    return rows.select("request_id", F.to_json("b.value").alias("value"), "b.text")


@query("Q72_envelopes", f"SELECT '/api/geo/areas/' || id AS url, to_json(struct_pack(ok := true, source := 'local', data := struct_pack(id := id, name := name)))::varchar AS answer FROM area UNION ALL SELECT '/api/geo/areas/x', '{{\"ok\":true,\"source\":\"local\",\"data\":null}}' UNION ALL SELECT '/api/geo/areas', to_json(struct_pack(ok := true, source := 'local', data := list(struct_pack(id := id, name := name, countries := (SELECT list(struct_pack(id := c.id, name := c.name, areaId := c.area_id) ORDER BY c.id) FROM country c WHERE c.area_id = area.id)) ORDER BY name)))::varchar FROM area")
def _(cat):
    """What a client gets for a row, a missing row and a list with nested children."""
    urls = ["/api/geo/areas", "/api/geo/areas/x", *(f"/api/geo/areas/{i}" for i in range(5))]
    found = [(u, reads.envelope(reads.response(*reads.read(cat, routing.resolve(DECLARATION, "GET", u))))) for u in urls]
    return cat.spark.createDataFrame([(u, json.dumps(e, separators=(",", ":"))) for u, e in found], "url string, answer string")


@query("Q73_insert_ids", "SELECT * FROM (VALUES ('n001', 'own', 'own'), ('n003', 'n004', '{\"id\": 5, \"name\": \"b\"}'), ('n005', 'n006', NULL)) t(id, row_id, other)")
def _(cat):
    """An id comes from the body only if it is text; every request has a row of its own in the journal, its body as it came. Two ids are drawn for each."""
    path = f"{shared_folder(cat.spark)}/journal-{uuid.uuid4().hex}"
    e = engine(marked(cat), path)
    for body in ({"id": "own", "name": "a"}, {"id": 5, "name": "b"}, None):
        e.run("POST", "/api/catalog/promos", body)
    log = cat.spark.read.schema(journal.COLUMNS).parquet(path)
    return log.select("id", "row_id", F.when(F.col("row_id") == "own", "own").otherwise(F.col("body")).alias("other"))


@query("Q74_schema_file", "SELECT DISTINCT replace(item_type, ' ', '_') AS \"table\", 'c' || (pack_size % 3) AS \"column\", CASE pack_size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'integer' ELSE 'real' END AS type FROM item UNION ALL SELECT 'draft', 'body', 'text'")
def _(cat):
    """A structure written as a schema file and read back; local tables survive a new derivation."""
    flags = F.element_at(F.array(*map(F.lit, (0, 4, 8))), (F.col("pack_size") % 3 + 1).cast("int"))
    column = F.struct(F.concat(F.lit("c"), (F.col("pack_size") % 3).cast("string")).alias("name"), flags.alias("sqlite_type"))
    tables = cat["item"].groupBy(F.replace("item_type", F.lit(" "), F.lit("_")).alias("name")).agg(F.collect_set(column).alias("columns"))
    structure = tables.select(F.array(F.struct(F.array(F.struct(F.lit("public").alias("name"), F.array(F.struct("name", "columns")).alias("tables"))).alias("schemas"))).alias("connections"))
    own = rules.flatten(structure)
    named = own.join(rules.device_names(own), "source").select("name", "column", "type")
    derived: dict[str, dict[str, str]] = {}
    for table, name, kind in named.collect():  # a row for each replicated column
        derived.setdefault(table, {})[name] = kind
    kept = rules.Schema.parse(rules.Schema({"old": {"x": "text"}}, {"draft": {"body": "text"}}).text())
    again = rules.Schema.parse(kept.renewed(derived).text())
    rows = [(t, c, k) for tables_ in (again.tables, again.local) for t, columns in tables_.items() for c, k in columns.items()]
    return cat.spark.createDataFrame(rows, "`table` string, `column` string, type string")


@query("Q75_admin_answers", "SELECT * FROM (VALUES ('good', 'balance:by_item'), ('refused', '401'), ('forbidden', '403'), ('failing', '500'), ('no rules', 'no active rules')) t(\"case\", answer)")
def _(cat):
    """Both admin requests; a refused token, a failing address and missing rules are told apart."""
    good = {"/schema": {"data": {"connections": []}}, "/diagnostics": {"data": {"active_sync_rules": {"content": "bucket_definitions: {by_item: {data: SELECT id FROM balance}}"}}}}

    def post(status: int, answers: dict):
        return lambda base, method, path, body, headers: (status, answers.get(path, {}))

    out = []
    for case, status, answers in (("good", 200, good), ("refused", 401, good), ("forbidden", 403, good), ("failing", 500, good), ("no rules", 200, {"/schema": good["/schema"]})):
        try:
            text = rules.ask_admin("https://admin", "token", post(status, answers))[1]
            out.append((case, ",".join(f"{c.source.removeprefix('public.')}:{c.bucket}" for c in rules.read_rules(text))))
        except rules.SchemaError as e:
            out.append((case, next((w for w in ("401", "403", "500", "no active rules") if w in str(e)), str(e))))
    return cat.spark.createDataFrame(out, "`case` string, answer string")


@query(
    "Q76_declared_paths",
    "SELECT * FROM (VALUES ('path', 1, '/api/geo/areas'), ('path', 2, '/api/geo/bare-areas'), ('path', 3, '/api/geo/areas/{id}'), ('path', 4, '/api/geo/countries'), ('path', 5, '/api/sales/clients'), ('path', 6, '/api/sales/clients-with-country'), ('path', 7, '/api/sales/pairs'), ('path', 8, '/api/catalog/items'), "
    "('path', 9, '/api/catalog/items/{id}'), ('path', 10, '/api/catalog/by-type/{type}'), ('path', 11, '/api/{locale}/typed/{type}'), ('path', 12, '/api/catalog/promos'), ('path', 13, '/api/sales/clients/{clientId}/purchases/{id}'), ('path', 14, '/api/sales/purchases'), ('path', 15, '/api/sales/purchases-by-area'), "
    "('table', 1, 'area'), ('table', 2, 'client'), ('table', 3, 'country'), ('table', 4, 'item'), ('table', 5, 'purchase')) t(kind, place, name)",
)
def _(cat):
    rows = [("path", i, p) for i, p in enumerate(DECLARATION.paths(), 1)] + [("table", i, t) for i, t in enumerate(DECLARATION.tables(), 1)]
    return cat.spark.createDataFrame(rows, "kind string, place int, name string")


# -- declarations and rules as tables ------------------------------------------------------------------------------------------------
def declared_tables(cat: Catalog) -> tuple[DataFrame, DataFrame]:
    """Prefixes and routes made of items, some of them wrong."""
    i, text = cat["item"], lambda c: F.col(c).cast("string")
    prefix = F.when(F.col("id") % 50 == 0, "x").when(F.col("id") % 50 == 1, "/").otherwise(F.concat(F.lit("/p/"), (F.col("id") % 700).cast("string")))
    prefixes = i.filter("id % 3 = 0").select(F.col("id").alias("place"), F.concat(F.lit("t"), text("id")).alias("table"), prefix.alias("prefix"))
    method = F.element_at(F.array(*map(F.lit, ("get", "POST", "", "BREW", "PUT"))), (F.col("id") % 5 + 1).cast("int"))
    path = F.when(F.col("id") % 40 == 7, "no/slash").otherwise(F.concat(F.lit("/p/"), (F.col("id") % 900).cast("string"), F.when(F.col("id") % 2 == 0, "/{id}").otherwise("")))
    routes = i.filter("id % 3 <> 0").select(F.col("id").alias("place"), F.concat(F.lit("t"), text("id")).alias("table"), method.alias("method"), path.alias("path"))
    return prefixes, routes


_DECLARED = """prefixes AS (SELECT id AS place, 't' || id AS "table", CASE id % 50 WHEN 0 THEN 'x' WHEN 1 THEN '/' ELSE '/p/' || (id % 700) END AS prefix FROM item WHERE id % 3 = 0),
routes AS (SELECT id AS place, 't' || id AS "table", ['get', 'POST', '', 'BREW', 'PUT'][id % 5 + 1] AS method, CASE WHEN id % 40 = 7 THEN 'no/slash' ELSE '/p/' || (id % 900) || CASE WHEN id % 2 = 0 THEN '/{id}' ELSE '' END END AS path FROM item WHERE id % 3 <> 0),
each AS (SELECT place, "table", path, unnest(CASE WHEN method = '' THEN ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'] ELSE [upper(method)] END) AS method FROM routes WHERE starts_with(path, '/')),
known AS (SELECT *, row_number() OVER (PARTITION BY method, path ORDER BY place) AS nth FROM each WHERE method <> 'BREW'),
good AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY place) AS nth FROM prefixes WHERE prefix NOT IN ('x', '/'))"""


@query(
    "Q87_declaration_faults",
    """SELECT 'bad prefix' AS fault, "table", prefix AS what FROM prefixes WHERE prefix IN ('x', '/') UNION ALL SELECT 'prefix twice', "table", prefix FROM good WHERE nth > 1 UNION ALL SELECT 'bad path', "table", path FROM routes WHERE path = 'no/slash'
    UNION ALL SELECT 'unknown method', "table", method || ' ' || path FROM each WHERE method = 'BREW' UNION ALL SELECT 'request twice', "table", method || ' ' || path FROM known WHERE nth > 1
    UNION ALL SELECT DISTINCT 'prefix covers', g."table", g.prefix || ' ' || k.path FROM good g JOIN known k ON g.nth = 1 AND k.nth = 1 AND g."table" <> k."table" AND (k.path = g.prefix OR starts_with(k.path, g.prefix || '/'))""",
    _DECLARED,
)
def _(cat):
    """Everything wrong with a declaration of as many rules as there are items."""
    out = declared.faults(*declared_tables(cat))
    return out.filter("fault <> 'prefix covers'").union(out.filter("fault = 'prefix covers'").distinct())


@query("Q88_declared_paths_of_tables", "SELECT 0 AS kind, min(place) AS first, prefix AS path FROM prefixes GROUP BY prefix UNION ALL SELECT 1, min(place), path FROM routes GROUP BY path", _DECLARED)
def _(cat):
    return declared.paths(*declared_tables(cat))


@query("Q89_declared_tables_of_tables", 'SELECT DISTINCT "table", row_number() OVER (ORDER BY "table") AS place FROM (SELECT "table" FROM prefixes UNION SELECT "table" FROM routes)', _DECLARED)
def _(cat):
    return reads.numbered(declared.tables(*declared_tables(cat)).orderBy("table"))


@query(
    "Q90_operation_faults",
    "SELECT 'missing' AS fault, id AS place FROM item WHERE id % 11 = 0 OR id % 13 = 0 UNION ALL SELECT 'connectivity', id FROM item WHERE id % 11 <> 0 AND id % 13 <> 0 AND id % 7 = 0 "
    "UNION ALL SELECT 'twice', id FROM (SELECT id, row_number() OVER (PARTITION BY id % 3, id % 400 ORDER BY id) AS nth FROM item WHERE id % 11 <> 0 AND id % 13 <> 0) WHERE nth > 1",
)
def _(cat):
    """An operation map of as many operations as items: the hole's name doesn't tell two requests apart."""
    text = lambda c: F.col(c).cast("string")
    name = F.when(F.col("id") % 11 != 0, F.concat(F.lit("op"), text("id")))
    path = F.when(F.col("id") % 13 == 0, "").otherwise(F.concat(F.lit("/o/"), (F.col("id") % 400).cast("string"), F.lit("/{h"), text("id"), F.lit("}")))
    method = F.element_at(F.array(*map(F.lit, ("get", "Put", "DELETE"))), (F.col("id") % 3 + 1).cast("int"))
    kind = F.when(F.col("id") % 7 == 0, "sometimes").when(F.col("id") % 2 == 0, "online").otherwise("offline")
    return declared.operation_faults(cat["item"].select(F.col("id").alias("place"), name.alias("operation_id"), method.alias("method"), path.alias("path"), kind.alias("connectivity")))


@query("Q91_handles", "SELECT request_id, method = 'GET' AND client_id % 5 = 0 OR client_id % 5 IN (1, 2) OR client_id % 5 = 3 AND method = 'PUT' AS handles FROM request_log")
def _(cat):
    """Operations, declared requests and prefixes: what any of them answers is handled."""
    ops = check_operations([{"operation_id": "ping", "method": "GET", "path": "/ops/{name}", "connectivity": "online", "handle": "h"}])
    path = F.element_at(F.array(*map(F.lit, ("/ops/%70ing?x=1", "/pre/fix", "/pre/fix/7", "/own/7", "/pre/fix/7/8"))), (F.col("client_id") % 5 + 1).cast("int"))
    rows = cat["request_log"].withColumn("path", path)
    return handled(rows, ops, [("PUT", "/own/{id}", "own")], {"/pre/fix": "item"}).select("request_id", "handles")


@query("Q92_assigned_ids", "SELECT request_id, CASE k % 4 WHEN 0 THEN 's' || k ELSE 'drawn-' || request_id END AS id FROM request_log")
def _(cat):
    """A row's id is the body's if it is text; numbers, missing ids and broken bodies get the drawn one."""
    k = F.col("k").cast("string")
    body = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"id":"s'), k, F.lit('"}'))).when(F.col("k") % 4 == 1, F.concat(F.lit('{"id":'), k, F.lit("}"))).when(F.col("k") % 4 == 2, '{"name":"x"}').otherwise("{broken")
    return cat["request_log"].select("request_id", mutations.assigned_id(body, F.concat(F.lit("drawn-"), F.col("request_id").cast("string"))).alias("id"))


@query("Q93_refused_writes", f"SELECT request_id, CASE WHEN {_ITEM_ID} THEN NULL WHEN method IN ('PUT', 'PATCH') THEN 'an update needs an id' WHEN method = 'DELETE' THEN 'a delete needs an id' END AS refusal FROM request_log")
def _(cat):
    """Updates and deletes of a collection name no row."""
    return routing.prefix_batch(cat["request_log"], PREFIXES).select("request_id", mutations.refusal(F.col("method"), F.col("id")).alias("refusal"))


@query(
    "Q94_bucket_queries",
    "SELECT id, CASE id % 3 WHEN 0 THEN 's' || (id % 9) || '.t' || id WHEN 1 THEN 'public.t' || id ELSE 's.t' || id END AS source, CASE WHEN id % 4 IN (2, 3) THEN NULL ELSE 'id=id,c' || (id % 5) || '=' || CASE WHEN id % 4 = 0 THEN 'x' ELSE 'c' || (id % 5) END END AS columns FROM item WHERE id % 6 <> 5",
)
def _(cat):
    """Bucket queries of all items: aliases, quotes, schemas, clauses that don't matter; stars and calls leave the columns to the structure."""
    n, text = F.col("id"), lambda c: c.cast("string")
    c5 = F.concat(F.lit("c"), text(n % 5))
    chosen = F.when(n % 4 == 0, F.concat(F.lit("t.id, "), c5, F.lit(' AS "x"'))).when(n % 4 == 1, F.concat(F.lit('"id",'), c5)).when(n % 4 == 2, "*").otherwise("id, lower(name) AS name")
    source = F.when(n % 3 == 0, F.concat(F.lit('db."s'), text(n % 9), F.lit('"."t'), text(n), F.lit('" AS t'))).otherwise(F.concat(F.when(n % 3 == 1, "t").otherwise("s.t"), text(n)))
    sql = F.when(n % 6 == 5, "DELETE FROM t").otherwise(F.concat(F.lit(" select "), chosen, F.lit("\n FROM "), source, F.when(n % 2 == 0, " WHERE a = 1 ORDER BY id").otherwise(""), F.lit(";")))
    rows = rules.read_queries(cat["item"].select("id", sql.alias("sql")))
    pairs = F.transform("columns", lambda c: F.concat(c["column"], F.lit("="), c["name"]))
    return rows.select("id", "source", F.array_join(pairs, ",").alias("columns"))


@query("Q95_custom_classifier", f"SELECT request_id, CASE http_status WHEN 403 THEN 'retry' WHEN 409 THEN 'ok' ELSE {_KIND} END AS kind FROM request_log")
def _(cat):
    """A classifier of one's own comes first; what it doesn't know is classified as usual."""
    own = lambda s: F.when(s == 403, replay.RETRY).when(s == 409, replay.OK)
    return cat["request_log"].select("request_id", replay.classify(F.col("http_status"), own).alias("kind"))


def _hear(error: dict) -> None:
    if error["k"] % 5 == 0:
        raise RuntimeError("a handler of its own trouble")


@query("Q96_error_handlers", "SELECT request_id, CASE WHEN k % 5 = 0 AND method <> 'GET' THEN 'failed' WHEN method IN ('PUT', 'POST') THEN 'own' ELSE 'default' END AS heard FROM request_log WHERE http_status IN (403, 409, 422)")
def _(cat):
    """Rejected writes by operation: their own handler, else the default one; a handler that fails breaks nothing."""
    own = replay.ErrorHandlers(lambda e: None if e["method"] == "GET" else _hear(e))
    for operation in ("PUT", "POST"):
        own.add(operation, _hear)
    rejected = cat["request_log"].filter(replay.classify(F.col("http_status")) == replay.REJECT).select("request_id", "method", "k", F.col("method").alias("operation_id"))
    return replay.dispatched(rejected, own).select("request_id", "heard")
