"""Which entity a request means: one request on the driver, or a whole DataFrame of requests.

Declarations are configuration, so a batch resolves against an array literal of routes inside one projection:
no join, no shuffle, whatever the number of requests. Among all routes that fit, the one whose holes come
latest wins, which is what walking a tree with literals first and backtracking finds: the smallest
pattern string with 0 for a literal and 1 for a hole. Two routes on the smallest pattern are ambiguous.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.declarations import Declaration, Route, hole, segments

MATCHED, NOT_FOUND, AMBIGUOUS = "Matched", "NotFound", "Ambiguous"


@dataclass(frozen=True)
class Resolved:
    """A request's table, its path parameters and the route (None under a prefix)."""

    table: str
    params: Mapping[str, str] = field(default_factory=dict)
    route: Route | None = None


def match(routes: Sequence[tuple[str, str, object]], method: str, parts: Sequence[str]) -> tuple[str, object | None, dict[str, str]]:
    """(status, target, params) of (method, path, target) routes for path segments."""
    best: tuple[str, list] = ("", [])
    for verb, path, target in routes:
        own = segments(path)
        if verb.upper() != method.upper() or len(own) != len(parts):
            continue
        holes = [hole(s) for s in own]
        if any(h is None and s != p for h, s, p in zip(holes, own, parts, strict=True)):
            continue
        pattern = "".join("0" if h is None else "1" for h in holes)
        if not best[1] or pattern < best[0]:
            best = (pattern, [])
        if pattern == best[0]:
            best[1].append((target, {h: p for h, p in zip(holes, parts, strict=True) if h is not None}))
    if not best[1]:
        return NOT_FOUND, None, {}
    if len(best[1]) > 1:
        return AMBIGUOUS, None, {}
    return MATCHED, *best[1][0]


def resolve(decl: Declaration, method: str, url: str) -> Resolved | None:
    """Declared requests first, as they are written; then the longest prefix, whose one further segment is a decoded id. Two further segments or more end the search."""
    parts = segments(urlsplit(url).path)
    status, route, params = match([(r.method, r.path, r) for r in decl.routes], method, parts)
    if status == MATCHED:
        return Resolved(route.table, params, route)
    for prefix in sorted(decl.prefixes, key=len, reverse=True):
        head = segments(prefix)
        if parts[: len(head)] == head:
            rest = parts[len(head) :]
            if len(rest) > 1:
                return None
            return Resolved(decl.prefixes[prefix], {"id": decoded(rest[0])} if rest else {})
    return None


def decoded(segment: str) -> str:
    """Percent-decoded, or the segment itself if that isn't possible."""
    try:
        return unquote(segment, errors="strict")
    except UnicodeDecodeError:
        return segment


def resolve_operation(operations: Sequence, method: str, url: str) -> tuple[object, dict[str, str]] | None:
    """An operation of the map: segments are decoded before matching, the query string doesn't count, ambiguity is no match."""
    parts = [decoded(s) for s in segments(urlsplit(url).path)]
    status, op, params = match([(o.method, o.path, o) for o in operations], method, parts)
    return (op, params) if status == MATCHED else None


_HOLE = r"(?s)^\{(.+)\}$"


def split_path(path: Column) -> Column:
    """Non-empty segments of a path, without its query string."""
    return F.filter(F.split(F.regexp_extract(path, r"^[^?#]*", 0), "/"), lambda s: s != "")


def decode_column(segment: Column) -> Column:
    """Percent-decoding that keeps + and leaves what can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def _route_map(routes: Sequence[tuple[str, str, str]]) -> Column:
    """Routes by method and number of segments, so that a request is held against the few that can fit."""
    rows: dict[str, list[Column]] = {}
    for i, (method, path, target) in enumerate(routes):
        own = segments(path)
        pattern = "".join("0" if hole(s) is None else "1" for s in own)
        names = [hole(s) or "" for s in own]
        rows.setdefault(f"{method.upper()} {len(own)}", []).append(F.struct(F.lit(pattern).alias("pattern"), F.lit(i).alias("nth"), F.lit(method).alias("method"), F.lit(path).alias("path"), F.lit(target).alias("target"), F.array(*map(F.lit, own)).alias("own"), F.array(*map(F.lit, names)).alias("names")))
    return F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.array(*v))])


def match_batch(requests: DataFrame, routes: Sequence[tuple[str, str, str]], method: str = "method", path: str = "path", decode: bool = False) -> DataFrame:
    """``requests`` with (status, target, route_path, params) for (method, path, target) routes; ``decode``: segments are percent-decoded before they are matched, as operations want it."""
    raw = split_path(F.col(path))
    requests = requests.withColumn("_parts", F.transform(raw, decode_column) if decode else raw)
    parts = F.col("_parts")

    def fits(r: Column) -> Column:
        same = F.forall(F.arrays_zip(r["own"].alias("a"), parts.alias("b"), r["names"].alias("n")), lambda z: (z["n"] != "") | (z["a"] == z["b"]))
        return same

    if not routes:
        none = F.lit(None).cast("string")
        return requests.drop("_parts").withColumn("status", F.lit(NOT_FOUND)).withColumn("target", none).withColumn("route_path", none).withColumn("params", F.lit(None).cast("map<string, string>"))
    own = F.try_element_at(_route_map(routes), F.concat(F.upper(F.col(method)), F.lit(" "), F.size(parts).cast("string")))
    found = F.filter(own, fits)  # null where no route has this method and size
    out = requests.withColumn("_found", found)
    out = out.withColumn("_found", F.filter("_found", lambda r: r["pattern"] == F.array_min(F.transform("_found", lambda x: x["pattern"]))))
    one = F.coalesce(F.size("_found"), F.lit(0)) == 1
    status = F.when(one, MATCHED).when(F.coalesce(F.size("_found"), F.lit(0)) <= 0, NOT_FOUND).otherwise(AMBIGUOUS)
    first = F.get("_found", F.lit(0))
    pairs = F.filter(F.arrays_zip(first["names"].alias("n"), parts.alias("v")), lambda z: z["n"] != "")
    out = out.withColumn("status", status).withColumn("target", F.when(one, first["target"])).withColumn("route_path", F.when(one, first["path"]))
    return out.withColumn("params", F.when(one, F.map_from_entries(pairs))).drop("_found", "_parts")


def match_table(requests: DataFrame, routes: DataFrame, method: str = "method", path: str = "path", decode: bool = False) -> DataFrame:
    """:func:`match_batch` with the routes in a table (method, path, target), however many there are.

    A request meets only routes that have its segments where they have no holes: it asks once for each shape (method, size, places of
    holes) that routes of its method and size have, by an equi-join on the literal segments. Each (method, path) is matched once.
    """
    own = F.filter(F.split("path", "/"), lambda s: s != "")
    names = F.transform(own, lambda s: F.regexp_extract(s, _HOLE, 1))
    pattern = F.array_join(F.transform(names, lambda n: F.when(n == "", "0").otherwise("1")), "")
    literal = F.array_join(F.transform(F.arrays_zip(own.alias("s"), names.alias("n")), lambda z: F.when(z["n"] == "", z["s"]).otherwise("")), "/")
    table = routes.select(F.upper("method").alias("_m"), pattern.alias("_pattern"), literal.alias("_literal"), names.alias("_names"), F.col("path").alias("route_path"), "target")
    shapes = table.select("_m", "_pattern").distinct().withColumn("_n", F.length("_pattern"))
    raw = split_path(F.col("_path"))
    asked = requests.select(F.upper(method).alias("_m"), F.col(path).alias("_path")).distinct()
    asked = asked.withColumn("_parts", F.transform(raw, decode_column) if decode else raw).withColumn("_n", F.size("_parts"))
    tried = asked.join(shapes, ["_m", "_n"])
    masked = F.transform("_parts", lambda s, i: F.when(F.substr(F.col("_pattern"), i + 1, F.lit(1)) == "0", s).otherwise(""))
    found = tried.withColumn("_literal", F.array_join(masked, "/")).join(table, ["_m", "_pattern", "_literal"])
    one = F.struct("target", "route_path", "_names", "_parts")
    per = found.groupBy("_m", "_path", "_pattern").agg(F.count("*").alias("_count"), F.min(one).alias("_route"))
    best = per.groupBy("_m", "_path").agg(F.min(F.struct("_pattern", "_count", "_route")).alias("_best"))
    alone = F.col("_best._count") == 1
    pairs = F.filter(F.arrays_zip(F.col("_best._route._names").alias("n"), F.col("_best._route._parts").alias("v")), lambda z: z["n"] != "")
    best = best.select(
        "_m", "_path", F.when(alone, MATCHED).otherwise(AMBIGUOUS).alias("status"), F.when(alone, F.col("_best._route.target")).alias("target"),
        F.when(alone, F.col("_best._route.route_path")).alias("route_path"), F.when(alone, F.map_from_entries(pairs)).alias("params"),
    )
    out = requests.withColumn("_m", F.upper(method)).withColumn("_path", F.col(path)).join(best, ["_m", "_path"], "left").drop("_m", "_path")
    return out.withColumn("status", F.coalesce("status", F.lit(NOT_FOUND))).select(*requests.columns, "status", "target", "route_path", "params")


def prefix_batch(requests: DataFrame, prefixes: Mapping[str, str], path: str = "path") -> DataFrame:
    """``requests`` with (table, prefix, id, collection) by the longest prefix: no further segment is the collection, one is a decoded id, more are nothing."""
    parts = split_path(F.col(path))
    rows = [F.struct(F.lit(-len(p)).alias("size"), F.lit(p).alias("prefix"), F.lit(t).alias("table"), F.array(*map(F.lit, segments(p))).alias("own")) for p, t in prefixes.items()]
    found = F.filter(F.array(*rows), lambda r: F.slice(parts, 1, F.size(r["own"])) == r["own"])
    out = requests.withColumn("_best", F.array_min(found)).withColumn("_rest", F.size(parts) - F.size(F.col("_best.own")))
    ok = F.col("_rest").isin(0, 1)
    out = out.withColumn("table", F.when(ok, F.col("_best.table"))).withColumn("prefix", F.when(ok, F.col("_best.prefix")))
    out = out.withColumn("id", F.when(F.col("_rest") == 1, decode_column(F.element_at(parts, -1)))).withColumn("collection", F.when(ok, F.col("_rest") == 0))
    return out.drop("_best", "_rest")


def cache_flags(requests: DataFrame, always_online: Sequence[str], module: Sequence[str], method: str = "method", path: str = "path", replay: str | None = None) -> DataFrame:
    """Flags for a response cache: writes, paths that are always online or of the module (a prefix ends at a slash), replays, and whether any of them forbids caching."""

    def under(prefixes: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | (F.col(path) == p) | F.col(path).startswith(p.rstrip("/") + "/")
        return out

    flags = requests.withColumn("is_write", ~F.upper(F.col(method)).isin("GET", "HEAD")).withColumn("is_always_online", under(always_online))
    flags = flags.withColumn("is_replay", F.coalesce(F.col(replay) == "1", F.lit(False)) if replay else F.lit(False)).withColumn("of_module", under(module))
    return flags.withColumn("is_forbidden", F.col("is_write") | F.col("is_always_online") | F.col("is_replay") | F.col("of_module"))


def duplicate_routes(routes: DataFrame) -> DataFrame:
    """(method, shape, n) of requests declared more than once, holes taken by position."""
    shape = F.regexp_replace("path", r"\{[^/]+\}", "{}")
    return routes.groupBy(F.upper("method").alias("method"), shape.alias("shape")).agg(F.count("*").alias("n")).filter("n > 1")


def undeclared(declared: DataFrame, replicated: DataFrame, on: str = "table_name") -> DataFrame:
    """Declared tables that are not replicated."""
    return declared.select(on).distinct().join(replicated.select(on), on, "left_anti")
