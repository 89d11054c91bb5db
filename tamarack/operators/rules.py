"""Table schemas from replication rules: bucket queries, the source's structure, names on the device."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: type flags of the source, tested in this order
FLAGS = ((4, "integer"), (8, "real"), (2, "text"))
_QUERY = re.compile(r"^\s*select\s+(.*?)\s+from\s+([\w.\"]+)(?:\s+(?:as\s+)?\w+)?", re.I | re.S)
_CLAUSE = re.compile(r"\s+(?:where|group\s+by|order\s+by|limit|having)\b.*$", re.I | re.S)
_ITEM = re.compile(r"^(?:\w+\.)?\"?(\w+)\"?(?:\s+as\s+\"?(\w+)\"?)?$", re.I)


def type_of(flags: int) -> str:
    return next((name for bit, name in FLAGS if flags & bit), "text")


def type_column(flags: Column) -> Column:
    out = F.lit("text")
    for bit, name in reversed(FLAGS):
        out = F.when(flags.bitwiseAND(F.lit(bit)) != 0, name).otherwise(out)
    return out


def qualify(name: str) -> str:
    """schema.table from the last two dotted parts, quotes off; ``public`` without a schema."""
    parts = [p.strip('"') for p in name.split(".")]
    return ".".join(parts[-2:]) if len(parts) > 1 else f"public.{parts[0]}"


@dataclass(frozen=True)
class Cited:
    """A table named in a bucket's query; ``columns`` is None where only the structure can tell."""

    bucket: str
    source: str
    columns: tuple[tuple[str, str], ...] | None


def read_query(bucket: str, sql: str) -> Cited | None:
    """SELECT list and table of one bucket query; filters and the rest don't matter. Anything but plain columns means all columns."""
    m = _QUERY.match(_CLAUSE.sub("", sql.strip().rstrip(";")))
    if not m:
        return None
    items = [i.strip() for i in m[1].split(",")]
    found = [_ITEM.match(i) for i in items]
    plain = None if any(f is None for f in found) else tuple((f[1], f[2] or f[1]) for f in found)
    return Cited(bucket, qualify(m[2]), plain)


def read_queries(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """:func:`read_query` of a column: ``queries`` with (source, columns), ``columns`` an array of (column, name), null where only the structure can tell; rows that are no such query go."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(sql), ";+$", ""), r"(?is)\s+(?:where|group\s+by|order\s+by|limit|having)\b.*$", "")
    whole = r'(?is)^\s*select\s+(.*?)\s+from\s+([\w."]+)(?:\s+(?:as\s+)?\w+)?'
    items = F.transform(F.split(F.regexp_extract(bare, whole, 1), ","), lambda i: F.trim(i))
    item = r'(?i)^(?:\w+\.)?"?(\w+)"?(?:\s+as\s+"?(\w+)"?)?$'
    own = F.transform(items, lambda i: F.struct(F.regexp_extract(i, item, 1).alias("column"), F.coalesce(F.nullif(F.regexp_extract(i, item, 2), F.lit("")), F.regexp_extract(i, item, 1)).alias("name")))
    parts = F.transform(F.split(F.regexp_extract(bare, whole, 2), r"\."), lambda p: F.btrim(p, F.lit('"')))
    source = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.concat(F.lit("public."), parts[0]))
    plain = F.forall(items, lambda i: i.rlike(item))
    return queries.filter(bare.rlike(whole)).withColumn("source", source).withColumn("columns", F.when(plain, own))


def read_rules(text: str) -> list[Cited]:
    """All tables that ``bucket_definitions`` or ``streams`` cite; entries that aren't text and empty buckets go."""
    data = yaml.safe_load(text) or {}
    out = []
    for bucket, spec in (data.get("bucket_definitions") or data.get("streams") or {}).items():
        spec = spec or {}
        queries = spec.get("data") or spec.get("queries") or spec.get("query") or []
        for q in [queries] if isinstance(queries, str) else queries:
            if isinstance(q, str) and (c := read_query(bucket, q)):
                out.append(c)
    return out


_CONNECTIONS = "array<struct<schemas: array<struct<name: string, tables: array<struct<name: string, columns: array<struct<name: string, sqlite_type: int>>>>>>>>"
STRUCTURE = f"connections {_CONNECTIONS}, data struct<connections: {_CONNECTIONS}>"


class SchemaError(ValueError):
    pass


def read_structure(spark, path: str) -> DataFrame:
    """A structure file (JSON)."""
    return spark.read.schema(STRUCTURE).option("multiLine", True).json(path)


def ask_admin(base: str, token: str, post: Callable[..., tuple[int, object]] | None = None) -> tuple[object, str]:
    """(structure, rules text) from an admin address: one POST for each. A refused token, an unreachable or failing address and missing rules are errors of their own."""
    from ..sources import http

    def call(path: str) -> dict:
        try:
            status, answer = (post or http.send)(base, "POST", path, {}, {"Authorization": f"Bearer {token}"})
        except http.NetworkError as e:
            raise SchemaError(f"{base} is unreachable ({e})") from e
        if status in (401, 403):
            raise SchemaError(f"{base} refused the token ({status})")
        if not 200 <= status < 300:
            raise SchemaError(f"{base}{path} answered {status}")
        inner = answer.get("data") if isinstance(answer, dict) else None
        return inner if isinstance(inner, dict) else answer if isinstance(answer, dict) else {}

    structure = call("/schema")
    rules = (call("/diagnostics").get("active_sync_rules") or {}).get("content")
    if not isinstance(rules, str) or not rules:
        raise SchemaError("no active rules: nothing is replicated, so no table can be declared")
    return structure, rules


def flatten(structure: DataFrame) -> DataFrame:
    """(source, column, type) from ``connections[].schemas[].tables[].columns[]``, also inside ``data``; levels that are missing, in a row or everywhere, yield nothing."""
    whole = structure.select(F.from_json(F.to_json(F.struct("*")), STRUCTURE).alias("r")) if structure.columns else structure.select(F.lit(None).cast(f"struct<connections: {_CONNECTIONS}, data: struct<connections: {_CONNECTIONS}>>").alias("r"))
    s = whole.select(F.explode(F.coalesce("r.data.connections", "r.connections")).alias("c")).select(F.explode("c.schemas").alias("s"))
    t = s.select(F.coalesce("s.name", F.lit("public")).alias("schema"), F.explode("s.tables").alias("t"))
    c = t.select(F.concat_ws(".", "schema", "t.name").alias("source"), F.explode("t.columns").alias("c"))
    return c.select("source", F.col("c.name").alias("column"), type_column(F.col("c.sqlite_type").cast("int")).alias("type"))


def device_names(sources: DataFrame, source: str = "source") -> DataFrame:
    """(source, name): the bare table name, or schema_table where two sources share it."""
    one = sources.select(source).distinct().withColumn("bare", F.element_at(F.split(F.col(source), r"\."), -1))
    n = F.count("*").over(Window.partitionBy("bare"))
    return one.withColumn("n", n).select(source, F.when(F.col("n") > 1, F.replace(F.col(source), F.lit("."), F.lit("_"))).otherwise(F.col("bare")).alias("name"))


def merge_buckets(cited: DataFrame, structure: DataFrame) -> DataFrame:
    """(source, column, type, buckets): each source's columns from all buckets, the first naming wins; types from the structure, text where it has none."""
    own = cited.groupBy("source", "column").agg(F.min("nth").alias("nth"), F.array_sort(F.collect_set("bucket")).alias("buckets"))
    return own.join(structure, ["source", "column"], "left").select("source", "column", "nth", F.coalesce("type", F.lit("text")).alias("type"), "buckets")


def bucket_filter(tables: DataFrame, wanted: list[str]) -> DataFrame:
    """Tables of the wanted buckets (a trailing * is a prefix, no wish means all), their bucket lists cut down too."""
    if not wanted:
        return tables

    def fits(b: Column) -> Column:
        out = F.lit(False)
        for w in wanted:
            out = out | (b.startswith(w[:-1]) if w.endswith("*") else b == w)
        return out

    return tables.withColumn("buckets", F.filter("buckets", fits)).filter(F.size("buckets") > 0)


@dataclass
class Schema:
    """Replicated tables (name -> column -> type) and local ones, which survive a new derivation."""

    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    local: dict[str, dict[str, str]] = field(default_factory=dict)

    def text(self) -> str:
        """The same text for the same schema: everything sorted by name."""
        order = lambda t: {k: dict(sorted(t[k].items())) for k in sorted(t)}
        return json.dumps({"tables": order(self.tables), "localTables": order(self.local)}, indent=2) + "\n"

    @classmethod
    def parse(cls, text: str) -> Schema:
        """Strict: a file that is no JSON, has no tables or a column without a known type is refused."""
        try:
            data = json.loads(text)
        except ValueError as e:
            raise SchemaError(f"not JSON: {e}") from e
        if not isinstance(data, dict) or not isinstance(data.get("tables"), dict):
            raise SchemaError("no tables")
        own = {"tables": data["tables"], "localTables": data.get("localTables", {})}
        known = {name for _, name in FLAGS}
        for kind, tables in own.items():
            if not isinstance(tables, dict):
                raise SchemaError(f"{kind} is no mapping")
            for table, columns in tables.items():
                if not isinstance(columns, dict) or any(t not in known for t in columns.values()):
                    raise SchemaError(f"{kind}.{table}: columns are names with one of {', '.join(sorted(known))}")
        return cls(own["tables"], own["localTables"])

    def renewed(self, tables: dict[str, dict[str, str]]) -> Schema:
        return Schema(tables, self.local)
