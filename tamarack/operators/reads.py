"""Composed reads: a resolved request becomes one Spark SQL query over the catalog's DataFrames.

Filters are bound parameters and reach the Parquet scan; nested children are correlated subqueries that
Catalyst turns into one aggregate and a left join.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.naming import LOWER, UPPER, checked, to_camel, to_snake
from ..sources.catalog import Catalog, shared_folder
from ..sources.declarations import hole, segments
from . import bands
from .params import names_in
from .routing import Resolved

_JOIN = re.compile(r"^\s*((?:LEFT|RIGHT|FULL|INNER|CROSS)?(?:\s+OUTER)?\s*JOIN)\s+(\w+)(?:\s+(?:AS\s+)?(?!ON\b|USING\b)(\w+))?\s*((?:ON|USING)\b.*)?$", re.I | re.S)


def holes_of(resolved: Resolved) -> list[str]:
    if resolved.route is None:
        return list(resolved.params)
    return [h for h in map(hole, segments(resolved.route.path)) if h]


def id_hole(resolved: Resolved) -> str | None:
    """The hole that carries the row's id: of those not mapped to a column the one named id, else the last."""
    mapped = resolved.route.params if resolved.route else {}
    free = [h for h in holes_of(resolved) if h not in mapped]
    return None if not free else "id" if "id" in free else free[-1]


def filters_of(resolved: Resolved, columns: list[str]) -> dict[str, str]:
    """column -> hole of all holes but the id's; holes that name no column are ignored."""
    mapped = resolved.route.params if resolved.route else {}
    own = id_hole(resolved)
    pairs = {mapped.get(h) or to_snake(h): h for h in holes_of(resolved) if h != own}
    return {c: h for c, h in pairs.items() if c in columns}


def compose(catalog: Catalog, resolved: Resolved) -> tuple[str, dict[str, object], dict[str, DataFrame], bool]:
    """(Spark SQL, arguments, tables, whether one row is meant)."""
    root = checked(resolved.table)
    route = resolved.route
    columns = [checked(c) for c in catalog.columns(root) if c != "_metadata"]
    used = {root: catalog[root]}
    joins, ons = [], []
    for text in route.joins if route else ():
        m = _JOIN.match(text)
        if not m:
            raise ValueError(f"not a join clause: {text!r}")
        on, name = m[4] or "", m[3] or m[2]
        used[m[2]] = used[m[2]] if m[2] in used else catalog[m[2]]
        on = _banded(used, root, m[1], m[2], name, on)
        ons.append((m[2], name, m[4] or "", on))
        joins.append(f"{m[1]} {{{m[2]}}} {name} {on}")
    dot = f"{root}." if joins else ""
    if route and route.select:
        items = [route.select]
    else:
        items = [f"{dot}{c} AS {to_camel(c)}" for c in columns]
    for a in route.aggregates if route else ():
        child = [c for c in catalog.columns(a.table) if c != "_metadata"]
        used[a.table] = catalog[a.table]
        fields = ", ".join(f"'{to_camel(c)}', {checked(a.table)}.{checked(c)}" for c in child)
        # no children: an empty array; order is fixed so that results are repeatable
        items.append(f"(SELECT array_sort(collect_list(named_struct({fields}))) FROM {{{a.table}}} {a.table} WHERE {a.on}) AS {checked(a.field)}")
    where, args = [], {}
    own = id_hole(resolved)
    for column, h in ([("id", own)] if own else []) + list(filters_of(resolved, columns).items()):
        kind = used[root].schema[column].dataType.simpleString()
        where.append(f"{root}.{column} = try_cast(:{h} AS {kind})")  # an id that isn't one finds nothing
        args[h] = resolved.params[h]
    sql = f"SELECT {', '.join(items)} FROM {{{root}}} {root} {' '.join(joins)}"
    if where:
        sql += f" WHERE {' AND '.join(where)}"
    if own is None:
        key, down = (f"translate({root}.name, '{UPPER}', '{LOWER}')", "") if "name" in columns else (f"{root}.created_at", " DESC") if "created_at" in columns else (None, "")
        blocked = _blocked(used, root, ons[0][:3], items[0], where, key, down) if key and len(ons) == len(items) == 1 and bands.LEVEL in ons[0][3] else None
        if blocked is not None:
            sql, used = blocked
        elif key:
            sql += f" ORDER BY {key}{down}"
    for name in names_in(sql.replace("{", "").replace("}", "")):
        if name not in args:
            if name not in resolved.params:
                raise ValueError(f"no value for :{name}")
            args[name] = resolved.params[name]
    return sql, args, used, own is not None


def _banded(used: dict[str, DataFrame], root: str, how: str, table: str, name: str, on: str) -> str:
    """The clause of an inner join; where it is a band between the root and this table, both get bins and the clause compares these too."""
    band = bands.clause(on)
    if band is None or table == root or " ".join(how.upper().split()) not in ("JOIN", "INNER JOIN"):
        return on
    sides = bands.aliases(band[0]), bands.aliases(*band[1:])
    if sides not in (({root}, {name}), ({name}, {root})) or any(c in used[t].columns for t in (root, table) for c in (bands.LEVEL, bands.BIN)):
        return on
    frames = {root: used[root].alias(root), name: used[table].alias(name)}
    point, interval = next(iter(sides[0])), next(iter(sides[1]))
    kinds = [frames[t].select(F.expr(e)).schema[0].dataType for t, e in ((point, band[0]), (interval, band[1]), (interval, band[2]))]
    if not all(isinstance(k, NumericType) for k in kinds):
        return on
    got = bands.binned(frames[point], F.expr(band[0]), frames[interval], F.expr(band[1]), F.expr(band[2]))
    used[root], used[table] = got if point == root else got[::-1]
    return f"{on} AND {root}.{bands.LEVEL} = {name}.{bands.LEVEL} AND {root}.{bands.BIN} = {name}.{bands.BIN}"


def read(catalog: Catalog, resolved: Resolved) -> tuple[DataFrame, bool]:
    """The rows a GET means, and whether it means one row (then at most one comes)."""
    sql, args, used, single = compose(catalog, resolved)
    df = catalog.spark.sql(sql, args=args or None, **used)
    return (df.limit(1) if single else df), single


def numbered(df: DataFrame) -> DataFrame:
    """A sorted ``df`` with ``place`` from 1: its range partitions are written once into the shared folder and their sizes added up, so no row meets all others in one task."""
    spark = df.sparkSession
    held = df.withColumn("_at", F.monotonically_increasing_id())
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    held.write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    first = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", first.alias("first"))
    rows = held.withColumn("part", part).join(F.broadcast(sizes), "part")
    return rows.withColumn("place", F.col("first") + F.col("_at") - F.shiftleft(F.col("part"), 33) + 1).select(*df.columns, "place")


def response(df: DataFrame, single: bool) -> object:
    """What a client gets: a list of rows, or the row or None."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return (rows[0] if rows else None) if single else rows


def lenient_json(value: object) -> object:
    """Text that starts like an object or array is parsed; what doesn't parse stays text."""
    if isinstance(value, str) and value[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def payload(value: object) -> object:
    """Keys to camel case all the way down; parsed JSON text is taken as it is."""
    from ..functions.naming import to_camel_key

    if isinstance(value, Mapping):
        return {to_camel_key(k): payload(v) for k, v in value.items()}
    if isinstance(value, list):
        return [payload(v) for v in value]
    return lenient_json(value)


def envelope(entity: object) -> dict[str, object]:
    return {"ok": True, "source": "local", "data": payload(entity) if entity else None}


def _blocked(used: dict[str, DataFrame], root: str, join: tuple[str, str, str], select: str, where: list[str], key: str, down: str) -> tuple[str, dict[str, DataFrame]] | None:
    """The same rows in the same order from sorted blocks (:func:`bands.blocks`), whose rows go by the tables' names; None where the text names a column without its table."""
    table, name, on = join
    if name == root:
        return None
    on = re.sub(r"^\s*ON\s", "", on, flags=re.I)
    text = re.sub(r"'[^']*'", "''", " ".join([select, on, *where]))
    free = re.sub(r"\b[A-Za-z_]\w*\s*\.\s*(\w+|\*)|\bAS\s+\w+", " ", text, flags=re.I)
    told = lambda c, where_: re.search(rf"\b{re.escape(c)}\b", where_, re.I)
    sides = []
    for t, a in ((root, root), (table, name)):
        columns = [c for c in used[t].columns if c not in (bands.LEVEL, bands.BIN)]
        if any(told(c, free) for c in columns):
            return None
        every = re.search(rf"\b{a}\s*\.\s*\*", text, re.I)
        sides.append((used[t], a, [c for c in columns if every or told(c, text)]))
    blocks = bands.blocks(*sides[0], F.expr(key), *sides[1])
    lateral = " ".join(f"LATERAL VIEW explode(_{a}s) AS {a}" for a in (root, name))
    return f"SELECT {select} FROM (SELECT * FROM {{blocks}} ORDER BY {bands.ORDER}{down}) {lateral} WHERE {' AND '.join([f'({on})', *where])}", {"blocks": blocks}
