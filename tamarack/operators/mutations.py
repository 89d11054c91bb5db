"""Mutations: what one write means, and the state of entities after a journal of writes.

A mutation is a journal row (id, seq, op, set): ``set`` maps a column to its new value, a null value is an
explicit null, a missing key leaves the column alone. State is a grouped fold, not a MERGE:
for each id the last valid insert opens a segment, the row lives if no delete follows it, and each column has
the latest value present in the segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import checked, to_snake

RESERVED = ("id", "tenant_id", "created_at", "updated_at", "_metadata")


class MutationError(ValueError):
    pass


def body_columns(body: Mapping | None, columns: Sequence[str]) -> dict[str, object]:
    """Writable columns of a body: snake-cased, known, scalar, not reserved; of two keys for a column the later wins."""
    out: dict[str, object] = {}
    for k, v in (body or {}).items():
        c = to_snake(k)
        if c in columns and c not in RESERVED and (v is None or isinstance(v, str | int | float | bool)):
            out[c] = v
    return out


def insert(columns: Sequence[str], body: Mapping | None, path: Mapping[str, object], defaults: Mapping[str, object], row_id: str, now: str, tenant: str | None = None, metadata: str | None = None) -> dict[str, object]:
    """The row a POST writes: body over path over defaults; an id from the body only if it is text."""
    given = (body or {}).get("id")
    row: dict[str, object] = {"id": given if isinstance(given, str) else row_id, **body_columns(body, columns)}
    for source in ({to_snake(k): v for k, v in path.items()}, dict(defaults)):
        for c, v in source.items():
            if c in columns and c not in RESERVED:
                row.setdefault(c, v)
    for c, v in (("tenant_id", tenant), ("created_at", now), ("updated_at", now), ("_metadata", metadata)):
        if c in columns and not (c in ("tenant_id", "_metadata") and v is None):
            row[c] = v
    return row


def update(columns: Sequence[str], body: Mapping | None, row_id: str | None, now: str, metadata: str | None = None) -> dict[str, object]:
    """The columns a PUT or PATCH sets on the row of that id alone."""
    if row_id is None:
        raise MutationError("an update needs an id")
    out = body_columns(body, columns)
    for c, v in (("updated_at", now), ("_metadata", metadata)):
        if c in columns and v is not None:
            out[c] = v
    if not out:
        raise MutationError("nothing to write")
    return out


def delete(columns: Sequence[str], row_id: str | None, metadata: str | None = None) -> list[tuple[str, dict[str, object]]]:
    """The steps of a DELETE: a mark that leaves the request's id on the row, where the table can hold it, then the delete, which carries nothing."""
    if row_id is None:
        raise MutationError("a delete needs an id")
    mark = [("mark", {"_metadata": metadata})] if "_metadata" in columns and metadata is not None else []
    return [*mark, ("delete", {})]


def assigned_id(body: Column, drawn: Column) -> Column:
    """The id of an inserted row: that of the body (JSON text) if it is text, else the drawn one."""
    own = F.variant_get(F.try_parse_json(body), "$.id", "variant")
    return F.coalesce(F.when(F.schema_of_variant(own) == "STRING", F.variant_get(F.try_parse_json(body), "$.id", "string")), drawn)


def refusal(method: Column, row_id: Column) -> Column:
    """Why a write of a table can't be composed, null if it can: a method that isn't known, an update or delete without an id."""
    kind = F.upper(method)
    return F.when(~kind.isin("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE") | kind.isNull(), "unknown method").when(kind.isin("PUT", "PATCH") & row_id.isNull(), "an update needs an id").when((kind == "DELETE") & row_id.isNull(), "a delete needs an id")


def kind_of(method: str) -> str:
    kinds = {"GET": "read", "HEAD": "read", "POST": "insert", "PUT": "update", "PATCH": "update", "DELETE": "delete"}
    if method.upper() not in kinds:
        raise MutationError(f"unknown method {method}")
    return kinds[method.upper()]


def presence_merge(layers: Sequence[Column]) -> Column:
    """One map of maps with earlier layers over later ones; a key that is there with a null value counts as given."""
    out = layers[0]
    for below in layers[1:]:
        out = _over(out, below)
    return out


def _over(top: Column, below: Column) -> Column:
    return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(top, k)), top)


def judged_inserts(log: DataFrame) -> DataFrame:
    """``log(id, seq, op)`` with ``valid``: an insert is rejected while its row exists."""
    born = log.filter(F.col("op").isin("insert", "delete"))
    before = F.lag("op").over(Window.partitionBy("id").orderBy("seq"))
    born = born.withColumn("valid", (F.col("op") == "insert") & (F.coalesce(before, F.lit("delete")) == "delete"))
    return born


def rejected_inserts(log: DataFrame) -> DataFrame:
    return judged_inserts(log).filter("op = 'insert' and not valid").drop("valid")


def state(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id, one text column per name) of all living rows after ``log(id, seq, op, set)``; base rows come as inserts at the lowest seq."""
    span = judged_inserts(log).groupBy("id").agg(F.max(F.when(F.col("valid"), F.col("seq"))).alias("since"), F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"))
    alive = span.filter("since is not null and (gone is null or gone < since)").select("id", "since")
    rows = log.join(alive, "id").filter((F.col("seq") == F.col("since")) | ((F.col("seq") > F.col("since")) & (F.col("op") == "update")))
    latest = [F.max_by(F.element_at("set", F.lit(checked(c))), F.when(F.map_contains_key("set", F.lit(c)), F.col("seq"))).alias(c) for c in columns]
    return rows.groupBy("id").agg(*latest)


def applied(base: DataFrame, log: DataFrame) -> DataFrame:
    """``base(id, ...)`` after ``log(id, seq, op, set)``: its rows are inserts before all others; columns keep their types, text that a column's type can't hold is null."""
    columns = [c for c in base.columns if c != "id"]
    text = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    first = base.select(F.col("id").cast("string").alias("id"), F.lit(None).cast(log.schema["seq"].dataType).alias("seq"), F.lit("insert").alias("op"), F.create_map(*text).alias("set"))
    both = first.withColumn("seq", F.struct(F.lit(0).alias("own"), "seq")).unionByName(log.withColumn("seq", F.struct(F.lit(1).alias("own"), "seq")))
    kinds = {f.name: f.dataType for f in base.schema}
    return state(both, columns).select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in base.columns])


def returning_delete(base: DataFrame, deletes: DataFrame) -> DataFrame:
    """Before-images of the rows that deletes hit; a missing id yields nothing."""
    return base.join(deletes.select("id").distinct(), "id", "left_semi")


def first_tenant(target: DataFrame, others: Sequence[DataFrame], tenant: str = "tenant_id", order: str = "id") -> DataFrame:
    """(tenant): the first non-null tenant, of the target table if it has one, else of the others in order; inside a table the row with the least ``order``."""
    parts = [t.filter(F.col(tenant).isNotNull()).select(F.lit(i).alias("nth"), F.col(order).cast("string").alias("o"), F.col(tenant).alias("tenant")) for i, t in enumerate([target, *others])]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.agg(F.min_by("tenant", F.struct("nth", "o")).alias("tenant"))
