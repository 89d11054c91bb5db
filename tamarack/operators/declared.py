"""Declarations held as tables: what is wrong with them, and the paths and tables they name.

The checks of :func:`~tamarack.sources.declarations.load` and ``check_operations`` for declarations of any size: joins and groups, no loop over routes.
``prefixes`` has (place, table, prefix), ``routes`` (place, table, method, path), ``place`` being the order of declaration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.declarations import KNOWN, METHODS


def expanded(routes: DataFrame) -> DataFrame:
    """One row for each method: upper-cased, a route without one has all of METHODS."""
    methods = F.when(F.coalesce("method", F.lit("")) == "", F.array(*map(F.lit, METHODS))).otherwise(F.array(F.upper("method")))
    return routes.withColumn("method", F.explode(methods))


def _again(*keys: str) -> Column:
    """Whether a row comes behind the first of its keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy("place", "table")) > 1


def faults(prefixes: DataFrame, routes: DataFrame) -> DataFrame:
    """(fault, table, what) of everything wrong: prefixes that don't start with / or are nothing else, declared twice or covering another
    table's path; paths that don't start with /, unknown methods, and the same request declared twice."""
    bad = ~F.col("prefix").startswith("/") | (F.regexp_replace("prefix", "/", "") == "")
    named = lambda df, fault, what: df.select(F.lit(fault).alias("fault"), "table", what.alias("what"))
    good = prefixes.filter(~bad).withColumn("again", _again("prefix"))
    own = expanded(routes.filter(F.col("path").startswith("/")))
    known = own.filter(F.col("method").isin(*KNOWN)).withColumn("again", _again("method", "path"))
    request = F.concat_ws(" ", "method", "path")
    # a path lies under the prefixes that end where one of its segments ends
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = known.filter(~F.col("again")).select(F.col("table").alias("other"), "path", F.explode(F.array_distinct(heads)).alias("prefix")).distinct()
    covered = good.filter(~F.col("again")).join(under, "prefix").filter(F.col("table") != F.col("other"))
    return (
        named(prefixes.filter(bad), "bad prefix", F.col("prefix"))
        .union(named(good.filter("again"), "prefix twice", F.col("prefix")))
        .union(named(routes.filter(~F.col("path").startswith("/")), "bad path", F.col("path")))
        .union(named(own.filter(~F.col("method").isin(*KNOWN)), "unknown method", request))
        .union(named(known.filter("again"), "request twice", request))
        .union(named(covered, "prefix covers", F.concat_ws(" ", "prefix", "path")))
    )


def paths(prefixes: DataFrame, routes: DataFrame) -> DataFrame:
    """(kind, first, path): prefixes, then distinct paths; in the order of (kind, first) as they were declared."""
    first = prefixes.groupBy(F.col("prefix").alias("path")).agg(F.min("place").alias("first")).select(F.lit(0).alias("kind"), "first", "path")
    return first.union(routes.groupBy("path").agg(F.min("place").alias("first")).select(F.lit(1), "first", "path"))


def tables(prefixes: DataFrame, routes: DataFrame) -> DataFrame:
    """(table): all declared tables once."""
    return prefixes.select("table").union(routes.select("table")).distinct()


def operation_faults(operations: DataFrame) -> DataFrame:
    """(fault, place) of ``operations(place, operation_id, method, path, connectivity)``: a required field missing, an unknown
    connectivity, or a request that is declared already, holes taken by position."""
    required = ("operation_id", "method", "path", "connectivity")
    missing = F.greatest(*[F.coalesce(F.col(c), F.lit("")) == "" for c in required])
    whole = operations.filter(~missing)
    shape = F.concat_ws(" ", F.upper("method"), F.regexp_replace("path", r"\{[^/]+\}", "{}"))
    again = whole.withColumn("nth", F.row_number().over(Window.partitionBy(shape).orderBy("place"))).filter("nth > 1")
    named = lambda df, fault: df.select(F.lit(fault).alias("fault"), "place")
    return named(operations.filter(missing), "missing").union(named(whole.filter(~F.col("connectivity").isin("offline", "online")), "connectivity")).union(named(again, "twice"))
