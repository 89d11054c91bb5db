"""Band joins as equi-joins: a point meets the intervals that hold it.

Intervals lie on levels by their length, a level's bins are as wide as its longest interval, so an interval touches two bins at
most, however long it is. A point asks for its bin on every level that intervals use. The comparison itself stays in the join's condition, so bins decide
cost and never results.

Where the answer has an order, rows that share a bin travel as blocks: the root's of one place in the order and the other side's meet as two
arrays, these are sorted, and pairs come of them behind the sort. So what is shuffled follows the blocks and not the pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL, BIN = "_band_level", "_band_bin"
ORDER, BLOCK = "_band_order", 1000  # rows of a block
_BETWEEN = re.compile(r"^\s*ON\s+(?P<at>.+?)\s+BETWEEN\s+(?P<low>.+?)\s+AND\s+(?P<high>(?:(?!\b(?:AND|OR|NOT)\b).)+?)\s*$", re.I | re.S)
_ALIAS = re.compile(r"\b([A-Za-z_]\w*)\s*\.")


def clause(on: str) -> tuple[str, str, str] | None:
    """(point, low, high) of ``ON point BETWEEN low AND high`` and nothing else, else None."""
    m = _BETWEEN.match(on)
    return (m["at"], m["low"], m["high"]) if m and " and " not in m["at"].lower() and " or " not in m["at"].lower() else None


def aliases(*texts: str) -> set[str]:
    return {a for t in texts for a in _ALIAS.findall(t)}


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level))


def binned(points: DataFrame, at: Column, intervals: DataFrame, low: Column, high: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with LEVEL and BIN, to be joined on them besides the comparison. Rows that no comparison can accept (nulls, empty intervals, not a number) go."""
    low, high, at = (c.cast("double") for c in (low, high, at))
    level = F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(1e-300)))), F.ceil(F.log2(F.greatest(F.abs(low), F.abs(high), F.lit(1e-300)))) - 50).cast("int")
    finite = lambda c: F.abs(c) < float("inf")
    spread = intervals.filter(low <= high).filter(finite(low) & finite(high) & ~F.isnan(low) & ~F.isnan(high)).withColumn(LEVEL, level)
    levels = sorted(r[0] for r in spread.select(LEVEL).distinct().collect())  # a few for all lengths that numbers can have
    own = F.array_distinct(F.array(_bin(low, F.col(LEVEL)), _bin(high, F.col(LEVEL))))
    spread = spread.withColumn(BIN, F.explode(own))
    if not levels:
        return points.limit(0).withColumn(LEVEL, F.lit(0)).withColumn(BIN, F.lit(0).cast("long")), spread
    found = points.filter(finite(at) & ~F.isnan(at)).withColumn(LEVEL, F.explode(F.array(*map(F.lit, levels))))
    return found.withColumn(BIN, _bin(at, F.col(LEVEL))), spread


def _gathered(rows: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """(keys, ``name``: up to BLOCK rows as an array of structs)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    numbered = rows.select(*keys, F.struct(*columns).alias(name), F.floor((nth - 1) / BLOCK).alias("_block"))
    return numbered.groupBy(*keys, "_block").agg(F.collect_list(name).alias(f"_{name}s")).drop("_block")


def blocks(root: DataFrame, name: str, columns: list[str], order: Column, other: DataFrame, other_name: str, other_columns: list[str]) -> DataFrame:
    """Both sides of :func:`binned` as (ORDER, ``_<name>s``, ``_<other name>s``): every pair that meets is in one row."""
    mine = _gathered(root.withColumn(ORDER, order), [LEVEL, BIN, ORDER], columns, name)
    # arrays look small to the optimizer, but as a broadcast they would go through the driver
    return mine.join(_gathered(other, [LEVEL, BIN], other_columns, other_name).hint("merge"), [LEVEL, BIN]).drop(LEVEL, BIN)
