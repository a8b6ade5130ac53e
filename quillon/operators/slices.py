"""Running values along a key without all of its rows in one task.

The order's range is cut into SLICES equal parts. Within a slice of a key a window does; across slices one row each is
enough, SLICES rows of a key at most, and comes back by a join. So a key that has all of the rows is spread over SLICES
tasks, as far as its numbers are spread over their range. The range comes from a subquery of the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 1024


def _across(df: DataFrame, keys: tuple[str, ...], order: str, summary: Column, along, bounds: DataFrame | None = None) -> DataFrame:
    """df with __key, __slice, and __far: along (a window function of summary) over the slices of a key.

    A key is one struct, in which nulls are equal, so aggregate, join and window share one partitioning. bounds is a
    table that has the order's range too but is cheaper to read.
    """
    ends = (df if bounds is None else bounds).agg(F.struct(F.min(order).cast("bigint").alias("low"), F.max(order).cast("bigint").alias("high"))).scalar()
    part = (ends["high"].cast("double") - ends["low"].cast("double") + 1) / SLICES
    cut = df.withColumn("__key", F.struct(*keys)).withColumn("__slice", F.floor((F.col(order).cast("double") - ends["low"].cast("double")) / part).cast("int"))
    each = cut.groupBy("__key", "__slice").agg(summary.alias("__sum"))
    far = each.select("__key", "__slice", along("__sum", Window.partitionBy("__key").orderBy("__slice")).alias("__far"))
    return cut.join(far, ["__key", "__slice"], "left")


def max_before(df: DataFrame, keys: tuple[str, ...], order: str, value: str, name: str) -> DataFrame:
    """Add the greatest value of the rows of a key before each row."""
    before = Window.unboundedPreceding, -1
    far = _across(df, keys, order, F.max(value), lambda c, w: F.max(c).over(w.rowsBetween(*before)))
    near = F.max(value).over(Window.partitionBy("__key", "__slice").orderBy(order).rowsBetween(*before))
    return far.withColumn(name, F.greatest(near, "__far")).drop("__far", "__slice", "__key")


def next_of(df: DataFrame, keys: tuple[str, ...], order: str, value: str, name: str, bounds: DataFrame | None = None) -> DataFrame:
    """Add the value of the next row of a key; null behind the last."""
    far = _across(df, keys, order, F.min_by(value, order), lambda c, w: F.lead(c).over(w), bounds)
    near = F.lead(value).over(Window.partitionBy("__key", "__slice").orderBy(order))
    return far.withColumn(name, F.coalesce(near, "__far")).drop("__far", "__slice", "__key")
