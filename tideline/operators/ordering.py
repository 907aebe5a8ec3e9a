"""Numbers and neighbours along an order, without a task that holds a whole group.

A group's rows are cut into stretches of the ordering number. Within a stretch a window does the work; across stretches
only a row a stretch is ordered, however many rows the group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stretch(at: Column, width: int) -> Column:
    """The stretch of a number; nulls stand before all others."""
    return F.coalesce(F.floor(at / F.lit(width)), F.lit(-(1 << 62)))


def numbered(rows: DataFrame, group: str, at: Column, order: list[str], width: int, name: str) -> DataFrame:
    """rows with ``name``: its place in its group from 0, by ``order``, which must begin with what ``at`` is the number of."""
    cut = rows.withColumn("_stretch", _stretch(at, width))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.groupBy(group, "_stretch").agg(F.count(F.lit(1)).alias("_n")).select(F.col(group).alias("_group"), F.col("_stretch").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(group, "_stretch").orderBy(*order))
    joined = cut.withColumn("_place", place).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_stretch") == F.col("_at")))
    return joined.select(*rows.columns, (F.col("_start") + F.col("_place") - 1).cast("bigint").alias(name))


def steps(rows: DataFrame, group: str, value: str, width: int = 1 << 20) -> DataFrame:
    """(group, previous, value) of every two neighbours of a group along a whole-numbered column."""
    cut = rows.select(group, value, _stretch(F.col(value), width).alias("_stretch")).where(F.col(value).isNotNull())
    inner = cut.withColumn("previous", F.lag(value).over(Window.partitionBy(group, "_stretch").orderBy(value))).where("previous IS NOT NULL")
    ends = cut.groupBy(group, "_stretch").agg(F.min(value).alias(value), F.max(value).alias("_last"))
    edges = ends.withColumn("previous", F.lag("_last").over(Window.partitionBy(group).orderBy("_stretch"))).where("previous IS NOT NULL")
    return inner.select(group, "previous", value).union(edges.select(group, "previous", value))
