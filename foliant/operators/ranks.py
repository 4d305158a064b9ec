"""Row numbers and running sums inside groups that may be large: no task sorts a whole group.

Rows are dealt to ranges of the order key; each range of a group is numbered by itself, and the sums of the ranges before it,
one small row each, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the order key is cut into.
RANGES = 64


def _ranged(rows: DataFrame, key: str) -> DataFrame:
    bounds = rows.agg(F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)], 10_000).alias("q")).first()["q"] or []
    # at most RANGES - 1 numbers, whatever the table holds
    return rows.withColumn("_range", sum(((F.col(key) > b).cast("int") for b in sorted(set(bounds))), F.lit(0)))


def _with_base(rows: DataFrame, groups: list[str], value: Column, name: str) -> DataFrame:
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*groups, "_range").agg(F.sum(value).alias("_sum"))
    return rows.join(sums.select(*groups, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(name)), [*groups, "_range"])


def numbered(rows: DataFrame, groups: list[str], key: str, name: str = "rank") -> DataFrame:
    """rows with name: their number from 1 inside the group, in the order of a numeric key that is not null and unique there."""
    based = _with_base(_ranged(rows, key), groups, F.lit(1), "_base")
    own = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(key))
    return based.withColumn(name, (F.col("_base") + own).cast("bigint")).drop("_range", "_base")


def running(rows: DataFrame, groups: list[str], key: str, value: str, name: str = "upto") -> DataFrame:
    """rows with name: the sum of value up to and with the row, in the order of key."""
    based = _with_base(_ranged(rows, key), groups, F.col(value), "_base")
    own = F.sum(value).over(Window.partitionBy(*groups, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return based.withColumn(name, F.col("_base") + own).drop("_range", "_base")
