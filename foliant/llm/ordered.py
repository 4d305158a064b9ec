"""Rows in the order of keys, so that large groups are spread over tasks instead of sorted in one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def in_order(rows: DataFrame, groups: list[str], keys: list[str], name: str) -> DataFrame:
    """A table of rows with name: a number that grows along (groups, keys), nulls first; rows alike in all of these stand in any order.

    Rows are dealt to tasks by ranges of all keys together, so a group with a third of all rows is spread over a third of the tasks. The upper
    bits of the number (from bit 33) tell the task, those below count its rows. The table is written to the shared folder, which fixes the numbers.
    """
    order = [F.asc_nulls_first(c) for c in [*groups, *keys]]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialise(dealt.withColumn(name, F.monotonically_increasing_id()), "ordered")
