"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _mark(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component): every id of edges(a, b) with the smallest id of its component.

    Null ends and loops are left out; an empty table gives an empty one. Each round needs the smallest neighbour of every id
    (summed before the shuffle) and joins it back; a round's stars are written to the shared folder.
    """
    whole = edges.where("a <> b")
    now, path = stored(whole.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "stars")
    seen = _mark(now)
    for _ in range(limit):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # a table of its own: the join then has a shuffle of its own, whose hot ids the adaptive plan splits
        least, used = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pair = large.join(least, "hi")
        small = pair.select("hi", F.col("m").alias("lo")).union(pair.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        now, new = stored(small, "stars")
        discard(used)
        discard(path)
        path = new
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components have not settled")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
