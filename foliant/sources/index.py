"""A vector index on disk: vectors in blocks around pivots, with radius and digest, from which an exact search leaves blocks out.

Angles between unit vectors obey the triangle inequality: a vector of a block lies at least the angle to the pivot less the
block's radius away from a query. A search reads a query's nearest blocks first, and then those alone that could hold something better.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.vectors import BLOCK, FOUND, _matrix, _unit, best_of
from .shared import stored, written

#: Pivots at most; the root of the number of vectors otherwise.
PIVOTS = 1024
#: Blocks that a search reads first, and what rounded scores may be off by.
FIRST, SLACK = 2, 1e-5


def _digest() -> Column:
    """A digest of a group's vectors that no order changes."""
    return F.sum(F.xxhash64("vec_id", "label", "embedding").cast("decimal(38,0)")).cast("string")


class Index:
    """The index in a folder: vectors/block=N, blocks, pivots."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, pivots: int = PIVOTS) -> Index:
        """Writes an index of vectors(vec_id, label, embedding); rows with a null id or vector are left out.

        Pivots are the vectors of the smallest hashes of their ids, as many as the root of their number and pivots at most; every vector goes to the
        nearest one, ties to the first.
        """
        spark = vectors.sparkSession
        index = cls(spark, folder)
        rows = written(vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding")), "vectors")
        n = min(pivots, max(1, math.isqrt(rows.count())))
        chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("embedding")
        chosen.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/pivots")
        sent = spark.sparkContext.broadcast(index.pivots())

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    angle = _angles(_matrix(pa.Table.from_batches([b])), sent.value)
                    near = angle.argmin(1)
                    yield b.append_column("angle", pa.array(angle[np.arange(len(near)), near])).append_column("block", pa.array(near.astype(np.int32)))

        kind = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
        held = written(rows.mapInArrow(placed, f"{kind}, angle double, block int"), "placed")
        held.drop("angle").repartition("block", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("errorifexists").partitionBy("block").parquet(f"{folder}/vectors")
        size = F.min(F.size("embedding")), F.max(F.size("embedding"))
        blocks = held.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), size[0].alias("least"), size[1].alias("most"), _digest().alias("digest"))
        blocks.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/blocks")
        return index

    def pivots(self) -> np.ndarray:
        """The pivots as rows of a matrix, at most PIVOTS of them."""
        rows = self.spark.read.parquet(f"{self.folder}/pivots").collect()
        return _unit(np.array([r.embedding for r in rows], float)) if rows else np.zeros((0, 1))

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id bigint, label int, embedding array<float>, block int").parquet(f"{self.folder}/vectors")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def faults(self) -> DataFrame:
        """(block, fault): blocks whose number or digest of vectors is not the listed one, that are not listed or missing, or that mix dimensions."""
        now = self.vectors().groupBy("block").agg(F.count(F.lit(1)).alias("n_now"), _digest().alias("digest_now"))
        both = self.blocks().join(now, "block", "full_outer")
        fault = F.when(F.col("n").isNull(), "unlisted").when(F.col("n_now").isNull(), "missing").when(F.col("n") != F.col("n_now"), "number").when(F.col("digest") != F.col("digest_now"), "digest").when(F.col("least") != F.col("most"), "dimension")
        return both.select("block", fault.alias("fault")).where("fault IS NOT NULL")

    def load(self) -> Index:
        """The index itself, once nothing speaks against it."""
        if (bad := self.faults().first()) is not None:
            raise ValueError(f"block {bad.block}: {bad.fault}")
        return self

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, vec_id, score, rank) of the k vectors most like each of queries(vec_id, embedding), itself left out, and (query_id, block) of what was read.

        Scores are cosines, rounded to six places, ties go to the smaller id: the same hits as a search of all vectors. Queries are a
        stated set and have ids of their own. An index without vectors gives no hits.
        """
        listed = {r.block: r for r in self.blocks().collect()}  # one row a block
        if not listed:
            return self.spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int"), self.spark.createDataFrame([], "query_id bigint, block int")
        names = np.array(sorted(listed))
        sent = self.spark.sparkContext.broadcast((self.pivots()[names], names, np.array([listed[b].radius for b in names.tolist()])))

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, blocks, radius = sent.value
            for b in batches:
                if b.num_rows:
                    least = np.maximum(_angles(_matrix(pa.Table.from_batches([b])), pivots) - radius, 0)
                    order = np.argsort(least, axis=1, kind="stable")
                    ids = np.repeat(b.column("query_id").to_numpy(), len(blocks))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blocks[order].ravel().astype(np.int32)), pa.array(np.cos(np.take_along_axis(least, order, 1)).ravel()), pa.array(np.tile(np.arange(len(blocks), dtype=np.int32), b.num_rows))], names=["query_id", "block", "most", "turn"])

        asked = written(queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding"), "asked")
        # a row per query and block: both are bounded, by the stated set and by PIVOTS
        reach = written(asked.mapInArrow(bounds, "query_id bigint, block int, most double, turn int"), "reach")
        parts = self.spark.createDataFrame([(b, -(-r.n // BLOCK)) for b, r in listed.items()], "block int, parts int")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        read = reach.where(F.col("turn") < FIRST).select("query_id", "block")
        first, _ = stored(self._scan(asked, read, parts, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "first")
        worst = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
        more = reach.where(F.col("turn") >= FIRST).join(worst, "query_id", "left").where(F.col("worst").isNull() | (F.col("most") >= F.col("worst") - SLACK)).select("query_id", "block")
        more = written(more, "more")
        found = first.drop("rank").unionByName(self._scan(asked, more, parts, k))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), read.unionByName(more)

    def _scan(self, asked: DataFrame, read: DataFrame, parts: DataFrame, k: int) -> DataFrame:
        """The k best of every pair of read(query_id, block). A large block is dealt to parts of BLOCK vectors; blocks that no query reads are not read."""

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return FOUND.empty_table()
            asked, ids = a["query_id"].to_numpy(), b["vec_id"].to_numpy()
            score = np.round(_unit(_matrix(a)) @ _unit(_matrix(b)).T, 6)
            return best_of(np.where(asked[:, None] == ids[None, :], -np.inf, score), asked, ids, k)

        small = F.broadcast(parts)  # a row per block
        left = read.join(asked, "query_id").join(small, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "query_id", "embedding")
        rows = self.vectors().join(F.broadcast(read.select("block").distinct()), "block", "left_semi").join(small, "block")
        right = rows.select("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding")
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(best, "query_id bigint, vec_id bigint, score double")


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(m) @ pivots.T, -1, 1))
