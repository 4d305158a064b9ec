"""Search in a vector index that has been written, read back and verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import SQL, query
from ..sources.index import Index
from ..sources.shared import fresh_path
from ..sources.tables import table
from .vectors import QUERY_EVERY


@query(SQL["vector_topk"])
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors most like every twentieth one, from an index on disk: the hits of vector_topk without all of its blocks."""
    rows = table(spark, sf_dir, "embeddings")
    index = Index.build(rows, fresh_path(spark, "index")).load()
    return index.search(rows.where(F.col("vec_id") % QUERY_EVERY == 0), 5)[0]
