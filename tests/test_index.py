"""The vector index: written, tampered with, searched."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

from foliant.operators import vectors
from foliant.sources import index as module
from foliant.sources.index import Index

SCHEMA = "vec_id long, label int, embedding array<float>"


def hits(df):
    return sorted(map(tuple, df.select("query_id", "vec_id", "score", "rank").collect()))


def test_hits_are_those_of_a_full_search(spark, tmp_path, monkeypatch):
    """Clusters, ties, copies and a block of many parts; fewer pairs of query and block are read than there are."""
    monkeypatch.setattr(module, "BLOCK", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(k, k % 3, [float(x) for x in centres[k % 12] + 0.05 * rng.normal(size=16)]) for k in range(600)]
    rows += [(1000 + k, 0, rows[0][2]) for k in range(80)] + [(2000, 1, [0.0] * 16), (None, 1, rows[1][2]), (2001, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = Index.build(df, str(tmp_path / "i")).load()
    queries = df.where(F.col("vec_id") % vectors.QUERY_EVERY == 0)
    found, read = index.search(queries, 5)
    assert hits(found) == hits(vectors.search(df, 5))
    n = queries.count() * index.blocks().count()
    assert read.count() < 0.6 * n
    assert hits(index.search(queries, 3)[0]) == hits(vectors.search(df, 3))


def test_real_vectors(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = Index.build(df, str(tmp_path / "i")).load()
    assert hits(index.search(df.where("vec_id % 20 = 0"), 5)[0]) == hits(vectors.search(df, 5))


def test_faults(spark, tmp_path):
    rows = [(k, 0, [float(k % 5), 1.0]) for k in range(40)]
    index = Index.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i")).load()
    path = sorted(glob.glob(f"{tmp_path}/i/vectors/block=*/*.parquet"))[0]
    kept = pq.ParquetFile(path).read()
    for crc in glob.glob(f"{tmp_path}/i/vectors/block=*/.*.crc"):
        open(crc, "w").close()
        import os

        os.remove(crc)
    pq.write_table(kept.slice(1), path)
    with pytest.raises(ValueError, match="number|missing"):
        index.load()
    at = kept.schema.get_field_index("vec_id")
    pq.write_table(kept.set_column(at, kept.schema.field(at), [[v + 1000 for v in kept["vec_id"].to_pylist()]]), path)
    with pytest.raises(ValueError, match="digest"):
        index.load()
    mixed = Index.build(spark.createDataFrame([*rows, (99, 0, [1.0, 2.0])], SCHEMA).where("vec_id = 99"), str(tmp_path / "j")).load()
    assert mixed.search(spark.createDataFrame(rows[:1], SCHEMA), 2)[0].count() == 1


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = Index.build(none, str(tmp_path / "i"))
    assert index.faults().count() == 0 and index.search(none, 3)[0].count() == 0
