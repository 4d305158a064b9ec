"""Exact search in dense vectors: a stated set of queries against all rows, in blocks.

The queries are the rows whose id is divisible by 20. Queries and vectors are dealt to blocks of bounded size, each
pair of blocks is one matrix product in one task, and only the best of each query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table

QUERY_EVERY = 20
#: Queries and rows of a block: a pair of blocks is a table of 512 x 8192 scores, 32 MB.
QUERY_BLOCK, BLOCK = 512, 8192
#: Queries and rows of a block of nearest(), whose scores are never one table: 512 x 4096 at a time. Larger blocks are copied to fewer others.
NEAR_BLOCK, PART = 16_384, 4096
#: The weights of content, style and rhetoric in a multi-vector search.
WEIGHTS = (0.7, 0.2, 0.1)
KINDS = {pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string"}
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 1e-12)


def _matrix(t: pa.Table) -> np.ndarray:
    return t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def best_of(score: np.ndarray, asked: np.ndarray, ids: np.ndarray, k: int, ties_up: bool = True) -> pa.Table:
    """The k best finite scores of every row of a table of scores, ties by id."""
    tie, out = ids if ties_up else -ids, []
    for i, row in enumerate(score):
        able = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
        near = able[np.lexsort((tie[able], -row[able]))][:k]
        near = near[np.isfinite(row[near])]
        out.append((np.full(len(near), asked[i]), ids[near], row[near]))
    return pa.table([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], schema=FOUND)


def in_blocks(queries: DataFrame, rows: DataFrame, best, of: tuple[DataFrame, DataFrame] | None = None, found: pa.Schema = FOUND, sizes: tuple[int, int] = (QUERY_BLOCK, BLOCK)) -> DataFrame:
    """best(block of queries, block of rows) for every pair of blocks; both have vec_id. Queries are a stated set, so rows are copied few times.

    of: the tables that queries and rows are made of, one vector a row at most; they are counted instead, without making the vectors. found is what best returns.
    """
    counted = of or (queries, rows)
    n_v = max(1, -(-counted[1].count() // sizes[1]))
    n_q = max(1, -(-counted[0].count() // sizes[0]))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = queries.withColumn("q", block(n_q)).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    right = rows.withColumn("v", block(n_v)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(lambda a, b: best(a, b) if a.num_rows and b.num_rows else found.empty_table(), ", ".join(f"{f.name} {KINDS[f.type]}" for f in found))


def nearest(queries: DataFrame, rows: DataFrame, k: int, of: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows of the largest dot product with each query, above zero, rounded to six places; of as in in_blocks."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        q, v, asked, ids = _matrix(a), _matrix(b), a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        parts = [_best(q[lo : lo + QUERY_BLOCK], v, k, asked[lo : lo + QUERY_BLOCK], ids) for lo in range(0, len(q), QUERY_BLOCK)]
        return pa.concat_tables(parts)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return in_blocks(queries, rows, best, of, sizes=(NEAR_BLOCK, NEAR_BLOCK)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chosen(score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(score >= least[:, None])
    return np.divmod(at, score.shape[1])


def _best(q: np.ndarray, v: np.ndarray, k: int, asked: np.ndarray, ids: np.ndarray) -> pa.Table:
    """The k best of every query, scores above zero rounded to six places, ties by id.

    Products in single precision choose the rows that can be among them, with room for their error; these alone are multiplied in double precision.
    """
    q4, v4 = q.astype(np.float32), v.astype(np.float32)
    size = np.sqrt((q * q).sum(1)) * np.sqrt(max((v * v).sum(1).max(), 0.0))
    slack = (2e-6 + 2.0**-22 * q.shape[1] * size).astype(np.float32)  # of rounding to six places, and of sums in single precision
    floor = np.full(len(q), -1.0, np.float32) * slack  # what is not above zero is never taken
    best = np.full((len(q), k), -np.inf, np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(v), PART):
        score = q4 @ v4[lo : lo + PART].T
        i, j = _chosen(score, np.maximum(best[:, 0] - slack, floor) if lo else np.maximum(_kth(score[:, :1024], k) - slack, floor))
        if not len(i):
            continue
        found.append((i, j + lo))
        # the k best of every query so far: of what was chosen alone
        s = score[i, j]
        order = np.lexsort((-s, i))
        i, s = i[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < k
        new = np.full((len(q), k), -np.inf, np.float32)
        new[i[top], place[top]] = s[top]
        best = np.partition(np.concatenate([best, new], 1), k, axis=1)[:, k:]
        best.sort(1)
    if not found:
        return FOUND.empty_table()
    i, j = (np.concatenate([f[c] for f in found]) for c in range(2))
    exact = np.empty(len(i))
    for lo in range(0, len(i), 65_536):
        exact[lo : lo + 65_536] = np.einsum("ij,ij->i", q[i[lo : lo + 65_536]], v[j[lo : lo + 65_536]])
    # scores above zero alone, as they are before rounding
    i, j, exact = i[exact > 0], j[exact > 0], np.round(exact[exact > 0], 6)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pa.table([pa.array(asked[i[top]]), pa.array(ids[j[top]]), pa.array(exact[top])], schema=FOUND)


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of every row of a table of scores."""
    return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf, np.float32)


def search(vectors: DataFrame, k: int, least: float | None = None, other_label: bool = False, parts: tuple[tuple[float, int], ...] = ((1.0, 0),), ties_up: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows most like each query, itself left out, scores rounded to six places.

    parts: weights and leading dimensions (0: all) whose cosines are added up. least: only scores above it. other_label: only
    rows of another label. Ties go to the smaller id, or with ties_up false to the larger one. Null vectors are left out.
    """
    rows = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "label", "embedding")
    queries = rows.where(F.col("vec_id") % QUERY_EVERY == 0)
    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        qa, vb = _matrix(a), _matrix(b)
        score = sum(w * (_unit(qa[:, : d or None]) @ _unit(vb[:, : d or None]).T) for w, d in parts)
        score = np.round(score, 6)
        ids, asked = b["vec_id"].to_numpy(), a["vec_id"].to_numpy()
        score[asked[:, None] == ids[None, :]] = -np.inf
        if other_label:
            score[np.array(a["label"].to_pylist(), object)[:, None] == np.array(b["label"].to_pylist(), object)[None, :]] = -np.inf
        if least is not None:
            score[score <= least] = -np.inf
        return best_of(score, asked, ids, k, ties_up)

    found = in_blocks(queries, rows, best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id") if ties_up else F.desc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_PAIRS = "p AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS la, b.label AS lb, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"


@query(f"WITH {_PAIRS} SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), 5)


@query(
    "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(0.7 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.2 * list_cosine_similarity(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[])"
    " + 0.1 * list_cosine_similarity(a.embedding[1:16]::DOUBLE[], b.embedding[1:16]::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"
    " SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5"
)
def multi_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content, style and rhetoric weighed together; the leading 32 and 16 dimensions stand for the latter two."""
    return search(table(spark, sf_dir, "embeddings"), 5, parts=tuple(zip(WEIGHTS, (0, 32, 16))))


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p WHERE la <> lb) WHERE r = 1")
def nearest_cross_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row of another label."""
    return search(table(spark, sf_dir, "embeddings"), 1, other_label=True).drop("rank")


@query(f"WITH {_PAIRS} SELECT query_id, round(greatest(0, least(1, 1 - max(score))), 6) AS novelty FROM p GROUP BY query_id")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One less the greatest likeness to any other row."""
    return search(table(spark, sf_dir, "embeddings"), 1).select("query_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("score"))), 6).alias("novelty"))


@query(f"WITH {_PAIRS} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC)::INT AS rank FROM p WHERE score > 0.35) WHERE rank <= 5")
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five rows of a likeness above 0.35."""
    return search(table(spark, sf_dir, "embeddings"), 5, least=0.35, ties_up=False)


@query(
    "WITH v AS (SELECT vec_id, label, len(embedding) AS d, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)"
    " SELECT label, count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(d)::INT AS min_dim, max(d)::INT AS max_dim, count(*) FILTER (isfinite(norm)) AS n_finite, count(*) FILTER (abs(norm - 1) <= 1e-4 + 1e-5) AS n_unit, round(avg(norm), 6) AS mean_norm FROM v GROUP BY label"
)
def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions, finiteness and norms by label."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("d"), norm.alias("norm"))
    finite = (~F.isnan("norm")) & (F.col("norm") < float("inf"))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"), F.min("d").alias("min_dim"), F.max("d").alias("max_dim"), F.count_if(finite).alias("n_finite"),
        F.count_if(F.abs(F.col("norm") - 1) <= 1e-4 + 1e-5).alias("n_unit"), F.round(F.avg("norm"), 6).alias("mean_norm"),
    )
