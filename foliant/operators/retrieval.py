"""Retrieval put together: lexical and dense ranks fused with confidences, texts indexed as windows, and search by content, style and rhetoric."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.shared import written
from ..sources.tables import documents, table
from . import profiles
from .corpus import _windows_sql, windows
from .linguistics import RHETORIC_VECTOR_SQL, STYLE_SQL
from .terms import BM25_SQL, DENSE, HASHED_SQL, LEXICAL, RRF, WIDTH, bm25, dense_vectors, top
from .vectors import WEIGHTS, nearest

#: Results of a question, and hits that the dense list holds.
KEPT, DEPTH = 5, 25


def linear(score: Column) -> Column:
    """A calibrator for hashed vectors: likeness of one half says nothing, of one is certain."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * score - 1))


def hybrid(active: DataFrame, indexed: DataFrame, questions: DataFrame, calibrate: Callable[[Column], Column] | None = linear, kept: int = KEPT, depth: int = DEPTH) -> DataFrame:
    """(item_id, doc_id, rank, fused, lexical_score, dense_score, confidence): the kept best of active for each question by fused ranks.

    The dense list holds the depth best of indexed, then only those that are active. Every document's lexical rank counts, however low:
    the first depth + kept are listed, the others' are counted for the dense hits alone, so no window holds all documents of a question.
    Without a calibrator dense scores do not enter the confidence. A document without a shared term has no lexical rank.
    """
    scored = written(bm25(active, questions), "scored")  # read three times below
    listed = top(scored, "bm25", depth + kept).withColumnRenamed("rank", "lexical_rank")
    found = nearest(dense_vectors(questions, "item_id"), dense_vectors(indexed, "doc_id"), depth, (questions, indexed))
    near = found.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("score").alias("dense_score"), F.col("rank").alias("r"))
    near = near.join(active.select("doc_id"), "doc_id", "left_semi")
    near = near.withColumn("dense_rank", F.row_number().over(Window.partitionBy("item_id").orderBy("r"))).drop("r")  # at most depth rows a question

    own = scored.join(near.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_semi")
    marks = own.groupBy("item_id").agg(F.collect_list(F.struct("doc_id", "bm25")).alias("marks"))
    before = lambda m: (F.col("bm25") > m["bm25"]) | ((F.col("bm25") == m["bm25"]) & (F.col("doc_id") < m["doc_id"]))
    ahead = scored.join(marks, "item_id").select("item_id", F.explode(F.transform(F.filter("marks", before), lambda m: m["doc_id"])).alias("doc_id"))
    counted = own.join(ahead.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n")), ["item_id", "doc_id"], "left")
    ranked = counted.withColumn("lexical_rank", (F.coalesce("n", F.lit(0)) + 1).cast("int")).drop("n").unionByName(listed).distinct()

    both = ranked.join(near, ["item_id", "doc_id"], "full_outer")
    part = lambda weight, rank: F.coalesce(weight / (RRF + F.col(rank)), F.lit(0.0))
    lexical = F.coalesce("confidence", F.lit(0.0))
    confidence = lexical if calibrate is None else F.when(F.col("dense_score").isNull(), lexical).otherwise(LEXICAL * lexical + DENSE * calibrate(F.col("dense_score")))
    rows = both.select("item_id", "doc_id", F.round(part(LEXICAL, "lexical_rank") + part(DENSE, "dense_rank"), 9).alias("fused"), F.coalesce("bm25", F.lit(0.0)).alias("lexical_score"), "dense_score", F.round(confidence, 6).alias("confidence"))
    return top(rows, "fused", kept)


_DENSE_SQL = HASHED_SQL.format(id="doc_id", table="documents", width=WIDTH).replace("hv AS", "dv AS") + ", " + HASHED_SQL.format(id="item_id", table="benchmark", width=WIDTH).replace("hv AS", "qv AS")


@query(
    "WITH active AS MATERIALIZED (SELECT * FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)), " + BM25_SQL.replace("documents", "active") + f", {_DENSE_SQL}" + """,
de AS (SELECT qv.id AS item_id, dv.id AS doc_id, round(sum(qv.c / qv.norm * dv.c / dv.norm), 6) AS dense FROM qv JOIN dv USING (b) GROUP BY ALL),
d25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS r FROM de) WHERE r <= 25),
dr AS (SELECT item_id, doc_id, dense, row_number() OVER (PARTITION BY item_id ORDER BY r) AS dense_rank FROM d25 SEMI JOIN active USING (doc_id)),
lr AS (SELECT item_id, doc_id, bm25, confidence, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS lexical_rank FROM lex),
fu AS (SELECT item_id, doc_id, round(coalesce(0.65 / (60 + lexical_rank), 0) + coalesce(0.35 / (60 + dense_rank), 0), 9) AS fused, coalesce(bm25, 0) AS lexical_score, dense AS dense_score,
  round(CASE WHEN dense IS NULL THEN coalesce(confidence, 0) ELSE 0.65 * coalesce(confidence, 0) + 0.35 * greatest(0, least(1, 2 * dense - 1)) END, 6) AS confidence FROM lr FULL JOIN dr USING (item_id, doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id)::INT AS rank FROM fu) WHERE rank <= 5"""
)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every question with their confidence; toxic documents are not active, though the vectors still hold them."""
    docs = documents(spark, sf_dir)
    active = docs.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return hybrid(active, docs, table(spark, sf_dir, "benchmark"))


_SQUEEZED = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"


@query(
    rf"""WITH segments AS MATERIALIZED (SELECT doc_id, 0 AS segment, {_SQUEEZED} AS text FROM documents WHERE {_SQUEEZED} <> ''), {_windows_sql(220, 40, 3)}
SELECT doc_id, "window", start, len(piece)::INT AS n_words, len(list_distinct(regexp_extract_all(lower(array_to_string(piece, ' ')), '[\p{{L}}\p{{N}}]+')))::INT AS n_terms, md5(array_to_string(piece, ' ')) AS digest FROM windows"""
)
def indexed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts indexed without their lines: windows of 220 words that share 40, their distinct terms and digests."""
    some = documents(spark, sf_dir).where(F.col("text").rlike(r"\S"))  # not the squeezed text, which the filter would make once more
    whole = some.select("doc_id", F.lit(0).alias("segment"), T.squeeze(F.col("text")).alias("text"))
    terms = F.size(F.array_distinct(T.tokens(F.col("text"))))
    return windows(whole, 220, 40, 3).select("doc_id", "window", "start", "n_words", terms.alias("n_terms"), F.md5("text").alias("digest"))


@query(
    f"WITH {STYLE_SQL}, {RHETORIC_VECTOR_SQL}, " + HASHED_SQL.format(id="doc_id", table="documents", width=WIDTH) + f""",
hm AS (SELECT id AS doc_id, map_from_entries(list((b, c / norm))) AS m FROM hv GROUP BY id),
pv AS MATERIALIZED (SELECT doc_id, list_transform(range({WIDTH}), lambda b: coalesce(m[b], 0)::DOUBLE) AS c, style, rhetoric FROM style JOIN rhetoric_v USING (doc_id) LEFT JOIN hm USING (doc_id)),
pp AS (SELECT a.doc_id AS query_id, b.doc_id, round({WEIGHTS[0]} * list_dot_product(a.c, b.c) + {WEIGHTS[1]} * list_dot_product(a.style, b.style) + {WEIGHTS[2]} * list_dot_product(a.rhetoric::DOUBLE[], b.rhetoric::DOUBLE[]), 6) AS score FROM pv a, pv b WHERE a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM pp WHERE score > 0) WHERE rank <= 5"""
)
def profile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents most like each query document (ids divisible by 20) by content, style and rhetoric, itself left out."""
    found = profiles.search(written(profiles.profiles(documents(spark, sf_dir)), "profiles"), 6)  # made once, for queries and rows
    return top(found.where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("doc_id"), "score"), "score", 5, "query_id")
