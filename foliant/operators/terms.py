"""Term statistics, the inverted index and BM25 for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.tables import documents, table
from .vectors import nearest

K1, B = 1.5, 0.75
#: Fixed values of rank fusion: weights of the lexical and the dense list, and the rank constant.
LEXICAL, DENSE, RRF = 0.65, 0.35, 60
TOKENS_SQL = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"
INDEX_SQL = TOKENS_SQL + """,
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS dl FROM tf GROUP BY doc_id),
st AS MATERIALIZED (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl)"""


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf): how often a document holds a term; counted before the shuffle."""
    return T.each(docs, ["doc_id"], T.tokens(F.col("text")), "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)).cast("bigint").alias("dl"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(item_id, term, qtf): terms of every question, a term's weight being its count, at most two."""
    each = questions.select("item_id", F.explode(T.query_terms(F.col("text"))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("qtf"))


def bm25(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, doc_id, bm25, confidence) of every document that shares a term with a question.

    Only postings of asked terms leave the scan of the documents; the questions' terms are joined, not looped over.
    """
    asked = question_terms(questions)
    wanted = postings(docs).join(asked.select("term").distinct(), "term", "left_semi")
    per_doc = lengths(docs)
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = F.broadcast(corpus_size(docs))  # one row
    weighed = asked.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).crossJoin(size)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = weighed.select("item_id", "term", "qtf", "avgdl", idf.alias("idf"))
    total = weighed.groupBy("item_id").agg(F.sum(F.col("idf") * F.col("qtf")).alias("total"))
    hits = wanted.join(weighed, "term").join(per_doc, "doc_id")
    part = F.col("idf") * (K1 + 1) * F.col("qtf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    scored = hits.groupBy("item_id", "doc_id").agg(F.sum(part).alias("bm25"), F.sum(F.col("idf") * F.col("qtf")).alias("supported")).join(total, "item_id")
    cover, full = F.col("supported") / F.col("total"), 1 - F.exp(-F.col("bm25") / F.col("total"))
    confidence = F.when((F.col("bm25") <= 0) | (F.col("total") <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.85 * cover + 0.15 * full)))
    return scored.select("item_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.round(confidence, 6).alias("confidence"))


def top(scored: DataFrame, score: str, k: int, group: str = "item_id", tie: str = "doc_id") -> DataFrame:
    """The k rows of each group of the highest score, ties by id, with their rank from 1."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


BM25_SQL = INDEX_SQL + r""",
qt AS (SELECT item_id, unnest(CASE WHEN len(list_filter(t, lambda x: length(x) > 2)) > 0 THEN list_filter(t, lambda x: length(x) > 2) ELSE t END) AS term
       FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark)),
q AS MATERIALIZED (SELECT item_id, term, least(count(*), 2) AS qtf FROM qt GROUP BY ALL),
qi AS MATERIALIZED (SELECT item_id, q.term, qtf, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM q LEFT JOIN df USING (term), st),
tot AS (SELECT item_id, sum(idf * qtf) AS total FROM qi GROUP BY item_id),
sc AS (SELECT item_id, doc_id, sum(idf * 2.5 * qtf * tf / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) AS bm25, sum(idf * qtf) AS supported
       FROM qi JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
lex AS MATERIALIZED (SELECT item_id, doc_id, round(bm25, 6) AS bm25,
       round(CASE WHEN bm25 <= 0 OR total <= 0 THEN 0 ELSE least(1, greatest(0, 0.85 * supported / total + 0.15 * (1 - exp(-bm25 / total)))) END, 6) AS confidence
       FROM sc JOIN tot USING (item_id))"""


@query(f"WITH {INDEX_SQL} SELECT term, df::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf JOIN df USING (term) GROUP BY ALL")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of every term, summed by term in each task; a document's own terms are made distinct in its row."""
    one = lambda terms, df: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(df).alias("df")))
    rows = documents(spark, sf_dir).select(T.tokens(F.col("text")).alias("t")).select(F.explode(F.concat(one("t", 0), one(F.array_distinct("t"), 1))).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.df").alias("df"), F.count_if(F.col("x.df") == 0).alias("cf"))


@query(f"WITH {INDEX_SQL} SELECT (SELECT n FROM st) AS n_docs, (SELECT round(avgdl, 6) FROM st) AS avg_length, (SELECT count(*) FROM df) AS n_terms, (SELECT sum(dl) FROM dl)::BIGINT AS n_tokens")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the inverted index."""
    terms = term_stats(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("cf").alias("n_tokens"))
    return corpus_size(documents(spark, sf_dir)).select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avg_length")).crossJoin(terms)


@query(f"WITH {INDEX_SQL} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 weight of every term."""
    docs = documents(spark, sf_dir)
    df = postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))  # one row
    return df.crossJoin(n).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"WITH {INDEX_SQL} SELECT doc_id, coalesce(dl, 0)::BIGINT AS dl, coalesce(n, 0)::BIGINT AS n_terms FROM documents LEFT JOIN dl USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM tf GROUP BY 1) USING (doc_id)")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct terms of every document."""
    t = T.tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.coalesce(F.size(t), F.lit(0)).cast("bigint").alias("dl"), F.coalesce(F.size(F.array_distinct(t)), F.lit(0)).cast("bigint").alias("n_terms"))


@query(f"WITH {BM25_SQL} SELECT doc_id, bm25, confidence, rank FROM (SELECT *, row_number() OVER (ORDER BY bm25 DESC, doc_id)::INT AS rank FROM lex WHERE item_id = (SELECT min(item_id) FROM benchmark)) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the first question."""
    questions = table(spark, sf_dir, "benchmark")
    first = questions.join(F.broadcast(questions.agg(F.min("item_id").alias("item_id"))), "item_id")  # one row
    return top(bm25(documents(spark, sf_dir), first), "bm25", 10).select("doc_id", "bm25", "confidence", "rank")


@query(f"WITH {BM25_SQL} SELECT * FROM (SELECT item_id, doc_id, bm25, confidence, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id)::INT AS rank FROM lex) WHERE rank <= 5")
def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for every question."""
    return top(bm25(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")), "bm25", 5)


WIDTH = 64
#: Hashed vectors are dense lists here: 64 buckets of token counts, L2-normalised.
HASHED_SQL = r"""
hv AS MATERIALIZED (SELECT {id} AS id, b, sqrt(sum(c * c) OVER (PARTITION BY {id})) AS norm, c FROM (
  SELECT {id}, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % {width}) AS b, count(*) AS c
  FROM (SELECT {id}, sha256(t) AS h FROM (SELECT {id}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM {table})) GROUP BY ALL))"""


def hashed_vectors(rows: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, bucket, weight): the L2-normalised counts of tokens in hashed buckets, zero buckets left out.

    Tokens are hashed where they are read, and counted by bucket before the only shuffle.
    """
    tokens = T.each(rows, [key], T.tokens(F.col("text")), "token")
    counts = tokens.groupBy(key, T.hashed_bucket(F.col("token"), width).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("c") / norm).alias("weight"))


def dense_vectors(rows: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(vec_id, embedding): the hashed vectors as arrays of one length; rows without a token have none."""
    packed = hashed_vectors(rows, key, width).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return packed.select(F.col(key).alias("vec_id"), F.expr(f"transform(sequence(0, {width - 1}), b -> coalesce(try_element_at(m, b), 0D))").alias("embedding"))


@query("WITH " + HASHED_SQL.format(id="doc_id", table="documents", width=WIDTH) + " SELECT id AS doc_id, b::INT AS bucket, round(c / norm, 6) AS weight FROM hv")
def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed feature vector of every document, as (bucket, weight) rows."""
    return hashed_vectors(documents(spark, sf_dir), "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(
    f"WITH {BM25_SQL}, " + HASHED_SQL.format(id="doc_id", table="documents", width=WIDTH).replace("hv AS", "dv AS") + ", " + HASHED_SQL.format(id="item_id", table="benchmark", width=WIDTH).replace("hv AS", "qv AS") + """,
de AS (SELECT qv.id AS item_id, dv.id AS doc_id, round(sum(qv.c / qv.norm * dv.c / dv.norm), 6) AS dense FROM qv JOIN dv USING (b) GROUP BY ALL),
lr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS r FROM lex) WHERE r <= 25),
dr AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id) AS r FROM de) WHERE r <= 25),
fu AS (SELECT item_id, doc_id, round(sum(s), 9) AS fused FROM (SELECT item_id, doc_id, 0.65 / (60 + r) AS s FROM lr UNION ALL SELECT item_id, doc_id, 0.35 / (60 + r) AS s FROM dr) GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id)::INT AS rank FROM fu) WHERE rank <= 5"""
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every question by reciprocal ranks in the lexical and the hashed dense list, 25 deep each."""
    docs, questions = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    lexical = top(bm25(docs, questions), "bm25", 25).select("item_id", "doc_id", (LEXICAL / (RRF + F.col("rank"))).alias("s"))
    dense = nearest(dense_vectors(questions, "item_id"), dense_vectors(docs, "doc_id"), 25, (questions, docs))
    near = dense.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), (DENSE / (RRF + F.col("rank"))).alias("s"))
    fused = lexical.unionByName(near).groupBy("item_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("fused"))
    return top(fused, "fused", 5)
