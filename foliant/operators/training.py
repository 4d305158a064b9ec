"""Preparation of training data: byte-pair merges, windows, pairs, schedules, sampling and n-gram losses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.shared import discard, stored, written
from ..sources.tables import SPANS_SQL, documents, spans, table
from .ranks import numbered, running
from .terms import HASHED_SQL, TOKENS_SQL, hashed_vectors

CONTEXT, STRIDE = 128, 64


_TOKEN_LIST = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    f"""WITH t AS (SELECT doc_id, len({_TOKEN_LIST}) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(list_sort(list_distinct(range(0, greatest(n - {CONTEXT}, 0), {STRIDE}) || [greatest(n - {CONTEXT} - 1, 0)]))) AS start FROM t WHERE n > 1)
SELECT doc_id, start::INT AS start, least({CONTEXT}, n - 1 - start)::INT AS length FROM w"""
)
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and lengths of training windows: every 64 tokens, and the last whole one; targets are one token on."""
    n = F.size(T.tokens(F.col("text")))
    last = F.greatest(F.col("n") - CONTEXT - 1, F.lit(0))
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - CONTEXT, F.lit(0)), F.lit(STRIDE)), lambda s: s < F.greatest(F.col("n") - CONTEXT, F.lit(0))), F.array(last)))
    rows = documents(spark, sf_dir).select("doc_id", n.alias("n")).where("n > 1").withColumn("start", F.explode(starts))
    return rows.select("doc_id", "start", F.least(F.lit(CONTEXT), F.col("n") - 1 - F.col("start")).alias("length"))


@query(f"SELECT doc_id, len({_TOKEN_LIST})::INT AS n_tokens, (len({_TOKEN_LIST}) - len({_TOKEN_LIST}) // 10)::INT AS n_train, (len({_TOKEN_LIST}) // 10)::INT AS n_validation FROM documents")
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of every document's tokens validates."""
    n = F.size(T.tokens(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", n.alias("n_tokens")).selectExpr("doc_id", "n_tokens", "cast(n_tokens - n_tokens div 10 AS int) AS n_train", "cast(n_tokens div 10 AS int) AS n_validation")


def asof_owner(units: DataFrame, points: DataFrame, key: str, at: str, owner: str) -> DataFrame:
    """Each point with the last unit of its key that starts at or before it: one sort of the union, no range join."""
    both = units.select(key, F.col(at), F.col(owner), F.lit(0).alias("_kind")).unionByName(points.select(key, F.col(at), F.lit(None).cast(units.schema[owner].dataType).alias(owner), F.lit(1).alias("_kind")))
    past = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(owner, F.last(owner, ignorenulls=True).over(past)).where("_kind = 1").drop("_kind")


@query(
    f"""WITH {SPANS_SQL}, u AS (SELECT doc_id, span_ord::INT AS span_ord, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY span_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at, length(text) AS n FROM spans),
p AS (SELECT doc_id, unnest(range(0, sum(n)::BIGINT, 256)) AS at FROM u GROUP BY doc_id)
SELECT p.doc_id, p.at, u.span_ord FROM p ASOF JOIN u ON p.doc_id = u.doc_id AND p.at >= u.at"""
)
def window_owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span in which every 256th character of a document lies."""
    before = Window.partitionBy("doc_id").orderBy("span_ord").rowsBetween(Window.unboundedPreceding, -1)
    units = spans(documents(spark, sf_dir)).select("doc_id", "span_ord", F.length("text").alias("n")).withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = units.groupBy("doc_id").agg(F.sum("n").alias("total")).where("total > 0")
    points = total.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(256).cast("bigint"))).alias("at"))
    return asof_owner(units, points, "doc_id", "at", "span_ord").select("doc_id", "at", "span_ord")


@query(f"WITH {SPANS_SQL}, n AS (SELECT doc_id, span_ord, lead(span_ord) OVER (PARTITION BY doc_id ORDER BY span_ord) AS next, lag(span_ord) OVER (PARTITION BY doc_id ORDER BY span_ord) AS prev FROM spans) SELECT doc_id, span_ord::INT AS anchor, next::INT AS positive, 'next' AS kind FROM n WHERE next IS NOT NULL UNION ALL SELECT doc_id, span_ord::INT, prev::INT, 'previous' FROM n WHERE prev IS NOT NULL UNION ALL SELECT doc_id, span_ord::INT, span_ord::INT, 'self' FROM n")
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive pairs of spans: a span with its neighbours and with its own second view."""
    w = Window.partitionBy("doc_id").orderBy("span_ord")
    near = F.array(F.struct(F.lead("span_ord").over(w).alias("positive"), F.lit("next").alias("kind")), F.struct(F.lag("span_ord").over(w).alias("positive"), F.lit("previous").alias("kind")), F.struct(F.col("span_ord").alias("positive"), F.lit("self").alias("kind")))
    rows = spans(documents(spark, sf_dir)).select("doc_id", F.col("span_ord").alias("anchor"), near.alias("near"))
    return rows.select("doc_id", "anchor", F.explode("near").alias("p")).select("doc_id", "anchor", "p.positive", "p.kind").where("positive IS NOT NULL")


@query(f"WITH {SPANS_SQL}, c AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) SELECT doc_id, span_ord::INT AS span_ord, round(1 / (1 + (span_ord > (SELECT min(span_ord) FROM spans s WHERE s.doc_id = spans.doc_id))::INT + (span_ord < (SELECT max(span_ord) FROM spans s WHERE s.doc_id = spans.doc_id))::INT), 6) AS weight FROM spans JOIN c USING (doc_id)")
def pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of each pair of an anchor: its weight over the number of its pairs."""
    w = Window.partitionBy("doc_id").orderBy("span_ord")
    n = 1 + F.lag("span_ord").over(w).isNotNull().cast("int") + F.lead("span_ord").over(w).isNotNull().cast("int")
    return spans(documents(spark, sf_dir)).select("doc_id", "span_ord", F.round(1 / n, 6).alias("weight"))


@query(f"WITH {SPANS_SQL}, w AS (SELECT doc_id, span_ord, string_split(text, ' ') AS w FROM spans) SELECT doc_id, span_ord::INT AS span_ord, md5(array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[:len(w) - len(w) // 4] END, ' ')) AS head, md5(array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[len(w) // 4 + 1:] END, ' ')) AS tail FROM w")
def overlap_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of every span: without its last and without its first quarter, as digests."""
    rows = spans(documents(spark, sf_dir)).select("doc_id", "span_ord", F.split("text", " ").alias("w")).withColumn("q", F.expr("cast(size(w) div 4 AS int)"))
    head = F.when(F.size("w") < 4, F.col("w")).otherwise(F.expr("slice(w, 1, size(w) - q)"))
    tail = F.when(F.size("w") < 4, F.col("w")).otherwise(F.expr("slice(w, q + 1, size(w))"))
    return rows.select("doc_id", "span_ord", F.md5(F.array_join(head, " ")).alias("head"), F.md5(F.array_join(tail, " ")).alias("tail"))


@query(
    "WITH " + HASHED_SQL.format(id="doc_id", table="documents", width=64) + """,
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS total FROM documents),
b AS (SELECT doc_id, source, r // 16 AS batch, true AS own FROM r UNION ALL SELECT doc_id, source, r // 16 + 1, false FROM r WHERE r = total - 2 AND total % 16 = 1),
v AS MATERIALIZED (SELECT id, hv.b, c / norm AS w, source, batch, own FROM hv JOIN b ON doc_id = id),
s AS (SELECT x.id, y.id AS other, round(sum(x.w * y.w), 6) AS s FROM v x JOIN v y ON x.own AND x.source = y.source AND x.batch = y.batch AND x.b = y.b GROUP BY ALL)
SELECT id AS doc_id, round(1 - max(CASE WHEN id = other THEN exp(s / 0.07) END) / sum(exp(s / 0.07)), 5) AS uncertainty FROM s GROUP BY id"""
)
def uncertainty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unsure a softmax over a batch of 16 documents of one source is of each document."""
    return batch_uncertainty(documents(spark, sf_dir))


def batch_uncertainty(docs: DataFrame, size: int = 16, temperature: float = 0.07) -> DataFrame:
    """(doc_id, uncertainty) of documents(doc_id, source, text) with tokens, by batches of size in the order of their ids.

    A last document that would be alone in its batch has the one before it as its other; that one is measured in its own batch alone. A
    source of one document is sure of it. Ids are unique and not null.
    """
    ranks = numbered(docs.select("doc_id", "source"), ["source"], "doc_id")
    totals = ranks.groupBy("source").agg(F.max("rank").alias("total"))
    own = ranks.select("doc_id", "source", F.floor((F.col("rank") - 1) / size).alias("batch"), F.lit(True).alias("own"))
    beside = ranks.join(totals, "source").where((F.col("rank") == F.col("total") - 1) & (F.col("total") % size == 1)).select("doc_id", "source", (F.floor((F.col("rank") - 1) / size) + 1).alias("batch"), F.lit(False).alias("own"))
    v = hashed_vectors(docs, "doc_id").join(own.unionByName(beside), "doc_id")
    other = v.select("source", "batch", "bucket", F.col("doc_id").alias("other"), F.col("weight").alias("w"))
    s = v.where("own").join(other, ["source", "batch", "bucket"]).groupBy("doc_id", "other").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("s"))
    e = F.exp(F.col("s") / temperature)
    return s.groupBy("doc_id").agg(F.round(1 - F.max(F.when(F.col("doc_id") == F.col("other"), e)) / F.sum(e), 5).alias("uncertainty"))


@query(
    rf"""WITH t AS (SELECT doc_id, {_TOKEN_LIST} AS l FROM documents),
g AS (SELECT doc_id, l[i] AS a, l[i + 1] AS b, count(*) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM t) GROUP BY ALL),
c AS (SELECT a, b, sum(n) AS n FROM g GROUP BY ALL), u AS (SELECT a, sum(n) AS n FROM c GROUP BY a), v AS (SELECT count(DISTINCT b) AS n FROM c)
SELECT doc_id, round(sum(g.n * -ln((c.n + 0.5) / (u.n + 0.5 * (SELECT n FROM v)))) / sum(g.n), 6) AS loss, sum(g.n)::BIGINT AS n_targets
FROM g JOIN c USING (a, b) JOIN u USING (a) GROUP BY doc_id"""
)
def ngram_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean negative log-likelihood of each document under the corpus's own smoothed bigrams, in place of a neural model's."""
    return bigram_loss(documents(spark, sf_dir))


def number(seed: int, *of: Column) -> Column:
    """A number for tokens or pairs, in place of their strings."""
    return F.xxhash64(*of, F.lit(seed))


def _unshared(rows: Callable[[int], DataFrame]) -> tuple[int, DataFrame]:
    """The first seed under which no two of rows(seed), which has a key, share one; and the table of them."""
    seed = 0
    while True:
        made = rows(seed)
        named = [F.max(c).alias(c) for c in made.columns if c != "key"]
        found, path = stored(made.groupBy("key").agg(F.count(F.lit(1)).alias("same"), *named), "numbers")
        if not found.where("same > 1").limit(1).count():
            return seed, found.drop("same")
        discard(path)
        seed += 1


def bigram_loss(docs: DataFrame, numbers: Callable[..., Column] = number) -> DataFrame:
    """(doc_id, loss, n_targets). Tokens and pairs go through the shuffles as numbers; those of a seed are taken only when no two tokens, or pairs, of the corpus share one."""
    tokens = T.tokens(F.col("text"))
    types = written(T.each(docs, [], F.array_distinct(tokens), "t").distinct(), "tokens")
    own, _ = _unshared(lambda seed: types.select(numbers(seed, F.col("t")).alias("key")))
    rows = docs.select("doc_id", F.transform(tokens, lambda t: numbers(own, t)).alias("l"))
    beside = lambda make: F.transform(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), lambda x, i: make(x, F.get("l", i + 1)))
    pairs = T.each(rows, [], beside(lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "p").select("p.a", "p.b")
    c = written(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("pair")), "bigrams")
    u = c.groupBy("a").agg(F.sum("pair").alias("first"))
    v = F.broadcast(c.agg(F.countDistinct("b").alias("v")))  # one row
    p = (F.col("pair") + 0.5) / (F.col("first") + 0.5 * F.col("v"))
    costs = c.join(u, "a").crossJoin(v).select("a", "b", (-F.log(p)).alias("cost"))
    seed, known = _unshared(lambda seed: costs.select(numbers(seed, F.col("a"), F.col("b")).alias("key"), "cost"))
    g = T.each(rows, ["doc_id"], beside(lambda a, b: numbers(seed, a, b)), "key")
    return g.join(known, "key").groupBy("doc_id").agg(F.round(F.sum("cost") / F.count(F.lit(1)), 6).alias("loss"), F.count(F.lit(1)).alias("n_targets"))


@query(
    """WITH s AS (SELECT source, count(*) AS total, greatest(1, count(*) // 10) AS warm FROM documents GROUP BY source),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS step FROM documents)
SELECT doc_id, step::INT AS step, round(CASE WHEN step <= warm THEN step / warm ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - warm) / greatest(1, total - warm))) END, 6) AS rate FROM d JOIN s USING (source)"""
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning rate at which each document of a source is met: a linear warm-up, then a cosine to a tenth."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    s = docs.groupBy("source").agg(F.count(F.lit(1)).alias("total")).selectExpr("source", "total", "greatest(1, total div 10) AS warm")
    d = numbered(docs, ["source"], "doc_id", "step").withColumn("step", F.col("step").cast("int")).join(s, "source")
    cosine = 0.1 + 0.9 * 0.5 * (1 + F.cos(F.pi() * (F.col("step") - F.col("warm")) / F.greatest(F.lit(1), F.col("total") - F.col("warm"))))
    return d.select("doc_id", "step", F.round(F.when(F.col("step") <= F.col("warm"), F.col("step") / F.col("warm")).otherwise(cosine), 6).alias("rate"))


@query(
    """WITH w AS (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents),
p AS (SELECT source, k, (k + 0.5) / 20 * any_value(total) AS pos FROM w, range(20) r(k) GROUP BY source, k)
SELECT p.source, k::INT AS draw, min(doc_id) AS doc_id FROM p JOIN w ON w.source = p.source AND upto >= pos GROUP BY p.source, k"""
)
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty systematic draws with replacement from each source, by size: the inverse of the running sum of weights."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "n_chars")
    w = running(docs, ["source"], "doc_id", "n_chars")
    total = docs.groupBy("source").agg(F.sum("n_chars").alias("total"))
    step = F.col("total") / 20
    rows = w.join(total, "source").withColumn("lo", F.ceil((F.col("upto") - F.col("n_chars")) / step - 0.5)).withColumn("hi", F.floor(F.col("upto") / step - 0.5))
    draws = F.when(F.col("hi") >= F.col("lo"), F.sequence(F.col("lo"), F.col("hi"))).otherwise(F.expr("array()"))
    found = rows.select("source", "doc_id", F.explode(draws).alias("draw")).where("draw BETWEEN 0 AND 19")
    return found.groupBy("source", "draw").agg(F.min("doc_id").alias("doc_id")).select("source", F.col("draw").cast("int").alias("draw"), "doc_id")


@query("SELECT doc_id, 'Q: ' || source || ' ' || lang || chr(10) || 'E: ' || text || chr(10) || 'A: [E1]' AS example FROM documents")
def control_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, as one evidence example; control_spans has spans."""
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Q: "), "source", F.lit(" "), "lang", F.lit("\nE: "), "text", F.lit("\nA: [E1]")).alias("example"))


#: Our own words of the examples: before the evidence, between it and the answer, after it, and without any.
ASK, ANSWER, CITE = "Task: quote what the evidence says.\nEvidence:\n[E1] ", "\nQuotation:\n", " [E1]"
ABSTAIN = "Task: answer from evidence alone.\nEvidence:\n\nQuotation:\nThe evidence says nothing of it."


def _literal(text: str) -> str:
    return " || chr(10) || ".join(f"'{part}'" for part in text.split("\n"))


@query(
    f"WITH {SPANS_SQL} SELECT doc_id, span_ord::INT AS span_ord, 'evidence' AS kind, {_literal(ASK)} || text || {_literal(ANSWER)} || text || {_literal(CITE)} AS example FROM spans"
    f" UNION ALL SELECT NULL, NULL, 'abstention', {_literal(ABSTAIN)}"
)
def control_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, span_ord, kind, example): each whole span as evidence and again as the answer, and one abstention for the corpus."""
    example = F.concat(F.lit(ASK), "text", F.lit(ANSWER), "text", F.lit(CITE))
    rows = spans(documents(spark, sf_dir)).select("doc_id", "span_ord", F.lit("evidence").alias("kind"), example.alias("example"))
    without = spark.range(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("span_ord"), F.lit("abstention").alias("kind"), F.lit(ABSTAIN).alias("example"))
    return rows.unionByName(without)


@query("SELECT doc_id, least(512, greatest(16, pow(2, ceil(log2(greatest(n_chars, 1))))))::INT AS bucket FROM documents")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of two that a document is padded to, between 16 and 512."""
    return documents(spark, sf_dir).select("doc_id", F.least(F.lit(512), F.greatest(F.lit(16), F.pow(F.lit(2), F.ceil(F.log2(F.greatest("n_chars", F.lit(1))))))).cast("int").alias("bucket"))
