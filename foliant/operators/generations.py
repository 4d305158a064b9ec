"""Generations of a corpus: written, changed and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.shared import discard, fresh_path
from ..sources.store import DIGITS, Corpus, chunk_identity
from ..sources.tables import SPANS_SQL, documents, spans, table
from .digests import RANGE


def span_chunks(docs: DataFrame) -> DataFrame:
    """The spans of documents as chunks of a corpus: document_id, ordinal, section, text and chunk_id."""
    rows = spans(docs).select(F.col("doc_id").cast("string").alias("document_id"), F.col("span_ord").cast("int").alias("ordinal"), F.lit("").alias("section"), "text")
    return rows.withColumn("chunk_id", chunk_identity())


def _sql(name: str, source: str) -> str:
    """One row for the generation of source(doc_id, text)."""
    own = SPANS_SQL.replace("spans AS", f"{name}_spans AS", 1).replace("FROM documents", f"FROM {source}")
    return f"""{own},
{name}_c AS (SELECT doc_id::VARCHAR AS d, span_ord AS o, text, 'chk_' || substr(sha256(doc_id || '|' || span_ord || '||' || text), 1, 32) AS chunk_id FROM {name}_spans),
{name}_p AS (SELECT d, o // {RANGE} AS p, sha256(string_agg(o || ':' || chunk_id, chr(10) ORDER BY o)) AS digest, count(*) AS chunks, sum(len(string_split(text, ' '))) AS words FROM {name}_c GROUP BY 1, 2),
{name}_0 AS (SELECT sha256(d) AS place, sha256(string_agg(p || ':' || digest, chr(10) ORDER BY p)) AS digest, sum(chunks) AS chunks, sum(words) AS words FROM {name}_p GROUP BY d),
{name}_8 AS (SELECT substr(place, 1, 8) AS place, sha256(string_agg(place || ':' || digest, chr(10) ORDER BY place)) AS digest FROM {name}_0 GROUP BY 1),
{name}_4 AS (SELECT substr(place, 1, 4) AS place, sha256(string_agg(place || ':' || digest, chr(10) ORDER BY place)) AS digest FROM {name}_8 GROUP BY 1),
{name}_2 AS (SELECT substr(place, 1, {DIGITS}) AS place, sha256(string_agg(place || ':' || digest, chr(10) ORDER BY place)) AS digest FROM {name}_4 GROUP BY 1),
{name}_r AS (SELECT (SELECT count(*) FROM {name}_0) AS documents, (SELECT sum(chunks) FROM {name}_0)::BIGINT AS chunks, (SELECT sum(words) FROM {name}_0)::BIGINT AS words, (SELECT sha256(string_agg(place || ':' || digest, chr(10) ORDER BY place)) FROM {name}_2) AS digest)"""


_BLOCKS = {
    "g1": "documents",
    "g2": "(SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0) THEN replace(text, chr(10), ' ') ELSE text END AS text FROM documents)",
    "g3": "(SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0) THEN replace(text, chr(10), ' ') ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))",
}


@query(
    "WITH " + ",\n".join(_sql(k, v) for k, v in _BLOCKS.items())
    + " SELECT generation, documents, chunks, words, digest, 0::BIGINT AS n_faults, action FROM ("
    + " UNION ALL ".join(f"SELECT {k[1]} AS generation, *, '{a}' AS action FROM {k}_r" for k, a in zip(_BLOCKS, ("replace", "put", "remove"))) + ")"
)
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of all documents' spans: written whole, those of no quality put again with their lines put together, the toxic ones removed; each read back and checked."""
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")
    corpus = Corpus(spark, fresh_path(spark, "corpus"))
    corpus.replace(span_chunks(docs))
    low = docs.join(labels.where("quality = 0 AND toxic = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    corpus.put(span_chunks(low.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    corpus.remove(toxic.join(corpus.documents(), "document_id", "left_semi"))
    rows, numbers = [], list(range(1, corpus.head() + 1))
    seen = corpus.seen(numbers)
    for number in numbers:
        entry = corpus.entry(number)
        rows.append((number, entry["action"], *(entry["aggregate"][k] for k in ("documents", "chunks", "words")), entry["digest"], corpus.faults(number, seen).count()))
    for path in seen[2]:
        discard(path)
    return spark.createDataFrame(rows, "generation int, action string, documents bigint, chunks bigint, words bigint, digest string, n_faults bigint")
