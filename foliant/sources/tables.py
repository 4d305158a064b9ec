"""Readers of the input tables, and the tables that stand for spans, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder; columns and filters are pushed into its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt out to all cores where the scan has fewer tasks than there are cores.

    A file of one row group is read by one task, however long the texts in it take. A table of many files or row groups stays as it
    is, without an exchange. Filters and column pruning pass through to the scan.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, span_ord, text, is_heading): each non-blank line of a document is a span; a line of at most eight words without a final mark is a heading."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("span_ord", "line"))
    # a single space stays as it is
    text = F.trim(F.regexp_replace("line", r" \s+|[\t\n\x0B\f\r]\s*", " "))
    short = F.size(F.split("text", " ")) <= 8
    return line.select("doc_id", "span_ord", text.alias("text")).where("text <> ''").withColumn("is_heading", short & ~F.col("text").rlike(r"[.!?]$"))


#: The same in DuckDB. Java's \s and RE2's are the ASCII blanks, but for the vertical tab.
SPANS_SQL = r"""
spans AS (
  SELECT doc_id, span_ord, text, len(string_split(text, ' ')) <= 8 AND NOT regexp_matches(text, '[.!?]$') AS is_heading
  FROM (SELECT doc_id, i - 1 AS span_ord, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  WHERE text <> '')"""
