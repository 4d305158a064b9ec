"""Digests of a corpus in order, as a tree: no task sees the whole corpus, and a change is found by going down.

Documents stand by the SHA-256 of their id. A document's digest covers its records in order, a node's digest its children in order;
the nodes are the ids' hash prefixes of 8, 6, 4, 2 and 0 digits. Prefixes are ranges of that order, the same ones in every corpus,
so two trees compare node by node. A node above the documents has 256 children at most; a document's records are digested by ranges of RANGE first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.shared import written
from ..sources.tables import SPANS_SQL, documents, spans, table

#: Digits of the prefixes, from the documents up, and the records of a document that one part of its digest covers.
LEVELS = (8, 6, 4, 2, 0)
RANGE = 1024


def place(key: Column) -> Column:
    """Where a document stands: the SHA-256 of its id, as hexadecimal digits."""
    return F.sha2(key, 256)


def _ordered(of: str, name: str) -> Column:
    """The digest of a group's (of, name) rows in the order of of: one line each."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(of, name))), lambda r: F.concat_ws(":", r[of].cast("string"), r[name]))
    return F.sha2(F.array_join(lines, "\n"), 256)


def document_digests(records: DataFrame, key: str, ordinal: str, digest: str, *sums: str) -> DataFrame:
    """(key, digest, n, sums...): every document of records(key, ordinal, digest), where digest stands for a record's content; sums are columns that are added up.

    Records of one place stand by their digests. A null digest is left out of its line, a null key gives no document.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(ordinal).alias("ordinal"), F.coalesce(digest, F.lit("")).alias("digest"), *sums)
    total = [F.sum(c).alias(c) for c in sums]
    parts = rows.groupBy("key", F.floor(F.col("ordinal") / RANGE).alias("part")).agg(_ordered("ordinal", "digest").alias("digest"), F.count(F.lit(1)).alias("n"), *total)
    return parts.groupBy("key").agg(_ordered("part", "digest").alias("digest"), F.sum("n").alias("n"), *total).select(F.col("key").alias(key), "digest", "n", *sums)


def nodes(digests: DataFrame, key: str, levels: tuple[int, ...] = LEVELS) -> dict[int, DataFrame]:
    """Tables (prefix, digest, n) by level over document_digests(); n counts documents. An empty corpus has no nodes."""
    rows = digests.select(place(F.col(key).cast("string")).alias("place"), "digest", F.lit(1).cast("bigint").alias("n"))
    out = {}
    for level in levels:
        rows = rows.groupBy(F.substring("place", 1, level).alias("prefix")).agg(_ordered("place", "digest").alias("digest"), F.sum("n").alias("n"))
        out[level] = rows
        rows = rows.select(F.col("prefix").alias("place"), "digest", "n")
    return out


def tree(digests: DataFrame, key: str) -> DataFrame:
    """(level, prefix, digest, n): all nodes, as a table."""
    made = nodes(written(digests, "digests"), key)
    whole = None
    for level, rows in made.items():
        part = rows.select(F.lit(level).alias("level"), "prefix", "digest", "n")
        whole = part if whole is None else whole.unionByName(part)
    return written(whole, "tree")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(level, prefix, state): the nodes of two trees that differ, from the root down; only below a node that differs is looked further.

    state is changed, added (before has no such node) or removed.
    """
    out, open_ = None, None
    for above, level in zip((None, *reversed(LEVELS)), reversed(LEVELS)):
        a, b = (t.where(F.col("level") == level).select("prefix", F.col("digest").alias(n)) for t, n in ((before, "a"), (after, "b")))
        if open_ is not None:
            a, b = (t.join(open_, F.substring(t["prefix"], 1, above) == F.col("under"), "left_semi") for t in (a, b))
        both = written(a.join(b, "prefix", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))), "changed")
        state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
        part = both.select(F.lit(level).alias("level"), "prefix", state.alias("state"))
        out = part if out is None else out.unionByName(part)
        open_ = both.select(F.col("prefix").alias("under"))
    return out


def _of_spans(docs: DataFrame) -> DataFrame:
    rows = spans(docs).select("doc_id", "span_ord", F.sha2("text", 256).alias("digest"))
    return document_digests(rows, "doc_id", "span_ord", "digest")


def reviewed(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document digests of docs, and of docs without those labelled toxic, in which those of no quality have their lines put together.

    Both forms of every text are digested where it is read, so that labels meet digests and no text is shuffled.
    """
    first = written(_of_spans(docs), "digests")
    joined = _of_spans(docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))).select("doc_id", F.col("digest").alias("joined"), F.col("n").alias("n_joined"))
    low, out = (labels.where(c).select("doc_id").distinct() for c in ("quality = 0 AND toxic = 0", "toxic = 1"))
    put = written(joined.join(low, "doc_id", "left_semi"), "joined")
    after = first.join(out, "doc_id", "left_anti").join(put, "doc_id", "left")
    return first, after.select("doc_id", F.coalesce("joined", "digest").alias("digest"), F.coalesce("n_joined", "n").alias("n"))


def tree_sql(name: str, source: str) -> str:
    """CTEs that end in {name}_tree(level, prefix, digest, n), over the spans of source(doc_id, text)."""
    own = SPANS_SQL.replace("spans AS", f"{name}_spans AS", 1).replace("FROM documents", f"FROM {source}")
    parts = [
        own,
        f"{name}_parts AS (SELECT doc_id, span_ord // {RANGE} AS part, sha256(string_agg(span_ord || ':' || sha256(text), chr(10) ORDER BY span_ord)) AS digest FROM {name}_spans GROUP BY ALL)",
        f"{name}_docs AS (SELECT sha256(doc_id::VARCHAR) AS place, sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part)) AS digest, 1::BIGINT AS n FROM {name}_parts GROUP BY doc_id)",
    ]
    last = f"{name}_docs"
    for level in LEVELS:
        parts.append(f"{name}_{level} AS MATERIALIZED (SELECT substr(place, 1, {level}) AS place, sha256(string_agg(place || ':' || digest, chr(10) ORDER BY place)) AS digest, sum(n)::BIGINT AS n FROM {last} GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY 1"))
        last = f"{name}_{level}"
    return ",\n".join(parts) + f",\n{name}_tree AS (" + " UNION ALL ".join(f"SELECT {level} AS level, place AS prefix, digest, n FROM {name}_{level}" for level in LEVELS) + ")"


@query(f"WITH {tree_sql('own', 'documents')} SELECT level, prefix, digest, n FROM own_tree")
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all documents' spans in order, up to the one of the whole corpus (level 0)."""
    return tree(_of_spans(documents(spark, sf_dir)), "doc_id")


REVIEWED_SQL = """reviewed AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0) THEN replace(text, chr(10), ' ') ELSE text END AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))"""


@query(
    f"WITH {REVIEWED_SQL}, {tree_sql('own', 'documents')}, {tree_sql('new', 'reviewed')} SELECT level, prefix, CASE WHEN own_tree.digest IS NULL THEN 'added' WHEN new_tree.digest IS NULL THEN 'removed' ELSE 'changed' END AS state"
    " FROM own_tree FULL JOIN new_tree USING (level, prefix) WHERE own_tree.digest IS DISTINCT FROM new_tree.digest"
)
def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of documents in which the reviewed corpus differs from the first one."""
    before, after = reviewed(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return changed(tree(before, "doc_id"), tree(after, "doc_id"))
