"""Spans, segments, windows and chunks of documents; their identities, digests and integrity checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.tables import SPANS_SQL, documents, spans, table

#: Words of a window, words that two windows share, and words below which a window is short.
TARGET, OVERLAP, MINIMUM = 220, 40, 12
#: Lines of a page.
PAGE_LINES = 60


def by_span(rows: str = "doc_id") -> Window:
    return Window.partitionBy(rows).orderBy("span_ord")


def with_sections(spans: DataFrame) -> DataFrame:
    """Adds section (the last heading so far, '' before the first), page, kind and segment (a new one at each heading, page and change of kind).

    A page is PAGE_LINES lines of the text, a span with two bars or more is of a table. Sections go on over pages.
    """
    rows = spans.withColumn("page", (F.floor(F.col("span_ord") / PAGE_LINES) + 1).cast("int")).withColumn("kind", F.when(F.regexp_count("text", F.lit(r"\|")) > 1, "table").otherwise("text"))
    past = by_span().rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(past), F.lit(""))
    other = F.coalesce(F.lag("page").over(by_span()) != F.col("page"), F.lit(False)) | F.coalesce(F.lag("kind").over(by_span()) != F.col("kind"), F.lit(False))
    begun = rows.withColumn("section", section).withColumn("begins", (F.col("is_heading") | other).cast("bigint"))
    return begun.withColumn("segment", F.sum("begins").over(past)).drop("begins")


SECTIONS_SQL = SPANS_SQL + f""",
paged AS (SELECT *, (span_ord // {PAGE_LINES} + 1)::INT AS page, CASE WHEN len(regexp_extract_all(text, '\\|')) > 1 THEN 'table' ELSE 'text' END AS kind FROM spans),
begun AS (SELECT *, is_heading OR coalesce(lag(page) OVER w <> page, false) OR coalesce(lag(kind) OVER w <> kind, false) AS begins FROM paged WINDOW w AS (PARTITION BY doc_id ORDER BY span_ord)),
sections AS MATERIALIZED (SELECT * EXCLUDE (begins), coalesce(last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER w, '') AS section, sum(begins::INT) OVER w::BIGINT AS segment
  FROM begun WINDOW w AS (PARTITION BY doc_id ORDER BY span_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, span_ord::INT AS span_ord, section FROM sections")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active section of every span."""
    return with_sections(spans(documents(spark, sf_dir))).select("doc_id", "span_ord", "section")


def segments(spans: DataFrame) -> DataFrame:
    """(doc_id, segment, section, page, kind, first_span, n_spans, text): the spans of a segment joined in their order by one space."""
    rows = with_sections(spans).groupBy("doc_id", "segment").agg(F.min("span_ord").alias("first_span"), F.count(F.lit(1)).alias("n_spans"), *[F.max(c).alias(c) for c in ("section", "page", "kind")], F.array_sort(F.collect_list(F.struct("span_ord", "text"))).alias("parts"))
    return rows.select("doc_id", "segment", "section", "page", "kind", "first_span", "n_spans", F.array_join(F.col("parts.text"), " ").alias("text"))


SEGMENTS_SQL = SECTIONS_SQL + """,
segments AS MATERIALIZED (SELECT doc_id, segment, max(section) AS section, max(page) AS page, max(kind) AS kind, min(span_ord)::INT AS first_span, count(*) AS n_spans, string_agg(text, ' ' ORDER BY span_ord) AS text FROM sections GROUP BY doc_id, segment)"""


@query(f"WITH {SEGMENTS_SQL} SELECT doc_id, segment, section, page, kind, first_span, n_spans, length(text)::BIGINT AS n_chars FROM segments")
def segment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every document."""
    return segments(spans(documents(spark, sf_dir))).select("doc_id", "segment", "section", "page", "kind", "first_span", "n_spans", F.length("text").cast("bigint").alias("n_chars"))


def word_windows_of(words: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Start places (from 0) of windows over an array of words: a step of target - overlap, the last window reaching the end."""
    n = F.size(words)
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(target - overlap)), lambda s: (n > 0) & ((s == 0) | (n - s > overlap)))


def windows(segments: DataFrame, target: int = TARGET, overlap: int = OVERLAP, minimum: int = MINIMUM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, segment, keep..., window, start, n_words, text): sliding windows; a last one shorter than minimum joins the one before. keep are columns of segments."""
    if target < 16 or not 0 <= overlap < target or not 1 <= minimum <= target:
        raise ValueError("windows need 16 words at least, an overlap below that, and a minimum from 1 to it")
    rows = segments.select("doc_id", "segment", *keep, F.split("text", " ").alias("words"))
    rows = rows.withColumn("starts", word_windows_of(F.col("words"), target, overlap))
    n, k = F.size("words"), F.size("starts")
    short = (k > 1) & (n - F.element_at("starts", -1) < minimum)
    rows = rows.withColumn("joined", short).withColumn("starts", F.when(F.col("joined"), F.slice("starts", 1, F.greatest(k - 1, F.lit(0)))).otherwise(F.col("starts")))
    def piece(start: Column, window: Column) -> Column:
        # the joined tail repeats the words of the overlap, as two whole windows put together do
        last = (window == F.size("starts") - 1) & F.col("joined")
        own = F.slice("words", start + 1, target)
        tail = F.slice("words", start + 1 + target - overlap, F.lit(target))
        words = F.when(last, F.concat(own, tail)).otherwise(own)
        return F.struct(start.alias("start"), F.size(words).alias("n_words"), F.array_join(words, " ").alias("text"))

    # pieces are cut in their segment's row, so that no window carries all of its words; an inner explode would make them once more, in a filter on their number
    each = rows.select("doc_id", "segment", *keep, F.transform("starts", piece).alias("pieces"))
    return each.select("doc_id", "segment", *keep, F.posexplode_outer("pieces").alias("window", "p")).where("p IS NOT NULL").select("doc_id", "segment", *keep, "window", "p.start", "p.n_words", "p.text")


def _windows_sql(target: int, overlap: int, minimum: int) -> str:
    step = target - overlap
    return f"""
ww AS (SELECT doc_id, segment, string_split(text, ' ') AS words FROM segments),
ws AS (SELECT *, len(words) AS n, list_filter(range(0, len(words), {step}), lambda s: s = 0 OR len(words) - s > {overlap}) AS s0 FROM ww),
wj AS (SELECT *, len(s0) > 1 AND n - s0[-1] < {minimum} AS joined FROM ws),
wt AS (SELECT *, CASE WHEN joined THEN s0[:len(s0) - 1] ELSE s0 END AS s FROM wj),
we AS (SELECT *, unnest(s) AS start, generate_subscripts(s, 1) - 1 AS k FROM wt),
windows AS MATERIALIZED (SELECT doc_id, segment, k::INT AS "window", start::INT AS start,
  CASE WHEN joined AND k = len(s) - 1 THEN words[start + 1:start + {target}] || words[start + 1 + {step}:start + {step + target}] ELSE words[start + 1:start + {target}] END AS piece FROM we)"""


@query(f'WITH {SEGMENTS_SQL}, {_windows_sql(TARGET, OVERLAP, MINIMUM)} SELECT doc_id, segment, "window", start, len(piece)::INT AS n_words, md5(array_to_string(piece, \' \')) AS digest FROM windows')
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 220 words that share 40."""
    return windows(segments(spans(documents(spark, sf_dir)))).withColumn("digest", F.md5("text")).drop("text")


@query(f'WITH {SEGMENTS_SQL}, {_windows_sql(32, 4, 12)} SELECT doc_id, segment, "window", start, len(piece)::INT AS n_words, md5(array_to_string(piece, \' \')) AS digest FROM windows')
def short_tail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 32 words that share 4, where tails of fewer than 12 words do occur and join the window before."""
    return windows(segments(spans(documents(spark, sf_dir))), 32, 4, 12).withColumn("digest", F.md5("text")).drop("text")


def carried(sizes: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """(doc_id, segment, chunk): which segments of a document make one chunk, of sizes(doc_id, segment, k, n, page, kind).

    A segment of a single window (k = 1) whose n words, with those that it is given, stay below minimum gives them on to the next segment,
    if that is on its page and of its kind. chunk numbers the receivers. Segments that may give are folded by stretches, as numbers alone.
    """
    by = Window.partitionBy("doc_id").orderBy("segment")
    near = (F.lead("page").over(by) == F.col("page")) & (F.lead("kind").over(by) == F.col("kind"))
    rows = sizes.withColumn("may", (F.col("k") == 1) & (F.col("n") < minimum) & F.coalesce(near, F.lit(False)))
    rows = rows.withColumn("stretch", F.sum((~F.col("may") | ~F.coalesce(F.lag("may").over(by), F.lit(False))).cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    folded = rows.where("may").groupBy("doc_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("segment", "n"))).alias("s"))
    # words on their way after every segment of a stretch: 0 where it gives none on
    gives = F.aggregate("s", F.expr("named_struct('c', 0, 'o', cast(array() AS array<boolean>))"), lambda a, x: F.struct(F.when(a["c"] + x["n"] < minimum, a["c"] + x["n"]).otherwise(0).alias("c"), F.array_append(a["o"], a["c"] + x["n"] < minimum).alias("o")), lambda a: a["o"])
    given = folded.select("doc_id", F.explode(F.arrays_zip(F.col("s.segment").alias("segment"), gives.alias("gives"))).alias("g")).select("doc_id", "g.segment", "g.gives")
    every = given.unionByName(rows.where("NOT may").select("doc_id", "segment", F.lit(False).alias("gives")))
    starts = (~F.coalesce(F.lag("gives").over(by), F.lit(False))).cast("bigint")
    return every.withColumn("starts", starts).select("doc_id", "segment", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("chunk"))


def chunks(spans: DataFrame, target: int = TARGET, overlap: int = OVERLAP, minimum: int = MINIMUM) -> DataFrame:
    """(doc_id, ordinal, section, page, kind, n_words, text): the canonical chunks of every document.

    A segment of a single window shorter than minimum is carried into the next segment of its page and kind, chained, and the
    receiver keeps its own section. Null and empty texts have no chunk.
    """
    each = windows(segments(spans), target, overlap, minimum, ("section", "page", "kind"))
    sizes = each.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("window") == 0, F.col("n_words"))).alias("n"), F.max("page").alias("page"), F.max("kind").alias("kind"))
    placed = each.join(carried(sizes, minimum), ["doc_id", "segment"])
    # what is carried stands before the receiver's first window
    parts = F.sort_array(F.collect_list(F.struct("segment", "text", "section", "page", "kind")))
    whole = placed.groupBy("doc_id", "chunk", "window").agg(parts.alias("p"))
    last = F.element_at("p", -1)
    text = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    rows = whole.select("doc_id", "chunk", "window", last["section"].alias("section"), last["page"].alias("page"), last["kind"].alias("kind"), text.alias("text"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "window")) - 1
    return rows.select("doc_id", ordinal.alias("ordinal"), "section", "page", "kind", F.size(F.split("text", " ")).alias("n_words"), "text")


CHUNKS_SQL = f"""WITH RECURSIVE {SEGMENTS_SQL}, {_windows_sql(TARGET, OVERLAP, MINIMUM)},
sz AS (SELECT doc_id, segment, count(*) AS k, max(CASE WHEN "window" = 0 THEN len(piece) END) AS n FROM windows GROUP BY ALL),
nm AS MATERIALIZED (SELECT doc_id, segment, n, row_number() OVER o AS i, k = 1 AND coalesce(lead(page) OVER o = page AND lead(kind) OVER o = kind, false) AS may FROM sz JOIN segments USING (doc_id, segment) WINDOW o AS (PARTITION BY doc_id ORDER BY segment)),
wk AS (SELECT doc_id, i, CASE WHEN may AND n < {MINIMUM} THEN n ELSE 0 END AS c FROM nm WHERE i = 1
  UNION ALL SELECT nm.doc_id, nm.i, CASE WHEN may AND c + n < {MINIMUM} THEN c + n ELSE 0 END FROM wk JOIN nm ON nm.doc_id = wk.doc_id AND nm.i = wk.i + 1),
st AS (SELECT doc_id, i, coalesce(lag(c) OVER o, 0) = 0 AS starts FROM wk WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ck AS (SELECT doc_id, i, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM st),
pt AS (SELECT w.doc_id, chunk, "window", w.segment, section, page, kind, array_to_string(piece, ' ') AS text FROM windows w JOIN nm USING (doc_id, segment) JOIN ck USING (doc_id, i) JOIN segments USING (doc_id, segment)),
ch AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk, "window") - 1)::INT AS ordinal, section, page, kind, text FROM (
  SELECT doc_id, chunk, "window", arg_max(section, segment) AS section, arg_max(page, segment) AS page, arg_max(kind, segment) AS kind, string_agg(text, ' ' ORDER BY segment) AS text FROM pt GROUP BY doc_id, chunk, "window"))"""


@query(
    CHUNKS_SQL + " SELECT doc_id, ordinal, section, page, kind, len(string_split(text, ' '))::INT AS n_words, 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) AS document_id,"
    " 'chk_' || substr(sha256('doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) || '|' || ordinal || '|' || section || '|' || text), 1, 32) AS chunk_id FROM ch"
)
def canonical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their identities."""
    return identified(chunks(spans(documents(spark, sf_dir)))).drop("text")


def identified(chunks: DataFrame) -> DataFrame:
    """Adds document_id and chunk_id, digests of the content alone."""
    doc = F.concat(F.lit("doc_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24))
    canonical = F.concat_ws("|", doc, F.col("ordinal").cast("string"), F.col("section"), F.col("text"))
    return chunks.select("*", doc.alias("document_id"), T.chunk_id(canonical).alias("chunk_id"))


@query(f"WITH {SPANS_SQL} SELECT doc_id, span_ord::INT AS span_ord, 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) AS document_id, 'chk_' || substr(sha256('doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) || '|' || span_ord || '||' || text), 1, 32) AS chunk_id FROM spans")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed identities of all spans."""
    rows = spans(documents(spark, sf_dir)).select("doc_id", F.col("span_ord").alias("ordinal"), F.lit("").alias("section"), "text")
    return identified(rows).select("doc_id", F.col("ordinal").alias("span_ord"), "document_id", "chunk_id")


@query(f"WITH {SPANS_SQL} SELECT doc_id, sha256(string_agg(span_ord || ':' || text, chr(10) ORDER BY span_ord) || chr(10)) AS digest, count(*) AS n_spans FROM spans GROUP BY doc_id")
def document_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every document's spans in their order; a corpus digest over these needs one small row per document."""
    rows = spans(documents(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_ord", F.concat_ws(":", "span_ord", "text").alias("t")))).alias("parts"))
    return rows.select("doc_id", F.sha2(F.concat(F.array_join(F.col("parts.t"), "\n"), F.lit("\n")), 256).alias("digest"), F.size("parts").cast("bigint").alias("n_spans"))


@query(
    r"""SELECT count(*) AS n_documents, sum(strlen(text))::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS n_words,
  sum(greatest(1, ceil(length(text) / 4)))::BIGINT AS estimated_tokens, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents"""
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals over the corpus."""
    t = F.col("text")
    return documents(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.octet_length(t)).alias("n_bytes"), F.sum(F.length(t)).alias("n_chars"), F.sum(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))).alias("n_words"),
        F.sum(T.estimated_tokens(t)).alias("estimated_tokens"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
    )


@query("SELECT source, lang, count(*) AS n_documents, sum(length(text))::BIGINT AS n_chars, max(length(text))::BIGINT AS longest FROM documents GROUP BY ALL")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source and language."""
    n = F.length("text")
    return documents(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(n).alias("n_chars"), F.max(n).cast("bigint").alias("longest"))


@query("SELECT doc_id, 'orphan' AS problem FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'missing' AS problem FROM documents ANTI JOIN labels USING (doc_id)")
def closed_world_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a document, and documents without a label."""
    docs, labels = documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return labels.join(docs, "doc_id", "left_anti").withColumn("problem", F.lit("orphan")).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("problem", F.lit("missing")))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one document has; digests are shuffled, not texts."""
    return documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1")


@query("SELECT 'chk_' || substr(sha256(text), 1, 32) AS record_id, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed ids that stand more than once; ids are shuffled, not texts."""
    return documents(spark, sf_dir).groupBy(T.chunk_id(F.col("text")).alias("record_id")).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


@query(r"SELECT doc_id, n_chars, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words FROM documents WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) < 5")
def ghost_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with next to no words."""
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return documents(spark, sf_dir).select("doc_id", "n_chars", n.alias("n_words")).where("n_words < 5")


@query("SELECT doc_id, n_chars AS listed, strlen(text)::BIGINT AS found FROM documents WHERE n_chars <> strlen(text)")
def manifest_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose listed size is not the number of bytes that their text takes."""
    return documents(spark, sf_dir).select("doc_id", F.col("n_chars").alias("listed"), F.octet_length("text").cast("bigint").alias("found")).where("listed <> found")


@query("WITH t AS (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(DISTINCT doc_id) FROM documents) AS b, (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)) AS c, (SELECT count(*) FROM labels) AS d) SELECT a = b AS ids_unique, c = d AS labels_known, a AS n_documents, d AS n_labels FROM t")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: whether ids are unique and every label has its document."""
    docs, labels = documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    per_id = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    a = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.count("doc_id").alias("n_ids"))
    b = labels.agg(F.count(F.lit(1)).alias("n_labels")).crossJoin(labels.join(per_id, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n_known")))
    return a.crossJoin(b).select((F.col("n_documents") == F.col("n_ids")).alias("ids_unique"), (F.col("n_known") == F.col("n_labels")).alias("labels_known"), "n_documents", "n_labels")


def latest(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key, the first in the order newest: an upsert of versions."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where("_n = 1").drop("_n")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every user and type, as an upsert by that key keeps it."""
    return latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(
    "WITH v AS (SELECT user_id, event_id, ts, value, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events)"
    " SELECT user_id, arg_max(value, (ts, event_id)) AS value, first(paid ORDER BY ts DESC, event_id DESC) FILTER (paid IS NOT NULL) AS last_paid, count(*) AS versions FROM v GROUP BY user_id"
)
def retained_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value wins, while the last purchase is retained through later rows of other types."""
    order = F.struct("ts", "event_id")
    paid = F.when(F.col("event_type") == "purchase", F.col("value"))
    rows = table(spark, sf_dir, "events").select("user_id", "value", paid.alias("paid"), order.alias("o"))
    paid_at = F.when(F.col("paid").isNotNull(), F.col("o"))
    return rows.groupBy("user_id").agg(F.max_by("value", "o").alias("value"), F.max_by("paid", paid_at).alias("last_paid"), F.count(F.lit(1)).alias("versions"))


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, string_agg(CASE WHEN is_heading AND span_ord > 0 THEN chr(10) || '--- ' || text || ' ---' ELSE text END, chr(10) ORDER BY span_ord) AS text FROM sections GROUP BY doc_id")
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document with banners at its headings."""
    banner = F.when(F.col("is_heading") & (F.col("span_ord") > 0), F.concat(F.lit("\n--- "), F.col("text"), F.lit(" ---"))).otherwise(F.col("text"))
    parts = spans(documents(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_ord", banner.alias("t")))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.col("parts.t"), "\n").alias("text"))


@query(
    r"""WITH s AS (SELECT doc_id, source, 1 + doc_id % 97 AS page, (doc_id * 37) % 800 + 0.1234::DOUBLE AS y0, (doc_id * 53) % 600 + 0.5678::DOUBLE AS x0, n_chars FROM documents)
SELECT source, round(min(x0), 3) AS x0, round(min(y0), 3) AS y0, round(max(x0 + n_chars), 3) AS x1, round(max(y0 + 12), 3) AS y1, count(*) AS n FROM s GROUP BY source"""
)
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of boxes of each source, the boxes laid out from the ids."""
    s = documents(spark, sf_dir).select("source", "n_chars", F.expr("(doc_id * 37) % 800 + 0.1234D").alias("y0"), F.expr("(doc_id * 53) % 600 + 0.5678D").alias("x0"))
    return s.groupBy("source").agg(F.round(F.min("x0"), 3).alias("x0"), F.round(F.min("y0"), 3).alias("y0"), F.round(F.max(F.col("x0") + F.col("n_chars")), 3).alias("x1"), F.round(F.max(F.col("y0") + 12), 3).alias("y1"), F.count(F.lit(1)).alias("n"))


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, markdown): every table of two rows or more as markdown; rows are padded or cut to the header's width."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.html import markdown_tables

        for f in frames:
            rows = [(p, k, m) for p, h in zip(f["page_id"], f["html"]) for k, m in enumerate(markdown_tables(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "markdown"])

    return pages.select("page_id", "html").mapInPandas(parsed, "page_id bigint, table_no int, markdown string")


@query()
def html_table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables(table(spark, sf_dir, "pages"))


@query(
    """WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')), lambda x: list_transform(string_split(x, ' | '), lambda c: trim(c))) AS cells FROM documents),
m AS (SELECT doc_id, list_transform(cells, lambda c: '| ' || array_to_string(list_transform(range(1, len(cells[1]) + 1), lambda i: coalesce(c[i], '')), ' | ') || ' |') AS r, len(cells[1])::INT AS width FROM l WHERE len(cells) > 1)
SELECT doc_id, width, len(r)::INT AS n_rows, md5(array_to_string(r, chr(10))) AS digest FROM m"""
)
def line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with cells between bars as one markdown table a document, rows padded or cut to the first one's width."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit(" | ")))
    cells = F.transform(lines, lambda x: F.transform(F.split(x, r" \| "), lambda c: F.trim(c)))
    rows = documents(spark, sf_dir).select("doc_id", cells.alias("cells")).where("size(cells) > 1").withColumn("width", F.size(F.get("cells", F.lit(0))))
    line = F.transform("cells", lambda c: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get(c, i), F.lit(""))), " | "), F.lit(" |")))
    return rows.select("doc_id", "width", F.size("cells").alias("n_rows"), F.md5(F.array_join(line, "\n")).alias("digest"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) IN ('localhost', '127.0.0.1') AND lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) IN ('http', 'https', 'ws', 'wss') AS allowed FROM pages")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's address is a web or socket address of this machine."""
    scheme, host = F.lower(F.regexp_extract("url", r"^([a-zA-Z]+)://", 1)), F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    ok = scheme.isin("http", "https", "ws", "wss") & host.isin("localhost", "127.0.0.1")
    return table(spark, sf_dir, "pages").select("page_id", scheme.alias("scheme"), host.alias("host"), ok.alias("allowed"))
