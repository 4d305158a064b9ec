"""Validators, listings and further joins: what a corpus and its tables must satisfy, and how they are paged through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.tables import SPANS_SQL, documents, spans, table
from .corpus import SECTIONS_SQL, SEGMENTS_SQL, identified, segments, with_sections
from .curiosity import CONTENT_SQL, SIGNALS_SQL, content_counts
from .terms import TOKENS_SQL, postings


@query(r"SELECT doc_id, regexp_matches(source, '^[a-z][a-z0-9_.:-]{0,63}$') AS label_ok, regexp_matches(lang, '^[a-z]{2}$') AS lang_ok, length(text) = n_chars AS size_ok, sha256(text) = sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS digest_ok FROM documents")
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the label, language and size of every document are well formed, and its digest is that of its canonical form."""
    return documents(spark, sf_dir).select(
        "doc_id", F.col("source").rlike(r"^[a-z][a-z0-9_.:-]{0,63}$").alias("label_ok"), F.col("lang").rlike(r"^[a-z]{2}$").alias("lang_ok"),
        (F.length("text") == F.col("n_chars")).alias("size_ok"), (F.sha2("text", 256) == F.sha2(T.squeeze(F.col("text")), 256)).alias("digest_ok"),
    )


@query(r"SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS basename, regexp_matches(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '^[A-Za-z0-9_.-]+$') AND regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) NOT IN ('.', '..') AS valid FROM pages")
def filename_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part of a page's address, and whether it would do as a file name."""
    name = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("basename"), (name.rlike("^[A-Za-z0-9_.-]+$") & ~name.isin(".", "..")).alias("valid"))


@query(
    f"WITH {SPANS_SQL}, i AS (SELECT doc_id, span_ord, text, 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 24) AS d FROM spans), c AS (SELECT doc_id, 'chk_' || substr(sha256(d || '|' || span_ord || '||' || text), 1, 32) AS id, 'chk_' || substr(sha256(d || '|' || span_ord || '||' || CASE WHEN span_ord = 3 THEN upper(text) ELSE text END), 1, 32) AS found FROM i)"
    " SELECT doc_id, count(*) AS n_records, count(*) FILTER (id <> found) AS n_changed FROM c GROUP BY doc_id"
)
def identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a document's records no longer have the id of their content, after the fourth span of each is put in capitals."""
    rows = spans(documents(spark, sf_dir)).select("doc_id", F.col("span_ord").alias("ordinal"), F.lit("").alias("section"), "text")
    listed = identified(rows).select("doc_id", "ordinal", "section", "text", F.col("chunk_id").alias("listed"))
    changed = listed.withColumn("text", F.when(F.col("ordinal") == 3, F.upper("text")).otherwise(F.col("text")))
    return identified(changed).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("listed") != F.col("chunk_id")).alias("n_changed"))


@query(f"WITH {SPANS_SQL}, p AS (SELECT doc_id, count(*) AS n_spans, sum(length(text))::BIGINT AS n FROM spans GROUP BY doc_id) SELECT d.doc_id, coalesce(n_spans, 0) AS n_spans, d.n_chars - coalesce(n, 0) AS difference FROM documents d LEFT JOIN p USING (doc_id) WHERE d.n_chars <> coalesce(n, 0)")
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose spans do not add up to their listed size, as blanks at line ends make it."""
    docs = documents(spark, sf_dir)
    parts = spans(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.length("text")).alias("n"))
    zero = F.lit(0).cast("bigint")
    return docs.select("doc_id", "n_chars").join(parts, "doc_id", "left").select("doc_id", F.coalesce("n_spans", zero).alias("n_spans"), (F.col("n_chars") - F.coalesce("n", zero)).alias("difference")).where("difference <> 0")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE sha256(d.text) = sha256(b.text))")
def missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose text no document has, by digest."""
    held = documents(spark, sf_dir).select(F.sha2("text", 256).alias("digest"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("digest")).join(held, "digest", "left_anti").select("item_id")


@query(f"WITH {SECTIONS_SQL}, m AS (SELECT doc_id, section, span_ord::INT AS anchor, lead(span_ord) OVER w::INT AS a, lead(span_ord, 2) OVER w::INT AS b FROM sections WHERE section <> '' WINDOW w AS (PARTITION BY doc_id, section ORDER BY span_ord)) SELECT doc_id, anchor, unnest([a, b]) AS mate FROM m WHERE a IS NOT NULL")
def section_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span with the next two of its section; where there is but one, the second is null."""
    w = Window.partitionBy("doc_id", "section").orderBy("span_ord")
    rows = with_sections(spans(documents(spark, sf_dir))).where("section <> ''").select("doc_id", F.col("span_ord").alias("anchor"), F.lead("span_ord", 1).over(w).alias("a"), F.lead("span_ord", 2).over(w).alias("b"))
    return rows.where("a IS NOT NULL").select("doc_id", "anchor", F.explode(F.array("a", "b")).alias("mate"))


@query(f"WITH {SPANS_SQL}, m AS (SELECT doc_id, span_ord, text, lag(span_ord) OVER w AS before, len(string_split(text, ' ')) AS n FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY span_ord)) SELECT doc_id, count(*) FILTER (n < 15) AS n_small, count(*) AS n_spans, max(n)::BIGINT AS longest FROM m GROUP BY doc_id")
def small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of a document are so short that they would be merged."""
    n = F.size(F.split("text", " "))
    return spans(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(n < 15).alias("n_small"), F.count(F.lit(1)).alias("n_spans"), F.max(n).cast("bigint").alias("longest"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a word anywhere, in any case."""
    return documents(spark, sf_dir).where(F.lower("text").contains("license") | F.lower("source").contains("license")).select("doc_id", "source")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND event_id > 500 AND value > 10 ORDER BY event_id LIMIT 100")
def audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of an audit log under its filters."""
    return table(spark, sf_dir, "events").where("event_type = 'error' AND event_id > 500 AND value > 10").select("event_id", "user_id", "value").orderBy("event_id").limit(100)


@query("SELECT source, doc_id, n_chars, place FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS place FROM documents) WHERE place <= 5")
def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest documents of each source."""
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return documents(spark, sf_dir).select("source", "doc_id", "n_chars", F.row_number().over(order).alias("place")).where("place <= 5")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS k FROM documents) WHERE k = 1")
def seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source, by a hash of its id in place of chance."""
    order = F.md5(F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).groupBy("source").agg(F.min_by("doc_id", order).alias("doc_id"))


@query(f"WITH {CONTENT_SQL}, r AS (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term)::INT AS place FROM cc) SELECT doc_id, term, tf, place FROM r WHERE place <= 10 AND NOT regexp_matches(term, '^[0-9]+$')")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent content terms of each document, less those that are numbers."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    return content_counts(documents(spark, sf_dir)).withColumn("place", F.row_number().over(order)).where("place <= 10").where(~F.col("term").rlike("^[0-9]+$"))


@query("SELECT doc_id, CASE WHEN len(w) > 60 THEN array_to_string(w[1:60], ' ') || '…' ELSE array_to_string(w, ' ') END AS summary FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents)")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty words of every document, which is what a summary is here."""
    return documents(spark, sf_dir).select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(f"WITH {TOKENS_SQL}, t AS (SELECT doc_id, list(term) AS l FROM tok GROUP BY doc_id), d AS (SELECT doc_id, coalesce(l, []) AS l FROM documents LEFT JOIN t USING (doc_id)) SELECT doc_id, least(len(l), 64)::INT AS n_kept, greatest(64 - len(l), 0)::INT AS n_padding FROM d")
def padded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a row of 64 keeps, and the padding that it needs."""
    n = F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", F.least(n, F.lit(64)).alias("n_kept"), F.greatest(64 - n, F.lit(0)).alias("n_padding"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, strftime(ts, '%Y-%m-%d') AS day, round(epoch(ts - (SELECT min(ts) FROM events)) / 3600, 2) AS uptime_hours FROM events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text with their zone, as days, and as hours since the first event."""
    rows = table(spark, sf_dir, "events")
    start = F.broadcast(rows.agg(F.min("ts").alias("start")))  # one row
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.crossJoin(start).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round((micros("ts") - micros("start")) / 1e6 / 3600, 2).alias("uptime_hours"))


@query("SELECT event_id, sha256(event_type || '|' || user_id || '|' || coalesce(props, '')) AS digest FROM events")
def request_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every request's canonical form."""
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.coalesce("props", F.lit(""))), 256).alias("digest"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, round(sum(n_chars / t), 6) AS total, min(n_chars) >= 0 AS non_negative FROM documents, (SELECT sum(n_chars) AS t FROM documents)")
def sampling_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: whether sampling weights by size cover every id once, are not negative, and add up to one."""
    rows = documents(spark, sf_dir).select("doc_id", "n_chars")
    total = F.broadcast(rows.agg(F.sum("n_chars").alias("t")))  # one row
    return rows.crossJoin(total).groupBy().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_ids"), F.round(F.sum(F.col("n_chars") / F.col("t")), 6).alias("total"), (F.min("n_chars") >= 0).alias("non_negative"))


@query(f"WITH {SIGNALS_SQL} SELECT s.user_id, visits, c_custkey IS NOT NULL AS known FROM sig s LEFT JOIN customer c ON c.c_custkey = s.user_id")
def signal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, and whether what they refer to exists."""
    signals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("visits"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    return signals.join(known, "user_id", "left").select("user_id", "visits", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT user_id, max(value) AS best, arg_max(event_id, (value, -event_id)) AS best_event FROM events WHERE value IS NOT NULL GROUP BY user_id")
def best_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest reward of each user, and the first event that gave it."""
    at = F.struct("value", (-F.col("event_id")).alias("o"))
    return table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_id", at).alias("best_event"))


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def measurement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {SEGMENTS_SQL}, g AS (SELECT doc_id, segment, section, n_spans, lag(text) OVER w AS before, text FROM segments WINDOW w AS (PARTITION BY doc_id ORDER BY segment)) SELECT doc_id, segment, coalesce(before = text, false) AS repeats FROM g")
def repeated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that repeat the one before them."""
    w = Window.partitionBy("doc_id").orderBy("segment")
    rows = segments(spans(documents(spark, sf_dir)))
    return rows.select("doc_id", "segment", F.coalesce(F.lag("text").over(w) == F.col("text"), F.lit(False)).alias("repeats"))


@query("SELECT conv_id, turn, role, 4 * 64 * 64 + 2 * 64 * 128 + 4 * 64 + length(text) AS parameters FROM conversations")
def parameter_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of one layer of width 64 and inner width 128, with one for each character of a turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.lit(4 * 64 * 64 + 2 * 64 * 128 + 4 * 64).cast("bigint") + F.length("text")).alias("parameters"))


@query(f"WITH {TOKENS_SQL}, f AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL) SELECT tf, count(*) AS n FROM f GROUP BY tf")
def frequency_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms stand once, twice, … in a document."""
    return postings(documents(spark, sf_dir)).groupBy("tf").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH c AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), ' (?:and|or|versus|vs) '), lambda p: length(p) > 3)) AS part, generate_subscripts(list_filter(string_split_regex(lower(text), ' (?:and|or|versus|vs) '), lambda p: length(p) > 3), 1)::INT AS part_no FROM benchmark)
SELECT item_id, part_no, md5(part) AS digest, (row_number() OVER (PARTITION BY item_id, part ORDER BY part_no) = 1) AS first FROM c"""
)
def subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts into which a compound question falls, and which of them are new."""
    parts = F.filter(F.split(F.lower("text"), " (?:and|or|versus|vs) "), lambda p: F.length(p) > 3)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("n", "part"))
    again = F.row_number().over(Window.partitionBy("item_id", "part").orderBy("n"))
    return rows.select("item_id", (F.col("n") + 1).alias("part_no"), F.md5("part").alias("digest"), (again == 1).alias("first"))


@query("SELECT item_id, greatest(4, least(len(w), 96 - least(len(q), 32)))::INT AS evidence_budget, least(len(q), 32)::INT AS question_budget FROM (SELECT item_id, string_split(text, ' ') AS q, string_split(text || ' ' || text, ' ') AS w FROM benchmark)")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of 96 words for evidence once the question has its part."""
    q = F.least(F.size(F.split("text", " ")), F.lit(32))
    e = F.greatest(F.lit(4), F.least(F.size(F.split(F.concat_ws(" ", "text", "text"), " ")), 96 - q))
    return table(spark, sf_dir, "benchmark").select("item_id", e.alias("evidence_budget"), q.alias("question_budget"))
