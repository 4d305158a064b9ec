"""What a corpus keeps on itself: manifests and their digests, changes to them, stale references, and checks of times and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.tables import documents, table
from .curiosity import INSIGHTS_SQL, insight_prune, signal_ema
from .cycle import transition_reward
from .terms import BM25_SQL, TOKENS_SQL, bm25_batch_topk

#: A manifest's version, and the words of a prompt with the least that evidence gets of them.
VERSION, PROMPT, LEAST_EVIDENCE = 2, 96, 4
_BLANK = r"[ \t\n\x0B\f\r]+"


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, n_bytes): one row per document; texts are hashed where they are read."""
    return docs.select("doc_id", "source", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def changed(stored: DataFrame, removed: DataFrame, put: DataFrame) -> DataFrame:
    """stored without the ids of removed, and with the rows of put in place of those of the same id; a removed id that is put again stays."""
    gone = removed.select("doc_id").unionByName(put.select("doc_id")).distinct()
    return stored.join(gone, "doc_id", "left_anti").unionByName(put.select(*stored.columns))


def corpus_mark(rows: DataFrame) -> DataFrame:
    """One row: documents, bytes, and a digest of all documents.

    The digest is the SHA-256 of the version, the counts and two sums over the digests of (id, digest), 48 bits each. Sums need no order,
    so no task sees the whole corpus, and a removed or added document changes them alone.
    """
    own = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "digest"), 256)
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(own, k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = rows.agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("bigint").alias("n_bytes"), part(1).alias("a"), part(13).alias("b"))
    whole = F.concat_ws("|", F.lit(str(VERSION)), *[F.col(c).cast("string") for c in ("n_documents", "n_bytes", "a", "b")])
    return sums.select("n_documents", "n_bytes", F.sha2(whole, 256).alias("digest"))


MANIFEST_SQL = "man AS (SELECT doc_id, source, sha256(text) AS digest, strlen(text)::BIGINT AS n_bytes FROM documents)"
_MARK_SQL = f"""SELECT n_documents, n_bytes, sha256('{VERSION}|' || n_documents || '|' || n_bytes || '|' || a || '|' || b) AS digest FROM (
  SELECT count(*) AS n_documents, coalesce(sum(n_bytes), 0)::BIGINT AS n_bytes, coalesce(sum(('0x' || substr(h, 1, 12))::BIGINT), 0)::HUGEINT::VARCHAR AS a, coalesce(sum(('0x' || substr(h, 13, 12))::BIGINT), 0)::HUGEINT::VARCHAR AS b
  FROM (SELECT n_bytes, sha256(doc_id || '|' || digest) AS h FROM {{}}))"""


@query(f"WITH {MANIFEST_SQL} " + _MARK_SQL.format("man"))
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the whole corpus."""
    return corpus_mark(manifest(documents(spark, sf_dir)))


def _revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after the reviewers' work: toxic documents removed, those of no quality put again in their squeezed form."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    low = docs.join(labels.where("quality = 0 AND toxic = 0").select("doc_id"), "doc_id", "left_semi")
    squeezed = low.withColumn("text", F.trim(F.regexp_replace("text", _BLANK, " ")))
    return changed(manifest(docs), labels.where("toxic = 1"), manifest(squeezed))


REVISED_SQL = MANIFEST_SQL + rf""",
low AS (SELECT doc_id, source, trim(regexp_replace(text, '{_BLANK}', ' ', 'g'), ' ') AS text FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0) USING (doc_id)),
rev AS MATERIALIZED (SELECT * FROM man WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0) UNION ALL SELECT doc_id, source, sha256(text), strlen(text)::BIGINT FROM low)"""


@query(f"WITH {REVISED_SQL} SELECT * FROM rev")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest once documents are removed and put again."""
    return _revised(spark, sf_dir)


@query(f"WITH {REVISED_SQL} " + _MARK_SQL.format("rev"))
def revised_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the corpus once documents are removed and put again."""
    return corpus_mark(_revised(spark, sf_dir))


@query(f"WITH {REVISED_SQL} SELECT coalesce(man.doc_id, rev.doc_id) AS doc_id, CASE WHEN rev.doc_id IS NULL THEN 'removed' WHEN man.doc_id IS NULL THEN 'added' WHEN man.n_bytes <> rev.n_bytes THEN 'size' ELSE 'digest' END AS fault FROM man FULL JOIN rev USING (doc_id) WHERE man.digest IS DISTINCT FROM rev.digest")
def artifact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a manifest and the corpus it is held against differ: ids that only one has, sizes, or digests of equal size."""
    listed = manifest(documents(spark, sf_dir)).select("doc_id", F.col("digest").alias("d0"), F.col("n_bytes").alias("n0"))
    both = listed.join(_revised(spark, sf_dir), "doc_id", "full_outer").where(~F.col("d0").eqNullSafe(F.col("digest")))
    return both.select("doc_id", F.when(F.col("digest").isNull(), "removed").when(F.col("d0").isNull(), "added").when(F.col("n0") != F.col("n_bytes"), "size").otherwise("digest").alias("fault"))


@query(f"WITH {MANIFEST_SQL} SELECT digest, count(*) AS n_documents, count(DISTINCT source) AS n_sources, min(doc_id) AS first_doc_id FROM man GROUP BY digest HAVING count(DISTINCT doc_id) > 1")
def shared_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that more than one document claims, and from how many sources."""
    rows = manifest(documents(spark, sf_dir)).groupBy("digest").agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
    return rows.where("first_doc_id <> last").drop("last")


@query(f"WITH {INSIGHTS_SQL}, {REVISED_SQL}, best AS (SELECT * FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM ins) WHERE r <= 200) SELECT best.source, doc_id, rev.doc_id IS NULL AS gone FROM best JOIN man USING (doc_id) LEFT JOIN rev USING (doc_id) WHERE rev.digest IS DISTINCT FROM man.digest")
def stale_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept insights whose document is gone from the revised corpus or has another digest there."""
    best = insight_prune(spark, sf_dir).select("source", "doc_id")
    made = best.join(manifest(documents(spark, sf_dir)).select("doc_id", F.col("digest").alias("of")), "doc_id")
    now = _revised(spark, sf_dir).select("doc_id", "digest")
    return made.join(now, "doc_id", "left").where(~F.col("of").eqNullSafe(F.col("digest"))).select("source", "doc_id", F.col("digest").isNull().alias("gone"))


#: Fields that an update may set, by the event that carries them; other events are refused.
FIELDS = {"click": "clicked", "purchase": "paid", "view": "viewed"}


@query(
    "SELECT user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (event_type = '{e}' AND value IS NOT NULL) AS {c}" for e, c in FIELDS.items())
    + f", count(*) FILTER (event_type NOT IN ({', '.join(map(repr, FIELDS))})) AS n_refused FROM events GROUP BY user_id"
)
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user after all its updates: each allowed field has its newest value, fields that none names stay, others are refused."""
    newest = lambda e: F.when((F.col("event_type") == e) & F.col("value").isNotNull(), F.struct("ts", "event_id"))
    refused = F.count_if(~F.col("event_type").isin(*FIELDS))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.max_by("value", newest(e)).alias(c) for e, c in FIELDS.items()], refused.alias("n_refused"))


_ISO_SQL = """CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:30' ELSE strftime(ts, '%Y-13-%dT%H:%M:%S') || 'Z' END"""
_ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})$"


def zoned(text: Column) -> Column:
    """The moment that an ISO 8601 text names; null where it names none or no zone."""
    return F.when(text.rlike(_ZONED), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


@query(f"WITH t AS (SELECT event_id, {_ISO_SQL} AS iso FROM events), p AS (SELECT *, CASE WHEN regexp_matches(iso, '{_ZONED}') THEN try_cast(iso AS TIMESTAMPTZ) END AS moment FROM t) SELECT event_id, iso, moment IS NOT NULL AS valid, epoch_us(moment) AS micros FROM p")
def timestamp_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events written with a zone, with another, without one and with a month that is none, and what is read back."""
    at = lambda form, zone: F.concat(F.date_format("ts", form), F.lit(zone))
    form, k = "yyyy-MM-dd'T'HH:mm:ss", F.col("event_id") % 5
    iso = F.when(k == 0, at(form, "Z")).when(k == 1, at(form, "+02:00")).when(k == 2, at(form, "")).when(k == 3, at(form, "-05:30")).otherwise(at("yyyy-'13'-dd'T'HH:mm:ss", "Z"))
    rows = table(spark, sf_dir, "events").select("event_id", iso.alias("iso")).withColumn("at", zoned(F.col("iso")))
    return rows.select("event_id", "iso", F.col("at").isNotNull().alias("valid"), F.unix_micros("at").alias("micros"))


@query("SELECT event_id, sha256(json_object('event_type', event_type, 'props', props, 'user_id', user_id)::VARCHAR) AS digest FROM events")
def canonical_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every request as compact JSON with sorted names."""
    body = F.to_json(F.struct("event_type", "props", "user_id"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "events").select("event_id", F.sha2(body, 256).alias("digest"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE try_cast(props AS JSON) IS NOT NULL AND json_exists(props, '$.k')")
def metadata_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON records of a table say; records that cannot be read are left out."""
    read = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", read["k"].alias("k")).where("k IS NOT NULL")


@query(
    "WITH o AS (SELECT user_id, event_id, ts, value, lag(value) OVER w AS before FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, round(0.01 * 0.5 * (value - before) * (value - before), 8) AS reward FROM o WHERE before IS NOT NULL)"
    " SELECT user_id, count(*) AS n_steps, round(avg(reward), 6) AS mean_reward, max(reward) AS max_reward, round(sum(reward), 5) AS total_reward FROM r GROUP BY user_id"
)
def cycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cycle reports of every user's rewards."""
    return transition_reward(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.max("reward").alias("max_reward"), F.round(F.sum("reward"), 5).alias("total_reward"))


@query("WITH l AS (SELECT doc_id, quality FROM labels ORDER BY doc_id DESC LIMIT 100) SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_bad, array_to_string(list_sort(list(doc_id), 'DESC')[1:10], ' ') AS newest FROM l")
def recent_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred judgements counted, and the ten newest named; a window of a hundred is the feature."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").orderBy(F.desc("doc_id")).limit(100)
    ids = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("doc_id"), asc=False), 1, 10), lambda x: x.cast("string")), " ")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("quality") == 0).alias("n_bad"), ids.alias("newest"))


@query(
    "WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)"
    " SELECT conv_id, count(*) FILTER (age <= 20) AS n_kept, string_agg(role, ' ' ORDER BY turn) FILTER (age <= 6) AS recent, max(turn) FILTER (role = 'user' AND age <= 20) AS last_user_turn FROM m GROUP BY conv_id"
)
def conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's memory of twenty turns holds: the roles of the last six in order, and the last turn of the user."""
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", age.alias("age")).where("age <= 20")
    recent = F.array_sort(F.collect_list(F.when(F.col("age") <= 6, F.struct("turn", "role"))))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"), F.array_join(recent["role"], " ").alias("recent"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"))


@query(
    "WITH m AS (SELECT conv_id, turn, role, coalesce(max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id), -1) AS seen FROM conversations)"
    " SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM m WHERE turn > seen AND role IN ('assistant', 'system')) WHERE place <= 20"
)
def unread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of what each channel holds for its user after the last turn that the user wrote: answers and broadcasts, twenty at most."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    seen = rows.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))), F.lit(-1)).alias("seen"))
    new = rows.where("role IN ('assistant', 'system')").join(seen, "conv_id").where("turn > seen")
    return new.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("place <= 20").drop("seen")


#: What a policy turns away, tried in this order, in patterns that both engines read.
SECRET = r"(?i)(?:password|passwd|token|secret|api_key|apikey)\s*[=:]\s*\S+|AKIA[0-9A-Z]{16}"
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
NUMBERS = r"(?:[0-9]{4}[ -]?){3}[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"


@query(f"SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'no text' WHEN regexp_matches(text, '{SECRET}') THEN 'secret' WHEN regexp_matches(text, '{ADDRESS}') THEN 'address' WHEN regexp_matches(text, '{NUMBERS}') THEN 'number' ELSE 'accepted' END AS decision FROM documents")
def policy_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a policy takes in, and the first reason against each of the others."""
    t = F.col("text")
    decision = F.when(F.length(F.trim(t)) == 0, "no text").when(t.rlike(SECRET), "secret").when(t.rlike(ADDRESS), "address").when(t.rlike(NUMBERS), "number").otherwise("accepted")
    return documents(spark, sf_dir).select("doc_id", decision.alias("decision"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents),
b AS (SELECT doc_id, min(length(line) - length(ltrim(line, ' '))) AS x0, min(y) AS y0, max(length(rtrim(line, ' '))) AS x1, max(y) + 1 AS y1 FROM l WHERE NOT regexp_matches(line, '^{_BLANK[:-1]}*$') GROUP BY doc_id)
SELECT doc_id, coalesce(x0, 0)::INT AS x0, coalesce(y0, 0)::INT AS y0, coalesce(x1, 0)::INT AS x1, coalesce(y1, 0)::INT AS y1 FROM documents LEFT JOIN b USING (doc_id)"""
)
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the boxes of a document's lines in cells of one character: a line's first and last character that is no space, and its row; zeros without any."""
    box = lambda line, y: F.when(line.rlike(r"[^ \t\n\x0B\f\r]"), F.struct((F.length(line) - F.length(F.ltrim(line))).alias("x0"), y.alias("y0"), F.length(F.rtrim(line)).alias("x1"), (y + 1).alias("y1")))
    rows = documents(spark, sf_dir).select("doc_id", F.filter(F.transform(F.split("text", "\n"), box), lambda b: b.isNotNull()).alias("b"))
    edge = lambda f, c: F.coalesce(f(F.col(f"b.{c}")), F.lit(0)).alias(c)
    return rows.select("doc_id", edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))


@query(f"WITH {TOKENS_SQL}, v AS (SELECT source, count(DISTINCT term) AS v FROM tok JOIN documents USING (doc_id) GROUP BY source) SELECT source, v AS vocabulary, v * 256 + 6 * (4 * 256 * 256 + 2 * 256 * 1024 + 4 * 256) + 2 * 256 AS parameters FROM v")
def model_sizes(spark: SparkSession, sf_dir: str, width: int = 256, layers: int = 6, inner: int = 1024) -> DataFrame:
    """The parameters of a model over each source's own vocabulary: embeddings, layers and the last norm."""
    terms = documents(spark, sf_dir).select("source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct()
    v = F.col("vocabulary")
    return terms.groupBy("source").agg(F.count(F.lit(1)).alias("vocabulary")).withColumn("parameters", v * width + layers * (4 * width * width + 2 * width * inner + 4 * width) + 2 * width)


_TOP_SQL = "best AS (SELECT * FROM (SELECT item_id, doc_id, bm25, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id)::INT AS rank FROM lex) WHERE rank <= 5)"


@query(
    rf"""WITH {BM25_SQL}, {_TOP_SQL},
qw AS (SELECT item_id, len(regexp_extract_all(text, '\S+')) AS words FROM benchmark),
e AS (SELECT item_id, rank, doc_id, least({PROMPT} - greatest({LEAST_EVIDENCE}, {PROMPT} // 3), words) AS question, len(regexp_extract_all(text, '\S+')) AS n FROM best JOIN documents USING (doc_id) JOIN qw USING (item_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY item_id ORDER BY rank) - n AS before FROM e)
SELECT item_id, rank, doc_id, question::INT AS question, greatest(0, least(n, {PROMPT} - question - before))::INT AS kept FROM s"""
)
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each question and of its five best documents a prompt of 96 words takes: the question first, but never the
    third that evidence is due; then the documents in their order, until it is full."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    questions = table(spark, sf_dir, "benchmark").select("item_id", F.least(F.lit(PROMPT - max(LEAST_EVIDENCE, PROMPT // 3)), n).alias("question"))
    best = bm25_batch_topk(spark, sf_dir).select("item_id", "doc_id", "rank")
    sizes = documents(spark, sf_dir).select("doc_id", n.alias("n"))
    rows = best.join(sizes, "doc_id").join(questions, "item_id")
    before = F.sum("n").over(Window.partitionBy("item_id").orderBy("rank")) - F.col("n")
    return rows.withColumn("before", before).select("item_id", "rank", "doc_id", "question", F.greatest(F.lit(0), F.least(F.col("n").cast("bigint"), PROMPT - F.col("question") - F.col("before"))).cast("int").alias("kept"))


@query(
    f"""WITH {BM25_SQL}, {_TOP_SQL}, n AS (SELECT doc_id, count(*) AS shown FROM best GROUP BY doc_id), d AS (SELECT source, doc_id, coalesce(shown, 0) AS shown FROM documents LEFT JOIN n USING (doc_id))
SELECT source, arg_min(doc_id, (shown, md5(doc_id::VARCHAR), doc_id)) AS doc_id, min(shown) AS shown FROM d GROUP BY source"""
)
def least_surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the document that the questions' lists show least, ties by a hash of the id in place of chance."""
    shown = bm25_batch_topk(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("shown"))
    rows = documents(spark, sf_dir).select("source", "doc_id").join(shown, "doc_id", "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    order = F.struct("shown", F.md5(F.col("doc_id").cast("string")).alias("h"), "doc_id")
    return rows.groupBy("source").agg(F.min_by("doc_id", order).alias("doc_id"), F.min("shown").alias("shown"))


_BUCKET = "4 + ('0x' || substr(sha256(x), 7, 2) || substr(sha256(x), 5, 2) || substr(sha256(x), 3, 2) || substr(sha256(x), 1, 2))::BIGINT % 1000"


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l[1:64], lambda x: ({_BUCKET})::VARCHAR) || list_transform(range(0, greatest(64 - len(l), 0)), lambda i: '0'), ' ') AS row, array_to_string(l[1:64], ' ') AS decoded, len(l) > 64 AS cut FROM t"""
)
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a row of 64 hashed token ids with zeros on the right, and what is read back without them; a row's length is the feature, cut tells of more."""
    rows = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("l")).select("doc_id", F.slice("l", 1, 64).alias("k"), (F.size("l") > 64).alias("cut"))
    ids = F.transform("k", lambda x: (T.hashed_bucket(x, 1000) + 4).cast("string"))
    return rows.select("doc_id", F.array_join(F.concat(ids, F.array_repeat(F.lit("0"), 64 - F.size("k"))), " ").alias("row"), F.array_join("k", " ").alias("decoded"), "cut")


@query(
    "WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id), e AS (SELECT user_id, round(list_reduce(list_prepend(0::DOUBLE, v), lambda r, x: 0.8 * r + 0.2 * x), 6) AS reward FROM o)"
    " SELECT user_id, reward, arg_max(value, (ts, event_id)) FILTER (event_type = 'click' AND value IS NOT NULL) AS loss, arg_max(value, (ts, event_id)) FILTER (event_type = 'view' AND value IS NOT NULL) AS uncertainty,"
    " count(*) FILTER (event_type = 'purchase') AS visits, count(*) AS version FROM events LEFT JOIN e USING (user_id) GROUP BY user_id, reward"
)
def signal_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals of a unit after its updates: the reward averaged, loss and uncertainty the newest, visits added up, a version for each."""
    newest = lambda e: F.when((F.col("event_type") == e) & F.col("value").isNotNull(), F.struct("ts", "event_id"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", newest("click")).alias("loss"), F.max_by("value", newest("view")).alias("uncertainty"), F.count_if(F.col("event_type") == "purchase").alias("visits"), F.count(F.lit(1)).alias("version"))
    return rows.join(signal_ema(spark, sf_dir).select("user_id", F.col("ema").alias("reward")), "user_id", "left").select("user_id", "reward", "loss", "uncertainty", "visits", "version")
