"""The curiosity cycle and its parts, and the remaining joins, filters and listings of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import query
from ..sources.shared import written
from ..sources.tables import SPANS_SQL, documents, spans, table
from .curiosity import INSIGHTS_SQL, PRIORITY_SQL, TAGS_SQL, Weighed, insights, priorities, tags, hours
from .vectors import nearest
from .terms import BM25_SQL, HASHED_SQL, bm25, dense_vectors, top

GAMMA, LAMBDA = 0.99, 0.95


@query(
    f"WITH {INSIGHTS_SQL}, {TAGS_SQL.split('mx AS (SELECT max(idf) AS m FROM ci),')[-1].strip()}, t AS (SELECT doc_id, list(term ORDER BY rank) AS tags FROM tags GROUP BY doc_id)"
    " SELECT source, doc_id, score, array_to_string(tags, ' ') AS tags, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INT AS rank FROM ins JOIN t USING (doc_id)) WHERE rank <= 10"
)
def curiosity_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle: every document scored for entropy and surprise, the ten best insights of each source with their tags."""
    docs = documents(spark, sf_dir)
    weighed = Weighed.of(docs)
    best = written(insights(docs, weighed).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).where("rank <= 10"), "best")
    shown = tags(docs, weighed=weighed.only(best.select("doc_id")))  # ten documents a source
    labels = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select("doc_id", F.array_join(F.col("t.term"), " ").alias("tags"))
    return best.join(labels, "doc_id").select("source", "doc_id", "score", "tags", "rank")


#: Rounds of the closed cycle, insights of a source that a round shows, and the share of the old in a running reward.
CYCLES, SHOWN, KEPT_SHARE = 3, 10, 0.8


def cycles(found: DataFrame, rounds: int = CYCLES, shown: int = SHOWN) -> DataFrame:
    """(round, source, doc_id, rank, priority, surfaced): what every round shows, of insights (doc_id, source, score) that are not null.

    A round shows the insights of the highest priority of each source, ties to those shown less and then the smaller id. An insight that is
    shown gains a running reward from its score and is counted as shown, and its priority for the next round follows from both: what has just been
    shown falls behind. A state is a table that one round writes and the next reads.
    """
    priority = lambda reward, seen: F.round(F.greatest(F.lit(0.0), T.bounded(reward) - 0.1 * F.log1p(seen)), 6)
    state = written(found.select("doc_id", "source", "score", F.col("score").alias("reward"), F.lit(0).cast("bigint").alias("surfaced"), priority(F.col("score"), F.lit(0)).alias("priority")), "cycle")
    order = Window.partitionBy("source").orderBy(F.desc("priority"), "surfaced", "doc_id")
    out = None
    for k in range(1, rounds + 1):
        # the best of a source are found in every task before they meet
        best = written(state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).select("doc_id", "source", "rank", "priority", "surfaced"), "shown")
        part = best.select(F.lit(k).alias("round"), "source", "doc_id", "rank", "priority", "surfaced")
        out = part if out is None else out.unionByName(part)
        if k < rounds:
            marked = state.join(best.select("doc_id", F.lit(1).alias("now")), "doc_id", "left").withColumn("now", F.coalesce("now", F.lit(0)))
            reward = F.when(F.col("now") == 1, F.round(KEPT_SHARE * F.col("reward") + (1 - KEPT_SHARE) * F.col("score"), 10)).otherwise(F.col("reward"))
            moved = marked.select("doc_id", "source", "score", reward.alias("reward"), (F.col("surfaced") + F.col("now")).alias("surfaced"))
            state = written(moved.withColumn("priority", priority(F.col("reward"), F.col("surfaced"))), "cycle")
    return out


def _cycles_sql() -> str:
    priority = "round(greatest(0, greatest({r}, 0) / (1 + greatest({r}, 0)) - 0.1 * ln(1 + {s})), 6)"
    parts = [f"s1 AS MATERIALIZED (SELECT doc_id, source, score, score AS reward, 0::BIGINT AS surfaced, {priority.format(r='score', s='0')} AS priority FROM ins)"]
    for k in range(1, CYCLES + 1):
        parts.append(f"b{k} AS MATERIALIZED (SELECT * FROM (SELECT {k} AS round, source, doc_id, row_number() OVER (PARTITION BY source ORDER BY priority DESC, surfaced, doc_id)::INT AS rank, priority, surfaced FROM s{k}) WHERE rank <= {SHOWN})")
        moved = f"SELECT s.doc_id, s.source, score, CASE WHEN b.doc_id IS NULL THEN reward ELSE round({KEPT_SHARE} * reward + {round(1 - KEPT_SHARE, 9)} * score, 10) END AS reward, s.surfaced + (b.doc_id IS NOT NULL)::BIGINT AS surfaced FROM s{k} s LEFT JOIN b{k} b ON b.doc_id = s.doc_id"
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT *, {priority.format(r='reward', s='surfaced')} AS priority FROM ({moved}))")
    return ", ".join(parts)


@query(f"WITH {INSIGHTS_SQL}, {_cycles_sql()} " + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, CYCLES + 1)))
def curiosity_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of the closed cycle over the insights of all documents."""
    return cycles(insights(documents(spark, sf_dir)))


@query(
    "WITH o AS (SELECT user_id, value, row_number() OVER w AS step, lag(value) OVER w AS before FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
    " SELECT user_id, step::INT AS step, round(0.01 * 0.5 * (value - before) * (value - before), 8) AS reward FROM o WHERE before IS NOT NULL"
)
def transition_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for a learnt forward model's error: half the squared distance of consecutive states, scaled."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", F.row_number().over(w).alias("step"), "value", F.lag("value").over(w).alias("before"))
    d = F.col("value") - F.col("before")
    return rows.where("before IS NOT NULL").select("user_id", "step", F.round(0.01 * 0.5 * d * d, 8).alias("reward"))


@query(
    """WITH o AS (SELECT user_id, list(value ORDER BY ts DESC, event_id DESC) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id),
a AS (SELECT user_id, unnest(range(1, len(v) + 1)) AS k, v FROM o),
g AS (SELECT user_id, len(v) - k + 1 AS step, list_reduce(list_prepend(0::DOUBLE, v[1:k]), lambda g, x: x + 0.99 * 0.95 * g) AS g FROM a),
s AS (SELECT user_id, avg(g) AS m, stddev_pop(g) AS d, count(*) AS n FROM g GROUP BY user_id)
SELECT user_id, step::INT AS step, round(CASE WHEN n > 1 THEN (g - m) / (d + 1e-8) ELSE g END, 5) AS advantage FROM g JOIN s USING (user_id)"""
)
def gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised advantages of every user's rollout, scanned from its end and normalised; a rollout of one step stays as it is."""
    decay, n = GAMMA * LAMBDA, F.size("v").cast("bigint")
    # inside an hour from its end, as if nothing followed; the steps before and the advantage after come from the other hours, two numbers each
    scan = F.aggregate(F.reverse("v"), F.expr("cast(array() AS array<double>)"), lambda acc, x: F.array_append(acc, x + decay * F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(F.lit(0.0))), -1), F.lit(0.0))))
    parts = hours(table(spark, sf_dir, "events")).select("user_id", "hour", n.alias("n"), F.reverse(scan).alias("g"))
    lists = parts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("hour", "n", F.col("g")[0].alias("b")))).alias("h"))
    after = F.expr(f"aggregate(reverse(h), named_struct('x', 0D, 'o', cast(array() AS array<double>)), (acc, m) -> named_struct('x', pow({decay}D, m.n) * acc.x + m.b, 'o', array_append(acc.o, acc.x)), acc -> reverse(acc.o))")
    before = F.expr("aggregate(h, named_struct('k', 0L, 'o', cast(array() AS array<bigint>)), (acc, m) -> named_struct('k', acc.k + m.n, 'o', array_append(acc.o, acc.k)), acc -> acc.o)")
    ends = lists.select("user_id", F.explode(F.arrays_zip(F.col("h.hour").alias("hour"), after.alias("after"), before.alias("before"))).alias("e")).select("user_id", "e.*")
    steps = parts.join(ends, ["user_id", "hour"]).select("user_id", "n", "after", "before", F.posexplode("g").alias("i", "own"))
    each = steps.select("user_id", (F.col("before") + F.col("i")).alias("k"), (F.col("own") + F.pow(F.lit(decay), F.col("n") - F.col("i")) * F.col("after")).alias("g"))
    stats = each.groupBy("user_id").agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("d"), F.count(F.lit(1)).alias("n"))
    return each.join(stats, "user_id").select("user_id", (F.col("k") + 1).cast("int").alias("step"), F.round(F.when(F.col("n") > 1, (F.col("g") - F.col("m")) / (F.col("d") + 1e-8)).otherwise(F.col("g")), 5).alias("advantage"))


@query(
    f"WITH {PRIORITY_SQL}, n AS (SELECT max(visits) AS v FROM pri) SELECT user_id, round(ln(1 + visits) / 10, 6) AS seen, round(priority / (1 + priority), 6) AS urgency, round(visits / greatest(v, 1), 6) AS share FROM pri, n"
)
def observation_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent sees of each unit beside its text: visits, bounded priority and its share of the most visits."""
    rows = priorities(table(spark, sf_dir, "events"))
    most = F.broadcast(rows.agg(F.max("visits").alias("v")))  # one row
    share = F.col("visits") / F.greatest("v", F.lit(1))
    return rows.crossJoin(most).select("user_id", F.round(F.log1p("visits") / 10, 6).alias("seen"), F.round(T.bounded(F.col("priority")), 6).alias("urgency"), F.round(share, 6).alias("share"))


@query(
    f"WITH {BM25_SQL}, "
    + HASHED_SQL.format(id="doc_id", table="documents", width=64).replace("hv AS", "dv AS")
    + ", "
    + HASHED_SQL.format(id="item_id", table="benchmark", width=64).replace("hv AS", "qv AS")
    + """, de AS (SELECT qv.id AS item_id, dv.id AS doc_id, round(sum(qv.c / qv.norm * dv.c / dv.norm), 6) AS dense FROM qv JOIN dv USING (b) GROUP BY ALL),
l AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id)::INT AS lexical_rank FROM lex) WHERE lexical_rank <= 10),
d AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY dense DESC, doc_id)::INT AS dense_rank FROM de) WHERE dense_rank <= 10)
SELECT item_id, doc_id, lexical_rank, dense_rank FROM l FULL JOIN d USING (item_id, doc_id)"""
)
def fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks of every document that either list holds among its ten, by a full outer join."""
    docs, questions = documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    lexical = top(bm25(docs, questions), "bm25", 10).select("item_id", "doc_id", F.col("rank").alias("lexical_rank"))
    near = nearest(dense_vectors(questions, "item_id"), dense_vectors(docs, "doc_id"), 10, (questions, docs))
    return lexical.join(near.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("rank").alias("dense_rank")), ["item_id", "doc_id"], "full_outer")


@query("SELECT vec_id, label FROM embeddings SEMI JOIN documents ON vec_id = doc_id")
def active_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose document is still there."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(documents(spark, sf_dir).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


@query("SELECT 'vector' AS side, vec_id AS id FROM embeddings ANTI JOIN documents ON vec_id = doc_id UNION ALL SELECT 'document', doc_id FROM documents ANTI JOIN embeddings ON vec_id = doc_id")
def index_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only the vectors or only the documents have."""
    v, d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
    return v.join(d, "id", "left_anti").select(F.lit("vector").alias("side"), "id").unionByName(d.join(v, "id", "left_anti").select(F.lit("document").alias("side"), "id"))


@query(f"WITH {SPANS_SQL} SELECT doc_id, count(*) FILTER (text <> '') AS n_spans, count(*) FILTER (is_heading) AS n_headings FROM spans GROUP BY doc_id")
def text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any text, and how many of their spans are headings."""
    return spans(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.count_if("is_heading").alias("n_headings"))


@query(f"WITH {SPANS_SQL}, k AS (SELECT doc_id, span_ord, text, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS kind FROM spans) SELECT doc_id, span_ord::INT AS span_ord, kind, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'text' THEN 0 ELSE 1 END, length(text), span_ord)::INT AS place FROM k")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in the order of kind, then length, then place, as a reader by kinds would see them."""
    kind = F.when(F.col("text").contains("|"), "table").otherwise("text")
    rows = spans(documents(spark, sf_dir)).select("doc_id", "span_ord", kind.alias("kind"), F.length("text").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("kind") == "text", 0).otherwise(1), "n", "span_ord")
    return rows.select("doc_id", "span_ord", "kind", F.row_number().over(order).alias("place"))


@query(f"WITH {SPANS_SQL}, k AS (SELECT doc_id, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS kind, text FROM spans), p AS (SELECT page_id, 'page' AS kind, html FROM pages) SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT kind, text FROM k UNION ALL SELECT kind, html FROM p) GROUP BY kind")
def modality_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, tables and pages in one bag, counted by kind."""
    kind = F.when(F.col("text").contains("|"), "table").otherwise("text")
    rows = spans(documents(spark, sf_dir)).select(kind.alias("kind"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("text"))
    return rows.unionByName(pages).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'no text' WHEN contains(text, 'token = ') THEN 'secret' ELSE 'accepted' END AS decision FROM documents")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a policy takes in: those with text and without a secret."""
    decision = F.when(F.length(F.trim("text")) == 0, "no text").when(F.col("text").contains("token = "), "secret").otherwise("accepted")
    return documents(spark, sf_dir).select("doc_id", decision.alias("decision"))


@query("WITH o AS (SELECT source, CASE WHEN length(trim(text)) = 0 THEN 'rejected' WHEN n_chars <> length(text) THEN 'error' ELSE 'success' END AS status FROM documents) SELECT source, status, count(*) AS n FROM o GROUP BY ALL")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of taking in every document, counted by source."""
    status = F.when(F.length(F.trim("text")) == 0, "rejected").when(F.col("n_chars") != F.length("text"), "error").otherwise("success")
    return documents(spark, sf_dir).groupBy("source", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TAGS_SQL} SELECT DISTINCT doc_id FROM tags WHERE term = (SELECT term FROM tags GROUP BY term ORDER BY count(*) DESC, term LIMIT 1)")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have the most common tag, by exact membership."""
    rows = written(tags(documents(spark, sf_dir)).select("doc_id", "term"), "tags")
    most = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(1).select("term")
    return rows.join(F.broadcast(most), "term").select("doc_id").distinct()  # one row


@query(r"SELECT page_id, trim(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^?#]+)', 1)), '[^a-z0-9]+', '-', 'g'), '-')[:60] AS slug FROM pages")
def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each page: small letters and digits, other runs as one dash, sixty characters at most."""
    s = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1)), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60).alias("slug"))


ALLOWED = ["python", "pytest", "ls", "cat", "git"]


@query("SELECT conv_id, turn, lower(regexp_extract(text, '^(\\S+)', 1)) IN ('python', 'pytest', 'ls', 'cat', 'git') AND NOT regexp_matches(text, '[;&|`$]') AS allowed FROM conversations")
def command_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn would pass as a command: an allowed first word and no shell marks."""
    first = F.lower(F.regexp_extract("text", r"^(\S+)", 1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (first.isin(*ALLOWED) & ~F.col("text").rlike("[;&|`$]")).alias("allowed"))


@query("SELECT user_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS active, count(*) FILTER (event_type <> 'error') AS n_tasks FROM events GROUP BY user_id")
def bus_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users were seen within a day of the newest event, and their tasks."""
    rows = table(spark, sf_dir, "events")
    end = F.broadcast(rows.agg(F.max("ts").alias("end")))  # one row
    sums = rows.groupBy("user_id").agg(F.max("ts").alias("seen"), F.count_if(F.col("event_type") != "error").alias("n_tasks"))
    return sums.crossJoin(end).select("user_id", (F.col("seen") >= F.col("end") - F.expr("INTERVAL 1 DAY")).alias("active"), "n_tasks")


@query("SELECT event_type, {'n': count(*), 'low': round(min(value), 6), 'high': round(max(value), 6)}.n AS n, round(min(value), 6) AS low, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY event_type")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every kind of metric as a nested snapshot, laid flat."""
    at = F.struct("ts", "event_id")
    nested = table(spark, sf_dir, "events").groupBy("event_type").agg(F.struct(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("low")).alias("s"), F.max_by("event_id", at).alias("newest"))
    return nested.select("event_type", "s.n", "s.low", "newest")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text): the visible text of pages, scripts and styles left out, blanks squeezed."""

    def visible(html: str | None) -> str:
        from ..functions.html import visible_text

        return visible_text(html or "")

    # by pickled rows, a hundred at a time: Arrow's batches hold up to 10,000 pages, of whatever size
    return pages.select("page_id", F.udf(visible, "string", useArrow=False)("html").alias("text"))


@query()
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page with its length in words."""
    return page_texts(table(spark, sf_dir, "pages")).withColumn("n_words", F.size(F.split("text", " ")))
