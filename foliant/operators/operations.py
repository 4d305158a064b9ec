"""Operational analytics: sessions, histories, metrics, alerts, idempotency, task states and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import documents, table
from .ranks import numbered

#: Which states a task may go to from each state (an open one is claimed by its own step), and the state that each event asks for.
TRANSITIONS = {
    "open": {"claimed", "cancelled"},
    "claimed": {"in_progress", "completed", "failed", "open", "cancelled"},
    "in_progress": {"completed", "failed", "open", "cancelled"},
    "completed": set(),
    "failed": {"open"},
    "cancelled": {"open"},
}
ASKS = {"signup": "open", "view": "claimed", "click": "in_progress", "purchase": "completed", "error": "failed"}


@query("SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT conv_id, turn, role, age FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS age FROM conversations) WHERE age <= 20")
def latest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty turns of every conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(order).alias("age")).where("age <= 20")


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, max(turn) FILTER (role = 'user') AS last_user_turn FROM conversations GROUP BY conv_id")
def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("role") == "user", F.col("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", at).alias("last_user"), F.max(at).alias("last_user_turn"))


@query("SELECT event_type, event_id, value, age FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS age FROM events) WHERE age <= 2000")
def metrics_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two thousand samples of each kind, as a ring buffer keeps them."""
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", "value", F.row_number().over(order).alias("age")).where("age <= 2000")


@query("SELECT event_id, event_type, value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def metrics_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of the last hour."""
    rows = table(spark, sf_dir, "events")
    end = F.broadcast(rows.agg(F.max("ts").alias("end")))  # one row
    return rows.crossJoin(end).where(F.col("ts") > F.col("end") - F.expr("INTERVAL 60 MINUTES")).select("event_id", "event_type", "value")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL")
def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("WITH q AS (SELECT event_type, quantile_disc(value, 0.9) AS limit_ FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_id, e.event_type, 'high ' || e.event_type AS alert FROM events e JOIN q USING (event_type) WHERE value > limit_")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples above the ninth decile of their kind; the limits are one row a kind."""
    rows = table(spark, sf_dir, "events")
    limit = rows.where("value IS NOT NULL").groupBy("event_type").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("limit"))
    return rows.join(limit, "event_type").where(F.col("value") > F.col("limit")).select("event_id", "event_type", F.concat(F.lit("high "), "event_type").alias("alert"))


@query("SELECT user_id, event_type, count(*) AS n_requests, count(DISTINCT sha256(coalesce(props, ''))) AS n_payloads, min(event_id) AS first_id FROM events GROUP BY ALL HAVING count(DISTINCT sha256(coalesce(props, ''))) > 1")
def idempotency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that came with more than one payload."""
    digest = F.sha2(F.coalesce("props", F.lit("")), 256)
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_requests"), F.countDistinct(digest).alias("n_payloads"), F.min("event_id").alias("first_id")).where("n_payloads > 1")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, sha256(coalesce(props, '')) ORDER BY event_id) AS k FROM events) WHERE k = 1")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request once: the same key and payload gives the first response again."""
    order = Window.partitionBy("user_id", "event_type", F.sha2(F.coalesce("props", F.lit("")), 256)).orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(order).alias("k")).where("k = 1").drop("k")


def fold_tasks(events: DataFrame) -> DataFrame:
    """(user_id, state, version, refused): every user's events folded in order through the allowed transitions.

    An hour of a user is folded from each of the six states at once, so that no row or task needs all events of a user; the maps
    of a user's hours are then put together in order. Events of an unknown kind are refused.
    """
    names = list(TRANSITIONS)
    moves = ", ".join(str(names.index(to) if to in TRANSITIONS[name] else -1) for name in names for to in names)
    asks = "CASE event_type " + " ".join(f"WHEN '{kind}' THEN {names.index(to)}" for kind, to in ASKS.items()) + " END"
    rows = events.select("user_id", F.coalesce(F.date_trunc("hour", "ts"), F.lit("0001-01-01").cast("timestamp")).alias("hour"), "ts", "event_id", F.expr(asks).alias("ask"))
    hours = rows.groupBy("user_id", "hour").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "ask"))).alias("v"))
    move = f"coalesce(element_at(array({moves}), acc.s * {len(names)} + x.ask + 1), -1)"
    step = f"if({move} < 0, named_struct('s', acc.s, 'n', acc.n, 'r', acc.r + 1), named_struct('s', {move}, 'n', acc.n + 1, 'r', acc.r))"
    maps = hours.select("user_id", "hour", F.expr(f"transform(sequence(0, {len(names) - 1}), s -> aggregate(v, named_struct('s', s, 'n', 0L, 'r', 0L), (acc, x) -> {step}))").alias("m"))
    steps = maps.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("hour", "m"))).alias("h"))
    whole = F.expr("aggregate(h, named_struct('s', 0, 'n', 0L, 'r', 0L), (acc, x) -> named_struct('s', x.m[acc.s].s, 'n', acc.n + x.m[acc.s].n, 'r', acc.r + x.m[acc.s].r))")
    state = F.expr("element_at(array(" + ", ".join(f"'{n}'" for n in names) + "), w.s + 1)")
    return steps.select("user_id", whole.alias("w")).select("user_id", state.alias("state"), F.col("w.n").alias("version"), F.col("w.r").alias("refused"))


_ASK_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASKS.items()) + " ELSE '?' END"
_ALLOWED_SQL = "CASE state " + " ".join(f"WHEN '{k}' THEN asked IN ({', '.join(repr(x) for x in sorted(v)) or repr('')})" for k, v in TRANSITIONS.items()) + " END"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {_ASK_SQL} AS asked FROM events),
f(user_id, k, state, version, refused) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 'open', 0::BIGINT, 0::BIGINT FROM e
  UNION ALL SELECT f.user_id, e.k, CASE WHEN {_ALLOWED_SQL} THEN asked ELSE state END, version + CASE WHEN {_ALLOWED_SQL} THEN 1 ELSE 0 END, refused + CASE WHEN {_ALLOWED_SQL} THEN 0 ELSE 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, arg_max(state, k) AS state, max(version) AS version, max(refused) AS refused FROM f GROUP BY user_id"""
)
def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every user's task after all events."""
    return fold_tasks(table(spark, sf_dir, "events"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 1000 AND event_type IN ('error', 'purchase') ORDER BY event_id LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of fifty after a known id; the predicates reach the scan."""
    return table(spark, sf_dir, "events").where((F.col("event_id") > 1000) & F.col("event_type").isin("error", "purchase")).select("event_id", "user_id", "event_type").orderBy("event_id").limit(50)


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN contains(lower(text), 'the') THEN true WHEN contains(lower(text), 'der') THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS awake FROM conversations")
def wake_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation is awake after each turn: a cue wakes it, another lets it sleep, other turns carry on."""
    t = F.lower("text")
    cue = F.when(t.contains("the"), F.lit(True)).when(t.contains("der"), F.lit(False))
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.last(cue, ignorenulls=True).over(past), F.lit(False)).alias("awake"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'system' OR (role = 'user' AND turn % 4 = 0)")
def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcasts, and what one channel is sent."""
    return table(spark, sf_dir, "conversations").where("role = 'system' OR (role = 'user' AND turn % 4 = 0)").select("conv_id", "turn", "role")


@query("SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("WITH l AS (SELECT source, doc_id, quality, row_number() OVER (PARTITION BY source, quality ORDER BY doc_id) AS k FROM labels JOIN documents USING (doc_id)) SELECT g.source, g.doc_id AS chosen, b.doc_id AS rejected FROM l g JOIN l b ON g.source = b.source AND g.k = b.k WHERE g.quality = 1 AND b.quality = 0")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad documents of a source, the k-th of one with the k-th of the other."""
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id").select("source", "doc_id", "quality")
    rows = numbered(rows, ["source", "quality"], "doc_id", "k")
    good = rows.where("quality = 1").select("source", "k", F.col("doc_id").alias("chosen"))
    return good.join(rows.where("quality = 0").select("source", "k", F.col("doc_id").alias("rejected")), ["source", "k"]).drop("k")


@query("SELECT event_id, array_to_string(coalesce(json_keys(try_cast(props AS JSON)), []), ',') AS keys FROM events")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a JSON column; nothing where it is empty or malformed."""
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.coalesce(F.json_object_keys("props"), F.expr("cast(array() AS array<string>)")), ",").alias("keys"))


@query("SELECT 'documents' AS entity, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events")
def database_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("documents", "pages", "labels", "conversations", "events"):
        row = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_error, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'error' ELSE 'mixed' END AS outcome FROM events GROUP BY user_id")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, good = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") != "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(good.alias("n_ok"), bad.alias("n_error"), F.when(bad == 0, "success").when(good == 0, "error").otherwise("mixed").alias("outcome"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS progress FROM events")
def progress_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known progress of a user at each event."""
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(past), F.lit(0.0)).alias("progress"))


@query(
    "SELECT n_name AS nation, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic star join: orders by the customer's nation."""
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("nation").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ALL")
def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
