"""The seven moves of a walk through the corpus: where each leads from a unit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.shared import written
from ..sources.tables import table
from .ranks import numbered
from .vectors import QUERY_EVERY, _matrix, _unit, best_of, in_blocks

#: The moves, in the order of their numbers.
MOVES = ("next", "previous", "related", "cross_document", "high_loss", "known", "unvisited")
NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("move", pa.string())])


def likest(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, move, vec_id): the nearest other row, the nearest of another label, and the nearest that has been visited, each if there is one.

    Masks differ by query, so a pair of blocks is one product under three masks. Scores are cosines, rounded to six places; ties go to the smaller id.
    """

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        score = np.round(_unit(_matrix(a)) @ _unit(_matrix(b)).T, 6)
        asked, ids = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        other = asked[:, None] != ids[None, :]
        labels = [np.array(t["label"].to_pylist(), object) for t in (a, b)]
        masks = {"related": other, "cross_document": other & (labels[0][:, None] != labels[1][None, :]), "known": other & (b["visits"].to_numpy() > 0)[None, :]}
        parts = [best_of(np.where(m, score, -np.inf), asked, ids, 1) for m in masks.values()]
        return pa.concat_tables([p.append_column("move", pa.array([name] * len(p), pa.string())) for name, p in zip(masks, parts)])

    found = in_blocks(queries, rows, best, found=NEAR)
    return found.groupBy("query_id", "move").agg(F.min_by("vec_id", F.struct(-F.col("score"), "vec_id")).alias("vec_id"))


def moves(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, move, target): a row per unit of queries(vec_id) and move, of units(vec_id, label, embedding, visits, loss, uncertainty).

    Units stand by vec_id. next and previous stay at the ends. related, cross_document and known go to the most similar other unit, of
    another label, or visited before; known falls back on related, and all stay where there is none. high_loss goes to the largest known
    loss, or where none is known to the first of the least visited; unvisited to the most uncertain of the least visited. Ties go to the first unit. A null
    loss is unknown, null visits and uncertainties are 0, a null label is a label of its own. Rows without an id or a vector are left out; ids are unique.
    """
    none = F.lit(0).cast("bigint")
    units = units.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "label", "embedding", F.coalesce("visits", none).alias("visits"), "loss", F.coalesce("uncertainty", F.lit(0.0)).alias("uncertainty"))
    units = written(units, "units")
    asked = written(queries.select("vec_id").join(units, "vec_id", "left_semi").distinct(), "asked")
    places = written(numbered(units.select("vec_id"), [], "vec_id"), "places")
    own = places.join(asked, "vec_id", "left_semi")

    def beside(step: int, name: str) -> DataFrame:
        at = places.select((F.col("rank") - step).alias("rank"), F.col("vec_id").alias("target"))
        return own.join(at, "rank", "left").select("vec_id", F.lit(name).alias("move"), F.coalesce("target", "vec_id").alias("target"))

    near = written(likest(written(units.join(asked, "vec_id", "left_semi"), "queries"), units), "near").select(F.col("query_id").alias("vec_id"), "move", F.col("vec_id").alias("target"))
    every = asked.select("vec_id", F.explode(F.array(*map(F.lit, ("related", "cross_document", "known")))).alias("move"))
    related = near.where("move = 'related'").select("vec_id", F.col("target").alias("related"))
    fallen = F.when(F.col("move") == "known", F.col("related"))
    like = every.join(near, ["vec_id", "move"], "left").join(related, "vec_id", "left").select("vec_id", "move", F.coalesce("target", fallen, "vec_id").alias("target"))
    # one row for all units, found by sums
    least = F.struct("visits", "vec_id")
    known = F.col("loss").isNotNull()
    whole = units.agg(
        F.min_by("vec_id", F.when(known, F.struct(-F.col("loss"), "vec_id"))).alias("loss"), F.min_by("vec_id", least).alias("first"),
        F.min_by("vec_id", F.struct("visits", -F.col("uncertainty"), "vec_id")).alias("unvisited"),
    ).select(F.explode(F.array(F.struct(F.lit("high_loss").alias("move"), F.coalesce("loss", "first").alias("target")), F.struct(F.lit("unvisited").alias("move"), F.col("unvisited").alias("target")))).alias("m"))
    fixed = asked.crossJoin(F.broadcast(whole)).select("vec_id", "m.move", "m.target")  # two rows
    return beside(1, "next").unionByName(beside(-1, "previous")).unionByName(like).unionByName(fixed)


@query(
    f"""WITH sig AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS visits, avg(value) FILTER (event_type = 'click') AS loss, stddev_pop(value) AS uncertainty FROM events GROUP BY user_id),
u AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e, coalesce(visits, 0) AS visits, round(loss, 6) AS loss, round(coalesce(uncertainty, 0), 6) AS uncertainty, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings LEFT JOIN sig ON vec_id = user_id),
q AS (SELECT * FROM u WHERE vec_id % {QUERY_EVERY} = 0),
p AS MATERIALIZED (SELECT q.vec_id, u.vec_id AS target, q.label <> u.label AS other, u.visits > 0 AS seen, round(list_cosine_similarity(q.e, u.e), 6) AS score FROM q, u WHERE q.vec_id <> u.vec_id),
n AS (SELECT vec_id, arg_min(target, (-score, target)) AS related, arg_min(target, (-score, target)) FILTER (other) AS cross_document, arg_min(target, (-score, target)) FILTER (seen) AS known FROM p GROUP BY vec_id),
g AS (SELECT coalesce(arg_min(vec_id, (-loss, vec_id)) FILTER (loss IS NOT NULL), arg_min(vec_id, (visits, vec_id))) AS high_loss, arg_min(vec_id, (visits, -uncertainty, vec_id)) AS unvisited FROM u),
w AS (SELECT q.vec_id, coalesce(a.vec_id, q.vec_id) AS next, coalesce(b.vec_id, q.vec_id) AS previous, coalesce(related, q.vec_id) AS related, coalesce(cross_document, q.vec_id) AS cross_document, high_loss, coalesce(known, related, q.vec_id) AS known, unvisited
  FROM q LEFT JOIN u a ON a.r = q.r + 1 LEFT JOIN u b ON b.r = q.r - 1 LEFT JOIN n ON n.vec_id = q.vec_id, g)
SELECT vec_id, move, target FROM w UNPIVOT (target FOR move IN ({', '.join(MOVES)}))"""
)
def corpus_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all seven moves lead from every twentieth vector; a user's events are the signals of the vector of that number."""
    click = F.when(F.col("event_type") == "click", F.col("value"))
    signals = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id")).agg(F.count_if(F.col("event_type") == "purchase").alias("visits"), F.round(F.avg(click), 6).alias("loss"), F.round(F.stddev_pop("value"), 6).alias("uncertainty"))
    units = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").join(signals, "vec_id", "left")
    return moves(units, units.where(F.col("vec_id") % QUERY_EVERY == 0))
