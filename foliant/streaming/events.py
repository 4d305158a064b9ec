"""Structured Streaming over events: each function takes a streaming DataFrame and gives one back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, in batches of whole files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counts_by_window(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts and means by event time and kind; a window is given once its lateness has passed."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sessions of users, closed by a gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def requests_once(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Each request once within the lateness: repeats of a key and payload are dropped, with bounded state."""
    keyed = events.withColumn("payload", F.sha2(F.coalesce("props", F.lit("")), 256)).withWatermark("ts", lateness)
    return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "payload"])


def every_nth(events: DataFrame, n: int = 5) -> DataFrame:
    """The samples that are persisted: every n-th by id, which needs no state."""
    return events.where(F.col("event_id") % n == 0)


def alerts(events: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Samples above the limit of their kind."""
    rule = F.lit(None).cast("string")
    for kind, limit in limits.items():
        rule = F.when((F.col("event_type") == kind) & (F.col("value") > limit), F.lit(f"high {kind}")).otherwise(rule)
    return events.withColumn("alert", rule).where("alert IS NOT NULL")


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns the rows as a table of this session; for small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


TASK_SCHEMA = "user_id bigint, state string, version bigint, refused bigint"


def task_states(events: DataFrame) -> DataFrame:
    """The state of every user's task after each batch, folded through the allowed transitions; the state kept is three values a user.

    Rows of a user are taken in the order of their time and id within a batch, batches in their order.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..operators.operations import ASKS, TRANSITIONS

    def fold(key, frames, state):
        now, version, refused = state.get if state.exists else ("open", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for asked in rows["event_type"].map(ASKS):
            if asked in TRANSITIONS[now]:
                now, version = asked, version + 1
            else:
                refused += 1
        state.update((now, version, refused))
        yield pd.DataFrame([(key[0], now, version, refused)], columns=["user_id", "state", "version", "refused"])

    return events.groupBy("user_id").applyInPandasWithState(fold, TASK_SCHEMA, "state string, version bigint, refused bigint", "update", GroupStateTimeout.NoTimeout)
