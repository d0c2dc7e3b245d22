"""Telemetry over an event stream (user_id, event_type, ts, value, event_id)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def replay(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream over event files in path, a few at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame) -> DataFrame:
    """Running totals of each type; unknown values are counted, not summed."""
    return events.groupBy("event_type").agg(F.count("*").alias("rows"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count_if(F.col("value").isNull()).alias("unknown_rows"))


def windowed_rates(events: DataFrame, window: str = "60 seconds", slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Events a second in sliding windows; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n",
        (F.col("n") / (F.unix_seconds("window.end") - F.unix_seconds("window.start"))).alias("per_second"))


def change_log(events: DataFrame) -> DataFrame:
    """A row whenever a user's latest event type differs from the one kept in state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The rows of one user in one batch.
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = rows["event_type"].shift(1, fill_value=state.get[0] if state.exists else None)
        changed = rows["event_type"].ne(before) & ~(rows["event_type"].isna() & before.isna())
        state.update((rows["event_type"].iloc[-1],))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "previous": before, "current": rows["event_type"]})[changed]

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, previous string, current string", "last string", "append", "NoTimeout")


def complete_keys(batch: DataFrame, seen: DataFrame | None, kinds: int) -> DataFrame:
    """For foreachBatch: distinct (user, type) pairs of all batches so far and who has all kinds."""
    pairs = batch.select("user_id", "event_type").distinct()
    pairs = pairs if seen is None else seen.unionByName(pairs).distinct()
    return pairs.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") == kinds).select("user_id")


def fresh(status_seconds, data_seconds, grace: float, checkpoint: float):
    """Whether a status is not older than its data by more than the larger grace."""
    return F.coalesce(status_seconds + F.greatest(F.lit(float(grace)), F.lit(max(0.0, checkpoint) * 3 + 5)) >= data_seconds, status_seconds.isNotNull())
