"""Streaming operators replayed over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ..streaming import monitor
from .common import Tables, registry

QUERIES, query = registry()

#: Files of a replay: a batch each.
BATCHES = 4


def _replay(t: Tables, df: DataFrame, order: str) -> tuple[DataFrame, str]:
    """(a stream over df, written as files in an order, one a batch; its folder)"""
    base = f"{folder(t.spark)}/replay-{uuid.uuid4().hex}"
    df.repartitionByRange(BATCHES, order).write.parquet(f"{base}/in")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), base


def _with_state_store(t: Tables, run) -> None:
    """run() under a state store that holds values and maps; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name, None)
    t.spark.conf.set(name, monitor.STATE_STORE)
    try:
        run()
    finally:
        t.spark.conf.set(name, before) if before else t.spark.conf.unset(name)


@query("""
SELECT user_id % 4 AS shard, event_type AS stage, count(DISTINCT user_id) AS files, count(*) AS rows, sum(value) AS total, count_if(value IS NULL)::BIGINT AS unknown_rows
FROM (SELECT *, max(date_part('day', ts) // 3) OVER (PARTITION BY user_id) AS newest FROM events) WHERE date_part('day', ts) // 3 = newest AND event_type IS NOT NULL GROUP BY 1, 2
""")
def q_shard_totals(t: Tables) -> DataFrame:
    """Each user's log is a file of one of four shards that is replaced every third day:
    totals of what the files now hold, by a stream whose state starts anew with a file's
    generation, whatever order its rows come in."""
    events = t.events.select((F.col("user_id") % 4).alias("shard"), F.col("user_id").cast("string").alias("file"), F.expr("day(ts) div 3").alias("generation"),
                             F.col("event_type").alias("stage"), F.col("value").alias("amount"), "event_id")
    stream, base = _replay(t, events, "event_id")
    updates = monitor.file_totals(stream.drop("event_id"), ordered=True)
    _with_state_store(t, lambda: monitor.record(updates, f"{base}/out", f"{base}/state").awaitTermination())
    return monitor.shard_totals(monitor.latest_totals(monitor.recorded(t.spark, f"{base}/out", updates.schema)))


_SEEN = """
WITH pairs AS (SELECT user_id AS "index", event_type AS stage, bool_or(event_type = 'error' AND value > 330) AS rejected FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)
SELECT "index", count_if(NOT rejected)::BIGINT AS stages, bool_or(rejected) AS rejected, NOT bool_or(rejected) AND count_if(NOT rejected) = 5 AS complete FROM pairs GROUP BY "index"
"""


def _progress(t: Tables) -> DataFrame:
    """Seen pairs of a replay.  A pair's first batch decides, so a batch holds whole users."""
    rows = t.events.select(F.col("user_id").alias("index"), F.col("event_type").alias("stage"), ((F.col("event_type") == "error") & (F.col("value") > 330)).alias("rejected"))
    stream, base = _replay(t, rows, "index")
    monitor.record(stream, f"{base}/seen", f"{base}/state", monitor.first_seen(f"{base}/seen")).awaitTermination()
    return monitor.recorded(t.spark, f"{base}/seen", monitor.PROGRESS)


@query(_SEEN)
def q_durable_progress(t: Tables) -> DataFrame:
    """Stages that each index passed, by batches that may run twice and count once."""
    return monitor.progress(_progress(t), 5)


@query(f"""
SELECT count(*) AS used, count_if(rejected)::BIGINT AS rejected, count_if(complete)::BIGINT AS complete, greatest(1000 - count_if(complete), 0)::BIGINT AS remaining,
       greatest(1000 - count_if(complete), 0) / 2.5 AS eta_seconds FROM ({_SEEN})
""")
def q_outlook(t: Tables) -> DataFrame:
    """How many of a thousand wanted indexes are complete, and the time that the others take at 2.5 a second."""
    return monitor.outlook(monitor.progress(_progress(t), 5), 1000, 2.5)


@query("""
WITH runs AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM events),
counted AS (SELECT user_id, ts, event_id, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id, era ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clicks FROM runs),
points AS (SELECT user_id, ts, arg_max(clicks, event_id) AS clicks FROM counted GROUP BY user_id, ts),
pairs AS (
  SELECT p.user_id, p.ts, p.clicks, min(struct_pack(a := q.ts, c := q.clicks)) AS base, max(struct_pack(a := q.ts, c := q.clicks)) AS near
  FROM points p LEFT JOIN points q ON p.user_id = q.user_id AND q.ts < p.ts AND q.ts >= p.ts - INTERVAL 2 DAY AND q.clicks <> p.clicks GROUP BY ALL)
SELECT user_id, epoch_us(ts) AS at_us, clicks::BIGINT AS clicks, epoch_us(base.a) AS base_us, base.c::BIGINT AS base, epoch_us(near.a) AS last_us, near.c::BIGINT AS last_different,
       CASE WHEN clicks > base.c THEN (clicks - base.c) / (date_diff('us', base.a, ts) / 1e6) END AS per_second FROM pairs
""")
def q_since_different(t: Tables) -> DataFrame:
    """Clicks of each user since the last sign-up, with their growth since the earliest other
    value of the last two days; a sign-up resets the counter and leaves no rate."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    era = t.events.withColumn("era", F.sum((F.col("event_type") == "signup").cast("int")).over(order))
    inside = Window.partitionBy("user_id", "era").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = era.withColumn("clicks", F.sum((F.col("event_type") == "click").cast("int")).over(inside))
    points = counted.groupBy("user_id", "ts").agg(F.max_by("clicks", "event_id").alias("clicks"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return monitor.since_different(points, ["user_id"], "ts", "clicks", 2 * 86_400).select(
        "user_id", us("ts").alias("at_us"), "clicks", us("base_at").alias("base_us"), "base", us("last_at").alias("last_us"), "last_different", "per_second")
