"""Sessions from their events to gold, negative and content-free rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sessions import EVENT, RESULT_STATUS


def assemble(events: DataFrame, key: str) -> DataFrame:
    """key, events: each session's events (columns of EVENT, order) as one array in their order."""
    fields = [f.split(":")[0].strip() for f in EVENT[len("struct<"):-1].split(",")]
    return events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("order", *fields))).alias("_events")).select(
        key, F.expr(f"transform(_events, e -> struct({', '.join('e.' + f for f in fields)}))").cast(f"array<{EVENT}>").alias("events"))


def quality_labels(events: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """key, labels: why a whole session is no gold, sorted: made anew from its events, whatever it states itself.

    A session without a user's or an assistant's text, with calls of another tool,
    without a result for each call, or whose results are not all completed.
    """
    call, result = F.col("type") == "tool_call", F.col("type") == "tool_result"
    label = lambda when, name: F.when(when, F.lit(name))
    found = F.array_compact(F.array(
        label(F.count_if(F.col("type") == "assistant_output") == 0, "assistant_missing"), label(F.count_if(call) != F.count_if(result), "result_missing"),
        label(F.count_if(call & ~F.col("tool").isin(allowed)) > 0, "tool_not_allowed"), label(F.count_if(result & (F.col("status") == "error")) > 0, "tool_error"),
        label(F.count_if(result & ~F.col("status").isin(RESULT_STATUS)) > 0, "tool_status"), label(F.count_if(F.col("type") == "user_input") == 0, "user_missing")))
    return events.groupBy(key).agg(F.array_sort(found).alias("labels"))


def partition_sessions(events: DataFrame, key: str, violation: Column, retained: Column, stated: DataFrame, allowed: list[str]) -> DataFrame:
    """key, disposition, codes, messages, n_messages: one row a session of stated (key, labels).

    violation judges an event's text; any makes the whole session a reject, of which
    only its sorted codes remain.  Labels that differ from `quality_labels` reject it
    too.  Otherwise the retained events are numbered anew from 1 and put together
    again; sessions with labels are negative, those without gold.
    """
    judged = events.withColumn("_code", violation).withColumn("_kept", retained)
    message = F.when(F.col("_kept"), F.struct("order", "type", F.coalesce("content", "input").alias("content")))
    gathered = judged.groupBy(key).agg(F.array_sort(F.collect_set("_code")).alias("_codes"), F.sort_array(F.collect_list(message)).alias("_messages"))
    made = stated.select(key, F.col("labels").alias("_stated")).join(gathered, key, "left").join(quality_labels(events, key, allowed), key, "left")
    none = F.array().cast("array<string>")
    differ = F.when(~F.coalesce(F.array_sort(F.array_distinct("_stated")), none).eqNullSafe(F.coalesce("labels", none)), F.array(F.lit("labels_differ"))).otherwise(none)
    codes = F.array_sort(F.concat(F.coalesce("_codes", F.array(F.lit("no_events"))), differ))
    rejected = F.size("_codes_all") > 0
    messages = F.expr("transform(_messages, (m, i) -> struct(CAST(i + 1 AS BIGINT) AS sequence, m.type AS type, m.content AS content))")
    return made.withColumn("_codes_all", codes).select(
        key, F.when(rejected, F.lit("reject")).when(F.size("labels") > 0, F.lit("negative")).otherwise(F.lit("gold")).alias("disposition"),
        F.when(rejected, F.col("_codes_all")).otherwise(F.col("labels")).alias("codes"),
        F.when(~rejected, messages).alias("messages"), F.when(~rejected, F.size("_messages")).cast("bigint").alias("n_messages"))
