"""Order-dependent operators as windows over a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def hash_ordered_top(df: DataFrame, group: str, ident: str, k: int, seed: int) -> DataFrame:
    """The k rows of each group with the smallest SHA-256 of seed:id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256)
    return df.withColumn("_k", key).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_k"))).where(F.col("rank") <= k).drop("_k")


def first_and_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def order_violations(df: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """How often position does not grow along order, for each key."""
    before = F.lag(position).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_b", before).groupBy(key).agg(F.count_if(F.col(position) <= F.col("_b")).alias("violations"))


def unanswered(df: DataFrame, key: str, order: str, kind: str, call: str, answer: str) -> DataFrame:
    """Calls that no answer follows at once."""
    after = F.lead(kind).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_a", after).where((F.col(kind) == call) & ~F.col("_a").eqNullSafe(F.lit(answer))).drop("_a")


def renumbered(df: DataFrame, key: str, order: list, name: str = "sequence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def repeated_events_dropped(df: DataFrame, key: str, order: str, same: list[str]) -> DataFrame:
    """The first of equal events of a key, renumbered."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(key, *same).orderBy(order))).where("_n = 1").drop("_n")
    return renumbered(first, key, [order])


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before (the first row does)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = df.withColumn("previous", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return before.where((F.col("_n") == 1) | ~F.col("previous").eqNullSafe(F.col(value))).drop("_n")


def rolling_rate(df: DataFrame, key: str, seconds: str, counter: str, frame: int = 60, multiplier: float = 1.0) -> DataFrame:
    """rate of a cumulative counter against the oldest sample of the frame before.

    Null without an earlier sample, after a reset (the counter fell), or if either
    value is unknown.
    """
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-frame, -1)
    t0, v0 = F.min(seconds).over(w), F.first(counter).over(w)
    fine = t0.isNotNull() & (F.col(counter) >= v0)
    return df.withColumn("rate", F.when(fine, F.round((F.col(counter) - v0) * multiplier / (F.col(seconds) - t0), 6)))


def recent(df: DataFrame, key: str, order: list, n: int = 8) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def earliest_root(df: DataFrame, key: str, stage: str, stages: list[str]) -> DataFrame:
    """root of each key (its earliest listed stage) and, exploded, every stage from it on."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col(stage))
    roots = df.where(place > 0).groupBy(key).agg(F.min(place).cast("int").alias("_r"))
    return roots.select(key, F.element_at(F.array(*map(F.lit, stages)), F.col("_r")).alias("root"), F.explode(F.slice(F.array(*map(F.lit, stages)), F.col("_r"), len(stages))).alias("task"))


def first_missing(seeds: DataFrame, done: DataFrame, key: str, stage: str, stages: list[str], index: str, n: int) -> DataFrame:
    """The first stage that each of the first n seeds (by index, null last, then key) lacks."""
    target = seeds.orderBy(F.asc_nulls_last(index), key).limit(n).select(key)
    grid = target.select(key, F.posexplode(F.array(*map(F.lit, stages))).alias("_i", stage))
    return grid.join(done.select(key, stage).distinct(), [key, stage], "left_anti").groupBy(key).agg(F.min_by(stage, "_i").alias(stage))


def quarantined(df: DataFrame, key: str, report: str, retries: int) -> DataFrame:
    """attempts (reports that name the key) and whether they exceed retries."""
    return df.groupBy(key).agg(F.countDistinct(report).alias("attempts")).withColumn("quarantined", F.col("attempts") > retries)


def cyclic(df: DataFrame, index: str, templates: list[str], name: str = "template") -> DataFrame:
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, templates)), (F.pmod(F.col(index), F.lit(len(templates))) + 1).cast("int")))


def exposure_schedule(df: DataFrame, ident: str, epochs: int, seed: int) -> DataFrame:
    """Every row once an epoch, in a hash order of its own; position is dense within the epoch, from 0.

    Rows are dealt by range and sorted there, so no epoch is sorted in one task;
    a partition's first position is the sum of the counts before it.
    """
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(ident).cast("string")), 256)
    dealt = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("order_key", key).repartitionByRange("epoch", "order_key").sortWithinPartitions("epoch", "order_key")
    row = F.monotonically_increasing_id()
    placed = cut(dealt.withColumn("_m", row).select("*", F.shiftright("_m", 33).alias("_p"), F.expr("_m & 8589934591").alias("_i")).drop("_m"), "schedule")
    here = placed.groupBy("epoch", "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    # A row for each epoch and partition.
    base = here.select("epoch", "_p", (F.coalesce(F.sum("_n").over(Window.partitionBy("epoch").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(base, ["epoch", "_p"]).withColumn("position", F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")


def rank_in(names: list[str], column: Column) -> Column:
    """Fixed order first, then the rest by name."""
    at = F.array_position(F.array(*map(F.lit, names)), column)
    return F.struct(F.when(at > 0, at).otherwise(F.lit(len(names) + 1)), column)
