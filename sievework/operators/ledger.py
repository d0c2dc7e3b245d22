"""A ledger of failures over epochs, and what it takes out of a run.

A key is a seed's stage.  However often a key fails in an epoch, and in however many
reports, it is charged once; classes that are nobody's fault are not charged.  A key
charged more often than the limit is quarantined, and with it all later stages of its
seed, which could never be reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def charges(failures: DataFrame, spared: list[str]) -> DataFrame:
    """seed, stage, epoch, reports, failures: each key's charge of an epoch.

    failures has (seed, stage, epoch, report, error_class).  Rows without a seed, stage
    or epoch tell of no key, and those of a spared or unreadable (null) class are left out.
    """
    told = failures.where(F.col("seed").isNotNull() & F.col("stage").isNotNull() & F.col("epoch").isNotNull() & ~F.coalesce(F.col("error_class").isin(spared), F.lit(True)))
    return told.groupBy("seed", "stage", "epoch").agg(F.count_distinct("report").alias("reports"), F.count("*").alias("failures"))


def ledger(charged: DataFrame, limit: int) -> DataFrame:
    """seed, stage, attempts, first_epoch, last_epoch, quarantined_epoch: of each charged key,
    and the epoch whose charge went beyond the limit; null if none did."""
    nth = F.row_number().over(Window.partitionBy("seed", "stage").orderBy("epoch"))
    return charged.withColumn("_nth", nth).groupBy("seed", "stage").agg(
        F.count("*").alias("attempts"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.max(F.when(F.col("_nth") == limit + 1, F.col("epoch"))).alias("quarantined_epoch"))


def cascade(items: DataFrame, kept: DataFrame) -> DataFrame:
    """items (seed, stage) with state: quarantined by a ledger, downstream of a stage of the
    seed that is, or open; and blocked_by, the least quarantined stage of the seed.

    A stage is open before that stage, whatever its own charges.  One small row a
    seed meets the items.
    """
    least = kept.where(F.col("quarantined_epoch").isNotNull()).groupBy("seed").agg(F.min("stage").alias("blocked_by"))
    own = kept.where(F.col("quarantined_epoch").isNotNull()).select("seed", "stage", F.lit(True).alias("_own"))
    met = items.join(least, "seed", "left").join(own, ["seed", "stage"], "left")
    state = F.when(F.col("_own"), "quarantined").when(F.col("stage") > F.col("blocked_by"), "downstream").otherwise("open")
    return met.select(*items.columns, state.alias("state"), F.when(state != "open", F.col("blocked_by")).alias("blocked_by"))
