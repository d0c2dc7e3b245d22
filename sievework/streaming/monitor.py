"""Totals of growing files that survive restarts, and progress that counts a row once.

A file is followed by its generation: when it is cut off or replaced, its state
starts anew.  What a batch gives is written under the batch's number, so that a
batch that runs twice leaves one result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileTotals(StatefulProcessor):
    """Rows, total and unknown amounts of each stage of one file's present generation.

    ordered: generations are numbers, a larger one is newer and rows of a smaller one,
    read late, are left out.  Otherwise any other generation than the kept one is
    newer, as a source that follows files in order tells it.
    """

    def __init__(self, ordered: bool, ttl_ms: int | None):
        self.ordered, self.ttl_ms = ordered, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.generation = handle.getValueState("generation", "generation string", self.ttl_ms)
        self.totals = handle.getValueState("totals", "stages array<string>, n array<long>, total array<double>, unknown array<long>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Two reads and at most two writes of state, however many rows and stages: each is a round trip."""
        read: dict[str, dict[str, list]] = {}
        for _, _, generation, stage, amount in rows:
            if generation is not None:
                sums = read.setdefault(generation, {}).setdefault(stage, [0, 0.0, 0])
                sums[0] += 1
                if amount is None or amount != amount:
                    sums[2] += 1
                else:
                    sums[1] += amount
        rank = int if self.ordered else str
        kept = self.generation.get()
        before = current = kept[0] if kept else None
        found = {}
        held = self.totals.get() if kept else None
        if held:
            found = {stage: list(sums) for stage, *sums in zip(*held)}
        for generation in sorted(read, key=rank) if self.ordered else read:
            if current is None or (rank(generation) > rank(current) if self.ordered else generation != current):
                current, found = generation, {}
            if generation != current:
                continue
            for stage, sums in read[generation].items():
                found[stage] = [x + y for x, y in zip(found.get(stage, (0, 0.0, 0)), sums)]
        if current != before:
            self.generation.update((current,))
        if current in read:
            self.totals.update((list(found), *map(list, zip(*found.values()))))
        for stage, (n, total, unknown) in found.items():
            yield Row(shard=key[0], file=key[1], generation=current, stage=stage, rows=n, total=total, unknown_rows=unknown)

    def close(self) -> None:
        pass


def file_totals(lines: DataFrame, ordered: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """Stream of (shard, file, generation string, stage, amount) to the totals of each file
    that a batch touches: all stages of its present generation.  Rows without a stage
    are left out; unknown amounts are counted, not summed.  State holds two rows of each
    file, its generation and its totals, which ttl_ms forgets when they were not touched for
    so long; the query then wakes to forget, so it must poll (`record` with once=False) and
    never ends.
    """
    return lines.where(F.col("stage").isNotNull()).select("shard", "file", F.col("generation").cast("string").alias("generation"), "stage", F.col("amount").cast("double").alias("amount")).groupBy(
        "shard", "file").transformWithState(FileTotals(ordered, ttl_ms), "shard long, file string, generation string, stage string, rows long, total double, unknown_rows long",
                                                    "update", "processingTime" if ttl_ms else "none")


def record(stream: DataFrame, folder: str, checkpoint: str, per_batch: Callable[[DataFrame, int], DataFrame] | None = None, once: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """Write each batch (or what per_batch makes of it) to folder/batch_id=N, overwriting:
    a batch repeated after a failure leaves one result.  once: all there is, then end;
    otherwise poll."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = per_batch(batch, batch_id) if per_batch else batch
        out.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def recorded(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All batches of a folder so far, with batch_id; a folder not yet written has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = StructType([*schema.fields]).add("batch_id", LongType())
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", folder).parquet(folder)


def latest_totals(updates: DataFrame) -> DataFrame:
    """The present totals from `record`ed updates: each file's last batch."""
    last = updates.groupBy("shard", "file").agg(F.max("batch_id").alias("batch_id"))
    return updates.join(last, ["shard", "file", "batch_id"], "left_semi").drop("batch_id")


def shard_totals(totals: DataFrame) -> DataFrame:
    """Totals of each shard and stage over its files."""
    return totals.groupBy("shard", "stage").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.sum("unknown_rows").alias("unknown_rows"))


#: Columns of a progress row: an index of a seed, the stage it passed, whether it was rejected.
PROGRESS = StructType().add("index", LongType()).add("stage", "string").add("rejected", "boolean")


def first_seen(folder: str) -> Callable[[DataFrame, int], DataFrame]:
    """per_batch for `record` over PROGRESS rows: (index, stage) pairs that no earlier batch
    holds, once each; rejected if any of its rows is.  Batches from this one on, left by a
    run that failed, are not looked at, so a repeated batch finds the same."""

    def new(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        pairs = batch.where(F.col("index").isNotNull() & F.col("stage").isNotNull()).groupBy("index", "stage").agg(F.max(F.coalesce("rejected", F.lit(False))).alias("rejected"))
        seen = recorded(spark, folder, PROGRESS).where(F.col("batch_id") < batch_id).select("index", "stage")
        return pairs.join(seen, ["index", "stage"], "left_anti")

    return new


def progress(seen: DataFrame, stages: int) -> DataFrame:
    """Of each index: stages passed, whether it is rejected, complete (all stages, none rejected) or pending."""
    rejected = F.max("rejected")
    passed = F.count_if(~F.col("rejected"))
    return seen.groupBy("index").agg(passed.alias("stages"), rejected.alias("rejected"), (~rejected & (passed == stages)).alias("complete"))


def outlook(state: DataFrame, wanted: int, per_second: float | None) -> DataFrame:
    """One row: indexes used, rejected, complete, remaining of wanted, and the seconds that
    the remaining take at a rate; unknown without one."""
    remaining = F.greatest(F.lit(wanted) - F.count_if("complete"), F.lit(0))
    return state.agg(F.count("*").alias("used"), F.count_if("rejected").alias("rejected"), F.count_if("complete").alias("complete"), remaining.alias("remaining")).withColumn(
        "eta_seconds", F.col("remaining") / F.lit(per_second if per_second and per_second > 0 else None).cast("double"))


def since_different(points: DataFrame, keys: list[str], at: str, counter: str, retention: Column | int) -> DataFrame:
    """Each point with the counter's movement in the retention (seconds) before it.

    points has one row per keys and time `at`.  base_at and base are the earliest point
    in the retention whose counter differs; last_at and last_different the latest such;
    per_second the counter's growth since base, null when it fell (a reset) or did not move.

    Islands of equal counters make it one pass: the earliest point in range is the base
    itself, or it equals the present one and then the island after its own is.
    """
    own = Window.partitionBy(*keys).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    changed = (~F.col(counter).eqNullSafe(F.lag(counter).over(own))) & F.lag(at).over(own).isNotNull()
    marked = points.withColumn("_us", micros).withColumn("_island", F.sum(changed.cast("int")).over(own)).withColumn(
        "_start", F.when(changed, F.struct(F.col(at).alias("at"), F.col("_us").alias("us"), F.col(counter).alias("value"))))
    marked = marked.withColumn("_next", F.first("_start", ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))).withColumn(
        "_last", F.last(F.when(changed, F.struct(F.lag(at).over(own).alias("at"), F.lag("_us").over(own).alias("us"), F.lag(counter).over(own).alias("value"))), ignorenulls=True).over(own))
    reach = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-int(retention) * 1_000_000, 0)
    first = F.first(F.struct(F.col(at).alias("at"), F.col("_us").alias("us"), F.col(counter).alias("value"), F.col("_next").alias("next"))).over(reach)
    seen = marked.withColumn("_first", first)
    base = F.when(~F.col("_first.value").eqNullSafe(F.col(counter)), F.struct("_first.at", "_first.us", "_first.value")).when(F.col("_first.next.us") < F.col("_us"), F.col("_first.next"))
    near = F.when(F.col("_last.us") >= F.col("_us") - int(retention) * 1_000_000, F.col("_last"))
    out = seen.withColumn("_base", base).withColumn("_near", near)
    grown = F.col(counter) - F.col("_base.value")
    return out.select(*points.columns, F.col("_base.at").alias("base_at"), F.col("_base.value").alias("base"), F.col("_near.at").alias("last_at"), F.col("_near.value").alias("last_different"),
                      F.when(grown > 0, grown / ((F.col("_us") - F.col("_base.us")) / 1_000_000)).alias("per_second"))
