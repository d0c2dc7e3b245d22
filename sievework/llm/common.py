"""What several operators share: scratch tables, row numbers, safe columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder

#: Row index inside a partition, in monotonically_increasing_id().
_INDEX_BITS = 33


#: Rows and bytes of an Arrow batch.  Texts may be very long, so the usual 10,000
#: rows would hold too much of an executor's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on passes at most BATCH_ROWS rows and about
    BATCH_BYTES bytes to Python at once (one longer text goes by itself).  Smaller
    settings of the session's own stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(str(conf.get(name)).rstrip("bB")) <= most:
            conf.set(name, str(most))
    return df


#: Bytes that a Python worker's memo holds, about; bytes of an entry (a slot and two
#: small objects); the longest key that it keeps.
MEMO_BYTES = 128 << 20
_ENTRY = 160
MEMO_KEY = 40


class Memo(dict):
    """make(key) of the keys asked for lately.

    Two generations of half the budget each: when the young one is full it becomes
    the old one, and what is asked for again moves back.  Long keys are not kept.
    """

    def __init__(self, make: Callable, budget: int = MEMO_BYTES):
        super().__init__()
        self.make, self.room, self.old = make, budget // 2 // _ENTRY, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_KEY:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def released_after(self, run: Callable) -> Callable:
        """run, a function of batches, which leaves nothing in this memory to the worker's next task."""

        def out(batches):
            try:
                yield from run(batches)
            finally:
                self.clear()
                self.old = {}

        return out


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.  This cuts
    the lineage: what follows never recomputes df, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for tables, once all that reads them is written."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


#: Small rows that may be broadcast.
FEW_ROWS = 1_000_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows: for rows of a few numbers, counted before."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def number_rows(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Dense row numbers from 0 in the order of keys, as `row_no`; written.

    Rows are dealt by range and sorted within their partitions; each partition's
    first number is the sum of the counts before it (one small row a partition),
    so no task sees more than its own range.
    """
    mid = F.monotonically_increasing_id()
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_mid", mid)
        .select("*", F.shiftright("_mid", _INDEX_BITS).alias("_pid"),
                F.col("_mid").bitwiseAND((1 << _INDEX_BITS) - 1).alias("_idx")).drop("_mid"),
        name)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_pid").agg(F.count("*").alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # One row a partition.
    return placed.join(few(starts), "_pid").withColumn("row_no", F.col("_base") + F.col("_idx")).drop("_pid", "_idx", "_base")
