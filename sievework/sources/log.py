"""Record logs as batches: numbered lines of JSON objects, whatever splits they are read in.

Spark's text source deals a file in byte ranges.  A line's number is its place in its
range plus the lines of the ranges before it, one small row a range.  Lines end with a
line feed; a last line without one is torn if it is no JSON object, and left out: its
writer died.  Every other line that is none is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges whose rows may be broadcast: a few numbers and a path each.
FEW_RANGES = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1), line (without its end), torn_end: all lines of the files, blank ones too.

    torn_end tells the last line of a file that does not end with a line feed: there,
    the lines with an end each are one byte longer than the file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_at"))
    ranges = lines.groupBy("path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum(F.octet_length("line").cast("long") + 1).alias("_bytes"), F.first("_size").alias("_size"))
    by_file = Window.partitionBy("path")
    order = by_file.orderBy("_start")
    placed = ranges.select("path", "_start", "_first", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.when(F.sum("_bytes").over(by_file) == F.col("_size") + 1, F.sum("_n").over(by_file)).alias("_torn_no"))
    if placed.limit(FEW_RANGES + 1).count() <= FEW_RANGES:
        placed = F.broadcast(placed)
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return lines.drop("_size").join(placed, ["path", "_start"]).select("path", number.alias("line_no"), "line", (number == F.col("_torn_no")).alias("_torn")).select(
        "path", "line_no", "line", F.coalesce("_torn", F.lit(False)).alias("torn_end"))


def judged_lines(lines: DataFrame) -> DataFrame:
    """lines with state: record (a JSON object), blank, torn or bad."""
    text = F.regexp_replace("line", r"\r$", "")
    record = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    state = F.when(F.trim(F.regexp_replace(text, r"\s", " ")) == "", "blank").when(record, "record").when(F.col("torn_end"), "torn").otherwise("bad")
    return lines.select("path", "line_no", text.alias("line"), state.alias("state"))


def load(spark: SparkSession, path: str, identity: str | None = None) -> DataFrame:
    """path, line_no, line of every record.  Blank and torn lines are left out; a bad one
    raises with its path and number, and shows none of its content.

    identity: a field; of records that share it, the first by path and line stays, and
    those without it stay all.
    """
    kept = judged_lines(numbered_lines(spark, path)).where(~F.col("state").isin("blank", "torn"))
    fine = kept.withColumn("line", F.when(F.col("state") == "record", F.col("line")).otherwise(
        F.raise_error(F.concat(F.lit("no JSON object: "), F.col("path"), F.lit(":"), F.col("line_no"))).cast("string"))).select("path", "line_no", "line")
    if identity is None:
        return fine
    own = fine.withColumn("_id", F.try_variant_get(F.try_parse_json("line"), f"$.{identity}", "string"))
    first = own.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.min(F.struct("path", "line_no", "line")).alias("r")).select("r.*")
    return first.unionByName(own.where(F.col("_id").isNull()).drop("_id"))
