"""Sharding by proportional stratified interleaving.

Rows are ranked within their source by a seeded hash.  Rank r of n becomes the
fraction (r + 0.5) / n, so the rows of every source spread evenly over (0, 1).
In the order of fractions, cut into equal runs, each shard holds each source in
the proportion of the whole corpus, and counts differ by one at most (`rows`).

Both orders are total orders dealt by range: a source that holds a third of all
rows spans as many partitions as it needs.  Texts are read once and not moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, number_rows


def shard(docs: DataFrame, shards: int = 24, seed: str = "interleave", strata: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, law, shard, slot and grown_shard of all rows.

    size is the text's bytes (null text: none) plus 8.  A null source is a
    stratum of its own; null or repeated doc_id are rows like others (equal rows
    are interchangeable).  An empty table gives no rows; with fewer rows than
    shards some shards stay empty.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    slim = docs.select(
        doc_id.alias("doc_id"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).__add__(F.lit(8)).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.col(strata).cast("string").alias("source"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))).alias("_order"))
    ranked = number_rows(slim, ["source", "_order", "doc_id", "text_crc32"], "by-source").withColumnRenamed("row_no", "_row")
    sources = ranked.groupBy(F.col("source").alias("_s")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    placed = ranked.join(few(sources), F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_fraction", (F.col("_row") - F.col("_first") + 0.5) / F.col("_n")).drop("_s", "_first", "_n", "_order")
    dealt = number_rows(placed, ["_fraction", "source", "_row"], "by-fraction")
    total = dealt.count()
    # Shard k takes the positions from ceil(k * total / shards) on.
    k = F.expr(f"(row_no * {shards}L) div {max(total, 1)}L")
    return dealt.select(
        "doc_id", "size", "text_crc32", "source", F.lit("rows").alias("law"), k.cast("int").alias("shard"),
        (F.col("row_no") - F.expr(f"(((row_no * {shards}L) div {max(total, 1)}L) * {total}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
