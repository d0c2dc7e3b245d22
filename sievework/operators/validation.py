"""Validation reports, held-out sets, capacity and coverage of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import safety as S
from ..functions.text import collapsed


def validation_report(lines: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(path, expert and valid records, and path, line and code of the first `most` errors of each path).

    lines has path, line and raw.  Of valid records that share an id the first line
    counts, the others are errors.
    """
    v = F.try_parse_json("raw")
    judged = lines.select("path", "line", R.record_violation(F.col("raw")).alias("code"), F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.expert", "string").alias("expert"))
    fine = judged.where("code IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy("path", "id").orderBy("line")))
    counts = fine.where("_n = 1").groupBy("path", "expert").agg(F.count("*").alias("valid"))
    wrong = judged.where("code IS NOT NULL").select("path", "line", "code").unionByName(fine.where("_n > 1").select("path", "line", F.lit("duplicate_id").alias("code")))
    return counts, wrong.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("_n") <= most).drop("_n")


def index_ranges(df: DataFrame, group: str, index: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.min(index).alias("first_index"), F.max(index).alias("last_index"))


def distinct_json(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct values of columns as sorted JSON objects: one row, for columns of few values."""
    return df.select(F.to_json(F.struct(*sorted(columns))).alias("j")).distinct().agg(F.array_sort(F.collect_list("j")).alias(name))


def capacity(counts: DataFrame, group: str, target: int, least: int) -> DataFrame:
    """What a group can still reach: its gold and the room that target leaves, against least."""
    left = F.greatest(F.lit(target) - F.col("collected"), F.lit(0))
    return counts.select(group, "collected", "gold", left.alias("remaining"), (F.col("gold") + left).alias("maximum"), (F.col("gold") + left >= least).alias("reachable"))


def lower_bound(usage: DataFrame, measure: str, requests: Column) -> DataFrame:
    """A usage rollup whose requests were counted elsewhere: rows that are missing are
    unknown, and the sum is never exact."""
    return usage.withColumn(f"{measure}_unknown_rows", F.col(f"{measure}_unknown_rows") + F.greatest(requests - F.col("rows"), F.lit(0))).withColumn(f"{measure}_exact", F.lit(False))


def heldout_violations(cases: DataFrame, ident: str, requirement: str, expected: str, malicious: str) -> DataFrame:
    """cases with the first rule that each breaks: own id, own requirement, a decision, and a label that fits it.

    Counts are grouped before they meet the cases.
    """
    text = F.sha2(collapsed(F.col(requirement)), 256)
    keyed = cases.withColumn("_i", F.col(ident)).withColumn("_r", text)
    ids = keyed.groupBy("_i").agg(F.count("*").alias("_same_id"))
    texts = keyed.groupBy("_r").agg(F.count("*").alias("_same_text"))
    code = R.first_code(("repeated_id", F.col("_same_id") > 1), ("repeated_requirement", F.col("_same_text") > 1), ("expected_decision", ~F.coalesce(F.col(expected).isin("PASS", "BLOCK"), F.lit(False))),
                        ("label_disagrees", (F.col(expected) == "BLOCK") != F.col(malicious)))
    return keyed.join(ids, "_i", "left").join(texts, "_r", "left").withColumn("violation", code).drop("_i", "_r", "_same_id", "_same_text")


def secret_lines(df: DataFrame, ident: str, text: str) -> DataFrame:
    """ident and line, from 1, of every line that holds a secret; never its content."""
    return df.where(S.has_secret(F.col(text))).select(ident, F.posexplode(F.split(text, "\n"))).where(S.has_secret(F.col("col"))).select(ident, (F.col("pos") + 1).alias("line"))


def approved_calls(calls: DataFrame, proposals: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """calls with whether a proposal of the same key has their signature."""
    digest = F.sha2(F.to_json(F.struct(*signature)), 256)
    known = proposals.select(F.col(key).alias("_k"), digest.alias("_s")).distinct().withColumn("_ok", F.lit(True))
    own = calls.withColumn("_sig", digest)
    return own.join(known, (F.col(key) == F.col("_k")) & (F.col("_sig") == F.col("_s")), "left").withColumn("approved", F.coalesce("_ok", F.lit(False))).drop("_k", "_s", "_ok", "_sig")


def cover_errors(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: uncovered ones are wanted, unknown ones were not."""
    a, b = wanted.select(F.col(key).alias("_a")).distinct(), given.select(F.col(key).alias("_b")).distinct()
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer").where("_a IS NULL OR _b IS NULL")
    return j.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_b").isNull(), "uncovered").otherwise("unknown").alias("problem"))
