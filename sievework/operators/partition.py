"""Dispositions, gates, coverage and the three-way partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_array(**rules: Column) -> Column:
    """Sorted names of the rules that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def disposed(df: DataFrame, hard: Column, soft: Column) -> DataFrame:
    """disposition (reject over negative over gold) and labels of every row."""
    out = df.withColumn("_h", hard).withColumn("_s", soft)
    d = F.when(F.size("_h") > 0, F.lit("reject")).when(F.size("_s") > 0, F.lit("negative")).otherwise(F.lit("gold"))
    return out.withColumn("disposition", d).withColumn("labels", F.array_sort(F.array_union("_h", "_s"))).drop("_h", "_s")


def split(df: DataFrame, content: Column, ident: str) -> dict[str, DataFrame]:
    """gold and negative with their content; reject with a hash and reason codes only."""
    return {"gold": df.where("disposition = 'gold'"), "negative": df.where("disposition = 'negative'"),
            "reject": df.where("disposition = 'reject'").select(F.sha2(F.concat(F.lit("reject:"), F.col(ident).cast("string")), 256).alias("id"), F.sha2(content, 256).alias("source_record_sha256"), F.col("labels").alias("reason_codes"), F.lit(False).alias("content_retained"))}


def gate(df: DataFrame, stage: str, ident: str, prompt: str, seed: str, target: int, stages: int, violation: Column, least_success: float, most_duplicates: float) -> DataFrame:
    """One row: records, success and duplicate rates, violations, and whether all pass."""
    per = df.groupBy(stage).agg(F.count("*").alias("n"), F.countDistinct(ident).alias("ids"), F.countDistinct(F.coalesce(prompt, F.lit(""))).alias("prompts"),
                                F.countDistinct(F.when(F.col(seed) != "", F.col(seed))).alias("seeds"), F.count_if(violation).alias("bad"))
    total = per.agg(F.sum("n").alias("records"), F.sum(F.least("seeds", F.lit(target))).alias("successful"), F.sum(F.greatest(F.col("n") - F.col("ids"), F.col("n") - F.col("prompts"))).alias("duplicate_count"), F.sum("bad").alias("safety_violations"))
    rates = total.withColumn("success_rate", F.col("successful") / F.lit(target * stages)).withColumn("duplicate_rate", F.when(F.col("records") > 0, F.col("duplicate_count") / F.col("records")).otherwise(F.lit(0.0)))
    return rates.withColumn("passed", (F.col("success_rate") >= least_success) & (F.col("duplicate_rate") <= most_duplicates) & (F.col("safety_violations") == 0))


def axis_coverage(df: DataFrame, axes: list[str], templates: int) -> DataFrame:
    """axis, value, n and whether n reaches its even share; enforced from `templates` rows on."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])).alias("x")).select("x.*")
    counts = long.groupBy("axis", "value").agg(F.count("*").alias("n"))
    per_axis = counts.groupBy("axis").agg(F.sum("n").alias("total"), F.count("*").alias("values"))
    share = F.floor(F.col("total") / F.greatest(F.col("values"), F.lit(templates)))
    return counts.join(per_axis, "axis").select("axis", "value", "n", F.when(F.col("total") >= templates, F.col("n") >= share).otherwise(F.lit(True)).alias("covered"))


def deficits(**parts: Column) -> Column:
    """A struct of non-negative shortfalls: lower is never worse."""
    return F.struct(*[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint").alias(n) for n, c in parts.items()])
