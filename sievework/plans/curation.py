"""Whole jobs: partition with manifest, shard merge, guarded import, retry plan, snapshot, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import partition as P
from ..sources import jsonl
from ..sources.scratch import cut

STAGES = ["plan", "tool_policy", "frontend", "review", "security"]


@dataclass
class Partition:
    gold: DataFrame
    negative: DataFrame
    reject: DataFrame
    counts: dict
    manifest: str
    digest: str


def offline_partition(records: DataFrame, hard: Column, soft: Column, content: Column, by: str, ident: str = "id", near: tuple[str, str] | None = None) -> Partition:
    """gold, negative and reject with a manifest of counts.

    near = (index column, text column): gold rows that resemble an earlier gold
    row become negative.  The manifest is a few counts a stage; the parts stay on
    the cluster.
    """
    rows = P.disposed(records, hard, soft)
    if near:
        gold = rows.where("disposition = 'gold'")
        reps = D.near_representatives(gold, ident, near[0], T.exact_tokens(F.col(near[1])))
        losers = reps.where(F.col(ident) != F.col("representative")).select(F.col(ident).alias("_loser"))
        rows = rows.join(losers, F.col(ident) == F.col("_loser"), "left")
        lost = F.col("_loser").isNotNull()
        rows = rows.withColumn("labels", F.when(lost, F.array_sort(F.array_union("labels", F.array(F.lit("near_duplicate"))))).otherwise(F.col("labels"))).withColumn(
            "disposition", F.when(lost, F.lit("negative")).otherwise(F.col("disposition"))).drop("_loser")
    rows = cut(rows, "partition")
    parts = P.split(rows, content, ident)
    counts = {f"{r[by]}:{r.disposition}": r.n for r in rows.groupBy(by, "disposition").agg(F.count("*").alias("n")).collect()}
    raw = sum(counts.values())
    if raw != records.count():
        raise ValueError("the partition lost or made rows")
    text, digest = jsonl.manifest({"counts": counts, "raw": raw})
    return Partition(parts["gold"], parts["negative"], parts["reject"], counts, text, digest)


def merge_shards(shards: list[DataFrame], content: Column, seeds: DataFrame) -> tuple[DataFrame, dict]:
    """(records, counts) of stage records (id, task, seed_id, source_id): conflict-checked
    union, no seed or source unresolved, and every seed's stages a prefix of all."""
    merged, found = D.conflict_union(shards, "id", content, ["task", "seed_id"])
    dangling = J.missing_references([("seed_id", merged, "seed_id", seeds, "seed_id"), ("source_id", merged, "source_id", merged, "id")]).count()
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("task")).cast("int")
    holes = merged.groupBy("seed_id").agg(F.max(place).alias("last"), F.countDistinct("task").alias("n")).where("last <> n").count()
    if dangling or holes:
        raise D.ConflictError(f"{dangling} references do not resolve, {holes} seeds skip a stage")
    return merged, found.first().asDict()


def guarded_import(rows: DataFrame, allow: DataFrame, key: str, deny: dict[str, DataFrame]) -> DataFrame:
    """Rows on the allowlist that no denylist names; a repeated or missing entry raises."""
    kept, missing = J.allowlisted(rows, allow, key)
    absent, twice = missing.count(), kept.groupBy(key).count().where("count > 1").count()
    if absent or twice:
        raise ValueError(f"{absent} allowed entries are missing, {twice} are repeated")
    return J.denied(kept, deny)


def retry_plan(bad: DataFrame, seeds: DataFrame, done: DataFrame, target: int) -> DataFrame:
    """seed_id, root and task: from the earliest bad or missing stage of each seed on.

    bad and done have (seed_id, task); seeds has (seed_id, seed_index).
    """
    missing = O.first_missing(seeds, done, "seed_id", "task", STAGES, "seed_index", target)
    return O.earliest_root(bad.select("seed_id", "task").unionByName(missing.select("seed_id", "task")), "seed_id", "task", STAGES)


def project_retry(records: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that stay, records that go to the archive) under a retry plan."""
    keys = ["seed_id", "task"]
    return records.join(plan.select(*keys), keys, "left_anti"), records.join(plan.select(*keys), keys, "left_semi")


def freeze_snapshot(gold: DataFrame, group: str, ident: str, per_group: int, seed: int) -> tuple[DataFrame, str]:
    """(rows, digest): the per_group rows of each group by hash order; too small a group,
    or an id in two groups, raises before anything is written."""
    small = gold.groupBy(group).count().where(F.col("count") < per_group).count()
    if small:
        raise ValueError(f"{small} groups have fewer than {per_group} rows")
    chosen = O.hash_ordered_top(gold, group, ident, per_group, seed)
    if not chosen.groupBy(ident).count().where("count > 1").isEmpty():
        raise ValueError("an id is in two groups")
    digests = A.ordered_digest(chosen.withColumn("_i", F.col(ident).cast("string")), [group], "rank", "_i").collect()  # one row a group
    text, digest = jsonl.manifest({"per_group": per_group, "seed": seed, "groups": {str(r[group]): r.digest for r in digests}})
    del text
    return chosen, digest


def report(records: DataFrame, supplied: DataFrame | None = None, by: str = "baseline") -> tuple[DataFrame, DataFrame | None]:
    """(metrics, differences from the supplied ones), both as (arm, metric, value)."""
    metrics = A.benchmark_metrics(records, by)
    names = [c for c, kind in metrics.dtypes if kind in ("double", "bigint", "int")]
    long = metrics.select(F.col(by).alias("arm"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("arm", "x.*")
    return long, None if supplied is None else J.numeric_difference(supplied, long, ["arm", "metric"], "value")


def readiness(checks: dict[str, Column], facts: DataFrame) -> list[str]:
    """Codes of the checks that fail on one row of facts, in order."""
    row = facts.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]).first()
    return [n for n in checks if not row[n]]
