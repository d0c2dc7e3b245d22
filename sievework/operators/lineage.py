"""Lineage of stage records: every link resolved, its content made again, chains counted.

A record names the records that it was made from and holds copies of what they gave it.
Where a record is read, digests are made of what it got and of what it must have given;
links are then joins of rows of a few digests, whatever the texts' lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import FIXTURES, mutated
from ..functions.safety import redacted
from ..functions.text import stable_id
from ..sources.scratch import cut

#: Link, upstream stage, downstream stage, the column that names the source.
EDGES = [("plan->tool_policy", "plan", "tool_policy", "plan_id"), ("plan->frontend", "plan", "frontend", "plan_id"), ("tool_policy->frontend", "tool_policy", "frontend", "tool_policy_id"),
         ("frontend->review", "frontend", "review", "frontend_id"), ("review->security", "review", "security", "review_id")]
_SOURCES = ["plan_id", "tool_policy_id", "frontend_id", "review_id"]
_BLANKS = " \t\n\r\x0b\x0c"


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _slim(records: DataFrame) -> DataFrame:
    """Ids, seeds and alignment of each record, and digests of what it got and gave."""
    _, candidate, _ = mutated(F.col("output"))
    fixed = F.array(*[_digest(_stripped(F.concat("output", F.lit(f"\n\n/* {marker} descriptor-only; never execute */")))) for _, marker, _ in FIXTURES])
    sane, _ = redacted(F.col("requirement"))
    stage = F.col("stage")
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    return records.select(
        "id", "stage", "line", blank("seed").alias("seed"), "card", "tags", "alignment", *[blank(c).alias(c) for c in _SOURCES],
        _digest(F.col("requirement")).alias("requirement"), F.when(stage == "review", _digest(sane)).alias("sane"), _digest(F.col("plan")).alias("plan"), _digest(F.col("policy")).alias("policy"), _digest(_stripped(F.col("code"))).alias("code"), _digest(F.col("output")).alias("output"),
        F.when(stage == "frontend", _digest(_stripped(candidate))).alias("candidate"), F.when(stage == "review", fixed).alias("fixed"))


def _contracts(edge: str) -> list[tuple[str, Column]]:
    """What a link's content must fulfil, in order."""
    same = lambda d, u: F.col(f"d.{d}").eqNullSafe(F.col(f"u.{u}"))
    requirement = ("requirement", same("requirement", "requirement"))
    return {
        "plan->tool_policy": [requirement, ("plan", same("plan", "output"))],
        "plan->frontend": [requirement, ("plan", same("plan", "output"))],
        "tool_policy->frontend": [requirement, ("tool_policy", same("policy", "output"))],
        "frontend->review": [("mutation_unavailable", F.col("u.candidate").isNotNull()), requirement, ("candidate", same("code", "candidate")), ("repair", same("output", "output"))],
        "review->security": [("requirement", same("requirement", "sane")), ("fixture", F.coalesce(F.array_contains("u.fixed", F.col("d.code")), F.lit(False)))],
    }[edge]


def _resolved(slim: DataFrame, edge: str, up: str, down: str, source: str) -> DataFrame:
    d, u = slim.where(F.col("stage") == down).alias("d"), slim.where(F.col("stage") == up).alias("u")
    j = d.join(u, F.col(f"d.{source}") == F.col("u.id"), "left")
    expected = F.when(F.col("d.card") != "", stable_id("alignment", F.concat_ws("\n", F.col("d.seed").cast("string"), "d.card")))
    aligned = ((F.col("d.alignment") == F.col("u.alignment")) & (F.col("d.alignment") == expected) & F.col("d.card").eqNullSafe(F.col("u.card")) & F.col("d.tags").isNotNull() & F.col("d.tags").eqNullSafe(F.col("u.tags")))
    contract = reduce(lambda rest, rule: F.when(~rule[1], F.lit(rule[0])).otherwise(rest), reversed(_contracts(edge)), F.lit(None).cast("string"))
    code = (F.when(F.col(f"d.{source}").isNull(), "missing_source_record_id").when(F.col("u.id").isNull(), "source_not_strict_gold").when(F.col("d.seed").isNull() | F.col("u.seed").isNull(), "missing_seed_id")
            .when(F.col("d.seed") != F.col("u.seed"), "seed_id_mismatch").when((F.col("d.alignment").isNotNull() | F.col("u.alignment").isNotNull()) & ~F.coalesce(aligned, F.lit(False)), "alignment_id_mismatch").when(contract.isNotNull(), "canonical_input_mismatch"))
    return j.select(F.lit(edge).alias("edge"), F.col("d.id").alias("downstream_id"), F.col(f"d.{source}").alias("source_id"), code.alias("code"), F.when(code == "canonical_input_mismatch", contract).alias("contract"), F.col("d.seed").alias("seed"), F.col("d.line").alias("line"))


def edges(gold: DataFrame) -> DataFrame:
    """edge, downstream_id, source_id, code, contract, seed, line of each of the five links; code is null where it holds.

    gold has (id, stage, line, seed, card, tags, alignment, plan_id, tool_policy_id,
    frontend_id, review_id, requirement, plan, policy, code, output), ids unique in a stage.
    The first thing wrong: missing_source_record_id, source_not_strict_gold (not among gold),
    missing_seed_id, seed_id_mismatch, alignment_id_mismatch (either has one, and they differ,
    are not the digest of seed and card, or cards or tags differ), canonical_input_mismatch
    with the contract that is broken: the copy of the requirement, plan or tool policy; a
    review's candidate, which must be the mutated code, and its repair; security's code, the
    reviewed code with a fixture, and its requirement without active payloads.
    """
    slim = cut(_slim(gold), "lineage")
    return reduce(DataFrame.unionByName, [_resolved(slim, *e) for e in EDGES])


def chains(resolved: DataFrame) -> DataFrame:
    """security_id, seed and code of each chain whose links all hold: null for the first of a
    seed by line, duplicate_complete_chain_seed for later ones, and planner_reference_fork
    where frontend and tool policy name different plans."""
    held = resolved.where("code IS NULL")

    def link(edge: str, down: str, up: str) -> DataFrame:
        return held.where(F.col("edge") == edge).select(F.col("downstream_id").alias(down), F.col("source_id").alias(up))

    start = held.where("edge = 'review->security'").select(F.col("downstream_id").alias("security_id"), F.col("source_id").alias("review_id"), "seed", "line")
    whole = (start.join(link("frontend->review", "review_id", "frontend_id"), "review_id").join(link("tool_policy->frontend", "frontend_id", "tool_id"), "frontend_id")
             .join(link("plan->frontend", "frontend_id", "plan_id"), "frontend_id").join(link("plan->tool_policy", "tool_id", "tool_plan_id"), "tool_id"))
    fork = F.col("plan_id") != F.col("tool_plan_id")
    nth = F.row_number().over(Window.partitionBy("seed", "_fork").orderBy("line", "security_id"))
    return whole.withColumn("_fork", fork).withColumn("_n", nth).select("security_id", "seed", F.when(F.col("_fork"), "planner_reference_fork").when(F.col("_n") > 1, "duplicate_complete_chain_seed").alias("code"))


def lineage_summary(resolved: DataFrame, complete: DataFrame) -> DataFrame:
    """kind, name, code, rows: links by edge and code, chains by code; ok where nothing is wrong."""
    told = F.coalesce("code", F.lit("ok")).alias("code")
    return resolved.groupBy(F.lit("edge").alias("kind"), F.col("edge").alias("name"), told).agg(F.count("*").alias("rows")).unionByName(
        complete.groupBy(F.lit("chain").alias("kind"), F.lit("complete").alias("name"), told).agg(F.count("*").alias("rows")))
