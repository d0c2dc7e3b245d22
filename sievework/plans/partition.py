"""The whole offline partition of stage records, with its manifest as a table.

Dispositions, exact copies, lineage, near copies, lineage again (a copy that goes may have
been another record's source), complete chains, quotas and coverage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import lineage as L
from ..operators import partition as P
from ..sources.scratch import cut


def _demoted(rows: DataFrame, losers: DataFrame, label: str) -> DataFrame:
    """rows, those of losers (one column of ids) made negative under a label."""
    lost = F.col("_loser").isNotNull()
    j = rows.join(losers.toDF("_loser"), F.col("id") == F.col("_loser"), "left")
    return j.withColumn("labels", F.when(lost, F.array_sort(F.array_union("labels", F.array(F.lit(label))))).otherwise(F.col("labels"))).withColumn(
        "disposition", F.when(lost, F.lit("negative")).otherwise(F.col("disposition"))).drop("_loser")


def _gold(rows: DataFrame) -> DataFrame:
    return rows.where("disposition = 'gold'")


def partition_records(records: DataFrame, hard: Column, soft: Column, content: Column, quotas: DataFrame, axes: list[str], templates: int, near: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with disposition and labels, manifest).

    records is what `lineage.edges` takes, with ids unique over all stages.  Of gold records of a
    stage with equal content the first by line and id stays, the others become negative; with
    near = (index column, text column) so do those that resemble an earlier gold one.
    quotas has (stage, want); axes are columns whose values must be covered.

    manifest is (section, name, rows): raw; disposition by stage; links and chains by
    code before and after near copies go, as lineage and lineage_after; shortfall of gold by
    stage, only where there is one; uncovered values by axis.  Records without an id raise.
    """
    if not records.where("id IS NULL").isEmpty():
        raise ValueError("a record has no id")
    rows = cut(P.disposed(records, hard, soft), "disposed")
    keys = _gold(rows).select("id", "stage", "line", F.sha2(content, 256).alias("_digest"))
    # One small row for each content, however many copies it has.
    first = keys.groupBy("stage", "_digest").agg(F.min(F.struct("line", "id")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    copies = keys.join(first, ["stage", "_digest"]).where(F.col("id") != F.col("_first.id")).select("id")
    rows = cut(_demoted(rows, copies, "duplicate_content"), "copies")
    before = cut(L.edges(_gold(rows)), "links")
    after = before
    if near:
        gold = _gold(rows)
        alike = D.near_representatives(gold, "id", near[0], T.exact_tokens(F.col(near[1]))).where("id <> representative").select("id")
        rows = cut(_demoted(rows, alike, "near_duplicate"), "near")
        after = cut(L.edges(_gold(rows)), "links")
    counts = _gold(rows).groupBy("stage").agg(F.count("*").alias("have"))

    def told(resolved: DataFrame, section: str) -> DataFrame:
        return L.lineage_summary(resolved, L.chains(resolved)).select(F.lit(section).alias("section"), F.concat_ws(":", "kind", "name", "code").alias("name"), "rows")

    parts = [
        rows.agg(F.count("*").alias("rows")).select(F.lit("raw").alias("section"), F.lit("records").alias("name"), "rows"),
        rows.groupBy(F.lit("disposition").alias("section"), F.concat_ws(":", "stage", "disposition").alias("name")).agg(F.count("*").alias("rows")),
        told(before, "lineage"), told(after, "lineage_after"),
        A.shortfalls(counts, quotas, ["stage"], "have", "want").select(F.lit("shortfall").alias("section"), F.col("stage").alias("name"), F.col("shortfall").cast("long").alias("rows")),
        P.axis_coverage(_gold(rows), axes, templates).where("NOT covered").groupBy(F.lit("uncovered").alias("section"), F.col("axis").alias("name")).agg(F.count("*").alias("rows")),
    ]
    return rows, reduce(DataFrame.unionByName, parts)
