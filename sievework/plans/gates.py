"""Readiness gates: one row a check, one code a blocker, one pass over the data.

Every check compares one aggregate of an expert's rows with a bound.  A snapshot is
written while its aggregates are observed, and stands under its name only if no check
fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.safety import has_active_payload, has_secret

#: code -> (aggregate of an expert's rows, comparison that passes, bound).  Rows have
#: (id, text, label, source); all but the *_low and *_share codes are counts that must be 0.
Check = tuple[Callable[[], Column], str, float]


def _share(part: Column) -> Column:
    return F.when(F.count("*") > 0, part / F.count("*")).otherwise(F.lit(0.0))


def checks(least_rows: int = 20, most_chars: int = 20_000, least_chars: int = 1, labelled: float = 0.3, one_sided: float = 0.98, mean_low: float = 50) -> dict[str, Check]:
    """The checks of an expert's training rows."""

    def zero(when: Callable[[Column], Column], of: str = "text") -> Check:
        return lambda: F.count_if(when(F.col(of))).cast("double"), "<=", 0.0

    def one_side() -> Column:
        label, known = F.col("label"), F.count("label")
        return F.when(known > 0, F.greatest(F.count_if(label == 1), F.count_if(label == 0)) / known).otherwise(F.lit(0.0))

    return {
        "rows_low": (lambda: F.count("*").cast("double"), ">=", float(least_rows)),
        "id_missing": zero(lambda x: x.isNull(), "id"),
        "id_repeated": (lambda: (F.count("id") - F.count_distinct("id")).cast("double"), "<=", 0.0),
        "text_missing": zero(lambda x: x.isNull()),
        "text_short": zero(lambda x: F.length(F.trim(x)) < least_chars),
        "text_long": zero(lambda x: F.length(x) > most_chars),
        "text_repeated": (lambda: (F.count("text") - F.count_distinct(F.sha2("text", 256))).cast("double"), "<=", 0.0),
        "secret_material": zero(has_secret),
        "active_payload": zero(has_active_payload),
        "control_text": zero(lambda x: x.rlike(r"[\x00-\x08]")),
        "source_missing": zero(lambda x: x.isNull(), "source"),
        "label_unknown": zero(lambda x: ~x.isin(0, 1), "label"),
        "labelled_low": (lambda: _share(F.count("label").cast("double")), ">=", labelled),
        "label_one_sided_share": (one_side, "<=", one_sided),
        "mean_chars_low": (lambda: F.coalesce(F.avg(F.length("text")), F.lit(0.0)), ">=", float(mean_low)),
    }


def _passes(value: Column, how: str, bound: float) -> Column:
    return F.coalesce(value >= bound if how == ">=" else value <= bound, F.lit(False))


def gate(rows: DataFrame, experts: list[str], wanted: dict[str, Check] | None = None) -> DataFrame:
    """expert, code, value, bound, passed: each check of each expert; rows have (expert, id, text,
    label, source).  An expert without rows has value null where nothing can be counted
    and fails rows_low; rows of other experts fail expert_unknown, which stands under 'all'."""
    wanted = wanted or checks()
    names = list(wanted)
    made = rows.groupBy("expert").agg(*[wanted[c][0]().alias(c) for c in names])
    every = rows.sparkSession.createDataFrame([(e,) for e in experts], "expert string").join(made, "expert", "left").withColumn("rows_low", F.coalesce("rows_low", F.lit(0.0)))
    stacked = every.select("expert", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("value"), F.lit(wanted[c][2]).alias("bound"), F.when(
        F.col(c).isNotNull(), _passes(F.col(c), wanted[c][1], wanted[c][2])).otherwise(F.lit(True)).alias("passed")) for c in names])).alias("c")).select("expert", "c.*")
    strange = rows.agg(F.count_if(~F.coalesce(F.col("expert").isin(experts), F.lit(False))).cast("double").alias("value")).select(
        F.lit("all").alias("expert"), F.lit("expert_unknown").alias("code"), "value", F.lit(0.0).alias("bound"), (F.col("value") <= 0).alias("passed"))
    return stacked.unionByName(strange)


def verdict(judged: DataFrame) -> DataFrame:
    """One row: ready, checks, and the blockers as sorted code:expert."""
    failed = F.when(~F.col("passed"), F.concat_ws(":", "code", "expert"))
    return judged.agg(F.count("*").alias("checks"), F.array_sort(F.collect_set(failed)).alias("blockers")).select((F.size("blockers") == 0).alias("ready"), "checks", "blockers")


def freeze(rows: DataFrame, path: str, most_blocked: dict[str, tuple[Column, str, float]]) -> list[str]:
    """Write rows to path once, and return the codes that block it; then nothing stands there.

    most_blocked has code -> (aggregate without distinct counts, comparison, bound).  The
    aggregates are observed while the rows are written beside path, so the data is
    read once; the table takes its name only if every check passes.  A path that exists
    is never written again.
    """
    spark = rows.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    final, beside = make(path), make(f"{path}.unchecked")
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(final):
        raise FileExistsError(path)
    seen = Observation()
    rows.observe(seen, *[a.alias(code) for code, (a, _, _) in most_blocked.items()]).write.mode("overwrite").parquet(f"{path}.unchecked")
    values = seen.get
    blocked = sorted(c for c, (_, how, bound) in most_blocked.items() if values[c] is None or not (values[c] >= bound if how == ">=" else values[c] <= bound))
    if blocked:
        system.delete(beside, True)
    elif not system.rename(beside, final):
        raise OSError(f"{path} was written by another")
    return blocked


def fair(specs: DataFrame, same: list[str]) -> DataFrame:
    """field, values, passed: whether the arms of a comparison agree in each field that must
    be the same; a missing value is a value of its own, no arms at all agree in nothing."""
    shown = [F.struct(F.lit(c).alias("field"), F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0missing"))).alias("values")) for c in same]
    return specs.agg(F.array(*shown).alias("f")).select(F.explode("f").alias("f")).select("f.field", "f.values", (F.col("f.values") == 1).alias("passed"))
