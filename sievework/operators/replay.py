"""Replay of links between stages: what a row was made from is made again and compared.

A review was given code with one known defect, made from a frontend row by a fixed
mutation, and must restore that row's code.  The mutations of each frontend row are
made where it is read; only digests meet the reviews, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mutations

_BLANKS = " \t\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def canonical_code(code: Column) -> Column:
    """Line ends as \\n, no blanks at the ends."""
    return F.btrim(F.replace(F.replace(code, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(_BLANKS))


def _digest(code: Column) -> Column:
    return F.sha2(canonical_code(code), 256)


def _made(frontends: DataFrame) -> DataFrame:
    """_id, _seed, _code and _made (of each rule: opened, digest of the mutated code) of
    each id; of rows with the same id the last by line counts."""
    code = F.when(canonical_code(F.col("code")) != "", F.col("code"))
    made = F.array(*[F.struct(F.lit(name).alias("rule"), opens.alias("opens"), _digest(after).alias("after"), F.sha2(after, 256).alias("exact")) for name, (opens, after, _) in mutations(code).items()])
    one = frontends.where(F.col("id").isNotNull()).select("id", "line", F.struct(F.col("seed").alias("seed"), _digest(code).alias("code"), F.sha2(code, 256).alias("exact"), made.alias("made")).alias("_row"))
    return one.groupBy(F.col("id").alias("_id")).agg(F.max_by("_row", "line").alias("_row")).select("_id", F.col("_row.seed").alias("_seed"), F.col("_row.code").alias("_code"), F.col("_row.exact").alias("_exact"), F.col("_row.made").alias("_made"))


def artifact_failures(frontends: DataFrame, reviews: DataFrame) -> DataFrame:
    """stage, id and codes of every row of the two with something wrong; all codes, in order.

    frontends has (id, line, seed, code).  reviews has (id, seed, source, rule, candidate,
    mutation, code): the frontend row it is made from, the mutation that was asked for
    (null: the first that applies), the code it was given, the stated mutation as a struct
    (rule, before, after: digests of the code before and after) and the code it answers.

    frontend: missing_artifact without code.  review: missing_provenance without a source
    and source_missing if none has that id, both followed only by missing_artifact;
    source_seed_mismatch; source_or_candidate_invalid if either has no code, or else
    mutation_unavailable if none can be made, or else candidate_not_canonical (it or
    the stated mutation is not what is made anew) and source_not_restored (the answer
    is not the source's code); missing_artifact.  Seeds that are both null agree.
    Line ends and blanks at the ends of code do not count.
    """
    blank = lambda c: F.coalesce(canonical_code(F.col(c)) == "", F.lit(True))
    bare = frontends.where(blank("code")).select(F.lit("frontend").alias("stage"), "id", F.array(F.lit("missing_artifact")).alias("codes"))

    slim = reviews.select("id", F.col("seed").alias("_own_seed"), F.when(F.trim(F.col("source").cast("string")) != "", F.col("source")).alias("_source"), F.col("rule").alias("_rule"),
                          F.when(~F.col("candidate").isNull(), _digest(F.col("candidate"))).alias("_candidate"), F.col("mutation").alias("_mutation"),
                          F.when(~blank("code"), _digest(F.col("code"))).alias("_answer"))
    j = slim.join(_made(frontends), F.col("_source") == F.col("_id"), "left")
    found, linked = F.col("_id").isNotNull(), F.col("_source").isNotNull()
    first = F.get(F.filter("_made", lambda m: m.opens), F.lit(0))
    asked = F.get(F.filter("_made", lambda m: m.rule == F.col("_rule")), F.lit(0))
    j = j.withColumn("_new", F.when(F.col("_rule").isNull(), first).otherwise(asked))
    valid = found & F.col("_code").isNotNull() & F.col("_candidate").isNotNull()
    replayed = valid & F.col("_new.after").isNotNull()
    same = ((F.col("_candidate") == F.col("_new.after")) & F.col("_mutation.rule").eqNullSafe(F.col("_new.rule"))
            & F.col("_mutation.before").eqNullSafe(F.col("_exact")) & F.col("_mutation.after").eqNullSafe(F.col("_new.exact")))
    codes = {
        "missing_provenance": ~linked,
        "source_missing": linked & ~found,
        "source_seed_mismatch": found & ~F.col("_seed").eqNullSafe(F.col("_own_seed")),
        "source_or_candidate_invalid": found & ~valid,
        "mutation_unavailable": valid & ~replayed,
        "candidate_not_canonical": replayed & ~same,
        "source_not_restored": replayed & ~F.col("_answer").eqNullSafe(F.col("_code")),
        "missing_artifact": F.col("_answer").isNull(),
    }
    listed = F.array_compact(F.array(*[F.when(wrong, F.lit(code)) for code, wrong in codes.items()]))
    return bare.unionByName(j.select(F.lit("review").alias("stage"), "id", listed.alias("codes")).where(F.size("codes") > 0))


def failure_counts(failures: DataFrame) -> DataFrame:
    """stage, code, rows, alone: how many rows have a code, and how many nothing else."""
    return failures.select("stage", F.explode("codes").alias("code"), (F.size("codes") == 1).alias("_one")).groupBy("stage", "code").agg(F.count("*").alias("rows"), F.count_if("_one").alias("alone"))
