"""Lineage: five records of a seed that hold, and each way in which one link does not."""

import hashlib

import pytest
from pyspark.sql import functions as F
from sievework.functions.safety import redacted
from sievework.operators import lineage as L
from sievework.operators import partition as P
from sievework.plans.partition import partition_records

SCHEMA = ("id string, stage string, line int, seed string, card string, tags array<string>, alignment string, plan_id string, tool_policy_id string, frontend_id string, review_id string, "
          "requirement string, plan string, policy string, code string, output string")
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
FIXED = "<main>x</main>\n\n/* [INERT_SECURITY_BOUNDARY:REACT_ESCAPED_TEXT] descriptor-only; never execute */"


def chain(seed, line=0, **changes):
    """Records of a seed; changes are stage__field=value."""
    alignment = "alignment_" + hashlib.sha256(f"{seed}\ncard".encode()).hexdigest()[:20]
    rows = {stage: dict.fromkeys(FIELDS) | {"id": f"{stage}-{seed}-{line}", "stage": stage, "line": line, "seed": seed, "card": "card", "tags": ["t"], "alignment": alignment, "requirement": "r"} for stage in ("plan", "tool_policy", "frontend", "review", "security")}
    ident = {stage: row["id"] for stage, row in rows.items()}
    rows["plan"] |= {"output": "P"}
    rows["tool_policy"] |= {"plan_id": ident["plan"], "plan": "P", "output": "Q"}
    rows["frontend"] |= {"plan_id": ident["plan"], "tool_policy_id": ident["tool_policy"], "plan": "P", "policy": "Q", "output": "<main>x</main>"}
    rows["review"] |= {"frontend_id": ident["frontend"], "code": " <div>x</div>\n", "output": "<main>x</main>"}
    rows["security"] |= {"review_id": ident["review"], "code": FIXED + "\n", "output": "PASS"}
    for key, value in changes.items():
        stage, field = key.split("__")
        rows[stage][field] = value
    return [tuple(row[f] for f in FIELDS) for row in rows.values()]


def codes(spark, rows):
    return {(r.edge, r.downstream_id): (r.code, r.contract) for r in L.edges(spark.createDataFrame(rows, SCHEMA)).collect() if r.code}


def test_edges_and_chains(spark):
    bad = {
        "a": ({"tool_policy__plan_id": " "}, {("plan->tool_policy", "tool_policy"): ("missing_source_record_id", None)}),
        "b": ({"review__frontend_id": "none"}, {("frontend->review", "review"): ("source_not_strict_gold", None)}),
        "c": ({"security__seed": None}, {("review->security", "security"): ("missing_seed_id", None)}),
        "d": ({"security__seed": "z"}, {("review->security", "security"): ("seed_id_mismatch", None)}),
        "e": ({"security__tags": ["u"]}, {("review->security", "security"): ("alignment_id_mismatch", None)}),
        "f": ({"security__alignment": None}, {("review->security", "security"): ("alignment_id_mismatch", None)}),
        "g": ({"security__requirement": "x"}, {("review->security", "security"): ("canonical_input_mismatch", "requirement")}),
        "h": ({"security__code": "<main>x</main>"}, {("review->security", "security"): ("canonical_input_mismatch", "fixture")}),
        "i": ({"security__code": None}, {("review->security", "security"): ("canonical_input_mismatch", "fixture")}),
        "j": ({"review__code": "<main>x</main>"}, {("frontend->review", "review"): ("canonical_input_mismatch", "candidate")}),
        "k": ({"review__output": "y", "security__code": FIXED.replace("<main>x</main>", "y")}, {("frontend->review", "review"): ("canonical_input_mismatch", "repair")}),
        "l": ({"frontend__output": "<p>"}, {("frontend->review", "review"): ("canonical_input_mismatch", "mutation_unavailable")}),
        "m": ({"frontend__policy": "y"}, {("tool_policy->frontend", "frontend"): ("canonical_input_mismatch", "tool_policy")}),
        "n": ({"frontend__plan": None}, {("plan->frontend", "frontend"): ("canonical_input_mismatch", "plan")}),
    }
    rows, want = chain("ok") + chain("ok", 1), {}
    for seed, (changes, told) in bad.items():
        rows += chain(seed, **changes)
        want |= {(edge, f"{stage}-{seed}-0"): code for (edge, stage), code in told.items()}
    none = chain("none")
    rows += [(*r[:FIELDS.index("alignment")], None, *r[FIELDS.index("alignment") + 1:]) for r in none]  # no row has an alignment: none is asked for
    fork = chain("fork", frontend__plan_id="plan-fork-1") + [r for r in chain("fork", 1) if r[1] == "plan"]
    assert codes(spark, rows + fork) == want
    resolved = L.edges(spark.createDataFrame(rows + fork, SCHEMA))
    got = L.chains(resolved)
    assert {(r.security_id, r.code) for r in got.collect()} == {("security-ok-0", None), ("security-ok-1", "duplicate_complete_chain_seed"), ("security-none-0", None), ("security-fork-0", "planner_reference_fork")}
    summary = {(r.kind, r.name, r.code): r["rows"] for r in L.lineage_summary(resolved, got).collect()}
    assert summary["chain", "complete", "ok"] == 2 and summary["edge", "frontend->review", "canonical_input_mismatch"] == 3
    assert L.chains(L.edges(spark.createDataFrame([], SCHEMA))).count() == 0


def test_requirement_without_payloads(spark):
    payload = "make <script>alert(1)</script> safe"
    rows = chain("s", **{f"{stage}__requirement": payload for stage in ("plan", "tool_policy", "frontend", "review", "security")})
    assert codes(spark, rows) == {("review->security", "security-s-0"): ("canonical_input_mismatch", "requirement")}
    sane = spark.range(1).select(redacted(F.lit(payload))[0]).first()[0]
    assert codes(spark, [(*r[:11], sane, *r[12:]) if r[1] == "security" else r for r in rows]) == {}


def test_partition_records(spark):
    long = "<main>one two three four five six seven eight nine ten</main>"
    near = long.replace("one two", "zero one two")
    sources = [("a", long), ("b", near), ("c", "<main>other</main>"), ("d", "<main>other</main>")]
    rows = []
    for i, (seed, code) in enumerate(sources):
        rows += chain(seed, i, frontend__output=code, review__code=code.replace("main", "div"), review__output=code, security__code=FIXED.replace("<main>x</main>", code))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.when(F.col("stage") == "frontend", F.col("output")).otherwise(F.concat("stage", F.lit(" "), "seed")))
    hard, soft = P.label_array(d=(F.col("seed") == "d") & (F.col("stage") == "plan")), P.label_array()
    quotas = spark.createDataFrame([("frontend", 3), ("plan", 3)], "stage string, want long")
    content = F.when(F.col("stage") == "frontend", F.col("output")).otherwise(F.col("id"))
    out, manifest = partition_records(df, hard, soft, content, quotas, ["seed"], 1, near=("line", "text"))
    got = {r.id: (r.disposition, r.labels) for r in out.where("disposition <> 'gold'").collect()}
    assert got == {"plan-d-3": ("reject", ["d"]), "frontend-d-3": ("negative", ["duplicate_content"]), "frontend-b-1": ("negative", ["near_duplicate"])}
    m = {(r.section, r.name): r["rows"] for r in manifest.collect()}
    assert m["raw", "records"] == 20 and m["disposition", "frontend:gold"] == 2 and m["disposition", "frontend:negative"] == 2 and m["shortfall", "frontend"] == 1 and ("shortfall", "plan") not in m
    assert m["lineage", "chain:complete:ok"] == 3 and m["lineage_after", "chain:complete:ok"] == 2 and m["lineage", "edge:frontend->review:source_not_strict_gold"] == 1 and m["lineage_after", "edge:frontend->review:source_not_strict_gold"] == 2
    assert m["lineage", "edge:plan->tool_policy:source_not_strict_gold"] == 1 and m["uncovered", "seed"] >= 1
    with pytest.raises(ValueError):
        partition_records(df.withColumn("id", F.lit(None).cast("string")), hard, soft, content, quotas, ["seed"], 1)
