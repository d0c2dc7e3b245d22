"""Outputs of the stages, and the turns that they are asked with."""

import json

from pyspark.sql import functions as F
from sievework.functions import stages as S


def test_output_violation(spark):
    step = {"id": "1", "goal": "g", "deliverable": "d"}
    plan = {"summary": "s", "steps": [step], "constraints": ["c"]}
    policy = {"decision": "BLOCK", "rationale": "r", "proposal_labels": []}
    review = {"language": "tsx", "summary": "s", "code": "c"}
    security = {"decision": "PASS", "rationale": "r", "findings": ["f"]}
    without = lambda o, k: {x: y for x, y in o.items() if x != k}
    cases = [("plan", plan, None), ("plan", without(plan, "constraints"), None), ("tool_policy", policy, None), ("tool_policy", without(policy, "proposal_labels"), None), ("frontend", without(review, "summary"), None), ("review", review, None), ("security", security, None), ("security", without(security, "findings"), None),
             ("plan", [plan], "not_an_object"), ("plan", '{"summary": ', "not_an_object"), ("plan", None, "not_an_object"), ("plan", '{"summary": "a", "summary": "b"}', "not_an_object"), ("plan", plan | {"x": 1}, "unknown_key"), ("frontend", review, "unknown_key"), ("other", plan, "unknown_stage"), (None, plan, "unknown_stage"),
             ("plan", {}, "summary"), ("plan", plan | {"summary": " "}, "summary"), ("plan", plan | {"summary": 5}, "summary"), ("plan", plan | {"summary": ["s"]}, "summary"), ("plan", plan | {"steps": []}, "steps"), ("plan", plan | {"steps": {"a": 1}}, "steps"), ("plan", without(plan, "steps"), "steps"), ("plan", plan | {"steps": ["x"]}, "step_fields"),
             ("plan", plan | {"steps": [step, without(step, "goal")]}, "step_fields"), ("plan", plan | {"steps": [step | {"id": 1}]}, "step_fields"), ("plan", plan | {"steps": [step | {"deliverable": " "}]}, "step_fields"), ("plan", plan | {"steps": [step, None]}, "step_fields"), ("plan", plan | {"constraints": None}, "constraints"),
             ("plan", plan | {"constraints": "c"}, "constraints"), ("plan", plan | {"constraints": ["c", 1]}, "constraints"), ("plan", plan | {"constraints": ["c", " "]}, "constraints"), ("plan", plan | {"steps": [step | {"x": 1}]}, "step_keys"), ("tool_policy", policy | {"decision": "PASS"}, "decision"), ("tool_policy", policy | {"decision": ["BLOCK"]}, "decision"), ("tool_policy", policy | {"rationale": ""}, "rationale"),
             ("tool_policy", policy | {"proposal_labels": [None]}, "labels"), ("frontend", {"language": "TSX", "code": "c"}, "language"), ("frontend", {"language": "tsx"}, "code"), ("review", review | {"code": ""}, "code"), ("review", without(review, "summary"), "summary"), ("security", security | {"decision": "block"}, "decision"),
             ("security", without(security, "rationale"), "rationale"), ("security", security | {"findings": {}}, "findings")]
    rows = [(i, stage, o if o is None or isinstance(o, str) else json.dumps(o)) for i, (stage, o, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, stage string, raw string").withColumn("got", S.output_violation(F.col("stage"), F.col("raw"))).collect()
    for r in got:
        assert r.got == cases[r.i][2], cases[r.i]


def test_stage_prompt(spark):
    rows = [("plan", "q", None, None, None, None, None, None), ("tool_policy", "q", "{}", "[]", None, None, None, None), ("frontend", "q", "{}", None, "p", None, None, "{r}"), ("review", "q", None, None, None, " c\n", "d ", None), ("security", "q", None, None, None, "c", None, None),
            ("frontend", "q", "{}", None, " ", None, None, None), ("review", "q", None, None, None, "\n", None, None), ("review", "q", None, None, None, "c", "\t", None), ("plan", " ", None, None, None, None, None, None), ("x", "q", None, None, None, None, None, None), (None, "q", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "stage string, request string, plan string, proposals string, policy string, code string, defect string, retry string")
    turn, lacking = S.stage_prompt(F.col("stage"), F.col("request"), {k: F.col(k) for k in ("plan", "proposals", "policy", "code", "defect")}, F.col("retry"))
    assert [tuple(r) for r in df.select(turn.alias("t"), lacking.alias("l")).collect()] == [
        ("q", None), ("REQUIREMENT:\nq\n\nPLAN:\n{}\n\nINERT TOOL PROPOSALS:\n[]", None), ("REQUIREMENT:\nq\n\nAPPROVED IMPLEMENTATION PLAN:\n{}\n\nTOOL POLICY ADVISORY (not an execution grant):\np\n\nQUALITY RETRY METADATA:\n{r}", None),
        ("REQUIREMENT:\nq\n\nCANDIDATE CODE:\nc\n\nKNOWN_BENIGN_DEFECT:\nd", None), ("REQUIREMENT:\nq\n\nREVIEWED CODE:\nc", None), (None, "policy"), (None, "code"), (None, "defect"), (None, "request"), (None, "stage"), (None, "stage")]
