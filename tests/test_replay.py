"""Replayed links, label oracles and outcomes read from event streams."""

import hashlib
import json

from pyspark.sql import functions as F
from sievework.operators import replay as R


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_artifact_failures(spark):
    main, aria, plain = "<main id='m'>x</main >", " <main><b aria-label='Go'>x</b></main>\r\n", "<p>"
    front = [("f1", 1, "s", main), ("f2", 1, "s", aria), ("f3", 1, "s", plain), ("f4", 1, None, " \n"), ("f5", 1, "s", "old"), ("f5", 2, "s", "<h1>x</h1>"), (None, 1, "s", main), ("f6", 1, "s", "<main>open<h1>x</h1>"), ("f7", 1, "s", None)]
    mutation = lambda rule, before, after: (rule, sha(before), sha(after))
    div, bare = "<div id='m'>x</div>", " <main><b>x</b></main>\r\n"
    m1, m2, m5 = mutation("semantic_main_to_div", main, div), mutation("remove_literal_aria_label", aria, bare), mutation("semantic_h1_to_div", "<h1>x</h1>", "<div>x</div>")
    h6 = "<main>open<div>x</div>"
    review = [
        ("ok1", "s", "f1", None, div, m1, main + "\n"), ("ok2", "s", "f2", None, bare.replace("\r\n", "\n").strip(), m2, aria.replace("\r\n", "\r")), ("ok3", "s", "f5", None, "<div>x</div>", m5, "<h1>x</h1>"),
        ("asked", "s", "f2", "semantic_main_to_div", " <div><b aria-label='Go'>x</b></div>", mutation("semantic_main_to_div", aria, " <div><b aria-label='Go'>x</b></div>\r\n"), aria),
        ("ok6", "s", "f6", "semantic_h1_to_div", h6, mutation("semantic_h1_to_div", "<main>open<h1>x</h1>", h6), "<main>open<h1>x</h1>"),
        ("r1", "s", None, None, div, m1, main), ("r2", "s", " ", None, div, m1, None), ("r3", "s", "none", None, div, m1, " "), ("r4", "t", "f1", None, div, m1, main), ("r5", None, "f4", None, div, m1, main),
        ("r6", "s", "f1", None, None, m1, main), ("r7", "s", "f3", None, plain, None, plain), ("r8", "s", "f6", None, h6, None, "x"), ("r9", "s", "f1", "made_up", div, m1, main),
        ("r10", "s", "f1", None, main, m1, main), ("r11", "s", "f1", None, div, (*m1[:2], "x"), main), ("r12", "t", "f1", None, div, None, div), ("r13", "s", "f1", None, div, m1, None), ("r14", "s", "f7", None, div, m1, main)]
    frontends = spark.createDataFrame(front, "id string, line int, seed string, code string")
    reviews = spark.createDataFrame(review, "id string, seed string, source string, rule string, candidate string, mutation struct<rule:string,before:string,after:string>, code string")
    rows = R.artifact_failures(frontends, reviews)
    got = {(r.stage, r.id): r.codes for r in rows.collect()}
    assert got == {
        ("frontend", "f4"): ["missing_artifact"], ("frontend", "f7"): ["missing_artifact"], ("review", "r1"): ["missing_provenance"], ("review", "r2"): ["missing_provenance", "missing_artifact"], ("review", "r3"): ["source_missing", "missing_artifact"],
        ("review", "r4"): ["source_seed_mismatch"], ("review", "r5"): ["source_or_candidate_invalid"], ("review", "r6"): ["source_or_candidate_invalid"], ("review", "r7"): ["mutation_unavailable"],
        ("review", "r8"): ["mutation_unavailable"], ("review", "r9"): ["mutation_unavailable"], ("review", "r10"): ["candidate_not_canonical"], ("review", "r11"): ["candidate_not_canonical"],
        ("review", "r12"): ["source_seed_mismatch", "candidate_not_canonical", "source_not_restored"], ("review", "r13"): ["source_not_restored", "missing_artifact"], ("review", "r14"): ["source_or_candidate_invalid"]}
    assert {(r.stage, r.code): (r["rows"], r.alone) for r in R.failure_counts(rows).collect()}["review", "missing_artifact"] == (3, 0)
    assert R.artifact_failures(frontends.limit(0), reviews.limit(0)).count() == 0


def test_label_oracles(spark):
    from sievework.functions import oracles as O

    read, write = ("workspace.read_text", "workspace-root", "none"), ("workspace.write_derived_file", "workspace-generated-output", "reversible")
    R0, W0, BAD = "INERT_READ_ONLY_WORKSPACE", "INERT_BOUNDED_REVERSIBLE_WRITE", "INERT_PROHIBITED_OR_UNKNOWN_CAPABILITY"

    def digest(proposals):
        return sha(json.dumps([dict(zip(("capability", "resource_scope", "side_effect"), p)) for p in proposals], sort_keys=True, ensure_ascii=False, separators=(",", ":")))

    both = [read, write]
    m = ("g", False, 2, digest(both))
    odd = [("ö", "x", "y")]
    cases = [(both, "ESCALATE", [R0, W0], "ESCALATE", m, None), (odd, "BLOCK", [BAD], "BLOCK", ("g", False, 1, digest(odd)), None), (None, "APPROVE", [], "APPROVE", m, "proposals_missing"), ([], "APPROVE", [], "APPROVE", m, "proposals_missing"),
             ([read, (None, "x", "y")], "BLOCK", [R0, BAD], "BLOCK", m, "proposals_not_canonical"), ([None], "BLOCK", [BAD], "BLOCK", m, "proposals_not_canonical"), (both, "APPROVE", [R0, W0], "ESCALATE", m, "output_differs"), (both, "ESCALATE", [W0, R0], "ESCALATE", m, "output_differs"),
             (both, None, None, "ESCALATE", m, "output_differs"), (both, "ESCALATE", [R0, W0], None, m, "oracle_differs"), (both, "ESCALATE", [R0, W0], "ESCALATE", None, "manifest_missing"), (both, "ESCALATE", [R0, W0], "ESCALATE", ("h", False, 2, m[3]), "manifest_differs"),
             (both, "ESCALATE", [R0, W0], "ESCALATE", ("g", True, 2, m[3]), "manifest_differs"), (both, "ESCALATE", [R0, W0], "ESCALATE", ("g", False, 1, m[3]), "manifest_differs"), (both, "ESCALATE", [R0, W0], "ESCALATE", ("g", False, 2, None), "manifest_differs")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p array<struct<capability:string,resource_scope:string,side_effect:string>>, d string, l array<string>, o string, m struct<generator:string,executed:boolean,count:int,sha256:string>, want string")
    for r in df.withColumn("got", O.policy_row_error(F.col("p"), F.col("d"), F.col("l"), F.col("o"), F.col("m"), "g")).collect():
        assert r.got == r.want, r

    code = "x\n\n/* [INERT_SECURITY_BOUNDARY:REACT_ESCAPED_TEXT] descriptor-only; never execute */"
    cases = [(code, "PASS", sha(code), ("PASS", sha(code)), None), (None, "PASS", None, None, "code_missing"), (" ", "PASS", None, None, "code_missing"), (code + ".", "PASS", sha(code), ("PASS", sha(code)), "fixture_not_canonical"), (code, "BLOCK", sha(code), ("PASS", sha(code)), "output_differs"),
             (code, None, sha(code), ("PASS", sha(code)), "output_differs"), (code, "PASS", "x", ("PASS", sha(code)), "fixture_differs"), (code, "PASS", sha(code), ("BLOCK", sha(code)), "oracle_differs"), (code, "PASS", sha(code), None, "oracle_differs")]
    df = spark.createDataFrame(cases, "c string, d string, f string, o struct<decision:string,sha256:string>, want string")
    for r in df.withColumn("got", O.security_row_error(F.col("c"), F.col("d"), F.col("f"), F.col("o"))).collect():
        assert r.got == r.want, r

    said, old = ("deterministic_oracle", True, False, "deterministic_oracle"), [(O.OLD_CHECK, O.OLD_EVIDENCE, O.OLD_ACTION.format("PASS"))]
    none = (None, None, None, None)
    cases = [(True, " [PASS]\n".strip("\n"), "PASS", "PASS", said, None, True), (False, "PASS", "PASS", "PASS", said, None, True), (True, "PASS", "PASS", "PASS", said, None, False), (True, "[PASS]", "PASS", "BLOCK", said, None, False), (True, "[PASS]", "PASS", None, said, old, False),
             (True, "[PASS]", "PASS", "PASS", none, old, True), (True, "[PASS]", "PASS", "PASS", None, old, True), (True, "[PASS]", "PASS", "PASS", none, old * 2, False), (True, "[PASS]", "PASS", "PASS", none, None, False), (True, "[BLOCK]", "BLOCK", "BLOCK", none, old, False),
             (True, "[PASS]", "PASS", "PASS", ("teacher", True, False, "deterministic_oracle"), old, False), (True, "[PASS]", "PASS", "PASS", (*said[:2], None, said[3]), old, False), (True, None, "PASS", "PASS", said, old, False)]
    df = spark.createDataFrame(cases, "b boolean, t string, d string, o string, s struct<source:string,normalized:boolean,agrees:boolean,trace_source:string>, h array<struct<check:string,evidence:string,action:string>>, want boolean")
    for r in df.withColumn("got", O.disagreement_safe(F.col("b"), F.col("t"), F.col("d"), F.col("o"), F.col("s"), F.col("h"))).collect():
        assert r.got == r.want, r


def test_public_outcome(spark):
    from sievework.functions import outcomes as O

    step = {"check": " c ", "evidence": "e", "action": "a"}
    good = {"schema_version": "v1", "status": "completed", "decision_trace": [step], "repair_summaries": ["r "], "final_summary": " done "}
    event = lambda o, **more: json.dumps({"type": "text", "part": {"type": "text", "text": o if isinstance(o, str) else json.dumps(o)}, **more})
    want = ("completed", 1, ["r"], "done")
    bad = [{**good, "schema_version": "v2"}, {**good, "CoT": 1}, {**good, "status": "done"}, {**good, "decision_trace": []}, {**good, "decision_trace": [step] * 9}, {**good, "decision_trace": [{**step, "action": " "}]},
           {**good, "decision_trace": [{"check": "c", "evidence": "e"}]}, {**good, "decision_trace": [step, 5]}, {**good, "decision_trace": [{**step, "check": "x" * 601}]}, {**good, "decision_trace": {"a": 1}}, {**good, "repair_summaries": None}, {**good, "repair_summaries": ["a"] * 9},
           {**good, "repair_summaries": [""]}, {**good, "repair_summaries": ["x" * 601]}, {**good, "final_summary": 5}, {**good, "final_summary": " "}, {**good, "final_summary": "x" * 1001}, {k: v for k, v in good.items() if k != "final_summary"}, "[1]", "plain", '{"torn": '] + [{k: v for k, v in good.items() if k != name} for name in good]
    other = {**good, "status": "partial", "decision_trace": [step, {**step, "check": 5}], "repair_summaries": []}
    streams = [(event(good), want), (event("```json\n" + json.dumps(good) + "\n```"), want), (event(good, type="TEXT"), want), (json.dumps({"type": "text", "part": {"text": json.dumps(good)}}), want),
               (json.dumps({"type": "tool", "part": {"type": "text", "text": json.dumps(good)}}), None), (json.dumps({"type": "text", "part": {"type": "reasoning", "text": json.dumps(good)}}), None), (json.dumps({"type": "text", "part": {"type": "text", "text": good}}), None),
               (json.dumps({"type": "text", "text": json.dumps(good)}), None), ("\n".join([event(good), "noise {", event(other), event(bad[0]), event(good)[:-9]]), ("partial", 2, [], "done")), ("\r\n".join([event(other), event(good)]), want), ("", None), (None, None), ("[]\n5", None)]
    streams += [(event(b), None) for b in bad]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(streams)], "i int, s string").withColumn("o", O.public_outcome(F.col("s"), "v1"))
    for r in df.collect():
        got = r.o and (r.o.status, len(r.o.steps), r.o.repairs, r.o.summary)
        assert got == streams[r.i][1], streams[r.i]


def test_execution_summary(spark):
    from sievework.functions import outcomes as O

    a, b = ("a", "PASS", 0), ("b", "PASS", 1)
    cases = [("completed", [a], (1, 1, 0, 0, None)), ("completed", [a, b], (2, 1, 1, 1, None)), ("partial", [a], (1, 1, 0, 1, None)), ("completed", [], (0, 0, 0, 0, None)), ("completed", [("a", "FAIL", 0)], (1, 0, 1, 1, None)), ("completed", [("a", None, 0)], (1, 0, 1, 1, None)),
             ("x", [a], (*[None] * 4, "status")), (None, [a], (*[None] * 4, "status")), ("completed", None, (*[None] * 4, "checks")), ("completed", [a, (" a", "PASS", 0)], (*[None] * 4, "check_repeated")), ("completed", [(" ", "PASS", 0)], (*[None] * 4, "check_name")),
             ("completed", [(None, "PASS", 0)], (*[None] * 4, "check_name")), ("completed", [("a", "PASS", None)], (*[None] * 4, "check_exit_code"))]
    df = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(cases)], "i int, s string, c array<struct<name:string,status:string,exit_code:int>>").withColumn("o", O.execution_summary(F.col("s"), F.col("c")))
    for r in df.collect():
        assert tuple(r.o) == cases[r.i][2], cases[r.i]
