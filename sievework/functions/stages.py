"""What each stage may answer, and the user's turn that it is trained with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys and labels of each stage's output, and the headings of its input.
OUTPUT_KEYS = {
    "plan": ["summary", "steps", "constraints"],
    "tool_policy": ["decision", "rationale", "proposal_labels"],
    "frontend": ["language", "code"],
    "review": ["language", "summary", "code"],
    "security": ["decision", "rationale", "findings"],
}
STEP_KEYS = ["id", "goal", "deliverable"]
DECISIONS = {"tool_policy": ["APPROVE", "BLOCK", "ESCALATE"], "security": ["BLOCK", "PASS"]}
LANGUAGE = "tsx"
HEADINGS = {
    "plan": {},
    "tool_policy": {"plan": "PLAN", "proposals": "INERT TOOL PROPOSALS"},
    "frontend": {"plan": "APPROVED IMPLEMENTATION PLAN", "policy": "TOOL POLICY ADVISORY (not an execution grant)"},
    "review": {"code": "CANDIDATE CODE", "defect": "KNOWN_BENIGN_DEFECT"},
    "security": {"code": "REVIEWED CODE"},
}
REQUEST_HEADING, RETRY_HEADING = "REQUIREMENT", "QUALITY RETRY METADATA"
# End of fixed values.


def _is_text(value: Column) -> Column:
    """A variant is a string that is not blank."""
    return F.coalesce((F.schema_of_variant(value) == "STRING") & (F.trim(F.try_variant_get(value, "$", "string")) != ""), F.lit(False))


def _keys(value: Column) -> Column:
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def output_violation(stage: Column, raw: Column) -> Column:
    """The first rule that a stage's JSON output breaks; null if it is as it must be.

    not_an_object (also torn JSON or a repeated key) and unknown_key, then by stage: summary,
    steps, step_fields, constraints and step_keys of a plan; decision, rationale and labels of
    a tool policy; language, code and a review's summary; decision, rationale and findings of
    security; unknown_stage.  Lists that may be left out must be lists of texts if they are
    there; a key that is null is there.
    """
    v = F.try_parse_json(raw)
    of = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    text = lambda name: _is_text(of(name))
    listed = lambda name: F.try_variant_get(v, f"$.{name}", "array<variant>")
    texts = lambda name: of(name).isNull() | F.coalesce(F.schema_of_variant(of(name)).startswith("ARRAY") & F.forall(listed(name), _is_text), F.lit(False))
    one_of = lambda name, values: F.coalesce((F.schema_of_variant(of(name)) == "STRING") & F.try_variant_get(v, f"$.{name}", "string").isin(values), F.lit(False))
    steps = listed("steps")
    whole = lambda s: reduce(lambda x, y: x & y, [_is_text(F.try_variant_get(s, f"$.{k}", "variant")) for k in STEP_KEYS])
    extra = lambda s: F.size(F.array_except(_keys(s), F.array(*map(F.lit, STEP_KEYS)))) > 0
    rules = {
        "plan": {"summary": text("summary"), "steps": F.coalesce(F.schema_of_variant(of("steps")).startswith("ARRAY") & (F.size(steps) > 0), F.lit(False)), "step_fields": F.forall(steps, whole), "constraints": texts("constraints"), "step_keys": ~F.exists(steps, extra)},
        "tool_policy": {"decision": one_of("decision", DECISIONS["tool_policy"]), "rationale": text("rationale"), "labels": texts("proposal_labels")},
        "frontend": {"language": one_of("language", [LANGUAGE]), "code": text("code")},
        "review": {"language": one_of("language", [LANGUAGE]), "code": text("code"), "summary": text("summary")},
        "security": {"decision": one_of("decision", DECISIONS["security"]), "rationale": text("rationale"), "findings": texts("findings")},
    }
    out = F.lit("unknown_stage")
    for name, checks in rules.items():
        unknown = F.size(F.array_except(_keys(v), F.array(*map(F.lit, OUTPUT_KEYS[name])))) > 0
        broken = reduce(lambda rest, rule: F.when(~F.coalesce(rule[1], F.lit(False)), F.lit(rule[0])).otherwise(rest), reversed(checks.items()), F.lit(None).cast("string"))
        out = F.when(stage == name, F.when(unknown, F.lit("unknown_key")).otherwise(broken)).otherwise(out)
    return F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("not_an_object")).otherwise(out)


def stage_prompt(stage: Column, request: Column, inputs: dict[str, Column], retry: Column) -> tuple[Column, Column]:
    """(the user's turn, what lacks): the turn is null where an input that the stage needs is null or blank.

    inputs has plan, proposals and policy (canonical JSON texts), code and defect.  A plan's
    turn is the request itself; the others' name the request and each input under its
    heading.  code and defect lose the blanks at their ends.  retry, if it is not null, is appended.
    """
    trimmed = {k: F.btrim(v, F.lit(" \t\n\r\x0b\x0c")) if k in ("code", "defect") else v for k, v in inputs.items()}
    under = lambda heading, value: F.concat(F.lit(heading + ":\n"), value)
    turn = lacking = F.lit(None).cast("string")
    for name, parts in HEADINGS.items():
        missing = reduce(lambda rest, k: F.when(F.coalesce(F.trim(trimmed[k]) == "", F.lit(True)), F.lit(k)).otherwise(rest), reversed(list(parts)), F.lit(None).cast("string"))
        text = F.concat_ws("\n\n", under(REQUEST_HEADING, request), *[under(h, trimmed[k]) for k, h in parts.items()]) if parts else request
        turn, lacking = F.when(stage == name, text).otherwise(turn), F.when(stage == name, missing).otherwise(lacking)
    lacking = F.when(F.coalesce(F.trim(request) == "", F.lit(True)), F.lit("request")).when(~F.coalesce(stage.isin(list(HEADINGS)), F.lit(False)), F.lit("stage")).otherwise(lacking)
    return F.when(lacking.isNull(), F.concat_ws("\n\n", turn, under(RETRY_HEADING, retry))), lacking
