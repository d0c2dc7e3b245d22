"""The public outcome that an agent states in its event stream, and what becomes of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that a public outcome must not have, and its states.
PRIVATE_KEYS = ["thinking", "reasoning", "chain_of_thought", "cot"]
STATES = ["completed", "blocked", "partial"]
# End of fixed values.
MOST_STEPS, MOST_TEXT, MOST_SUMMARY = 8, 600, 1000
_OUTCOME = "struct<status:string,decision_trace:array<struct<check:string,evidence:string,action:string>>,repair_summaries:array<string>,final_summary:string>"


def _kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...> of a variant; null without one."""
    return F.schema_of_variant(value)


def _texts(lines: Column) -> Column:
    """The text of each text event among lines; null for other lines."""
    def text(line: Column) -> Column:
        event = F.try_parse_json(line)
        kind = F.lower(F.try_variant_get(event, "$.type", "string"))
        part = F.coalesce(F.lower(F.try_variant_get(event, "$.part.type", "string")), F.lit(""))
        said = F.try_variant_get(event, "$.part.text", "variant")
        return F.when((kind == "text") & part.isin("", "text") & (_kind(said) == "STRING"), F.try_variant_get(said, "$", "string"))

    return F.transform(lines, text)


def _candidate(text: Column) -> Column:
    """A text that is one JSON object, perhaps fenced as json; else null."""
    bare = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    inner = F.when(bare.startswith("```json") & bare.endswith("```"), F.btrim(F.regexp_extract(bare, r"(?s)^```json(.*)```$", 1), F.lit(" \t\n\r\x0b\x0c"))).otherwise(bare)
    return F.when(inner.startswith("{") & inner.endswith("}"), inner)


def _accepted(text: Column, version: str) -> Column:
    """The outcome that a candidate states, texts trimmed; null if any rule is broken."""
    v = F.try_parse_json(text)
    of = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    keys = F.transform(F.json_object_keys(text), F.lower)
    o = F.from_json(text, _OUTCOME)
    steps = F.transform(o.decision_trace, lambda s: F.struct(F.trim(s.check).alias("check"), F.trim(s.evidence).alias("evidence"), F.trim(s.action).alias("action")))
    repairs = F.transform(o.repair_summaries, lambda r: F.trim(r))
    told = lambda x: F.coalesce(F.char_length(x).between(1, MOST_TEXT), F.lit(False))
    summary = F.trim(o.final_summary)
    fine = ((F.try_variant_get(v, "$.schema_version", "string") == version) & ~F.arrays_overlap(keys, F.array(*map(F.lit, PRIVATE_KEYS))) & o.status.isin(STATES)
            & _kind(of("decision_trace")).startswith("ARRAY") & F.size(steps).between(1, MOST_STEPS) & F.forall(steps, lambda s: told(s.check) & told(s.evidence) & told(s.action))
            & _kind(of("repair_summaries")).startswith("ARRAY") & (F.size(repairs) <= MOST_STEPS) & F.forall(repairs, told)
            & (_kind(of("final_summary")) == "STRING") & F.char_length(summary).between(1, MOST_SUMMARY))
    return F.when(fine, F.struct(o.status.alias("status"), steps.alias("steps"), repairs.alias("repairs"), summary.alias("summary")))


def public_outcome(stream: Column, version: str) -> Column:
    """The last outcome (status, steps, repairs, summary) that a stream of JSON lines states.

    Only text events count, and of these only a text that is one JSON object of the given
    schema_version, without private keys, with one to eight steps whose check, evidence and
    action are told, at most eight repairs and a summary.  Lines that are no JSON, torn or
    too long in a field, are passed over.  Null without any; a null stream has none.
    """
    candidates = F.array_compact(F.transform(_texts(F.split(stream, "\\R")), _candidate))
    return F.try_element_at(F.array_compact(F.transform(candidates, lambda c: _accepted(c, version))), F.lit(-1))


def execution_summary(status: Column, checks: Column) -> Column:
    """checks_run, checks_passed, checks_failed, exit_code and problem of an execution.

    checks is an array of (name, status, exit_code).  A check passes with PASS and exit
    code 0.  exit_code is 0 only for a completed execution of which no check failed.
    problem is set, and all else null, for an unknown status, a check without a name
    or exit code, or a repeated name.
    """
    names = F.transform(checks, lambda c: F.trim(c["name"]))
    problem = (F.when(~F.coalesce(status.isin(STATES), F.lit(False)), "status").when(checks.isNull(), "checks")
               .when(F.exists(checks, lambda c: F.coalesce(F.trim(c["name"]) == "", F.lit(True))), "check_name")
               .when(F.size(F.array_distinct(names)) < F.size(names), "check_repeated").when(F.exists(checks, lambda c: c.exit_code.isNull()), "check_exit_code"))
    passed = F.size(F.filter(checks, lambda c: (c.status == "PASS") & (c.exit_code == 0))).cast("bigint")
    run = F.size(checks).cast("bigint")
    known = lambda x: F.when(problem.isNull(), x)
    return F.struct(known(run).alias("checks_run"), known(passed).alias("checks_passed"), known(run - passed).alias("checks_failed"),
                    known(F.when((run == passed) & (status == "completed"), 0).otherwise(1)).alias("exit_code"), problem.alias("problem"))
