"""Rules for records as JSON text: the first one that breaks, as a finite code.

All are native columns over parsed variants but the planner's canonical text and
the leaves of nested text, which are one Arrow UDF each.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and vocabularies that results must agree on.
EXPERTS = ("planner", "tool_policy", "frontend_gen", "frontend_review", "security_gate", "code_review", "security_audit")
ROLES = ("system", "user", "assistant")
TOOL_DECISIONS = ("APPROVE", "BLOCK", "ESCALATE")
SECURITY_DECISIONS = ("PASS", "BLOCK")
SOURCE_KINDS = ("self_synthetic", "swe_smith", "swebench_heldout")
FEEDBACK_CODES = ("artifact_build_or_test_failed", "artifact_missing_tsx", "deterministic_oracle_mismatch", "duplicate_prompt", "duplicate_record", "lineage_rebuild_required", "public_rubric_disagreement",
                  "public_safety_contract", "raw_record_missing", "review_mutation_unavailable", "review_repair_not_canonical", "task_card_alignment", "task_card_axis", "upstream_quality_rebuild")
HIDDEN_KEY = "^cot$|chainofthought|^reasoning|^thinking"
FORBIDDEN_KEYS = ("patch", "patches", "testpatch", "hint", "hints", "hintstext", "testname", "testnames", "tests", "testcases", "failtopass", "passtopass", "gold", "goldpatch", "goldsolution", "oracle", "oracletext",
                  "oraclefields", "reasoning", "thinking", "chainofthought", "environment", "env", "apikey", "accesstoken", "refreshtoken", "authorization", "proxyauthorization", "password", "secretkey", "privatekey",
                  "cookie", "systemprompt", "system", "systemmessage", "provider", "model", "modelid", "session", "sessionid", "messageid", "rawcallid")
FORBIDDEN_PREFIXES = ("patch", "test", "hint", "oracle", "gold", "failtopass", "passtopass")
SHELL_META = r"[\r\n;&|<>`$()]"
TOOL_ALIASES = {"write": "edit", "patch": "edit"}
TERMINAL_STATES = {"provider_quota_exhausted": "provider_quota_exhausted", "complete": "automation_complete", "cooldown": "temporary_rate_limit", "client_deadline": "client_deadline", "budget_exhausted": "local_safety_budget",
                   "failed": "failed", "gate_blocked": "data_gate_blocked", "running": "nonterminal", "ready": "nonterminal"}
QUOTA_PHRASES = ("usage limit", "quota will be refreshed", "quota exhausted", "budget exhausted")
MOCK_MODELS = ("mock", "mock-teacher", "fixture")
HELDOUT_OWNERS = ("swe-bench", "princeton-nlp")
HELDOUT_VARIANTS = {"swe_bench": "full", "swe_bench_full": "full", "swe_bench_lite": "lite", "swe_bench_verified": "verified"}
MOST_USAGE = 1_000_000_000_000
# End of fixed values.


def first_code(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that breaks (unknown counts as kept); null if none does."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _text(value: Column, path: str) -> Column:
    """The string at path; null if it is absent or no string."""
    return F.when(_is(F.try_variant_get(value, path, "variant"), "STRING"), F.try_variant_get(value, path, "string"))


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def _none_of(text: Column, names: tuple[str, ...]) -> Column:
    return ~F.coalesce(text.isin(*names), F.lit(False))


@F.pandas_udf(T.StringType())
def spaced_json(raw: pd.Series) -> pd.Series:
    """JSON text with sorted keys and a blank after each comma and colon."""
    return raw.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True))


def record_violation(raw: Column) -> Column:
    """The first rule that a training record breaks: schema, messages, provenance,
    trace, output, and a last message equal to the target that output gives."""
    v = F.try_parse_json(raw)
    expert, messages, trace, output = _text(v, "$.expert"), F.try_variant_get(v, "$.messages", "array<variant>"), F.try_variant_get(v, "$.decision_trace", "array<variant>"), F.try_variant_get(v, "$.output", "variant")
    roles = F.transform(messages, lambda m: _text(m, "$.role"))
    message = lambda m: first_code(("message_object", ~_is(m, "OBJECT")), ("message_role", _none_of(_text(m, "$.role"), ROLES)), ("message_content", _blank(_text(m, "$.content"))))
    step = lambda s: first_code(("trace_step", ~_is(s, "OBJECT")), *[(f"trace_{f}", _blank(_text(s, f"$.{f}"))) for f in ("check", "evidence", "action")])
    first_of = lambda items, rule: F.get(F.array_compact(F.transform(items, rule)), F.lit(0))
    last = _text(F.element_at(messages, -1), "$.content")
    decision, code = _text(output, "$.decision"), _text(output, "$.code")
    steps = F.try_variant_get(output, "$.steps", "array<variant>")
    shown = F.array_compact(F.array(*[F.when(F.contains(last, F.lit(f"[{d}]")), F.lit(d)) for d in SECURITY_DECISIONS]))
    coded = expert.isin("frontend_gen", "frontend_review", "code_review")
    security = expert.isin("security_gate", "security_audit")
    target = (F.when(expert == "planner", spaced_json(F.when(expert == "planner", F.to_json(output)))).when(expert == "tool_policy", decision)
              .when(coded, F.btrim(code, F.lit(" \t\n\r\x0b\f"))).otherwise(F.concat(F.lit("["), decision, F.lit("]"))))
    early = first_code(
        ("not_an_object", ~_is(v, "OBJECT")), ("schema_version", _none_of(_text(v, "$.schema_version"), ("1.0",))), ("id", _blank(_text(v, "$.id"))), ("expert", _none_of(expert, EXPERTS)),
        ("messages", F.coalesce(F.size(messages) < 2, F.lit(True))))
    turns = F.coalesce(first_of(messages, message), first_code(("no_user_turn", ~F.array_contains(roles, "user")), ("last_turn", F.element_at(roles, -1) != "assistant")))
    late = F.coalesce(
        first_code(("provenance", ~_is(F.try_variant_get(v, "$.provenance", "variant"), "OBJECT")), ("provenance_source", _blank(_text(v, "$.provenance.generator")) & _blank(_text(v, "$.provenance.teacher.model"))),
                   ("decision_trace", F.coalesce(F.size(trace) < 1, F.lit(True)))),
        first_of(trace, step),
        first_code(
            ("output", ~_is(output, "OBJECT")), ("planner_summary", (expert == "planner") & _blank(_text(output, "$.summary"))), ("planner_steps", (expert == "planner") & F.coalesce(F.size(steps) < 1, F.lit(True))),
            ("tool_decision", (expert == "tool_policy") & _none_of(decision, TOOL_DECISIONS)), ("tool_rationale", (expert == "tool_policy") & _blank(_text(output, "$.rationale"))),
            ("code", coded & _blank(code)), ("security_label", security & (F.size(shown) != 1)), ("security_decision", security & ~F.coalesce(F.get(shown, F.lit(0)) == decision, F.lit(False))),
            ("security_rationale", security & _blank(_text(output, "$.rationale"))), ("target", ~F.coalesce(last == target, F.lit(False)))))
    return F.coalesce(early, turns, late)


def keys_at_any_depth(raw: Column) -> Column:
    """Keys of a JSON text, lower case letters and digits only; null if it is no JSON.

    Rewritten by the parser first, so that an escaped letter is a letter; what is
    still escaped then (quotes, line feeds) is left out.
    """
    plain = F.regexp_replace(F.to_json(F.try_parse_json(raw)), r"(?s)\\.", "")
    keys = F.filter(F.regexp_extract_all(plain, F.lit(r'"[^"]*"\s*:?'), F.lit(0)), lambda t: t.endswith(":"))
    return F.transform(keys, lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", ""))


def hidden_reasoning(raw: Column) -> Column:
    """Whether a key, at any depth, names hidden reasoning."""
    return F.exists(keys_at_any_depth(raw), lambda k: k.rlike(HIDDEN_KEY))


def forbidden_material(raw: Column) -> Column:
    """Whether a key, at any depth, names an oracle, a credential or the environment."""
    return F.exists(keys_at_any_depth(raw), lambda k: k.isin(*FORBIDDEN_KEYS) | k.rlike(f"^(?:{'|'.join(FORBIDDEN_PREFIXES)})"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])))
def text_leaves(raw: pd.Series) -> pd.Series:
    """Every string of a JSON text that is not blank, with its path ($.a[0].b, keys in lower case); null if it is no JSON."""

    def one(text):
        try:
            todo, out = [("$", json.loads(text))], []
        except (TypeError, ValueError):
            return None
        while todo:
            path, value = todo.pop()
            if isinstance(value, str) and value.strip():
                out.append({"path": path, "text": value})
            elif isinstance(value, dict):
                todo += [(f"{path}.{k.casefold()}", x) for k, x in value.items()]
            elif isinstance(value, list):
                todo += [(f"{path}[{i}]", x) for i, x in enumerate(value)]
        return out

    return raw.map(one)


def seed_violation(raw: Column) -> Column:
    """The first rule that a seed breaks: fields that must stand together, kinds and digests."""
    v = F.try_parse_json(raw)
    text = lambda name: F.trim(F.try_variant_get(v, f"$.{name}", "string"))
    card, template, kind, digest = text("card_id"), text("template_id"), text("source_kind"), F.lower(text("source_digest"))
    raw_index = F.try_variant_get(v, "$.seed_index", "variant")
    # A JSON null is an absent value.
    index = F.when(raw_index.isNotNull() & ~F.coalesce(F.is_variant_null(raw_index), F.lit(True)), raw_index)
    number = F.when(_is(index, "BIGINT"), F.try_variant_get(v, "$.seed_index", "bigint"))
    return first_code(
        ("empty_request", _blank(text("request"))), ("empty_card", card == ""), ("seed_index", index.isNotNull() & F.coalesce(number < 0, F.lit(True))), ("card_without_index", card.isNull() != index.isNull()),
        ("empty_template", template == ""), ("empty_source_kind", kind == ""), ("template_without_kind", template.isNull() != kind.isNull()), ("template_without_card", template.isNotNull() & card.isNull()),
        ("source_kind", template.isNotNull() & _none_of(kind, SOURCE_KINDS)), ("synthetic_digest", template.isNotNull() & (kind == "self_synthetic") & digest.isNotNull()),
        ("external_digest", template.isNotNull() & (kind != "self_synthetic") & ~F.coalesce(digest.rlike("^[0-9a-f]{64}$"), F.lit(False))), ("legacy_digest", template.isNull() & digest.isNotNull()))


def retry_violation(generation: Column, retry_of: Column, codes: Column) -> Column:
    """The first rule that retry metadata breaks."""
    return first_code(
        ("generation", F.coalesce(generation < 1, F.lit(True))), ("retry_of", retry_of.isNull() | F.exists(retry_of, lambda x: x.isNull() | ~x.startswith("record_") | (F.length(x) > 96))),
        ("no_codes", F.coalesce(F.size(codes) < 1, F.lit(True))), ("unknown_code", F.size(F.array_except(codes, F.array(*map(F.lit, FEEDBACK_CODES)))) > 0))


def retry_codes(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(codes))


def is_live(model: Column, base_url: Column) -> Column:
    """Whether a record comes from a real teacher and not from a stand-in."""
    name, url = F.lower(F.trim(F.coalesce(model, F.lit("")))), F.lower(F.trim(F.coalesce(base_url, F.lit(""))))
    return (name != "") & ~name.isin(*MOCK_MODELS) & ~url.startswith("mock:")


def heldout_variant(dataset_id: Column) -> Column:
    """The benchmark that an owner/name is held out for; null if it is none."""
    ident = F.lower(dataset_id)
    name = F.replace(F.substring_index(ident, "/", -1), F.lit("-"), F.lit("_"))
    known = F.create_map(*[F.lit(x) for pair in HELDOUT_VARIANTS.items() for x in pair])
    return F.when(F.substring_index(ident, "/", 1).isin(*HELDOUT_OWNERS), F.try_element_at(known, name))


def trains(dataset_id: Column) -> Column:
    """Whether an owner/name may be trained on, as far as its name tells."""
    ident = F.lower(dataset_id)
    owner, name = F.substring_index(ident, "/", 1), F.substring_index(ident, "/", -1)
    return owner.isin(*HELDOUT_OWNERS) & (((owner == "swe-bench") & name.rlike("^swe-smith(?:-|$)")) | (F.replace(name, F.lit("-"), F.lit("_")) == "swe_bench"))


def canonical_command(command: Column) -> Column:
    """White space runs to one blank; empty if it holds shell syntax."""
    plain = F.trim(F.regexp_replace(command, r"\s+", " "))
    return F.when(plain.rlike(SHELL_META), F.lit("")).otherwise(plain)


def tool_allowed(tool: Column, tools: list[str]) -> Column:
    name = F.lower(tool)
    aliases = F.create_map(*[F.lit(x) for pair in TOOL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, name), name).isin(*tools)


def command_allowed(command: Column, commands: list[str]) -> Column:
    plain = canonical_command(command)
    return (plain != "") & plain.isin(*commands)


def workspace_path_ok(path: Column) -> Column:
    """Whether a path lies below the workspace and is written canonically."""
    below = F.regexp_replace(path, "^<workspace>/", "")
    parts = F.split(below, "/")
    return path.startswith("<workspace>/") & ~F.contains(path, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def terminal_state(state: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TERMINAL_STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, state), F.lit("unknown"))


def quota_exhausted(error: Column) -> Column:
    return F.lower(error).rlike("|".join(QUOTA_PHRASES))


def usage_count(raw: Column, name: str) -> Column:
    """A usage counter: a whole number from 0 to MOST_USAGE, no boolean; null otherwise."""
    v = F.try_parse_json(raw)
    n = F.when(_is(F.try_variant_get(v, f"$.{name}", "variant"), "BIGINT"), F.try_variant_get(v, f"$.{name}", "bigint"))
    return F.when(n.between(0, MOST_USAGE), n)


def chargeable(errors: Column) -> Column:
    """How many errors are no cascade of another."""
    return F.size(F.filter(errors, lambda e: ~F.contains(e, F.lit("UpstreamDependencyError"))))


def first_appearances(items: Column) -> Column:
    """Distinct items in the order in which they first appear."""
    return F.array_distinct(items)


def card_ids(requirement: Column, kind: Column, digest: Column, seed_id: Column) -> tuple[Column, Column]:
    """(card id, alignment id): content-bound for synthetic cards, digest-bound for others."""
    from .text import nfkc_casefold, stable_id

    own = F.when(kind == "self_synthetic", F.concat(F.lit("self_synthetic\n"), nfkc_casefold(requirement))).otherwise(F.concat(kind, F.lit("\n"), digest))
    card = stable_id("card", own)
    return card, stable_id("alignment", F.concat(seed_id, F.lit("\n"), card))


def record_id(expert: Column, sop_sha256: Column, user: Column) -> Column:
    """Identity of a training record: expert, procedure and the user's text with plain line ends."""
    from .text import newlined, stable_id

    return stable_id("record", F.concat_ws("\n", expert, sop_sha256, newlined(user)))
