"""Record, seed and gate rules over JSON texts made for every row of a table: each
row takes one of a list of samples, so every rule breaks somewhere, and carries the
row's own id and text digest."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..functions import records as R
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import validation as V
from .common import listed, literal, pick, registry

QUERIES, query = registry()


def _record(expert: str, result, content: str, **changes) -> str:
    made = {"schema_version": "1.0", "id": "@id", "expert": expert, "messages": [{"role": "user", "content": "@sha"}, {"role": "assistant", "content": content}],
            "provenance": {"generator": "g", "teacher": {"model": "m"}}, "decision_trace": [{"check": "c", "evidence": "e", "action": "a"}], "output": result}
    made.update(changes)
    return json.dumps({k: v for k, v in made.items() if v is not ...})


_PLAN = {"steps": ["one", "two"], "summary": "a plan"}
_GOOD = [_record("planner", _PLAN, json.dumps(_PLAN)), _record("tool_policy", {"decision": "BLOCK", "rationale": "r"}, "BLOCK"), _record("frontend_gen", {"code": " <b/> "}, "<b/>"),
         _record("security_gate", {"decision": "PASS", "rationale": "r"}, "[PASS]")]
_STEP = {"check": "c", "evidence": "e", "action": "a"}
_USER, _SAID = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
RECORD_SAMPLES = [
    *_GOOD, "[1, 2]", "{broken", _record("planner", _PLAN, "x", schema_version="2"), _record("planner", _PLAN, "x", id="  "), _record("planner", _PLAN, "x", id=7), _record("poet", {}, "x"),
    _record("planner", _PLAN, "x", messages=[_USER]), _record("planner", _PLAN, "x", messages=[_USER, 5]), _record("planner", _PLAN, "x", messages=[_USER, {"role": "bot", "content": "x"}]),
    _record("planner", _PLAN, "x", messages=[{"role": "user", "content": " "}, _SAID]), _record("planner", _PLAN, "x", messages=[_SAID, _SAID]), _record("planner", _PLAN, "x", messages=[_SAID, _USER]),
    _record("planner", _PLAN, "x", provenance=3), _record("planner", _PLAN, "x", provenance={"teacher": {"model": ""}}), _record("planner", _PLAN, json.dumps(_PLAN), provenance={"teacher": {"model": "m"}}),
    _record("planner", _PLAN, "x", decision_trace=[]), _record("planner", _PLAN, "x", decision_trace=["a"]), _record("planner", _PLAN, "x", decision_trace=[_STEP, _STEP | {"evidence": ""}]),
    _record("planner", "text", "x"), _record("planner", {"steps": [1]}, "x"), _record("planner", {"summary": "s", "steps": []}, "x"), _record("planner", _PLAN, "another plan"),
    _record("tool_policy", {"decision": "MAYBE", "rationale": "r"}, "MAYBE"), _record("tool_policy", {"decision": "BLOCK"}, "BLOCK"), _record("frontend_review", {"code": " "}, "x"), _record("code_review", {"code": "a"}, " a"),
    _record("security_gate", {"decision": "PASS", "rationale": "r"}, "[PASS] [BLOCK]"), _record("security_gate", {"decision": "BLOCK", "rationale": "r"}, "[PASS]"), _record("security_audit", {"decision": "PASS"}, "[PASS]"),
    _record("security_audit", {"decision": "PASS", "rationale": "r"}, "so [PASS]"), _record("planner", _PLAN, "x", output=...),
]
_RAW = f"replace(replace({listed(RECORD_SAMPLES, 'doc_id')}, '@id', 'record_' || doc_id // 2), '@sha', sha256(text))"


def _raw(t):
    text = F.replace(F.replace(pick(RECORD_SAMPLES, "doc_id"), F.lit("@id"), F.concat(F.lit("record_"), F.expr("CAST(doc_id div 2 AS STRING)"))), F.lit("@sha"), F.sha2("text", 256))
    return t.documents.select("doc_id", text.alias("raw"))


def _names(names) -> str:
    return "(" + ", ".join(map(literal, names)) + ")"


_S = lambda path, of="j": f"CASE WHEN json_type({of}, '{path}') = 'VARCHAR' THEN json_extract_string({of}, '{path}') END"
_B = lambda x: f"NOT coalesce(regexp_matches({x}, '\\S'), false)"
_FIRST = lambda items, rule: f"list_filter(list_transform({items}, lambda m: {rule}), lambda c: c IS NOT NULL)[1]"
_RECORD_SQL = f"""WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents), v AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r),
f AS (SELECT doc_id, j, {_S('$.expert')} AS expert, CASE WHEN json_type(j, '$.messages') = 'ARRAY' THEN from_json(json_extract(j, '$.messages'), '["JSON"]') END AS messages,
 CASE WHEN json_type(j, '$.decision_trace') = 'ARRAY' THEN from_json(json_extract(j, '$.decision_trace'), '["JSON"]') END AS trace, json_extract(j, '$.output') AS output FROM v),
g AS (SELECT *, list_transform(messages, lambda m: {_S('$.role', 'm')}) AS roles, {_S('$.content', 'messages[-1]')} AS said, {_S('$.decision', 'output')} AS decision, {_S('$.code', 'output')} AS code FROM f),
h AS (SELECT *, list_filter(['PASS', 'BLOCK'], lambda d: contains(said, '[' || d || ']')) AS shown, CASE WHEN expert = 'planner' THEN replace(replace(output::VARCHAR, '":', '": '), ',"', ', "') WHEN expert = 'tool_policy' THEN decision
 WHEN expert IN ('frontend_gen', 'frontend_review', 'code_review') THEN trim(code) ELSE '[' || decision || ']' END AS target FROM g)
SELECT doc_id, CASE WHEN json_type(j) IS DISTINCT FROM 'OBJECT' THEN 'not_an_object' WHEN {_S('$.schema_version')} IS DISTINCT FROM '1.0' THEN 'schema_version' WHEN {_B(_S('$.id'))} THEN 'id'
 WHEN coalesce(expert, '') NOT IN {_names(R.EXPERTS)} THEN 'expert' WHEN coalesce(len(messages) < 2, true) THEN 'messages'
 WHEN {_FIRST('messages', f"CASE WHEN json_type(m) <> 'OBJECT' THEN 'message_object' WHEN coalesce({_S('$.role', 'm')}, '') NOT IN {_names(R.ROLES)} THEN 'message_role' WHEN {_B(_S('$.content', 'm'))} THEN 'message_content' END")} IS NOT NULL
 THEN {_FIRST('messages', f"CASE WHEN json_type(m) <> 'OBJECT' THEN 'message_object' WHEN coalesce({_S('$.role', 'm')}, '') NOT IN {_names(R.ROLES)} THEN 'message_role' WHEN {_B(_S('$.content', 'm'))} THEN 'message_content' END")}
 WHEN NOT list_contains(roles, 'user') THEN 'no_user_turn' WHEN roles[-1] <> 'assistant' THEN 'last_turn' WHEN json_type(j, '$.provenance') IS DISTINCT FROM 'OBJECT' THEN 'provenance'
 WHEN {_B(_S('$.provenance.generator'))} AND {_B(_S('$.provenance.teacher.model'))} THEN 'provenance_source' WHEN coalesce(len(trace) < 1, true) THEN 'decision_trace'
 WHEN list_bool_or(list_transform(trace, lambda m: json_type(m) <> 'OBJECT')) THEN 'trace_step'
 WHEN list_bool_or(list_transform(trace, lambda m: {_B(_S('$.evidence', 'm'))})) THEN 'trace_evidence' WHEN json_type(output) IS DISTINCT FROM 'OBJECT' THEN 'output'
 WHEN expert = 'planner' AND {_B(_S('$.summary', 'output'))} THEN 'planner_summary' WHEN expert = 'planner' AND coalesce(json_array_length(output, '$.steps') < 1, true) THEN 'planner_steps'
 WHEN expert = 'tool_policy' AND coalesce(decision, '') NOT IN {_names(R.TOOL_DECISIONS)} THEN 'tool_decision' WHEN expert = 'tool_policy' AND {_B(_S('$.rationale', 'output'))} THEN 'tool_rationale'
 WHEN expert IN ('frontend_gen', 'frontend_review', 'code_review') AND {_B('code')} THEN 'code' WHEN expert LIKE 'security%' AND len(shown) <> 1 THEN 'security_label'
 WHEN expert LIKE 'security%' AND shown[1] IS DISTINCT FROM decision THEN 'security_decision' WHEN expert LIKE 'security%' AND {_B(_S('$.rationale', 'output'))} THEN 'security_rationale'
 WHEN said IS DISTINCT FROM target THEN 'target' END AS violation FROM h"""


@query(_RECORD_SQL)
def q_record_violation(t):
    return _raw(t).select("doc_id", R.record_violation(F.col("raw")).alias("violation"))


@query(f"""WITH c AS ({_RECORD_SQL}), k AS (SELECT doc_id, json_extract_string({_RAW}, '$.expert') AS expert, 'record_' || doc_id // 2 AS id FROM documents WHERE json_valid({_RAW})),
n AS (SELECT c.doc_id, k.expert, c.violation, row_number() OVER (PARTITION BY c.violation IS NULL, k.id ORDER BY c.doc_id) AS n FROM c LEFT JOIN k USING (doc_id))
SELECT expert, count(*)::BIGINT AS valid FROM n WHERE violation IS NULL AND n = 1 GROUP BY expert""")
def q_validation_counts(t):
    lines = _raw(t).select(F.lit("documents").alias("path"), F.col("doc_id").alias("line"), "raw")
    return V.validation_report(lines)[0].select("expert", "valid")


@query(f"""WITH c AS ({_RECORD_SQL}), n AS (SELECT doc_id, violation, row_number() OVER (PARTITION BY violation IS NULL, 'record_' || doc_id // 2 ORDER BY doc_id) AS n FROM c)
SELECT doc_id AS line, coalesce(violation, 'duplicate_id') AS code FROM n WHERE violation IS NOT NULL OR n > 1 ORDER BY doc_id LIMIT 20""")
def q_validation_errors(t):
    lines = _raw(t).select(F.lit("documents").alias("path"), F.col("doc_id").alias("line"), "raw")
    return V.validation_report(lines)[1].select("line", "code")


KEY_SAMPLES = ['{"a": {"CoT": 1}}', '{"a": [{"chain_of_thought": "x"}]}', '{"notes": "\\"reasoning\\": no"}', '{"Reasoning-Content": 1}', '{"x": {"Thinking": []}}', '{"rethinking": 1, "a": "cot:"}', '{"decision_trace": [1], "b": "@sha"}', '{"gold_patch": 1}',
               '{"a": [[{"API-Key": 2}]]}', '{"tested": 1}', '{"contest": "test", "b": "\\n\\"env\\":"}', '{"Env": {}}', "not json"]
_KEYS = "list_transform(list_filter(regexp_extract_all(regexp_replace(raw, '\\\\.', '', 'g'), '\"[^\"]*\"\\s*:?'), lambda x: ends_with(x, ':')), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g'))"


@query(f"""WITH r AS (SELECT doc_id, replace({listed(KEY_SAMPLES, 'doc_id')}, '@sha', sha256(text)) AS raw FROM documents), k AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN {_KEYS} END AS k FROM r)
SELECT doc_id, list_bool_or(list_transform(k, lambda x: regexp_matches(x, {literal(R.HIDDEN_KEY)}))) AS hidden, list_bool_or(list_transform(k, lambda x: x IN {_names(R.FORBIDDEN_KEYS)} OR regexp_matches(x, '^(?:{'|'.join(R.FORBIDDEN_PREFIXES)})'))) AS forbidden FROM k""")
def q_forbidden_keys(t):
    raw = t.documents.select("doc_id", F.replace(pick(KEY_SAMPLES, "doc_id"), F.lit("@sha"), F.sha2("text", 256)).alias("raw"))
    return raw.select("doc_id", R.hidden_reasoning(F.col("raw")).alias("hidden"), R.forbidden_material(F.col("raw")).alias("forbidden"))


@query(f"""WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents), v AS (SELECT doc_id, raw FROM r WHERE json_valid(raw))
SELECT v.doc_id, e.fullkey AS path, sha256(e.atom->>'$') AS text_sha256 FROM v, json_tree(v.raw::JSON) e WHERE e.type = 'VARCHAR' AND trim(e.atom->>'$') <> ''""")
def q_text_leaves(t):
    leaves = _raw(t).select("doc_id", F.explode(R.text_leaves(F.col("raw"))).alias("x"))
    return leaves.select("doc_id", F.col("x.path").alias("path"), F.sha2("x.text", 256).alias("text_sha256"))


_D = "ab" * 32
SEED_SAMPLES = ['{"request": "@sha"}', '{"request": " "}', '{"request": "r", "card_id": ""}', '{"request": "r", "card_id": "c"}', '{"request": "r", "card_id": "c", "seed_index": 3}', '{"request": "r", "card_id": "c", "seed_index": -1}',
                '{"request": "r", "card_id": "c", "seed_index": true}', '{"request": "r", "seed_index": 0}', '{"request": "r", "template_id": " "}', '{"request": "r", "source_kind": " "}', '{"request": "r", "template_id": "t"}',
                '{"request": "r", "template_id": "t", "source_kind": "swe_smith"}', '{"request": "r", "template_id": "t", "source_kind": "x", "card_id": "c", "seed_index": 1}',
                f'{{"request": "r", "template_id": "t", "source_kind": "self_synthetic", "card_id": "c", "seed_index": 1, "source_digest": "{_D}"}}', '{"request": "r", "template_id": "t", "source_kind": "self_synthetic", "card_id": "c", "seed_index": 1}',
                f'{{"request": "r", "template_id": "t", "source_kind": "swe_smith", "card_id": "c", "seed_index": 1, "source_digest": " {_D.upper()} "}}', '{"request": "r", "template_id": "t", "source_kind": "swe_smith", "card_id": "c", "seed_index": 1}',
                f'{{"request": "r", "source_digest": "{_D}"}}', '{"request": "r", "card_id": null, "seed_index": null}']


@query(f"""WITH r AS (SELECT doc_id, replace({listed(SEED_SAMPLES, 'doc_id')}, '@sha', sha256(text))::JSON AS j FROM documents),
f AS (SELECT doc_id, trim(json_extract_string(j, '$.request')) AS request, trim(json_extract_string(j, '$.card_id')) AS card, trim(json_extract_string(j, '$.template_id')) AS template, trim(json_extract_string(j, '$.source_kind')) AS kind,
 lower(trim(json_extract_string(j, '$.source_digest'))) AS digest, nullif(json_type(j, '$.seed_index'), 'NULL') AS itype, TRY_CAST(json_extract_string(j, '$.seed_index') AS BIGINT) AS i FROM r)
SELECT doc_id, CASE WHEN request = '' THEN 'empty_request' WHEN card = '' THEN 'empty_card' WHEN itype IS NOT NULL AND (itype NOT IN ('UBIGINT', 'BIGINT') OR i < 0) THEN 'seed_index' WHEN (card IS NULL) <> (itype IS NULL) THEN 'card_without_index'
 WHEN template = '' THEN 'empty_template' WHEN kind = '' THEN 'empty_source_kind' WHEN (template IS NULL) <> (kind IS NULL) THEN 'template_without_kind' WHEN template IS NOT NULL AND card IS NULL THEN 'template_without_card'
 WHEN template IS NOT NULL AND kind NOT IN {_names(R.SOURCE_KINDS)} THEN 'source_kind' WHEN template IS NOT NULL AND kind = 'self_synthetic' AND digest IS NOT NULL THEN 'synthetic_digest'
 WHEN template IS NOT NULL AND kind <> 'self_synthetic' AND NOT coalesce(regexp_full_match(digest, '[0-9a-f]{{64}}'), false) THEN 'external_digest' WHEN template IS NULL AND digest IS NOT NULL THEN 'legacy_digest' END AS violation FROM f""")
def q_seed_violation(t):
    raw = F.replace(pick(SEED_SAMPLES, "doc_id"), F.lit("@sha"), F.sha2("text", 256))
    return t.documents.select("doc_id", R.seed_violation(raw).alias("violation"))


@query(f"""WITH r AS (SELECT event_id, (event_id % 4)::BIGINT AS generation, CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['record_' || user_id] ELSE ['seed_' || user_id] END AS retry_of,
 CASE event_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['duplicate_record', event_type] ELSE ['task_card_axis', 'duplicate_prompt', 'task_card_axis'] END AS codes FROM events)
SELECT event_id, CASE WHEN generation < 1 THEN 'generation' WHEN len(list_filter(retry_of, lambda x: NOT starts_with(x, 'record_'))) > 0 THEN 'retry_of' WHEN len(codes) = 0 THEN 'no_codes' WHEN len(list_filter(codes, lambda c: c NOT IN {_names(R.FEEDBACK_CODES)})) > 0 THEN 'unknown_code' END AS violation,
 list_sort(list_distinct(codes)) AS codes FROM r""")
def q_retry_metadata(t):
    e = F.col("event_id")
    retry = F.when(e % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.when(e % 3 == 1, "record_").otherwise("seed_"), F.col("user_id").cast("string"))))
    codes = F.when(e % 5 == 0, F.array().cast("array<string>")).when(e % 5 == 1, F.array(F.lit("duplicate_record"), F.col("event_type"))).otherwise(F.array(*map(F.lit, ["task_card_axis", "duplicate_prompt", "task_card_axis"])))
    return t.events.select("event_id", R.retry_violation(e % 4, retry, codes).alias("violation"), R.retry_codes(codes).alias("codes"))


@query(r"""WITH r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'PASS' ELSE 'REVISE' END AS verdict, CASE event_id % 5 WHEN 0 THEN [] WHEN 1 THEN [upper(event_type)] WHEN 2 THEN [event_type] WHEN 3 THEN list_transform(range(event_id % 20), lambda i: 'CODE_' || i) ELSE ['A' || user_id] END AS issues FROM events)
SELECT event_id, (verdict = 'PASS' AND len(issues) = 0) OR (verdict = 'REVISE' AND len(issues) BETWEEN 1 AND 16 AND len(list_filter(issues, lambda c: NOT regexp_full_match(c, '[A-Z][A-Z0-9_]{2,63}'))) = 0) AS ok FROM r""")
def q_review_verdict(t):
    e = F.col("event_id")
    many = F.transform(F.slice(F.sequence(F.lit(0), F.lit(19)), F.lit(1), (e % 20).cast("int")), lambda i: F.concat(F.lit("CODE_"), i.cast("string")))
    issues = F.when(e % 5 == 0, F.array().cast("array<string>")).when(e % 5 == 1, F.array(F.upper("event_type"))).when(e % 5 == 2, F.array("event_type")).when(e % 5 == 3, many).otherwise(F.array(F.concat(F.lit("A"), F.col("user_id").cast("string"))))
    return t.events.select("event_id", L.verdict_ok(F.when(e % 2 == 0, "PASS").otherwise("REVISE"), issues).alias("ok"))


@query(r"""SELECT event_id, [' Mock', 'gpt', '', 'fixture ', 'Teacher'][(event_id % 5 + 1)::INT] NOT IN ('') AND lower(trim([' Mock', 'gpt', '', 'fixture ', 'Teacher'][(event_id % 5 + 1)::INT])) NOT IN ('', 'mock', 'mock-teacher', 'fixture')
 AND NOT starts_with(lower(trim(['http://x', ' MOCK://y'][(event_id % 2 + 1)::INT])), 'mock:') AS live FROM events""")
def q_live_provenance(t):
    return t.events.select("event_id", R.is_live(pick([" Mock", "gpt", "", "fixture ", "Teacher"], "event_id"), pick(["http://x", " MOCK://y"], "event_id")).alias("live"))


DATASETS = ["SWE-bench/SWE-bench", "princeton-nlp/SWE-bench_Lite", "swe-bench/swe-bench-verified", "SWE-bench/SWE-smith", "swe-bench/SWE-smith-py", "princeton-nlp/SWE-smith", "other/SWE-bench", "SWE-bench/SWE-bench_full", "swe-bench/swe-smithy"]


@query(f"""WITH d AS (SELECT event_id, lower({listed(DATASETS, 'event_id')}) AS d FROM events), p AS (SELECT event_id, split_part(d, '/', 1) AS o, split_part(d, '/', 2) AS n, replace(split_part(d, '/', 2), '-', '_') AS u FROM d)
SELECT event_id, CASE WHEN o IN ('swe-bench', 'princeton-nlp') THEN CASE u WHEN 'swe_bench' THEN 'full' WHEN 'swe_bench_full' THEN 'full' WHEN 'swe_bench_lite' THEN 'lite' WHEN 'swe_bench_verified' THEN 'verified' END END AS heldout,
 o IN ('swe-bench', 'princeton-nlp') AND ((o = 'swe-bench' AND (n = 'swe-smith' OR starts_with(n, 'swe-smith-'))) OR u = 'swe_bench') AS trains FROM p""")
def q_dataset_class(t):
    ident = pick(DATASETS, "event_id")
    return t.events.select("event_id", R.heldout_variant(ident).alias("heldout"), R.trains(ident).alias("trains"))


COMMANDS = ["npm  run build", "npm run test", "npm run lint; rm x", " npm run\tlint ", "npm run $x", "", "npm run other"]
TOOLS = ["Write", "edit", "PATCH", "read", "bash"]


@query(f"""WITH c AS (SELECT event_id, trim(regexp_replace({listed(COMMANDS, 'event_id')}, '\\s+', ' ', 'g')) AS c, lower({listed(TOOLS, 'event_id')}) AS tool FROM events), m AS (SELECT *, CASE WHEN regexp_matches(c, {literal(R.SHELL_META)}) THEN '' ELSE c END AS n FROM c)
SELECT event_id, n AS command, n IN ('npm run build', 'npm run test', 'npm run lint') AS command_ok, CASE tool WHEN 'write' THEN 'edit' WHEN 'patch' THEN 'edit' ELSE tool END IN ('edit', 'read') AS tool_ok FROM m""")
def q_allowlists(t):
    c = pick(COMMANDS, "event_id")
    return t.events.select("event_id", R.canonical_command(c).alias("command"), R.command_allowed(c, ["npm run build", "npm run test", "npm run lint"]).alias("command_ok"), R.tool_allowed(pick(TOOLS, "event_id"), ["edit", "read"]).alias("tool_ok"))


PATHS = ["<workspace>/src/a.ts", "<workspace>/../x", "<workspace>/a//b", "/etc/passwd", "<workspace>/a\\b", "<workspace>/./a", "<workspace>/", "<workspace>/a/..b"]


@query(f"""WITH p AS (SELECT event_id, {listed(PATHS, 'event_id')} AS p FROM events) SELECT event_id, starts_with(p, '<workspace>/') AND NOT contains(p, chr(92)) AND NOT list_has_any(string_split(substr(p, 13), '/'), ['', '.', '..']) AS ok FROM p""")
def q_workspace_path(t):
    return t.events.select("event_id", R.workspace_path_ok(pick(PATHS, "event_id")).alias("ok"))


STATES = [*R.TERMINAL_STATES, "idle"]
QUOTAS = ["You hit your Usage Limit", "HTTP 429", "quota will be refreshed at 5", "Quota exhausted", "budget  exhausted", "session budget exhausted"]


@query(f"""SELECT event_id, CASE {listed(STATES, 'event_id')} {' '.join(f'WHEN {literal(k)} THEN {literal(v)}' for k, v in R.TERMINAL_STATES.items())} ELSE 'unknown' END AS terminal,
 regexp_matches(lower({listed(QUOTAS, 'event_id')}), 'usage limit|quota will be refreshed|quota exhausted|budget exhausted') AS quota FROM events""")
def q_terminal_state(t):
    return t.events.select("event_id", R.terminal_state(pick(STATES, "event_id")).alias("terminal"), R.quota_exhausted(pick(QUOTAS, "event_id")).alias("quota"))


USAGES = ['{"input_tokens": 12}', '{"input_tokens": true}', '{"input_tokens": -1}', '{"input_tokens": 1000000000000}', '{"input_tokens": 1000000000001}', '{"input_tokens": "5"}', "{}", '{"input_tokens": 1.5}']


@query(f"""WITH u AS (SELECT event_id, {listed(USAGES, 'event_id')}::JSON AS j FROM events) SELECT event_id, CASE WHEN json_type(j, '$.input_tokens') IN ('UBIGINT', 'BIGINT') AND (j->>'$.input_tokens')::BIGINT BETWEEN 0 AND 1000000000000 THEN (j->>'$.input_tokens')::BIGINT END AS input_tokens FROM u""")
def q_usage_count(t):
    return t.events.select("event_id", R.usage_count(pick(USAGES, "event_id"), "input_tokens").alias("input_tokens"))


@query(r"""SELECT user_id, count_if(event_type <> 'error')::BIGINT AS chargeable, list_distinct(list(event_type ORDER BY event_id)) IS NOT NULL AS some, count(DISTINCT event_type)::BIGINT AS kinds FROM events GROUP BY user_id""")
def q_chargeable(t):
    errors = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e.event_type).alias("e"))
    named = F.transform("e", lambda x: F.when(x == "error", "plan:1:UpstreamDependencyError:x").otherwise(x))
    return errors.select("user_id", R.chargeable(named).cast("long").alias("chargeable"), F.lit(True).alias("some"), F.size(R.first_appearances(F.col("e"))).cast("long").alias("kinds"))


@query(r"""WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) SELECT conv_id, list(role ORDER BY first_turn) AS stages FROM f GROUP BY conv_id""")
def q_stage_order(t):
    turns = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("r"))
    return turns.select("conv_id", R.first_appearances(F.col("r")).alias("stages"))


@query(r"""WITH i AS (SELECT doc_id, sha256('planner' || chr(10) || sha256(lang) || chr(10) || trim(replace(text, chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(13))) AS r, 'card_' || substr(sha256(CASE WHEN doc_id % 2 = 0 THEN 'self_synthetic' || chr(10) || lower(source) ELSE 'swe_smith' || chr(10) || sha256(text) END), 1, 20) AS card FROM documents)
SELECT doc_id, 'record_' || substr(r, 1, 20) AS record, card, 'alignment_' || substr(sha256('seed' || doc_id || chr(10) || card), 1, 20) AS alignment FROM i""")
def q_card_ids(t):
    kind = F.when(F.col("doc_id") % 2 == 0, "self_synthetic").otherwise("swe_smith")
    card, alignment = R.card_ids(F.col("source"), kind, F.sha2("text", 256), F.concat(F.lit("seed"), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", R.record_id(F.lit("planner"), F.sha2("lang", 256), F.col("text")).alias("record"), card.alias("card"), alignment.alias("alignment"))


@query(r"""SELECT source, count(*)::BIGINT AS n, min(doc_id) AS first_index, max(doc_id) AS last_index FROM documents GROUP BY source""")
def q_template_counts(t):
    return V.index_ranges(t.documents, "source", "doc_id")


@query(r"""SELECT list(DISTINCT '{"lang":"' || lang || '","source":"' || source || '"}' ORDER BY '{"lang":"' || lang || '","source":"' || source || '"}') AS provenance FROM documents""")
def q_provenance_strings(t):
    return V.distinct_json(t.documents, ["lang", "source"], "provenance")


@query(r"""WITH g AS (SELECT d.lang, count(*) AS collected, count_if(l.quality = 1) AS gold FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang)
SELECT lang, collected::BIGINT AS collected, gold::BIGINT AS gold, greatest(300 - collected, 0)::BIGINT AS remaining, (gold + greatest(300 - collected, 0))::BIGINT AS maximum, gold + greatest(300 - collected, 0) >= 120 AS reachable FROM g""")
def q_capacity(t):
    counts = t.documents.join(t.labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("collected"), F.count_if(F.col("quality") == 1).alias("gold"))
    return V.capacity(counts, "lang", 300, 120)


@query(r"""WITH u AS (SELECT event_type, count(*) AS rows, count_if(value < 5) AS unknown, sum(CASE WHEN value >= 5 THEN (value * 100)::BIGINT END)::BIGINT AS tokens FROM events GROUP BY 1)
SELECT event_type, coalesce(tokens, 0)::BIGINT AS tokens, (unknown + greatest(200 - rows, 0))::BIGINT AS tokens_unknown_rows, false AS tokens_exact FROM u""")
def q_lower_bound_usage(t):
    usage = A.usage_rollup(t.events, ["event_type"], {"tokens": F.when(F.col("value") >= 5, F.round(F.col("value") * 100).cast("long"))})
    return V.lower_bound(usage, "tokens", F.lit(200)).select("event_type", "tokens", "tokens_unknown_rows", "tokens_exact")


@query(r"""WITH c AS (SELECT item_id, 'heldout:' || CASE WHEN item_id % 9 = 0 THEN 0 ELSE item_id END AS case_id, text, item_id % 2 = 0 AS malicious, CASE WHEN item_id % 5 = 0 THEN 'PASS' WHEN item_id % 2 = 0 THEN 'BLOCK' WHEN item_id % 7 = 0 THEN 'MAYBE' ELSE 'PASS' END AS expected FROM benchmark)
SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY case_id) > 1 THEN 'repeated_id' WHEN count(*) OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) > 1 THEN 'repeated_requirement' WHEN expected NOT IN ('PASS', 'BLOCK') THEN 'expected_decision' WHEN (expected = 'BLOCK') <> malicious THEN 'label_disagrees' END AS violation FROM c""")
def q_heldout_cases(t):
    i = F.col("item_id")
    cases = t.benchmark.select("item_id", F.concat(F.lit("heldout:"), F.when(i % 9 == 0, 0).otherwise(i).cast("string")).alias("case_id"), F.col("text").alias("requirement"), (i % 2 == 0).alias("malicious"),
                               F.when(i % 5 == 0, "PASS").when(i % 2 == 0, "BLOCK").when(i % 7 == 0, "MAYBE").otherwise("PASS").alias("expected"))
    return V.heldout_violations(cases, "case_id", "requirement", "expected", "malicious").select("item_id", "violation")


@query(r"""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'password: hunter2hunter2' || chr(10) || 'end' ELSE text END AS text FROM documents))
SELECT doc_id, n::INT AS line FROM c WHERE regexp_matches(line, '\bsk-[A-Za-z0-9_-]{12,}\b') OR regexp_matches(line, '\bAKIA[0-9A-Z]{16}\b') OR regexp_matches(line, '-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----') OR regexp_matches(line, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}')
 OR regexp_matches(line, '(?i)\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|password)\s*[:=]\s*[''"]?[^\s''"]{8,}')""")
def q_secret_lines(t):
    planted = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\npassword: hunter2hunter2\nend"))).otherwise(F.col("text"))
    return V.secret_lines(t.documents.select("doc_id", planted.alias("text")), "doc_id", "text")


@query(r"""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE printf('%.1f%%', p_size * 2.0) END AS percent, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / (p_size % 5) * 100 END AS idx FROM part""")
def q_report_numbers(t):
    rate = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 0.02)
    return t.part.select("p_partkey", N.percent_text(rate).alias("percent"), N.index_of(F.col("p_size") % 5, F.col("p_retailprice")).alias("idx"))


@query(r"""WITH k AS (SELECT p_partkey, ['axis:' || p_brand, 'kind:' || p_type] AS a, CASE WHEN p_size % 3 = 0 THEN ['axis:x'] WHEN p_size % 3 = 1 THEN [] ELSE ['axisless'] END AS b FROM part)
SELECT p_partkey, CASE WHEN len(list_filter(list_concat(a, b), lambda x: starts_with(x, 'axis:'))) = 1 THEN substr(a[1], 6) END AS value FROM k""")
def q_axis_value(t):
    tags = F.concat(F.array(F.concat(F.lit("axis:"), "p_brand"), F.concat(F.lit("kind:"), "p_type")), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("axis:x"))).when(F.col("p_size") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("axisless"))))
    return t.part.select("p_partkey", L.axis_value(tags, "axis").alias("value"))


@query(r"""WITH f AS (SELECT doc_id, sha256(text) AS code, doc_id % 4 AS k FROM documents) SELECT doc_id, CASE WHEN k IN (0, 3) THEN code END AS code FROM f""")
def q_only_fenced_code(t):
    code, k = F.sha2("text", 256), F.col("doc_id") % 4
    fence = lambda x, kind="ts": F.concat(F.lit(f"```{kind}\n"), x, F.lit("\n```\n"))
    raw = F.when(k == 0, F.concat(F.lit("see\n"), fence(code))).when(k == 1, F.concat(fence(code), fence(code))).when(k == 2, fence(code, "python")).otherwise(fence(F.concat(code, F.lit("\r\n")), "JSX"))
    return t.documents.select("doc_id", T.only_fenced_code(raw).alias("code"))


@query(r"""SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'P'), []) AS failures FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def q_attached_failures(t):
    failures = t.orders.where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    nested = J.children(t.customer.select("c_custkey"), failures, "c_custkey", ["o_orderkey"], "failures")
    return nested.select("c_custkey", F.transform("failures", lambda x: x.o_orderkey).alias("failures"))


@query(r"""WITH p AS (SELECT l_orderkey, md5(l_linestatus || l_quantity) AS s FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT l_orderkey, l_linenumber, md5(l_linestatus || l_quantity) AS s FROM lineitem WHERE l_returnflag <> 'A')
SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM p WHERE p.l_orderkey = c.l_orderkey AND p.s = c.s) AS approved FROM c""")
def q_signature_join(t):
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    return V.approved_calls(line.where("l_returnflag <> 'A'"), line.where("l_returnflag = 'A'"), "l_orderkey", ["l_linestatus", "l_quantity"]).select("l_orderkey", "l_linenumber", "approved")


@query(r"""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'uncovered' ELSE 'unknown' END AS problem FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def q_exact_cover(t):
    return V.cover_errors(t.orders.select(F.col("o_custkey").alias("k")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")
