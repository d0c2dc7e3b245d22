"""Documents as the answers of five stages and as what these are asked with.

An answer is JSON made of a document's own lines, language and source, so null languages,
blank lines and unknown labels break it by themselves; other rules are broken by its length n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stages as S
from .common import Tables, registry

QUERIES, query = registry()

STAGES = list(S.HEADINGS)
_LABEL = {"en": "APPROVE", "de": "BLOCK", "fr": "ESCALATE"}

_OUTPUTS = f"""
rows AS (SELECT doc_id, text, lang, source, length(text) AS n, {STAGES!r}[doc_id % 5 + 1] AS stage, substr(text, 1, 30) AS w FROM documents),
made AS (
  SELECT *, CASE lang WHEN 'en' THEN 'APPROVE' WHEN 'de' THEN 'BLOCK' WHEN 'fr' THEN 'ESCALATE' ELSE lang END AS decision, CASE WHEN lang = 'en' THEN 'PASS' WHEN lang = 'fr' THEN 'REVISE' ELSE 'BLOCK' END AS passed,
         CASE WHEN n % 17 = 2 THEN w END AS thinking, CASE WHEN n % 7 = 1 THEN 'html' ELSE 'tsx' END AS language,
         list_transform(string_split(text, chr(10))[1:CASE WHEN n % 13 = 4 THEN 0 ELSE 12 END], lambda l: CASE WHEN n % 11 = 3 THEN to_json({{'id': source, 'goal': substr(l, 1, 40), 'deliverable': 'd', 'note': w}}) ELSE to_json({{'id': source, 'goal': substr(l, 1, 40), 'deliverable': 'd'}}) END) AS steps FROM rows),
whole AS (
  SELECT doc_id, stage, n, json_merge_patch('{{}}'::JSON, CASE stage
    WHEN 'plan' THEN to_json({{'summary': w, 'steps': steps, 'constraints': [lang], 'thinking': thinking}})
    WHEN 'tool_policy' THEN to_json({{'decision': decision, 'rationale': w, 'proposal_labels': CASE WHEN n % 13 = 5 THEN '"x"'::JSON ELSE to_json([source]) END, 'thinking': thinking}})
    WHEN 'frontend' THEN to_json({{'language': language, 'code': CASE WHEN n % 19 = 1 THEN ' ' ELSE text END, 'thinking': thinking}})
    WHEN 'review' THEN to_json({{'language': language, 'summary': CASE WHEN n % 5 <> 1 THEN w END, 'code': CASE WHEN n % 19 = 1 THEN ' ' ELSE text END, 'thinking': thinking}})
    ELSE to_json({{'decision': passed, 'rationale': w, 'findings': [lang], 'thinking': thinking}}) END)::VARCHAR AS o FROM made),
outputs AS (SELECT doc_id, stage, CASE WHEN n % 23 = 6 THEN o[:-2] WHEN n % 19 = 4 THEN '[' || o || ']' ELSE o END AS raw FROM whole),
parsed AS (SELECT doc_id, stage, CASE WHEN json_valid(raw) THEN CASE WHEN json_type(raw) = 'OBJECT' THEN raw::JSON END END AS j FROM outputs)"""


def _text_sql(path: str, j: str = "j") -> str:
    return f"coalesce(json_type({j}, '{path}') = 'VARCHAR' AND trim(json_extract_string({j}, '{path}')) <> '', false)"


def _texts_sql(name: str) -> str:
    return f"(NOT list_contains(json_keys(j), '{name}') OR json_type(j, '$.{name}') = 'ARRAY' AND len(list_filter(json_extract(j, '$.{name}[*]'), lambda x: NOT {_text_sql('$', 'x')})) = 0)"


def _unknown_sql() -> str:
    return "CASE stage " + " ".join(f"WHEN '{s}' THEN len(list_filter(json_keys(j), lambda k: k NOT IN ({', '.join(map(repr, keys))}))) > 0" for s, keys in S.OUTPUT_KEYS.items()) + " END"


_STEP = " AND ".join(_text_sql(f"$.{k}", "s") for k in S.STEP_KEYS)


@query(f"""
WITH {_OUTPUTS}
SELECT doc_id, stage, CASE WHEN j IS NULL THEN 'not_an_object' WHEN {_unknown_sql()} THEN 'unknown_key'
  WHEN stage = 'plan' THEN CASE WHEN NOT {_text_sql('$.summary')} THEN 'summary' WHEN json_type(j, '$.steps') IS DISTINCT FROM 'ARRAY' OR json_array_length(j, '$.steps') = 0 THEN 'steps'
    WHEN len(list_filter(json_extract(j, '$.steps[*]'), lambda s: NOT ({_STEP}))) > 0 THEN 'step_fields' WHEN NOT {_texts_sql('constraints')} THEN 'constraints'
    WHEN len(list_filter(json_extract(j, '$.steps[*]'), lambda s: len(list_filter(json_keys(s), lambda k: k NOT IN ('id', 'goal', 'deliverable'))) > 0)) > 0 THEN 'step_keys' END
  WHEN stage = 'tool_policy' THEN CASE WHEN coalesce(json_extract_string(j, '$.decision') NOT IN ('APPROVE', 'BLOCK', 'ESCALATE'), true) THEN 'decision' WHEN NOT {_text_sql('$.rationale')} THEN 'rationale' WHEN NOT {_texts_sql('proposal_labels')} THEN 'labels' END
  WHEN stage = 'security' THEN CASE WHEN coalesce(json_extract_string(j, '$.decision') NOT IN ('BLOCK', 'PASS'), true) THEN 'decision' WHEN NOT {_text_sql('$.rationale')} THEN 'rationale' WHEN NOT {_texts_sql('findings')} THEN 'findings' END
  WHEN coalesce(json_extract_string(j, '$.language') <> 'tsx', true) THEN 'language' WHEN NOT {_text_sql('$.code')} THEN 'code' WHEN stage = 'review' AND NOT {_text_sql('$.summary')} THEN 'summary' END AS violation
FROM parsed
""")
def q_stage_outputs(t: Tables) -> DataFrame:
    """The first rule of its stage that each answer breaks."""
    n, text, lang, w = F.char_length("text"), F.col("text"), F.col("lang"), F.substring("text", 1, 30)
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.col("doc_id") % 5).cast("int"))
    thinking = F.when(n % 17 == 2, w)
    lines = F.slice(F.split(text, "\n"), 1, F.when(n % 13 == 4, 0).otherwise(12))
    steps = F.transform(lines, lambda x: F.struct(F.col("source").alias("id"), F.substring(x, 1, 40).alias("goal"), F.lit("d").alias("deliverable"), F.when(n % 11 == 3, w).alias("note")))
    decision = F.when(lang.isin(list(_LABEL)), F.element_at(F.create_map(*[F.lit(x) for pair in _LABEL.items() for x in pair]), lang)).otherwise(lang)
    language, code = F.when(n % 7 == 1, "html").otherwise(S.LANGUAGE), F.when(n % 19 == 1, " ").otherwise(text)

    def json(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], thinking.alias("thinking")))

    policy = lambda labels: json(decision=decision, rationale=w, proposal_labels=labels)
    o = (F.when(stage == "plan", json(summary=w, steps=steps, constraints=F.array(lang)))
         .when(stage == "tool_policy", F.when(n % 13 == 5, policy(F.lit("x"))).otherwise(policy(F.array("source"))))
         .when(stage == "frontend", json(language=language, code=code)).when(stage == "review", json(language=language, summary=F.when(n % 5 != 1, w), code=code))
         .otherwise(json(decision=F.when(lang == "en", "PASS").when(lang == "fr", "REVISE").otherwise("BLOCK"), rationale=w, findings=F.array(lang))))
    made = t.documents.select("doc_id", stage.alias("stage"), n.alias("n"), o.alias("o"))
    raw = F.when(F.col("n") % 23 == 6, F.expr("substring(o, 1, length(o) - 1)")).when(F.col("n") % 19 == 4, F.concat(F.lit("["), "o", F.lit("]"))).otherwise(F.col("o"))
    return made.select("doc_id", "stage", S.output_violation(F.col("stage"), raw).alias("violation"))


@query(f"""
WITH chains AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS request, max(text) FILTER (WHERE turn = 1) AS answer, max(text) FILTER (WHERE turn = 2) AS code, max(text) FILTER (WHERE turn = 3) AS defect FROM conversations GROUP BY conv_id),
asked AS (
  SELECT conv_id, unnest({STAGES!r}) AS stage, request, to_json({{'a': answer}})::VARCHAR AS plan, CASE WHEN answer IS NOT NULL THEN to_json([substr(answer, 1, 20)])::VARCHAR END AS proposals, CASE WHEN conv_id % 3 > 0 THEN '{{}}' ELSE ' ' END AS policy,
         ' ' || code || chr(10) AS code, defect, CASE WHEN conv_id % 4 = 1 THEN '{{"n":' || conv_id || '}}' END AS retry FROM chains),
judged AS (
  SELECT *, CASE WHEN coalesce(trim(request) = '', true) THEN 'request' WHEN stage IN ('tool_policy', 'frontend') AND coalesce(trim(plan) = '', true) THEN 'plan' WHEN stage = 'tool_policy' AND proposals IS NULL THEN 'proposals'
    WHEN stage = 'frontend' AND trim(policy) = '' THEN 'policy' WHEN stage IN ('review', 'security') AND coalesce(trim(code, ' ' || chr(10) || chr(9) || chr(13)) = '', true) THEN 'code' WHEN stage = 'review' AND coalesce(trim(defect) = '', true) THEN 'defect' END AS lacking,
    trim(code, ' ' || chr(10) || chr(9) || chr(13)) AS c, trim(defect, ' ' || chr(10) || chr(9) || chr(13)) AS d, chr(10) AS e FROM asked)
SELECT conv_id, stage, lacking, CASE WHEN lacking IS NULL THEN sha256(CASE stage WHEN 'plan' THEN request
    WHEN 'tool_policy' THEN 'REQUIREMENT:' || e || request || e || e || 'PLAN:' || e || plan || e || e || 'INERT TOOL PROPOSALS:' || e || proposals
    WHEN 'frontend' THEN 'REQUIREMENT:' || e || request || e || e || 'APPROVED IMPLEMENTATION PLAN:' || e || plan || e || e || 'TOOL POLICY ADVISORY (not an execution grant):' || e || policy
    WHEN 'review' THEN 'REQUIREMENT:' || e || request || e || e || 'CANDIDATE CODE:' || e || c || e || e || 'KNOWN_BENIGN_DEFECT:' || e || d
    ELSE 'REQUIREMENT:' || e || request || e || e || 'REVIEWED CODE:' || e || c END || CASE WHEN retry IS NULL THEN '' ELSE e || e || 'QUALITY RETRY METADATA:' || e || retry END) END AS turn_sha256 FROM judged
""")
def q_stage_prompts(t: Tables) -> DataFrame:
    """What each stage of a conversation, taken as a chain of stages, is asked with."""
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    chains = t.conversations.groupBy("conv_id").agg(at(0).alias("request"), at(1).alias("answer"), at(2).alias("code"), at(3).alias("defect"))
    inputs = {
        "plan": F.to_json(F.struct(F.col("answer").alias("a")), {"ignoreNullFields": "false"}), "proposals": F.when(F.col("answer").isNotNull(), F.to_json(F.array(F.substring("answer", 1, 20)))),
        "policy": F.when(F.col("conv_id") % 3 > 0, "{}").otherwise(" "), "code": F.concat(F.lit(" "), "code", F.lit("\n")), "defect": F.col("defect")}
    asked = chains.select("*", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    turn, lacking = S.stage_prompt(F.col("stage"), F.col("request"), inputs, F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit('{"n":'), F.col("conv_id").cast("string"), F.lit("}"))))
    return asked.select("conv_id", "stage", lacking.alias("lacking"), F.sha2(turn, 256).alias("turn_sha256"))
