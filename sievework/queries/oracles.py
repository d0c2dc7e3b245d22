"""Label oracles over events and documents, and outcomes read from the streams of conversations.

The tables hold neither labels of this kind nor outcomes: they are made of each row's own
text, kind and numbers, and go wrong by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import oracles as O
from ..functions import outcomes as P
from .common import Tables, registry

QUERIES, query = registry()

GENERATOR, VERSION = "inert-proposals-v1", "public-outcome-v1"
_READ = ("workspace.read_text", "workspace-root", "none")
_WRITE = ("workspace.write_derived_file", "workspace-generated-output", "reversible")
_SEND = ("external.publish", "unspecified-external-destination", "irreversible")
_FIELDS = ("capability", "resource_scope", "side_effect")


def _json(p: tuple) -> str:
    return "{" + ",".join(f'"{k}":"{v}"' for k, v in zip(_FIELDS, p)) + "}"


@query(f"""
WITH e AS (
  SELECT event_id, event_id % 13 AS m, CASE WHEN event_type = 'error' THEN 'BLOCK' WHEN event_type IN ('purchase', 'signup') THEN 'ESCALATE' ELSE 'APPROVE' END AS gold FROM events)
SELECT event_id, CASE WHEN m > 1 AND m <> 10 THEN sha256('[' || CASE gold WHEN 'BLOCK' THEN '{_json(_SEND)}' WHEN 'ESCALATE' THEN '{_json(_WRITE)}' ELSE '{_json(_READ)}' END || ',{_json(_READ)}]') END AS proposals_sha256,
  CASE WHEN m IN (0, 1) THEN 'proposals_missing' WHEN m = 10 THEN 'proposals_not_canonical' WHEN m IN (2, 3) AND gold <> 'APPROVE' THEN 'output_differs' WHEN m = 4 THEN 'oracle_differs'
       WHEN m = 5 THEN 'manifest_missing' WHEN m BETWEEN 6 AND 9 THEN 'manifest_differs' END AS error FROM e
""")
def q_policy_rows(t: Tables) -> DataFrame:
    """Each event as a tool-policy row of two proposals: what first shows that it is not the rule's."""
    kind, m = F.col("event_type"), F.col("event_id") % 13
    made = lambda p: F.struct(*[F.lit(v).alias(k) for k, v in zip(_FIELDS, p)])
    own = F.when(kind == "error", made(_SEND)).when(kind.isin("purchase", "signup"), made(_WRITE)).otherwise(made(_READ))
    proposals = F.array(own, made(_READ))
    torn = F.array(made(_READ), F.struct(F.lit("x").alias("capability"), F.lit(None).cast("string").alias("resource_scope"), F.lit("none").alias("side_effect")))
    rows = t.events.select("event_id", m.alias("m"), proposals.alias("gold"), F.when(m == 1, F.slice(proposals, 1, 0)).when(m == 10, torn).when(m > 0, proposals).alias("proposals"))
    decision, labels = L.proposal_decision(F.col("gold")), F.transform("gold", L.proposal_label)
    manifest = F.struct(F.when(F.col("m") == 7, "older").otherwise(GENERATOR).alias("generator"), (F.col("m") == 8).alias("executed"), (F.size("gold") + F.when(F.col("m") == 6, 1).otherwise(0)).alias("count"),
                        F.sha2(F.concat(O.canonical_proposals(F.col("gold")), F.when(F.col("m") == 9, " ").otherwise("")), 256).alias("sha256"))
    error = O.policy_row_error(F.col("proposals"), F.when(F.col("m") == 2, "APPROVE").otherwise(decision), F.when(F.col("m") == 3, F.reverse(labels)).otherwise(labels), F.when(F.col("m") != 4, decision), F.when(F.col("m") != 5, manifest), GENERATOR)
    return rows.select("event_id", F.when((F.col("m") > 1) & (F.col("m") != 10), F.sha2(O.canonical_proposals(F.col("proposals")), 256)).alias("proposals_sha256"), error.alias("error"))


@query("""
WITH d AS (SELECT doc_id, length(text) % 9 AS m, length(text) % 7 AS k, CASE WHEN doc_id % 2 = 0 THEN 'PASS' ELSE 'BLOCK' END AS gold FROM documents)
SELECT doc_id, CASE m WHEN 0 THEN 'code_missing' WHEN 1 THEN 'fixture_not_canonical' WHEN 2 THEN 'output_differs' WHEN 3 THEN 'fixture_differs' WHEN 4 THEN 'oracle_differs' WHEN 5 THEN 'oracle_differs' END AS error,
       k IN (0, 1) AND m <> 4 AND m <> 2 OR k = 6 AND m <> 4 AND m <> 2 AS safe FROM d
""")
def q_security_rows(t: Tables) -> DataFrame:
    """Each document as code with a fixture: what first shows that its label is not the fixture's,
    and whether a row whose teacher disagreed may be trained on."""
    rows = t.documents.select("doc_id", (F.char_length("text") % 9).alias("m"), (F.char_length("text") % 7).alias("k"), F.concat("text", L.fixture_suffix(F.col("doc_id"))).alias("code"), F.when(F.col("doc_id") % 2 == 0, "PASS").otherwise("BLOCK").alias("gold"))
    m, k, gold = F.col("m"), F.col("k"), F.col("gold")
    other = F.when(gold == "PASS", "BLOCK").otherwise("PASS")
    code = F.when(m == 0, " ").when(m == 1, F.concat("code", F.lit("."))).otherwise(F.col("code"))
    decision = F.when(m == 2, other).otherwise(gold)
    oracle = F.when(m != 5, F.struct(F.when(m == 4, other).otherwise(gold).alias("decision"), F.sha2("code", 256).alias("sha256")))
    error = O.security_row_error(code, decision, F.sha2(F.when(m == 3, F.upper("code")).otherwise(F.col("code")), 256), oracle)
    # k: 0, 1 an older row's trace; 2 another's; 3 none; 4 a teacher's label; 5 the rule's, not said to disagree; 6 the rule's
    step = F.struct(F.lit(O.OLD_CHECK).alias("check"), F.lit(O.OLD_EVIDENCE).alias("evidence"), F.concat(F.lit("Emit "), F.when(k == 2, other).otherwise(gold), F.lit(" without executing or reconstructing payloads.")).alias("action"))
    source = F.when(k == 4, "teacher").when(k > 4, "deterministic_oracle")
    supervision = F.struct(source.alias("source"), F.lit(True).alias("normalized"), (k == 5).alias("agrees"), F.lit("deterministic_oracle").alias("trace_source"))
    safe = O.disagreement_safe(F.lit(True), F.concat(F.lit("["), gold, F.lit("]")), decision, F.when(m == 4, other).otherwise(gold), supervision, F.when(k < 3, F.array(step)))
    return rows.select("doc_id", error.alias("error"), safe.alias("safe"))


def _outcome(n: Column, private: bool) -> Column:
    step = F.struct(F.lit("check").alias("check"), F.substring("text", 1, 10).alias("evidence"), F.lit("act").alias("action"))
    return F.to_json(F.struct(
        F.when(n % 19 == 7, "other").otherwise(VERSION).alias("schema_version"), F.get(F.array(*map(F.lit, [*P.STATES, "lost"])), (n % 4).cast("int")).alias("status"),
        F.array_repeat(step, (n % 10).cast("int")).alias("decision_trace"), F.array_repeat(F.lit("repair"), (n % 11).cast("int")).alias("repair_summaries"),
        F.substring("text", 1, 60).alias("final_summary"), *([F.lit("x").alias("CoT")] if private else [])))


_STATUS = "['completed', 'blocked', 'partial', 'lost'][n % 4 + 1]"
_MADE = f"""'schema_version': CASE WHEN n % 19 = 7 THEN 'other' ELSE '{VERSION}' END, 'status': {_STATUS}, 'decision_trace': list_transform(range(n % 10), lambda i: {{'check': 'check', 'evidence': substr(text, 1, 10), 'action': 'act'}}),
  'repair_summaries': list_transform(range(n % 11), lambda i: 'repair'), 'final_summary': substr(text, 1, 60)"""
_FENCE = "'```json' || chr(10)"


@query(f"""
WITH turns AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
made AS (SELECT *, CASE WHEN n % 9 = 4 THEN to_json({{{_MADE}, 'CoT': 'x'}})::VARCHAR ELSE to_json({{{_MADE}}})::VARCHAR END AS o FROM turns),
fenced AS (SELECT *, CASE WHEN n % 5 = 1 THEN {_FENCE} || o || chr(10) || '```' ELSE o END AS said FROM made),
lines AS (
  SELECT conv_id, turn, CASE WHEN n % 7 = 6 THEN line[:-4] ELSE line END AS line
  FROM (SELECT conv_id, turn, n, to_json({{'type': CASE WHEN role = 'assistant' THEN 'Text' ELSE 'tool' END, 'part': {{'type': CASE WHEN n % 13 = 5 THEN 'reasoning' ELSE 'text' END, 'text': said}}}})::VARCHAR AS line FROM fenced)),
events_of AS (SELECT conv_id, turn, CASE WHEN json_valid(line) THEN line END AS line FROM lines),
texts AS (
  SELECT conv_id, turn, regexp_replace(json_extract_string(line, '$.part.text'), '^```json\\n|\\n```$', '', 'g') AS o FROM events_of
  WHERE lower(json_extract_string(line, '$.type')) = 'text' AND json_extract_string(line, '$.part.type') = 'text'),
accepted AS (
  SELECT conv_id, turn, json_extract_string(o, '$.status') AS status, json_array_length(o, '$.decision_trace') AS n_steps, json_array_length(o, '$.repair_summaries') AS n_repairs, trim(json_extract_string(o, '$.final_summary')) AS summary FROM texts
  WHERE json_extract_string(o, '$.schema_version') = '{VERSION}' AND json_extract_string(o, '$.status') IN ('completed', 'blocked', 'partial') AND NOT list_contains(list_transform(json_keys(o), lambda k: lower(k)), 'cot')
    AND json_array_length(o, '$.decision_trace') BETWEEN 1 AND 8 AND trim(json_extract_string(o, '$.decision_trace[0].evidence')) <> '' AND json_array_length(o, '$.repair_summaries') <= 8 AND length(trim(json_extract_string(o, '$.final_summary'))) BETWEEN 1 AND 1000),
last AS (SELECT conv_id, arg_max({{'status': status, 's': n_steps, 'r': n_repairs, 'summary': summary}}, turn) AS o FROM accepted GROUP BY conv_id)
SELECT c.conv_id, o.status AS status, o.s::BIGINT AS n_steps, o.r::BIGINT AS n_repairs, o.summary AS summary FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN last ON c.conv_id = last.conv_id
""")
def q_public_outcomes(t: Tables) -> DataFrame:
    """The outcome that each conversation's stream of events states last."""
    n = F.char_length("text").cast("bigint")
    o = F.when(n % 9 == 4, _outcome(n, True)).otherwise(_outcome(n, False))
    said = F.when(n % 5 == 1, F.concat(F.lit("```json\n"), o, F.lit("\n```"))).otherwise(o)
    line = F.to_json(F.struct(F.when(F.col("role") == "assistant", "Text").otherwise("tool").alias("type"), F.struct(F.when(n % 13 == 5, "reasoning").otherwise("text").alias("type"), said.alias("text")).alias("part")))
    lines = t.conversations.select("conv_id", "turn", F.when(n % 7 == 6, F.substr(line, F.lit(1), F.char_length(line) - 3)).otherwise(line).alias("line"))
    # One row a conversation, as a stream is.
    streams = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x.line), "\n").alias("stream"))
    found = streams.select("conv_id", P.public_outcome(F.col("stream"), VERSION).alias("o"))
    return found.select("conv_id", "o.status", F.when(F.col("o").isNotNull(), F.size("o.steps").cast("long")).alias("n_steps"), F.when(F.col("o").isNotNull(), F.size("o.repairs").cast("long")).alias("n_repairs"), "o.summary")


@query("""
WITH runs AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ['completed', 'partial', 'blocked', 'completed', 'lost'][user_id % 5 + 1] AS status, count(*) AS n, count(DISTINCT event_id % 40) AS names,
         count_if(value >= 2 AND event_id % 3 < 2) AS passed, count_if(event_id % 97 = 0) AS broken FROM events GROUP BY ALL),
judged AS (SELECT *, CASE WHEN status = 'lost' THEN 'status' WHEN names < n THEN 'check_repeated' WHEN broken > 0 THEN 'check_exit_code' END AS problem FROM runs)
SELECT user_id, day, problem, CASE WHEN problem IS NULL THEN n END AS checks_run, CASE WHEN problem IS NULL THEN passed END::BIGINT AS checks_passed, CASE WHEN problem IS NULL THEN n - passed END::BIGINT AS checks_failed,
       CASE WHEN problem IS NULL THEN CASE WHEN n = passed AND status = 'completed' THEN 0 ELSE 1 END END AS exit_code FROM judged
""")
def q_execution_summaries(t: Tables) -> DataFrame:
    """A user's events of a day as the checks of one execution."""
    check = F.struct((F.col("event_id") % 40).cast("string").alias("name"), F.when(F.col("value") >= 2, "PASS").otherwise("FAIL").alias("status"), F.when(F.col("event_id") % 97 != 0, F.when(F.col("event_id") % 3 < 2, 0).otherwise(1)).alias("exit_code"))
    runs = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list(check).alias("checks"))
    status = F.get(F.array(*map(F.lit, ["completed", "partial", "blocked", "completed", "lost"])), (F.col("user_id") % 5).cast("int"))
    return runs.select("user_id", "day", P.execution_summary(status, F.col("checks")).alias("s")).select("user_id", "day", "s.*")
