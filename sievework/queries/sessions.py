"""Sessions made of conversations: a turn of the assistant is a call, its result and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sessions as S
from ..operators import sessions as O
from .common import Tables, registry

QUERIES, query = registry()

TOOLS = ["read", "grep", "edit", "bash", "fetch"]
ALLOWED = ["read", "grep", "edit", "bash"]
ROOT, MOST_BYTES, IDENTIFIERS = "/workspace/app", 1500, ["heldout case", "liche keiten"]


def _events(t: Tables) -> DataFrame:
    """Events of conversations, in `order`.  What breaks rules is picked by a text's length n."""
    n = F.char_length("text").cast("bigint")
    event = lambda k, sequence, kind, call=None, tool=None, given=None, status=None, content=None: F.struct(
        (3 * F.col("turn") + k).cast("bigint").alias("order"), sequence.cast("bigint").alias("sequence"), *[(x if x is not None else F.lit(None).cast("string")).alias(name) for name, x in
        (("type", kind), ("call_id", call), ("tool", tool), ("input", given), ("status", status), ("content", content))])
    at, text = 3 * F.col("turn"), F.col("text")
    call = F.concat(F.lit("call-"), (n % 300).cast("string"))
    tool = F.get(F.array(*map(F.lit, TOOLS)), (n % 5).cast("int"))
    answer = F.array(
        event(1, at + 1, F.lit("tool_call"), call, tool, F.substring(text, 1, 24)),
        F.when(n % 23 != 3, event(2, at + 2 + F.when(n % 41 == 9, 5).otherwise(0), F.lit("tool_result"), F.when(n % 29 == 4, F.lit("call-x")).otherwise(call), tool, None,
                                  F.when(n % 31 == 5, F.lit("lost")).when(n % 7 == 1, F.lit("error")).otherwise(F.lit("completed")), F.when(n % 43 != 10, text))),
        event(3, F.when(n % 37 == 6, at).otherwise(at + 3), F.lit("assistant_output"), content=text))
    other = F.array(event(1, at + 1, F.when((F.col("role") == "system") & (n % 3 == 0), F.lit("note")).otherwise(F.lit("user_input")), content=F.when(n % 47 != 11, text)))
    return t.conversations.select("conv_id", n.alias("n"), F.explode(F.array_compact(F.when(F.col("role") == "assistant", answer).otherwise(other))).alias("e")).select("conv_id", "n", "e.*")


_EVENTS = f"""
turns AS (SELECT conv_id, turn::BIGINT AS turn, role, text, length(text)::BIGINT AS n, 'call-' || (length(text) % 300) AS call, {TOOLS!r}[1 + (length(text) % 5)::INT] AS tool FROM conversations),
events AS MATERIALIZED (
  SELECT conv_id, n, 3 * turn + 1 AS ord, 3 * turn + 1 AS sequence, 'tool_call' AS type, call AS call_id, tool, substr(text, 1, 24) AS input, NULL AS status, NULL AS content FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id, n, 3 * turn + 2, 3 * turn + 2 + CASE WHEN n % 41 = 9 THEN 5 ELSE 0 END, 'tool_result', CASE WHEN n % 29 = 4 THEN 'call-x' ELSE call END, tool, NULL,
         CASE WHEN n % 31 = 5 THEN 'lost' WHEN n % 7 = 1 THEN 'error' ELSE 'completed' END, CASE WHEN n % 43 <> 10 THEN text END FROM turns WHERE role = 'assistant' AND n % 23 <> 3
  UNION ALL SELECT conv_id, n, 3 * turn + 3, CASE WHEN n % 37 = 6 THEN 3 * turn ELSE 3 * turn + 3 END, 'assistant_output', NULL, NULL, NULL, NULL, text FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id, n, 3 * turn + 1, 3 * turn + 1, CASE WHEN role = 'system' AND n % 3 = 0 THEN 'note' ELSE 'user_input' END, NULL, NULL, NULL, NULL, CASE WHEN n % 47 <> 11 THEN text END FROM turns WHERE role <> 'assistant')"""


@query(f"""
WITH {_EVENTS},
seen AS (
  SELECT *, row_number() OVER s AS pos, lag(sequence, 1, 0) OVER s AS last, lag(type) OVER s AS before, lag(call_id) OVER s AS open_id, lag(tool) OVER s AS open_tool,
         row_number() OVER (PARTITION BY conv_id, type, call_id ORDER BY ord) AS nth, lead(type) OVER s IS NULL AS ends
  FROM events WINDOW s AS (PARTITION BY conv_id ORDER BY ord)),
judged AS (
  SELECT *, CASE WHEN sequence < 1 THEN 'sequence' WHEN sequence <= last THEN 'sequence_order'
    WHEN type IN ('user_input', 'assistant_output') THEN CASE WHEN coalesce(trim(content), '') = '' THEN 'text' WHEN before = 'tool_call' THEN 'result_not_adjacent' END
    WHEN type = 'tool_call' THEN CASE WHEN before = 'tool_call' THEN 'call_not_adjacent' WHEN nth > 1 THEN 'call_repeated' WHEN n % 19 = 8 THEN 'not_approved' END
    WHEN type = 'tool_result' THEN CASE WHEN NOT (before = 'tool_call' AND open_id = call_id AND open_tool = tool AND status IN ('completed', 'error', 'rejected') AND sequence = last + 1) THEN 'result_pairing'
      WHEN content IS NULL THEN 'result_content' END
    ELSE 'event_type' END AS code FROM seen),
firsts AS (
  SELECT conv_id, arg_min(code, pos) FILTER (WHERE code IS NOT NULL) AS code, min(pos) FILTER (WHERE code IS NOT NULL) AS at, max(pos) AS n, bool_or(ends AND type = 'tool_call') AS open, count_if(type = 'tool_call') AS any_call
  FROM judged GROUP BY conv_id)
SELECT f.conv_id, coalesce(f.code, CASE WHEN open THEN 'open_call' WHEN any_call = 0 THEN 'no_calls' END) AS code,
       CASE WHEN f.code IS NOT NULL THEN f.at WHEN open OR any_call = 0 THEN f.n + 1 END::BIGINT AS at,
       count_if(j.type = 'tool_call' AND j.pos <= coalesce(f.at, f.n))::BIGINT AS calls, count_if(j.type = 'tool_result' AND j.pos <= coalesce(f.at, f.n))::BIGINT AS results
FROM firsts f JOIN judged j ON f.conv_id = j.conv_id GROUP BY ALL
""")
def q_trajectory(t: Tables) -> DataFrame:
    """The first broken rule of each session's trajectory, folded over its events."""
    events = _events(t)
    approved = events.where((F.col("type") == "tool_call") & (F.col("n") % 19 != 8)).groupBy("conv_id").agg(F.collect_set(S.signature(F.col("tool"), F.col("input"))).alias("approved"))
    return O.assemble(events, "conv_id").join(approved, "conv_id", "left").select("conv_id", S.trajectory(F.col("events"), F.col("approved")).alias("r")).select("conv_id", "r.*")


_SESSIONS = """
digests AS (SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id),
sessions AS (SELECT *, conv_id % 12 AS card, row_number() OVER (PARTITION BY conv_id % 12 ORDER BY conv_id) AS revision, lead(conv_id) OVER (PARTITION BY conv_id % 12 ORDER BY conv_id) IS NULL AS final FROM digests)"""


@query(f"""
WITH {_SESSIONS},
audited AS (SELECT *, CASE WHEN turns % 7 = 3 THEN revision + 1 ELSE revision END AS a_revision, CASE WHEN turns % 5 = 4 THEN sha256(digest) ELSE digest END AS a_digest, NOT (card % 5 = 2 AND final) AS present FROM sessions),
links AS (SELECT card, list_reduce(list_prepend('', list(digest ORDER BY revision)), lambda a, d: sha256(a || d)) AS chain FROM sessions GROUP BY card)
SELECT a.card, count(*)::BIGINT AS sessions, count_if(present)::BIGINT AS audits,
       CASE WHEN count(*) <> count_if(present) THEN 'count' ELSE arg_min(CASE WHEN a_revision <> revision THEN 'revision' ELSE 'digest' END, revision) FILTER (WHERE a_revision <> revision OR a_digest <> digest) END AS code,
       CASE WHEN count(*) = count_if(present) THEN min(revision) FILTER (WHERE a_revision <> revision OR a_digest <> digest) END::BIGINT AS at, any_value(chain) AS chain
FROM audited a JOIN links l ON a.card = l.card GROUP BY a.card
""")
def q_audit_zip(t: Tables) -> DataFrame:
    """Revisions of a card against the audits of them, place by place, and their hash chain."""
    own = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"), F.count("*").alias("turns")).select(
        (F.col("conv_id") % 12).alias("card"), "conv_id", "turns", F.sha2(F.array_join("_t.text", "\n"), 256).alias("digest"))
    by_card = Window.partitionBy("card").orderBy("conv_id")
    sessions = own.withColumn("revision", F.row_number().over(by_card)).withColumn("final", F.lead("conv_id").over(by_card).isNull())
    audits = sessions.where(~((F.col("card") % 5 == 2) & F.col("final"))).select(
        "card", "revision", F.when(F.col("turns") % 7 == 3, F.col("revision") + 1).otherwise(F.col("revision")).alias("_revision"),
        F.when(F.col("turns") % 5 == 4, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("_digest"))
    audited = audits.groupBy("card").agg(F.sort_array(F.collect_list(F.struct("revision", "_revision", "_digest"))).alias("_a")).select(
        "card", F.expr("transform(_a, a -> struct(a._revision AS revision, a._digest AS digest))").alias("a"))
    made = sessions.groupBy("card").agg(F.sort_array(F.collect_list(F.struct("revision", "digest"))).alias("s")).join(audited, "card", "left")
    judged = made.withColumn("r", S.audit(F.col("s"), F.col("a")))
    return judged.select("card", F.size("s").cast("bigint").alias("sessions"), F.coalesce(F.size("a"), F.lit(0)).cast("bigint").alias("audits"), "r.code", "r.at", S.hash_chain(F.col("s.digest")).alias("chain"))


def _credential(t: Tables) -> DataFrame:
    """Digest of nine letters inside the first token of ten or more of all conversations: one row."""
    return t.conversations.where(F.col("text").rlike("[A-Za-z]{10}")).groupBy().agg(F.min(F.struct("conv_id", "turn", "text")).alias("r")).select(
        F.sha2(F.substring(F.regexp_extract("r.text", "[A-Za-z]{10,}", 0), 2, 9), 256).alias("digest"))


@query(f"""
WITH credential AS (SELECT sha256(substr(regexp_extract(text, '[A-Za-z]{{10,}}'), 2, 9)) AS digest FROM conversations WHERE regexp_matches(text, '[A-Za-z]{{10}}') ORDER BY conv_id, turn LIMIT 1),
tokens AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{S.CREDENTIAL_TOKEN}')) AS token FROM conversations),
windows AS (SELECT conv_id, turn, substr(token, unnest(range(1, length(token) - 7)), 9) AS piece FROM tokens WHERE length(token) >= 9)
SELECT conv_id, count(DISTINCT turn)::BIGINT AS turns FROM windows, credential WHERE sha256(piece) = digest GROUP BY conv_id
""")
def q_credential_windows(t: Tables) -> DataFrame:
    """Conversations that hold, inside any token, a secret known by length and digest only."""
    digest = _credential(t).first().digest
    return t.conversations.where(S.holds_credential(F.col("text"), 9, digest)).groupBy("conv_id").agg(F.count_distinct("turn").alias("turns"))


@query(f"""
WITH {_EVENTS},
labelled AS (
  SELECT conv_id, list_sort(list_filter([CASE WHEN count_if(type = 'assistant_output') = 0 THEN 'assistant_missing' END, CASE WHEN count_if(type = 'tool_call') <> count_if(type = 'tool_result') THEN 'result_missing' END,
         CASE WHEN count_if(type = 'tool_call' AND tool = 'fetch') > 0 THEN 'tool_not_allowed' END, CASE WHEN count_if(type = 'tool_result' AND status = 'error') > 0 THEN 'tool_error' END,
         CASE WHEN count_if(type = 'tool_result' AND status = 'lost') > 0 THEN 'tool_status' END, CASE WHEN count_if(type = 'user_input') = 0 THEN 'user_missing' END], lambda x: x IS NOT NULL)) AS labels
  FROM events GROUP BY conv_id),
coded AS (
  SELECT *, CASE WHEN type IN ('user_input', 'assistant_output') THEN CASE WHEN content IS NULL THEN 'not_text' WHEN octet_length(encode(content)) > {MOST_BYTES} THEN 'text_size'
       WHEN contains(lower(content), '{IDENTIFIERS[1]}') OR contains(lower(content), '{IDENTIFIERS[0]}') THEN 'heldout' END END AS code, type IN ('user_input', 'assistant_output', 'tool_call') AS kept FROM events),
gathered AS (
  SELECT conv_id, list_sort(list(DISTINCT code) FILTER (WHERE code IS NOT NULL)) AS codes, count_if(kept) AS n, list(type || ':' || coalesce(content, input) ORDER BY ord) FILTER (WHERE kept) AS m FROM coded GROUP BY conv_id),
made AS (
  SELECT g.conv_id, l.labels, list_sort(list_concat(coalesce(codes, []), CASE WHEN g.conv_id % 9 = 4 AND len(l.labels) > 0 THEN ['labels_differ'] ELSE [] END)) AS codes, n, m FROM gathered g JOIN labelled l ON g.conv_id = l.conv_id)
SELECT conv_id, CASE WHEN len(codes) > 0 THEN 'reject' WHEN len(labels) > 0 THEN 'negative' ELSE 'gold' END AS disposition, array_to_string(CASE WHEN len(codes) > 0 THEN codes ELSE labels END, ',') AS codes,
       CASE WHEN len(codes) = 0 THEN n END::BIGINT AS n_messages,
       CASE WHEN len(codes) = 0 THEN sha256(array_to_string(list_transform(range(1, len(m) + 1), lambda i: i || ':' || m[i]), chr(10))) END AS record_sha256 FROM made
""")
def q_session_partition(t: Tables) -> DataFrame:
    """Gold and negative sessions with their messages numbered anew, and rejects of which only codes remain."""
    events = _events(t)
    public = F.col("type").isin("user_input", "assistant_output")
    violation = F.when(public, S.text_violation(F.col("content"), ROOT, MOST_BYTES, IDENTIFIERS))
    labels = O.quality_labels(events, "conv_id", ALLOWED)  # what sessions state, some of them falsely
    stated = labels.withColumn("labels", F.when(F.col("conv_id") % 9 == 4, F.array().cast("array<string>")).otherwise(F.col("labels")))
    out = O.partition_sessions(events, "conv_id", violation, public | (F.col("type") == "tool_call"), stated, ALLOWED)
    lines = F.expr(r"array_join(transform(messages, m -> concat_ws(':', CAST(m.sequence AS STRING), m.type, m.content)), '\n')")
    return out.select("conv_id", "disposition", F.array_join("codes", ",").alias("codes"), "n_messages", F.sha2(lines, 256).alias("record_sha256"))
