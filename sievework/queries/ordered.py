"""Windows, top-k, schedules and telemetry over event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import ordered as O
from .common import registry

QUERIES, query = registry()


@query(r"""SELECT text_sha256, doc_id FROM (SELECT sha256(text) AS text_sha256, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def q_exact_dedup_first(t):
    return D.keep_first(t.documents.select(F.sha2("text", 256).alias("text_sha256"), "doc_id"), ["text_sha256"], ["doc_id"])


@query(r"""SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicated FROM documents""")
def q_dup_flags(t):
    return D.duplicate_counts(t.documents.select("doc_id", F.sha2("text", 256).alias("k")), "k").select("doc_id", (F.col("copies") > 1).alias("duplicated"))


@query(r"""SELECT conv_id, first(sha256(text) ORDER BY turn) AS first, last(sha256(text) ORDER BY turn) AS last FROM conversations GROUP BY conv_id""")
def q_first_last_turn(t):
    return O.first_and_last(t.conversations.withColumn("h", F.sha2("text", 256)), "conv_id", "turn", "h")


@query(r"""WITH l AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, count_if(n <= b)::BIGINT AS violations FROM l GROUP BY conv_id""")
def q_sequence_check(t):
    return O.order_violations(t.conversations.withColumn("n", F.length("text")), "conv_id", "turn", "n")


@query(r"""SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) WHERE role = 'user' AND a IS DISTINCT FROM 'assistant'""")
def q_unanswered(t):
    return O.unanswered(t.conversations, "conv_id", "turn", "role", "user", "assistant").select("conv_id", "turn")


@query(r"""SELECT conv_id, last(role ORDER BY turn) = 'assistant' AS ends_with_assistant FROM conversations GROUP BY conv_id""")
def q_last_is_assistant(t):
    return t.conversations.groupBy("conv_id").agg((F.max_by("role", "turn") == "assistant").alias("ends_with_assistant"))


@query(r"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS sequence FROM conversations WHERE role <> 'system'""")
def q_renumber(t):
    return O.renumbered(t.conversations.where("role <> 'system'").select("conv_id", "turn"), "conv_id", ["turn"])


@query(r"""WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS sequence FROM f""")
def q_event_dedup(t):
    return O.repeated_events_dropped(t.events.select("user_id", "event_type", "event_id"), "user_id", "event_id", ["event_type"])


@query(r"""SELECT user_id, event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER w AS previous, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR previous IS DISTINCT FROM event_type""")
def q_change_log(t):
    return O.changes(t.events, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous")


@query(r"""WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, event_id * (CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END) AS counter FROM events), d AS (SELECT user_id, s, max(counter) AS counter FROM e GROUP BY 1, 2),
w AS (SELECT user_id, s, counter, min(s) OVER f AS t0, first(counter) OVER f AS v0 FROM d WINDOW f AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING))
SELECT user_id, s, CASE WHEN t0 IS NOT NULL AND counter >= v0 THEN round((counter - v0)::DOUBLE / (s - t0), 6) END AS rate FROM w""")
def q_rolling_rate(t):
    e = t.events.select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"), F.when(F.col("event_id") % 97 == 0, 0).otherwise(F.col("event_id")).alias("counter"))
    d = e.groupBy("user_id", "s").agg(F.max("counter").alias("counter"))
    return O.rolling_rate(d, "user_id", "s", "counter", 86400).select("user_id", "s", "rate")


@query(r"""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events WHERE event_type = 'error') WHERE rank <= 8""")
def q_recent(t):
    return O.recent(t.events.where("event_type = 'error'").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "rank")


@query(r"""SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id))::INT AS rank FROM documents) WHERE rank <= 15""")
def q_topk_hash_per_lang(t):
    return O.hash_ordered_top(t.documents.select("lang", "doc_id"), "lang", "doc_id", 15, 42)


_STAGES = ["signup", "view", "click", "purchase", "error"]


@query(r"""WITH s AS (SELECT unnest(['signup','view','click','purchase','error']) AS task, unnest(range(1, 6)) AS i), r AS (SELECT user_id, min(i) AS i FROM events JOIN s ON event_type = task WHERE value > 30 GROUP BY user_id)
SELECT user_id, a.task AS root, b.task AS task FROM r JOIN s a ON a.i = r.i JOIN s b ON b.i >= r.i""")
def q_earliest_root(t):
    return O.earliest_root(t.events.where("value > 30"), "user_id", "event_type", _STAGES)


@query(r"""WITH s AS (SELECT unnest(['signup','view','click','purchase','error']) AS stage, unnest(range(5)) AS i), t AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id LIMIT 40),
d AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60), g AS (SELECT t.user_id, s.stage, s.i FROM t, s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = t.user_id AND d.event_type = s.stage))
SELECT user_id, arg_min(stage, i) AS event_type FROM g GROUP BY user_id""")
def q_first_missing(t):
    seeds = t.events.select("user_id", F.col("user_id").alias("i")).distinct()
    return O.first_missing(seeds, t.events.where("value > 60"), "user_id", "event_type", _STAGES, "i", 40)


@query(r"""SELECT user_id || ':' || event_type AS key, count(DISTINCT ts::DATE)::BIGINT AS attempts, count(DISTINCT ts::DATE) > 3 AS quarantined FROM events WHERE value < 20 GROUP BY 1""")
def q_quarantine(t):
    e = t.events.where("value < 20").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.to_date("ts").alias("day"))
    return O.quarantined(e, "key", "day", 3)


@query(r"""SELECT c_custkey, ['a','b','c'][(c_custkey % 3 + 1)::INT] AS template FROM customer""")
def q_cyclic_template(t):
    return O.cyclic(t.customer.select("c_custkey"), "c_custkey", ["a", "b", "c"])


@query(r"""SELECT doc_id, e AS epoch, sha256('7:' || e || ':' || doc_id) AS order_key, row_number() OVER (PARTITION BY e ORDER BY sha256('7:' || e || ':' || doc_id)) - 1 AS position FROM labels, (SELECT unnest(range(3))::INT AS e)""")
def q_exposure_schedule(t):
    return O.exposure_schedule(t.labels.select("doc_id"), "doc_id", 3, 7)


@query(r"""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def q_bounded_list(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query(None)
def q_near_representatives(t):
    from ..functions import text as T

    return D.near_representatives(t.documents, "doc_id", "doc_id", T.tokens(F.col("text")))
