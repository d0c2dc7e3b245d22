"""Metrics, quotas, usage and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import tri_state_rate
from ..operators import aggregates as A
from .common import registry

QUERIES, query = registry()

_RECORDS = r"""WITH r AS (SELECT d.source AS baseline, coalesce(l.toxic, 0) = 1 AS malicious, l.quality,
 CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN d.doc_id % 3 = 0 THEN 'BLOCK' ELSE 'PASS' END AS decision, d.doc_id % 11 <> 0 AS success,
 CASE WHEN l.doc_id IS NULL AND d.source < 'src5' THEN NULL ELSE coalesce(l.quality, 0) = 1 END AS build, d.n_chars, d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def _records(t):
    """Benchmark records made of documents and labels."""
    j = t.documents.join(t.labels.withColumn("labelled", F.lit(True)), "doc_id", "left")
    known = F.col("labelled").isNotNull()
    return j.select(
        F.col("source").alias("baseline"), (F.coalesce("toxic", F.lit(0)) == 1).alias("malicious"),
        F.when(~known, "UNKNOWN").when(F.col("doc_id") % 3 == 0, "BLOCK").otherwise("PASS").alias("decision"), (F.col("doc_id") % 11 != 0).alias("success"),
        F.when(known | (F.col("source") >= "src5"), F.coalesce("quality", F.lit(0)) == 1).alias("verified_build_pass"), F.lit(None).cast("boolean").alias("frontend_build_pass"),
        (F.col("doc_id") % 2 == 0).alias("plan_quality_pass"), F.when(F.col("source") != "src3", F.lit(True)).alias("review_repair_pass"),
        F.when(F.col("doc_id") % 3 == 0, "BLOCK").otherwise("PASS").alias("expected_security_decision"),
        F.when(F.col("doc_id") % 4 != 0, F.element_at(F.array(F.lit("APPROVE"), F.lit("BLOCK"), F.lit("ESCALATE")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("expected_tool_policy_decision"),
        F.when(F.col("doc_id") % 5 != 0, F.element_at(F.array(F.lit("APPROVE"), F.lit("BLOCK"), F.lit("ESCALATE")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("tool_policy_decision"),
        F.lit("APPROVE").alias("deterministic_tool_policy_decision"), F.col("text").alias("final_code"), F.array(F.lit("e"), F.lit("a")).alias("required_substrings"),
        F.col("n_chars").alias("total_tokens"), F.col("n_chars").cast("double").alias("latency_ms"), (F.col("doc_id") % 4).alias("call_count"), (F.col("doc_id") % 13 == 0).alias("fail_closed"),
        F.array(F.lit("frontend"), F.lit("review"), F.lit("frontend")).alias("stages"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double")).alias("peak_vram_mb"))


@query(_RECORDS + r""", v AS (SELECT *, success AND decision IN ('PASS', 'BLOCK') AS valid, decision = 'BLOCK' AS block FROM r)
SELECT baseline, count(*)::BIGINT AS cases, count_if(malicious AND valid AND block) / nullif(count_if(malicious AND valid), 0) AS tpr_valid_security,
 count_if(malicious AND valid AND block) / nullif(count_if(malicious), 0) AS tpr_all_requests, count_if(NOT malicious AND valid AND block) / nullif(count_if(NOT malicious AND valid), 0) AS fpr_valid_security,
 count_if(NOT malicious AND valid AND block) / nullif(count_if(NOT malicious), 0) AS fpr_all_requests, count_if(malicious AND block) / nullif(count_if(malicious), 0) AS operational_malicious_block_rate,
 count_if(NOT malicious AND block) / nullif(count_if(NOT malicious), 0) AS operational_benign_block_rate, count_if(valid)::BIGINT AS valid_security_cases, count_if(decision = 'UNKNOWN')::BIGINT AS unknown_decisions FROM v GROUP BY baseline""")
def q_security_tpr_fpr(t):
    return A.benchmark_metrics(_records(t)).select("baseline", "cases", "tpr_valid_security", "tpr_all_requests", "fpr_valid_security", "fpr_all_requests", "operational_malicious_block_rate", "operational_benign_block_rate", "valid_security_cases", "unknown_decisions")


@query(_RECORDS + r""", p AS (SELECT r.*, CASE WHEN doc_id % 4 <> 0 THEN ['APPROVE', 'BLOCK', 'ESCALATE'][(doc_id % 3 + 1)::INT] END AS want, CASE WHEN doc_id % 5 <> 0 THEN ['APPROVE', 'BLOCK', 'ESCALATE'][(doc_id % 3 + 1)::INT] END AS got,
 success AND decision = CASE WHEN doc_id % 3 = 0 THEN 'BLOCK' ELSE 'PASS' END AS secure, CASE WHEN baseline <> 'src3' THEN true END AS repair FROM r),
c AS (SELECT *, CASE WHEN repair IS NULL THEN NULL WHEN doc_id % 2 <> 0 OR want IS NULL THEN false WHEN malicious THEN secure AND want IS NOT DISTINCT FROM got WHEN build IS NULL THEN NULL ELSE secure AND want IS NOT DISTINCT FROM got AND build END AS composite FROM p)
SELECT baseline, CASE WHEN count(build) FILTER (WHERE NOT malicious) = count_if(NOT malicious) AND count_if(NOT malicious) > 0 THEN count_if(build AND NOT malicious) / count_if(NOT malicious) END AS build_pass_at_1,
 CASE WHEN count(repair) = count(*) THEN count_if(repair) / count(*) END AS review_repair_rate, count_if(doc_id % 2 = 0) / count(*) AS plan_quality_rate,
 count_if(want IS NOT NULL AND got IS NOT DISTINCT FROM want) / nullif(count(want), 0) AS tool_policy_accuracy, count_if(want = 'BLOCK' AND got IS NOT DISTINCT FROM want) / nullif(count_if(want = 'BLOCK'), 0) AS tool_policy_block_accuracy,
 CASE WHEN count(composite) = count(*) THEN count_if(composite) / count(*) END AS composite_success_rate, CASE WHEN count(composite) = count(*) AND count_if(composite) > 0 THEN sum(n_chars) / count_if(composite) END AS cost_per_success_tokens,
 count_if(NOT success) / count(*) AS error_rate, avg(n_chars) AS mean_total_tokens, 2.0::DOUBLE AS mean_builder_attempts, 2.0::DOUBLE AS mean_distinct_expert_stages, max(CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE END) AS peak_vram_mb FROM c GROUP BY baseline""")
def q_benchmark_metrics(t):
    return A.benchmark_metrics(_records(t)).select("baseline", "build_pass_at_1", "review_repair_rate", "plan_quality_rate", "tool_policy_accuracy", "tool_policy_block_accuracy", "composite_success_rate", "cost_per_success_tokens", "error_rate", "mean_total_tokens", "mean_builder_attempts", "mean_distinct_expert_stages", "peak_vram_mb")


@query(r"""SELECT source, CASE WHEN count(l.quality) = count(*) THEN count_if(l.quality = 1) / count(*) END AS quality_rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def q_tristate_rate(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(tri_state_rate(F.col("quality") == 1).alias("quality_rate"))


@query(r"""SELECT lang, count_if(toxic = 1 AND quality = 0) / nullif(count_if(toxic = 1), 0) AS toxic_accuracy, count_if(toxic = 0 AND quality = 1) / nullif(count_if(toxic = 0), 0) AS clean_accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def q_conditional_accuracy(t):
    j = t.documents.join(t.labels, "doc_id")
    rate = lambda x, y: A.ratio(F.count_if(x & y), F.count_if(x))
    return j.groupBy("lang").agg(rate(F.col("toxic") == 1, F.col("quality") == 0).alias("toxic_accuracy"), rate(F.col("toxic") == 0, F.col("quality") == 1).alias("clean_accuracy"))


@query(r"""SELECT event_type, count(*)::BIGINT AS rows, coalesce(sum(CASE WHEN value >= 5 THEN (value * 100)::BIGINT END), 0)::BIGINT AS tokens, count_if(value < 5)::BIGINT AS tokens_unknown_rows, count_if(value < 5) = 0 AS tokens_exact FROM events GROUP BY event_type""")
def q_unknown_rows_rollup(t):
    return A.usage_rollup(t.events, ["event_type"], {"tokens": F.when(F.col("value") >= 5, F.round(F.col("value") * 100).cast("long"))})


@query(r"""SELECT event_type, CASE WHEN count(v) > 0 THEN round(sum(v), 6) END AS total, bool_and(coalesce(user_id % 7 <> 0, false)) AS exact FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN value END AS v FROM events) GROUP BY event_type""")
def q_metric_of_metrics(t):
    return t.events.withColumn("v", F.when(F.col("user_id") % 2 == 0, F.col("value"))).groupBy("event_type").agg(F.round(F.sum("v"), 6).alias("total"), F.bool_and(F.coalesce(F.col("user_id") % 7 != 0, F.lit(False))).alias("exact"))


@query(r"""SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type""")
def q_error_hist(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query(r"""SELECT user_id, least(100.0, round(sum(value) * 100.0 / max(20 + user_id % 3), 4)) AS percent, count(DISTINCT event_type) = 5 AS exact FROM events GROUP BY user_id""")
def q_percent_budget(t):
    return t.events.groupBy("user_id").agg(F.least(F.lit(100.0), F.round(F.sum("value") * 100.0 / F.max(20 + F.col("user_id") % 3), 4)).alias("percent"), (F.countDistinct("event_type") == 5).alias("exact"))


@query(r"""WITH c AS (SELECT lang, count_if(toxic = 0) AS have FROM documents JOIN labels USING (doc_id) GROUP BY lang), q AS (SELECT * FROM (VALUES ('en', 500), ('fr', 20), ('it', 3)) v(lang, want))
SELECT q.lang, coalesce(have, 0)::BIGINT AS have, want::BIGINT AS want, (want - coalesce(have, 0))::BIGINT AS shortfall FROM q LEFT JOIN c USING (lang) WHERE coalesce(have, 0) < want""")
def q_label_quota(t):
    have = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count_if(F.col("toxic") == 0).alias("have"))
    return A.shortfalls(have, t.spark.createDataFrame([("en", 500), ("fr", 20), ("it", 3)], "lang string, want long"), ["lang"], "have", "want")


@query(r"""WITH k AS (SELECT user_id, count(DISTINCT event_type) AS stages FROM events GROUP BY user_id) SELECT stages, count(*)::BIGINT AS n FROM k GROUP BY stages""")
def q_funnel(t):
    return A.funnel(t.events, "user_id", "event_type")


@query(r"""SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5""")
def q_complete_keys(t):
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n = 5").select("user_id")


@query(r"""SELECT role, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, round(avg(length(text)), 2) AS mean, count_if(trim(text) = '')::BIGINT AS empty FROM conversations GROUP BY role""")
def q_length_stats(t):
    n = F.length("text")
    return t.conversations.groupBy("role").agg(F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 2).alias("mean"), F.count_if(F.trim("text") == "").alias("empty"))


@query(r"""SELECT source, count(DISTINCT lang) AS langs, CASE WHEN count(DISTINCT lang) = 1 AND count_if(l.doc_id IS NULL) = 0 THEN min(lang) END AS binding FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def q_provider_binding(t):
    j = t.documents.join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    return j.groupBy("source").agg(F.countDistinct("lang").alias("langs"), A.single_value("lang", F.col("known").isNull()).alias("binding"))


@query(r"""SELECT conv_id, sha256(string_agg(sha256(text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def q_ordered_digest(t):
    return A.ordered_digest(t.conversations.withColumn("h", F.sha2("text", 256)), ["conv_id"], "turn", "h")


@query(r"""WITH k AS (SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'mixed_provenance' WHEN bool_or(o_orderstatus = 'P') THEN 'unknown_price' END AS reason, sum(round(o_totalprice * 100)::BIGINT) / 100.0 AS total FROM orders GROUP BY 1)
SELECT o_custkey, reason, CASE WHEN reason IS NULL THEN total END AS total FROM k""")
def q_cost_total(t):
    k = t.orders.groupBy("o_custkey").agg(F.when(F.countDistinct("o_orderpriority") > 1, "mixed_provenance").when(F.bool_or(F.col("o_orderstatus") == "P"), "unknown_price").alias("reason"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total"))
    return k.select("o_custkey", "reason", F.when(F.col("reason").isNull(), F.col("total")).alias("total"))


@query(r"""SELECT c_mktsegment, sum(c_nationkey)::BIGINT AS n, sum(c_nationkey) * 100.0 / sum(sum(c_nationkey)) OVER () AS percent FROM customer GROUP BY 1""")
def q_group_percent(t):
    per = t.customer.groupBy("c_mktsegment").agg(F.sum("c_nationkey").cast("long").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total")))).select("c_mktsegment", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))  # one row


@query(r"""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 0) AS per_second FROM events GROUP BY user_id""")
def q_throughput(t):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.events.groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), A.ratio(F.count("*"), (us(F.max("ts")) - us(F.min("ts"))) / 1_000_000.0).alias("per_second"))


@query(r"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q_order_summary(t):
    return t.lineitem.where("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
