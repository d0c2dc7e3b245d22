"""Whole jobs and what else only jobs use: partition, shard merge, retry, report, records' leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ordered as O
from ..operators import partition as P
from ..plans import curation as C
from ..sources import jsonl
from ..sources.log import judged_lines, numbered_lines
from ..sources.scratch import folder
from ..streaming import telemetry as S
from .common import listed, pick, registry
from .partition import _DISPOSED

QUERIES, query = registry()
_STAGES = "['plan','tool_policy','frontend','review','security']"


@query(_DISPOSED + "SELECT lang || ':' || disposition AS part, count(*)::BIGINT AS n FROM x GROUP BY 1")
def q_partition_manifest(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    copies = rows.groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("k", F.sha2("text", 256)).join(copies, "k", "left")
    hard = P.label_array(toxic=F.col("toxic") == 1, empty=F.trim("text") == "")
    soft = P.label_array(duplicate_text=F.col("copies") > 1, low_quality=F.col("quality") == 0)
    made = C.offline_partition(rows, hard, soft, F.col("text"), "lang", "doc_id")
    return t.spark.createDataFrame(sorted(made.counts.items()), "part string, n long")  # one row a language and part


def _records(t):
    """Stage records of documents: five in a row are one seed, each but the first names the one before."""
    stage = F.element_at(F.array(*map(F.lit, C.STAGES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select(F.col("doc_id").alias("id"), stage.alias("task"), F.expr("doc_id div 5").alias("seed_id"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") - 1).alias("source_id"), "text")


@query(r"""SELECT count(*)::BIGINT + (SELECT count(*) FROM documents WHERE doc_id % 4 = 0)::BIGINT AS input_rows, count(*)::BIGINT AS output_rows, (SELECT count(*) FROM documents WHERE doc_id % 4 = 0)::BIGINT AS eliminated, 0::BIGINT AS id_conflicts, 0::BIGINT AS content_conflicts, 0::BIGINT AS key_conflicts FROM documents""")
def q_merge_shards(t):
    r = _records(t)
    found = C.merge_shards([r.where("id % 2 = 0"), r.where("id % 2 = 1"), r.where("id % 4 = 0")], F.concat_ws(":", F.col("id").cast("string"), "text"), r.select("seed_id").distinct())[1]
    return t.spark.createDataFrame([{k: int(v) for k, v in found.items()}], "input_rows long, output_rows long, eliminated long, id_conflicts long, content_conflicts long, key_conflicts long")


@query(f"""WITH r AS (SELECT doc_id, doc_id // 5 AS seed_id, doc_id % 5 AS i FROM documents), g AS (SELECT DISTINCT r.seed_id, s.i FROM r, (SELECT unnest(range(5)) AS i) s),
m AS (SELECT seed_id, min(i) AS i FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.seed_id = g.seed_id AND r.i = g.i AND r.doc_id % 7 <> 0) GROUP BY seed_id),
b AS (SELECT seed_id, min(i) AS i FROM (SELECT seed_id, i FROM r WHERE doc_id % 11 = 0 UNION ALL SELECT seed_id, i FROM m) GROUP BY seed_id)
SELECT seed_id, {_STAGES}[(b.i + 1)::INT] AS root, {_STAGES}[(s.i + 1)::INT] AS task FROM b, (SELECT unnest(range(5)) AS i) s WHERE s.i >= b.i""")
def q_retry_plan(t):
    r = _records(t)
    seeds = r.select("seed_id", F.col("seed_id").alias("seed_index")).distinct()
    return C.retry_plan(r.where("id % 11 = 0"), seeds, r.where("id % 7 <> 0"), 1 << 30)


@query(r"""SELECT c_custkey FROM customer WHERE c_nationkey < 12 AND lower(c_mktsegment) <> 'building'""")
def q_guarded_import(t):
    allow = t.nation.where("n_nationkey < 12").select("n_nationkey").join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey")
    return C.guarded_import(t.customer, allow, "c_custkey", {"c_mktsegment": t.spark.createDataFrame([("Building",)], "x string")}).select("c_custkey")


@query(r"""SELECT 'orders->lineitem' AS edge, l_orderkey || '-' || l_linenumber AS downstream_id, l_orderkey::VARCHAR AS source_id, CASE WHEN l_suppkey % 3 <> o_custkey % 3 THEN 'seed_id_mismatch' ELSE 'canonical_input_mismatch' END AS code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 3 <> o_custkey % 3 OR md5('in:' || o_orderdate) <> md5(CASE WHEN l_linenumber % 2 = 0 THEN 'in:' ELSE 'of:' END || o_orderdate)""")
def q_edge_content(t):
    """The downstream input is made anew from the upstream row and must be the same."""
    up = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 3).alias("seed"), F.col("o_orderdate").cast("string").alias("text"))
    down = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("source"), (F.col("l_suppkey") % 3).alias("seed"),
                                                                                       F.md5(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "in:").otherwise("of:"), F.col("o_orderdate").cast("string"))).alias("input"))
    return J.edge_errors(down, up, "orders->lineitem", "source", content=F.col("d.input") == F.md5(F.concat(F.lit("in:"), "u.text")))


@query(r"""WITH s AS (SELECT event_id, floor(epoch(ts))::BIGINT AS status, floor(epoch(ts))::BIGINT + event_id % 60 AS data FROM events) SELECT event_id, CASE WHEN event_id % 13 = 0 THEN false ELSE status + 35 >= data END AS fresh FROM s""")
def q_fresh(t):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    status = F.when(F.col("event_id") % 13 != 0, seconds)
    return t.events.select("event_id", S.fresh(status, seconds + F.col("event_id") % 60, 20.0, 10.0).alias("fresh"))


@query(r"""SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
def q_complete_pairs(t):
    return S.complete_keys(t.events, None, t.events.select("event_type").distinct().count())


@query(r"""SELECT event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, event_type)::INT AS place FROM (SELECT DISTINCT event_type FROM events)""")
def q_custom_order(t):
    from pyspark.sql import Window

    kinds = t.events.select("event_type").distinct()  # a few
    return kinds.select("event_type", F.row_number().over(Window.orderBy(O.rank_in(["purchase", "error"], F.col("event_type")))).alias("place"))


LEAVES = ['{"a": {"n": 5}, "b": "x", "c": true}', '{"a": {"n": "5"}, "b": 7, "c": 0}', '{"a": 1}', '[1]', '{"a": {"n": true}, "b": null, "c": false}']
_J = f"{listed(LEAVES, 'event_id')}::JSON"


@query(f"""WITH l AS (SELECT event_id::VARCHAR AS path, {_J} AS j FROM events) SELECT path, CASE WHEN json_type(j, '$.a.n') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.a.n')::BIGINT END AS n, CASE WHEN json_type(j, '$.b') = 'VARCHAR' THEN j->>'$.b' END AS b, CASE WHEN json_type(j, '$.c') = 'BOOLEAN' THEN (j->>'$.c')::BOOLEAN END AS c FROM l""")
def q_selected_leaves(t):
    lines = t.events.select(F.col("event_id").cast("string").alias("path"), F.try_parse_json(pick(LEAVES, "event_id")).alias("record"))
    return jsonl.selected(lines, {"n": ("$.a.n", "bigint"), "b": ("$.b", "string"), "c": ("$.c", "boolean")})


KEYED = ['{"a": 1, "b": 2}', '{"a": 1}', '{"a": 1, "b": 2, "z": 3}', '{"z": 1}', '{}', '[1]']


@query(f"""WITH k AS (SELECT event_id, {listed(KEYED, 'event_id')}::JSON AS j FROM events) SELECT event_id, CASE WHEN json_type(j) <> 'OBJECT' THEN ['not_an_object'] ELSE list_sort(list_concat(list_transform(list_filter(json_keys(j), lambda x: x NOT IN ('a', 'b', 'c')), lambda x: 'unknown:' || sha256(x)), list_transform(list_filter(['a', 'b'], lambda x: NOT list_contains(json_keys(j), x)), lambda x: 'missing:' || x))) END AS codes FROM k""")
def q_closed_keys(t):
    return t.events.select("event_id", jsonl.closed_keys(pick(KEYED, "event_id"), ["a", "b", "c"], ["a", "b"]).alias("codes"))


@query("""
WITH rows AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no, doc_id FROM documents WHERE source IS NOT NULL)
SELECT source, CASE WHEN doc_id % 17 = 3 THEN 'bad' WHEN doc_id % 23 = 5 THEN 'blank' ELSE 'record' END AS state, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line, sum(line_no)::BIGINT AS number_sum
FROM rows GROUP BY ALL
""")
def q_log_lines(t):
    """Records written as one log a source, some lines cut or blank, and read again with their numbers."""
    path = f"{folder(t.spark)}/log-{uuid.uuid4().hex}"
    record = F.to_json(F.struct("doc_id", "lang", "text"))
    line = F.when(F.col("doc_id") % 17 == 3, F.expr("substring(_line, 1, length(_line) - 1)")).when(F.col("doc_id") % 23 == 5, F.lit(" ")).otherwise(F.col("_line"))
    rows = t.documents.where(F.col("source").isNotNull()).withColumn("_line", record).select("source", "doc_id", line.alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    lines = judged_lines(numbered_lines(t.spark, path)).withColumn("source", F.url_decode(F.regexp_extract("path", "source=([^/]*)/", 1)))
    return lines.groupBy("source", "state").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum("line_no").alias("number_sum"))
