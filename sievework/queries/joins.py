"""Lineage, closure, lists, precedence and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .common import registry

QUERIES, query = registry()


@query(r"""SELECT 'orders->lineitem' AS edge, l_orderkey || '-' || l_linenumber AS downstream_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END::VARCHAR AS source_id,
CASE WHEN l_linenumber = 7 THEN 'missing_source_record_id' WHEN o_orderkey IS NULL THEN 'source_not_strict_gold' WHEN l_suppkey % 17 = 0 THEN 'missing_seed_id' WHEN o_custkey % 5 <> l_suppkey % 5 THEN 'seed_id_mismatch' END AS code
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'
WHERE l_linenumber = 7 OR o_orderkey IS NULL OR l_suppkey % 17 = 0 OR o_custkey % 5 <> l_suppkey % 5""")
def q_edge_errors(t):
    down = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_linenumber") != 7, F.col("l_orderkey").cast("string")).alias("source"),
                             F.when(F.col("l_suppkey") % 17 != 0, F.col("l_suppkey") % 5).alias("seed"))
    up = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 5).alias("seed"))
    return J.edge_errors(down, up, "orders->lineitem", "source")


@query(r"""WITH e AS (SELECT CASE WHEN l_linenumber = 7 THEN 'missing_source_record_id' WHEN o_orderkey IS NULL THEN 'source_not_strict_gold' WHEN l_suppkey % 17 = 0 THEN 'missing_seed_id' WHEN o_custkey % 5 <> l_suppkey % 5 THEN 'seed_id_mismatch' END AS code
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P')
SELECT 'orders->lineitem' AS edge, code, count(*)::BIGINT AS n FROM e WHERE code IS NOT NULL GROUP BY code""")
def q_edge_error_counts(t):
    return q_edge_errors(t).groupBy("edge", "code").agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS security_id, l_suppkey AS seed, (c_nationkey % 3 <> s_nationkey % 3) AS fork
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT security_id, seed, CASE WHEN fork THEN 'planner_reference_fork' WHEN row_number() OVER (PARTITION BY seed, fork ORDER BY security_id) > 1 THEN 'duplicate_complete_chain_seed' END AS code FROM c""")
def q_complete_chain(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = t.lineitem.select(*key).distinct()
    security = lines.select(*key, F.concat_ws("-", *key).alias("id"), F.col("l_suppkey").alias("seed"))
    owner = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", (F.col("c_nationkey") % 3).alias("plan_id"))
    frontend = lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(*key, "plan_id", F.col("l_suppkey").alias("tool_id"))
    tool = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("plan_id"))
    plan = t.spark.range(3).select(F.col("id"))
    return J.complete_chains(security, lines, frontend, tool, plan, order="id", key=key)


@query(r"""SELECT 'orders.o_custkey' AS reference, o_custkey::VARCHAR AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'customer.c_nationkey', c_nationkey::VARCHAR FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)""")
def q_fk_closure(t):
    return J.missing_references([("orders.o_custkey", t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey"), ("customer.c_nationkey", t.customer, "c_nationkey", t.nation.where("n_regionkey < 4"), "n_nationkey")])


@query(r"""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def q_allowlist_semi(t):
    allow = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return J.allowlisted(t.customer, allow, "c_nationkey")[0].select("c_custkey")


@query(r"""SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def q_missing_allowlisted(t):
    return J.allowlisted(t.documents.where("lang = 'en'"), t.labels.select("doc_id"), "doc_id")[1]


@query(r"""SELECT c_custkey FROM customer WHERE lower(c_mktsegment) NOT IN ('building') AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def q_denylist_anti(t):
    lists = {"c_mktsegment": t.spark.createDataFrame([("Building",)], "x string"), "c_nationkey": t.nation.where("n_regionkey = 0").select("n_nationkey"), "c_custkey": t.orders.where("o_totalprice > 300000").select("o_custkey")}
    return J.denied(t.customer, lists).select("c_custkey")


@query(r"""WITH c AS (SELECT lower(p_brand) AS k, CASE WHEN p_size > 25 THEN 1 ELSE 2 END AS priority, p_partkey FROM part WHERE p_size % 2 = 0), b AS (SELECT k, min((priority, p_partkey)) AS m FROM c GROUP BY k)
SELECT p.p_brand, p.p_size, m[2] AS p_partkey FROM (SELECT DISTINCT p_brand, p_size FROM part) p LEFT JOIN b ON lower(p.p_brand) = k""")
def q_alias_precedence(t):
    candidates = t.part.where("p_size % 2 = 0").select(F.upper("p_brand").alias("p_brand"), F.when(F.col("p_size") > 25, 1).otherwise(2).alias("priority"), "p_partkey")
    return J.by_precedence(t.part.select("p_brand", "p_size").distinct(), "p_brand", candidates, "priority", "p_partkey")


@query(r"""WITH o AS (SELECT s_nationkey AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT n_nationkey, s AS s_suppkey FROM nation LEFT JOIN o ON n_nationkey = k""")
def q_only_match(t):
    return J.only_match(t.nation.select("n_nationkey"), t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey"), ["n_nationkey"], "s_suppkey")


@query(r"""WITH o AS (SELECT p_partkey AS k, p_type AS v FROM part WHERE p_size < 30), n AS (SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN p_type || '*' ELSE p_type END AS v FROM part WHERE p_size > 10)
SELECT coalesce(o.k, n.k) AS p_partkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v""")
def q_snapshot_diff(t):
    new = t.part.where("p_size > 10").select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.concat("p_type", F.lit("*"))).otherwise(F.col("p_type")).alias("p_type"))
    return J.keyed_difference(t.part.where("p_size < 30"), new, "p_partkey", "p_type")


@query(r"""WITH g AS (SELECT lang, avg(n_chars) AS v FROM documents GROUP BY lang), c AS (SELECT lang, avg(length(text)) + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS v FROM documents GROUP BY lang)
SELECT g.lang, g.v AS given, c.v AS computed FROM g JOIN c USING (lang) WHERE abs(g.v - c.v) > greatest(abs(g.v), abs(c.v)) * 1e-9""")
def q_metric_diff(t):
    given = t.documents.groupBy("lang").agg(F.avg("n_chars").alias("v"))
    computed = t.documents.groupBy("lang").agg((F.avg(F.length("text")) + F.when(F.col("lang") == "fr", 1).otherwise(0)).alias("v"))
    return J.numeric_difference(given, computed, ["lang"], "v")


@query(r"""SELECT c_custkey FROM customer WHERE (c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey % 50 = 0) AND c_acctbal >= 0""")
def q_pending(t):
    key = lambda d, c: d.select(F.col(c).alias("c_custkey"))
    return J.pending(t.customer.select("c_custkey"), key(t.orders, "o_custkey").distinct(), key(t.customer.where("c_acctbal < 0"), "c_custkey"), key(t.customer.where("c_custkey % 50 = 0"), "c_custkey"), "c_custkey")


@query(r"""SELECT o_custkey, o_orderpriority, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS o_orderkey, CASE WHEN count(*) = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM orders GROUP BY 1, 2""")
def q_exactly_one(t):
    return J.exactly_one(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query(r"""SELECT r_regionkey, m AS c_mktsegment, count(c_custkey)::BIGINT AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer) LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0 LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = m GROUP BY 1, 2""")
def q_dense_grid(t):
    rows = t.customer.join(t.nation.where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), "c_mktsegment")
    return J.dense_grid(rows, t.region.select("r_regionkey"), t.customer.select("c_mktsegment").distinct())


@query(r"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 3 AND role = 'user' THEN 'tool' ELSE role END AS role FROM conversations)
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn - 1) AS turn, CASE WHEN a.conv_id IS NULL THEN 'no_answer' ELSE 'no_question' END AS problem
FROM (SELECT * FROM c WHERE role = 'user') u FULL JOIN (SELECT * FROM c WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE u.conv_id IS NULL OR a.conv_id IS NULL""")
def q_role_pairing(t):
    c = t.conversations.withColumn("role", F.when((F.col("conv_id") % 7 == 3) & (F.col("role") == "user"), "tool").otherwise(F.col("role")))
    u = c.where("role = 'user'").select(F.col("conv_id").alias("u"), F.col("turn").alias("x"))
    a = c.where("role = 'assistant'").select(F.col("conv_id").alias("a"), (F.col("turn") - 1).alias("y"))
    j = u.join(a, (F.col("u") == F.col("a")) & (F.col("x") == F.col("y")), "full_outer").where("u IS NULL OR a IS NULL")
    return j.select(F.coalesce("u", "a").alias("conv_id"), F.coalesce("x", "y").alias("turn"), F.when(F.col("a").isNull(), "no_answer").otherwise("no_question").alias("problem"))


@query(r"""SELECT r_regionkey, coalesce(list(n_nationkey || ':' || n_name ORDER BY n_nationkey) FILTER (WHERE n_nationkey IS NOT NULL), []) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_regionkey <> 4 GROUP BY 1""")
def q_nested_children(t):
    nations = t.nation.where("n_regionkey <> 4").withColumnRenamed("n_regionkey", "r_regionkey")
    nested = J.children(t.region.select("r_regionkey"), nations, "r_regionkey", ["n_nationkey", "n_name"], "nations")
    return nested.select("r_regionkey", F.transform("nations", lambda n: F.concat_ws(":", n.n_nationkey, n.n_name)).alias("nations"))


@query(r"""SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) AND b.text <> ''""")
def q_contains_probe(t):
    return J.containing(t.documents.select("doc_id", F.lower("text").alias("text")), t.benchmark.select("item_id", F.lower("text").alias("needle")), "text", "needle").select("item_id", "doc_id")


@query(r"""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def q_id_difference(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id").distinct()).distinct()


@query(r"""SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")
def q_id_intersection(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 5000").select("c_custkey"))
