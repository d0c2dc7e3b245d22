"""Chains whose records have ids of several columns are joined where they lie."""

from sievework import queries as Q


def test_complete_chain_shuffles_no_made_ids(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.queries()["q_complete_chain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "id#" in line.split("hashpartitioning")[1] and "review" in line or "frontend_id" in line]
    assert sum("hashpartitioning(l_orderkey" in line for line in dealt) <= 8 and "review_id" not in plan
