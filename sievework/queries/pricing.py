"""Price lists made of suppliers, and line items as calls to them; both go wrong by their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pricing as P
from .common import Tables, registry

QUERIES, query = registry()

DAY = "2024-05-01"
SHA = {"list-a": "a" * 64, "list-b": "b" * 64}
_MODELS = [f"model-{i}" for i in range(5)]

_AUDITED = f"""
audited AS (
  SELECT s_suppkey AS k, s_name AS id, CASE s_suppkey % 3 WHEN 0 THEN ['openai_compatible'] WHEN 1 THEN ['anthropic'] ELSE ['openai_compatible', 'anthropic'] END AS protocols,
         'https://api' || s_nationkey || '.example.com/v1' AS url, CASE WHEN s_suppkey % 4 = 1 THEN '{P.QUOTA}' ELSE 'per_token' END AS mode, CASE WHEN s_nationkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
         (s_suppkey % 9 + 1) * 25 AS p_input, (s_suppkey % 9 + 1) * 100 AS p_output, (s_suppkey % 9 + 1) * 5 AS p_read, CASE WHEN s_suppkey % 5 <> 3 THEN 50 END AS p_write FROM supplier)"""


def _audited(t: Tables) -> DataFrame:
    k, price = F.col("s_suppkey"), lambda x: (x / 100).cast("decimal(18,6)")
    one, both = F.lit("openai_compatible"), F.lit("anthropic")
    return t.supplier.select(
        F.col("s_name").alias("id"), F.when(k % 3 == 0, F.array(one)).when(k % 3 == 1, F.array(both)).otherwise(F.array(one, both)).alias("protocols"),
        F.array(F.concat(F.lit("https://api"), F.col("s_nationkey").cast("string"), F.lit(".example.com/v1"))).alias("base_urls"), F.array(*map(F.lit, _MODELS)).alias("models"), F.lit("model").alias("canonical"),
        F.when(k % 4 == 1, P.QUOTA).otherwise("per_token").alias("mode"), F.when(F.col("s_nationkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"),
        price((k % 9 + 1) * 25).alias("input"), price((k % 9 + 1) * 100).alias("output"), price((k % 9 + 1) * 5).alias("cache_read"), F.when(k % 5 != 3, price(F.lit(50))).alias("cache_write"),
        F.lit("https://example.com/prices").alias("source_url"), F.lit(DAY).alias("retrieved"), k.alias("_k"))


@query(f"""
WITH {_AUDITED},
given AS (
  SELECT *, CASE WHEN k % 10 = 5 THEN 'X' || id ELSE id END AS gid, k % 10 AS m, CASE WHEN k % 10 = 1 THEN replace(url, 'https', 'http') WHEN k % 10 = 2 THEN 'https://own' || k || '.example.com/v2/' ELSE url END AS gurl,
         CASE WHEN k % 10 = 3 THEN ['grpc'] ELSE protocols END AS gprotocols FROM audited WHERE k % 10 <> 4),
doors AS (SELECT DISTINCT gid, rtrim(lower(gurl), '/') AS u, unnest(gprotocols) AS p FROM given),
shared AS (SELECT DISTINCT gid FROM doors WHERE (u, p) IN (SELECT (u, p) FROM doors GROUP BY u, p HAVING count(DISTINCT gid) > 1)),
judged AS (
  SELECT gid AS id, list_filter([
    CASE WHEN m = 6 THEN 'id_repeated' END, CASE WHEN m = 5 THEN 'not_audited' END, CASE WHEN m = 3 THEN 'protocol_unknown' END, CASE WHEN m = 1 THEN 'url_not_https' END, CASE WHEN gid IN (SELECT gid FROM shared) THEN 'endpoint_shared' END,
    CASE WHEN m = 7 THEN 'price_negative' END, CASE WHEN m = 3 THEN 'protocols_differ' END, CASE WHEN m IN (1, 2) THEN 'urls_differ' END, CASE WHEN m = 0 THEN 'models_differ' END, CASE WHEN m = 7 THEN 'billing_differs' END,
    CASE WHEN m = 8 THEN 'source_differs' END, CASE WHEN m = 9 THEN 'retrieved_differs' END], lambda x: x IS NOT NULL) AS codes FROM given
  UNION ALL SELECT id, ['absent'] FROM audited WHERE k % 10 IN (4, 5))
SELECT * FROM judged WHERE len(codes) > 0
""")
def q_price_list_errors(t: Tables) -> DataFrame:
    """All that is wrong with a price list against the audited one."""
    audited = _audited(t)
    m, k = F.col("_k") % 10, F.col("_k").cast("string")
    url = F.get("base_urls", F.lit(0))
    given = audited.where(m != 4).withColumns({
        "id": F.when(m == 5, F.concat(F.lit("X"), "id")).otherwise(F.col("id")), "protocols": F.when(m == 3, F.array(F.lit("grpc"))).otherwise(F.col("protocols")),
        "base_urls": F.array(F.when(m == 1, F.replace(url, F.lit("https"), F.lit("http"))).when(m == 2, F.concat(F.lit("https://OWN"), k, F.lit(".example.com/v2/"))).otherwise(url)),
        "canonical": F.when(m == 0, "other").otherwise(F.col("canonical")), "input": F.when(m == 7, -F.col("input")).otherwise(F.col("input")).cast("decimal(18,6)"),
        "source_url": F.when(m == 8, "https://example.org").otherwise(F.col("source_url")), "retrieved": F.when(m == 9, "2024-04-30").otherwise(F.col("retrieved"))})
    given = given.unionByName(given.where(m == 6))
    return P.channel_errors(given.drop("_k"), audited.drop("_k"), DAY)


_COSTS = f"""
{_AUDITED},
doors AS (SELECT url, p, min(k) AS k FROM (SELECT url, k, unnest(protocols) AS p FROM audited) GROUP BY url, p HAVING count(*) = 1),
calls AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q, s_nationkey, l_linenumber % 4 AS pick, l_partkey % 31 <> 0 AS bound,
         CASE WHEN l_partkey % 37 <> 0 THEN 'MODEL-' || l_partkey % 7 END AS model, CASE WHEN l_partkey % 11 <> 1 THEN l_quantity::BIGINT * 1000 END AS input, CASE WHEN l_partkey % 13 <> 1 THEN l_quantity::BIGINT * 10 END AS output,
         CASE WHEN l_partkey % 17 <> 1 THEN l_linenumber * 7000 END AS cache_read, CASE WHEN l_partkey % 19 = 1 THEN -1 ELSE l_partkey % 2 * 40 END AS cache_write, l_returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
met AS (
  SELECT c.*, a.*, ['openai', 'anthropic', 'openai_responses', 'soap'][pick + 1] AS protocol FROM calls c
  LEFT JOIN doors d ON d.url = 'https://api' || c.s_nationkey || '.example.com/v1' AND d.p = ['openai_compatible', 'anthropic', 'openai_responses', NULL][pick + 1] LEFT JOIN audited a ON a.k = d.k),
reasoned AS (
  SELECT *, CASE WHEN NOT bound OR model IS NULL THEN 'provider_binding_unknown' WHEN protocol = 'soap' THEN 'billing_protocol_unknown' WHEN k IS NULL OR l_partkey % 7 > 4 THEN 'exact_alias_unknown'
    WHEN mode = '{P.QUOTA}' THEN 'subscription_quota_no_marginal_token_price' WHEN input IS NULL THEN 'input_usage_unknown' WHEN output IS NULL THEN 'output_usage_unknown' WHEN cache_read IS NULL THEN 'cache_read_usage_unknown'
    WHEN cache_write < 0 THEN 'cache_write_usage_unknown' WHEN cache_write > 0 AND p_write IS NULL THEN 'unknown_price' END AS reason,
    greatest(input - cache_read, 0) * p_input + output * p_output + cache_read * p_read + cache_write * coalesce(p_write, 0) AS e8 FROM met),
costs AS (SELECT *, k IS NOT NULL AND l_partkey % 7 <= 4 AND model IS NOT NULL AS named FROM reasoned)"""


def _costs(t: Tables) -> DataFrame:
    part, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    calls = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (part % 31 != 0).alias("bound"), F.concat(F.lit("https://API"), F.col("s_nationkey").cast("string"), F.lit(".example.com/v1/")).alias("base_url"),
        F.get(F.array(*map(F.lit, ["openai", "anthropic", "openai_responses", "soap"])), (F.col("l_linenumber") % 4).cast("int")).alias("protocol"), F.when(part % 37 != 0, F.concat(F.lit("MODEL-"), (part % 7).cast("string"))).alias("model"),
        F.when(part % 11 != 1, q * 1000).alias("input"), F.when(part % 13 != 1, q * 10).alias("output"), F.when(part % 17 != 1, F.col("l_linenumber").cast("long") * 7000).alias("cache_read"), F.when(part % 19 == 1, -1).otherwise(part % 2 * 40).alias("cache_write"))
    return P.call_costs(calls, _audited(t).drop("_k"))


@query(f"""WITH {_COSTS}
SELECT l_orderkey, l_linenumber, l_partkey, id AS channel, CASE WHEN named THEN currency END AS currency, CASE WHEN reason IS NULL THEN e8 END::BIGINT AS total_e8, reason FROM costs""")
def q_call_costs(t: Tables) -> DataFrame:
    """What each line item costs as a call, or what keeps that unknown; in 10^-8 of the currency."""
    return _costs(t).select("l_orderkey", "l_linenumber", "l_partkey", "channel", "currency", (F.col("total") * 100_000_000).cast("long").alias("total_e8"), "reason")


@query(f"""WITH {_COSTS},
priced AS (SELECT l_orderkey, reason, currency, e8, CASE l_returnflag WHEN 'A' THEN 'list-a' WHEN 'N' THEN 'list-b' ELSE 'list-a' END AS tag, l_partkey % 23 = 0 AS untold, l_returnflag = 'R' AND l_partkey % 3 = 0 AS old, named FROM costs WHERE reason IS NULL OR l_partkey % 3 = 0),
sums AS (
  SELECT l_orderkey, bool_or(untold) AS untold, count(DISTINCT tag || CASE WHEN old THEN '-old' ELSE '' END) AS lists, bool_or(old) AS old, count(reason) AS open, count(DISTINCT CASE WHEN named THEN currency ELSE '' END) AS currencies, min(currency) AS currency, sum(e8) AS e8 FROM priced GROUP BY l_orderkey),
judged AS (
  SELECT o_orderkey, s.*, CASE WHEN s.l_orderkey IS NULL THEN 'no_shards' WHEN untold THEN 'pricing_provenance_unknown' WHEN lists > 1 THEN 'mixed_pricing_provenance' WHEN old THEN 'pricing_provenance_unknown'
    WHEN open > 0 THEN 'one_or_more_shard_costs_unknown' WHEN currencies > 1 THEN 'mixed_currency' END AS reason FROM orders o LEFT JOIN sums s ON o_orderkey = s.l_orderkey)
SELECT o_orderkey, CASE WHEN reason IS NULL THEN e8 END::BIGINT AS total_e8, CASE WHEN reason IS NULL THEN currency END AS currency, reason FROM judged""")
def q_combined_costs(t: Tables) -> DataFrame:
    """The sum of an order's calls of one price list and currency, or why there is none."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    tag = F.when(flag == "N", "list-b").otherwise("list-a")
    sha = F.when(part % 23 == 0, "?").when((flag == "R") & (part % 3 == 0), "c" * 64).when(tag == "list-b", SHA["list-b"]).otherwise(SHA["list-a"])
    costs = _costs(t).where(F.col("reason").isNull() | (part % 3 == 0)).select(F.col("l_orderkey").alias("o_orderkey"), "total", "currency", tag.alias("source_tag"), sha.alias("source_sha"))
    out = P.combined_cost(t.orders, costs, "o_orderkey", list(SHA.items()))
    return out.select("o_orderkey", (F.col("total") * 100_000_000).cast("long").alias("total_e8"), "currency", "reason")
