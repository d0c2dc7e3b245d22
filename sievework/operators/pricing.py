"""Price lists: their audit, the channel of a call, what a call costs, or why that is not known.

A channel is a row (id, protocols, base_urls, models, canonical, mode, currency, input,
output, cache_read, cache_write, source_url, retrieved): prices are decimals for a million
tokens, null where unknown; models are the names that may be asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import token_cost

DIMENSIONS = ["input", "output", "cache_read", "cache_write"]
#: Protocols as calls name them, and as price lists do.
PROTOCOLS = {"openai": "openai_compatible", "openai_compatible": "openai_compatible", "openai_responses": "openai_responses", "anthropic": "anthropic"}
QUOTA = "subscription_quota"
_SHA256 = "^[0-9a-f]{64}$"


def _first(*rules: tuple[str, Column]) -> Column:
    """The first code whose condition holds; null if none does."""
    return reduce(lambda rest, rule: F.when(rule[1], F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def _listed(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(wrong, F.lit(code)) for code, wrong in rules.items()]))


def endpoint(url: Column) -> Column:
    """A base address without blanks, case and closing slashes."""
    return F.rtrim(F.lower(F.trim(url)), F.lit("/"))


def channel_errors(channels: DataFrame, audited: DataFrame, retrieved: str) -> DataFrame:
    """id and codes of each channel with something wrong, and of each audited one that lacks.

    Each channel must be audited, under one id, and the same in all that the audit names;
    in addition its addresses must be https and used by no other channel under the same
    protocol, its protocols known, its prices not negative, and of the audit's day.
    Channels without an id are one row.
    """
    names = [c for c in channels.columns if c != "id"]
    one = channels.groupBy("id").agg(F.count("*").alias("_n"), F.min(F.struct(*names)).alias("c"))
    doors = one.select("id", F.explode("c.base_urls").alias("_url"), F.col("c.protocols").alias("_p")).select("id", endpoint(F.col("_url")).alias("_url"), F.explode("_p").alias("_p")).distinct()
    several = doors.groupBy("_url", "_p").agg(F.count_distinct("id").alias("_k")).where("_k > 1")
    shared = doors.join(several, ["_url", "_p"], "left_semi").where("id IS NOT NULL").select(F.col("id").alias("_shared")).distinct()
    known = audited.select(F.col("id").alias("_audited"), F.struct(*[F.col(x) for x in names]).alias("a"))
    j = one.join(known, F.col("id") == F.col("_audited"), "full_outer").join(shared, F.col("id") == F.col("_shared"), "left")
    here, both = F.col("_n").isNotNull(), F.col("_n").isNotNull() & F.col("_audited").isNotNull()
    differs = lambda *fields: reduce(lambda x, y: x | y, [~F.col(f"c.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields])
    unknown = lambda wrong: F.coalesce(wrong, F.lit(True))
    codes = _listed({
        "absent": ~here,
        "id_missing": here & F.col("id").isNull(),
        "id_repeated": F.col("id").isNotNull() & (F.col("_n") > 1),
        "not_audited": here & F.col("id").isNotNull() & F.col("_audited").isNull(),
        "protocol_unknown": here & unknown((F.size("c.protocols") == 0) | F.exists("c.protocols", lambda p: ~F.coalesce(p.isin(sorted(set(PROTOCOLS.values()))), F.lit(False)))),
        "url_not_https": here & unknown(F.exists("c.base_urls", lambda u: ~F.coalesce(u.rlike(r"^https://[^\s/@?#]+(/[^\s?#]*)?$"), F.lit(False)))),
        "endpoint_shared": F.col("_shared").isNotNull(),
        "price_negative": here & reduce(lambda x, y: x | y, [F.coalesce(F.col(f"c.{d}") < 0, F.lit(False)) for d in DIMENSIONS]),
        "protocols_differ": both & differs("protocols"),
        "urls_differ": both & differs("base_urls"),
        "models_differ": both & differs("models", "canonical"),
        "billing_differs": both & differs("mode", "currency", *DIMENSIONS),
        "source_differs": both & differs("source_url"),
        "retrieved_differs": here & ~F.col("c.retrieved").eqNullSafe(F.lit(retrieved)),
    })
    return j.select(F.coalesce("id", "_audited").alias("id"), codes.alias("codes")).where(F.size("codes") > 0)


def call_costs(calls: DataFrame, channels: DataFrame) -> DataFrame:
    """calls with channel, canonical, currency, total and reason: the first thing that keeps a cost unknown.

    calls has (bound, base_url, protocol, model, input, output, cache_read, cache_write):
    bound tells that exactly one provider is known to have answered.  The channel is the
    one with that address under that protocol; if several have it, none is.  In order:
    provider_binding_unknown, billing_protocol_unknown, exact_alias_unknown (no channel,
    or the model is none of its names, in any case), subscription_quota_no_marginal_token_price,
    <dimension>_usage_unknown (null or negative), unknown_price.  Cache reads are part of
    the input and billed apart.  total is null unless reason is.

    A channel with many addresses is one small row for each; calls move only if price lists
    are too long to be broadcast.
    """
    lookup = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    doors = channels.select("*", F.explode("base_urls").alias("_u")).select("*", F.explode("protocols").alias("_p")).select(endpoint(F.col("_u")).alias("_url"), "_p", F.struct(*channels.columns).alias("_c")).distinct()
    only = doors.groupBy("_url", "_p").agg(F.count("*").alias("_n"), F.min("_c").alias("_c")).where("_n = 1").drop("_n")
    j = calls.withColumn("_protocol", F.try_element_at(lookup, F.col("protocol"))).withColumn("_at", endpoint(F.col("base_url")))
    j = j.join(only, (F.col("_at") == F.col("_url")) & (F.col("_protocol") == F.col("_p")), "left")
    named = F.coalesce(F.exists("_c.models", lambda m: F.lower(m) == F.lower(F.col("model"))), F.lit(False))
    counts = {d: F.col(d).cast("long") for d in DIMENSIONS}
    billed = counts | {"input": F.greatest(counts["input"] - counts["cache_read"], F.lit(0).cast("long"))}
    cost = token_cost(F.lit(""), billed, {d: F.col(f"_c.{d}") for d in DIMENSIONS}, 1_000_000, F.lit(1))
    reason = _first(
        ("provider_binding_unknown", ~F.coalesce(F.col("bound"), F.lit(False)) | F.col("model").isNull()),
        ("billing_protocol_unknown", F.col("_protocol").isNull()),
        ("exact_alias_unknown", ~named),
        ("subscription_quota_no_marginal_token_price", F.col("_c.mode").eqNullSafe(F.lit(QUOTA))),
        *[(f"{d}_usage_unknown", F.coalesce(counts[d] < 0, F.lit(True))) for d in DIMENSIONS],
        ("unknown_price", cost.isNull()))
    return j.withColumn("_reason", reason).select(*calls.columns, F.col("_c.id").alias("channel"), F.when(named, F.col("_c.canonical")).alias("canonical"), F.when(named, F.col("_c.currency")).alias("currency"), F.when(F.col("_reason").isNull(), cost).alias("total"), F.col("_reason").alias("reason"))


def combined_cost(groups: DataFrame, costs: DataFrame, by: str, known: list[tuple[str, str]]) -> DataFrame:
    """by, total, currency and reason of each of groups: a sum only of costs that may be added.

    costs has (by, total, currency, source_tag, source_sha); total is null where unknown;
    known are the (tag, digest) pairs of the price lists in use.  In order: no_shards,
    pricing_provenance_unknown (a row without a tag or a digest), mixed_pricing_provenance,
    pricing_provenance_unknown (not among known), one_or_more_shard_costs_unknown,
    mixed_currency.  Rows of no group count for none.
    """
    told = F.coalesce((F.col("source_tag") != "") & F.col("source_sha").rlike(_SHA256), F.lit(False))
    source = F.struct("source_tag", "source_sha")
    sums = costs.groupBy(by).agg(
        F.count("*").alias("_n"), F.count_if(~told).alias("_untold"), F.min(source).alias("_first"), F.max(source).alias("_last"), F.count_if(F.col("total").isNull()).alias("_open"),
        F.min(F.coalesce("currency", F.lit(""))).alias("_from"), F.max(F.coalesce("currency", F.lit(""))).alias("_to"), F.sum("total").alias("_sum"))
    j = groups.select(by).distinct().join(sums, by, "left")
    in_use = reduce(lambda x, y: x | y, [(F.col("_first.source_tag") == tag) & (F.col("_first.source_sha") == sha) for tag, sha in known], F.lit(False))
    reason = _first(
        ("no_shards", F.col("_n").isNull()),
        ("pricing_provenance_unknown", F.col("_untold") > 0),
        ("mixed_pricing_provenance", F.col("_first") != F.col("_last")),
        ("pricing_provenance_unknown", ~in_use),
        ("one_or_more_shard_costs_unknown", F.col("_open") > 0),
        ("mixed_currency", F.col("_from") != F.col("_to")))
    fine = F.col("_reason").isNull()
    return j.withColumn("_reason", reason).select(by, F.when(fine, F.col("_sum")).alias("total"), F.when(fine, F.col("_from")).alias("currency"), F.col("_reason").alias("reason"))
