"""Safe casts, rates and exact prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,12)"


def count_or_null(text: Column) -> Column:
    """A non-negative integer written as one; anything else is null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def offset_timestamp(text: Column) -> Column:
    """A timestamp that states its offset; null otherwise."""
    return F.when(F.length(text).between(10, 40) & text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null for an empty whole."""
    return F.when(whole != 0, part.cast("double") / whole)


def tri_state_rate(flag: Column) -> Column:
    """Aggregate: the share that is true; null if any is null or there is none."""
    return F.when((F.count(flag) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.count_if(flag).cast("double") / F.count(F.lit(1)))


def token_cost(protocol: Column, counts: dict[str, Column], prices: dict[str, Column], divisor: int, multiplier: Column) -> Column:
    """Decimal cost, or null if a price that is needed is unknown (null).

    Protocols in the style of openai count cache reads in their input; those are
    billed apart, never below zero.
    """
    total, known = F.lit(0).cast(MONEY), F.lit(True)
    for name, count in counts.items():
        if name == "input":
            count = F.when(protocol.isin("openai_compatible", "openai_responses"), F.greatest(count - counts["cache_read"], F.lit(0))).otherwise(count)
        known = known & ((count == 0) | prices[name].isNotNull())
        total = total + F.when(count > 0, (prices[name] * count.cast("decimal(18,0)") / F.lit(divisor)).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    return F.when(known, (total * multiplier).cast(MONEY))


def decimal_text(value: Column) -> Column:
    """A decimal without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def percent_text(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.format_string("%.1f%%", rate * 100)).otherwise(F.lit("n/a"))


def index_of(a: Column, b: Column) -> Column:
    """b relative to a, 100 for equal; null if a is 0."""
    return F.when(a != 0, b.cast("double") / a * 100)


def backoff_seconds(attempt: Column, hint: Column) -> Column:
    """Doubling delay up to 4 s, at least the provider's hint up to 8 s; without jitter."""
    return F.greatest(F.least(F.pow(F.lit(2.0), attempt), F.lit(4.0)), F.least(F.greatest(F.coalesce(hint, F.lit(0.0)), F.lit(0.0)), F.lit(8.0)))
