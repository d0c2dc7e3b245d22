"""Price lists, costs of calls and their sums: each code by a row of its own."""

from decimal import Decimal

from sievework.operators import pricing as P

CHANNEL = "id string, protocols array<string>, base_urls array<string>, models array<string>, canonical string, mode string, currency string, input decimal(18,6), output decimal(18,6), cache_read decimal(18,6), cache_write decimal(18,6), source_url string, retrieved string"
CALL = "n int, bound boolean, base_url string, protocol string, model string, input long, output long, cache_read long, cache_write long"


def channel(id, url, **other):
    row = {"protocols": ["anthropic"], "models": ["M1", "m2"], "canonical": "m", "mode": "per_token", "currency": "USD", "input": Decimal(2), "output": Decimal(10), "cache_read": Decimal("0.5"), "cache_write": None, "source_url": "https://p", "retrieved": "d"} | other
    return (id, row["protocols"], url if isinstance(url, list) else [url], *[row[k] for k in ("models", "canonical", "mode", "currency", "input", "output", "cache_read", "cache_write", "source_url", "retrieved")])


def test_channel_errors(spark):
    audited = [channel(x, f"https://{x}/v1") for x in "abcdefgh"]
    given = [channel("a", "https://a/v1"), channel("b", "https://b/v1"), channel("b", "https://b/v1"), channel(None, "https://n"), channel("new", "https://D/v1/"), channel("c", "http://c/v1"), channel("d", "https://d/v1"),
             channel("e", "https://e/v1", protocols=[]), channel("f", "https://f/v1", output=Decimal(-1)), channel("g", "https://g/v1", models=None, retrieved=None), channel("z", None, protocols=["anthropic", None])]
    got = {r.id: r.codes for r in P.channel_errors(spark.createDataFrame(given, CHANNEL), spark.createDataFrame(audited, CHANNEL), "d").collect()}
    assert got == {"b": ["id_repeated"], None: ["id_missing"], "new": ["not_audited", "endpoint_shared"], "c": ["url_not_https", "urls_differ"], "d": ["endpoint_shared"], "e": ["protocol_unknown", "protocols_differ"], "f": ["price_negative", "billing_differs"],
                   "g": ["models_differ", "retrieved_differs"], "h": ["absent"], "z": ["not_audited", "protocol_unknown", "url_not_https"]}
    none = spark.createDataFrame([], CHANNEL)
    assert P.channel_errors(none, none, "d").count() == 0


def test_call_costs(spark):
    channels = spark.createDataFrame([channel("a", ["https://a/v1", "https://A/v1/", "https://a/v2"], protocols=["anthropic", "openai_compatible"]), channel("q", "https://q", mode=P.QUOTA), channel("s", "https://s"), channel("t", "https://s", protocols=["anthropic", "openai_responses"])], CHANNEL)
    base = (True, " https://A/V1//", "anthropic", "m1", 1000, 100, 200, 0)

    def call(**other):
        return tuple((dict(zip(("bound", "base_url", "protocol", "model", "input", "output", "cache_read", "cache_write"), base)) | other).values())

    cases = [(base, "a", "0.0027"), (call(protocol="openai", base_url="https://a/v2"), "a", "0.0027"), (call(cache_read=5000), "a", "0.0035"), (call(base_url="https://s", protocol="openai_responses", model="M2"), "t", "0.0027"),
             (call(bound=False), "a", "provider_binding_unknown"), (call(bound=None), "a", "provider_binding_unknown"), (call(model=None), "a", "provider_binding_unknown"), (call(protocol="soap"), None, "billing_protocol_unknown"), (call(protocol=None), None, "billing_protocol_unknown"),
             (call(base_url="https://s"), None, "exact_alias_unknown"), (call(base_url=None), None, "exact_alias_unknown"), (call(model="m"), "a", "exact_alias_unknown"), (call(base_url="https://q"), "q", "subscription_quota_no_marginal_token_price"),
             (call(input=None, output=-1), "a", "input_usage_unknown"), (call(output=-1), "a", "output_usage_unknown"), (call(cache_read=None), "a", "cache_read_usage_unknown"), (call(cache_write=None), "a", "cache_write_usage_unknown"), (call(cache_write=1), "a", "unknown_price")]
    out = P.call_costs(spark.createDataFrame([(i, *c) for i, (c, _, _) in enumerate(cases)], CALL), channels).collect()
    assert len(out) == len(cases)
    for r in out:
        _, want, told = cases[r.n]
        assert r.channel == want and (r.reason == told if told[0].isalpha() else r.reason is None and r.total == Decimal(told)), (r, cases[r.n])
    assert P.call_costs(spark.createDataFrame([], CALL), channels).count() == 0


def test_combined_cost(spark):
    a, b, d = "a" * 64, "b" * 64, Decimal(1)
    rows = [("ok", d, "USD", "l", a), ("ok", d, "USD", "l", a), ("tag", d, "USD", None, a), ("sha", d, "USD", "l", "x"), ("mixed", d, "USD", "l", a), ("mixed", d, "USD", "k", b), ("old", d, "USD", "l", b), ("open", d, "USD", "l", a), ("open", None, "USD", "l", a), ("cur", d, "USD", "l", a), ("cur", d, None, "l", a),
            ("stray", d, "USD", "l", a), (None, d, "USD", "l", a)]
    costs = spark.createDataFrame(rows, "g string, total decimal(38,12), currency string, source_tag string, source_sha string")
    groups = spark.createDataFrame([(g,) for g in ("ok", "ok", "none", "tag", "sha", "mixed", "old", "open", "cur")], "g string")
    got = {r.g: (r.total, r.currency, r.reason) for r in P.combined_cost(groups, costs, "g", [("l", a), ("k", b)]).collect()}
    no = lambda reason: (None, None, reason)
    assert got == {"ok": (Decimal(2), "USD", None), "none": no("no_shards"), "tag": no("pricing_provenance_unknown"), "sha": no("pricing_provenance_unknown"), "mixed": no("mixed_pricing_provenance"), "old": no("pricing_provenance_unknown"), "open": no("one_or_more_shard_costs_unknown"), "cur": no("mixed_currency")}
