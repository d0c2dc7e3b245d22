"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest
from sievework import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return format(v, ".9g")
    if hasattr(v, "asDict"):
        v = v.asDict()
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


#: Queries whose rules must each break somewhere in the tables: column and its values.
BRANCHES = {
    "q_secret_scan": ("codes", {"sk_key", "ark_key", "access_key", "private_key", "bearer", "assigned"}),
    "q_active_payload": ("codes", {"script_tag", "script_url", "sql_statement", "dynamic_code", "miner"}),
    "q_instruction_audit": ("findings", {"instruction_override", "secret_exfiltration", "external_command", "safety_bypass"}),
    "q_stage_safety": ("violation", {None, "secret_material", "code_too_long", "active_payload", "unsafe_reviewed_code"}),
    "q_html_mutation": ("rule", {None, "remove_literal_aria_label", "semantic_main_to_div", "semantic_h1_to_div"}),
    "q_role_pairing": ("problem", {"no_answer", "no_question"}),
    "q_error_codes": ("codes", {"invalid_url", "client_cancelled", "rate_limited", "authentication_failed", "missing_reasoning_content"}),
    "q_parse_decision": ("decision", {None, "PASS", "BLOCK"}),
    "q_rejection_reason": ("reason", {"active_payload_material", "credential_like_material", "invalid_json_object", "empty_request", "task_card_binding", "seed_schema", "unclassified_validation"}),
    "q_record_violation": ("violation", {None, "not_an_object", "schema_version", "id", "expert", "messages", "message_object", "message_role", "message_content", "no_user_turn", "last_turn", "provenance", "provenance_source", "decision_trace", "trace_step",
                                         "trace_evidence", "output", "planner_summary", "planner_steps", "tool_decision", "tool_rationale", "code", "security_label", "security_decision", "security_rationale", "target"}),
    "q_seed_violation": ("violation", {None, "empty_request", "empty_card", "seed_index", "card_without_index", "empty_template", "empty_source_kind", "template_without_kind", "template_without_card", "source_kind", "synthetic_digest", "external_digest", "legacy_digest"}),
    "q_retry_metadata": ("violation", {None, "generation", "retry_of", "no_codes", "unknown_code"}),
    "q_heldout_cases": ("violation", {None, "repeated_id", "expected_decision", "label_disagrees"}),
    "q_artifact_failures": ("codes", {"missing_provenance", "source_missing", "source_seed_mismatch", "source_or_candidate_invalid", "mutation_unavailable", "candidate_not_canonical", "source_not_restored", "missing_artifact"}),
    "q_policy_rows": ("error", {None, "proposals_missing", "proposals_not_canonical", "output_differs", "oracle_differs", "manifest_missing", "manifest_differs"}),
    "q_security_rows": ("error", {None, "code_missing", "fixture_not_canonical", "output_differs", "fixture_differs", "oracle_differs"}),
    "q_public_outcomes": ("status", {None, "completed", "blocked", "partial"}),
    "q_execution_summaries": ("problem", {None, "status", "check_repeated", "check_exit_code"}),
    "q_price_list_errors": ("codes", {"absent", "id_repeated", "not_audited", "protocol_unknown", "url_not_https", "price_negative", "protocols_differ", "urls_differ", "models_differ", "billing_differs", "source_differs", "retrieved_differs"}),
    "q_call_costs": ("reason", {None, "provider_binding_unknown", "billing_protocol_unknown", "exact_alias_unknown", "subscription_quota_no_marginal_token_price", "input_usage_unknown", "output_usage_unknown", "cache_read_usage_unknown", "cache_write_usage_unknown", "unknown_price"}),
    "q_combined_costs": ("reason", {None, "no_shards", "pricing_provenance_unknown", "mixed_pricing_provenance", "one_or_more_shard_costs_unknown", "mixed_currency"}),
    "q_stage_outputs": ("violation", {None, "not_an_object", "unknown_key", "steps", "step_keys", "decision", "labels", "language", "code", "summary"}),
    "q_stage_prompts": ("lacking", {None, "policy", "code", "defect"}),
    "q_lineage_edges": ("code", {None, "missing_source_record_id", "source_not_strict_gold", "missing_seed_id", "seed_id_mismatch", "alignment_id_mismatch", "canonical_input_mismatch"}),
    "q_lineage_summary": ("kind", {"edge", "chain"}),
    "q_curation_manifest": ("section", {"raw", "disposition", "lineage", "lineage_after", "shortfall", "uncovered"}),
}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, con, name):
    df = Q.queries()[name](spark, SF)
    cur = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    rows = df.collect()
    assert rows, "an empty result proves nothing"
    if name in BRANCHES:
        column, wanted = BRANCHES[name]
        assert {x for r in rows for x in (r[column] if isinstance(r[column], list) else [r[column]])} >= wanted
    got = sorted("|".join(plain(r[c]) for c in order) for r in rows)
    assert got == sorted("|".join(plain(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall())
