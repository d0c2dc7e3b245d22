"""Rows whose label a fixed rule decides: is the stored label, and all that tells of it, the rule's own?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import fixture_decision, proposal_decision, proposal_label

#: The trace that rows from before explicit provenance must carry.
OLD_CHECK, OLD_EVIDENCE, OLD_ACTION = "deterministic label oracle", "The inert fixture or proposal manifest defines the gold class.", "Emit {} without executing or reconstructing payloads."
# End of fixed values.


def _first(rules: dict[str, Column]) -> Column:
    """The first code whose condition is true or unknown; null if all are false."""
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[1], F.lit(True)), F.lit(rule[0])).otherwise(rest), reversed(rules.items()), F.lit(None).cast("string"))


def canonical_proposals(proposals: Column) -> Column:
    """Proposals as JSON text with sorted keys, non-ASCII letters as they are."""
    return F.to_json(F.transform(proposals, lambda p: F.struct(p.capability.alias("capability"), p.resource_scope.alias("resource_scope"), p.side_effect.alias("side_effect"))))


def policy_row_error(proposals: Column, decision: Column, labels: Column, oracle: Column, manifest: Column, generator: str) -> Column:
    """What first shows that a tool-policy row is not the rule's; null if nothing does.

    proposals is an array of (capability, resource_scope, side_effect), labels the stored
    label of each, oracle the stored decision of the rule, manifest a struct (generator,
    executed, count, sha256 of the canonical proposals).
    """
    fields = lambda p: p.isNull() | p.capability.isNull() | p.resource_scope.isNull() | p.side_effect.isNull()
    return _first({
        "proposals_missing": proposals.isNull() | (F.size(proposals) == 0),
        "proposals_not_canonical": F.exists(proposals, fields),
        "output_differs": ~(decision.eqNullSafe(proposal_decision(proposals)) & labels.eqNullSafe(F.transform(proposals, proposal_label))),
        "oracle_differs": ~oracle.eqNullSafe(proposal_decision(proposals)),
        "manifest_missing": manifest.isNull(),
        "manifest_differs": (manifest.generator != generator) | manifest.executed | (manifest["count"] != F.size(proposals)) | (manifest.sha256 != F.sha2(canonical_proposals(proposals), 256)),
    })


def security_row_error(code: Column, decision: Column, fixture: Column, oracle: Column) -> Column:
    """What first shows that a security row is not its fixture's; null if nothing does.

    code ends in a fixture's descriptor, fixture is the stored digest of code and oracle
    the stored struct (decision, sha256 of code).
    """
    gold = fixture_decision(code)
    return _first({
        "code_missing": code.isNull() | (F.trim(code) == ""),
        "fixture_not_canonical": gold.isNull(),
        "output_differs": decision != gold,
        "fixture_differs": fixture != F.sha2(code, 256),
        "oracle_differs": oracle.isNull() | (oracle.decision != gold) | (oracle.sha256 != F.sha2(code, 256)),
    })


def disagreement_safe(bracketed: Column, target: Column, decision: Column, oracle: Column, supervision: Column, trace: Column) -> Column:
    """Whether a row whose teacher disagreed with the rule holds nothing of the teacher's.

    The last message must be the decision (in brackets where bracketed), the rule's decision
    the same.  supervision (source, normalized, agrees, trace_source), if it names a source,
    must say that the rule decided; without one, trace (check, evidence, action) must be the
    one step that older rows were given.  What is unknown is not safe.
    """
    stated = (supervision.source == "deterministic_oracle") & supervision.normalized & ~supervision.agrees & (supervision.trace_source == "deterministic_oracle")
    step = F.get(trace, F.lit(0))
    before, after = OLD_ACTION.split("{}")
    old = (F.size(trace) == 1) & (step.check == OLD_CHECK) & (step.evidence == OLD_EVIDENCE) & (step.action == F.concat(F.lit(before), decision, F.lit(after)))
    same = (F.trim(target) == F.when(bracketed, F.concat(F.lit("["), decision, F.lit("]"))).otherwise(decision)) & (oracle == decision)
    return F.coalesce(same & F.when(supervision.source.isNotNull(), stated).otherwise(old), F.lit(False))
