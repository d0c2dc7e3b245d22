"""Operators applied to the driver's tables, each with DuckDB SQL where it can
express them.  The tables stand in for record logs: documents for training
records, benchmark for held-out cases, labels for decisions, conversations for
sessions, pages for artifacts, events for telemetry, the order tables for lineage."""

from . import aggregates, gates, jobs, joins, ledger, lineage, oracles, ordered, partition, pricing, records, replay, scalars, sessions, stages, streams

_ALL = {**scalars.QUERIES, **joins.QUERIES, **aggregates.QUERIES, **ordered.QUERIES, **partition.QUERIES, **records.QUERIES, **jobs.QUERIES, **streams.QUERIES, **sessions.QUERIES, **gates.QUERIES, **ledger.QUERIES, **replay.QUERIES, **oracles.QUERIES, **pricing.QUERIES, **stages.QUERIES, **lineage.QUERIES}


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
