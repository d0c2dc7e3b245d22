"""DataFrame operators: dedup, joins, aggregates, ordered and set operations."""
