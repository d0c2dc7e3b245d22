"""The failure ledger over events: an error of a user is a failure of one of five stages, ten days an epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger as L
from .common import Tables, registry

QUERIES, query = registry()
LIMIT = 2
SPARED = ["cancelled"]

_FAILURES = """
failures AS (SELECT user_id AS seed, event_id % 5 AS stage, (date_part('day', ts)::BIGINT - 1) // 6 AS epoch, strftime(ts, '%Y-%m-%d') AS report,
  CASE WHEN value > 320 THEN 'cancelled' WHEN value < 5 THEN NULL ELSE 'server' END AS error_class FROM events WHERE event_type = 'error'),
charged AS (SELECT seed, stage, epoch, count(DISTINCT report) AS reports, count(*) AS failures FROM failures WHERE error_class <> 'cancelled' GROUP BY ALL),
book AS (SELECT seed, stage, count(*) AS attempts, min(epoch) AS first_epoch, max(epoch) AS last_epoch, list_sort(list(epoch))[3] AS quarantined_epoch FROM charged GROUP BY ALL)"""


def _charges(t: Tables) -> DataFrame:
    failures = t.events.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("seed"), (F.col("event_id") % 5).alias("stage"), F.expr("(day(ts) - 1) div 6").alias("epoch"), F.date_format("ts", "yyyy-MM-dd").alias("report"),
        F.when(F.col("value") > 320, "cancelled").when(F.col("value") >= 5, "server").alias("error_class"))
    return L.charges(failures, SPARED)


@query(f"WITH {_FAILURES} SELECT * FROM charged")
def q_charges(t: Tables) -> DataFrame:
    """What each key is charged in an epoch."""
    return _charges(t)


@query(f"WITH {_FAILURES} SELECT * FROM book")
def q_failure_ledger(t: Tables) -> DataFrame:
    """Each key's attempts, and the epoch that put it into quarantine."""
    return L.ledger(_charges(t), LIMIT)


@query(f"""WITH {_FAILURES},
items AS (SELECT DISTINCT user_id AS seed, event_id % 5 AS stage FROM events),
least AS (SELECT seed, min(stage) AS s FROM book WHERE quarantined_epoch IS NOT NULL GROUP BY seed)
SELECT i.seed, i.stage, CASE WHEN b.quarantined_epoch IS NOT NULL THEN 'quarantined' WHEN i.stage > l.s THEN 'downstream' ELSE 'open' END AS state,
       CASE WHEN b.quarantined_epoch IS NOT NULL OR i.stage > l.s THEN l.s END AS blocked_by
FROM items i LEFT JOIN book b ON i.seed = b.seed AND i.stage = b.stage LEFT JOIN least l ON i.seed = l.seed""")
def q_quarantine_cascade(t: Tables) -> DataFrame:
    """Which stages of each seed are open, quarantined, or out of reach behind one that is."""
    items = t.events.select(F.col("user_id").alias("seed"), (F.col("event_id") % 5).alias("stage")).distinct()
    return L.cascade(items, L.ledger(_charges(t), LIMIT))
