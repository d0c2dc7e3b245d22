"""Five documents in a row as the stage records of one seed, each made from those before it and broken by its text's length n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import FIXTURES, fixture_suffix
from ..functions.text import stable_id
from ..operators import lineage as L
from ..operators import partition as P
from ..plans.partition import partition_records
from .common import Tables, registry

QUERIES, query = registry()

_STAGES = ["plan", "tool_policy", "frontend", "review", "security"]
_SUFFIX = [f"\n\n/* {marker} descriptor-only; never execute */" for _, marker, _ in FIXTURES]

_MADE = f"""
own AS (SELECT doc_id, doc_id // 5 AS s, doc_id % 5 AS k, length(text) AS n, regexp_replace(substr(text, 1, 60), '[^a-z ]', '', 'g') AS w FROM documents WHERE doc_id >= 0),
seeds AS (
  SELECT s, max(w) FILTER (WHERE k = 0) AS w0, max(w) FILTER (WHERE k = 1) AS w1, max(CASE WHEN n % 9 = 4 THEN '<p>' || w ELSE '<main>' || w || '</main>' END) FILTER (WHERE k = 2) AS front,
         max(CASE WHEN n % 9 = 2 THEN '<i>' ELSE '' END) FILTER (WHERE k = 3) AS spoilt FROM own GROUP BY s),
records AS MATERIALIZED (
  SELECT o.doc_id AS id, o.doc_id AS line, {_STAGES!r}[k + 1] AS stage, CASE WHEN n % 16 = 3 THEN NULL WHEN n % 16 = 4 THEN 'seed-x' ELSE 'seed-' || (o.s // 2 * 2) END AS seed, 'card-' || (o.s // 2) % 7 AS card, ['axis:' || CASE WHEN n % 20 = 6 THEN 'z' ELSE 'a' END] AS tags,
         CASE WHEN n % 20 = 5 THEN 'x' WHEN o.s % 2 = 0 THEN 'alignment_' || substr(sha256('seed-' || (o.s // 2 * 2) || chr(10) || 'card-' || (o.s // 2) % 7), 1, 20) END AS alignment,
         CASE WHEN n % 14 = 9 THEN 'other' ELSE w0 END AS requirement, 5 * o.s + CASE WHEN n % 24 = 2 THEN 100000000 ELSE 0 END AS up, n % 24 = 1 AS unnamed,
         CASE WHEN n % 9 = CASE k WHEN 2 THEN 2 ELSE 1 END THEN 'other' ELSE 'P:' || w0 END AS plan, CASE WHEN n % 9 = 3 THEN 'other' ELSE 'Q:' || w1 END AS policy,
         replace(replace(front, '<main>', '<div>'), '</main>', '</div>') AS made, CASE WHEN n % 9 = 1 THEN front ELSE replace(replace(front, '<main>', '<div>'), '</main>', '</div>') END AS candidate,
         CASE k WHEN 0 THEN 'P:' || w0 WHEN 1 THEN 'Q:' || w1 WHEN 2 THEN front WHEN 3 THEN spoilt || front ELSE 'PASS' END AS output, spoilt || front AS reviewed, n % 9 <> 1 AS fixture_ok, k
  FROM own o JOIN seeds USING (s) WHERE n % 25 <> 7)"""
_LINKS = f"""
links AS (
  SELECT *, CASE WHEN unnamed THEN NULL ELSE up + j END AS source FROM (
    SELECT *, unnest(CASE k WHEN 1 THEN [0] WHEN 2 THEN [0, 1] WHEN 3 THEN [2] WHEN 4 THEN [3] ELSE [] END) AS j FROM records)),
met AS (
  SELECT d.*, u.id AS uid, u.seed AS useed, u.card AS ucard, u.tags AS utags, u.alignment AS ualign, u.requirement AS ureq, u.output AS uout, {_STAGES!r}[d.j + 1] || '->' || d.stage AS edge
  FROM links d LEFT JOIN records u ON u.id = d.source AND u.k = d.j),
contracted AS (
  SELECT *, CASE WHEN j = 2 AND NOT starts_with(uout, '<main>') THEN 'mutation_unavailable' WHEN requirement <> ureq THEN 'requirement' WHEN j = 0 AND plan <> uout THEN 'plan' WHEN j = 1 AND policy <> uout THEN 'tool_policy'
    WHEN j = 2 AND candidate <> made THEN 'candidate' WHEN j = 2 AND output <> uout THEN 'repair' WHEN j = 3 AND NOT fixture_ok THEN 'fixture' END AS contract FROM met),
edges AS MATERIALIZED (
  SELECT edge, id AS downstream_id, source AS source_id, seed, line, CASE WHEN source IS NULL THEN 'missing_source_record_id' WHEN uid IS NULL THEN 'source_not_strict_gold' WHEN seed IS NULL OR useed IS NULL THEN 'missing_seed_id' WHEN seed <> useed THEN 'seed_id_mismatch'
    WHEN (alignment IS NOT NULL OR ualign IS NOT NULL) AND NOT coalesce(alignment = ualign AND alignment = 'alignment_' || substr(sha256(seed || chr(10) || card), 1, 20) AND card = ucard AND tags = utags, false) THEN 'alignment_id_mismatch'
    WHEN contract IS NOT NULL THEN 'canonical_input_mismatch' END AS code, contract FROM contracted),
held AS (SELECT * FROM edges WHERE code IS NULL),
whole AS (
  SELECT a.downstream_id AS security_id, a.seed, a.line, d.source_id <> e.source_id AS fork FROM held a JOIN held b ON b.edge = 'frontend->review' AND a.source_id = b.downstream_id JOIN held c ON c.edge = 'tool_policy->frontend' AND b.source_id = c.downstream_id
  JOIN held d ON d.edge = 'plan->frontend' AND b.source_id = d.downstream_id JOIN held e ON e.edge = 'plan->tool_policy' AND c.source_id = e.downstream_id WHERE a.edge = 'review->security'),
chains AS (SELECT security_id, seed, CASE WHEN fork THEN 'planner_reference_fork' WHEN row_number() OVER (PARTITION BY seed, fork ORDER BY line) > 1 THEN 'duplicate_complete_chain_seed' END AS code FROM whole)"""

_RECORDS = f"{_MADE},{_LINKS}"


def _records(t: Tables) -> DataFrame:
    n, k, s = F.col("n"), F.col("k"), F.col("s")
    own = t.documents.where("doc_id >= 0").select("doc_id", F.expr("doc_id div 5").alias("s"), (F.col("doc_id") % 5).alias("k"), F.char_length("text").cast("bigint").alias("n"), F.regexp_replace(F.substring("text", 1, 60), "[^a-z ]", "").alias("w"))
    front = F.when(n % 9 == 4, F.concat(F.lit("<p>"), "w")).otherwise(F.concat(F.lit("<main>"), "w", F.lit("</main>")))
    of = lambda i, c: F.max(F.when(k == i, c))
    seeds = own.groupBy("s").agg(of(0, F.col("w")).alias("w0"), of(1, F.col("w")).alias("w1"), of(2, front).alias("front"), of(3, F.when(n % 9 == 2, "<i>").otherwise("")).alias("spoilt"))
    pair = F.expr("s div 2 * 2").cast("string")
    seed, card = F.concat(F.lit("seed-"), pair), F.concat(F.lit("card-"), F.expr("(s div 2) % 7").cast("string"))
    up = F.when(n % 24 != 1, 5 * s + F.when(n % 24 == 2, 100_000_000).otherwise(0))
    made = F.replace(F.replace("front", F.lit("<main>"), F.lit("<div>")), F.lit("</main>"), F.lit("</div>"))
    reviewed = F.concat("spoilt", "front")
    return own.where(n % 25 != 7).join(seeds, "s").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("line"), F.get(F.array(*map(F.lit, _STAGES)), k.cast("int")).alias("stage"), F.when(n % 16 == 4, "seed-x").when(n % 16 != 3, seed).alias("seed"), card.alias("card"),
        F.array(F.when(n % 20 == 6, "axis:z").otherwise("axis:a")).alias("tags"), F.when(n % 20 == 5, "x").when(s % 2 == 0, stable_id("alignment", F.concat_ws("\n", seed, card))).alias("alignment"),
        F.when(k.isin(1, 2), up).alias("plan_id"), F.when(k == 2, up + 1).alias("tool_policy_id"), F.when(k == 3, up + 2).alias("frontend_id"), F.when(k == 4, up + 3).alias("review_id"),
        F.when(n % 14 == 9, "other").otherwise(F.col("w0")).alias("requirement"), F.when(n % 9 == F.when(k == 2, 2).otherwise(1), "other").otherwise(F.concat(F.lit("P:"), "w0")).alias("plan"), F.when(n % 9 == 3, "other").otherwise(F.concat(F.lit("Q:"), "w1")).alias("policy"),
        F.when(k == 3, F.concat(F.when(n % 9 == 1, F.col("front")).otherwise(made), F.lit("\n"))).when(k == 4, F.when(n % 9 == 1, reviewed).otherwise(F.concat(reviewed, fixture_suffix(F.col("doc_id"))))).alias("code"),
        F.when(k == 0, F.concat(F.lit("P:"), "w0")).when(k == 1, F.concat(F.lit("Q:"), "w1")).when(k == 2, F.col("front")).when(k == 3, reviewed).otherwise("PASS").alias("output"))


@query(f"WITH {_RECORDS} SELECT edge, downstream_id, source_id, code, CASE WHEN code = 'canonical_input_mismatch' THEN contract END AS contract FROM edges")
def q_lineage_edges(t: Tables) -> DataFrame:
    """Each link of the five, and the first thing wrong with it."""
    return L.edges(_records(t)).select("edge", "downstream_id", "source_id", "code", "contract")


@query(f"""WITH {_RECORDS} SELECT 'edge' AS kind, edge AS name, coalesce(code, 'ok') AS code, count(*) AS rows FROM edges GROUP BY ALL
UNION ALL SELECT 'chain', 'complete', coalesce(code, 'ok'), count(*) FROM chains GROUP BY ALL""")
def q_lineage_summary(t: Tables) -> DataFrame:
    """Links by edge and code, and complete chains."""
    found = L.edges(_records(t))
    return L.lineage_summary(found, L.chains(found))


_WANT = {"plan": 30, "tool_policy": 1000000, "frontend": 20, "review": 25, "security": 0}


@query(f"""
WITH {_MADE.replace("records AS MATERIALIZED", "all_records AS MATERIALIZED")},
judged AS (SELECT *, CASE WHEN seed = 'seed-x' THEN 'reject' WHEN requirement = 'other' THEN 'negative' ELSE 'gold' END AS first_disposition FROM all_records),
parted AS MATERIALIZED (
  SELECT *, CASE WHEN first_disposition = 'gold' AND row_number() OVER (PARTITION BY first_disposition, k, output, CASE k WHEN 3 THEN candidate WHEN 4 THEN reviewed || CASE WHEN NOT fixture_ok THEN '' WHEN id % 2 = 0 THEN ' 0' ELSE ' 1' END END ORDER BY line, id) > 1 THEN 'negative' ELSE first_disposition END AS disposition FROM judged),
records AS MATERIALIZED (SELECT * FROM parted WHERE disposition = 'gold'),
{_LINKS},
summary AS (SELECT 'edge:' || edge || ':' || coalesce(code, 'ok') AS name, count(*) AS rows FROM edges GROUP BY ALL UNION ALL SELECT 'chain:complete:' || coalesce(code, 'ok'), count(*) FROM chains GROUP BY ALL),
wanted(stage, want) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _WANT.items())}),
have AS (SELECT stage, count(*) AS have FROM records GROUP BY stage),
axis_rows AS (SELECT unnest(['card', 'seed']) AS axis, unnest([card, seed]) AS value FROM records),
cells AS (SELECT axis, value, count(*) AS n FROM axis_rows GROUP BY axis, value),
shares AS (SELECT axis, sum(n) AS total, sum(n) // greatest(count(*), 5) AS share FROM cells GROUP BY axis)
SELECT 'raw' AS section, 'records' AS name, count(*)::BIGINT AS rows FROM parted
UNION ALL SELECT 'disposition', stage || ':' || disposition, count(*) FROM parted GROUP BY ALL
UNION ALL SELECT 'lineage', name, rows FROM summary UNION ALL SELECT 'lineage_after', name, rows FROM summary
UNION ALL SELECT 'shortfall', stage, want - coalesce(have, 0) FROM wanted LEFT JOIN have USING (stage) WHERE coalesce(have, 0) < want
UNION ALL SELECT 'uncovered', axis, count(*) FROM cells JOIN shares USING (axis) WHERE total >= 5 AND n < share GROUP BY axis
""")
def q_curation_manifest(t: Tables) -> DataFrame:
    """The manifest of the whole partition of the stage records."""
    quotas = t.spark.createDataFrame(sorted(_WANT.items()), "stage string, want long")
    hard, soft = P.label_array(seed=F.col("seed") == "seed-x"), P.label_array(requirement=F.col("requirement") == "other")
    content = F.concat_ws("|", "stage", "output", F.coalesce("code", F.lit("")))
    return partition_records(_records(t), hard, soft, content, quotas, ["card", "seed"], 5)[1]
