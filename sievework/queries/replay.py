"""Pages as code of a frontend stage, and reviews made of them; each review goes wrong by its page's length n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mutated
from ..operators import replay as R
from .common import Tables, listed, pick, registry
from .scalars import HTML_SAMPLES

QUERIES, query = registry()

_ARIA = r"""(?i)\s+aria-label\s*=\s*("[^"'']+"|''[^"'']+'')"""


def _mutated_sql(rule: str, code: str) -> str:
    """The code after a rule; null where it does not apply."""
    if rule == "remove_literal_aria_label":
        return f"CASE WHEN regexp_matches({code}, '{_ARIA}') THEN regexp_replace({code}, '{_ARIA}', '') END"
    tag = rule.split("_")[1]
    return f"CASE WHEN regexp_matches({code}, '(?i)<{tag}[\\s>]') AND regexp_matches({code}, '(?i)</{tag}\\s*>') THEN regexp_replace(regexp_replace({code}, '(?i)<{tag}([\\s>])', '<div\\1'), '(?i)</{tag}\\s*>', '</div>') END"


_CANONICAL = "trim(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"
_FAILURES = f"""
pages_of AS (SELECT page_id AS id, page_id % 40 AS seed, length(html) AS n, CASE WHEN length(html) % 37 = 3 THEN '  ' ELSE {listed(HTML_SAMPLES, 'page_id')} || html END AS code FROM pages),
ruled AS MATERIALIZED (
  SELECT *, {_mutated_sql('remove_literal_aria_label', 'code')} AS aria, {_mutated_sql('semantic_main_to_div', 'code')} AS main, {_mutated_sql('semantic_h1_to_div', 'code')} AS h1,
         CASE WHEN regexp_matches(code, '{_ARIA}') THEN 'remove_literal_aria_label' WHEN regexp_matches(code, '(?i)<main[\\s>]') THEN 'semantic_main_to_div' WHEN regexp_matches(code, '(?i)<h1[\\s>]') THEN 'semantic_h1_to_div' END AS first_rule
  FROM pages_of),
made AS MATERIALIZED (SELECT *, CASE first_rule WHEN 'remove_literal_aria_label' THEN aria WHEN 'semantic_main_to_div' THEN main ELSE h1 END AS first_code FROM ruled),
reviews AS (
  SELECT id, seed + CASE WHEN n % 7 = 3 THEN 1 ELSE 0 END AS seed, CASE WHEN n % 11 = 1 THEN NULL WHEN n % 11 = 2 THEN -1 - id ELSE id END AS source,
         CASE WHEN n % 4 = 1 THEN 'semantic_h1_to_div' END AS rule, CASE WHEN n % 13 = 4 THEN NULL WHEN n % 5 = 2 THEN code ELSE coalesce(first_code, code) || chr(10) END AS candidate,
         first_rule AS m_rule, sha256(code) AS m_before, sha256(CASE WHEN n % 6 = 5 THEN code ELSE first_code END) AS m_after,
         CASE WHEN n % 17 = 6 THEN NULL WHEN n % 9 = 5 THEN first_code ELSE code || chr(13) || chr(10) END AS answer FROM made),
met AS (
  SELECT r.*, f.id AS fid, f.seed AS fseed, CASE WHEN trim(f.code) <> '' THEN f.code END AS fcode, CASE WHEN rule IS NULL THEN f.first_rule ELSE rule END AS new_rule, CASE WHEN rule IS NULL THEN f.first_code ELSE f.h1 END AS new_code
  FROM reviews r LEFT JOIN made f ON r.source = f.id),
judged AS (
  SELECT *, source IS NOT NULL AND fid IS NULL AS lost, fid IS NOT NULL AND (fcode IS NULL OR candidate IS NULL) AS invalid,
         fcode IS NOT NULL AND candidate IS NOT NULL AS valid, fcode IS NOT NULL AND candidate IS NOT NULL AND new_code IS NOT NULL AS replayed FROM met),
failures AS (
  SELECT 'frontend' AS stage, id, ['missing_artifact'] AS codes FROM pages_of WHERE trim(code) = ''
  UNION ALL SELECT * FROM (
    SELECT 'review', id, list_filter([
      CASE WHEN source IS NULL THEN 'missing_provenance' END, CASE WHEN lost THEN 'source_missing' END, CASE WHEN fid IS NOT NULL AND seed IS DISTINCT FROM fseed THEN 'source_seed_mismatch' END,
      CASE WHEN invalid THEN 'source_or_candidate_invalid' END, CASE WHEN valid AND NOT replayed THEN 'mutation_unavailable' END,
      CASE WHEN replayed AND ({_CANONICAL.format('candidate')} IS DISTINCT FROM {_CANONICAL.format('new_code')} OR m_rule IS DISTINCT FROM new_rule OR m_before IS DISTINCT FROM sha256(fcode) OR m_after IS DISTINCT FROM sha256(new_code)) THEN 'candidate_not_canonical' END,
      CASE WHEN replayed AND {_CANONICAL.format('answer')} IS DISTINCT FROM {_CANONICAL.format('fcode')} THEN 'source_not_restored' END,
      CASE WHEN answer IS NULL OR trim(answer, ' ' || chr(10) || chr(13)) = '' THEN 'missing_artifact' END], lambda x: x IS NOT NULL) AS codes FROM judged) WHERE len(codes) > 0)"""


def _failures(t: Tables) -> DataFrame:
    n = F.char_length("html").cast("bigint")
    pages = t.pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 40).alias("seed"), n.alias("n"), F.lit(0).alias("line"), F.when(n % 37 == 3, "  ").otherwise(F.concat(pick(HTML_SAMPLES, "page_id"), "html")).alias("code"))
    rule, after, _ = mutated(F.col("code"))
    n = F.col("n")
    reviews = pages.withColumns({"_rule": rule, "_after": after}).select(
        "id", (F.col("seed") + F.when(n % 7 == 3, 1).otherwise(0)).alias("seed"), F.when(n % 11 == 2, -1 - F.col("id")).when(n % 11 != 1, F.col("id")).alias("source"), F.when(n % 4 == 1, "semantic_h1_to_div").alias("rule"),
        F.when(n % 13 != 4, F.when(n % 5 == 2, F.col("code")).otherwise(F.concat(F.coalesce("_after", "code"), F.lit("\n")))).alias("candidate"),
        F.struct(F.col("_rule").alias("rule"), F.sha2("code", 256).alias("before"), F.sha2(F.when(n % 6 == 5, F.col("code")).otherwise(F.col("_after")), 256).alias("after")).alias("mutation"),
        F.when(n % 17 != 6, F.when(n % 9 == 5, F.col("_after")).otherwise(F.concat("code", F.lit("\r\n")))).alias("code"))
    return R.artifact_failures(pages, reviews)


@query(f"WITH {_FAILURES} SELECT * FROM failures")
def q_artifact_failures(t: Tables) -> DataFrame:
    """All that is wrong with each page's row and its review, the mutation made anew."""
    return _failures(t)


@query(f"WITH {_FAILURES} SELECT stage, code, count(*) AS rows, count_if(one)::BIGINT AS alone FROM (SELECT stage, unnest(codes) AS code, len(codes) = 1 AS one FROM failures) GROUP BY stage, code")
def q_artifact_failure_counts(t: Tables) -> DataFrame:
    """How many rows have each code, and how many nothing else."""
    return R.failure_counts(_failures(t))
