"""Gates over documents, their labels and sources as training rows of four languages and one that is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import gates as G
from .common import Tables, registry

QUERIES, query = registry()

EXPERTS = ["en", "de", "fr", "it"]
#: What SQL can match: these checks' patterns need no look-around.
PLAIN = [c for c in G.checks() if c not in ("secret_material", "active_payload")]

_ROWS = "rows AS (SELECT lang AS expert, d.doc_id AS id, text, quality AS label, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_GATE = f"""
{_ROWS},
made AS (
  SELECT expert, count(*)::DOUBLE AS rows_low, count_if(id IS NULL)::DOUBLE AS id_missing, (count(id) - count(DISTINCT id))::DOUBLE AS id_repeated, count_if(text IS NULL)::DOUBLE AS text_missing,
         count_if(length(trim(text)) < 1)::DOUBLE AS text_short, count_if(length(text) > 20000)::DOUBLE AS text_long, (count(text) - count(DISTINCT text))::DOUBLE AS text_repeated,
         count_if(regexp_matches(text, '[\\x00-\\x08]'))::DOUBLE AS control_text, count_if(source IS NULL)::DOUBLE AS source_missing, count_if(label NOT IN (0, 1))::DOUBLE AS label_unknown,
         count(label) / count(*) AS labelled_low, CASE WHEN count(label) > 0 THEN greatest(count_if(label = 1), count_if(label = 0)) / count(label) ELSE 0 END::DOUBLE AS label_one_sided_share,
         coalesce(avg(length(text)), 0)::DOUBLE AS mean_chars_low FROM rows GROUP BY expert),
judged AS (
  SELECT expert, code, value, bound, CASE WHEN value IS NULL THEN true WHEN code LIKE '%_low' THEN value >= bound ELSE value <= bound END AS passed
  FROM (SELECT e.expert, unnest([{", ".join(f"{{'code': '{c}', 'value': {'coalesce(rows_low, 0)' if c == 'rows_low' else c}, 'bound': {G.checks()[c][2]}::DOUBLE}}" for c in PLAIN)}], recursive := true)
        FROM (SELECT unnest({EXPERTS!r}) AS expert) e LEFT JOIN made ON made.expert = e.expert)
  UNION ALL SELECT 'all', 'expert_unknown', count_if(expert IS NULL OR NOT list_contains({EXPERTS!r}, expert))::DOUBLE, 0, count_if(expert IS NULL OR NOT list_contains({EXPERTS!r}, expert)) <= 0 FROM rows)"""


def _gate(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id", "left").select(F.col("lang").alias("expert"), F.col("doc_id").alias("id"), "text", "label", "source")
    return G.gate(rows, EXPERTS, {c: k for c, k in G.checks().items() if c in PLAIN})


@query(f"WITH {_GATE} SELECT * FROM judged")
def q_readiness(t: Tables) -> DataFrame:
    """Each check of each language's training rows."""
    return _gate(t)


@query(f"WITH {_GATE} SELECT count_if(NOT passed) = 0 AS ready, count(*) AS checks, list_sort(list(DISTINCT code || ':' || expert) FILTER (WHERE NOT passed)) AS blockers FROM judged")
def q_blockers(t: Tables) -> DataFrame:
    """Whether the rows are ready, and what blocks them."""
    return G.verdict(_gate(t))


@query("""
WITH arms AS (SELECT source, max(length(text)) > 0 AS has_text, count(DISTINCT lang) AS langs, min(lang) AS first_lang, count(*) AS rows FROM documents GROUP BY source)
SELECT unnest(['has_text', 'langs', 'first_lang', 'rows']) AS field, unnest([count(DISTINCT has_text), count(DISTINCT langs), count(DISTINCT first_lang), count(DISTINCT rows)]) AS values,
       unnest([count(DISTINCT has_text) = 1, count(DISTINCT langs) = 1, count(DISTINCT first_lang) = 1, count(DISTINCT rows) = 1]) AS passed FROM arms
""")
def q_fair_arms(t: Tables) -> DataFrame:
    """In which figures the sources, as arms of a comparison, agree."""
    arms = t.documents.groupBy("source").agg((F.max(F.length("text")) > 0).alias("has_text"), F.count_distinct("lang").alias("langs"), F.min("lang").alias("first_lang"), F.count("*").alias("rows"))
    return G.fair(arms, ["has_text", "langs", "first_lang", "rows"])
