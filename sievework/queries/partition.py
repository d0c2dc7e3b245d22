"""Dispositions, coverage, conflict-checked union, leakage and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import leakage as K
from ..operators import similar as V
from ..operators import partition as P
from .common import registry

QUERIES, query = registry()


def dispositions(t):
    """doc_id, lang, disposition and labels: toxic rows and empty texts are rejected,
    copies and rows without a good label are negative."""
    d = D.duplicate_counts(t.documents.select("doc_id", "lang", "text", F.sha2("text", 256).alias("k")), "k").join(t.labels, "doc_id", "left")
    hard = P.label_array(toxic=F.col("toxic") == 1, empty=F.trim("text") == "")
    soft = P.label_array(duplicate_text=F.col("copies") > 1, low_quality=F.col("quality") == 0)
    return P.disposed(d, hard, soft)


_DISPOSED = r"""WITH d AS (SELECT d.doc_id, d.lang, d.text, coalesce(toxic = 1, false) AS toxic, trim(text) = '' AS empty, count(*) OVER (PARTITION BY text) > 1 AS dup, coalesce(quality = 0, false) AS low FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
x AS (SELECT *, CASE WHEN toxic OR empty THEN 'reject' WHEN dup OR low THEN 'negative' ELSE 'gold' END AS disposition, list_filter([CASE WHEN dup THEN 'duplicate_text' END, CASE WHEN empty THEN 'empty' END, CASE WHEN low THEN 'low_quality' END, CASE WHEN toxic THEN 'toxic' END], lambda v: v IS NOT NULL) AS labels FROM d)
"""


@query(_DISPOSED + "SELECT lang, disposition, count(*)::BIGINT AS n FROM x GROUP BY 1, 2")
def q_disposition(t):
    return dispositions(t).groupBy("lang", "disposition").agg(F.count("*").alias("n"))


@query(_DISPOSED + "SELECT doc_id, disposition, labels FROM x")
def q_disposition_rows(t):
    return dispositions(t).select("doc_id", "disposition", "labels")


@query(_DISPOSED + "SELECT sha256('reject:' || doc_id) AS id, sha256(text) AS source_record_sha256, labels AS reason_codes, false AS content_retained FROM x WHERE disposition = 'reject'")
def q_rejects(t):
    return P.split(dispositions(t), F.col("text"), "doc_id")["reject"]


@query(_DISPOSED + "SELECT label, count(*)::BIGINT AS n FROM (SELECT unnest(labels) AS label FROM x) GROUP BY label")
def q_reason_histogram(t):
    return dispositions(t).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(_DISPOSED + "SELECT count(*)::BIGINT AS raw, count(*) = count_if(disposition = 'gold') + count_if(disposition = 'negative') + count_if(disposition = 'reject') AS balanced FROM x")
def q_balance(t):
    d = F.col("disposition")
    return dispositions(t).agg(F.count("*").alias("raw"), (F.count("*") == F.count_if(d == "gold") + F.count_if(d == "negative") + F.count_if(d == "reject")).alias("balanced"))


@query(r"""WITH p AS (SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS prompts, count(DISTINCT source) AS seeds, count_if(regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b')) AS bad FROM documents GROUP BY lang),
s AS (SELECT sum(n)::BIGINT AS records, sum(least(seeds, 18))::BIGINT AS successful, sum(greatest(n - ids, n - prompts))::BIGINT AS duplicate_count, sum(bad)::BIGINT AS safety_violations FROM p)
SELECT records, successful, duplicate_count, safety_violations, successful / 72 AS success_rate, duplicate_count / records AS duplicate_rate, successful / 72 >= 0.9 AND duplicate_count / records <= 0.1 AND safety_violations = 0 AS passed FROM s""")
def q_gate(t):
    return P.gate(t.documents, "lang", "doc_id", F.col("text"), "source", 18, 4, F.col("text").rlike(r"\bAKIA[0-9A-Z]{16}\b"), 0.9, 0.1)


@query(r"""WITH l AS (SELECT 'lang' AS axis, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT axis, value, count(*) AS n FROM l GROUP BY 1, 2), a AS (SELECT axis, sum(n) AS total, count(*) AS k FROM c GROUP BY 1)
SELECT axis, value, n::BIGINT AS n, CASE WHEN total >= 16 THEN n >= floor(total / greatest(k, 16)) ELSE true END AS covered FROM c JOIN a USING (axis)""")
def q_axis_coverage(t):
    return P.axis_coverage(t.documents, ["lang", "source"], 16)


@query(r"""SELECT count(*)::BIGINT AS input_rows, (SELECT count(*) FROM documents)::BIGINT AS output_rows, 0::BIGINT AS id_conflicts, (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1))::BIGINT AS content_conflicts,
(SELECT count(*) FROM (SELECT source, lang FROM documents GROUP BY 1, 2 HAVING count(*) > 1))::BIGINT AS key_conflicts, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0)::BIGINT AS eliminated
FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0)""")
def q_conflict_union(t):
    d = t.documents.select("doc_id", "text", "source", "lang")
    return D.conflict_union([d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), d.where("doc_id % 3 = 0")], "doc_id", F.col("text"), ["source", "lang"], check=False)[1]


@query(r"""SELECT count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def q_insert_only(t):
    d = t.documents.select("doc_id")
    return D.insert_only(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), "doc_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(r"""SELECT count(DISTINCT text)::BIGINT AS n FROM documents""")
def q_content_union(t):
    d = t.documents.select("doc_id", "text")
    return D.content_union(d.where("doc_id % 2 = 0"), d, F.col("text")).agg(F.count("*").alias("n"))


#: Held-out texts: the benchmark, and every hundredth document with its middle tenth replaced.
_HELD = r"""SELECT item_id::VARCHAR AS item_id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, substr(text, 1, (length(text) * 45 // 100)::INT) || ' altered ' || substr(text, (length(text) * 55 // 100)::INT + 1) FROM documents WHERE doc_id % 100 = 0"""
_WORDED = r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')"


@query(rf"""WITH h AS (SELECT item_id, {_WORDED} AS a FROM ({_HELD})), d AS (SELECT text, {_WORDED} AS b FROM documents)
SELECT DISTINCT sha256(item_id::VARCHAR) AS held_sha256, sha256(text) AS source_sha256, 'normalized_exact' AS match_type, 1.0::DOUBLE AS similarity FROM h, d
WHERE length(a) > 0 AND length(b) > 0 AND (a = b OR (length(a) >= 24 AND contains(b, a)) OR (length(b) >= 24 AND contains(a, b)))""")
def q_leak_containment(t):
    return _leaks(t, False).where("match_type = 'normalized_exact'")


@query(rf"""WITH h AS (SELECT item_id, {_WORDED} AS a FROM ({_HELD})), d AS (SELECT text, {_WORDED} AS b FROM documents),
p AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM h, d WHERE length(a) BETWEEN length(b) * 0.4 AND length(b) * 2.5 AND NOT (a = b OR (length(a) >= 24 AND contains(b, a)) OR (length(b) >= 24 AND contains(a, b)))),
g AS (SELECT *, CASE WHEN least(len(x), len(y)) >= 5 THEN list_distinct(list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i+2], ' '))) ELSE list_distinct(x) END AS gx,
 CASE WHEN least(len(x), len(y)) >= 5 THEN list_distinct(list_transform(range(1, len(y) - 1), lambda i: array_to_string(y[i:i+2], ' '))) ELSE list_distinct(y) END AS gy FROM p),
s AS (SELECT item_id, text, len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))) AS score FROM g)
SELECT DISTINCT sha256(item_id::VARCHAR) AS held_sha256, sha256(text) AS source_sha256, round(score, 6) AS similarity FROM s WHERE score >= 0.3""")
def q_leak_jaccard(t):
    return _leaks(t, False, 0.3).where("match_type <> 'normalized_exact'").drop("match_type")


@query(None)
def q_leak_full(t):
    return _leaks(t, True)


@query(None)
def q_curriculum(t):
    """Tasks that break a rule: repeated seeds, active payloads, likeness to a held-out text (see `_leaks`)."""
    tasks = t.documents.select(F.col("doc_id").alias("task_id"), F.when(F.col("doc_id") % 50 == 7, F.lit(7)).otherwise(F.col("doc_id")).alias("seed_id"), "text")
    return V.curriculum_codes(tasks, _held(t).select(F.col("id").alias("held_id"), "text"), ["<script src=http", "powershell -enc", "curl http", "wget http"]).where(F.size("codes") > 0).select(
        "task_id", F.array_join("codes", ",").alias("codes"))


def _held(t):
    altered = t.documents.where("doc_id % 100 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.expr(
        "substr(text, 1, length(text) * 45 div 100) || ' altered ' || substr(text, CAST(length(text) * 55 div 100 AS INT) + 1)").alias("text"))
    return t.benchmark.select(F.col("item_id").cast("string").alias("id"), "text").unionByName(altered)


def _leaks(t, sequence, threshold=0.86):
    return K.collisions(_held(t), t.documents.select("text"), threshold, sequence)


@query(r"""WITH a AS (SELECT source, count_if(lang = 'en') AS en, count(*) AS n FROM documents GROUP BY source) SELECT source, {'lang_shortfall': greatest(40 - en, 0)::BIGINT, 'row_shortfall': greatest(60 - n, 0)::BIGINT} AS deficits FROM a""")
def q_deficits(t):
    a = t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count("*").alias("n"))
    return a.select("source", P.deficits(lang_shortfall=40 - F.col("en"), row_shortfall=60 - F.col("n")).alias("deficits"))


@query(_DISPOSED + r""", g AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('11:' || doc_id)) AS n FROM x WHERE disposition = 'gold') SELECT lang, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY n)) AS digest FROM g WHERE n <= 25 GROUP BY lang""")
def q_snapshot(t):
    from ..operators.ordered import hash_ordered_top

    chosen = hash_ordered_top(dispositions(t).where("disposition = 'gold'").select("lang", "doc_id"), "lang", "doc_id", 25, 11)
    return A.ordered_digest(chosen.withColumn("d", F.col("doc_id").cast("string")), ["lang"], "rank", "d")


@query(r"""SELECT lang, count(*)::BIGINT AS n, count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))::BIGINT AS prompts FROM documents GROUP BY lang""")
def q_frequency(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct(T.collapsed(F.col("text"))).alias("prompts"))
