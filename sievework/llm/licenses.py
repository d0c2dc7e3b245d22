"""Licence scan with native operations only: ordered signature rules.

A text becomes its words.  A rule's regular expression runs only on texts that
hold the rule's keyword.  Places are intervals of words.  One that lies inside a
place of an equal or better rule is dropped; what stays names the licences.

Words are written with blanks around each (" w1  w2 "), so that a pattern needs
no look-around to match whole words, and two blanks are a word: the places of a
rule follow from the blanks in and between its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import BASE, CONFIDENCE, RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The tier of BASE's phrases.
BASE_TIER = 3
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(pattern: str) -> str:
    """A pattern over words parted by single blanks, for words with blanks around each."""
    return " " + pattern.replace(" ?", "( )?").replace(" ", "  ") + " "


def normal(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with blanks around each; none: empty."""
    words = F.btrim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN, "  "), F.lit(" "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")


def n_words(spaced_text: Column) -> Column:
    return ((F.char_length(spaced_text) - F.char_length(F.replace(spaced_text, F.lit(" ")))) / 2).cast("long")


def _keys(docs: DataFrame) -> DataFrame:
    """_doc (null last) and _hash tell a row; equal rows share both and their result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), F.sha2(text, 256).alias("_hash"),
                       F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))


def _places(rules: list[tuple]) -> Column:
    """Rules found in _words: number, words before each match, words of each match."""
    by_keyword: dict[str, list] = {}
    for number, (_, _, keyword, pattern) in enumerate(rules):
        by_keyword.setdefault(keyword.replace("_", " ").replace(" ", "  "), []).append(F.struct(F.lit(number).alias("rule"), F.lit(spaced(pattern)).alias("pattern")))
    known = F.create_map(*[x for k, v in by_keyword.items() for x in (F.lit(k), F.array(*v))])
    held = F.filter(F.array(*map(F.lit, by_keyword)), lambda k: F.contains(F.col("_words"), k))
    found = F.transform(F.flatten(F.transform(held, lambda k: F.element_at(known, k))), lambda r: F.struct(
        r.rule.alias("rule"), F.transform(F.split("_words", r.pattern, -1), n_words).alias("gaps"),
        F.transform(F.regexp_extract_all("_words", r.pattern, F.lit(0)), n_words).alias("sizes")))
    return F.filter(found, lambda f: F.size(f.sizes) > 0)


def _judged(docs: DataFrame, rules: list[tuple]) -> DataFrame:
    """The rows of `detections` with n_words, and one of rule -1 for each text.

    Each different row of docs is searched where it is read and grouped once; the
    windows and groups that follow keep that dealing.
    """
    words = _keys(docs).select("_doc", "_hash", normal(F.col("_text")).alias("_words"))
    hits = words.select("_doc", "_hash", n_words(F.col("_words")).alias("n_words"), _places(rules).alias("_hits")).groupBy("_doc", "_hash").agg(
        F.first("n_words").alias("n_words"), F.first("_hits").alias("_hits"))
    none = F.array(F.struct(F.lit(-1).alias("rule"), F.array(F.lit(0).cast("long")).alias("gaps"), F.array(F.lit(0).cast("long")).alias("sizes")))
    one = hits.select("_doc", "_hash", "n_words", F.explode(F.concat(none, "_hits")).alias("_hit")).select(
        "_doc", "_hash", "n_words", "_hit.rule", F.posexplode(F.arrays_zip("_hit.gaps", "_hit.sizes")).alias("_no", "_at"))
    size = F.col("_at.sizes")  # null after a rule's last match
    end = F.sum(F.col("_at.gaps") + size).over(Window.partitionBy("_doc", "_hash", "rule").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0))
    of = lambda i: F.get(F.array(*[F.lit(r[i]) for r in rules]), F.col("rule"))
    placed = one.select("_doc", "_hash", "n_words", "rule", of(0).alias("tier"), of(1).alias("label"), (end - size).alias("start"), end.alias("end")).where(F.col("end") >= F.col("start"))
    before = Window.partitionBy("_doc", "_hash").orderBy("start", F.col("end").desc(), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")  # how far the places before this one reach, of its tier or better
    for tier in sorted({r[0] for r in rules}):
        reach = F.when(F.col("tier") == tier, F.max(F.when(F.col("tier") <= tier, F.col("end"))).over(before)).otherwise(reach)
    return placed.select("_doc", "_hash", "n_words", "rule", "tier", "label", "start", "end", F.col("rule").between(0, len(BASE) - 1).alias("base"), F.coalesce(reach < F.col("end"), F.lit(True)).alias("kept"))


def detections(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """doc_id, rule, tier, label, start, end (exclusive), base, kept: each place of a rule.

    BASE's phrases are rules too, marked base.  kept is false inside a place of an
    equal or better tier; of equal places the best tier's first rule is kept.  Equal
    rows of docs give their places once.  Null and empty texts have none.
    """
    return _judged(docs, _with_base(rules)).where(F.col("rule") >= 0).select(
        F.when(F.col("_doc") < (1 << 63) - 1, F.col("_doc")).alias("doc_id"), "rule", "tier", "label", "start", "end", "base", "kept")


def _with_base(rules: list[tuple]) -> list[tuple]:
    return [(BASE_TIER, label, phrase, phrase) for phrase, label in BASE] + rules


def scan_licenses(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs.

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased, numbered
    from 0.  n_base counts the places of BASE's phrases, from first_word to last_word
    (null if there are none).  labels holds those of BASE and of the places that
    `detections` keeps; labels and base_labels hold each once, sorted, comma-joined.
    score is the best confidence of a label, 0 without one.  Null and empty texts have
    no words and no labels.  Rows of null or repeated doc_id are each judged by their
    own text; equal rows have equal results.  Whole texts are searched, however long;
    a document's places are sorted, not compared in pairs.  Other columns are not
    read.  An empty table gives no rows.
    """
    confidence = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("tier"))
    label = lambda rows: F.array_join(F.array_sort(F.collect_set(F.when(rows, F.col("label")))), ",")
    base_start = F.when(F.col("base"), F.col("start"))
    found = _judged(docs, _with_base(rules)).groupBy(F.col("_doc").alias("_d"), F.col("_hash").alias("_h")).agg(
        F.first("n_words").alias("n_words"), F.count_if("base").alias("n_base"), F.min(base_start).alias("first_word"), F.max(base_start).alias("last_word"),
        label(F.col("base")).alias("base_labels"), label(F.col("base") | F.col("kept")).alias("labels"), F.coalesce(F.max(confidence), F.lit(0.0)).alias("score"))
    return _keys(docs).select("_doc", "_hash", "doc_id").join(found, (F.col("_doc") == F.col("_d")) & (F.col("_hash") == F.col("_h"))).drop("_doc", "_hash", "_d", "_h")


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rules = _with_base(RULES)
    values = ", ".join(f"({i}, {t}, {quote(name)}, {quote(k.replace(' ', '  ').replace('_', '  '))}, {quote(spaced(p))}, {CONFIDENCE[t]}::DOUBLE)" for i, (t, name, k, p) in enumerate(rules))
    reach = " ".join(f"WHEN {t} THEN max(CASE WHEN tier <= {t} THEN e END) OVER w" for t in CONFIDENCE)
    return rf"""
WITH cleaned AS MATERIALIZED (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BETWEEN}', '  ', 'g'), ' ') AS words FROM documents),
spaced AS MATERIALIZED (SELECT doc_id, CASE WHEN words = '' THEN '' ELSE ' ' || words || ' ' END AS words FROM cleaned),
rules(rule, tier, label, keyword, pattern, confidence) AS (VALUES {values}),
held AS (SELECT * FROM spaced JOIN rules ON contains(words, keyword)),
cut AS (
  SELECT doc_id, rule, tier, label, confidence, unnest(regexp_extract_all(words, pattern)) AS hit,
         unnest(string_split_regex(words, pattern)[:-2]) AS gap, unnest(range(len(regexp_extract_all(words, pattern)))) AS no
  FROM held WHERE regexp_matches(words, pattern)),
counted AS (SELECT *, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS size, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS apart FROM cut),
placed AS (SELECT *, sum(apart + size) OVER (PARTITION BY doc_id, rule ORDER BY no) AS e FROM counted),
judged AS (
  SELECT *, e - size AS s, coalesce(CASE tier {reach} END < e, true) AS kept FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY e - size, e DESC, tier, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (
  SELECT doc_id, count_if(rule < {len(BASE)}) AS n, min(s) FILTER (WHERE rule < {len(BASE)}) AS first, max(s) FILTER (WHERE rule < {len(BASE)}) AS last, max(confidence) AS score,
         array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE rule < {len(BASE)})), ',') AS base, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE rule < {len(BASE)} OR kept)), ',') AS labels
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, ((length(words) - length(replace(words, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
       coalesce(base, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM spaced d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
