"""The registered queries of these operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = None


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; TOKENIZERS may name another folder."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The session's spark.sievework.pseudonym.secret, which Spark redacts by its name, or
    spark.sievework.pseudonym.key.  Without one the registered queries use a public key,
    so that their results can be compared: no protection at all."""
    return spark.conf.get("spark.sievework.pseudonym.secret", None) or spark.conf.get("spark.sievework.pseudonym.key", None) or "public key of the registered queries"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("_kept", 256).alias("kept_sha256"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark)).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_masked").alias("text"), "n_found", "pseudonyms")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_codec import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(_table(spark, sf_dir, "embeddings"))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read, write

    return read(write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digest, periodic_runs, planted

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(periodic_runs(docs, planted(F.col("doc_id"), F.col("text"))))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) < max(doc_id)),
judged AS (
  SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND k.doc_id > f.first AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: crc32 has no function there: its table by rule, a step a byte.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i::BIGINT))"""
OP11_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT CRC_TABLE AS step),
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii((doc_id::VARCHAR)[j])::BIGINT),
                         lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents, crc),
planned AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM hashed),
words AS MATERIALIZED (
  SELECT doc_id, n, i, w[1 + CASE WHEN made AND i >= a THEN a + (i - a) % (1 + (n - a) // d) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM planned)),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, m, min(q) AS q FROM stretches GROUP BY doc_id, s, m),
dropped AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, kind, max(e) OVER (PARTITION BY doc_id ORDER BY i, kind) AS e FROM (
      SELECT doc_id, s + q AS i, 0 AS kind, s + m AS e FROM runs UNION ALL SELECT doc_id, i, 1, NULL FROM words WHERE doc_id IN (SELECT doc_id FROM runs)))
  WHERE kind = 1 AND i < e),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM dropped) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, max({'m': m, 's': -s, 'q': -q}) AS best,
         string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.m::BIGINT AS length, (-best.q)::BIGINT AS period,
       (1000 * best.m // -best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
""".replace("CRC_TABLE", CRC_TABLE)


OP13_SQL = r"""
WITH crc AS MATERIALIZED (SELECT CRC_TABLE AS step),
texts AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
words AS MATERIALIZED (
  SELECT own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS MATERIALIZED (
  SELECT own, doc_id, f, count(*) AS n FROM (
    SELECT own, doc_id, unnest(w) AS f FROM words
    UNION ALL SELECT own, doc_id, unnest(list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    UNION ALL SELECT own, doc_id, unnest(list_transform(range(1, len(w)::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words)
  GROUP BY own, doc_id, f),
bytes AS (
  SELECT f, list_transform(range(1, octet_length(encode(f))::BIGINT + 1), lambda j: ('0x' || substr(hex(encode(f)), 2 * j - 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT f FROM grams)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc),
counted AS (SELECT bucket, sum(n) FILTER (WHERE own) AS s, sum(n) FILTER (WHERE NOT own) AS t FROM grams JOIN hashed USING (f) GROUP BY bucket),
full_counts AS (SELECT r.bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range(10000) r(bucket) LEFT JOIN counted c ON c.bucket = r.bucket),
sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM full_counts),
gains AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM full_counts, sums),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM grams JOIN hashed USING (f) JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM words w LEFT JOIN weights x ON w.doc_id = x.doc_id WHERE own),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER () // 100 AS draw FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= draw THEN r END::BIGINT AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
""".replace("CRC_TABLE", CRC_TABLE)


#: Seeded ranks within a source and the order of their fractions; a CRC step a byte of each text.
OP2_SQL = r"""
WITH crc AS MATERIALIZED (SELECT CRC_TABLE AS step),
bytes AS (SELECT DISTINCT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents WHERE text <> ''),
hashed AS MATERIALIZED (SELECT text, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM bytes, crc),
slim AS (
  SELECT doc_id, coalesce(octet_length(encode(d.text)), 0) + 8 AS size, coalesce(crc, 0) AS text_crc32, source, md5('interleave:' || coalesce(doc_id::VARCHAR, 'null')) AS o
  FROM documents d LEFT JOIN hashed h ON d.text = h.text),
placed AS (
  SELECT *, (row_number() OVER w - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction, row_number() OVER w AS r FROM slim
  WINDOW w AS (PARTITION BY source ORDER BY o, doc_id NULLS FIRST, text_crc32)),
dealt AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, r) - 1 AS pos, count(*) OVER () AS total FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, source, 'rows' AS law, (pos * 24 // total)::INT AS shard,
       (pos - ((pos * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM dealt
""".replace("CRC_TABLE", CRC_TABLE)


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_sharding": op2_sharding, "op3_fingerprints": op3_fingerprints, "op4_line_dedup": op4_line_dedup,
            "op5_pseudonyms": op5_pseudonyms, "op6_language": op6_language, "op7_sentencepiece": op7_sentencepiece, "op8_kmeans_tree": op8_kmeans_tree, "op9_wavelet": op9_wavelet, "op10_ngram_join": op10_ngram_join,
            "op11_word_runs": op11_word_runs, "op12_license_scan": op12_license_scan, "op13_resampling": op13_resampling}


def oracle_sql() -> dict[str, str]:
    from .licenses import oracle

    return {"op2_sharding": OP2_SQL, "op4_line_dedup": OP4_SQL, "op11_word_runs": OP11_SQL, "op12_license_scan": oracle(), "op13_resampling": OP13_SQL}
