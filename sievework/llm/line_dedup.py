"""Line dedup with native operations only.

Line keys become 128-bit hashes.  (hash, salt of the document) is dealt by range
and sorted by document and position within it; a streaming window passes the
first document on, so every later document's lines drop at once.  The first
documents of a hash under its salts - at most SALTS, however frequent the line
is - meet in a second window, which keeps the smallest.  What drops returns as a
bitmap for each document: 64 lines a word, and only words in which a line drops
are stored.  Texts move once, to meet their bitmap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A line found in a third of all documents is dealt to so many groups.
SALTS = 64
_SPACE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _identified(docs: DataFrame) -> DataFrame:
    """_doc orders rows (null last); _doc and _text_hash tell a row, and equal
    rows share both, as they share every decision."""
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("_row")).select(
        "_row", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), text.alias("_text"), F.xxhash64(text).alias("_text_hash"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """_doc, _text_hash, keep map<int, bigint>, n_dropped of documents that lose lines.

    Bit i of word w says whether line 64 * w + i stays; a missing word keeps all.
    """
    lines = _identified(docs).select("_doc", "_text_hash", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    key = F.translate(F.btrim("_line", F.lit(_SPACE)), _UPPER, _UPPER.lower())
    hashed = lines.withColumn("_key", key).where(F.char_length("_key") >= min_chars).select(
        F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), "_doc", "_text_hash", "_pos",
        F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int").alias("_salt"))
    dealt = materialize(hashed, "lines").repartitionByRange("_h1", "_h2", "_salt")
    stream = Window.partitionBy("_h1", "_h2", "_salt").orderBy("_doc", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    first = dealt.withColumn("_first", F.first("_doc").over(stream))
    later = first.where(F.col("_doc") > F.col("_first")).select("_doc", "_text_hash", "_pos")
    heads = first.where(F.col("_doc") == F.col("_first")).withColumn("_first", F.min("_doc").over(Window.partitionBy("_h1", "_h2")))
    dropped = later.unionByName(heads.where(F.col("_doc") > F.col("_first")).select("_doc", "_text_hash", "_pos"))
    words = dropped.groupBy("_doc", "_text_hash", F.expr("_pos div 64").cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits"))
    return words.groupBy("_doc", "_text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", F.bitwise_not("_bits").alias("_bits")))).alias("keep"),
        F.sum(F.bit_count("_bits")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """All rows of docs with their columns in `_row`, and _kept, n_lines, n_dropped.

    The key of a line is the line stripped of ASCII white space, A-Z lower-cased.
    A key of at least min_chars code points found in two documents or more loses
    its lines in all but the smallest doc_id that holds it.  A null or empty text
    is one empty line.  Rows of one doc_id count as one document; null doc_id
    counts as one document after all others.  Repeated rows share their lines'
    fate.  An empty table gives no rows.
    """
    bitmaps = keep_bitmaps(docs, min_chars).withColumnsRenamed({"_doc": "_d", "_text_hash": "_t"})
    joined = _identified(docs).join(bitmaps, (F.col("_doc") == F.col("_d")) & (F.col("_text_hash") == F.col("_t")), "left")
    kept = F.expr(r"""CASE WHEN keep IS NULL THEN _text ELSE array_join(filter(split(_text, '\n'),
        (line, i) -> (shiftright(coalesce(keep[CAST(i div 64 AS INT)], -1L), i % 64) & 1L) = 1L), '\n') END""")
    return joined.select("_row", kept.alias("_kept"), F.size(F.split("_text", "\n")).cast("long").alias("n_lines"),
                         F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
