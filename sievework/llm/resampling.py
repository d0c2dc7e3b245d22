"""Importance resampling towards a target distribution, by hashed word n-grams.

Identical texts are collapsed first: features and weights are computed once for
each different text and counted as often as the text occurs.  The weights are then
joined back to the documents, and noise of the document's own (Gumbel noise from a
hash of its doc_id) makes the largest scores a sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, discard, materialize, number_rows

BUCKETS = 10_000
ORDER = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Texts that make up this share of all rows or more are joined by broadcast: at most so many.
HOT = 10_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of up to so many bytes append by table.
_TABLED = 48


def _append_tables() -> np.ndarray:
    """[n, i, b]: what byte i of a crc32, of value b, becomes behind n zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((_TABLED + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & 255]
    return out


_AFTER = _append_tables()


def _crc_pair(word: bytes) -> tuple[int, int, int]:
    """crc32 of the word, of a blank and the word, and the latter's length."""
    return zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1


def _kind(n_buckets: int) -> type:
    return np.uint16 if n_buckets <= 65_536 else np.uint32


def buckets(text: str | None, memory: dict, order: int = ORDER, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to order words, repeats included."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0, np.empty(0, _kind(n_buckets))
    alone, joined, size = np.array([memory[w] for w in words], np.int64).T
    alone, joined = alone.astype(np.uint32), joined.astype(np.uint32)
    out, last = [alone], alone
    for n in range(1, min(order, len(words))):
        head, tail, length = last[:-1], joined[n:], size[n:]
        by = np.minimum(length, _TABLED + 1)
        last = _AFTER[by, 0, head & 255] ^ _AFTER[by, 1, (head >> 8) & 255] ^ _AFTER[by, 2, (head >> 16) & 255] ^ _AFTER[by, 3, head >> 24] ^ tail
        for i in np.flatnonzero(length > _TABLED + 1).tolist():
            last[i] = zlib.crc32(b" " + words[n + i], int(head[i]))
        out.append(last)
    return len(words), (np.concatenate(out) % np.uint32(n_buckets)).astype(_kind(n_buckets))


def features(texts: DataFrame, order: int = ORDER, n_buckets: int = BUCKETS) -> DataFrame:
    """(text, copies) to (key, copies, n_words, n_features, buckets): key is the text's
    SHA-256, buckets the features' numbers as little-endian unsigned integers."""

    def run(batches):
        memory = Memo(_crc_pair)
        for batch in batches:
            keys, n_words, sizes, raw = [], [], [], []
            for text in batch.column(0).to_pylist():
                size, found = buckets(text, memory, order, n_buckets)
                keys.append(hashlib.sha256(text.encode()).hexdigest())
                n_words.append(size)
                sizes.append(len(found))
                raw.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())],
                                             ["key", "copies", "n_words", "n_features", "buckets"])

    return bounded_batches(texts).mapInArrow(run, "key string, copies long, n_words long, n_features long, buckets binary")


def collapsed(df: DataFrame) -> DataFrame:
    """(text, copies) of each different text; null is empty."""
    return df.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))


def bucket_counts(made: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """How often features fall into each bucket, copies counted: a task adds up one
    array of n_buckets numbers, and n_buckets rows reach the driver."""
    kind = _kind(n_buckets)

    def add(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for copies, raw in zip(*(c.to_pylist() for c in batch.columns)):
                total += copies * np.bincount(np.frombuffer(raw, kind), minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = [0] * n_buckets
    for r in made.select("copies", "buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of each bucket's smoothed probability in the target over that in the source)."""
    n, s, t = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float((b + 1) * (s + n)) / float((a + 1) * (t + n)))) for a, b in zip(source, target)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, in thousandths; a null doc_id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _joined(docs: DataFrame, weights: DataFrame, rows: int) -> DataFrame:
    """Every document with its text's weight.  The texts that make up 1 / HOT of all rows
    or more, at most HOT of them, are broadcast; the others meet by a shuffle in which
    no key has more than rows / HOT documents."""
    hot = F.broadcast(weights.where(F.col("copies") * HOT >= rows))
    rest = weights.where(F.col("copies") * HOT < rows)
    return docs.join(hot, "key").unionByName(docs.join(hot, "key", "left_anti").join(rest, "key"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, order: int = ORDER, n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, key (SHA-256 of the text), n_words, n_features, weight, score, rank: one row per row of docs.

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased; features
    are all runs of 1 to order words, hashed into n_buckets.  weight adds a bucket's
    gain for each feature, score adds noise of the doc_id.  Of the N rows with
    min_words words or more, floor(percent * N / 100) of the highest scores are drawn
    and ranked from 1, ties by smaller doc_id (null last), then key; equal rows in any
    order.  rank is null for others.  Null and empty texts have no features and weight
    0.  Texts may be of any length and be repeated by any share of all rows.  Other
    columns are not read.  An empty target or docs changes only the gains; an empty
    docs gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = materialize(features(collapsed(own), order, n_buckets), "features", {"compression": "zstd"})
    gain = np.array(gains(bucket_counts(made, n_buckets), bucket_counts(features(collapsed(target), order, n_buckets), n_buckets)), np.int64)
    kind = _kind(n_buckets)

    def weigh(batches):
        for batch in batches:
            weight = [int(gain[np.frombuffer(raw, kind)].sum()) for raw in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], ["key", "copies", "n_words", "n_features", "weight"])

    weights = materialize(made.mapInArrow(weigh, "key string, copies long, n_words long, n_features long, weight long"), "weights")
    discard(made)
    rows = weights.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    scored = _joined(own.select("doc_id", F.sha2("text", 256).alias("key")), weights, rows).drop("copies").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = scored.where(F.col("n_words") >= min_words)
    ranked = number_rows(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")], "ranked")
    drawn = percent * weights.agg(F.coalesce(F.sum(F.when(F.col("n_words") >= min_words, F.col("copies"))), F.lit(0))).first()[0] // 100
    ranked = ranked.withColumn("rank", F.when(F.col("row_no") < drawn, F.col("row_no") + 1)).drop("row_no")
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
