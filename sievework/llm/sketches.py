"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the K smallest distinct shingle hashes (48 bits each, highest
bits of the hash) in base64.  Sketches of parts merge into the sketch of the
union, and two sketches estimate resemblance, containment and distinct counts.
With K shingles or fewer the estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .shingles import forgetful, shingles

K = 128
_BYTES = 6
_SPACE = float(1 << (8 * _BYTES))


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes; none for a text without words."""
    return np.unique(shingles(text) >> np.uint64(64 - 8 * _BYTES))[:k]


def dump(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES:].tobytes()).decode()


def load(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - _BYTES:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) * _SPACE / (float(s[-1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A or B|; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A|; an empty A is contained."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces a text's last floor(n / 2) code points by the first
    as many (or all) of the next document in ascending doc_id, after the last by
    those of the first.  Null text is empty.  Null doc_id come first, rows of one
    doc_id follow each other by text.  A lone document follows itself; an empty
    table gives no rows.

    Documents are dealt to runs of the doc_id order; each run's successor, the
    first document of the next run, is copied to it, so neighbours meet within a
    task and each text moves once.
    """
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.agg(F.count("*"), F.min("doc_id"), F.count("doc_id")).first()
    rows, least, known = ids
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 20_000)
    # The order's cuts are existing doc_ids: parts * 4 numbers at most.
    cuts = docs.agg(F.percentile_approx("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 10 * 4 * parts)).first()[0] or []
    cuts = np.array(sorted({c for c in cuts if c > least}), np.int64)
    opens_null = known < rows

    def deal(batches):
        for batch in batches:
            doc_id = batch.column(0)
            null = np.asarray(doc_id.is_null())
            value = doc_id.fill_null(least if least is not None else 0).to_numpy(zero_copy_only=False)
            run = np.searchsorted(cuts, value, side="right")
            run[null] = 0
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(np.zeros(len(run), bool)), *batch.columns], ["run", "tail", "doc_id", "text"])
            first = (null if opens_null else (value == least)) & (run == 0)
            copied = np.flatnonzero(np.isin(value, cuts) & ~null | first)
            if len(copied):
                to = np.where(first[copied], len(cuts), run[copied] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.ones(len(to), bool)), *(c.take(pa.array(copied)) for c in batch.columns)], ["run", "tail", "doc_id", "text"])

    def edit(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in batches:
            out = []
            for run, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tail and (held is None or held[0] != run):
                    continue  # this run's last document has met its successor
                own = sketch(text, k)
                if held is not None and held[0] == run:
                    _, held_id, held_text, held_own = held
                    n = len(held_text)
                    edited = held_text[:n - n // 2] + text[:n // 2]
                    other = sketch(edited, k)
                    out.append((held_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), dump(held_own), dump(other), resemblance(held_own, other, k), resemblance(held_own, own, k)))
                held = None if tail else (run, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    dealt = docs.mapInArrow(deal, "run int, tail boolean, doc_id long, text string")
    return dealt.repartition("run").sortWithinPartitions("run", "tail", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(
        forgetful(edit), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
