"""Packing by power-of-two decomposition.

A document of n ids is cut by the binary digits of n: as many pieces of the
sequence length as fit, then one piece for each further binary digit, longest
first.  Pieces of equal length form a bucket, each piece is a sequence by
itself, so no sequence crosses documents and none needs padding: every length
is a power of two.  Sequences are numbered bucket by bucket, longest first.

The work is one pass over the texts without a shuffle.  Each task numbers its
pieces in each bucket; the numbers of other tasks before it are added from one
small row for each task and bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_BYTES, bounded_batches, few, materialize
from .tokens import encoder

#: Bytes of a worker's memory of words; packing mostly follows other stages in the same workers.
MEMORY = MEMO_BYTES // 2
_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _pid int, _local long"


def pieces_of(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the binary-length pieces of n ids; longest is a power of two."""
    out = [(i * longest, longest) for i in range(n // longest)]
    at, bit = len(out) * longest, longest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each one a sequence.

    docs has doc_id and text; other columns are ignored, whatever their names.
    Null text is empty and gives the end id alone.  Null and repeated doc_id are
    kept: each row is a document of its own.  An empty table gives no rows.  A very
    long text takes time and memory in proportion to its length.
    with_ids adds the ids themselves, `ids` array<int>, for writers of training
    sequences; without it only their unsigned crc32 is carried.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches):
        enc, pid, used = encoder(tokenizer_path, MEMORY), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, tokens = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(enc.encode(text).astype("<u4"), np.uint32(end_id))
                raw = memoryview(ids.tobytes())
                for start, length in pieces_of(len(ids), longest):
                    local = used.get(length, 0)
                    used[length] = local + 1
                    rows.append((doc_id, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), len(ids), pid, local))
                    if with_ids:
                        tokens.append(ids[start:start + length].astype(np.int32))
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_pid", "_local"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    pieces = materialize(bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, _FIELDS + (", ids array<int>" if with_ids else "")), "pieces")
    # At most 1 + log2(longest) rows for each task of the scan, and in all.
    here = pieces.groupBy("_pid", "length").agg(F.count("*").alias("_n"))
    earlier = lambda order, *by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    longer = here.groupBy("length").agg(F.sum("_n").alias("_n")).select("length", earlier(F.desc("length")).alias("_first"))
    bases = here.select("_pid", "length", earlier(F.asc("_pid"), "length").alias("_before")).join(F.broadcast(longer), "length").select("_pid", "length", (F.col("_first") + F.col("_before")).alias("_base"))
    out = pieces.join(few(bases), ["_pid", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_local")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
    return out
