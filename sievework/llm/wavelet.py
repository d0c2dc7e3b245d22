"""Token files as wavelet matrices.

A file holds the ids of a run of documents in ascending doc_id order: one bit
plane for each binary digit of the largest id, highest first.  Each plane keeps
the stable order of the plane before it, zeros first; with counts of ones at
every 512th bit, a token is read, counted or located by one step for each plane
(access, rank, select).  Planes, counts and document ends are compressed into
one payload; a written file is a Parquet file of one row, which holds it.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, few, materialize
from .tokens import encoder

#: A file is closed after this many ids; a document is never split.
FILE_TOKENS = 1 << 22
_BLOCK = 512
_MAGIC = b"WVM1"


def build(ids: np.ndarray, doc_ids: list, lengths: list[int], bits: int) -> bytes:
    """The payload of ids, which are the documents' ids one after another."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    planes, zeros = [], []
    one = ids.dtype.type(1)
    for k in range(bits - 1, -1, -1):
        bit = (ids & (one << ids.dtype.type(k))).astype(bool)
        raw = np.packbits(bit)
        ones = np.add.reduceat(np.bitwise_count(raw), np.arange(0, len(raw), _BLOCK // 8), dtype=np.uint32) if len(raw) else np.empty(0, np.uint32)
        planes += [pack(raw.tobytes()), pack((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())]
        zeros.append(len(ids) - int(np.count_nonzero(bit)))
        if k:
            # Compress and take cost a third of what boolean indexing does.
            ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "sizes": [len(p) for p in planes], "doc_ids": doc_ids, "lengths": lengths}).encode()
    head = pack(head)
    return _MAGIC + struct.pack("<I", len(head)) + head + b"".join(planes)


class Wavelet:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        import zstandard

        if payload[:4] != _MAGIC:
            raise ValueError("not a wavelet file")
        unpack = zstandard.ZstdDecompressor().decompress
        (size,) = struct.unpack_from("<I", payload, 4)
        head = json.loads(unpack(payload[8:8 + size]))
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self.doc_ids, self.lengths = head["doc_ids"], head["lengths"]
        parts, at = [], 8 + size
        for s in head["sizes"]:
            parts.append(unpack(payload[at:at + s]))
            at += s
        self.raw = [np.frombuffer(p, np.uint8) for p in parts[::2]]
        self.ones = [np.frombuffer(p, "<u4") for p in parts[1::2]]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before bit i."""
        raw, block = self.raw[plane], i // _BLOCK
        if block >= len(self.ones[plane]):
            block = len(self.ones[plane]) - 1
            if block < 0:
                return 0
        at = block * _BLOCK // 8
        whole = i >> 3
        count = int(self.ones[plane][block]) + int(np.bitwise_count(raw[at:whole]).sum())
        return count + (int(raw[whole]) >> (8 - (i & 7))).bit_count() if i & 7 else count

    def _bit(self, plane: int, i: int) -> int:
        return int(self.raw[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank1(k, start), self._rank1(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of token in positions [start, end)."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) such bit, by bisection over ranks."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def locate(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of token."""
        a, b = self._range(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last to the first."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.raw[k], count=self.n).view(bool)
            zeros = self.zeros[k]
            out = np.empty_like(ids)
            out[np.flatnonzero(~bit)] = ids[:zeros]
            out[np.flatnonzero(bit)] = ids[zeros:] | ids.dtype.type(1 << (self.bits - 1 - k))
            ids = out
        return ids


def write(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files and return them: file_no long (in document order), payload binary.

    Each file is one Parquet file of one row in the shared folder.  Documents are
    dealt by range of doc_id (null first; equal doc_id by text), so a file is one
    run of the global order.  Null text is empty and gives the end id alone.  A very
    long text takes memory in proportion to its length; columns other than doc_id and
    text are ignored.
    """

    def encode(batches):
        enc, pid, number = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        bits = max(enc.tokenizer.get_vocab_size() - 1, end_id, 1).bit_length()
        end, width = np.array([end_id], enc.dtype).tobytes(), np.dtype(enc.dtype).itemsize
        ids, doc_ids, lengths = bytearray(), [], []

        def file():
            payload = build(np.frombuffer(ids, enc.dtype), doc_ids, lengths, bits)
            return pa.RecordBatch.from_arrays([pa.array([pid << 32 | number], pa.int64()), pa.array([payload], pa.binary())], ["file_no", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = len(ids)
                ids += enc.raw(text)
                ids += end
                doc_ids.append(doc_id)
                lengths.append((len(ids) - before) // width)
                if len(ids) >= FILE_TOKENS * width:
                    yield file()
                    number += 1
                    ids, doc_ids, lengths = bytearray(), [], []
        if doc_ids:
            yield file()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    files = (bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
             .repartitionByRange(keys[0]).sortWithinPartitions(*keys).mapInArrow(encode, "file_no long, payload binary"))
    return materialize(files, "tokens", {"maxRecordsPerFile": "1", "compression": "none"})


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    start counts the ids of all documents before it: those of its own file, and
    the sizes of the files before, one small row a file.  An empty table gives no
    rows; repeated doc_id are documents of their own, in the order written.
    """

    def decode(batches):
        for batch in batches:
            for file_no, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = Wavelet(payload)
                raw = memoryview(w.all().astype("<u4").tobytes())
                starts = np.cumsum([0, *w.lengths])
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_no] * len(crcs), pa.int64()), pa.array(w.doc_ids, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(w.lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    ["file_no", "doc_id", "_at", "n_tokens", "ids_crc32"])

    docs = materialize(files.mapInArrow(decode, "file_no long, doc_id long, _at long, n_tokens long, ids_crc32 long"), "token-index")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row for every 4 million ids.
    bases = docs.groupBy("file_no").agg(F.sum("n_tokens").alias("_n")).select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return docs.join(few(bases), "file_no").select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
