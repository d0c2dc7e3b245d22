"""Periodic runs of words: an all-lag vectorised scan.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping that period.  The array of a text's word ids
is compared with itself shifted by every lag up to n / min_exp; true stretches
are run-length encoded.  A stretch seen at several lags belongs to the smallest,
as a stretch of two periods or more has no other period but multiples of its
smallest.

Small lags are compared at every word, all of a block at once.  From DENSE lags
on, the lags of an octave [L, 2L) are first compared at every (L / 8)-th word: a
run covers one period at least and so eight probes in a row.  Lags without eight
equal probes in a row hold no run; the others are compared at every word.

Texts of up to LONG_BYTES bytes are scanned where they are read.  Of longer ones
each different text is dealt once, in ranges of RANGE lags, over all machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MIN_WORDS, MIN_EXP = 12, 2
DENSE = 32
LONG_BYTES = 1 << 20
RANGE = 1 << 18
#: Cells of a block of comparisons.
_CELLS = 1 << 18
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_DDL = "runs array<struct<start: long, length: long, period: long>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Small numbers, equal for equal words; the largest of the type stays free."""
    numbers = dict.fromkeys(words)
    for i, word in enumerate(numbers):
        numbers[word] = i
    return np.fromiter(map(numbers.__getitem__, words), np.uint16 if len(numbers) < 65_535 else np.uint32, len(words))


def _shifted(ids: np.ndarray, lags: int, columns: int, first: int, step: int) -> np.ndarray:
    """Row j: the words first + j, first + j + step, ..."""
    size = ids.itemsize
    return np.lib.stride_tricks.as_strided(ids[first:], (lags, columns), (size, step * size), writeable=False)


def _stretches(equal: np.ndarray, lags: np.ndarray, least: np.ndarray, found: dict) -> None:
    """Note (start, length) -> lag of each row's true stretches; the last column is false."""
    width = equal.shape[1]
    flat = np.zeros(equal.size + 1, bool)
    flat[1:] = equal.ravel()
    edge = np.flatnonzero(flat[1:] != flat[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    start, size = (x[size >= least.min()] for x in (start, size))
    row = start // width
    good = size >= least[row]
    for s, n, q in zip((start[good] % width).tolist(), (size + lags[row])[good].tolist(), lags[row[good]].tolist()):
        if found.get((s, n), q) >= q:
            found[s, n] = q


def scan(ids: np.ndarray, first: int = 1, last: int | None = None, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest lag, of all runs at lags from first to last."""
    n = len(ids)
    most = n // min_exp
    last = most if last is None else min(last, most)
    found: dict = {}
    if n < min_words or last < first:
        return found
    end = np.iinfo(ids.dtype).max
    padded = np.concatenate([ids, np.full(2 * most + 2, end, ids.dtype)])

    def least(lags: np.ndarray) -> np.ndarray:
        return np.maximum(min_words - lags, (min_exp - 1) * lags)

    lag = first
    while lag <= last and lag < DENSE:
        width = n - lag + 1  # the last column compares with the end
        rows = min(max(1, _CELLS // width), min(last + 1, DENSE) - lag)
        lags = np.arange(lag, lag + rows)
        equal = _shifted(padded, rows, width, lag, 1) == padded[:width]
        equal[:, -1] = False
        _stretches(equal, lags, least(lags), found)
        lag += rows
    while lag <= last:
        octave = 1 << (lag.bit_length() - 1)
        step = octave // 8
        probes = ids[::step]
        rows = min(max(1, _CELLS // len(probes)), min(last + 1, 2 * octave) - lag)
        hits = (_shifted(padded, rows, len(probes), lag, step) == probes).ravel()
        for apart in (1, 2, 4):  # eight equal probes in a row; those across rows are refuted below
            hits = hits[apart:] & hits[:-apart]
        for q in (lag + np.unique(np.flatnonzero(hits) // len(probes))).tolist():
            equal = np.append(ids[q:] == ids[:-q], False)[None, :]
            _stretches(equal, np.array([q]), least(np.array([q])), found)
        lag += rows
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of what follows a run's first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(runs, np.int64).T
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _listed(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 3)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])).cast(_RUNS)


def _judge(key: str, kind: pa.DataType, min_words: int, min_exp: int, given: bool):
    """Batches of (key, text[, runs]) to (key, n_words, runs, collapsed)."""

    def run(batches):
        for batch in batches:
            n_words, all_runs, texts = [], [], []
            for row in range(batch.num_rows):
                words = (batch.column(1)[row].as_py() or "").encode().split()
                if given:
                    runs = [(r["start"], r["length"], r["period"]) for r in batch.column(2)[row].as_py() or []]
                else:
                    runs = sorted((s, n, q) for (s, n), q in scan(word_ids(words), min_words=min_words, min_exp=min_exp).items())
                n_words.append(len(words))
                all_runs.append(runs)
                texts.append(collapse(words, runs).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(n_words, pa.int64()), _listed(all_runs), pa.array(texts, pa.string())],
                                             [key, "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: Column | str = "text", min_words: int = MIN_WORDS, min_exp: int = MIN_EXP,
                  long_bytes: int = LONG_BYTES, lag_range: int = RANGE) -> DataFrame:
    """doc_id, n_words, runs array<start, length, period>, collapsed: one row per row of docs.

    Words are numbered from 0: maximal runs without ASCII white space.  runs holds
    every run of at least min_words words and min_exp (2 at least) periods, by
    start, then period.  collapsed joins by one space the words that no run
    contains after its first period.  Null, empty and white texts have no words and
    an empty collapsed text.  Rows of null or repeated doc_id are kept as they are,
    each judged by its own text; equal texts, however many, have equal results, and
    long ones are scanned once.  Texts of more than long_bytes bytes are scanned in
    ranges of lag_range lags, one task's work each.  Other columns of docs are not
    read.  An empty table gives no rows.
    """
    if min_exp < 2:
        raise ValueError("a run holds two periods at least")
    text = F.col(text) if isinstance(text, str) else text
    own = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    schema = f"n_words long, {_RUNS_DDL}, collapsed string"
    size = F.octet_length("text")
    short = own.where(size <= long_bytes).mapInArrow(_judge("doc_id", pa.int64(), min_words, min_exp, False), f"doc_id long, {schema}")

    def deal(batches):
        for batch in batches:
            for key, value in zip(*(c.to_pylist() for c in batch.columns)):
                ids = word_ids(value.encode().split())
                for first in range(1, len(ids) // min_exp + 1, lag_range):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([first], pa.int64()), pa.array([ids.itemsize], pa.int32()),
                                                      pa.array([ids.tobytes()], pa.binary())], ["key", "first", "width", "ids"])

    def scan_ranges(batches):
        for batch in batches:
            for key, first, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                found = scan(np.frombuffer(raw, np.uint16 if width == 2 else np.uint32), first, first + lag_range - 1, min_words, min_exp)
                rows = np.array([(s, n, q) for (s, n), q in found.items()], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.string()), *(pa.array(rows[:, i]) for i in range(3))], ["key", "start", "length", "period"])

    large = own.where(size > long_bytes).withColumn("key", F.sha2("text", 256))
    texts = large.groupBy("key").agg(F.first("text").alias("text"))
    ranges = texts.mapInArrow(deal, "key string, first long, width int, ids binary").repartition("key", "first")
    runs = (ranges.mapInArrow(scan_ranges, "key string, start long, length long, period long")
            .groupBy("key", "start", "length").agg(F.min("period").alias("period"))
            .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
            .select("key", F.expr("transform(_runs, r -> struct(r.start, r.length, r.period))").alias("runs")))
    judged = texts.join(runs, "key", "left").select("key", "text", "runs").mapInArrow(_judge("key", pa.string(), min_words, min_exp, True), f"key string, {schema}")
    return short.unionByName(large.select("doc_id", "key").join(judged, "key").drop("key"))


def planted(doc_id: Column, text: Column) -> Column:
    """A text with a periodic tail, for known documents: those whose crc32 of the decimal
    doc_id ends in 0 repeat the p words from word a on to their end.  Others and null
    stay, words apart."""
    return F.when(F.crc32(doc_id.cast("string")) % 10 == 0, _periodic(F.floor(F.crc32(doc_id.cast("string")) / 10), text)).otherwise(text)


def _periodic(g: Column, text: Column) -> Column:
    def repeat(words: Column) -> Column:  # bound once, not once a word
        start = F.when(F.size(words) > 0, g % F.size(words))
        period = 1 + F.floor((F.size(words) - start) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < start, w).otherwise(F.get(words, (start + (i - start) % period).cast("int"))))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.get(F.transform(F.array(words), repeat), F.lit(0)), " ")


def digest(runs: DataFrame) -> DataFrame:
    """The result of `periodic_runs` in numbers and hashes."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr(r"array_join(transform(array_sort(transform(runs, r -> struct(r.start, r.period, r.length))), r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return runs.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"), F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
