"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

A set is a text's distinct five-word shingles; equal sets are one node.  Two sets
link when |A and B| / |A or B| reaches the threshold.

1. Shingles are dealt by hash to parts, which count the nodes of each and keep
   those of two nodes at least; these return to their nodes.  Each node lists its
   first n - ceil(t * n) + 1 shingles, rarest first; linked nodes share one of
   them.  Shingles of one node come first and need no entry, so most nodes have
   none.  What very many nodes hold (by counts of all documents in hash cells) is
   not dealt to one part: it comes last in the order and is split by salts.
2. In the list of a shingle, nodes sorted by size are compared by tiles of one
   size band: short lists pair by pair, long ones with the band's first node only
   (copies of a text need not meet all pairs).
3. Candidates pass if the bits in which their hashed bitmaps differ allow enough
   overlap, then if the exact intersection of their sorted shingles does.
4. Links give components.  Members of long lists that ended in different
   components meet in tiles of bounded size, across components only, by wider
   bitmaps and exact intersection: first by pairs enough to join what probably
   links, at last by every pair that bitmaps allow, so no link between components
   is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, bounded_batches, discard, materialize
from .shingles import forgetful, mix, shingles

#: Hash cells in which very frequent shingles are found: a fixed size, whatever the corpus.
CELLS = 1 << 20
_CELL_BLOCKS = 64
#: A cell of so many entries, and of twice the mean, is split by salts.
HOT = 1 << 16
#: Entries that a part is meant to count.
PART = 2_000_000
#: Entries that a task holds before it deals them out.
_BLOCK = 500_000
#: Nodes that a task remembers, so that their copies are not described again.
_SEEN = 200_000
#: Lists of up to so many nodes are compared pair by pair at once.
SHORT = 12
#: Nodes of a tile in the last comparison; a salt is meant to hold as many.
TILE = 1024
#: Bits of the filter that spares the texts of nodes without candidates.
FILTER_BITS = 1 << 24


def _least(n: int, t: Fraction) -> int:
    """ceil(t * n)"""
    return -(-n * t.numerator // t.denominator)


def bitmap(s: np.ndarray, wide: int = 0) -> bytes:
    """Parities of hashed shingles: as many bits as the next power of two over their number, from 256 on; 2 ** wide times as many."""
    bits = 1 << max(8, int(len(s) - 1).bit_length()) + wide
    return np.packbits(np.bincount((s >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1 != 0, bitorder="little").tobytes()


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bits: parities add up."""
    return np.bitwise_xor.reduce(b.reshape(-1, size), axis=0) if len(b) > size else b


def may_link(na: int, nb: int, a: bytes, b: bytes, t: Fraction) -> bool:
    """Whether the differing bits allow an intersection that links."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())
    shared = (na + nb - differ) // 2
    return shared * t.denominator >= t.numerator * (na + nb - shared)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def node_of(s: np.ndarray) -> int | None:
    """A set's 64-bit name; equal sets share it."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _describe(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, text_hash, node (null: no words), n and, once for a
    node and task, bits.  Besides, rows with block, width, cells and counts: a task's
    entries in the cells of a block, or if cells is null in every cell."""
    names = ["doc_id", "text_hash", "node", "n", "bits", "block", "width", "cells", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        seen, total = set(), np.zeros(CELLS, np.int64)
        for batch in batches:
            node, n, bits, cells = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                own = node_of(s)
                node.append(own)
                n.append(len(s))
                if own is None or own in seen:
                    bits.append(None)
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(own)
                bits.append(bitmap(s))
                cells.append(_cells(s))
            if cells:
                total += np.bincount(np.concatenate(cells), minlength=CELLS)
            columns = [batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip((node, n, bits), kinds[2:])), *(pa.nulls(len(n), k) for k in kinds[5:])]
            yield pa.RecordBatch.from_arrays(columns, names)
        rows = []
        for k, own in enumerate(total.reshape(_CELL_BLOCKS, -1)):
            kind = np.min_scalar_type(own.max())
            some = np.flatnonzero(own)
            if len(some) * (2 + kind.itemsize) < len(own) * kind.itemsize:
                rows.append((k, kind.itemsize, some.astype(np.uint16).tobytes(), own[some].astype(kind).tobytes()))
            else:
                rows.append((k, kind.itemsize, None, own.astype(kind).tobytes()))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(_CELL_BLOCKS, k) for k in kinds[:5]), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[5:]))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(
        forgetful(run), "doc_id long, text_hash long, node long, n long, bits binary, block int, width int, cells binary, counts binary")


def _cell_counts(described: DataFrame) -> np.ndarray:
    """Entries of all documents in CELLS hash cells."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // _CELL_BLOCKS, np.int64)
        for batch in batches:
            for width, cells, raw in zip(*(batch.column(c).to_pylist() for c in ("width", "cells", "counts"))):
                total[slice(None) if cells is None else np.frombuffer(cells, np.uint16)] += np.frombuffer(raw, f"u{width}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    blocks = described.where("block IS NOT NULL").select("block", "width", "cells", "counts").groupBy("block").applyInArrow(
        add, "block int, counts binary").collect()  # CELLS numbers, whatever the corpus
    return np.concatenate([np.frombuffer(bytes(r.counts), np.int64) for r in sorted(blocks, key=lambda r: r.block)]) if blocks else np.zeros(CELLS, np.int64)


def _scaled(x: np.ndarray, parts: int) -> np.ndarray:
    """x * parts / 2 ** 32 of 64-bit x, in whole numbers: the part of equal ranges that x
    falls into, and 32 bits of where it lies there.  It keeps the order of x."""
    high, low, n = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF), np.uint64(parts)
    return (high * n + (low * n >> np.uint64(32))).astype(np.int64)


def _bucket(node: np.ndarray, parts: int) -> np.ndarray:
    return _scaled(node.view(np.uint64), parts) >> 32


def _grouped(x: np.ndarray) -> np.ndarray:
    """A stable order by small whole numbers."""
    return np.argsort(x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x, kind="stable")


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)


_DEALT = {"counted": pa.bool_(), "to": pa.int32(), "part": pa.int32(), "nodes": pa.binary(), "sizes": pa.binary(), "runs": pa.binary(), "h": pa.binary(), "more": pa.binary()}
_DEALT_FIELDS = "counted boolean, to int, part int, nodes binary, sizes binary, runs binary, h binary, more binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_DEALT)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], k) for c, k in zip(columns, _DEALT.values())], list(_DEALT))


def _postings(docs: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """Binary rows of many entries each.

    counted false, to a part: nodes, runs (entries of each) and h, the low 32 bits of
    their shingles, still to be counted.  counted true, to a bucket of nodes: nodes,
    their sizes (shingles; distinct ones as dealt) and, if they hold very frequent
    shingles, runs, h (part and low bits) and more (a salt each).
    """
    salts = np.where(counts > max(HOT, 2 * counts.mean()), counts // TILE, 0)
    shared = docs.sparkSession.sparkContext.broadcast(salts)  # 8 bytes a cell

    def deal(held: list[tuple[int, np.ndarray]]):
        """The rows of a block of nodes."""
        split = shared.value
        node = np.array([k for k, _ in held], np.int64)
        size = np.array([len(s) for _, s in held], np.int64)
        h = np.concatenate([s for _, s in held])
        of = np.repeat(np.arange(len(held)), size)
        h, cell = _scaled(h, parts), _cells(h)
        fresh = np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))  # sets are sorted
        of, h, cell = of[fresh], h[fresh], cell[fresh]
        distinct = np.bincount(of, minlength=len(held))
        hot = split[cell] > 0
        bucket = _bucket(node, parts)
        by_bucket = _grouped(bucket)
        lines = []
        for at in np.split(by_bucket, _runs(bucket[by_bucket])[1:]):
            lines.append((True, int(bucket[at[0]]), None, node[at], np.stack([size[at], distinct[at]], 1).astype(np.uint32), None, None, None))
        if hot.any():
            k = np.flatnonzero(hot)
            k = k[_grouped(bucket[of[k]])]
            own, where = node[of[k]], bucket[of[k]]
            salt = (own % split[cell[k]]).astype(np.int32)
            for at in np.split(np.arange(len(k)), _runs(where)[1:]):
                lines.append((True, int(where[at[0]]), None, own[at], None, np.ones(len(at), np.uint32), h[k[at]], salt[at]))
            of, h = of[~hot], h[~hot]
        if len(of):
            by_part = _grouped(h >> 32)  # within a part nodes stay together
            of, part, low = of[by_part], h[by_part] >> 32, h[by_part].astype(np.uint32)
            first = _runs(part * np.int64(len(held)) + of)
            length = np.diff(np.append(first, len(of))).astype(np.uint32)
            begin = _runs(part)
            run_at = np.searchsorted(first, np.append(begin, len(of)))
            for i, (a, b) in enumerate(zip(begin, np.append(begin[1:], len(of)))):
                r = slice(run_at[i], run_at[i + 1])
                lines.append((False, int(part[a]), int(part[a]), node[of[first[r]]], None, length[r], low[a:b], None))
        return _dealt(lines)

    def run(batches):
        seen, held, entries = set(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                own = node_of(s)
                if own is None or own in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(own)
                held.append((own, s))
                entries += len(s)
                if entries >= _BLOCK:
                    yield deal(held)
                    held, entries = [], 0
        if held:
            yield deal(held)

    return docs.select(F.col("text").cast("string")).mapInArrow(forgetful(run), _DEALT_FIELDS)


def _counted(postings: DataFrame, parts: int) -> DataFrame:
    """Counted rows only, to buckets of nodes: of each part, the shingles of two nodes at
    least; more: in how many, up to 65534."""

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py():
            yield from batches
            return
        part, nodes, h = key[1].as_py(), [], []
        for batch in batches:
            for own, runs, low in zip(*(batch.column(c).to_pylist() for c in ("nodes", "runs", "h"))):
                nodes.append(np.repeat(np.frombuffer(own, np.int64), np.frombuffer(runs, np.uint32)))
                h.append(np.frombuffer(low, np.uint32))
        if not h:
            return
        packed = np.concatenate(h).astype(np.uint64) << np.uint64(32)
        del h
        packed |= np.arange(len(packed), dtype=np.uint64)
        packed.sort()
        low, at = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del packed
        again = low[1:] == low[:-1]
        kept = np.append(again, False) | np.append(False, again)
        low, node = low[kept], np.concatenate(nodes)[at[kept]]
        order = np.lexsort((node, low))
        low, node = low[order], node[order]
        if not len(low):
            return
        fresh = np.append(True, (low[1:] != low[:-1]) | (node[1:] != node[:-1]))
        low, node = low[fresh], node[fresh]
        begin = _runs(low)
        times = np.diff(np.append(begin, len(low)))
        many = np.repeat(times, times)
        low, node, many = low[many > 1], node[many > 1], np.minimum(many[many > 1], 65534).astype(np.uint16)
        order = np.argsort(node.view(np.uint64), kind="stable")
        low, node, many = low[order], node[order], many[order]
        first = _runs(node)
        length = np.diff(np.append(first, len(node))).astype(np.uint32)
        bucket = _bucket(node[first], parts)
        begin = _runs(bucket)
        edge = np.append(first, len(node))
        rows = []
        for a, b in zip(begin, np.append(begin[1:], len(first))):
            k = slice(edge[a], edge[b])
            rows.append((True, int(bucket[a]), part, node[first[a:b]], None, length[a:b], low[k], many[k]))
        yield _dealt(rows)

    return postings.groupBy("counted", "to").applyInArrow(count, _DEALT_FIELDS)


def _prefixes(counted: DataFrame, t: Fraction) -> DataFrame:
    """h, salt (-1: the list is not split), node, n of each node's first shingles that other nodes hold."""

    def choose(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_node, base, node, h, many, salt = [], [], [], [], [], []
        for batch in batches:
            for part, own, sizes, runs, low, more in zip(*(batch.column(c).to_pylist() for c in ("part", "nodes", "sizes", "runs", "h", "more"))):
                own = np.frombuffer(own, np.int64)
                if sizes is not None:
                    base_node.append(own)
                    base.append(np.frombuffer(sizes, np.uint32).reshape(-1, 2))
                    continue
                node.append(np.repeat(own, np.frombuffer(runs, np.uint32)))
                if part is None:
                    h.append(np.frombuffer(low, np.int64))
                    salt.append(np.frombuffer(more, np.int32))
                    many.append(np.full(len(h[-1]), 65535, np.uint16))
                else:
                    h.append(np.frombuffer(low, np.uint32).astype(np.int64) | np.int64(part) << 32)
                    many.append(np.frombuffer(more, np.uint16))
                    salt.append(np.full(len(h[-1]), -1, np.int32))
        if not node:
            return
        node, h, many, salt = (np.concatenate(x) for x in (node, h, many, salt))
        order = np.lexsort((h, many, node))
        node, h, many, salt = node[order], h[order], many[order], salt[order]
        fresh = np.append(True, (node[1:] != node[:-1]) | (h[1:] != h[:-1]))
        node, h, salt = node[fresh], h[fresh], salt[fresh]
        known, at = np.unique(np.concatenate(base_node), return_index=True)
        first = _runs(node)
        held = np.diff(np.append(first, len(node)))
        size = np.concatenate(base)[at[np.searchsorted(known, node[first])]].astype(np.int64)
        n, distinct = size[:, 0], size[:, 1]
        # Shingles that no other node holds come first.
        left = n - -(-n * t.numerator // t.denominator) + 1 - (distinct - held)
        turn = np.arange(len(node)) - np.repeat(first, held)
        keep = turn < np.repeat(left, held)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(salt[keep]), pa.array(node[keep]), pa.array(np.repeat(n, held)[keep])], ["h", "salt", "node", "n"])

    return counted.groupBy("to").applyInArrow(choose, "h long, salt int, node long, n long")


def _lists(listed: DataFrame, t: Fraction, parts: int) -> DataFrame:
    """kind 0: a candidate pair (a, b); 1: node a of n = b in a long list of shingle h;
    2: the same, first of its size band in one salt's part of a split list."""

    def rows(kind, h, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(h), pa.array(a), pa.array(b)], ["kind", "h", "a", "b"])

    def compare(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        h, salt, node, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
        del held
        order = np.lexsort((node, n, salt, h))
        h, salt, node, n = h[order], salt[order], node[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
        fresh = new.copy()  # a node that several tasks have named counts once
        fresh[1:] |= node[1:] != node[:-1]
        h, salt, node, n, new = h[fresh], salt[fresh], node[fresh], n[fresh], new[fresh]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        group = np.repeat(np.arange(len(start)), size)
        short = ((size <= SHORT) & (salt[start] < 0))[group]
        pairs = []
        # Short lists: their pairs at one distance after another.
        for gap in range(1, min(SHORT, len(h))):
            k = np.flatnonzero(short[:-gap] & (group[:-gap] == group[gap:]) & (n[:-gap] * t.denominator >= n[gap:] * t.numerator))
            pairs.append((node[k], node[k + gap]))
        # Long lists: each node with the first of its size band.
        heads = []
        for g in np.flatnonzero((size > SHORT) | (salt[start] >= 0)):
            at, end = start[g], start[g] + size[g]
            while at < end:
                to = at + int(np.searchsorted(n[at:end], n[at] * t.denominator // t.numerator, side="right"))
                pairs.append((np.full(to - at - 1, node[at]), node[at + 1:to]))
                if salt[at] >= 0:
                    heads.append(at)
                at = to
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield rows(0, np.zeros(len(found), np.int64), found[:, 0].copy(), found[:, 1].copy())
        long = ~short
        yield rows(1, h[long], node[long], n[long])
        heads = np.array(heads, np.int64)
        yield rows(2, h[heads], node[heads], n[heads])

    return listed.repartition(parts, "h", "salt").mapInArrow(compare, "kind int, h long, a long, b long")


def _fit(pairs: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow a link."""

    def keep(batches):
        for batch in batches:
            na, nb, a, b = (batch.column(c).to_pylist() for c in ("na", "nb", "bits_a", "bits_b"))
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*x, t) for x in zip(na, nb, a, b)], pa.bool_()))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator).select(
        "a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(keep, "a long, b long")


def _filter(ends: DataFrame):
    """The nodes in ends, and a few others, as a fixed number of hashed bits, broadcast."""
    cell = F.expr(f"pmod(node, {FILTER_BITS}) + 1")
    filled = ends.groupBy(F.bitmap_bucket_number(cell).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, np.uint8)  # FILTER_BITS bits at most come to the driver
    for k, raw in ((r.k, r.bits) for r in filled):
        table[(k - 1) * 4096:k * 4096] = np.frombuffer(bytes(raw), np.uint8)
    return ends.sparkSession.sparkContext.broadcast(table)


def _gather(docs: DataFrame, described: DataFrame, ends: DataFrame) -> DataFrame:
    """node, text and bits, a bitmap four times as wide, of the nodes in ends and of a few others."""
    wanted = described.where("bits IS NOT NULL").join(ends.select("node").distinct(), "node", "left_semi").select(F.col("text_hash").alias("node"))
    shared = _filter(wanted)

    def texts(batches):
        filter_bits, seen = shared.value, set()
        for batch in batches:
            at = batch.column(1).to_numpy() % FILTER_BITS
            may = batch.column(0).filter(pa.array(filter_bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0))
            node, own_text, bits = [], [], []
            for text in may.to_pylist():
                own = node_of(s := shingles(text))
                if own is None or own in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(own)
                node.append(own), own_text.append(text), bits.append(bitmap(s, 2))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(own_text, pa.string()), pa.array(bits, pa.binary())], ["node", "text", "bits"])

    text = F.col("text").cast("string")
    return materialize(docs.select(text, F.xxhash64(text)).mapInArrow(forgetful(texts), "node long, text string, bits binary").dropDuplicates(["node"]), "texts")


def _verify(texts: DataFrame, pairs: DataFrame, t: Fraction, name: str) -> DataFrame:
    """The pairs that link, by exact intersections of sorted shingles."""
    shared = _filter(pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def needed(batches):
        for batch in batches:
            at = batch.column(0).to_numpy() % FILTER_BITS
            yield batch.filter(pa.array(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0))

    def intersect(batches):
        for batch in batches:
            keep, last, left = [], None, None
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if last != ta:
                    last, left = ta, shingles(ta)
                right = shingles(tb)
                shared_n = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(shared_n * t.denominator >= t.numerator * (len(left) + len(right) - shared_n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    few = texts.select("node", "text").mapInArrow(needed, "node long, text string")
    joined = pairs.join(few.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        few.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return materialize(joined.select("a", "b", "ta", "tb").mapInArrow(forgetful(intersect), "a long, b long"), name)


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of all nodes in links (a, b).

    Labels take the least of the neighbours' and then that label's own label, so
    long chains shorten by half a round; only a count comes to the driver.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    # Two numbers a node: small tables are broadcast in every round, by their count.
    sent = F.broadcast if labels.count() <= FEW_ROWS else lambda df: df
    while True:
        of = labels.select(F.col("node").alias("b"), "label")
        near = edges.join(sent(of), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        met = near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = materialize(met.join(sent(up), "label", "left").select("node", F.least("label", "above").alias("label"), "old"), "labels")
        discard(labels)
        labels = new
        if new.where("label <> old").isEmpty():
            discard(edges)
            return labels


def _merge(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels after more links (a, b): only the labels that they join are relabelled."""
    known = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    ends = more
    for end in ("a", "b"):
        ends = ends.join(known, ends[end] == known["_n"], "left").withColumn(end, F.coalesce("_l", end)).select("a", "b")
    top = components(ends.where("a <> b"))
    to = top.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    moved = labels.select("node", "label").join(to, labels["label"] == to["_n"], "left").select("node", F.coalesce("_l", "label").alias("label"))
    out = materialize(moved.unionByName(top.select("node", "label").join(labels, "node", "left_anti")), "labels")
    discard(top)
    return out


def _across(long: DataFrame, labels: DataFrame, texts: DataFrame, t: Fraction, forest: bool) -> DataFrame:
    """Candidate pairs of long lists (h, node, n) whose ends lie in different components.

    forest: of the pairs that probably link, only as many as join the components of
    a tile; without it, every pair whose bitmaps allow a link.
    """
    named = long.join(labels.select("node", "label"), "node", "left").select("h", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("h").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("_n")).where("_a <> _b").select(
        "h", F.expr(f"CAST(ceil(_n / {TILE}) AS INT)").alias("tiles"))
    tile = named.join(mixed, "h").withColumn("tile", F.expr("CAST(pmod(node, tiles) AS INT)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tile.join(texts.select("node", "bits"), "node").select(
        "h", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "label", "n", "bits")

    def meet(key, table):
        own_tile, node, label, n = (table.column(c).to_numpy() for c in ("tile", "node", "label", "n"))
        bits = table.column("bits").to_pylist()
        order = np.lexsort((node, n))
        own_tile, node, label, n, bits = own_tile[order], node[order], label[order].copy(), n[order], [bits[i] for i in order]
        widths = np.array([len(b) for b in bits])
        plain = {int(s): np.stack([fold(np.frombuffer(b, np.uint8), int(s)) if s <= len(b) <= 2 * s else np.zeros(int(s), np.uint8) for b in bits]) for s in np.unique(widths)}
        within = key[1].as_py() == key[2].as_py()
        found = []
        for i in range(len(node)):
            to = int(np.searchsorted(n, n[i] * t.denominator // t.numerator, side="right"))
            k = np.arange(i + 1, to)
            k = k[(label[k] != label[i]) & (within | (own_tile[k] != own_tile[i]))]
            if not len(k):
                continue
            own = plain[int(widths[i])]
            differ = np.bitwise_count(own[k] ^ own[i]).sum(1, dtype=np.int64)
            shared = (n[i] + n[k] - differ) // 2
            fits = shared * t.denominator >= t.numerator * (n[i] + n[k] - shared)
            if forest:
                # Shingles that differ, as the bits that differ let expect.
                width = 8 * int(widths[i])
                likely = -width / 2 * np.log1p(-2 * np.minimum(differ, width / 2 - 1) / width)
                fits &= (n[i] + n[k] - likely) / (n[i] + n[k] + likely) >= float(t)
                k, likely = k[fits], likely[fits]
                k = k[np.argsort(likely, kind="stable")]
                k = k[np.unique(label[k], return_index=True)[1]]  # the likeliest of each component
                label[np.isin(label, label[k])] = label[i]
            else:
                k = k[fits]
            found.append(np.stack([np.minimum(node[k], node[i]), np.maximum(node[k], node[i])], 1))
        pair = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.table([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    return tiles.groupBy("h", "low", "high").applyInArrow(meet, "a long, b long").distinct()


def _labelled(docs: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """(the document rows of _describe, node and label of the nodes that link)"""
    spark = docs.sparkSession
    docs = bounded_batches(docs).select("doc_id", "text")
    described = materialize(_describe(docs), "sets")
    counts = _cell_counts(described)
    described = described.where("block IS NULL").drop("block", "width", "cells", "counts")
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(fewest, int(counts.sum()) // PART)
    listed = materialize(_prefixes(_counted(_postings(docs, counts, parts), parts), threshold), "prefixes")
    lists = materialize(_lists(listed, threshold, max(fewest, listed.count() // PART)), "lists")
    discard(listed)
    nodes = described.where("bits IS NOT NULL").select("node", "n", "bits").dropDuplicates(["node"])
    band = Window.partitionBy("h", F.floor(F.log(F.col("b").cast("double")) / -float(np.log(float(threshold))))).orderBy("b", "a")
    heads = lists.where("kind = 2").select(F.first("a").over(band).alias("p"), F.col("a").alias("q")).where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    pairs = lists.where("kind = 0").select("a", "b").unionByName(heads).distinct()
    fit = materialize(_fit(pairs, nodes, threshold), "fit")
    long = lists.where("kind = 1").select("h", F.col("a").alias("node"), F.col("b").alias("n"))
    texts = _gather(docs, described, fit.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select("node")))
    found = _verify(texts, fit, threshold, "links")
    discard(fit)
    labels = components(found)
    discard(found)
    for forest in (True, False):
        across = materialize(_across(long, labels, texts, threshold, forest), "across")
        if not across.isEmpty():
            more = _verify(texts, across, threshold, "links-across")
            if not more.isEmpty():
                merged = _merge(labels, more)
                discard(labels)
                labels = merged
            discard(more)
        discard(across)
    discard(lists, texts)
    return described, labels


def representatives(docs: DataFrame, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """doc_id and text_hash of one row of each component: the smallest doc_id (null
    last), then the smallest text_hash.  Texts without words, or null, link with
    nothing: each stands for itself."""
    described, labels = _labelled(docs, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")
    named = described.where("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("first")).join(labels.select("node", "label"), "node", "left")
    first = named.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    return first.unionByName(described.where("node IS NULL").select("doc_id", "text_hash").distinct())


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row of docs.

    component_id is the smallest doc_id reachable by links, the row's own
    included.  A text without words, or null, has no shingles, links with nothing
    and is its own component.  Null doc_id take part, and name a component (null)
    only if all its rows have none.  Rows of one doc_id are documents of their own
    that share a name.  An empty table gives no rows; columns other than doc_id
    and text are ignored.
    """
    described, labels = _labelled(docs, threshold)
    named = described.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("own")).join(labels.select("node", "label"), "node", "left").select("node", "own", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("own").alias("component_id"))
    of = named.join(least, "label").select("node", "component_id")
    return described.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles")).join(of, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
