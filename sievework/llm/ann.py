"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put into a leaf by going
down to the nearest child.  A query visits leaves best bin first: the open node
nearest to it is taken from a priority queue, until enough leaves are visited and
they hold enough rows.
How many is calibrated: for a bounded number of queries the true neighbours are
found among all rows, and visits widen until the wanted share of them is reached.

Of equal vectors only the k + 1 smallest ids can be an answer, so only those are
put into leaves.  Leaves are dealt to BUCKETS buckets, and a bucket meets its queries leaf
by leaf: it gives k rows a query, however many leaves the query visits.  What holds
more than TILE rows or is asked by more than TILE queries is split, so tasks stay
bounded whatever a leaf holds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Rows on which the tree is fitted, in expectation: FIT_ROOT times the root of all
#: rows, within these bounds.
FIT_ROWS, FIT_MOST, FIT_ROOT = 20_000, 200_000, 8
#: Queries whose true neighbours calibrate the visits, in expectation.
CALIBRATION = 400
#: Children of a node, rows that a leaf is meant to hold, sampled rows it needs.
BRANCH, LEAF_ROWS, LEAF_SAMPLE = 8, 512, 8
#: Buckets of leaves: their number is fixed, so rows found grow with queries alone.
BUCKETS = 32
#: Rows and queries of a tile of a bucket.
TILE = 32_768
RECALL = 0.97


class Tree:
    """centres[i] and children[i] of node i; a node without children is a leaf."""

    def __init__(self, points: np.ndarray, leaf_size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres, self.children = [points.mean(0) if len(points) else np.zeros(points.shape[1])], [[]]
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf_size:
                continue
            centres, label = _kmeans(own, BRANCH, rng)
            parts = [own[label == j] for j in range(len(centres))]
            if sum(len(p) > 0 for p in parts) < 2:
                continue
            for centre, part in zip(centres, parts):
                if len(part):
                    self.centres.append(centre)
                    self.children.append([])
                    self.children[node].append(len(self.centres) - 1)
                    todo.append((len(self.centres) - 1, part))
        self.centres = np.array(self.centres)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), np.int32)
        for node, below in enumerate(self.children):  # a child's number is above its parent's
            here = np.flatnonzero(at == node)
            if below and len(here):
                at[here] = np.array(below, np.int32)[np.argmax(points[here] @ self.centres[below].T, 1)]
        return at

    def visit(self, point: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first leaves, best bin first: so many, and more until their sizes add up to least."""
        near, out, held = 1.0 - self.centres @ point, [], 0
        heap = [(0.0, 0)]
        while heap and (len(out) < leaves or held < least):
            _, node = heapq.heappop(heap)
            if below := self.children[node]:
                for child in below:
                    heapq.heappush(heap, (float(near[child]), child))
            else:
                out.append(node)
                held += sizes.get(node, 0) if sizes else 0
        return out

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)


def _kmeans(points: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; an empty cluster goes."""
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        label = np.argmax(points @ centres.T, 1)
        kept = [points[label == j].mean(0) for j in range(len(centres)) if (label == j).any()]
        centres = np.array([c / (np.linalg.norm(c) or 1.0) for c in kept])
    return centres, np.argmax(points @ centres.T, 1)


def _matrix(column) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, row id, cosine) of each query's k nearest rows, its own id left out.

    A product finds what may be among them; those are scored pair by pair, so that
    equal vectors have equal scores wherever they are, and ties go to smaller ids.
    """
    out = []
    unit_q, unit_r = _unit(queries), _unit(rows)
    for i in range(0, len(queries), 256):
        near = unit_q[i:i + 256] @ unit_r.T
        near[ids[i:i + 256, None] == row_ids[None, :]] = -np.inf
        floor = np.partition(near, -k, 1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
        for j in range(len(near)):
            q = queries[i + j]
            may = np.flatnonzero((near[j] >= floor[j] - 1e-9) & (near[j] > -np.inf))
            v = rows[may]
            score = (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))
            best = np.lexsort((row_ids[may], -score))[:k]
            out += [(int(ids[i + j]), int(row_ids[may[b]]), float(score[b])) for b in best]
    return out


def _hits(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, c = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _brute(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """True neighbours of a bounded list of (vec_id, vector), every row compared."""
    ids = np.array([q[0] for q in queries], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, np.array([q[1] for q in queries], np.float64)))

    def run(batches):
        own_ids, own = shared.value
        best: dict[int, list] = {int(q): [] for q in own_ids}
        for batch in batches:
            if batch.num_rows:
                for hit in nearest(own, own_ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k):
                    best[hit[0]].append(hit)
                best = {q: sorted(found, key=lambda h: (-h[2], h[1]))[:k] for q, found in best.items()}
        yield _hits([h for found in best.values() for h in found])

    return _ranked(vectors.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: vec_id not null, and a
    vector that is not null, empty or zero, has no null or non-finite component, and has the
    most frequent length (the smaller one of two).  A repeated row counts once;
    of different vectors with one vec_id the smallest stands."""
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND exists(v, x -> x <> 0) AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    length = fine.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    return fine.where(F.size("v") == (length.k if length else -1)).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query, and recall:
    the share of true neighbours that the calibration found at the chosen visits.

    Queries are the usable rows (see usable) whose vec_id is divisible by every.
    An empty table, or one with a single usable row, gives no rows.  Columns other
    than vec_id and embedding are ignored; a very long vector is one of another
    length.
    """
    spark = vectors.sparkSession
    twin = Window.partitionBy("v").orderBy("vec_id")
    rows = materialize(usable(bounded_batches(vectors.select("vec_id", "embedding"))).withColumn("twin", F.row_number().over(twin)), "vectors")
    kept, total = rows.where(F.col("twin") <= k + 1).select("vec_id", "v"), rows.count()
    fit_rows = min(FIT_MOST, max(FIT_ROWS, int(FIT_ROOT * total ** 0.5)))
    chance = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = kept.where(chance < min(1.0, fit_rows / max(total, 1))).select("v").toArrow()  # fit_rows vectors
    points = _unit(_matrix(sample.column(0))) if sample.num_rows else np.empty((0, 1))
    tree = Tree(points, max(LEAF_SAMPLE, LEAF_ROWS * len(points) // max(total, 1)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf = shared.value.assign(_unit(_matrix(batch.column(1)))) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["vec_id", "v", "leaf"])

    placed = materialize(kept.mapInArrow(place, "vec_id long, v array<double>, leaf int"), "leaves")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    n_asked = asked.count()
    trial = [(r.vec_id, r.v) for r in asked.where(chance < min(1.0, CALIBRATION / max(n_asked, 1))).collect()]  # CALIBRATION vectors
    visits, reached = tree.leaves, 1.0
    if trial:
        true = _brute(placed.select("vec_id", "v"), trial, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # k rows a trial query
        turn = {q: {leaf: i for i, leaf in enumerate(tree.visit(_unit(np.array([v]))[0], tree.leaves))} for q, v in trial}
        needed = np.sort([turn[r.query_id][r.leaf] + 1 for r in true])
        if len(needed):
            visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
            reached = float((needed <= visits).mean())
    held = spark.sparkContext.broadcast({r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()})  # a number a leaf

    def go(batches):
        for batch in batches:
            points = _unit(_matrix(batch.column(1))) if batch.num_rows else []
            # The query's own row is none of its k.
            dealt = []
            for i, p in enumerate(points):
                own: dict[int, list[int]] = {}
                for leaf in shared.value.visit(p, visits, held.value, k + 1):
                    own.setdefault(leaf % BUCKETS, []).append(leaf)
                dealt += [(i, bucket, leaves) for bucket, leaves in own.items()]
            at, bucket, leaves = zip(*dealt) if dealt else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(bucket, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["vec_id", "v", "bucket", "leaves"])

    calls = materialize(asked.mapInArrow(go, "vec_id long, v array<double>, bucket int, leaves array<int>"), "calls")
    rows_of = placed.withColumn("bucket", F.pmod("leaf", F.lit(BUCKETS)))
    # A row a bucket.
    tiles = lambda df, name: df.groupBy("bucket").agg(F.expr(f"CAST(ceil(count(*) / {TILE}) AS INT)").alias(name))
    sizes = F.broadcast(tiles(rows_of, "row_tiles").join(tiles(calls, "call_tiles"), "bucket"))
    part = lambda n: F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.col(n)).cast("int")
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows_of.join(sizes, "bucket").withColumn("row_part", part("row_tiles")).withColumn("call_part", every_part("call_tiles"))
    right = calls.join(sizes, "bucket").withColumn("call_part", part("call_tiles")).withColumn("row_part", every_part("row_tiles"))
    keys = ["bucket", "row_part", "call_part"]

    def meet(own, other):
        best: dict[int, list] = {}
        if own.num_rows and other.num_rows:
            rows, ids, leaf = _matrix(own.column("v")), own.column("vec_id").to_numpy(), own.column("leaf").to_numpy()
            points, callers, wanted = _matrix(other.column("v")), other.column("vec_id").to_numpy(), other.column("leaves").combine_chunks()
            asks, caller = wanted.flatten().to_numpy(), np.repeat(np.arange(len(callers)), wanted.value_lengths().to_numpy())
            for one in np.unique(leaf):
                here, by = leaf == one, caller[asks == one]
                if len(by):
                    for hit in nearest(points[by], callers[by], rows[here], ids[here], k):
                        best.setdefault(hit[0], []).append(hit)
        return pa.Table.from_batches([_hits([h for found in best.values() for h in sorted(found, key=lambda h: (-h[2], h[1]))[:k]])])

    hits = left.select(*keys, "vec_id", "v", "leaf").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v", "leaves").groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return _ranked(hits, k).withColumn("recall", F.lit(reached))
