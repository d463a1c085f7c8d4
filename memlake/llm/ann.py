"""Approximate nearest neighbours by collision counting over single random projections, with virtual rehashing.

Vectors are dealt once, by hash, into blocks; each block holds one sorted array for each of PROJECTIONS random directions. A query opens in every array a window around its
own projection, and a vector collides once for each array in whose window it lies. Windows are ranges of ranks and are widened step by step (virtual rehashing: no array is built
anew, both ends move outwards) until enough of a block's vectors collide THRESHOLD of PROJECTIONS times or more; those of the
highest threshold that enough of them pass are verified by their inner product in double precision.

Enough is SHARE * n ** -FALL of n vectors (and 20 k at least): the more vectors there are, the nearer are a query's k nearest, and the smaller the part
in which they are found. So the vectors verified for a query grow as n ** (1 - FALL).

Largest inner product is brought to nearest distance by one more component: sqrt(M^2 - |x|^2) for vectors, 0 for queries, M the
largest norm, queries scaled to M.

The stated set of queries meets all rows: every query is read once in each block, as part of a stream, after the block's arrays are built. A task holds one block and a batch of
queries; vectors are never copied. The best k of all blocks are then ranked.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors meet those of equal length only; of equal
scores the smaller vec_id comes first; rows that repeat a vec_id are candidates of their own, except for their own query; fewer
candidates than k: all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

PROJECTIONS, THRESHOLD, K = 240, 104, 20
SHARE, FALL = 4.5, 0.37
FIRST, WIDER = 0.3, 1.15
BLOCK, TILE = 8192, 64


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v, dim, norm2) of vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select("vec_id", v.alias("v"), F.size("embedding").alias("dim"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("norm2"))


@functools.lru_cache(maxsize=4)
def _directions(dim: int) -> np.ndarray:
    return np.random.RandomState(9).normal(size=(dim, PROJECTIONS))


class Block:
    """Sorted arrays of a block of vectors (of 65536 at most), and each vector's rank in them. `share` of the vectors are verified for a query."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, largest: float, share: float, k: int):
        self.ids, self.x, self.share, self.k, self.first = ids, x, share, k, FIRST
        scaled = x / largest
        tail = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        projected = np.hstack([scaled, tail[:, None]]) @ _directions(x.shape[1] + 1)
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T)
        self.ranks = np.empty((PROJECTIONS, len(x)), dtype=np.uint16)
        for j in range(PROJECTIONS):
            self.ranks[j, order[:, j]] = np.arange(len(x), dtype=np.uint16)

        own = (x[:TILE] / np.linalg.norm(x[:TILE], axis=1, keepdims=True)) @ _directions(x.shape[1] + 1)[:-1]
        self.ended = np.full(len(own), FIRST)
        for _ in self.colliding(own):
            pass
        self.first = max(FIRST, float(np.quantile(self.ended, 0.2)))  # windows start near to where those of the block's first vectors end, whatever is asked

    def collisions(self, projected: np.ndarray, half: np.ndarray) -> np.ndarray:
        """For queries (projections, half widths of their windows): how often each vector collides. A window is a range of ranks, found at both of its ends."""
        n, m = len(projected), len(self.ids)
        counts = np.zeros((n, m), dtype=np.uint8)
        shifted, inside = np.empty((n, m), dtype=np.uint16), np.empty((n, m), dtype=bool)
        for j in range(PROJECTIONS):
            low = np.searchsorted(self.sorted[j], projected[:, j] - half, side="left")
            length = np.searchsorted(self.sorted[j], projected[:, j] + half, side="right") - low
            np.subtract(self.ranks[j][None, :], low.astype(np.uint16)[:, None], out=shifted)
            np.less(shifted, length.astype(np.uint16)[:, None], out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return counts

    def colliding(self, projected: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(query, places of the vectors that collide often enough with it) for queries given by their projections: windows widen until enough are found."""
        n = len(self.ids)
        needed = max(20 * self.k + 1, int(np.ceil(self.share * n)))
        if needed >= n:
            yield from ((i, np.arange(n)) for i in range(len(projected)))
            return
        todo, half = np.arange(len(projected)), np.full(len(projected), self.first)
        while len(todo):
            counts = self.collisions(projected[todo], half[todo])
            enough = (counts >= THRESHOLD).sum(1) >= needed
            for own, i in zip(counts[enough], todo[enough], strict=True):
                # a step may pass by what is needed: then the threshold rises to where it is met
                yield i, np.flatnonzero(own >= np.partition(own, n - needed)[n - needed])
            todo = todo[~enough]
            half[todo] *= WIDER
        self.ended = half

    def search(self, queries: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, vec_ids, scores, verified): the best k verified vectors of each query, and how many were verified."""
        projected = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ _directions(q.shape[1] + 1)[:-1]
        for at in range(0, len(q), TILE):
            for i, found in self.colliding(projected[at : at + TILE]):
                query = queries[at + i]
                found = found[self.ids[found] != query]
                scores = np.einsum("ij,j->i", self.x[found], q[at + i])
                verified = len(found)
                if verified > 4 * self.k:  # ties at the k-th score stay
                    edge = np.partition(scores, verified - self.k)[verified - self.k]
                    found, scores = found[scores >= edge], scores[scores >= edge]
                best = np.lexsort((self.ids[found], -scores))[: self.k]
                yield query, self.ids[found[best]], scores[best], verified


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): rows and queries hold (vec_id, embedding); verified is how many vectors of the block
    that a neighbour comes from were verified for the query."""
    data, asked = usable(rows), usable(queries)
    n, largest = data.agg(F.count(F.lit(1)), F.max("norm2")).first()
    if not n or not asked.count():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    largest, share, blocks = float(np.sqrt(largest)), min(1.0, SHARE * n**-FALL), max(1, -(-n // BLOCK))
    d = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    left = data.select("dim", d.alias("d"), F.lit(0).alias("kind"), "vec_id", "v")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("d"), F.lit(1).alias("kind"), "vec_id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, built = None, [], [], []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                dim, _, kind = keys[a]
                if tuple(keys[a, :2]) != key:
                    key, ids, held, built = tuple(keys[a, :2]), [], [], []
                own = batch.column(3).slice(a, b - a).to_numpy()
                vectors = batch.column(4).slice(a, b - a).flatten().to_numpy().reshape(-1, dim)
                if kind == 0:
                    ids.append(own)
                    held.append(vectors)
                    continue
                if ids:
                    all_ids, all_vectors = np.concatenate(ids), np.concatenate(held)
                    ids, held = [], []
                    built = [Block(all_ids[x : x + 2 * BLOCK], all_vectors[x : x + 2 * BLOCK], largest, share, k) for x in range(0, len(all_ids), 2 * BLOCK)]
                for part in built:
                    for query, found, scores, verified in part.search(own, vectors):
                        out.append((np.full(len(found), query), found, scores, np.full(len(found), verified)))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64, np.int64), strict=True)], names=["query_id", "vec_id", "score", "verified"])

    dealt = left.unionByName(right).repartition(4 * blocks, "dim", "d").sortWithinPartitions("dim", "d", "kind", "vec_id", "v")  # so a block is the same in every run
    met = dealt.mapInArrow(meet, "query_id long, vec_id long, score double, verified long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "verified")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
