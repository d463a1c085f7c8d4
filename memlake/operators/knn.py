"""Exact nearest rows by cosine: one side streams by blocks of the other, in matrix products; or, by pivots, each row meets those cells alone that can hold a neighbour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.sources import scratch

BLOCK, TILE = 4096, 256
#: topk: so many bytes of vectors are held at a time by a task, and so many rows stream by them at most, WAIT bytes of vectors at a time.
HELD, STREAM, WAIT = 64 << 20, 1 << 18, 8 << 20
#: At most so many pivots, and as many cells; they and figures of their cells are all that the driver sees.
PIVOTS = 2048
#: Scores are rounded to six places, so rows within that of a bound can still be among the best.
SLACK = 2e-6
#: Rows of whole numbers (see whole): WIDE columns meet NARROW rows at a time; bytes hold the products of rows of at most MOST as sum of squares. Multiples of one number are known to EVEN of their
#: length, so scores by them to EXACT, within which a row can still be among the best.
WIDE, NARROW, MOST, EVEN, EXACT = 6 << 11, 128, 127, 2.5e-7, 4e-6


def topk(left: DataFrame, right: DataFrame, k: int, min_score: float, block: int | None = None, apart: bool = False) -> DataFrame:
    """(left id, right id, score, rank): for each row of left (id, vector) the k rows of right (id, vector) of largest cosine, at or above min_score, rounded to six
    places; of equal ones the smaller id. `apart` leaves out rows of equal ids. The ids keep their columns' names.

    Right is dealt into parts of `block` rows, by default as many as HELD bytes hold, and every row of left goes to each part once and streams by there (see meet): what is copied is left once for a part, and right once
    for STREAM rows of left (oftener only where that leaves cores without work). Rows meet those of equal length only; null vectors take no part, a zero vector has a cosine of 0."""
    (a, _), (b, _) = left.columns, right.columns
    left, right = (x.where("vector is not null").withColumn("cell", F.size("vector")) for x in (left, right))
    n, (m, longest) = left.count(), right.agg(F.count(F.lit(1)), F.max("cell")).first()
    block = block or max(1, HELD // (8 * max(1, longest or 1)))
    parts = max(1, -(-m // block))
    ways = max(1, -(-n // STREAM), min(-(-n // BLOCK), 2 * left.sparkSession.sparkContext.defaultParallelism // parts))
    deal = lambda c, ways: F.pmod(F.xxhash64(c), F.lit(ways)).cast("int")
    every = lambda ways: F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    data = right.select("cell", deal(b, parts).alias("part"), every(ways).alias("way"), F.col(b).alias("id"), "vector")
    asked = left.select("cell", every(parts).alias("part"), deal(a, ways).alias("way"), F.col(a).alias("key"), "vector", F.lit(float(min_score)).alias("least"))
    more = right.groupBy(b).count().agg(F.max("count")).first()[0] or 0 if apart else 0  # rows that share an id, which is once where ids are unique
    met = meet(data, asked, k + more, lambda batch: units(matrix(batch.column("vector")))).select(F.col("key").alias(a), F.col("id").alias(b), "score")
    met = met.where(~F.col(a).eqNullSafe(F.col(b))) if apart else met
    order = Window.partitionBy(a).orderBy(F.desc("score"), b)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_of_equal(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, vector) without those that k rows of the same vector and smaller ids come before: none of the k nearest of anything is among them."""
    return rows.where("vector is not null").withColumn("_n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("_n") <= k).drop("_n")


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of TILE rows at most: what a row has for each pivot or bin is held for so many rows at a time."""
    return (batch.slice(at, TILE) for batch in batches for at in range(0, len(batch), TILE))


def best(x: np.ndarray, data: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores): for each row of x the k columns of largest product with data, rounded, that are at or above its `least`, largest first and of equal ones the first column. BLOCK columns are looked at at a
    time, and those that can't be among the k best are left out by the bound that the columns before gave."""
    edge, found = np.array(least, dtype=np.float64), []
    for at in range(0, data.shape[1], BLOCK):
        scores = x @ data[:, at : at + BLOCK]
        hit = scores >= (edge - SLACK)[:, None]
        if scores.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(x):  # few, once a row's bound has risen
            edge = np.fmax(edge, np.partition(scores, -k, axis=1)[:, -k])
            hit = scores >= (edge - SLACK)[:, None]
        rows, columns = np.nonzero(hit)
        found.append((rows, columns + at, np.round(scores[rows, columns], 6)))
    rows, columns, own = (np.concatenate(c) for c in zip(*found, strict=True))
    kept = own >= least[rows]
    rows, columns, own = rows[kept], columns[kept], own[kept]
    order = np.lexsort((columns, -own, rows))
    rows, columns, own = rows[order], columns[order], own[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], columns[kept], own[kept]


def whole(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, which): each row as small whole numbers where it is such a row times one number, as counts of words are when scaled; which rows are, with a sum of squares of MOST at most."""
    out, which = np.zeros(vectors.shape, dtype=np.int8), np.zeros(len(vectors), dtype=bool)
    for at in range(0, len(vectors), BLOCK):
        part = vectors[at : at + BLOCK]
        least = np.where(part == 0, np.inf, np.abs(part)).min(axis=1, initial=np.inf)
        found = np.isinf(least) & np.isfinite(part).all(axis=1)  # zero rows
        for c in range(1, 7):
            left = np.flatnonzero(~found & np.isfinite(least))
            own = part[left] * (c / least[left])[:, None]
            near = np.rint(own)
            squares = (own * own).sum(1)
            good = (squares <= MOST + 0.5) & (((own - near) ** 2).sum(1) <= EVEN * EVEN * squares)
            out[at + left[good]], found[left[good]] = near[good], True
        which[at : at + BLOCK] = found
    return out, which


class Whole:
    """Columns of whole numbers, to find the best for rows of whole numbers. Six columns are one in a matrix product, as the bytes of a number under 2^53, which a product of doubles keeps exactly:
    with 2^52 and 128 a byte added, the product with each of them is a byte of the result."""

    def __init__(self, columns: np.ndarray, units: np.ndarray, at: np.ndarray):
        """Of units, the rows `at`, which are columns as whole numbers."""
        squares = (columns.astype(np.int64) ** 2).sum(1)
        self.order = np.argsort(squares, kind="stable")
        self.columns, self.squares, self.units, self.at = columns[self.order], squares[self.order], units, at

    def best(self, rows: np.ndarray, units: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As best(), but all that can be among the k best. No row is zero."""
        x = np.append(rows, np.ones((len(rows), 1), rows.dtype), axis=1).astype(np.float64)
        scale, edge, found, ends = np.sqrt((x[:, :-1] ** 2).sum(1)), np.array(least, dtype=np.float64), [], []
        for at in range(0, len(self.columns), WIDE):
            own, squares = self.columns[at : at + WIDE].astype(np.float64), self.squares[at : at + WIDE]
            own = np.append(own, np.zeros((-len(own) % 6, own.shape[1])), axis=0).reshape(-1, 6, own.shape[1])
            packed = np.append((own * 256.0 ** np.arange(6)[:, None]).sum(1), np.full((len(own), 1), 2.0**52 + 128 * (256.0 ** np.arange(6)).sum()), axis=1).T.copy()
            group = np.append(True, squares[1:] != squares[:-1])
            place = np.arange(len(squares)) // 6 * 8 + np.arange(len(squares)) % 6  # of each column's byte
            start, norms = place[group], np.sqrt(squares[group])
            stop = np.append(start[1:], place[-1] + 1)
            inverse = np.divide(1.0, norms, out=np.zeros(len(norms)), where=norms > 0)
            group = np.cumsum(group) - 1
            for a in range(0, len(x), NARROW):
                tile = slice(a, a + NARROW)
                sums = (x[tile] @ packed).view(np.uint8)
                most = (np.maximum.reduceat(sums, start, axis=1) - 128.0) * inverse
                top = most.max(axis=1) / scale[tile]
                near = np.flatnonzero(top >= edge[tile] - EXACT)
                if not len(near):
                    continue
                way = scale[tile][near]
                if k == 1:
                    raised = np.where(top[near] > 0, top[near], edge[tile][near])  # the bytes above the six count as less than 0
                elif len(place) >= k:
                    raised = np.partition((sums[near][:, place] - 128.0) * inverse[group], -k, axis=1)[:, -k] / way
                else:
                    raised = edge[tile][near]
                edge[a + near] = np.fmax(edge[a + near], raised)
                bound = (edge[a + near] - EXACT) * way
                i, g = np.nonzero(most[near] >= bound[:, None])
                byte = np.ceil(bound[i] * norms[g] + 128 - 1e-9).clip(0, 255).astype(np.int64)
                for r, own, u, v in zip(near[i].tolist(), byte.tolist(), start[g].tolist(), stop[g].tolist(), strict=True):
                    hit = (sums[r, u:v] >= own).nonzero()[0] + u
                    found.append((np.repeat(a + r, len(hit)), hit, sums[r, hit]))
                    ends.append(at)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        at = np.repeat(ends, [len(f[0]) for f in found])
        row, byte, value = (np.concatenate(c) for c in zip(*found, strict=True))
        column = at + byte // 8 * 6 + byte % 8
        kept = (byte % 8 < 6) & (column < np.minimum(at + WIDE, len(self.columns)))
        row, column, value = row[kept], column[kept], value[kept].astype(np.float64) - 128
        kept = value >= (edge[row] - EXACT) * scale[row] * np.sqrt(self.squares[column]) - 1e-9
        row, column = row[kept], self.order[column[kept]]
        step = 1 << 16
        scores = [np.einsum("ij,ij->i", units[row[x : x + step]], self.units[self.at[column[x : x + step]]]) for x in range(0, len(row), step)]
        return row, column, np.round(np.concatenate([*scores, np.empty(0)]), 6)


class Held:
    """Unit vectors in the order of their ids, and the best of them for rows of unit vectors: six at a time where both are of whole numbers."""

    def __init__(self, units: np.ndarray):
        own, which = whole(units)
        self.units, self.at, self.rest = units, np.flatnonzero(which), np.flatnonzero(~which)
        self.whole = Whole(own[which], units, self.at)

    def best(self, x: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least, found = np.array(least, dtype=np.float64), []
        own, which = whole(x) if len(self.at) else (None, np.zeros(len(x), dtype=bool))
        which &= (x != 0).any(axis=1) if len(self.at) else False
        empty = np.flatnonzero(~(x != 0).any(axis=1))  # a zero vector is as near to all
        first = np.arange(min(k, len(self.units)))
        zero = empty[least[empty] <= 0]
        found.append((np.repeat(zero, len(first)), np.tile(first, len(zero)), np.zeros(len(zero) * len(first))))
        at = np.flatnonzero(which)
        if len(at):
            rows, columns, scores = self.whole.best(own[at], x[at], k, least[at])
            found.append((at[rows], self.at[columns], scores))
        for rows, columns in ((at, self.rest), (np.setdiff1d(np.arange(len(x)), np.append(at, empty)), None)):
            data = self.units.T if columns is None else self.units[columns].T
            for a in range(0, len(rows) if data.shape[1] else 0, TILE):
                part = rows[a : a + TILE]
                r, c, scores = best(x[part], data, k, least[part])
                found.append((part[r], c if columns is None else columns[c], scores))
        rows, columns, scores = (np.concatenate(c) for c in zip(*found, strict=True))
        rows, columns = rows.astype(np.int64), columns.astype(np.int64)
        kept = scores >= least[rows]
        rows, columns, scores = rows[kept], columns[kept], scores[kept]
        order = np.lexsort((columns, -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[kept], columns[kept], scores[kept]


def meet(data: DataFrame, asked: DataFrame, k: int, read: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(key, id, score): the k best rows of data (cell, part, way, id, and what `read` makes unit vectors from) for each row of asked (cell, part, way, key, vector, least), of those of equal
    (cell, part, way) whose score is `least` or more. Both sides are dealt by these three and sorted, data first: a task holds BLOCK rows or so of one part and lets those asked for stream by."""
    at = ["cell", "part", "way"]
    payload = [c for c in data.columns if c not in (*at, "id")]
    kinds = {c: data.schema[c].dataType for c in ("id", *payload)} | {c: asked.schema[c].dataType for c in ("key", "vector", "least")}
    null = lambda names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
    both = data.select(*at, F.lit(0).alias("kind"), "id", *payload, *null(c for c in ("key", "vector", "least") if c not in payload))
    both = both.unionByName(asked.select(*at, F.lit(1).alias("kind"), *null(c for c in ("id", *payload) if c != "vector"), "key", "vector", "least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, ready, waiting = None, [], [], None, []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if not waiting or not ids:
                waiting.clear()
                return
            if ready is None:
                held = pa.chunked_array(ids).to_pylist()
                order = np.array(sorted(range(len(held)), key=held.__getitem__), dtype=np.int64)
                every = np.concatenate(parts)
                parts.clear()
                every = every[order]
                ready = pa.array([held[i] for i in order], ids[0].type), Held(every)
            keys, vectors, least = zip(*waiting, strict=True)
            waiting.clear()
            rows, columns, scores = ready[1].best(np.concatenate(vectors), k, np.concatenate(least))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(pa.array(rows)), ready[0].take(pa.array(columns)), pa.array(scores)], names=["key", "id", "score"])

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in (*at, "kind")], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if tuple(marks[a, :3]) != place:
                    yield from answers()
                    place, ids, parts, ready = tuple(marks[a, :3]), [], [], None
                if marks[a, 3] == 0:
                    ids.append(own.column("id"))
                    parts.append(read(own))
                    continue
                if not ids:
                    continue
                waiting.append((own.column("key"), units(matrix(own.column("vector"))), own.column("least").to_numpy()))
                if sum(w[1].nbytes for w in waiting) >= WAIT:
                    yield from answers()
        yield from answers()

    dealt = both.repartition(*at).sortWithinPartitions(*at, "kind")
    return dealt.mapInArrow(run, f"key {kinds['key'].simpleString()}, id {kinds['id'].simpleString()}, score double")


def pivot_topk(rows: DataFrame, k: int, min_score: float, pivots: int | None = None, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """(source_id, target_id, score, rank): topk of rows (id, vector) with themselves, each apart from its own id; the same rows as topk gives, without all pairs of blocks. Ids are unique.

    Some rows are pivots; each row belongs to its nearest pivot's cell. The triangle inequality between a row, a pivot and the range of angles in that pivot's cell, and the distance to the
    plane between two pivots, tell how near a row of each cell can be. A row goes to the cells that can hold its nearest first, in rounds of 1, 1, 2, 4 ... bins: the k found so far bound
    how far its k nearest can be, and cells beyond that are never sent to. Vectors that lie in groups meet few cells, however many rows there are; those without any structure meet all, which is as much as blocks would do: cells are dealt in bins of a
    block's size, and a row goes to a bin once.

    Equal vectors ask once, and no more than the k + 1 smallest ids of them can be anyone's neighbours, so a large group of copies costs as much as one row. `report` gets the number of parts
    that each asking vector was sent to on average. Vectors of several lengths, which no pivot spans, go by blocks."""
    rows = rows.select("id", "vector").where("vector is not null")
    dims, n = rows.agg(F.count_distinct(F.size("vector")), F.count(F.lit(1))).first()
    if dims != 1:
        found = topk(rows.withColumnRenamed("id", "source_id"), rows.withColumnRenamed("id", "target_id"), k, min_score, apart=True)
        return found.select("source_id", "target_id", "score", "rank")
    copies = Window.partitionBy("vector").orderBy("id")
    held = rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1)
    chosen = held.orderBy(F.xxhash64("id"), "id").limit(pivots or min(PIVOTS, max(1, int(n**0.5)))).select("vector").collect()  # PIVOTS rows at most
    points = units(np.array([r[0] for r in chosen], dtype=np.float64))
    kind = rows.schema["id"].dataType.simpleString()
    zero_cell = len(points)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tiles(batches):
            x = units(matrix(batch.column("vector")))
            cos = np.clip(x @ points.T, -1, 1)
            cell = cos.argmax(1)
            angle = np.arccos(cos[np.arange(len(cell)), cell])
            cell[~x.any(1)] = zero_cell  # a zero vector has a cosine of 0 with all
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "vector", "_n", "cell", "angle"])

    held = scratch.held(held.select("id", "vector", "_n").mapInArrow(placed, f"id {kind}, vector {rows.schema['vector'].dataType.simpleString()}, _n int, cell int, angle double"), "cells")
    figures = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # a row for each cell
    size, low, high = np.zeros(zero_cell + 1, dtype=np.int64), np.zeros(zero_cell + 1), np.zeros(zero_cell + 1)
    for r in figures:
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    # cells of near pivots share a bin of a block's size, and a row is sent to a bin once; a cell that is larger is a bin of several parts
    near = (points @ points[: max(1, -(-int(size.sum()) // block))].T).argmax(1)
    bin_of, filled = np.zeros(zero_cell + 1, dtype=np.int32), [0]
    for c in [*np.lexsort((np.arange(zero_cell), near)), zero_cell]:
        if filled[-1] and filled[-1] + size[c] > block:
            filled.append(0)
        bin_of[c] = len(filled) - 1
        filled[-1] += int(size[c])
    n_parts = np.maximum(1, -(-np.array(filled) // block))
    spread = lambda c, ways: F.pmod(F.xxhash64(c), ways).cast("int")
    small = lambda rows_, schema: F.broadcast(rows.sparkSession.createDataFrame(rows_, schema))
    bins = small([(c, int(b), int(n_parts[b])) for c, b in enumerate(bin_of)], "cell int, bin int, parts int")  # PIVOTS + 1 at most
    held = held.join(bins, "cell").select("id", "vector", "_n", F.col("bin").alias("cell"), spread("id", F.col("parts")).alias("part"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    read = lambda batch: units(matrix(batch.column("vector")))
    asking = held.where("_n = 1")
    far = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row the bins, and the largest cosine that a row of each can have, largest first."""
        for batch in tiles(batches):
            x = units(matrix(batch.column("vector")))
            cos = np.clip(x @ points.T, -1, 1)
            own, angle = cos.argmax(1), np.arccos(cos)
            most = np.cos(np.maximum(0, np.maximum(angle - high[None, :-1], low[None, :-1] - angle)))
            apart = far[own]
            plane = np.divide(cos[np.arange(len(own)), own][:, None] - cos, apart, out=np.zeros_like(cos), where=apart > 1e-9)
            most = np.minimum(most, 1 - plane * plane / 2)
            most[~x.any(1)] = 1.0
            most = np.concatenate([most, np.zeros((len(x), 1))], axis=1)
            most[:, size == 0] = -np.inf
            by_bin = np.maximum.reduceat(most[:, by], np.flatnonzero(np.diff(bin_of[by], prepend=-1)), axis=1)
            by_bin[np.arange(len(x)), np.where(x.any(1), bin_of[own], bin_of[zero_cell])] += 1  # its own bin comes first
            order = np.argsort(-by_bin, axis=1, kind="stable")
            reach = [(o[b[o] >= min_score - SLACK].astype(np.int32), b[o][b[o] >= min_score - SLACK]) for o, b in zip(order, by_bin, strict=True)]
            columns = [pa.array([r[0] for r in reach], pa.list_(pa.int32())), pa.array([r[1] for r in reach], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), *columns], names=["id", "vector", "cells", "most"])

    by = np.lexsort((np.arange(zero_cell + 1), bin_of))
    reach = asking.select("id", "vector").mapInArrow(reaching, f"id {kind}, vector {rows.schema['vector'].dataType.simpleString()}, cells array<int>, most array<double>")
    reach = scratch.held(reach, "reach")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found, sent, lo = None, 0, 0
    while lo < len(n_parts):  # rounds of 1, 1, 2, 4 ... bins: each leaves about k rows more of each row, as its bound has risen with the bins before
        hi = min(len(n_parts), max(1, 2 * lo))
        own = reach.select(F.col("id").alias("key"), "vector", F.slice(F.arrays_zip("cells", "most"), lo + 1, hi - lo).alias("bins")).where(F.size("bins") > 0)
        if found is not None:
            bound = found.groupBy("key").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"))
            own = own.join(bound, "key", "left")
        else:
            own = own.withColumn("least", F.lit(None).cast("double"))
        own = own.withColumn("least", F.coalesce("least", F.lit(float(min_score)))).select("key", "vector", "least", F.explode(F.filter("bins", lambda b: b["most"] >= F.col("least") - SLACK)).alias("b"))
        own = scratch.held(own.select("key", "vector", "least", F.col("b.cells").alias("cell")), "asked")
        arrivals = np.zeros(len(n_parts), dtype=np.int64)
        for r in own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each bin
            arrivals[r["cell"]] = r["n"]
        sent, lo = sent + int((arrivals * n_parts).sum()), hi
        if not arrivals.any():
            continue
        ways = np.maximum(1, -(-arrivals // (16 * block)))
        dealt = small([(b, int(n_parts[b]), int(ways[b])) for b in range(len(n_parts)) if arrivals[b]], "cell int, parts int, ways int")
        data = held.join(dealt, "cell").select("cell", "part", every(F.col("ways")).alias("way"), "id", "vector")
        asked = own.join(dealt, "cell").select("cell", every(F.col("parts")).alias("part"), spread("key", F.col("ways")).alias("way"), "key", "vector", "least")
        new = meet(data, asked, k + 1, read)
        new = (new if found is None else new.unionByName(found)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
        found = scratch.held(new.select("key", "id", "score"), "found")
    if report is not None:
        report.append(sent / max(1, reach.count()))
    if found is None:
        return rows.select(F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    found = found.withColumn("_n", F.row_number().over(order))
    near = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_n", "id", "score"))).alias("near"))  # k + 1 of them
    asker = rows.groupBy("vector").agg(F.min("id").alias("key"))
    members = rows.join(asker, "vector").select(F.col("id").alias("source_id"), "key")
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("source_id")), 1, k)
    return members.join(near, "key").select("source_id", F.posexplode(own).alias("rank", "x")).select("source_id", F.col("x.id").alias("target_id"), F.col("x.score").alias("score"), (F.col("rank") + 1).alias("rank"))
