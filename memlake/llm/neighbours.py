"""N-gram Jaccard join by Bayesian candidate pruning.

A document is the set of its 5-word shingles (lower case, words between white space; a shorter text is one shingle). Documents of equal
sets are one node. Nodes meet in the buckets of BANDS bands of their MinHash values (a pair at similarity 0.8 misses all of them
once in 300,000 times). In a bucket, values are compared ROUND at a time, and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold, given so many equal values, is under TOLERANCE. A pair that meets in several buckets belongs to that of its first equal band. What survives
joins nodes into components, and in each the pairs are verified on the whole shingle sets.

No pair is emitted: buckets and candidate components are cut into blocks by hash, of BLOCK nodes or BLOCK_BYTES of sets, a task compares two blocks in memory, and
only a spanning forest of the surviving pairs and counts of links leave it. So a bucket or component of any size is dealt over many tasks, whole.

Result: one row for each document with class_id (smallest doc_id of its connected class), n_links (how many other documents are at or
above the threshold, copies included) and n_shingles.

Defined cases: a null text counts as empty; empty texts have no shingles, are in classes of one and have no links; copies are linked with each other; rows that repeat a doc_id
count as documents of their own in n_links; rows without a doc_id take no part (no class, no links); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import cut, remove, small_batches, table, text_of

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
ROUND, TOLERANCE, BLOCK, BLOCK_BYTES = 16, 1e-6, 1024, 8 << 20
#: Nodes to be read again are sent to every task if they take so many bytes at most (NODE_BYTES each), else texts are joined to them by a shuffle.
BROADCAST_BYTES, NODE_BYTES = 32 << 20, 96

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles: differences of polynomial prefix sums over its bytes."""
    raw = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-8", "replace"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    size = 1 << max(12, int(len(raw)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(raw))
    n = max(1, len(starts) - k + 1)
    starts, ends = starts[:n], ends[min(k, len(ends)) - 1 :][:n]
    return np.unique(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE)))


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20)
    draw = lambda: (r.randint(0, 1 << 32, BANDS * ROWS).astype(np.uint64) << np.uint64(32)) | r.randint(0, 1 << 32, BANDS * ROWS).astype(np.uint64)
    return draw() | np.uint64(1), draw()


def minhash(hashes: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    best = np.full(len(a), (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(hashes), 256):
        block = (hashes[i : i + 256, None] * a + b) >> np.uint64(32)
        np.minimum(best, block.min(axis=0).astype(np.uint32), out=best)
    return best


@functools.cache
def fewest_matches() -> tuple[int, ...]:
    """By number of values compared: under so many equal ones, a pair is dropped. The posterior is Beta(1 + equal, 1 + unequal) over similarities in [0, 1]."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(ROUND, BANDS * ROWS + 1, ROUND):
        for m in range(n + 1):
            log_pdf = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
            if np.exp(log_pdf[grid >= THRESHOLD]).sum() / 20_000 >= TOLERANCE:
                out.append(m)
                break
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of rows whose values leave the threshold possible; values are compared ROUND by ROUND, among the pairs still alive."""
    fewest = fewest_matches()
    counts = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(ROUND):
        counts += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(counts >= fewest[0])
    equal = counts[i, j].astype(np.int64)
    for r in range(1, len(fewest)):
        span = slice(r * ROUND, (r + 1) * ROUND)
        equal = equal + np.concatenate([(left[i[a : a + 65536], span] == right[j[a : a + 65536], span]).sum(1) for a in range(0, len(i), 65536)] or [np.zeros(0, dtype=np.int64)])
        alive = equal >= fewest[r]
        i, j, equal = i[alive], j[alive], equal[alive]
    return np.stack([i, j], axis=1)


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph."""
    above = list(range(n))
    out = []

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, signature): node is the digest of the shingle set, null if there is none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, values = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "node", "n", "signature"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(made, f"doc_id {kind}, node binary, n long, signature binary")


def _blocks(rows: DataFrame) -> DataFrame:
    """Deals rows of groups of `parts` blocks over pairs of blocks: every two rows of a group meet in exactly one pair (i, j)."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")


def _each_group(rows: DataFrame, keys: list[str], columns: list[str], work, schema: str) -> DataFrame:
    """work(rows of a group as a pandas frame) -> list of tuples; groups are read one after another from sorted partitions."""
    fields = pa.schema([(f.split()[0], {"binary": pa.binary(), "long": pa.int64()}[f.split()[1]]) for f in schema.split(", ")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        out: list[tuple] = []

        def done() -> None:
            if held:
                out.extend(work(pd.concat(held, ignore_index=True)))
                held.clear()

        for frame in frames:
            change = np.flatnonzero((frame[keys].values[1:] != frame[keys].values[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *change], [*change, len(frame)], strict=True):
                if a == b:
                    continue
                now = tuple(frame[keys].values[a])
                if key is not None and now != key:
                    done()
                key = now
                held.append(frame.iloc[a:b])
            if len(out) > 2048:
                yield pd.DataFrame(out, columns=fields.names)
                out = []
        done()
        if out:
            yield pd.DataFrame(out, columns=fields.names)

    rows = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, schema)


def _sides(g: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
    if i == j:
        return g, g, True
    return g[g["part"] == i], g[g["part"] == j], False


def _first_shared(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, band: int) -> np.ndarray:
    """Which pairs agree in no band before `band`."""
    a, b = (np.ascontiguousarray(x[:, : band * ROWS]).reshape(len(x), band, ROWS) for x in (left, right))
    own = np.ones(len(pairs), dtype=bool)
    for k in range(band):
        at = np.flatnonzero(own)
        for x in range(0, len(at), 65536):
            some = at[x : x + 65536]
            own[some] = (a[pairs[some, 0], k] != b[pairs[some, 1], k]).any(axis=1)
    return own


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the pairs in each bucket that pruning leaves, from (node, signature)."""
    band = lambda b: F.struct(F.lit(b).cast("long").alias("band"), F.xxhash64(F.lit(b), F.substring("signature", F.lit(1 + 4 * ROWS * b), F.lit(4 * ROWS))).alias("bucket"))
    keys = nodes.select("node", F.inline(F.array(*(band(b) for b in range(BANDS)))))
    sizes = keys.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = cut(_blocks(keys.join(sizes, "bucket")), "buckets")
    rows = members.join(nodes, "node")

    def work(g: pd.DataFrame) -> list[tuple]:
        left, right, same = _sides(g)
        if not len(left) or not len(right):
            return []
        read = lambda x: np.frombuffer(b"".join(x["signature"]), dtype=np.uint32).reshape(len(x), -1)
        a, b = read(left), read(right)
        pairs = surviving(a, b)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]] if same else pairs
        pairs = pairs[_first_shared(a, b, pairs, int(g["band"].iloc[0]))] + (0, 0 if same else len(left))
        names = list(left["node"]) if same else [*left["node"], *right["node"]]
        return [(names[x], names[y]) for x, y in forest(len(names), pairs)]

    found = cut(_each_group(rows, ["bucket", "i", "j"], ["part", "band", "node", "signature"], work, "a binary, b binary").distinct(), "candidate-edges")
    remove(members)
    return found


def verified(members: DataFrame) -> DataFrame:
    """From (comp, node, copies, shingles), dealt in blocks: rows (a, b, links): node a has so many links found in this task; b is another node of a
    spanning forest of the links, or null."""

    def work(g: pd.DataFrame) -> list[tuple]:
        left, right, same = _sides(g)
        if not len(left) or not len(right):
            return []
        sets = lambda x: [np.frombuffer(s, dtype=np.uint64) for s in x["shingles"]]
        a_sets = sets(left)
        linked = np.argwhere(similar(a_sets, a_sets if same else sets(right)))
        if same:
            linked = linked[linked[:, 0] < linked[:, 1]]
        if not len(linked):
            return []
        copies = np.asarray(left["copies"]), np.asarray(right["copies"])
        n, shift = len(left), 0 if same else len(left)
        links = np.zeros(n + (0 if same else len(right)), dtype=np.int64)
        np.add.at(links, linked[:, 0], copies[1][linked[:, 1]])
        np.add.at(links, linked[:, 1] + shift, copies[0][linked[:, 0]])
        names = list(left["node"]) if same else [*left["node"], *right["node"]]
        out = [(names[x], names[y], 0) for x, y in forest(len(names), linked + (0, shift))]
        return out + [(names[x], None, int(links[x])) for x in np.flatnonzero(links)]

    return _each_group(members, ["comp", "i", "j"], ["part", "node", "copies", "shingles"], work, "a binary, b binary, links long")


def similar(a_sets: list[np.ndarray], b_sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Matrix of which sets reach the threshold, counted on the whole sets: shingles that both sides hold become columns of 0 and 1, and products of
    such matrices, `columns` at a time, add up to the sizes of all intersections (exact in floats, as no product passes 2^24)."""
    sizes = [np.array([len(x) for x in sets]) for sets in (a_sets, b_sets)]
    known = np.intersect1d(np.unique(np.concatenate(a_sets)), np.unique(np.concatenate(b_sets)), assume_unique=True)
    entries = []
    for sets, n in zip((a_sets, b_sets), sizes, strict=True):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        place = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        hit = known[place] == flat if len(known) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(place[hit], kind="stable")
        entries.append((row[hit][order], place[hit][order]))
    shared = np.zeros((len(a_sets), len(b_sets)), dtype=np.int64)
    for low in range(0, len(known), columns):
        width = min(columns, len(known) - low)
        sides = []
        for (row, place), sets in zip(entries, (a_sets, b_sets), strict=True):
            x, y = np.searchsorted(place, [low, low + width])
            rows, at = np.unique(row[x:y], return_inverse=True)  # sets that hold none of these columns stay out of the product
            side = np.zeros((len(rows), width), dtype=np.float32)
            side[at, place[x:y] - low] = 1
            sides.append((rows, side))
        (r, left), (c, right) = sides
        shared[np.ix_(r, c)] += (left @ right.T).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return shared * 5 >= union * 4 if THRESHOLD == 0.8 else shared >= THRESHOLD * union


def _sets(docs: DataFrame, wanted: DataFrame, small: bool) -> DataFrame:
    """wanted (rep, node, ...) with the nodes' shingle sets, made again from the texts of their representatives."""
    wanted = F.broadcast(wanted) if small else wanted
    rows = docs.select(F.col("doc_id").alias("rep"), text_of().alias("text")).join(wanted, "rep")
    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            right = [xxhash.xxh3_128_digest(s.tobytes()) == n for s, n in zip(sets, batch.column("node").to_pylist(), strict=True)]  # repeated doc_ids may have other texts
            whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])
            yield whole.filter(pa.array(right, pa.bool_()))

    return rows.select(*names, "text").mapInArrow(made, f"{schema}, shingles binary")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class, class_id, n_links, n_shingles): class is the same for all nodes of a class, null if there is no node."""
    small_batches(docs.sparkSession)
    signed = cut(signatures(docs), "signatures")
    reps = signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    own = signed.where("node is not null").select("node", F.col("doc_id").alias("rep"), "n", "signature")
    nodes = cut(reps.join(own, ["node", "rep"]).dropDuplicates(["node"]), "nodes")
    edges = candidate_edges(nodes.select("node", "signature"))
    near = components(edges).join(nodes.select("node", "rep", "copies", "n"), "node")
    near = cut(near, "candidates")
    bytes_ = F.sum(F.col("n") * 8)
    sizes = near.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(bytes_ / BLOCK_BYTES)).cast("int").alias("parts"))
    dealt = near.drop("n").join(sizes, "comp")
    whole = _sets(docs, dealt, near.count() * NODE_BYTES <= BROADCAST_BYTES).drop("rep")
    repeated = signed.where("node is not null").groupBy("doc_id").count().where("count > 1").limit(1)
    if not repeated.isEmpty():  # only then can a representative's text be read twice
        whole = whole.dropDuplicates(["node"])
    found = cut(verified(_blocks(whole)), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.where("b is not null").select("a", "b")).join(nodes.select("node", "rep"), "node")
    tops = classes.groupBy("comp").agg(F.min("rep").alias("class_id"))
    by_node = nodes.select("node", "rep", "copies").join(classes.select("node", "comp"), "node", "left").join(tops, "comp", "left").join(links, "node", "left")
    by_node = by_node.select("node", F.coalesce("comp", "node").alias("class"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_node = cut(by_node, "node-classes")
    for done in (edges, near, found, nodes):
        remove(done)
    out = signed.select("doc_id", "node", F.col("n").alias("n_shingles")).join(by_node, "node", "left")
    return out.select("doc_id", "node", "class", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return _classes(docs).select("doc_id", "class_id", "n_links", "n_shingles")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@F.pandas_udf(T.BinaryType())
def _node(texts: pd.Series) -> pd.Series:
    sets = texts.map(shingles)
    return sets.map(lambda s: xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that with the smallest doc_id; of its repeated rows, one. A doc_id with several texts is several documents, each in the class of its text."""
    found = cut(_classes(docs).select("doc_id", "node", "class", "class_id"), "classes")
    gone = found.where("doc_id <> class_id").select("doc_id").distinct()
    repeated = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(repeated, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    first = found.where("doc_id = class_id and node is not null").join(repeated, "doc_id").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("_node"))
    several = docs.join(repeated, "doc_id").withColumn("_node", _node(text_of()))
    kept = several.join(first.select("doc_id", "_node"), ["doc_id", "_node"]).dropDuplicates(["doc_id", "_node"]).select(*docs.columns)
    blank = several.where("_node is null").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return once.unionByName(kept).unionByName(blank)
