"""The trie of conversations' beginnings, and what each of its nodes saves if shared turns are kept once.

Each node is owned by its smallest member. A conversation's path goes from larger groups to smaller ones, whose smallest members only grow, so what it owns is the end of its path.
A node's saving, the sum of (members - 1) x tokens over its subtree, is then a sum over its members alone: the tokens of each one's occurrences from the node on, less those of occurrences
that it owns. Likewise leaves and children are counted where their owners pass. So one group-by of all occurrences by prefix gives every node's figures, and no subtree is walked.

A prefix is named by 128 bits: the exclusive or of a hash of each turn with its depth. That is a running total, so even a conversation that holds most rows is dealt over many tasks
(operators/prefix.py). Groups by prefix are summed where their rows are before they are dealt.

Defined cases: rows without a conv_id are left out; a null role or text counts as empty; turns are ordered by (turn, role, text), null turns first; rows that repeat are turns of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.prefix import ranged, running

from .shared import cut, small_batches, table

#: A rebuilt conversation begins with at most HEADS - 1 turns of the conversation whose number is its own without its last digits.
HEADS, BASE = 6, 100
#: conv_ids that differ in so many last bits at most are joined into one piece of text before a node's pieces are digested in order.
PIECE = 12
NODE = ["depth", "k1", "k2"]


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, depth, x1, x2, tokens, total, _range), and the conversations themselves (conv_id, taken, total): how many turns
    come from elsewhere, and how many there are."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    content = [F.xxhash64(F.lit(seed), "role", "text").alias(f"c{seed}") for seed in (1, 2)]
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    rows = ranged(rows, ["conv_id"], order, ["conv_id", F.length("text").cast("long").alias("tokens"), *content], cut)
    rows = cut(running(rows, ["conv_id"], ["_row"], {"place": ("sum", F.lit(1))}).drop("_row"), "places")

    lengths = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % BASE
    known = lengths.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("own").alias("held"))
    h = head_length(F.col("conv_id"))
    convs = lengths.withColumn("base", base).join(known, "base", "left").withColumn("taken", F.least(h, F.coalesce("held", F.lit(0))))  # a base has BASE conversations, or twice that at 0
    convs = cut(convs.select("conv_id", "base", "taken", (F.col("taken") + F.greatest(F.col("own") - h, F.lit(0))).cast("long").alias("total")), "convs")

    columns = ["conv_id", "depth", "c1", "c2", "tokens", "total", "_range"]
    heads = rows.where((base == F.col("conv_id")) & (F.col("place") < HEADS)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "c1", "c2", "tokens")
    heads = convs.where("taken > 0").join(heads, "base").where("depth <= taken").withColumn("_range", F.lit(-1)).select(columns)
    own = rows.where(F.col("place") > h).join(convs.select("conv_id", "taken", "total"), "conv_id").withColumn("depth", F.col("place") - h + F.col("taken")).select(columns)
    turns = heads.unionByName(own).withColumn("depth", F.col("depth").cast("long"))
    named = [F.xxhash64(F.lit(seed), "depth", "c1", "c2").alias(f"x{seed}") for seed in (1, 2)]
    return cut(turns.select("conv_id", "depth", *named, "tokens", "total", "_range"), "turns"), convs.select("conv_id", "taken", "total")


def digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id): the digest of a node's conv_ids, ascending, with commas between. Ids are joined in pieces by many tasks; a digest can only be made in
    order, so one task then reads a node's pieces, sorted, and holds one of them at a time."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", PIECE).alias("at")).agg(piece.alias("ids"))  # 2 ** PIECE ids at most

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) if made else [[]] * 4
            made.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])

        for rows in batches:
            for *own, _, ids in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if own != node:
                    if state:
                        made.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if made:
                yield batch()
        if state:
            made.append((*node, state.hexdigest()))
            yield batch()

    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "at")
    return pieces.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    small_batches(conversations.sparkSession)
    turns, convs = rebuilt(conversations)
    paths = running(turns, ["conv_id"], ["depth"], {"k1": ("xor", F.col("x1")), "k2": ("xor", F.col("x2")), "through": ("sum", F.col("tokens"))})
    above = [F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2")]
    paths = paths.select("conv_id", *NODE, *above, (F.col("through") - F.col("tokens")).alias("before"), "through", "total")
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    roots = convs.select("conv_id", *zero(*NODE, "p1", "p2", "before", "through"), "total")
    paths = cut(paths.unionByName(roots), "paths")

    owners = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("before").alias("before"), F.max(F.col("depth") < F.col("total")).alias("inner"))
    owned = owners.select("conv_id", F.col("depth").alias("start"), "before", (~F.col("inner")).alias("leaf"))
    whole = paths.where("depth = total").select("conv_id", F.lit(None).cast("long").alias("start"), F.col("through").alias("before"), F.lit(False).alias("leaf"))
    #: From `start` on a conversation owns its path; `before` are its tokens up to there, all of them if it owns nothing.
    marks = cut(owned.unionByName(whole).groupBy("conv_id").agg(F.min("start").alias("start"), F.min("before").alias("unowned"), F.max("leaf").alias("leaf")), "marks")

    seen = paths.join(marks, "conv_id")
    child = (F.col("start") <= F.col("depth") + 1) & (F.col("depth") < F.col("total"))
    nodes = seen.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(child).alias("n_children"), F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("unowned") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    nodes = cut(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = digests(paths.where("depth = total").select(*NODE, "conv_id"))
    out = nodes.join(parents, ["depth", "p1", "p2"], "left").join(ends, NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH shifts AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)) AS crc),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a // 256, crc[xor(a % 256, b) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM placed), shifts),
turns AS (
  SELECT c.conv_id, p.place AS sequence, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL SELECT c.conv_id, 10 + p.place, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h),
deep AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sequence) AS depth, sha256(role || chr(31) || text) AS said FROM turns),
paths AS (
  SELECT conv_id, depth, length(text) AS tokens, string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM deep
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
long AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS total, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM paths),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(tokens) AS tokens, min(above) AS above, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
  FROM long GROUP BY depth, path),
children AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
subtrees AS (
  SELECT p.path, sum((n.n_convs - 1) * n.tokens) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes n JOIN long p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.above = n.path GROUP BY p.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN u.conv_id END AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (path) LEFT JOIN children c ON c.above = n.path LEFT JOIN nodes u ON u.path = n.above
"""
