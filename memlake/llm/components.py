"""Connected components of a graph in a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, remove

#: A node is a hub if it has more edges than the larger of HUB and one in HUBS of all: so there are 2 * HUBS hubs at most.
HUB, HUBS = 256, 1000


def _with_least(both: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """both (a, b) with least (a, m, n). The few hubs, which hold many rows each, are sent to every task; all other nodes are joined by a shuffle."""
    most = max(HUB, edges // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > most))  # 2 * HUBS rows at most
    rest = both.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= most), "a")
    return rest.unionByName(both.join(hubs, "a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of an edge (a, b) with the smallest node of its component.

    Alternating large-star and small-star until nothing changes: each round, every node links its larger neighbours to its smallest one, then its
    smaller ones. The edges never grow in number, and become stars around the smallest nodes after about log^2 rounds. The smallest neighbours are
    found by partial sums, whose exchange is made once and read again, and the edges of hubs stay where they are.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both, least, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.unionByName(least.where("a > m").select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "large-star")
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, lower, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = cut(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(edges)
        remove(large)
        edges = small
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
