"""Statistics over memories, tags, spaces, agents, relations and sharing events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARES = ("share", "batch_share", "reshare")
DIMENSIONS = ("memory_type", "category", "tier", "state", "space_id", "visibility", "owner_agent_id")


def by_dimension(memories: DataFrame) -> DataFrame:
    """(dimension, value, n): all counts in one pass, by exploding a row's seven values; partial sums keep the shuffle small."""
    space = F.when(F.coalesce("space_id", F.lit("")) == "", "default").otherwise(F.col("space_id"))
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), (space if d == "space_id" else F.col(d)).alias("value")) for d in DIMENSIONS))
    return memories.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def averages(memories: DataFrame) -> DataFrame:
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return memories.agg(F.count(F.lit(1)).alias("total"), zero(F.avg("importance")).alias("avg_importance"), zero(F.avg("confidence")).alias("avg_confidence"), F.coalesce(F.sum("access_count"), F.lit(0)).cast("long").alias("total_access"))


def timeline(memories: DataFrame, as_of, days: int) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd")
    rows = memories.where(day >= F.date_format(as_of - F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd"))
    return rows.groupBy(day.alias("day"), "memory_type").agg(F.count(F.lit(1)).alias("n")).withColumn("day_total", F.sum("n").over(Window.partitionBy("day")))


def tag_counts(memories: DataFrame, min_count: int = 1, limit: int = 50) -> DataFrame:
    """The most used tags. total_usages is taken before min_count and the limit, total_unique between the two."""
    counts = memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").cast("long").alias("total_usages"), F.count_if(F.col("n") >= min_count).alias("total_unique"))  # one row
    return counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), "tag").limit(limit).join(F.broadcast(totals))


def cross_space_tags(memories: DataFrame) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag"), "space_id").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n_spaces")).where("n_spaces >= 2")


def top_categories(memories: DataFrame, by: str, n: int = 3) -> DataFrame:
    counts = memories.groupBy(by, "category").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), "category")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def space_overview(memories: DataFrame, spaces: DataFrame) -> DataFrame:
    """One row for each space, also for those without memories."""
    sums = memories.groupBy("space_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("owner_agent_id").alias("n_agents"), *(F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("core", "working", "peripheral")),
        F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_created"), F.count("provenance_source_id").alias("n_shared"),
    )
    top = top_categories(memories, "space_id").groupBy("space_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]), ",").alias("top"))
    rows = spaces.select(F.col("id").alias("space_id"), "space_type", "owner_id", F.size("members").cast("long").alias("n_members"))
    rows = rows.join(sums, "space_id", "left").join(top, "space_id", "left")
    return rows.fillna(0, [c for c in sums.columns if c.startswith("n")])


def sharing_summary(events: DataFrame) -> DataFrame:
    shared = F.col("action").isin(*SHARES)
    return events.agg(F.count_if(shared).alias("shares"), F.count_if(F.col("action") == "pull").alias("pulls"), F.count_if(F.col("action") == "unshare").alias("unshares"), F.count_distinct(F.when(shared, F.col("user_id"))).alias("sharers"))


def sharing_flow(events: DataFrame) -> DataFrame:
    return events.where(F.col("action").isin(*SHARES)).groupBy("from_space", "to_space").agg(F.count(F.lit(1)).alias("n"))


def sharing_nodes(events: DataFrame) -> DataFrame:
    flow = sharing_flow(events)
    return flow.select(F.col("from_space").alias("space")).union(flow.select("to_space")).distinct()


def sharing_timeline(events: DataFrame) -> DataFrame:
    """Reshares don't count as shares here; a day of any event has a row."""
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    return events.groupBy(day).agg(F.count_if(F.col("action").isin("share", "batch_share")).alias("shares"), F.count_if(F.col("action") == "pull").alias("pulls"))


def recent_activity(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), F.desc("id")).limit(n).select("id", "action", "from_space", "to_space")


def agent_activity(memories: DataFrame, events: DataFrame) -> DataFrame:
    """For each owner agent: memories, their number by space, top categories, last day, shares."""
    space = F.when(F.coalesce("space_id", F.lit("")) == "", "default").otherwise(F.col("space_id"))
    in_space = memories.groupBy("owner_agent_id", space.alias("space")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
    sums = in_space.groupBy("owner_agent_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("space", "n")))).alias("by_space"), F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_active"))
    top = top_categories(memories, "owner_agent_id").groupBy("owner_agent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]), ",").alias("top"))
    shares = events.where(F.col("action").isin("share", "batch_share")).groupBy(F.col("agent_id").alias("owner_agent_id")).agg(F.count(F.lit(1)).alias("n_shares"))
    return sums.join(top, "owner_agent_id").join(shares, "owner_agent_id", "left").withColumn("n_shares", F.coalesce("n_shares", F.lit(0)))


def edges(memories: DataFrame, min_importance: float = 0.0) -> DataFrame:
    """(source, target, kind, context_label, cross_space): relations, supersessions (new to old) and copies (source to copy) of memories important enough.

    A relation crosses spaces if both of its ends are such memories in two named spaces; a supersession never does."""
    rows = memories.where(F.col("importance") >= min_importance).withColumn("space", F.coalesce("space_id", F.lit("")))
    none = F.lit(None).cast("string").alias("context_label")
    said = rows.select(F.col("id").alias("source"), "space", F.explode("relations").alias("r")).select("source", F.col("r.target_id").alias("target"), F.col("r.relation_type").alias("kind"), F.col("r.context_label").alias("context_label"), "space")
    ends = rows.select(F.col("id").alias("target"), F.col("space").alias("to"))
    crosses = (F.col("space") != "") & (F.col("to") != "") & (F.col("space") != F.col("to"))
    said = said.join(ends, "target", "left").select("source", "target", "kind", "context_label", F.coalesce(crosses, F.lit(False)).alias("cross_space"))
    over = rows.where("superseded_by is not null").select(F.col("superseded_by").alias("source"), F.col("id").alias("target"), F.lit("supersedes").alias("kind"), none, F.lit(False).alias("cross_space"))
    label = F.concat("shared_from_space", F.lit(" → "), "space").alias("context_label")
    copied = rows.where("provenance_source_id is not null").select(F.col("provenance_source_id").alias("source"), F.col("id").alias("target"), F.lit("shared_from").alias("kind"), label, (F.col("shared_from_space") != F.col("space")).alias("cross_space"))
    return said.unionByName(over).unionByName(copied)


def nodes(memories: DataFrame, min_importance: float, limit: int) -> DataFrame:
    """The most important memories that an edge touches; edges are not limited."""
    found = edges(memories, min_importance)
    touched = found.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    label = F.when(F.coalesce("l0_abstract", F.lit("")) != "", F.col("l0_abstract")).otherwise(F.col("content"))
    rows = memories.where(F.col("importance") >= min_importance).join(touched, "id", "left_semi").orderBy(F.desc("importance"), "id").limit(limit)
    return rows.select("id", label.alias("label"), "category", F.round("importance", 6).alias("importance"))
