"""Decay, staleness, tiers, expiry and archival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import scoring
from memlake.operators import scan
from memlake.schema import DecayOptions, TierOptions

#: Markers that end a memory's life, and after how many days.
TTL_MARKERS = ((("today", "今天", "tomorrow", "明天"), 2), (("next week", "下周"), 10), (("this month", "这个月"), 35))


def with_composite(memories: DataFrame, now: Column, options: DecayOptions = DecayOptions()) -> DataFrame:
    return memories.withColumn("composite", scoring.composite(now, options))


def stale(memories: DataFrame, now: Column, options: DecayOptions = DecayOptions()) -> DataFrame:
    return with_composite(memories, now, options).where(F.col("composite") < options.stale_threshold)


def transitions(memories: DataFrame, now: Column, decay: DecayOptions = DecayOptions(), tiers: TierOptions = TierOptions()) -> DataFrame:
    moved = with_composite(memories, now, decay).withColumn("new_tier", scoring.next_tier(F.col("composite"), now, tiers))
    return moved.where("new_tier <> tier")


def ttl_days(content: Column) -> Column:
    low, out = F.lower(content), None
    for words, days in TTL_MARKERS:
        hit = F.greatest(*(F.contains(low, F.lit(w)) for w in words))
        out = F.when(hit, days) if out is None else out.when(hit, days)
    return out


def _past(now: Column) -> Column:
    return F.coalesce(F.timestamp_add("DAY", ttl_days(F.col("content")), F.col("created_at")) < now, F.lit(False))


def expired(memories: DataFrame, now: Column) -> DataFrame:
    """Memories past the days that their text gives them; archived ones too."""
    return memories.where("state <> 'deleted'").where(_past(now)).withColumn("ttl", ttl_days(F.col("content")))


def cleanup_expired(memories: DataFrame, now: Column) -> DataFrame:
    """The next snapshot: expired memories are deleted softly."""
    return scan.soft_delete(memories, _past(now))


def archive_superseded(memories: DataFrame, now: Column, days: int) -> DataFrame:
    """The next snapshot: superseded memories older than `days` are archived."""
    hit = (F.col("state") != "deleted") & F.col("superseded_by").isNotNull() & (F.timestamp_add("DAY", F.lit(days), F.col("created_at")) < now)
    return memories.withColumn("state", F.when(hit, "archived").otherwise(F.col("state")))


def decay_curve(spark: SparkSession, importance: float, days: int, points: int, options: DecayOptions = DecayOptions()) -> DataFrame:
    base = spark.range(points).select((F.col("id") * F.lit(float(days)) / max(points - 1, 1)).alias("day"))
    rate = F.lit(scoring.LN2) / (options.half_life_days * F.exp(F.lit(options.importance_modulation * importance)))
    at = lambda tier: F.round(F.greatest(F.exp(-rate * F.pow("day", F.lit(options.beta[tier]))), F.lit(options.floor[tier])), 6).alias(tier)
    return base.select(F.round("day", 6).alias("day"), *(at(t) for t in ("core", "working", "peripheral")))
