"""Declared schemas, enumerations and constants of the memory store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CATEGORIES = ("profile", "preferences", "entities", "events", "cases", "patterns")
MEMORY_TYPES = ("pinned", "insight", "session")
STATES = ("active", "archived", "deleted")
TIERS = ("core", "working", "peripheral")
ROLES = ("admin", "member", "reader")
SHARE_ACTIONS = ("share", "pull", "unshare", "batch_share", "reshare")

_S, _N = T.StringType(), True
RELATION = T.StructType([T.StructField("relation_type", _S), T.StructField("target_id", _S), T.StructField("context_label", _S)])
PROVENANCE = T.StructType([T.StructField(n, _S) for n in ("shared_from_space", "shared_from_memory", "shared_by_user", "shared_by_agent", "original_created_at")] + [T.StructField("shared_at", T.TimestampType()), T.StructField("source_version", T.LongType())])
MEMORY = T.StructType(
    [T.StructField(n, _S, False) for n in ("id", "content", "l0_abstract", "l1_overview", "l2_content")]
    + [T.StructField("vector", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, _S, False) for n in ("category", "memory_type", "state", "tier")]
    + [T.StructField("importance", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("access_count", T.IntegerType()), T.StructField("tags", T.ArrayType(_S))]
    + [T.StructField(n, _S) for n in ("scope", "agent_id", "session_id", "source", "tenant_id")]
    + [T.StructField("relations", T.ArrayType(RELATION)), T.StructField("superseded_by", _S)]
    + [T.StructField(n, T.TimestampType()) for n in ("invalidated_at", "created_at", "updated_at", "last_accessed_at")]
    + [T.StructField(n, _S) for n in ("space_id", "visibility", "owner_agent_id")]
    + [T.StructField("provenance", PROVENANCE), T.StructField("version", T.LongType()), T.StructField("provenance_source_id", _S)]
)
SESSION = T.StructType([T.StructField(n, _S) for n in ("id", "session_id", "agent_id", "role", "content", "content_hash")] + [T.StructField("tags", T.ArrayType(_S)), T.StructField("created_at", T.TimestampType())])
MEMBER = T.StructType([T.StructField("user_id", _S), T.StructField("role", _S), T.StructField("joined_at", T.TimestampType())])
RULE = T.StructType([T.StructField("id", _S), T.StructField("source_space", _S), T.StructField("categories", T.ArrayType(_S)), T.StructField("tags", T.ArrayType(_S)), T.StructField("min_importance", T.DoubleType()), T.StructField("require_approval", T.BooleanType())])
SPACE = T.StructType([T.StructField(n, _S) for n in ("id", "space_type", "name", "owner_id")] + [T.StructField("members", T.ArrayType(MEMBER)), T.StructField("auto_share_rules", T.ArrayType(RULE)), T.StructField("created_at", T.TimestampType())])


@dataclass(frozen=True)
class DecayOptions:
    half_life_days: float = 30.0
    importance_modulation: float = 1.5
    beta: dict = field(default_factory=lambda: {"core": 0.8, "working": 1.0, "peripheral": 1.3})
    floor: dict = field(default_factory=lambda: {"core": 0.9, "working": 0.7, "peripheral": 0.5})
    recency_weight: float = 0.4
    frequency_weight: float = 0.3
    intrinsic_weight: float = 0.3
    stale_threshold: float = 0.3
    boost_floor: float = 0.3


@dataclass(frozen=True)
class TierOptions:
    working_access: int = 3
    working_composite: float = 0.4
    core_access: int = 10
    core_composite: float = 0.7
    core_importance: float = 0.8
    demote_composite: float = 0.15
    demote_age_days: int = 60


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    min_score: float = 0.3
    vector_weight: float = 0.7
    text_weight: float = 0.3
    rrf_k: int = 60
    pinned_boost: float = 1.5
    floor_bm25: float = 0.75
    floor_factor: float = 0.95
    hard_cutoff: float = 0.005
    length_reference: int = 500
    diversity_similarity: float = 0.85
    diversity_penalty: float = 0.5
    vector_min_score: float = 0.3
