"""Scores of memories as Column expressions: decay, tiers, admission, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import strip
from memlake.schema import DecayOptions, TierOptions

LN2 = 0.6931471805599453


def days_since(t: Column, now: Column) -> Column:
    return F.greatest((F.unix_seconds(now) - F.unix_seconds(t)) / F.lit(86400.0), F.lit(0.0))


def _by_tier(values: dict) -> Column:
    return F.when(F.col("tier") == "core", values["core"]).when(F.col("tier") == "working", values["working"]).otherwise(values["peripheral"])


def recency(now: Column, o: DecayOptions = DecayOptions()) -> Column:
    """Weibull decay; important memories live longer, tiers bend the curve."""
    days = days_since(F.coalesce("last_accessed_at", "created_at"), now)
    rate = F.lit(LN2) / (o.half_life_days * F.exp(o.importance_modulation * F.col("importance")))
    return F.exp(-rate * F.pow(days, _by_tier(o.beta)))


def average_gap() -> Column:
    """Days between two accesses on average: from creation to the last access, over one less than their number; 0 for up to one access."""
    n = F.col("access_count")
    span = days_since(F.col("created_at"), F.coalesce("last_accessed_at", "created_at"))
    return F.when(n > 1, span / (n - 1)).otherwise(0.0)


def frequency() -> Column:
    n = F.col("access_count")
    base = 1 - F.exp(-n / F.lit(5.0))
    return F.when(n > 1, base * (0.5 + 0.5 * F.exp(-average_gap() / 30))).otherwise(base)


def composite(now: Column, o: DecayOptions = DecayOptions()) -> Column:
    raw = o.recency_weight * recency(now, o) + o.frequency_weight * frequency() + o.intrinsic_weight * F.col("importance") * F.col("confidence")
    return F.greatest(raw, _by_tier(o.floor))


def next_tier(score: Column, now: Column, o: TierOptions = TierOptions()) -> Column:
    n, old = F.col("access_count"), days_since(F.col("created_at"), now) > o.demote_age_days
    weak = (score < o.demote_composite) & (n < o.working_access)
    working = (
        F.when((n >= o.core_access) & (score >= o.core_composite) & (F.col("importance") >= o.core_importance), "core")
        .when((score < o.demote_composite) | (old & (n < o.working_access)), "peripheral")
        .otherwise("working")
    )
    return (
        F.when(F.col("tier") == "peripheral", F.when((n >= o.working_access) & (score >= o.working_composite), "working").otherwise("peripheral"))
        .when(F.col("tier") == "working", working)
        .otherwise(F.when(weak, "working").otherwise("core"))
    )


def length_factor(content: Column, reference: int = 500) -> Column:
    n = F.octet_length(content)
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(1.0), 1 + F.log2(n / F.lit(float(reference)))))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


#: How much a category is worth keeping.
TYPE_PRIOR = {"profile": 0.95, "preferences": 0.90, "entities": 0.75, "events": 0.45, "cases": 0.80, "patterns": 0.85}


def type_prior(category: Column) -> Column:
    out = F.when(category == "profile", TYPE_PRIOR["profile"])
    for name, value in TYPE_PRIOR.items():
        out = out.when(category == name, value)
    return out.otherwise(TYPE_PRIOR["events"])


def utility(text: Column) -> Column:
    t = strip(text)
    n = F.octet_length(t)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    name = F.exists(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike(r"^\p{Lu}"))
    long = F.greatest(F.lit(0.7), F.when(t.rlike("[0-9]"), 0.85).otherwise(0.0), F.when(name, 0.8).otherwise(0.0), F.when(n > 60, 0.75).otherwise(0.0))
    return F.when(n <= 5, 0.2).when(n <= 20, 0.3).otherwise(long)


#: Fixed values: (reject under, admit from) of each preset.
PRESETS = {"balanced": (0.45, 0.60), "conservative": (0.52, 0.68), "high_recall": (0.34, 0.52)}


def decision(score: Column, similarity: Column, preset: str = "balanced") -> Column:
    reject, admit = PRESETS[preset]
    return F.when(score < reject, "reject").when((score >= admit) & (similarity < 0.55), "add").otherwise("update_or_merge")
