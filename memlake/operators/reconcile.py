"""Reconciliation: decisions about facts applied to memories as one set-based change, and edges between near memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import knn

#: Categories of which an older statement is kept beside the newer.
VERSIONED = ("preferences", "entities")
ACTIONS = ("create", "merge", "skip", "supersede", "support", "contextualize", "contradict")


def resolve(decisions: DataFrame, facts: DataFrame, memories: DataFrame) -> DataFrame:
    """decisions (decision_id, action, fact_id, match_id, merged_content; seq and context_label if there are any) with their fact and target, and the action that applies.

    Unknown actions, and actions on a target that isn't there, create; so do merges and supersessions of pinned memories.
    A fact of preferences or entities that contradicts supersedes; an unknown category counts as profile."""
    target = memories.select(F.col("id").alias("match_id"), F.col("memory_type").alias("t_type"))
    source = F.col("source_text") if "source_text" in facts.columns else F.lit(None).cast("string")
    more = [c for c in ("l1_overview", "l2_content", "tags") if c in facts.columns]
    d = decisions.join(facts.select("fact_id", "l0", F.col("category").alias("f_category"), source.alias("f_source"), *more), "fact_id").join(target, "match_id", "left")
    a = F.lower("action")
    known = F.when(a.isin(*ACTIONS), a).otherwise("create")
    lost = F.col("t_type").isNull() & ~known.isin("create", "skip")
    versioned = text.category_or(F.col("f_category"), "profile").isin(*VERSIONED)
    turned = F.when((known == "contradict") & versioned, "supersede").otherwise(known)
    return d.withColumn("applied", F.when(lost, "create").when(turned.isin("merge", "supersede") & (F.col("t_type") == "pinned"), "create").otherwise(turned))


def by_ordinal(decisions: DataFrame, facts: DataFrame, existing: DataFrame) -> DataFrame:
    """decisions that name their fact and match by place (fact_index, match_index) with fact_id and match_id. facts (fact_id, ordinal) are those asked about, existing
    (id, ordinal) the candidates shown. A fact_index that isn't there, or a match_index that isn't there where one is needed, ends the job."""
    d = decisions.join(facts.select(F.col("ordinal").alias("fact_index"), "fact_id"), "fact_index", "left")
    d = d.join(existing.select(F.col("ordinal").alias("match_index"), F.col("id").alias("match_id")), "match_index", "left")
    needed = F.lower("action").isin("merge", "supersede", "support", "contextualize", "contradict")
    fail = lambda what, c: F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))))
    d = d.withColumn("fact_id", F.when(F.col("fact_id").isNull(), fail("fact_index", "fact_index").cast(d.schema["fact_id"].dataType)).otherwise(F.col("fact_id")))
    return d.withColumn("match_id", F.when(needed & F.col("match_id").isNull(), fail("match_index", "match_index").cast("string")).otherwise(F.col("match_id")))


def self_dedup(facts: DataFrame, by: str = "request", threshold: float = 0.85, order: str = "fact_id") -> DataFrame:
    """facts (by, fact_id, l0, and the column `order`) of a request without those that nearly repeat an earlier one of it: the stand-in for asking a model which to keep. The first of a
    request always stays. Requests hold 50 facts at most (seams.sentence_facts), so a request's facts meet each other."""
    own = F.struct(F.col(order).alias("_at"), text.trimmed_word_set(F.col("l0")).alias("_words"), F.struct(*facts.columns).alias("_row"))
    all_of = facts.where(F.col(by).isNotNull() & F.col("fact_id").isNotNull()).groupBy(by).agg(F.collect_list(own).alias("all"))
    size = lambda x, o: F.least(F.size(x), F.size(o)) >= (threshold - 1e-9) * F.greatest(F.size(x), F.size(o))  # noqa: E731 - what sets of these sizes can share at most
    near = lambda x: F.exists("all", lambda o: (o["_at"] < x["_at"]) & size(x["_words"], o["_words"]) & (text.jaccard(x["_words"], o["_words"], 0.0) > threshold))
    return all_of.select(F.explode(F.filter("all", lambda x: ~near(x))["_row"]).alias("_row")).select("_row.*")


def _optional(rows: DataFrame, name: str, kind: str, otherwise=None) -> Column:
    """A column of rows, or a value where they have none of that name."""
    return F.col(name) if name in rows.columns else F.lit(otherwise).cast(kind)


def _no_relations() -> Column:
    return F.array().cast("array<struct<relation_type:string,target_id:string,context_label:string>>")


def _relation(kind: Column, target: Column, label: Column) -> Column:
    return F.struct(kind.alias("relation_type"), target.cast("string").alias("target_id"), label.cast("string").alias("context_label"))


def inserts(resolved: DataFrame, like: DataFrame, now: Column, tenant: str = "", embed=None) -> DataFrame:
    """New memories with the columns of `like`. The content is the fact's source text, or the fact where there is none; what a fact doesn't say has the value of a new memory. Columns that
    a memory doesn't know are null. One that is changed right after it was made, to point at its target, has version 2."""
    linked = F.col("applied").isin("contextualize", "contradict")
    kind = F.when(F.col("applied") == "contextualize", "contextualizes").otherwise("contradicts")
    label = F.when(F.col("applied") == "contextualize", _optional(resolved, "context_label", "string"))
    content = F.coalesce("f_source", "l0")
    values = {
        "id": F.concat(F.lit("n"), "decision_id"), "content": content, "l0_abstract": F.col("l0"), "l1_overview": F.coalesce(_optional(resolved, "l1_overview", "string"), F.lit("")),
        "l2_content": F.coalesce(_optional(resolved, "l2_content", "string"), F.lit("")), "category": text.category_or(F.col("f_category"), "profile"), "memory_type": F.lit("insight"), "state": F.lit("active"),
        "tier": F.lit("peripheral"), "importance": F.lit(0.5), "confidence": F.lit(0.5), "access_count": F.lit(0), "tags": F.coalesce(_optional(resolved, "tags", "array<string>"), F.array().cast("array<string>")),
        "scope": F.lit("global"), "tenant_id": F.lit(tenant), "relations": F.when(linked, F.array(_relation(kind, F.col("match_id"), label))).otherwise(_no_relations()), "created_at": now, "updated_at": now,
        "space_id": F.lit(""), "visibility": F.lit("global"), "owner_agent_id": F.lit(""), "version": F.when(linked, 2).otherwise(1),
    }
    if embed:
        values["vector"] = embed(content)
    rows = resolved.where(F.col("applied").isin("create", "supersede", "contextualize", "contradict"))
    return rows.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields))


def apply(memories: DataFrame, resolved: DataFrame, now: Column, embed=None, tenant: str = "") -> DataFrame:
    """The next snapshot of memories, with all their columns. Changes to one memory are gathered first, so each memory joins at most one row: of several merges and supersessions the last one
    counts (by the column `seq` of the decisions, or else their id), supports add up, relations come in order. A merge without content takes the fact's. With `embed`, a column
    function, a vector is made again for what was merged and made for what is new; all else keeps its own. A decision whose memory is there already makes none again."""
    order = F.col("seq") if "seq" in resolved.columns else F.col("decision_id")
    applied = F.col("applied")
    link = F.when(applied == "support", _relation(F.lit("supports"), F.col("match_id"), _optional(resolved, "context_label", "string")))
    link = link.when(applied == "contradict", _relation(F.lit("contradicts"), F.concat(F.lit("n"), "decision_id"), F.lit(None)))
    changes = resolved.where(applied.isin("merge", "supersede", "support", "contradict")).groupBy(F.col("match_id").alias("id")).agg(
        F.max(F.when(applied == "merge", F.struct(order.alias("at"), F.coalesce("merged_content", "l0").alias("content")))).alias("_merged"),
        F.max(F.when(applied == "supersede", F.struct(order.alias("at"), F.concat(F.lit("n"), "decision_id").alias("by")))).alias("_over"),
        F.count_if(applied == "support").alias("_supports"), F.count(F.lit(1)).alias("_n"),
        F.transform(F.array_sort(F.collect_list(F.when(link.isNotNull(), F.struct(order.alias("at"), F.col("decision_id").alias("id"), link.alias("link"))))), lambda x: x["link"]).alias("_links"),
    )
    merged, over, n = F.col("_merged.content"), F.col("_over"), F.coalesce("_n", F.lit(0))
    values = {
        "content": F.coalesce(merged, "content"), "version": F.coalesce("version", F.lit(0)) + n, "relations": F.when(F.size("_links") > 0, F.concat(F.coalesce("relations", _no_relations()), "_links")).otherwise(F.col("relations")),
        "confidence": F.round(F.least(F.col("confidence") + 0.1 * F.coalesce("_supports", F.lit(0)), F.greatest(F.lit(1.0), F.col("confidence"))), 6), "superseded_by": F.coalesce("_over.by", "superseded_by"),
    }
    if "l0_abstract" in memories.columns:
        values["l0_abstract"] = F.coalesce(merged, "l0_abstract")
    if "invalidated_at" in memories.columns:
        values["invalidated_at"] = F.when(over.isNotNull(), now).otherwise(F.col("invalidated_at"))
    if "updated_at" in memories.columns:
        values["updated_at"] = F.when(n > 0, now).otherwise(F.col("updated_at"))
    if embed and "vector" in memories.columns:
        values["vector"] = F.when(merged.isNotNull(), embed(merged)).otherwise(F.col("vector"))
    joined = memories.join(changes, "id", "left")
    old = joined.select(*(values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in memories.schema.fields))
    new = inserts(resolved, memories, now, tenant, embed).join(memories.select("id"), "id", "left_anti")
    return old.unionByName(new)


def near_edges(memories: DataFrame, threshold: float, k: int = 5, block: int = knn.BLOCK) -> DataFrame:
    """Directed `supports` edges from each memory to its k nearest, at or above the threshold, unless there is an edge already."""
    rows = memories.where("state <> 'deleted' and vector is not null").select("id", "vector", "relations")
    best = knn.pivot_topk(rows, k, threshold, block=block)
    held = rows.select(F.col("id").alias("source_id"), F.explode("relations").alias("r")).select("source_id", F.col("r.target_id").alias("target_id"))
    return best.join(held, ["source_id", "target_id"], "left_anti").select("source_id", "target_id", "score", text.similarity_label(F.col("score")).alias("label"))
