"""Queries by name over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import scoring, seams, table_functions, text
from memlake.operators import chunk, ingest, lifecycle, profile, reconcile, retrieve, scan, sharing, stats, text_index, vector_index
from memlake.plans import sql
from memlake.schema import SearchOptions
from memlake.sources import files, scratch, tables, views, webhook
from memlake.streaming import flows, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _m(spark, d, vector=False):
    return views.memories(spark, d, vector)


def _probe(spark, d):
    """The first benchmark item's first five words (bounded: one row), and vector 0 as a one-row frame."""
    words = views.read(spark, d, "benchmark").where("item_id = 0").select(F.slice(text.words(F.col("text")), 1, 5).alias("w")).first()["w"]
    vector = views.read(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("qv"))
    return [t for w in words for t in re.findall(r"[^\W_]+", w.lower())], vector


# --- scans and filters


@query(sql.LIST_FILTERED)
def list_filtered(spark, d):
    return scan.page(scan.list_filter(_m(spark, d), category="events", tags=["en"]), 40, 0, "importance").select("id", "category", F.round("importance", 6).alias("importance"))


@query(sql.LIST_PAGED)
def list_paged(spark, d):
    return scan.page(scan.live(_m(spark, d)), 25, 50).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(sql.COUNT_FILTERED)
def count_filtered(spark, d):
    return scan.list_filter(_m(spark, d), tier="core", memory_type="session").agg(F.count(F.lit(1)).alias("n"))


@query(sql.POINT_LOOKUP)
def point_lookup(spark, d):
    return scan.by_id(_m(spark, d), "m5").select("id", "state", "content")


@query(sql.VECTOR_LOOKUP)
def vector_lookup(spark, d):
    return scan.vector_by_id(_m(spark, d, True), "m7").select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("v0"), F.size("vector").cast("long").alias("dims"))


@query(sql.PROVENANCE_LOOKUP)
def provenance_lookup(spark, d):
    return scan.by_provenance(_m(spark, d), "m17").select("id", "provenance_source_id")


@query(sql.VISIBILITY)
def visibility_filter(spark, d):
    return scan.live(_m(spark, d)).where(scan.visible_to("agent-1", ["team/a"])).select("id", "visibility", "owner_agent_id")


@query(sql.BATCH_DELETE)
def batch_delete_preview(spark, d):
    return scan.live(_m(spark, d)).where(scan.batch_delete_filter("src1", ["en"], before="2024-02-15")).agg(F.count(F.lit(1)).alias("would_delete"))


@query(sql.SOFT_DELETE)
def soft_delete(spark, d):
    return scan.soft_delete(_m(spark, d), F.col("category") == "cases").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


@query(sql.UPSERT)
def upsert(spark, d):
    m = _m(spark, d).select("id", "content", "version", "state")
    changed = m.where("version = 2").select("id", F.concat(F.lit("new "), "content").alias("content"), (F.col("version") + 1).alias("version"), "state")
    return scan.upsert(m, changed).select("id", F.length("content").cast("long").alias("n"), "version", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))


@query(sql.SPACE_UNION)
def space_union(spark, d):
    m = _m(spark, d).select("id", "space_id", "state")
    copy = m.where("space_id = 'team/a'").withColumn("space_id", F.lit("org/x"))
    return scan.space_rows(m.unionByName(copy), ["personal/u0", "team/a", "org/x"]).select("id", "space_id")


@query(sql.UPDATED)
def update_rows(spark, d):
    m = _m(spark, d)
    return scan.update(m, m.where("i % 3 = 1").select("id", F.lit("cases").alias("category")), views.as_of()).select("id", "category", "version")


@query(sql.CODEC)
def row_codec(spark, d):
    m = _m(spark, d).withColumn("memory_type", F.when(F.col("i") % 10 == 9, "odd").otherwise(F.col("memory_type"))).drop("created_at", "last_accessed_at")
    good, bad = scan.decode(scan.encode(m))
    return good.select("id", "category", F.lit(None).cast("string").alias("bad"), F.size("tags").cast("long").alias("n_tags")).unionByName(bad.select("id", "category", "bad", F.lit(None).cast("long").alias("n_tags")))


# --- statistics


@query(sql.BY_DIMENSION)
def stats_by_dimension(spark, d):
    return stats.by_dimension(scan.live(_m(spark, d)))


@query(sql.AVERAGES)
def stats_averages(spark, d):
    return stats.averages(scan.live(_m(spark, d)))


@query(sql.TIMELINE)
def stats_timeline(spark, d):
    return stats.timeline(scan.live(_m(spark, d)), views.as_of(), 30)


@query(sql.TAGS)
def stats_tags(spark, d):
    return stats.tag_counts(scan.live(_m(spark, d)), 20, 15)


@query(sql.CROSS_TAGS)
def stats_cross_space_tags(spark, d):
    return stats.cross_space_tags(scan.live(_m(spark, d)))


@query(sql.TOP_CATEGORIES)
def top_categories(spark, d):
    return stats.top_categories(scan.live(_m(spark, d)), "space_id").select("space_id", "category", "n", F.col("rank").cast("long").alias("rank"))


@query(sql.SPACES)
def stats_spaces(spark, d):
    return stats.space_overview(scan.live(_m(spark, d)), views.spaces(spark))


@query(sql.SHARING_SUMMARY)
def stats_sharing_summary(spark, d):
    return stats.sharing_summary(views.sharing_events(spark, d))


@query(sql.SHARING_FLOW)
def stats_sharing_flow(spark, d):
    return stats.sharing_flow(views.sharing_events(spark, d))


@query(sql.SHARING_NODES)
def stats_sharing_nodes(spark, d):
    return stats.sharing_nodes(views.sharing_events(spark, d))


@query(sql.SHARING_TIMELINE)
def stats_sharing_timeline(spark, d):
    return stats.sharing_timeline(views.sharing_events(spark, d))


@query(sql.RECENT)
def stats_recent_activity(spark, d):
    return stats.recent_activity(views.sharing_events(spark, d))


@query(sql.EVENT_LIST)
def sharing_event_list(spark, d):
    e = views.sharing_events(spark, d)
    return e.where((F.col("from_space") == "personal/u2") | (F.col("to_space") == "personal/u2")).orderBy(F.desc("timestamp"), F.desc("id")).limit(100).select("id", "action", "to_space")


@query(sql.AGENTS)
def stats_agents(spark, d):
    rows = stats.agent_activity(scan.live(_m(spark, d)), views.sharing_events(spark, d))
    return rows.withColumn("by_space", F.array_join(F.transform(F.map_entries("by_space"), lambda x: F.concat_ws(":", x["key"], x["value"])), ","))


@query(sql.EDGES)
def relation_edges(spark, d):
    return stats.edges(scan.live(_m(spark, d)), 0.2)


@query(sql.NODES)
def relation_nodes(spark, d):
    return stats.nodes(scan.live(_m(spark, d)), 0.5, 60)


# --- lifecycle


@query(sql.COMPOSITE)
def decay_composite(spark, d):
    return lifecycle.with_composite(scan.live(_m(spark, d)), views.as_of()).select("id", F.round(scoring.recency(views.as_of()), 6).alias("recency"), F.round(scoring.frequency(), 6).alias("frequency"), F.round("composite", 6).alias("composite"))


@query(sql.CURVE)
def decay_curve(spark, d):
    return lifecycle.decay_curve(spark, 0.5, 90, 31)


@query(sql.STALE)
def stale_memories(spark, d):
    from memlake.schema import DecayOptions

    floorless = DecayOptions(floor={"core": 0.0, "working": 0.0, "peripheral": 0.0})
    return lifecycle.stale(scan.live(_m(spark, d)), views.as_of(), floorless).select("id", F.round("composite", 6).alias("composite"))


@query(sql.TIERS)
def tier_transitions(spark, d):
    return lifecycle.transitions(scan.live(_m(spark, d)), views.as_of()).select("id", "tier", "new_tier")


@query(sql.TTL)
def ttl_expired(spark, d):
    return lifecycle.expired(_m(spark, d), views.as_of()).select("id", F.col("ttl").cast("long").alias("ttl"))


@query(sql.EXPIRED)
def cleanup_expired(spark, d):
    return lifecycle.cleanup_expired(_m(spark, d), views.as_of()).select("id", "state", "version")


@query(sql.ARCHIVE)
def archive_superseded(spark, d):
    return lifecycle.archive_superseded(_m(spark, d), views.as_of(), 30).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# --- retrieval


@query(sql.VECTOR_TOPK)
def vector_topk(spark, d):
    return retrieve.vector_topk(_m(spark, d, True), _probe(spark, d)[1], 20)


@query(sql.VECTOR_TOPK_FILTERED)
def vector_topk_filtered(spark, d):
    return retrieve.vector_topk(_m(spark, d, True), _probe(spark, d)[1], 20, 0.1, F.col("space_id") == "team/a")


@query(sql.BM25)
def bm25_topk(spark, d):
    return retrieve.bm25_topk(scan.live(_m(spark, d)), _probe(spark, d)[0], 20)


@query(sql.BM25_POST)
def bm25_postfilter(spark, d):
    return retrieve.bm25_topk(scan.live(_m(spark, d)), _probe(spark, d)[0], 20, F.col("category") == "profile")


@query(sql.BM25)
def text_index_topk(spark, d):
    """The same rows from a stored index: two thirds of the memories are indexed, the rest are added as a second segment."""
    live = scan.live(_m(spark, d))
    index = text_index.TextIndex(spark, scratch.place(spark, "text-index"))
    index.add(live.where("i % 3 <> 1"))
    index.add(live.where("i % 3 = 1"))
    return index.search(_probe(spark, d)[0], 20)


@query(sql.BM25)
def text_index_merged(spark, d):
    """All memories are indexed, deleted ones are removed again, and segments merged."""
    m = _m(spark, d)
    index = text_index.TextIndex(spark, scratch.place(spark, "text-index"))
    index.add(m)
    index.remove(m.where("state = 'deleted'").select("id"))
    index.merge()
    return index.search(_probe(spark, d)[0], 20)


@query()
def vector_index_topk(spark, d):
    """The ten memories nearest to each benchmark item's vector, by an approximate index over all memories' vectors. Vectors of these tables have no structure, so half the cells are read."""
    index = vector_index.VectorIndex(spark, scratch.place(spark, "vector-index"))
    rows = views.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index.build(rows.select(F.concat(F.lit("m"), "vec_id").alias("id"), "vector"))
    asked = views.read(spark, d, "benchmark").join(rows, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("key"), "vector")
    probes = max(1, index.lists.part("centres").count() // 2)
    return index.search(asked, 10, probes).select(F.col("key").alias("fact_id"), "id", "score", F.col("rank").cast("long").alias("rank"))


def _legs(spark, d, limit=10):
    words, vector = _probe(spark, d)
    m = _m(spark, d, True)
    return m, retrieve.vector_topk(m, vector, 3 * limit), retrieve.bm25_topk(scan.live(m), words, 3 * limit)


@query(sql.FUSION)
def rrf_fusion(spark, d):
    _, v, t = _legs(spark, d)
    return retrieve.fuse(v, t).select("id", F.round("score", 9).alias("score"))


@query(sql.NORMALISED)
def rrf_normalize(spark, d):
    _, v, t = _legs(spark, d)
    return retrieve.normalise(retrieve.fuse(v, t)).select("id", F.round("score", 6).alias("score"))


@query(sql.HYBRID)
def hybrid_search(spark, d):
    return retrieve.hybrid(*_legs(spark, d), views.as_of())


@query(sql.RERANKED)
def hybrid_reranked(spark, d):
    """The search with a reranker's scores for two thirds of the memories blended in."""
    scores = _m(spark, d).where("i % 3 <> 0").select("id", ((F.col("i") % 10) / F.lit(10.0)).alias("rerank"))
    return retrieve.hybrid(*_legs(spark, d), views.as_of(), reranked=scores)


@query(sql.SEARCH_FILTERS)
def search_filters(spark, d):
    """What a request's scope, tags, source and agent leave, for two requests."""
    m = scan.live(_m(spark, d)).withColumn("scope", F.col("tier"))
    source = views.read(spark, d, "documents").agg(F.min("source")).first()[0]
    first = m.where(retrieve.scoped("core", ["t3"], source)).select("id")
    return first.unionByName(m.where(retrieve.scoped(tags=["en", "t2"], agent="agent-3")).select(F.concat("id", F.lit("/agent")).alias("id")))


@query(sql.TRACE)
def retrieval_trace(spark, d):
    all_stages = retrieve.stages(*_legs(spark, d), views.as_of(), hold=lambda rows: scratch.held(rows, "trace"))
    return retrieve.trace(all_stages).select(F.col("pos").cast("long").alias("pos"), "stage", "output_count", "low", "high")


@query(sql.DIVERSITY)
def diversity_penalty(spark, d):
    m = scan.live(_m(spark, d)).select("id", "category", "content", (F.col("importance") + F.col("confidence") + 0.1).alias("score"))
    top = m.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= 2 * SearchOptions().limit).drop("_n")
    return retrieve.diversify(top, by=["category"]).select("category", "id", F.round("score", 6).alias("score"))


@query(sql.CROSS_SPACE)
def cross_space_search(spark, d):
    words, vector = _probe(spark, d)
    m, vectors = (_m(spark, d, v).where("state <> 'deleted'") for v in (False, True))  # texts never meet vectors
    scored = vectors.where("vector is not null").join(F.broadcast(vector)).select("space_id", "id", F.round(scoring.cosine(F.col("vector"), F.col("qv")), 6).alias("score"))
    top = lambda rows: rows.withColumn("_n", F.row_number().over(Window.partitionBy("space_id").orderBy(F.desc("score"), "id"))).where("_n <= 30").drop("_n")
    t = retrieve.bm25_scores(m, words).join(m.select("id", "space_id"), "id").select("space_id", "id", "score")
    ranked = retrieve.hybrid(m, top(scored), top(t), views.as_of(), SearchOptions(), ["space_id"], hold=lambda rows: scratch.held(rows, "cross-space"))
    return retrieve.cross_space(ranked, views.spaces(spark), 20)


# --- ingest


@query(sql.DEDUP)
def session_dedup(spark, d):
    s = views.sessions(spark, d)
    again = F.sha2(F.concat("session_id", "role", "content", F.lit(" again")).cast("binary"), 256)
    return ingest.new_messages(s.withColumn("content_hash", F.when(F.col("turn") % 3 == 0, again).otherwise(F.col("content_hash"))), s).select("id", "content_hash")


@query(sql.SESSION_DELETE)
def session_delete(spark, d):
    s = views.sessions(spark, d)
    return tables.drop_sessions(s, s.where("conv_id % 5 = 2").select("session_id").distinct()).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(sql.HASHES)
def session_hashes(spark, d):
    s = views.sessions(spark, d).select("content_hash")
    return tables.has_hash(s, s.union(s.select(F.sha2(F.col("content_hash").cast("binary"), 256)))).distinct()


@query(sql.SESSION_COUNTS)
def session_counts(spark, d):
    return views.sessions(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("roles"))


@query(sql.BUDGET)
def message_budget(spark, d):
    return ingest.budget(views.sessions(spark, d), "conv_id", "turn").select("conv_id", "turn")


@query(sql.REDACT)
def privacy_redact(spark, d):
    return ingest.redacted(views.messages(spark, d)).select("id", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))


@query(sql.NOISE)
def noise_filter(spark, d):
    return ingest.without_noise(views.messages(spark, d)).select("id")


@query(sql.PROTOTYPES)
def noise_prototypes(spark, d):
    """All vectors that are like one of five prototypes."""
    rows = views.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ingest.like_prototypes(rows, rows.where("vec_id < 5").select(F.col("vector").alias("p_vector")), 0.25).select("vec_id")


@query(sql.TEXT_MARKS)
def text_marks(spark, d):
    """Keywords that ask to remember, and texts without the fences or the context around them."""
    t, id_ = F.coalesce("text", F.lit("")), F.col("doc_id")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    said = F.concat(t, F.when(id_ % 4 == 0, " Please REMEMBER it").when(id_ % 4 == 1, " 别忘了").otherwise(""))
    fenced = F.concat(F.lit("```json\n"), t, F.lit("\n```"))
    around = F.concat(F.lit("<memory-context>a\nb</memory-context>\n"), t, F.lit(" <memory-context></memory-context>"))
    return views.read(spark, d, "documents").select("doc_id", text.has_keyword(said).alias("keyword"), sha(text.strip_fence(fenced)).alias("fence"), sha(text.strip_context(around)).alias("context"))


@query(sql.ENVELOPE)
def envelope_strip(spark, d):
    wrapped = F.concat(F.lit("bot: System: [10:00] Channel general\n"), "content", F.lit('\nSender (untrusted metadata): {"a":\n 1}\nend'))
    return views.sessions(spark, d).select("id", F.sha2(text.strip_envelope(wrapped).cast("binary"), 256).alias("sha"))


@query(sql.TRANSCRIPT)
def transcript_tail(spark, d):
    return ingest.transcript(views.sessions(spark, d), "conv_id", "turn").select("conv_id", "turn", F.length("content").cast("long").alias("n"))


@query(sql.TRANSCRIPT)
def transcript_source(spark, d):
    """Conversations as transcript files that Spark writes, read back by the data source; its sessions' tails are those of transcript_tail."""
    files.register(spark)
    at = scratch.place(spark, "transcripts")
    entry = F.to_json(F.struct("session_id", "conv_id", "turn", "role", "content"))
    views.sessions(spark, d).select(entry.alias("value")).write.text(at)
    field = lambda name: F.col("fields")[name].cast("long")
    messages = spark.read.format("transcripts").load(at).select("session", field("conv_id").alias("conv_id"), field("turn").alias("turn"), "role", "content")
    return ingest.transcript(messages, "session", "turn").select("conv_id", "turn", F.length("content").cast("long").alias("n"))


@query(sql.BLOCKS)
def message_blocks(spark, d):
    return ingest.message_block(views.sessions(spark, d), "conv_id", "turn").select("conv_id", F.sha2(F.col("block").cast("binary"), 256).alias("sha"))


def _facts(spark, d):
    b = views.read(spark, d, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("l0"), F.get(F.array(*map(F.lit, ("profile", "preferences", "entities", "events", "cases", "patterns"))), (F.col("item_id") % 6).cast("int")).alias("category"), F.concat("text", F.lit(" and more words")).alias("source_text"))
    v = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vector"))
    return b.join(v, "fact_id")


def _with_update(spark, d):
    return _m(spark, d, True).withColumn("updated_at", F.col("created_at"))


@query(sql.GATHER)
def gather_existing(spark, d):
    facts = _facts(spark, d)
    return ingest.candidates(facts, _with_update(spark, d)).select("fact_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(sql.GATHER_BOTH)
def gather_both_legs(spark, d):
    """Each fact is a request of its own, so all keep their candidates of both legs."""
    facts = _facts(spark, d)
    found = ingest.candidates(facts, _with_update(spark, d)), ingest.text_candidates(facts.drop("vector"), _m(spark, d))  # words need no vectors
    legs = [leg.select(F.col("fact_id").alias("request"), "fact_id", "id", "rank") for leg in found]
    return ingest.gather(*legs, by=["request"]).select(F.col("request").alias("fact_id"), "id", F.col("ordinal").cast("long").alias("ordinal"))


@query(sql.ADMISSION)
def admission_score(spark, d):
    facts = _facts(spark, d)
    out = ingest.admission(facts.drop("vector"), ingest.candidates(facts, _with_update(spark, d), 5, 0.0), views.as_of())
    return out.select("fact_id", "score", "decision")


@query(sql.SLOTS)
def preference_slots(spark, d):
    m = views.messages(spark, d).withColumn("slot", text.preference_slot(F.col("content"))).where("slot is not null")
    return m.select("id", "slot.brand", "slot.item")


@query(sql.GUARD)
def preference_guard(spark, d):
    m = views.messages(spark, d).withColumn("category", F.lit("preferences"))
    facts = m.select(F.col("id").alias("fact_id"), F.when(F.col("conv_id") % 2 == 0, "I love mocha from starbucks").otherwise("I like latte from Starbucks").alias("l0"), "category")
    return ingest.guarded(facts, m).select("fact_id")


def _decisions(spark, d):
    b = views.read(spark, d, "benchmark")
    return b.select(F.concat(F.lit("d"), "item_id").alias("decision_id"), F.get(F.array(*map(F.lit, (*reconcile.ACTIONS, "unknown"))), (F.col("item_id") % 8).cast("int")).alias("action"), F.col("item_id").alias("fact_id"), F.concat(F.lit("m"), (F.col("item_id") * 37) % views.read(spark, d, "documents").count()).alias("match_id"), F.concat(F.lit("merged "), "text").alias("merged_content"))


@query(sql.RECONCILE)
def reconcile_apply(spark, d):
    m = _m(spark, d).withColumn("invalidated_at", F.lit(None).cast("timestamp"))
    b = views.read(spark, d, "benchmark")
    facts = b.select(F.col("item_id").alias("fact_id"), F.col("text").alias("l0"), F.get(F.array(*map(F.lit, ("profile", "preferences", "entities", "events", "cases", "odd"))), (F.col("item_id") % 6).cast("int")).alias("category"))
    out = reconcile.apply(m, reconcile.resolve(_decisions(spark, d), facts, m), views.as_of())
    return out.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("sha"), "category", "state", F.round("confidence", 6).alias("confidence"), "superseded_by", F.col("invalidated_at").isNotNull().alias("invalidated"), F.size("relations").cast("long").alias("n_relations"), "version")


@query(sql.CROSS_RECONCILE)
def cross_reconcile(spark, d):
    e = views.read(spark, d, "embeddings")
    none = F.array().cast("array<struct<relation_type:string,target_id:string,context_label:string>>")
    m = e.select(F.concat(F.lit("m"), "vec_id").alias("id"), F.lit("active").alias("state"), F.col("embedding").alias("vector"), none.alias("relations"))
    return reconcile.near_edges(m, 0.3)


# --- sharing


@query(sql.ACCESS)
def space_access(spark, d):
    return sharing.access(views.spaces(spark))


@query(sql.SPACES_OF)
def spaces_for_user(spark, d):
    return sharing.spaces_of(views.spaces(spark), "u1").select("id", "space_type")


def _copied(rows):
    p = lambda c: F.col(f"provenance.{c}")
    return rows.select(
        "id", "space_id", "provenance_source_id", p("source_version").alias("source_version"), p("shared_from_space").alias("from_space"), p("shared_by_user").alias("by_user"), p("original_created_at").alias("original_created_at"),
        F.col("access_count").cast("long").alias("access_count"), "version", "visibility", "superseded_by", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
    )


@query(sql.SHARE_FILTERED)
def share_filtered(spark, d):
    return _copied(sharing.shared_all(_m(spark, d), "u2", "team/a", views.as_of(), sharing.share_filter(["preferences", "events", "cases"], ["en", "t6"], 0.3)))


@query(sql.PULL)
def pull_memories(spark, d):
    m = _m(spark, d)
    return _copied(sharing.pulled(m, m.where("version = 2"), "org/x", "u1", views.as_of()))


@query(sql.SHARE_EVENTS)
def share_events(spark, d):
    made = sharing.shared_all(_m(spark, d), "u2", "team/a", views.as_of(), F.lit(True))
    return sharing.events_of(made, "share").select("id", "action", "from_space", "to_space", "user_id", "preview")


@query(sql.UNSHARED)
def unshare(spark, d):
    m = _m(spark, d).withColumn("provenance", F.struct(F.lit("u0").alias("shared_by_user")))
    return sharing.unshared(m, m.select("id"), "personal/u2", views.spaces(spark), "u2").select("id", "state", "version")


@query(sql.RESHARED)
def reshare(spark, d):
    m = _m(spark, d).where("true")
    return sharing.reshared(m, m.select("id"), views.as_of(), "u1").select("id", F.when(F.col("id").contains("@"), "active").otherwise(F.col("state")).alias("state"), "source_version")


@query(sql.BRIDGE)
def bridge_space(spark, d):
    """u0 and u1 share a space already, u2 and u4 get one."""
    return sharing.with_bridge(sharing.with_bridge(views.spaces(spark), "u1", "u0"), "u2", "u4").select("id", "space_type", "owner_id")


@query(sql.AUTO_SHARE)
def auto_share(spark, d):
    m = scan.live(_m(spark, d))
    hit = sharing.matched_rules(m, views.rules(spark)).select(F.col("id").alias("source_id"), "to_space", "rule_id")
    made = sharing.auto_copies(m, views.rules(spark), views.as_of(), "u0").select("id", F.col("provenance_source_id").alias("source_id"), F.col("space_id").alias("to_space"))
    return made.join(hit, ["source_id", "to_space"]).select("id", "source_id", "to_space", "rule_id")


@query(sql.IDEMPOTENT)
def share_idempotent(spark, d):
    m = _m(spark, d)
    return sharing.not_yet_shared(m, "team/a").where("state <> 'deleted' and space_id = 'org/x'").select("id")


@query(sql.OUTCOME)
def share_outcome(spark, d):
    m = _m(spark, d)
    ids = m.select("id").union(m.where("i % 7 = 0").select(F.concat("id", F.lit("?"))))
    return sharing.share_outcome(m, ids, "personal/u1")


@query(sql.TENANTS)
def tenant_gate(spark, d):
    tenants = spark.createDataFrame([(f"u{i}", "suspended" if i % 3 == 2 else "active") for i in range(6)], "id string, status string")
    return tables.active_tenants(tenants, spark.range(8).select(F.concat(F.lit("u"), "id").alias("id")))


@query(sql.TASKS)
def import_tasks(spark, d):
    """Tasks of every conversation: pending, running, completed or failed, each asked to complete, except that pending ones are asked to run."""
    ids = views.read(spark, d, "conversations").select("conv_id").distinct()
    status = F.get(F.array(*map(F.lit, ("pending", "running", "completed", "failed"))), (F.col("conv_id") % 4).cast("int"))
    t = ids.where("conv_id >= 0").select(F.concat(F.lit("t"), "conv_id").alias("id"), status.alias("status"), F.lit(None).cast("timestamp").alias("completed_at"))
    moved = tables.move_tasks(t, t.select("id", F.when(F.col("status") == "pending", "running").otherwise("completed").alias("to")), views.as_of())
    return moved.select("id", "status", F.col("completed_at").isNotNull().alias("stamped"))


@query(sql.TASK_RECORDS)
def import_task_records(spark, d):
    """Every conversation as an import task that a stream of events moves: a turn is a chunk, every fourth fails; events of even turns come twice; some tasks need no processing, fail, are rolled back or hear no more."""
    turns = views.read(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max(F.coalesce(F.length("text"), F.lit(0)) % 3).alias("f"))
    c, none = F.col("conv_id"), F.lit(None).cast("string")
    event = lambda rows, kind, after, part, n, message=none: rows.select(c.cast("string").alias("task_id"), F.lit(kind).alias("kind"), part.cast("long").alias("part"), n.cast("long").alias("n"), message.alias("message"), F.timestamp_seconds(c * 60 + after).alias("at"))
    tasks = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"))
    at = lambda kind, where, after, n=F.lit(0), message=none: event(tasks.where(where), kind, after, F.lit(0), n, message)
    good = turns.where("turn % 4 <> 3")
    parts = [
        at("created", "true", 0, (c % 7 != 3).cast("long")), at("chunked", "true", 10, F.col("chunks")), event(good, "extracted", 20, F.col("turn"), F.col("f")), event(good.where("turn % 2 = 0"), "extracted", 20, F.col("turn"), F.col("f")),
        event(turns.where("turn % 4 = 3"), "chunk_failed", 20, F.col("turn"), F.lit(0), F.lit("no answer")), at("failed", "conv_id % 13 = 5", 25, message=F.lit("store gone")), at("reconciled", "conv_id % 3 = 0", 30, c % 5),
        at("reconcile_failed", "conv_id % 3 = 1", 30, message=F.lit("no answer")), at("rolled_back", "conv_id % 11 = 0", 40),
    ]
    events = scratch.place(spark, "task-events")
    functools.reduce(DataFrame.unionByName, parts).write.parquet(events)
    stream = spark.readStream.schema(state.EVENTS).parquet(events)
    records = state.latest(state.finished(state.task_records(stream, "1 hour", "601 seconds"), scratch.place(spark, "task-checkpoint"), scratch.place(spark, "task-records")))
    return records.select("task_id", "status", "extraction_status", "extraction_chunks", "extraction_facts", "extraction_progress", "reconcile_status", "reconcile_merged", F.size("errors").cast("long").alias("n_errors"))


@query(sql.SELF_DEDUP)
def batch_self_dedup(spark, d):
    b = views.read(spark, d, "benchmark").select(F.col("item_id").alias("fact_id"), F.floor(F.col("item_id") / 10).alias("request"), F.when(F.col("item_id") % 5 == 4, "the same words each time").otherwise(F.col("text")).alias("l0"))
    return reconcile.self_dedup(b).select("fact_id")


@query(sql.STALE_COPIES)
def stale_copies(spark, d):
    return sharing.stale_copies(_m(spark, d))


# --- profile and context


@query(sql.PROFILE_STATIC)
def profile_static(spark, d):
    return profile.static_facts(_m(spark, d))


@query(sql.PROFILE_DYNAMIC)
def profile_dynamic(spark, d):
    return profile.dynamic_context(_m(spark, d), views.as_of())


@query(sql.PROFILE)
def profile_with_query(spark, d):
    return profile.profile(_m(spark, d), views.as_of(), _probe(spark, d)[0]).select("section", "place", "id", F.round("score", 6).alias("score"))


@query(sql.CONTEXT)
def context_block(spark, d):
    return profile.context_lines(scan.live(_m(spark, d)), 600).select("id", "category", "spent")


@query(sql.LABELS)
def age_labels(spark, d):
    t = F.col("created_at")
    return scan.live(_m(spark, d)).select("id", text.age_label(t, views.as_of()).alias("age"), text.relative_age(t, views.as_of()).alias("short_age"), text.token_estimate(F.col("content")).cast("long").alias("tokens"), F.length(text.preview(F.col("content"))).cast("long").alias("preview_chars"), F.round(scoring.utility(F.col("l0_abstract")), 6).alias("utility"))


@query(sql.TAGS_OF)
def container_tags(spark, d):
    return _m(spark, d).select("tenant_id").distinct().select("tenant_id", text.container_tag("user", F.col("tenant_id")).alias("tag"), text.space_id(F.concat(F.lit("team:"), "tenant_id", F.lit(":x"))).alias("space_id"))


@query(sql.SIMILAR)
def word_similarity(spark, d):
    b = views.read(spark, d, "benchmark")
    a, c = b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")), b.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("tb"))
    rows = a.join(c, "a")
    return rows.select("a", F.round(text.jaccard(text.word_set(F.col("ta")), text.word_set(F.col("tb")), 1.0), 6).alias("plain"), F.round(text.jaccard(text.trimmed_word_set(F.col("ta")), text.trimmed_word_set(F.col("tb")), 0.0), 6).alias("trimmed"))


# --- texts and files


@query(sql.CONTENT_TYPE)
def content_type_detect(spark, d):
    marked = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# "), "text")).when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("\nuser: a\nassistant: b\nuser: c"))).otherwise(F.col("text"))
    return views.read(spark, d, "documents").select("doc_id", text.content_type(marked).alias("kind"))


@query(sql.SECTIONS)
def split_sections(spark, d):
    marked = F.regexp_replace("text", "\n(The|And|A)", "\n# $1")
    docs = views.read(spark, d, "documents").select("doc_id", marked.alias("text"))
    return chunk.sections(docs, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.max(F.length("section")).cast("long").alias("longest"))


@query()
def context_text(spark, d):
    """What a search for the probe adds to a prompt."""
    ranked = retrieve.hybrid(*_legs(spark, d), views.as_of()).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return profile.context_block(ranked.join(_m(spark, d).select("id", "category", "tags", "created_at", "content"), "id"), views.as_of())


@query()
def ingest_conversations(spark, d):
    """All conversations as one batch against all memories: facts are sentences, vectors hashed words."""
    embed = seams.embedder(seams.hashing_vectors)
    m = _m(spark, d).withColumns({"updated_at": F.col("created_at"), "vector": embed(F.col("l0_abstract"))})
    out, _ = flows.ingest(views.sessions(spark, d), m, views.as_of(), embed, seams.completer(seams.sentence_facts))
    return out.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("sha"), "category", "state", F.round("confidence", 6).alias("confidence"), F.size("relations").cast("long").alias("n_relations"), "version")


@query()
def import_routing(spark, d):
    docs = views.read(spark, d, "documents").select("doc_id", "text")
    return chunk.import_chunks(docs, "doc_id", "text").select("doc_id", "hint", "part", F.octet_length("chunk").cast("long").alias("bytes"))


@query()
def smart_split(spark, d):
    return chunk.chunked(views.read(spark, d, "documents"), "doc_id", "text", 4000, 200).select("doc_id", "part", F.length("chunk").cast("long").alias("n"))


@query()
def code_chunks(spark, d):
    return chunk.blocks(views.read(spark, d, "pages").select("page_id", F.regexp_replace("html", "</p>", "\n\n").alias("html")), "page_id", "html").select("page_id", "part", "start_line", "end_line")


@query()
def smart_split_lateral(spark, d):
    """smart_split from SQL text."""
    table_functions.register(spark)
    return spark.sql("SELECT doc_id, f.part, CAST(length(f.chunk) AS BIGINT) AS n FROM {docs}, LATERAL smart_chunks(text, 4000, 200) f", docs=views.read(spark, d, "documents"))


@query()
def code_chunks_lateral(spark, d):
    """code_chunks from SQL text."""
    table_functions.register(spark)
    pages = views.read(spark, d, "pages").select("page_id", F.regexp_replace("html", "</p>", "\n\n").alias("html"))
    return spark.sql("SELECT page_id, f.part, f.start_line, f.end_line FROM {pages}, LATERAL code_blocks(html) f", pages=pages)


@query()
def conversation_chunks(spark, d):
    """Each conversation as one text of its messages, in overlapping chunks of 1000 bytes."""
    table_functions.register(spark)
    turns = views.sessions(spark, d).select("conv_id", "turn", "role", "content")
    return spark.sql("SELECT conv_id, part, CAST(length(chunk) AS BIGINT) AS n FROM conversation_chunks(TABLE(SELECT * FROM {turns}), 'conv_id', 'turn', 1000, 100)", turns=turns)


@query(sql.WEBHOOK)
def webhook_commits(spark, d):
    e = views.read(spark, d, "events")
    commit = F.struct(F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("id"), F.concat(F.lit("fix "), "event_type").alias("message"), F.struct(F.concat(F.lit("u"), "user_id").alias("name")).alias("author"), F.array(F.concat(F.lit("src/a"), F.col("event_id") % 5, F.lit(".py"))).alias("added"), F.array(F.lit("README.md")).alias("modified"))
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("r"), F.col("user_id") % 3).alias("full_name")).alias("repository"), F.array(commit).alias("commits")))
    rows = e.select(F.lit("push").alias("event"), payload.alias("payload"))
    return webhook.commits(rows).select("repo", "kind", "content", F.array_join("tags", "|").alias("tags"))


@query(sql.DISCUSSIONS)
def webhook_discussions(spark, d):
    """Issues, comments, pull requests and reviews from payloads that Spark makes of events; every fifth is of another kind."""
    n = F.col("event_id")
    user = F.when(n % 3 != 0, F.struct(F.concat(F.lit("u"), "user_id").alias("login"))).alias("user")
    body = F.concat(F.lit("b"), "user_id").alias("body")
    about = (n.alias("number"), F.when(n % 7 != 0, F.col("event_type")).alias("title"), body, user)
    ref = lambda x: F.struct(x.alias("ref"))
    parts = {
        "repository": F.struct(F.concat(F.lit("r"), F.col("user_id") % 3).alias("full_name")),
        "issue": F.when((n % 5).isin(0, 1, 4), F.struct(*about)),
        "comment": F.when(n % 5 == 1, F.struct(body, user)),
        "pull_request": F.when((n % 5).isin(2, 3), F.struct(*about, ref(F.concat(F.lit("f"), n)).alias("head"), ref(F.lit("main")).alias("base"))),
        "review": F.when(n % 5 == 3, F.struct(F.lit("approved").alias("state"), F.when(n % 2 == 1, body).otherwise("").alias("body"), user)),
    }
    event = F.get(F.array(*map(F.lit, ("issues", "issue_comment", "pull_request", "pull_request_review", "ping"))), (n % 5).cast("int"))
    rows = views.read(spark, d, "events").select(event.alias("event"), F.to_json(F.struct(*(c.alias(k) for k, c in parts.items()))).alias("payload"))
    return webhook.discussions(rows).select("repo", "kind", "content", F.array_join("tags", "|").alias("tags"), "source")


@query()
def noise_learning(spark, d):
    e = views.read(spark, d, "embeddings")
    rows = e.select(F.concat(F.lit("u"), F.col("vec_id") % 5).alias("tenant_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), (F.col("vec_id") % 11 == 0).alias("noisy"))
    return flows.noise_by_tenant(rows)
