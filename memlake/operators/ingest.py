"""From messages to admitted facts: dedup, budget, privacy, noise, admission, and what each fact is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring, text
from memlake.operators import knn, retrieve

MAX_MESSAGES, MAX_BYTES = 20, 200_000


def new_messages(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages whose hash isn't stored; equal messages within the batch all stay."""
    return incoming.join(stored.select("content_hash"), "content_hash", "left_anti")


def budget(messages: DataFrame, by: str, order: str, max_messages: int = MAX_MESSAGES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The newest messages of each conversation within both limits; the newest always stays."""
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    rows = messages.withColumns({"_n": F.row_number().over(newest), "_bytes": F.sum(F.octet_length("content")).over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("_n") <= max_messages) & ((F.col("_n") == 1) | (F.col("_bytes") <= max_bytes))).drop("_n", "_bytes")


def redacted(messages: DataFrame) -> DataFrame:
    return messages.where(~text.fully_private(F.col("content"))).withColumn("content", text.redact(F.col("content")))


def without_noise(messages: DataFrame) -> DataFrame:
    return messages.where(~text.is_noise(F.col("content")))


def like_prototypes(rows: DataFrame, prototypes: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Rows (vector) that are near a noise prototype (p_vector). Learned prototypes number MAX_PROTOTYPES of a tenant at most (flows.learn_noise)."""
    return rows.join(prototypes.select("p_vector"), scoring.cosine(F.col("vector"), F.col("p_vector")) >= threshold, "left_semi")


def transcript(messages: DataFrame, by: str, order: str, keep: int = 10, longest: int = 2000) -> DataFrame:
    """The last user and assistant messages, cut to `longest` characters; conversations of one message go."""
    rows = messages.where(F.col("role").isin("user", "assistant") & (text.strip(F.col("content")) != ""))
    n, back = F.count(F.lit(1)).over(Window.partitionBy(by)), F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    rows = rows.withColumns({"_total": n, "_back": back}).where((F.col("_back") <= keep) & (F.col("_total") >= 2))
    return rows.withColumn("content", F.substring("content", 1, longest)).drop("_total", "_back")


def message_block(messages: DataFrame, by: str, order: str, longest: int = 8000) -> DataFrame:
    """`role: content` lines of each conversation. Of one over `longest` bytes, its last bytes from the first line that starts within them, or all of these
    if none does. Null roles and texts count as empty. A conversation is one value of the result, so it is gathered whole."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = messages.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "").alias("block"))
    rows = rows.withColumn("_tail", text.last_bytes(F.col("block"), longest)).withColumn("_at", F.locate("\n", F.col("_tail")))
    ended = F.when(F.col("_at") == F.char_length("_tail"), F.col("_tail")).otherwise(F.substring("_tail", F.col("_at") + 1, F.lit(longest)))
    return rows.withColumn("block", F.when(F.octet_length("block") <= longest, F.col("block")).otherwise(ended)).drop("_tail", "_at")


def candidates(facts: DataFrame, memories: DataFrame, k: int = 5, min_score: float = 0.3, block: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """(fact_id, id, score, updated_at, rank): the k nearest memories of each fact. `among` (id, vector) are those of the memories that can be, if that is known."""
    live = memories.where("state <> 'deleted'")
    found = knn.topk(facts.select("fact_id", "vector"), live.select("id", "vector") if among is None else among, k, min_score, block)
    return found.join(live.select("id", "updated_at"), "id").select("fact_id", "id", "score", "updated_at", "rank")


def text_candidates(facts: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """(fact_id, id, score, rank): the k memories that match the first 200 characters of each fact's source text best by words."""
    return retrieve.bm25_topk_each(memories.where("state <> 'deleted'"), facts.select("fact_id", F.substring("source_text", 1, 200).alias("query")), k, "fact_id")


def gather(vector_leg: DataFrame, text_leg: DataFrame, cap: int = 60, by: list[str] = ()) -> DataFrame:
    """(*by, id, ordinal): candidates of all facts of a request (`by`) by first appearance: each fact's vector matches, then its text matches. Both legs are (*by, fact_id, id, rank), k a fact."""
    legs = vector_leg.select(*by, "id", F.struct("fact_id", F.lit(0).alias("leg"), "rank").alias("at")).unionByName(text_leg.select(*by, "id", F.struct("fact_id", F.lit(1).alias("leg"), "rank").alias("at")))
    first = legs.groupBy(*by, "id").agg(F.min("at").alias("at"))
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("at", "id")) - 1).where(F.col("ordinal") < cap).select(*by, "id", "ordinal")


def support(fact: Column, message: Column) -> Column:
    """How much of a fact's wording its conversation backs."""
    return support_by(fact, text.trimmed_word_set(message))


def support_by(fact: Column, words: Column) -> Column:
    """support() of a conversation whose trimmed_word_set is there."""
    return text.jaccard(text.trimmed_word_set(fact), words, 0.0)


def admission(facts: DataFrame, matches: DataFrame, now: Column, preset: str = "balanced") -> DataFrame:
    """facts (fact_id, l0, category, and source_text or else its `support`) with the scores of the five features, the composite and the decision. matches are the k nearest with a
    score of 0 at least; of equal scores that of the smallest id is the best."""
    best = matches.groupBy("fact_id").agg(F.max("score").alias("max_sim"), F.min_by("updated_at", F.struct(-F.col("score"), "id")).alias("best_at"))
    rows = facts.join(best, "fact_id", "left").withColumn("max_sim", F.coalesce("max_sim", F.lit(0.0)))
    days = F.floor(F.greatest((F.unix_seconds(now) - F.unix_seconds("best_at")) / 86400, F.lit(0)))
    rows = rows.withColumns({
        "utility": scoring.utility(F.col("l0")), "support": F.col("support") if "support" in facts.columns else support(F.col("l0"), F.col("source_text")), "novelty": 1 - F.col("max_sim"),
        "recency": F.when(F.col("best_at").isNull(), 1.0).otherwise(1 - F.exp(-days / F.lit(30.0))), "prior": scoring.type_prior(F.col("category")),
    })
    rows = rows.withColumn("score", F.round(0.1 * (F.col("utility") + F.col("support") + F.col("novelty") + F.col("recency")) + 0.6 * F.col("prior"), 6))
    return rows.withColumn("decision", scoring.decision(F.col("score"), F.col("max_sim"), preset))


def guarded(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """Preference facts that name another item of a brand that a stored preference names: these are created without asking."""
    slot = lambda rows, c: rows.where("category = 'preferences'").withColumn("slot", text.preference_slot(F.col(c))).where("slot is not null").withColumns({"brand": F.lower("slot.brand"), "item": F.lower("slot.item")})
    held = slot(memories, "content").select(F.col("brand").alias("h_brand"), F.col("item").alias("h_item")).distinct()
    new = slot(facts, "l0")
    return new.join(held, (new["brand"] == held["h_brand"]) & (new["item"] != held["h_item"]), "left_semi")
