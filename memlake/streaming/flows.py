"""Streams: ingest with dedup across batches, reconciliation by batch, learned noise, webhooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import seams, text
from memlake.operators import ingest as operators
from memlake.operators import knn, reconcile
from memlake.sources import webhook

MAX_PROTOTYPES, KNOWN, NOISY = 200, 0.95, 0.82


def session_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(stream: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each content hash once. With an event time, hashes are forgotten when the watermark has passed, which bounds the state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"]) if time else stream.dropDuplicates(["content_hash"])


def two_paths(stream: DataFrame, checkpoint: str, raw: Callable[[DataFrame], None], enriched: Callable[[DataFrame], None]):
    """Write each batch as it came, then what is left of it after redaction and noise. A failure of the second leaves the first."""

    def both(batch: DataFrame, _: int) -> None:
        raw(batch)
        rows = batch.where(~text.fully_private(F.col("content"))).withColumn("content", text.redact(F.col("content")))
        enriched(rows.where(~text.is_noise(F.col("content"))))

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


def ingest(messages: DataFrame, memories: DataFrame, now, embed, extract, decide=seams.ruled_decisions, tenant: str = "", ledger: DataFrame | None = None, held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of a tenant's memories (all columns, vector included) after a batch of messages (conv_id, turn, role, content), and the ledger's new rows: the newest messages of
    each conversation, without private parts, give facts; noise goes; admission, what exists and the preference guard decide which are asked about; decisions are applied.

    embed and extract are column functions (text to vector, text to the JSON of seams.FACTS), decide a rule over the best match's score. Facts of one conversation
    are one request. Each conversation's facts are compared with the memories before the batch, so the order of conversations doesn't matter; decisions on one memory
    count in the order of conversations and of their facts.

    A decision's id is made from its conversation and the fact's words, so a later batch of a conversation makes ids of its own, and a batch that runs again makes the same. Facts whose
    id is in the ledger (decision_id) were decided before, whatever was decided, and take no part.

    Facts, their matches and decisions are read several times, so they are kept meanwhile; they are added to `held` for the caller to let go."""
    held = [] if held is None else held

    def keep(rows: DataFrame) -> DataFrame:
        held.append(rows.persist())
        return rows

    kept = reconcile_input(messages, embed, extract)
    if ledger is not None:
        kept = kept.join(ledger.select(F.expr("substring(decision_id, 2)").alias("fact_id")), "fact_id", "left_anti")
    kept = keep(kept)
    live = memories.where("state <> 'deleted'")
    # admission and decisions ask for the best alone
    near = keep(operators.candidates(kept, live, 1, 0.0, among=keep(knn.first_of_equal(live.select("id", "vector"), 1))))
    judged = keep(operators.admission(kept.drop("vector"), near, now))
    admitted = judged.where("decision <> 'reject'")
    guarded = operators.guarded(admitted, live.withColumn("content", F.col("l0_abstract")) if "l0_abstract" in live.columns else live).select("fact_id", F.lit(True).alias("_guarded"))
    best = near.where(F.col("score") >= 0.3).groupBy("fact_id").agg(F.max_by("id", F.struct("score", -F.col("rank"))).alias("match_id"), F.max("score").alias("best"))
    asked = judged.join(best, "fact_id", "left").join(guarded, "fact_id", "left")
    action = F.when(F.col("decision") == "reject", "REJECT").when(F.coalesce("_guarded", F.lit(False)) | F.col("match_id").isNull(), "CREATE").otherwise(decide(F.col("best")))
    decisions = asked.select(F.concat(F.lit("i"), "fact_id").alias("decision_id"), action.alias("action"), "fact_id", "match_id", F.lit(None).cast("string").alias("merged_content"), F.struct("request", "at").alias("seq"))
    decisions = keep(decisions)
    made = keep(reconcile.resolve(decisions.where("action <> 'REJECT'"), admitted, memories))
    return reconcile.apply(memories, made, now, embed, tenant), decisions.select("decision_id", "action", now.alias("decided_at"))


def reconcile_input(messages: DataFrame, embed, extract) -> DataFrame:
    """(fact_id, request, at, l0, l1_overview, l2_content, tags, category, support, vector): the facts of each conversation's newest messages that aren't noise and don't repeat one
    before. fact_id is a digest of the conversation and the fact's words; of equal facts of a conversation the first one counts. How far the conversation backs a fact is told here, so no
    fact takes its conversation's text along."""
    rows = operators.redacted(operators.budget(messages, "conv_id", "turn"))
    block = operators.message_block(rows, "conv_id", "turn").withColumn("_words", text.trimmed_word_set(F.col("block")))
    found = block.select(F.col("conv_id").alias("request"), "_words", F.posexplode(F.from_json(extract(F.col("block")), seams.FACTS)["memories"]).alias("at", "m"))
    facts = found.select("request", "at", operators.support_by(F.col("m.l0_abstract"), F.col("_words")).alias("support"), F.col("m.l0_abstract").alias("l0"), "m.l1_overview", "m.l2_content", "m.tags", F.col("m.category").alias("category"))
    facts = facts.where(F.coalesce(text.strip(F.col("l0")) != "", F.lit(False))).where(~text.is_noise(F.col("l0")))
    digest = F.substring(F.sha2(F.concat_ws("\x1f", F.col("request").cast("string"), F.col("l0")).cast("binary"), 256), 1, 32)
    facts = facts.withColumn("fact_id", digest).groupBy("fact_id", "request").agg(F.min_by(F.struct("at", "l0", "l1_overview", "l2_content", "tags", "category", "support"), "at").alias("f"))
    kept = reconcile.self_dedup(facts.select("fact_id", "request", "f.*"), order="at")
    return kept.withColumn("vector", embed(F.col("l0")))


def upserts(stream: DataFrame, checkpoint: str, table, now, embed, extract, decide=seams.ruled_decisions, tenant: str = ""):
    """Each batch of messages is merged into a versioned table (store.Table) by one writer. The ledger of decisions is a part of the same version, so a batch counts with its ledger or not at
    all, and one that comes again after a failure changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        known, held = table.part("ledger"), []
        try:
            rows, decided = ingest(batch, table.read(), now, embed, extract, decide, tenant, known, held)
            table.replace(rows, ledger=decided if known is None else known.unionByName(decided))
        finally:
            for rows in held:
                rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def webhook_stream(spark: SparkSession, path: str) -> DataFrame:
    """Memories of pushes and discussions, from files of (event, payload) as they come."""
    return webhook.memories(spark.readStream.schema("event string, payload string").json(path))


def learn_noise(vectors, noisy: np.ndarray, known: list[np.ndarray], fixed: list[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are noise, in order of arrival, and the prototypes learned afterwards: first in, first out, and none nearly equal to another or a fixed one. A null vector teaches nothing."""
    hits = np.zeros(len(vectors), dtype=bool)

    def unit() -> np.ndarray | None:
        every = np.array([*fixed, *known], dtype=float)
        return every / np.maximum(np.linalg.norm(every, axis=1, keepdims=True), np.finfo(float).tiny) if len(every) else None

    held = unit()
    for i, v in enumerate(vectors):
        if v is None:
            hits[i] = noisy[i]
            continue
        v = np.asarray(v, dtype=float)
        n = np.linalg.norm(v)
        near = -1.0 if held is None else float((held @ v).max() / n) if n else 0.0
        hits[i] = noisy[i] or near >= NOISY
        if hits[i] and near < KNOWN:
            known = [*known, v][-MAX_PROTOTYPES:]
            held = unit()
    return hits, known


def noise_by_tenant(rows: DataFrame) -> DataFrame:
    """(tenant_id, seq, noise) from (tenant_id, seq, vector, noisy). Order matters, so a tenant's rows are read in order in one task, in batches; only the prototypes are held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, known = None, []
        for frame in frames:
            out = []
            for t, part in frame.groupby("tenant_id", sort=False):
                known = known if t == tenant else []
                tenant = t
                hits, known = learn_noise(np.array(part["vector"].tolist(), dtype=float), part["noisy"].to_numpy(), known)
                out.append(pd.DataFrame({"tenant_id": t, "seq": part["seq"], "noise": hits}))
            if out:
                yield pd.concat(out)

    rows = rows.select("tenant_id", "seq", "vector", "noisy").repartition("tenant_id").sortWithinPartitions("tenant_id", "seq")
    return rows.mapInPandas(run, "tenant_id string, seq long, noise boolean")


def windowed_activity(stream: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
