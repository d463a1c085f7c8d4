"""Vector and BM25 search, and the twelve-stage ranking pipeline, within a partition of spaces or over all."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring, text
from memlake.operators.scan import space_weight
from memlake.schema import SearchOptions

K1, B = 1.2, 0.75
#: So many distinct terms of queries are sent to every task at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: The texts that are searched; their scores are summed.
FIELDS = ("content", "l0_abstract")


def vector_topk(memories: DataFrame, query: DataFrame, k: int, min_score: float = 0.0, where: Column | None = None) -> DataFrame:
    """Exact cosine search: filter, then the k best, then the threshold. `query` is one row with `qv`; only it is broadcast."""
    rows = memories.where("state <> 'deleted' and vector is not null")
    rows = rows.where(where) if where is not None else rows
    scored = rows.select("id", "vector").join(F.broadcast(query.select("qv").limit(1))).select("id", F.round(scoring.cosine(F.col("vector"), F.col("qv")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k).where(F.col("score") >= min_score)


def tokens(content: Column) -> Column:
    return F.filter(F.split(F.lower(content), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25_scores(docs: DataFrame, query: str | list[str], id_: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, score) of documents with a query term, summed over the fields. Terms are counted inside each row, so no posting is ever made. The counts are dealt
    once, and both the statistics (one row) and the scores read that one exchange: texts are read and split once."""
    asked = sorted(set(query if isinstance(query, list) else re.findall(r"[^\W_]+", query.lower())))
    if not asked:
        return docs.select(id_, F.lit(0.0).alias("score")).limit(0)
    rows = docs.select(id_, *(tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"w{i}") for i, f in enumerate(fields)))
    counts = [c for i in range(len(fields)) for c in (F.size(f"w{i}").alias(f"len{i}"), F.array(*(_times(f"w{i}", t) for t in asked)).alias(f"tf{i}"))]
    rows = rows.select(id_, *counts).repartition(F.col(id_))
    at = lambda c, j: F.get(c, F.lit(j))
    sums = [c for i in range(len(fields)) for c in (F.avg(f"len{i}").alias(f"avg{i}"), F.array(*(F.count_if(at(f"tf{i}", j) > 0) for j in range(len(asked)))).alias(f"df{i}"))]
    found = rows.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"), F.count(id_).alias("_ids"), *sums)))
    score = F.lit(0.0)
    for i in range(len(fields)):
        for j in range(len(asked)):
            score = score + _weight(at(f"df{i}", j), at(f"tf{i}", j), F.col(f"len{i}"), F.col(f"avg{i}"))
    return found.select(id_, score.alias("score")).where("score > 0").select(id_, F.round("score", 6).alias("score"))


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def _weight(df: Column, tf: Column, length: Column, average: Column) -> Column:
    """BM25 of one term in one text of n (a column)."""
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(F.coalesce(average, F.lit(1.0)), F.lit(1e-9))))


def bm25_topk(docs: DataFrame, query, k: int, where: Column | None = None, id_: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The k best, then the filter: fewer than k rows may remain."""
    top = bm25_scores(docs, query, id_, fields).orderBy(F.desc("score"), id_).limit(k)
    return top if where is None else top.join(docs.where(where).select(id_), id_, "left_semi")


def bm25_topk_each(docs: DataFrame, queries: DataFrame, k: int, by: str, block: int = 2048, id_: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(`by`, id, score, rank): bm25_topk for each of many queries (`by`, query). Queries and documents meet in pairs of blocks. A document is dealt as its words, once for
    each block of queries, and they are counted where they meet the queries' terms: no posting is dealt, and no pair leaves a block but the best k of each query."""
    d, q = max(1, -(-docs.count() // block)), max(1, -(-queries.count() // block))
    part = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = queries.select(by, part(q, by).alias("i"), F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    asked = asked.groupBy("i", "term").agg(F.collect_list(by).alias("asked_by"))  # a block's queries at most
    # no text holds the empty term: it stands for all texts, and carries their number and length to each block
    asked = asked.unionByName(queries.sparkSession.range(q).select(F.col("id").cast("int").alias("i"), F.lit("").alias("term"), F.array().cast(asked.schema["asked_by"].dataType).alias("asked_by")))
    terms = asked.select("term").distinct()
    few = terms.count() <= BROADCAST_TERMS
    rows = docs.select(id_, *(tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"w{i}") for i, f in enumerate(fields)))
    words = [F.struct(F.lit(i).alias("field"), F.size(f"w{i}").alias("len"), F.concat(F.array(F.lit("")), F.array_distinct(f"w{i}")).alias("w")) for i in range(len(fields))]
    words = rows.select(F.inline(F.array(*words))).select("field", "len", F.explode("w").alias("term"))
    held = lambda i: F.col("field") == i
    counts = words.join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("term").agg(
        F.array(*(F.count_if(held(i)) for i in range(len(fields)))).alias("texts"),
        F.array(*(F.sum(F.when(held(i) & (F.col("term") == ""), F.col("len")).otherwise(0)) for i in range(len(fields)))).alias("total"),
    )
    left = asked.join(F.broadcast(counts) if few else counts, "term").select("i", every(d).alias("j"), "term", "asked_by", "texts", "total")
    right = rows.select(id_, every(q).alias("i"), part(d, id_, *(f"w{i}" for i in range(len(fields)))).alias("j"), F.array(*(F.array_join(f"w{i}", " ") for i in range(len(fields)))).alias("words"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        best: list[tuple] = []
        if x.num_rows and y.num_rows:
            y = y.sort_by(id_)
            terms = x.column("term").to_pylist()
            place = {t: n for n, t in enumerate(terms) if t}
            texts, total = (np.array(x.column(c).to_pylist(), dtype=float) for c in ("texts", "total"))
            n, average = texts[terms.index("")], np.maximum((total / np.maximum(texts, 1))[terms.index("")], 1e-9)
            doc, term, weight = [], [], []
            for f in range(len(fields)):
                found, ends, lengths = array("q"), [], []
                for own in y.column("words").to_pylist():
                    own = own[f].split()
                    found.extend(place[w] for w in own if w in place)
                    ends.append(len(found))
                    lengths.append(len(own))
                at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                pairs, tf = np.unique(at * len(terms) + np.array(found, dtype=np.int64), return_counts=True)
                doc.append(pairs // len(terms))
                term.append(pairs % len(terms))
                df = texts[term[f], f]
                weight.append(np.log(1 + (n[f] - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.array(lengths)[doc[f]] / average[f])))
            doc, term, weight = (np.concatenate(c) for c in (doc, term, weight))
            order = np.argsort(term, kind="stable")
            doc, weight, ends = doc[order], weight[order], np.append(0, np.cumsum(np.bincount(term, minlength=len(terms))))
            wanted: dict = {}
            for t, keys in zip(terms, x.column("asked_by").to_pylist(), strict=True):
                for key in keys:
                    wanted.setdefault(key, []).append(t)
            ids = y.column(id_).to_pylist()
            for key, own in wanted.items():
                at = np.concatenate([np.arange(ends[place[t]], ends[place[t] + 1]) for t in sorted(own)])
                scores = np.round(np.bincount(doc[at], weight[at], len(ids)), 6)
                edge = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
                hit = np.flatnonzero((scores >= edge) & (scores > 0))
                hit = hit[np.argsort(-scores[hit], kind="stable")][:k]  # ids are in order
                best += [(key, ids[h], scores[h]) for h in hit]
        columns = list(zip(*best, strict=True)) if best else [[], [], []]
        return pa.table({by: pa.array(columns[0], x.schema.field("asked_by").type.value_type), id_: pa.array(columns[1], y.schema.field(id_).type), "score": pa.array(columns[2], pa.float64())})

    kinds = [queries.schema[by].dataType.simpleString(), docs.schema[id_].dataType.simpleString()]
    scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"{by} {kinds[0]}, {id_} {kinds[1]}, score double")
    order = Window.partitionBy(by).orderBy(F.desc("score"), id_)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(vector: DataFrame, words: DataFrame, o: SearchOptions = SearchOptions(), by: list[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, score), within `by`."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    v = vector.select(*by, "id", rank.alias("v_rank"))
    t = words.select(*by, "id", rank.alias("t_rank"), F.col("score").alias("bm25"))
    both = v.join(t, [*by, "id"], "full_outer")
    part = lambda w, r: F.coalesce(w / (o.rrf_k + F.col(r)), F.lit(0.0))
    return both.withColumn("score", part(F.lit(o.vector_weight), "v_rank") + part(F.lit(o.text_weight), "t_rank"))


def normalise(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Min-max over the candidates; equal scores become 1, a lone one min(40 s, 1)."""
    w = Window.partitionBy(*by)
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count(F.lit(1)).over(w)
    s = F.col("score")
    return rows.withColumn("score", F.when(n == 1, F.least(40 * s, F.lit(1.0))).when(high > low, (s - low) / (high - low)).when(s > 0, 1.0).otherwise(0.0))


def rerank(rows: DataFrame, reranked: DataFrame | None) -> DataFrame:
    """Blend with a reranker's scores (id, rerank), if there is one; a candidate that it left out scores 0 there."""
    rows = rows.withColumn("pre", F.col("score"))
    if reranked is None:
        return rows
    return rows.join(reranked, "id", "left").withColumn("score", 0.6 * F.coalesce("rerank", F.lit(0.0)) + 0.4 * F.col("pre")).drop("rerank")


def diversify(rows: DataFrame, o: SearchOptions = SearchOptions(), by: list[str] = ()) -> DataFrame:
    """Halve the score of a row that nearly repeats any better-ranked one: a semi-join of the few candidates with themselves."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    ranked = rows.withColumns({"_rank": F.row_number().over(w), "_words": text.word_set(F.col("content"))})
    better = ranked.select(*(F.col(c).alias(f"o_{c}") for c in by), F.col("_rank").alias("o_rank"), F.col("_words").alias("o_words"))
    near = (F.col("o_rank") < F.col("_rank")) & (text.jaccard(F.col("_words"), F.col("o_words"), 1.0) > o.diversity_similarity)
    for c in by:
        near = near & (F.col(c) == F.col(f"o_{c}"))
    hit = ranked.join(better, near, "left_semi").select(*by, "id", F.lit(True).alias("_near"))
    return ranked.join(hit, [*by, "id"], "left").withColumn("score", F.when(F.col("_near"), F.col("score") * o.diversity_penalty).otherwise(F.col("score"))).drop("_rank", "_words", "_near")


def scoped(scope: str | None = None, tags: list[str] = (), source: str | None = None, agent: str | None = None) -> Column:
    """The filters that a search request may name; none by default."""
    out = F.lit(True) if scope is None else F.col("scope") == scope
    for tag in tags:
        out = out & F.array_contains("tags", tag)
    out = out & (F.col("source") == source) if source else out
    return out & (F.col("owner_agent_id") == agent) if agent else out


def stages(memories: DataFrame, vector: DataFrame | None, words: DataFrame | None, now: Column, o: SearchOptions = SearchOptions(), by: list[str] = (), reranked: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[tuple[str, DataFrame]]:
    """Each stage's name and rows. Candidates are at most three times the limit in each leg, so all later stages are small.

    `hold` may write the legs and the candidates with their columns somewhere: who reads many stages then searches once, and all stages tell of the same candidates."""
    out: list[tuple[str, DataFrame]] = []

    def stage(name: str, rows: DataFrame) -> DataFrame:
        out.append((name, rows))
        return rows

    none = memories.select(*by, "id", F.lit(0.0).alias("score")).limit(0)
    vector, words = (none if leg is None else hold(leg) for leg in (vector, words))  # a leg that failed is empty
    top = lambda rows, n: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("_n") <= n).drop("_n")
    stage("parallel_search", vector.select("id", "score").unionByName(words.select("id", "score")))
    fused = fuse(vector, words, o, by)
    columns = [c for c in ("content", "memory_type", "tier", "importance", "confidence", "access_count", "created_at", "last_accessed_at", "category") if c not in by]
    fused = hold(fused.join(memories.select("id", *columns), "id"))
    r = stage("rrf_fusion", fused.withColumn("score", F.when(F.col("memory_type") == "pinned", F.col("score") * o.pinned_boost).otherwise(F.col("score"))))
    r = stage("rrf_normalize", normalise(r, by))
    r = stage("min_score_filter", r.where(F.col("score") >= o.min_score))
    r = stage("topk_cap", top(r, 2 * o.limit))
    r = stage("cross_encoder_rerank", rerank(r, reranked))
    r = stage("bm25_floor", r.withColumn("score", F.when(F.col("bm25") >= o.floor_bm25, F.greatest("score", o.floor_factor * F.col("pre"))).otherwise(F.col("score"))))
    r = stage("decay_boost", r.withColumn("score", F.col("score") * (0.3 + 0.7 * scoring.composite(now))))
    r = stage("importance_weight", r.withColumn("score", F.col("score") * (0.7 + 0.3 * F.col("importance"))))
    r = stage("length_normalization", r.withColumn("score", F.col("score") / scoring.length_factor(F.col("content"), o.length_reference)))
    r = stage("hard_cutoff", r.where(F.col("score") >= o.hard_cutoff))
    r = diversify(r, o, by)
    stage("mmr_diversity", top(r, o.limit))
    return out


def hybrid(memories: DataFrame, vector: DataFrame | None, words: DataFrame | None, now: Column, o: SearchOptions = SearchOptions(), by: list[str] = (), reranked: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    return stages(memories, vector, words, now, o, by, reranked, hold)[-1][1].select(*by, "id", F.round("score", 6).alias("score"))


def trace(all_stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(pos, stage, output_count, low, high)."""
    parts = [rows.agg(F.count(F.lit(1)).alias("output_count"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high")).select(F.lit(i + 1).alias("pos"), F.lit(name).alias("stage"), "output_count", "low", "high") for i, (name, rows) in enumerate(all_stages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_space(ranked: DataFrame, spaces: DataFrame, limit: int) -> DataFrame:
    """Results of each space, brought to its best score, weighted by the kind of space, and merged."""
    best = F.max("score").over(Window.partitionBy("space_id"))
    kind = spaces.select(F.col("id").alias("space_id"), "space_type")
    rows = ranked.withColumn("best", best).join(kind, "space_id")
    rows = rows.withColumn("score", F.round(F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0) * space_weight(F.col("space_type")), 6))
    return rows.orderBy(F.desc("score"), "space_id", "id").limit(limit).select("space_id", "id", "score")
