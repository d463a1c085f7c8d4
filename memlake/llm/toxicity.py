"""Toxicity by non-negative positive-unlabelled learning: numpy models, scored over whole texts.

Fitting. Confirmed toxic documents (at most POSITIVES, picked by a hash of doc_id) and all documents without their labels, freed of equal texts, are turned into
sets of words and of their beginnings (inflected words share those). One is a feature if the probability of being
toxic that it alone tells, prior * (its rate in toxic documents) / (its rate in unlabelled ones), is over MIN_POSTERIOR at the lower bound of Z deviations;
of nested ones with equal counts one is kept. Rates are counted over all unlabelled documents, for every term that has such a probability in the sample of UNLABELLED of them without
any deviation off. The risk is that of the confirmed documents and of this sample. A feature's value is log(1 + 10 n / sqrt(words)) for n occurrences: a stem that
a long text holds once by chance says less than two in a short one. A logistic model over these then minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

by Adam; where the second part would turn negative, the step goes up its gradient instead. As calibration, the bias is then set so that the mean score of the unlabelled rows is the class prior, which is the share of toxic labels among
labelled rows. Held-out rows (crc32 of doc_id as text, modulo 4, is 2) never take part, and labels, lang, source and doc_id are never inputs.

Defined cases: a null text scores like an empty one; null labels count as unlabelled, several labels of a document as their
largest; rows that repeat score alike; without any positive all scores are the prior; other columns are kept by with_toxicity().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, cut, fold, remove, small_batches, table, text_of

POSITIVES, UNLABELLED = 4000, 12000
MIN_POSTERIOR, Z, MIN_DOCS, THRESHOLD = 0.25, 2.5, 3, 0.3
WORD = re.compile(r"\w+")


#: Lengths of beginnings of words, marked by a star.
STEMS = (4, 5, 6, 7, 8)


def terms(text: str | None) -> set[str]:
    found = set(WORD.findall((text or "").lower()))
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) >= k}


def reader(vocabulary: dict[str, int]):
    """A function from a text to its features, {index: value}."""
    whole = {w: i for w, i in vocabulary.items() if not w.endswith("*")}
    stems = {w[:-1]: i for w, i in vocabulary.items() if w.endswith("*")}
    lengths, heads = sorted({len(x) for x in stems}), {x[: STEMS[0]] for x in stems}

    def read(text: str | None) -> dict[int, float]:
        tokens = WORD.findall((text or "").lower())
        found: Counter = Counter()
        for w, n in Counter(tokens).items():
            if w in whole:
                found[whole[w]] += n
            if w[: STEMS[0]] in heads:
                for k in lengths:
                    if len(w) >= k and w[:k] in stems:
                        found[stems[w[:k]]] += n
        scale = 10 / math.sqrt(max(1, len(tokens)))
        return {i: math.log1p(n * scale) for i, n in sorted(found.items())}

    return read


def _terms(column: str):
    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(terms(t)))

    return run(column)


class Sparse:
    """A matrix by its entries."""

    def __init__(self, row, column, value, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = np.asarray(row, dtype=np.int64), np.asarray(column, dtype=np.int64), np.asarray(value, dtype=float), shape

    @classmethod
    def of(cls, x) -> Sparse:
        if isinstance(x, cls):
            return x
        row, column = np.nonzero(x)
        return cls(row, column, np.asarray(x)[row, column], np.shape(x))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.shape[1])


def fit_nnpu(positive, unlabelled, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last of them the bias, that minimise the non-negative risk under the logistic loss."""
    p, u = Sparse.of(positive), Sparse.of(unlabelled)
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    score = lambda x: x.times(w[:-1]) + w[-1]
    mean = lambda x, g: np.append(x.transposed_times(g), g.sum()) / x.shape[0]
    for step in range(1, steps + 1):
        fp, fu = score(p), score(u)
        as_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up_p, up_u = 1 / (1 + np.exp(-np.clip(fp, -500, 500))), 1 / (1 + np.exp(-np.clip(fu, -500, 500)))
        negative = mean(u, up_u) - prior * mean(p, up_p)
        grad = -negative if as_negative < 0 else negative - prior * mean(p, 1 - up_p)
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    low, high, f = -30.0, 30.0, u.times(w[:-1])
    for _ in range(60):  # the bias at which unlabelled rows are toxic with the class prior, on average
        w[-1] = (low + high) / 2
        low, high = (w[-1], high) if (1 / (1 + np.exp(-np.clip(f + w[-1], -500, 500)))).mean() < prior else (low, w[-1])
    return w


def _bounded_texts(rows: DataFrame, bound: int) -> DataFrame:
    """A written table of distinct texts, about `bound` at most."""
    texts = cut(rows.select("text").dropDuplicates(["text"]).withColumn("_key", F.xxhash64("text")), "texts")
    return bounded_sample(texts, "_key", bound)


def _bound(a, b, n_p: int, n_u: int, prior: float, z: float):
    """Logarithm of the probability of being toxic that a term alone tells, at z deviations below; a and b are the documents that hold it."""
    a, b = a + 0.5, b + 0.5
    return F.lit(float(np.log(prior))) + F.log(a / (n_p + 1)) - F.log(b / (n_u + 1)) - z * F.sqrt(1 / a + 1 / b)


def document_counts(rows: DataFrame, known: list[str]) -> tuple[DataFrame, int]:
    """(word, b): how many distinct texts of rows hold each of the known terms; and the number of distinct texts. Only the texts that hold one leave their task, as a hash
    and the places of the terms, so a text that repeats without end is counted where it is first found."""
    whole = {w: i for i, w in enumerate(known) if not w.endswith("*")}
    stems = {w[:-1]: i for i, w in enumerate(known) if w.endswith("*")}
    heads, longer = {w[: STEMS[0]] for w in stems}, sorted({len(w) for w in stems})

    def terms_in(text: str) -> list[int]:
        words = set(WORD.findall(text.lower()))
        found = {whole[w] for w in words & whole.keys()}
        for w in words:
            if w[: STEMS[0]] in heads:
                found.update(stems[w[:k]] for k in longer if len(w) >= k and w[:k] in stems)
        return sorted(found)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_in(t) for t in batch.column(1).to_pylist()]
            some = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), pa.array([found[i] for i in some], pa.list_(pa.int32()))], names=["h", "terms"])

    hashed = rows.select(F.xxhash64("text").alias("h"), "text")
    n = hashed.select("h").distinct().count()
    counts = hashed.mapInArrow(held, "h long, terms array<int>").distinct().select(F.explode("terms").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("b"))
    names = rows.sparkSession.createDataFrame(list(enumerate(known)), "i int, word string")
    return names.join(counts, "i", "left").select("word", F.coalesce("b", F.lit(0)).alias("b")), n


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """(weights of words, bias)."""
    labels = labels.where((fold() != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = labels.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(toxic / n if n else 0.1, 0.01), 0.9)
    bias = float(np.log(prior / (1 - prior)))
    if not toxic:
        return {}, bias
    small_batches(docs.sparkSession)
    confirmed = bounded_sample(labels.where("toxic = 1"), "doc_id", POSITIVES).select("doc_id")  # its size is bounded
    rows = docs.select("doc_id", text_of().alias("text")).where(fold() != 2)
    positive = _bounded_texts(rows.join(F.broadcast(confirmed), "doc_id"), POSITIVES)  # a doc_id may repeat with any number of texts
    unlabelled = _bounded_texts(bounded_sample(rows, "doc_id", UNLABELLED), UNLABELLED)
    sample = cut(positive.select(F.lit(1).alias("positive"), "text").unionByName(unlabelled.select(F.lit(0).alias("positive"), "text")), "toxicity")
    for done in (positive, unlabelled):
        remove(done)
    sizes = dict(sample.groupBy("positive").count().collect())
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return {}, bias
    counts = sample.select("positive", F.explode(_terms("text")).alias("word")).groupBy("word").agg(F.sum("positive").alias("a"), F.sum(1 - F.col("positive")).alias("b")).where(F.col("a") >= MIN_DOCS)
    screened = {r.word: r.a for r in counts.where(_bound(F.col("a"), F.col("b"), n_p, n_u, prior, 0) > float(np.log(MIN_POSTERIOR))).select("word", "a").collect()}  # terms of the bounded sample
    in_all, n_all = document_counts(rows, sorted(screened))
    counts = in_all.join(in_all.sparkSession.createDataFrame([(w, int(a)) for w, a in sorted(screened.items())], "word string, a long"), "word")
    chosen = counts.withColumn("bound", _bound(F.col("a"), F.col("b"), n_p, n_all, prior, Z)).where(F.col("bound") > float(np.log(MIN_POSTERIOR))).orderBy(F.desc("bound"), F.length("word"), "word")
    vocabulary: dict[str, int] = {}
    taken_: dict[tuple, list[str]] = {}
    for r in chosen.collect():  # no more than were screened
        stem, same = r.word.rstrip("*"), taken_.setdefault((r.a, r.b), [])
        if not any(stem.startswith(x) or x.startswith(stem) for x in same):
            vocabulary[r.word] = len(vocabulary)
            same.append(stem)
    read = reader(vocabulary)

    @F.pandas_udf("map<int,double>")
    def features(text: pd.Series) -> pd.Series:
        return text.map(read)

    entries: dict[int, tuple[list, list, list]] = {0: ([], [], []), 1: ([], [], [])}
    at = {0: 0, 1: 0}
    rows = sample.select("positive", F.xxhash64("text").alias("h"), features("text").alias("x")).collect()  # bounded by the samples
    for r in sorted(rows, key=lambda r: r.h):
        for i, v in sorted(r.x.items()):
            for held, value in zip(entries[r.positive], (at[r.positive], i, v), strict=True):
                held.append(value)
        at[r.positive] += 1
    remove(sample)
    weights = fit_nnpu(Sparse(*entries[1], (n_p, len(vocabulary))), Sparse(*entries[0], (n_u, len(vocabulary))), prior)
    return {w: float(weights[i]) for w, i in vocabulary.items()}, float(weights[-1])


def with_toxicity(docs: DataFrame, weights: dict[str, float], bias: float, column: str = "score") -> DataFrame:
    """docs with the probability of being toxic."""
    names = sorted(weights)
    read, w = reader({x: i for i, x in enumerate(names)}), [weights[x] for x in names]

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        f = np.array([bias + sum(w[i] * v for i, v in read(t).items()) for t in text], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(f, -500, 500))))

    small_batches(docs.sparkSession)
    return docs.withColumn(column, score("text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs.select("doc_id", "text"), weights, bias)
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score reaches THRESHOLD."""
    weights, bias = fit(docs, labels)
    return with_toxicity(docs, weights, bias, "_toxicity").where(F.col("_toxicity") < THRESHOLD).select(*docs.columns)
