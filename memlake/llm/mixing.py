"""Mixing to target weights with soft memberships. DataFrame and SQL functions only.

A naive Bayes classifier over hashed words, fitted to a bounded sample of the labelled table, predicts each document's posterior over domains. Its
counts of words times posteriors say how many expected tokens of each domain a document brings. Projected-gradient least squares then
finds nonnegative rates r with sum_d r_d * tokens_d * P_dk = target_k: from r = 1, each round sums the K residuals over all documents and sets

    r_d = max(0, r_d - P_d . G^-1 residual),   G = sum_d tokens_d P_d P_d'

which is a gradient step scaled by 1 / tokens_d (so rates don't depend on lengths) and by G^-1 (so that step 1 is safe). Only the K residuals reach
the driver; as the steps are few and short, a document's rate is folded from them wherever it is needed, without a join.

Targets: weights of the domains, or by default their natural shares to the power TEMPERATURE. With these, the token budget is the
least at which every rate is 1 or more, so no document is lost; with given weights, the least at which no domain's tokens shrink. That budget exists where texts tell domains
apart, so that documents wholly of any domain keep a positive rate; for domains that texts don't tell, rates may fall to 0.

Defined cases: null text counts as empty and has 0 tokens; null labels are not learned from; documents that repeat get equal rates; an empty table
gives an empty result; without labels there is one domain and all rates are 1; other columns are kept by mixed().
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, cut, table, text_of

LABELLED, BUCKETS, TEMPERATURE, ROUNDS, MAX_DOMAINS = 4000, 4096, 0.7, 50, 64
#: The domain of what the MAX_DOMAINS - 1 largest domains leave.
OTHER = "other"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), "\n\t\r", "   "), " "), "")


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _literal(xs) -> Column:
    """A constant array of doubles, as one literal."""
    return F.split(F.lit(",".join(map(repr, map(float, xs)))), ",").cast("array<double>")


class Domains:
    """Domains and their word weights: log probabilities by bucket, and the log prior."""

    def __init__(self, names: list[str], prior: np.ndarray, weights: np.ndarray):
        self.names, self.prior, self.weights = names, prior, weights

    def posterior(self, buckets: Column) -> Column:
        """Array of probabilities; the evidence of n words is tempered to that of sqrt(n), as words of a text are not independent."""
        if len(self.names) == 1:
            return F.array(F.lit(1.0))
        scale = F.sqrt(F.greatest(F.size(buckets), F.lit(1)))
        total = lambda w: F.aggregate(buckets, F.lit(0.0), lambda a, i: a + F.get(w, i))
        return F.array(*(total(_literal(self.weights[k])) / scale + float(self.prior[k]) for k in range(len(self.names))))


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def fit_domains(docs: DataFrame, labelled: DataFrame, domain: str = "lang") -> Domains:
    """labelled: doc_id of the rows to learn from; their domain is a column of docs."""
    ids = bounded_sample(labelled.select("doc_id").where("doc_id is not null").distinct(), "doc_id", LABELLED)  # its size is bounded
    rows = docs.select("doc_id", "text", domain).join(F.broadcast(ids), "doc_id", "left_semi").where(F.col(domain).isNotNull())
    rows = rows.select(F.col(domain).cast("string").alias("domain"), _buckets(_words(text_of())).alias("buckets"))
    top = [r["domain"] for r in rows.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MAX_DOMAINS + 1).collect()]
    if len(top) > MAX_DOMAINS:
        rows = rows.withColumn("domain", F.when(F.col("domain").isin(top[: MAX_DOMAINS - 1]), F.col("domain")).otherwise(OTHER))
    sizes = dict(rows.groupBy("domain").count().collect())  # MAX_DOMAINS rows at most, as domains were mapped before
    counts = rows.select("domain", F.explode("buckets").alias("bucket")).groupBy("domain", "bucket").count()
    names = sorted(sizes)
    if not names:
        return Domains(["all"], np.zeros(1), np.zeros((1, BUCKETS)))
    table_ = np.full((len(names), BUCKETS), 0.5)
    for r in counts.collect():  # at most MAX_DOMAINS * BUCKETS rows
        table_[names.index(r["domain"]), r["bucket"]] += r["count"]
    n = np.array([sizes[x] for x in names], dtype=float)
    return Domains(names, np.log(n / n.sum()), np.log(table_ / table_.sum(1, keepdims=True)))


def with_posteriors(docs: DataFrame, domains: Domains) -> DataFrame:
    """docs with _tokens and _posterior."""
    rows = _once(docs, _buckets=_buckets(_words(text_of())))
    rows = _once(rows, _tokens=F.size("_buckets").cast("long"), _logs=domains.posterior(F.col("_buckets"))).drop("_buckets")
    return _once(rows, _posterior=F.col("_logs") if len(domains.names) == 1 else _softmax(F.col("_logs"))).drop("_logs")


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row: a generator of one element keeps the optimizer from writing them into what uses them."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def rate_of(steps: list[np.ndarray], posterior: str = "_posterior") -> Column:
    """max(0, .) folded over the steps taken, from 1, as one SQL expression over the column `posterior`."""
    rate = "1D"
    for step in steps:
        rate = f"greatest(0D, {rate} - ({' + '.join(f'{float(x)!r}D * {posterior}[{i}]' for i, x in enumerate(step))}))"
    return F.expr(rate)


class Solution(NamedTuple):
    """The steps that lead from rates of 1 to the solution, and how far its totals are from the targets at most, as a share of their sum. That is 0 but for rounding where
    nonnegative rates can meet the targets; else no further step brought them nearer (or ROUNDS were taken)."""

    steps: list[np.ndarray]
    residual: float


def solve(rows: DataFrame, k: int, weights: list[float] | None = None) -> Solution:
    """For rows of _tokens and _posterior."""
    p = [F.get("_posterior", F.lit(i)) for i in range(k)]
    sums = rows.agg(*(F.sum(F.col("_tokens") * p[i] * p[j]) for i in range(k) for j in range(i, k)), *(F.sum(F.col("_tokens") * x) for x in p)).first()
    if sums[0] is None or sum(sums[-k:]) == 0:
        return Solution([], 0.0)
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = sums[: -k or None]
    g = g + np.triu(g, 1).T
    natural = np.array(sums[-k:])
    want = np.array(weights, dtype=float) if weights is not None else (natural / natural.sum()) ** TEMPERATURE
    want = want / want.sum()
    target = want * (natural[want > 0] / want[want > 0]).max()
    inverse = np.linalg.pinv(g + np.eye(k) * 1e-12 * np.trace(g))
    lowest = (1 - inverse @ (natural - target)).min()  # the rate of a document wholly of the domain that needs least
    if weights is None and 0 < lowest < 1:
        target = target / lowest
    steps: list[np.ndarray] = []
    before = None
    while True:
        now = np.array(rows.select(rate_of(steps).alias("r"), "_tokens", "_posterior").agg(*(F.sum(F.col("r") * F.col("_tokens") * x) for x in p)).first()) if steps else natural
        if np.abs(now - target).max() <= 1e-9 * target.sum() or before is not None and np.abs(now - before).max() <= 1e-6 * target.sum() or len(steps) == ROUNDS:
            return Solution(steps, float(np.abs(now - target).max() / target.sum()))  # the targets are met, or as near as nonnegative rates come
        before = now
        steps.append(inverse @ (now - target))


def rates(docs: DataFrame, labelled: DataFrame, domain: str = "lang", weights: list[float] | None = None, kept: list[str] | None = None) -> tuple[Domains, Solution, DataFrame]:
    """The domains, the solution, and a written table of docs (of the columns `kept`, if given) with _tokens and _posterior."""
    domains = fit_domains(docs, labelled, domain)
    rows = with_posteriors(docs.drop("_tokens", "_posterior"), domains)
    rows = cut(rows.select(*kept, "_tokens", "_posterior") if kept else rows, "posteriors")
    return domains, solve(rows, len(domains.names), weights), rows


def copies_of(rate: Column) -> Column:
    """A whole number of copies whose mean is the rate: the fraction is settled by a hash of the document. A rate under 1, which given weights may ask for, can give none."""
    u = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.round(rate, 6) + u).cast("int")


def op3_source_mixing(spark: SparkSession, sf_dir: str, domain: str = "lang", weights: list[float] | None = None) -> DataFrame:
    """One row for each document. Domains are the values of a column (`lang`, which texts tell, or `source`), learned from the documents in `labels`."""
    docs = table(spark, sf_dir, "documents")
    domains, solution, rows = rates(docs.select("doc_id", "text", domain), table(spark, sf_dir, "labels"), domain, weights, ["doc_id"])
    named = F.map_from_arrays(F.array(*map(F.lit, domains.names)), F.col("_posterior"))
    best = F.get(F.array(*map(F.lit, domains.names)), (F.array_position("_posterior", F.array_max("_posterior")) - 1).cast("int"))
    out = rows.withColumn("rate", rate_of(solution.steps))
    return out.select("doc_id", F.col("_tokens").alias("tokens"), best.alias("domain"), F.map_entries(named).alias("posterior"), "rate", copies_of(F.col("rate")).alias("copies"), F.lit(solution.residual).alias("residual"))


def mixed(docs: DataFrame, labelled: DataFrame, domain: str = "lang") -> DataFrame:
    """docs repeated so that the domains' expected tokens meet the targets. Posteriors are found once and written beside the rows."""
    _, solution, rows = rates(docs, labelled, domain)
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), copies_of(rate_of(solution.steps)))).alias("_copy")).select(*docs.columns)
