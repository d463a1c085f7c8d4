"""Quality by hierarchical empirical Bayes: a document's own evidence, combined with what its host and path are like.

A logistic model over figures of a text's bytes, words and lines, fitted to a bounded sample of labelled rows (LABELLED), gives the evidence
p. Grouped sums of p and p squared by (host, path) and by host then give normal-normal posteriors: the mean of a host is
shrunk towards the global mean, and the mean of a path towards its host's posterior, by tau^2 / (tau^2 + sigma^2 / n) with
variances found from the groups themselves by moments. A site with few documents so stays near what stands above it. The document's posterior is

    logit(quality) = logit(p) + logit(path posterior) - logit(global mean)

where the posteriors are those of the document's site without the document itself, so that no evidence counts twice: a document alone on its path has its
host's, one alone on its host the global mean.

Defined cases: null text counts as empty; null hosts and paths are groups of their own; rows that repeat score alike; without labels all
evidence is 0.5; an empty table gives an empty result; other columns are kept by with_quality().
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, cut, remove, small_batches, table, text_of

LABELLED, SITES_BROADCAST, THRESHOLD = 8000, 100_000, 0.5
MARKS = b"#$%&*|!?.,:;-_=<>/\\\"'()[]{}@+~^"


def figures(text: str | None) -> list[float]:
    """Shares of kinds of bytes, and repetition of words and lines."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, len(raw))
    c = np.bincount(raw, minlength=256)
    upper, lower, digits, white = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[32] + c[9:14].sum()
    words, lines = (text or "").split(), (text or "").split("\n")
    return [
        *(np.sqrt(c[m] / n) for m in MARKS), upper / n, upper / (1 + upper + lower), lower / n, digits / n, white / n, c[10] / n, c[128:].sum() / n,
        np.log1p(len(words)), np.log1p(n / (1 + len(words))), len(set(words)) / (1 + len(words)), 1 - len(set(lines)) / len(lines), float(c[:9].sum() + c[14:32].sum() > 0),
    ]


def _figures(column: str):
    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(figures)

    return run(column)


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, decay), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean and deviation of the figures, weights); None without labels of both kinds."""
    small_batches(docs.sparkSession)
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = bounded_sample(labels, "doc_id", LABELLED)  # its size is bounded
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(labels), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = cut(rows.withColumn("_key", F.xxhash64("doc_id", "text")), "labelled")  # a doc_id may repeat with any number of texts, so they are bounded once more
    taken = bounded_sample(rows, "_key", LABELLED).select("quality", "_key", _figures("text").alias("x")).collect()
    remove(rows)
    rows = sorted(taken, key=lambda r: r._key)
    y = np.array([r.quality for r in rows], dtype=float)
    if len(set(y)) < 2:
        return None
    x = np.array([r.x for r in rows])
    mean, deviation = x.mean(0), x.std(0) + 1e-3
    return mean, deviation, fit_logistic((x - mean) / deviation, y)


def evidence(model, text: Column) -> Column:
    if model is None:
        return F.lit(0.5)
    mean, deviation, w = model

    @F.pandas_udf("double")
    def p(texts: pd.Series) -> pd.Series:
        x = np.array([figures(t) for t in texts]).reshape(len(texts), -1)
        return pd.Series(1 / (1 + np.exp(-np.clip(((x - mean) / deviation) @ w[:-1] + w[-1], -6, 6))))

    return p(text)


def _shrunk(above: Column, n: Column, total: Column, sigma2: float, tau2: float) -> Column:
    """Posterior mean of a group of n that sum up to total; that of what stands above it if n is 0."""
    b = F.lit(tau2) / (F.lit(tau2) + F.lit(sigma2) / n)
    return F.when(n > 0, above + b * (total / n - above)).otherwise(above)


def _variances(groups: DataFrame, above: Column, n: str, total: str, squares: str) -> tuple[float, float]:
    """Variance within the groups and between their means, by moments; one row of sums reaches the driver."""
    mean = F.col(total) / F.col(n)
    k, N, within, between, n2 = groups.agg(F.count(F.lit(1)), F.sum(n), F.sum(F.col(squares) - F.col(total) * mean), F.sum(F.col(n) * (mean - above) ** 2), F.sum(F.col(n) ** 2)).first()
    sigma2 = max(within / max(N - k, 1), 1e-6)
    return sigma2, max((between - (k - 1) * sigma2) / max(N - n2 / N, 1), 1e-6)


class Spread(NamedTuple):
    """The global mean, and variances (within, between) of hosts and of paths."""

    mean: float
    hosts: tuple[float, float]
    paths: tuple[float, float]


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, Spread]:
    """From (host, path, p): (host, path, n, s, hn, hs, host_posterior, path_posterior), one row for each site with its counts and sums and its host's, and their spread."""
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("ss")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"))
    n, s = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    mean = s / n if n else 0.5
    of_hosts = _variances(hosts, F.lit(mean), "hn", "hs", "hss") if n else (1e-6, 1e-6)
    hosts = hosts.withColumn("host_posterior", _shrunk(F.lit(mean), F.col("hn"), F.col("hs"), *of_hosts))
    right = hosts.select(F.col("host").alias("host_"), "host_posterior", "hn", "hs")
    both = paths.join(right, paths["host"].eqNullSafe(right["host_"])).drop("host_")
    of_paths = _variances(both, F.col("hs") / F.col("hn"), "n", "s", "ss") if n else (1e-6, 1e-6)
    both = both.withColumn("path_posterior", _shrunk(F.col("host_posterior"), F.col("n"), F.col("s"), *of_paths))
    return both.select("host", "path", "n", "s", "hn", "hs", "host_posterior", "path_posterior"), Spread(mean, of_hosts, of_paths)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(0.02)), F.lit(0.98))
    return F.log(p / (1 - p))


def combine(scored: DataFrame, sites: DataFrame, spread: Spread) -> DataFrame:
    """scored (with _host, _path, _p) with host_posterior and path_posterior of its site without the row itself, and quality. Few sites are sent to all tasks; many
    are joined by a shuffle, where Spark splits a hot site."""
    own = ["_site_host", "_site_path", "_site_n", "_site_s", "_host_n", "_host_s"]
    sites = sites.select(*(F.col(c).alias(name) for c, name in zip(("host", "path", "n", "s", "hn", "hs"), own, strict=True)))
    sites = F.broadcast(sites) if sites.count() <= SITES_BROADCAST else sites
    joined = scored.drop("host_posterior", "path_posterior", "quality").join(sites, scored["_host"].eqNullSafe(sites["_site_host"]) & scored["_path"].eqNullSafe(sites["_site_path"]))
    p, mean = F.col("_p"), F.lit(spread.mean)
    joined = joined.withColumn("host_posterior", _shrunk(mean, F.col("_host_n") - 1, F.col("_host_s") - p, *spread.hosts))
    joined = joined.withColumn("path_posterior", _shrunk(F.col("host_posterior"), F.col("_site_n") - 1, F.col("_site_s") - p, *spread.paths))
    f = _logit(p) + _logit(F.col("path_posterior")) - _logit(mean)
    return joined.drop(*own).withColumn("quality", 1 / (1 + F.exp(-f)))


def with_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """docs with _host, _path, _p (the evidence), host_posterior, path_posterior and quality; columns of docs that bear these names are replaced. The evidence is found
    once and written beside the rows."""
    model = fit(docs, labels)
    scored = cut(docs.withColumns({"_host": F.col(host), "_path": F.concat_ws("/", host, path), "_p": evidence(model, text_of())}), "evidence")
    sites, spread = site_posteriors(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("p")))
    return combine(scored, sites, spread)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host is a document's source, path its part in a language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.col("source").alias("_host"), F.concat_ws("/", "source", "lang").alias("_path"), evidence(model, text_of()).alias("_p"))
    scored = cut(scored, "evidence")
    sites, spread = site_posteriors(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("p")))
    out = combine(scored, sites, spread)
    return out.select("doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= THRESHOLD).alias("keep"))


def remove_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose posterior quality is under THRESHOLD. Columns of docs named as those of with_quality() keep their own values."""
    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("text"), F.col("doc_id"))
    model = fit(docs, labels)
    scored = cut(own.withColumns({"_host": F.col("_s"), "_path": F.concat_ws("/", "_s", "_l"), "_p": evidence(model, text_of())}).drop("_s", "_l", "text", "doc_id"), "evidence")
    sites, spread = site_posteriors(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("p")))
    kept = combine(scored, sites, spread).where(F.col("quality") >= THRESHOLD)
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
