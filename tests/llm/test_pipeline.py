"""The pipeline stage by stage against plain versions, on the smallest tables."""

import collections

import corpus_pipeline
import numpy as np
from brute import brute_links

from memlake.llm import mixing, packing, quality, toxicity
from memlake.llm.shared import cut

SF = "/root/testdata/sf0.001"


def counted(rows):
    return collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)


def plain_quality(docs, labels):
    """Evidence and posteriors with numpy alone."""
    known = {r.doc_id: r.quality for r in labels}
    x = np.array([quality.figures(r.text) for r in docs])
    fit = [i for i, r in enumerate(docs) if r.doc_id in known]
    mean, deviation = x[fit].mean(0), x[fit].std(0) + 1e-3
    w = quality.fit_logistic((x[fit] - mean) / deviation, np.array([known[docs[i].doc_id] for i in fit], dtype=float))
    p = 1 / (1 + np.exp(-np.clip(((x - mean) / deviation) @ w[:-1] + w[-1], -6, 6)))

    def variances(groups, above):
        n = np.array([len(g) for g in groups])
        means = np.array([g.mean() for g in groups])
        sigma2 = max(sum(((g - m) ** 2).sum() for g, m in zip(groups, means, strict=True)) / max(n.sum() - len(n), 1), 1e-6)
        return sigma2, max(((n * (means - above) ** 2).sum() - (len(n) - 1) * sigma2) / max(n.sum() - (n**2).sum() / n.sum(), 1), 1e-6)

    def shrunk(others, above, sigma2, tau2):
        return above + tau2 / (tau2 + sigma2 / len(others)) * (others.mean() - above) if len(others) else above

    hosts = sorted({r.source for r in docs})
    of_host = {h: [i for i, r in enumerate(docs) if r.source == h] for h in hosts}
    paths = sorted({(r.source, r.lang) for r in docs})
    of_path = {q: [i for i, r in enumerate(docs) if (r.source, r.lang) == q] for q in paths}
    host_spread = variances([p[of_host[h]] for h in hosts], p.mean())
    path_spread = variances([p[of_path[q]] for q in paths], np.array([p[of_host[h]].mean() for h, _ in paths]))
    without = lambda members, i: p[[j for j in members if j != i]]
    host = [shrunk(without(of_host[r.source], i), p.mean(), *host_spread) for i, r in enumerate(docs)]
    path = [shrunk(without(of_path[(r.source, r.lang)], i), host[i], *path_spread) for i, r in enumerate(docs)]
    logit = lambda v: np.log(np.clip(v, 0.02, 0.98) / (1 - np.clip(v, 0.02, 0.98)))
    f = logit(p) + logit(np.array(path)) - logit(p.mean())
    return 1 / (1 + np.exp(-f))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    made = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        made[name] = cut(stage(spark, at, SF), name)
        if name != "packing":
            assert made[name].columns == docs.columns
        at = made[name]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "source_mixing", "packing"]

    rows = docs.collect()
    good = plain_quality(rows, labels.collect())
    assert counted(made["quality_classifier"].collect()) == counted([r for r, g in zip(rows, good, strict=True) if g >= quality.THRESHOLD])
    rows = made["quality_classifier"].collect()
    weights, bias = toxicity.fit(made["quality_classifier"], labels)
    read = toxicity.reader({w: w for w in weights})
    f = [bias + sum(weights[w] * v for w, v in read(r.text).items()) for r in rows]
    assert counted(made["toxicity"].collect()) == counted([r for r, x in zip(rows, f, strict=True) if 1 / (1 + np.exp(-x)) < toxicity.THRESHOLD])
    rows = made["toxicity"].collect()
    classes = brute_links([(r.doc_id, r.text) for r in rows])
    assert counted(made["ngram_jaccard_join"].collect()) == counted([r for r in rows if classes[r.doc_id][0] == r.doc_id])

    domains, solution, table = mixing.rates(made["ngram_jaccard_join"], labels)
    copies = {r.doc_id: r.n for r in table.select("doc_id", mixing.copies_of(mixing.rate_of(solution.steps)).alias("n")).collect()}
    got = collections.Counter(r.doc_id for r in made["source_mixing"].collect())
    assert got == copies and min(copies.values()) >= 1
    import public_tokenizers

    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(encode(r.text)) + 1 for r in made["source_mixing"].collect())
    assert sum(r.length for r in made["packing"].collect()) == want
    key = lambda rows: collections.Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(made["packing"].collect())


def test_run_on_odd_tables(spark, tmp_path):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (4, "same text here now ok", "en", None, 1), (4, "same text here now ok", "en", None, 1), (4, "an other text under this id", "en", None, 1), (5, "same text here now ok", None, "s", 1), (None, "no id", "en", "s", 5)]
    made = spark.createDataFrame([(*r, "clash", 1.0, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _p string, quality double, n int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", made), ("empty", made.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        none.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = docs
        for stage, apply in corpus_pipeline.STAGES[:-1]:
            at = cut(apply(spark, at, f"{tmp_path}/{name}"), stage)
            assert at.columns == docs.columns
        kept = [(r.doc_id, r.text) for r in at.collect()]
        assert sorted(map(str, kept)) == (sorted(map(str, {(1, None), (2, ""), (3, long), (4, "same text here now ok"), (4, "an other text under this id"), (None, "no id")})) if name == "odd" else [])
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").where("start = 0").count() == len(kept)
