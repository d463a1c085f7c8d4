"""Stored indexes and joins by pivots against plain versions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from memlake.operators import knn, prefix, retrieve, text_index, vector_index
from memlake.sources import scratch


def _brute(data, k, least):
    ids = sorted(data)
    x = knn.units(np.array([data[i] for i in ids], dtype=float))
    s = np.round(x @ x.T, 6)
    out = set()
    for a, i in enumerate(ids):
        near = sorted(((-s[a, b], j) for b, j in enumerate(ids) if j != i and s[a, b] >= least))[:k]
        out |= {(i, j, round(-v, 6), n + 1) for n, (v, j) in enumerate(near)}
    return out


def _frame(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in data.items()], "id long, vector array<double>")


def _clustered(n, dim=16, clusters=40, seed=3):
    r = np.random.RandomState(seed)
    centres = r.normal(size=(clusters, dim))
    return {i: centres[i % clusters] + 0.05 * r.normal(size=dim) for i in range(n)}


def test_pivot_join_is_exact(spark):
    r = np.random.RandomState(1)
    loose = {i: r.normal(size=6) for i in range(150)}
    odd = _clustered(120) | {200 + i: np.ones(16) for i in range(30)} | {300: np.zeros(16), 301: np.zeros(16), 302: 2 * np.ones(16)}
    for data, k, least, pivots, block in ((loose, 3, 0.2, 12, 7), (loose, 2, -1.0, 150, 4096), (odd, 4, 0.0, 20, 16), (odd, 5, 0.5, 1, 4096)):
        got = {(x.source_id, x.target_id, x.score, x["rank"]) for x in knn.pivot_topk(_frame(spark, data), k, least, pivots, block).collect()}
        assert got == _brute(data, k, least)
    none = _frame(spark, {0: np.zeros(2)}).limit(0)
    assert knn.pivot_topk(none, 2, 0.0).collect() == []
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.1])], "id long, vector array<double>")
    assert {(x.source_id, x.target_id) for x in knn.pivot_topk(mixed, 2, 0.5).collect()} == {(1, 2), (2, 1), (3, 5), (5, 3)}


def test_pivot_join_sends_rows_to_few_cells(spark):
    """Copies per row stay flat as rows grow, where vectors lie in groups."""
    copies = []
    for n in (400, 1600):
        report: list = []
        data = _clustered(n)
        got = {(x.source_id, x.target_id, x.score, x["rank"]) for x in knn.pivot_topk(_frame(spark, data), 3, 0.3, 100, 64, report).collect()}
        assert got == _brute(data, 3, 0.3)
        copies += report
    assert copies[1] < 1.5 * copies[0] < 6  # of 7 bins and of 25


def test_pivots_meet_few_rows_at_a_time(spark):
    """A batch of any size is compared with the pivots TILE rows at a time, whatever Arrow's batches are."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000))})
    parts = list(knn.tiles(iter([batch, batch.slice(0, 0), batch.slice(990)])))
    assert max(map(len, parts)) == knn.TILE and [i for p in parts for i in p.column("id").to_pylist()] == [*range(1000), *range(990, 1000)]
    data = _clustered(700)
    got = {(x.source_id, x.target_id, x.score, x["rank"]) for x in knn.pivot_topk(_frame(spark, data).coalesce(1), 3, 0.3, 100).collect()}
    assert got == _brute(data, 3, 0.3)


def test_whole_numbers_meet_six_at_a_time():
    """Rows of counts, beside rows that are none, zero rows and ties, have the same best columns as by plain products; no product of all of them is made."""
    r = np.random.RandomState(5)
    counts = [r.poisson(0.12, (n, 64)) * r.choice([-1.0, 1.0], (n, 64)) for n in (300, 14000)]
    counts[1][100:140] = counts[1][:40]
    counts[1][50], counts[0][7], counts[0][8] = 0, 0, r.normal(size=64)
    counts[1][::97] = r.normal(size=(145, 64))
    x, data = (knn.units(c).astype(np.float32).astype(np.float64) for c in counts)
    x, data = knn.units(x), knn.units(data)
    rows, which = knn.whole(x)
    assert which.sum() == 299 and (rows[which] == counts[0][which] / np.gcd.reduce(np.abs(counts[0][which]).astype(int), axis=1).clip(1)[:, None]).all()
    for k, least in ((1, 0.0), (1, -1.0), (5, 0.3), (3, -1.0)):
        got, want = knn.Held(data).best(x, k, np.full(300, least)), knn.best(x, data.T, k, np.full(300, least))
        assert all((a == b).all() for a, b in zip(got, want, strict=True)), (k, least)
    seen, plain = [], knn.best
    knn.best = lambda x, data, *a: seen.append(len(x) * data.shape[1]) or plain(x, data, *a)
    try:
        knn.Held(data).best(x, 1, np.zeros(300))
    finally:
        knn.best = plain
    assert sum(seen) < 0.05 * 300 * 14000


def test_equal_vectors_are_dealt_once(spark):
    rows = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [1.0, 2.0]), ("c", [1.0, 2.0]), ("d", [2.0, 1.0]), ("e", None)], "id string, vector array<float>")
    assert sorted(r.id for r in knn.first_of_equal(rows, 1).collect()) == ["a", "d"] and sorted(r.id for r in knn.first_of_equal(rows, 2).collect()) == ["a", "b", "d"]


def _texts(spark, n=300):
    rows = [(f"d{i:03}", " ".join(f"w{(i * j) % 37}" for j in range(1, 3 + i % 40)) + (" rare" if i % 29 == 0 else "") + " the" * (i % 5), "the w1" if i % 2 else None) for i in range(n)]
    return spark.createDataFrame([*rows, ("e1", None, None), ("e2", "", "")], "id string, content string, l0_abstract string")


def test_text_index_gives_the_same_as_a_scan(spark, tmp_path):
    docs = _texts(spark)
    index = text_index.TextIndex(spark, f"{tmp_path}/i", buckets=8)
    assert index.search("the", 5).collect() == []
    index.add(docs.where("id < 'd200'"))
    same = lambda rows, q, k: [tuple(r) for r in index.search(q, k).collect()] == [tuple(r) for r in retrieve.bm25_topk(rows, q, k).collect()]
    assert same(docs.where("id < 'd200'"), "the rare w3", 10)
    index.add(docs.where("id >= 'd200'"))
    for q in ("the rare w3", "W1", "nothing here", "rare", "w1 w2 w3 w4 w5 the"):
        assert same(docs, q, 7), q
    index.remove(docs.where("id like 'd1%'").select("id"))
    assert not index.search("the rare", 20).where("id like 'd1%'").count()
    index.merge()
    assert same(docs.where("id not like 'd1%'"), "the rare w3", 12)
    index.add(docs.where("id = 'd100'"))
    assert same(docs.where("id not like 'd1%' or id = 'd100'"), "w5 rare", 12)


def test_text_index_loses_many_without_dealing_postings(spark, tmp_path, monkeypatch):
    """Merges that lose more than FEW documents, also of shards that were merged before, give what a scan gives; no posting is dealt by itself."""
    monkeypatch.setattr(text_index, "FEW", 3)
    docs, index = _texts(spark), text_index.TextIndex(spark, f"{tmp_path}/i", buckets=8)
    index.add(docs.where("id < 'd200'").repartition(3))
    index.add(docs.where("id >= 'd200'"))
    plans, placed = [], index._placed
    monkeypatch.setattr(index, "_placed", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or placed(rows, *a))
    for gone in ("id like 'd1%'", "id like 'd1%' or id like '%7'"):
        index.remove(docs.where(gone).select("id"))
        index.merge()
        for q in ("the rare w3", "w5 w7"):
            assert [tuple(r) for r in index.search(q, 12).collect()] == [tuple(r) for r in retrieve.bm25_topk(docs.where(f"not ({gone})"), q, 12).collect()]
    assert len(plans) == 2 and not any("explode(posts#" in p for p in plans)


def test_text_index_merges_by_slices(spark, tmp_path, monkeypatch):
    """Of many slices, each finds what the one before exchanged deleted; the merged index gives what a scan gives."""
    monkeypatch.setattr(text_index, "SLICE", 1)
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    docs, index = _texts(spark), text_index.TextIndex(spark, f"{tmp_path}/i", buckets=8)
    index.add(docs.where("id < 'd200'").repartition(3))
    index.add(docs.where("id >= 'd200'"))
    seen, placed = [], index._placed
    monkeypatch.setattr(index, "_placed", lambda rows: seen.append(files()) or placed(rows))
    for few, gone in ((5000, "id like 'd1%'"), (3, "id like 'd1%' or id like '%7'")):
        monkeypatch.setattr(text_index, "FEW", few)
        index.remove(docs.where(gone).select("id"))
        seen.clear()
        index.merge()
        assert len(seen) == 8 and max(seen) == seen[0]
        for q in ("the rare w3", "w5 w7"):
            assert [tuple(r) for r in index.search(q, 12).collect()] == [tuple(r) for r in retrieve.bm25_topk(docs.where(f"not ({gone})"), q, 12).collect()]


def test_text_index_reads_what_can_matter(spark, tmp_path):
    index = text_index.TextIndex(spark, f"{tmp_path}/i", buckets=8)
    index.add(_texts(spark, 3000).coalesce(2))
    levels, least, n, blocks = index.plan(["the", "rare"], 5)
    assert n == 3002 and least > 0 and levels.where("read").count() < levels.count() < blocks
    scan = index._asked(["rare"])
    assert {r.term for r in scan.select("term").distinct().collect()} == {"rare"}
    assert "PartitionFilters: [isnotnull(bucket" in scan._jdf.queryExecution().executedPlan().toString() and "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in scan._jdf.queryExecution().executedPlan().toString()


def test_documents_are_inverted_some_at_a_time(monkeypatch):
    monkeypatch.setattr(text_index, "SHARD", 50)
    batch = pa.RecordBatch.from_pydict({"id": [f"d{i}" for i in range(1000)], "w0": ["a b a" if i % 2 else "" for i in range(1000)]})
    rows = [r for out in text_index.inverted(iter([batch, batch.slice(0, 10)]), 1) for r in out.to_pylist()]
    assert max(r["n"] for r in rows) <= 256 and all(r["n"] == len(r["posts"]) and r["total"] == sum(p["len"] for p in r["posts"]) for r in rows)
    assert sum(r["n"] for r in rows if r["term"] == "") == 1010 and sum(p["tf"] for r in rows if r["term"] == "a" for p in r["posts"]) == 2 * 505
    assert {(r["min_tf"], r["max_tf"], r["min_len"], r["max_len"]) for r in rows if r["term"] == "b"} == {(1, 1, 3, 3)}


def test_vector_index_recall(spark, tmp_path):
    """Recall at 10 of 0.9 or more at two sizes, with the share of rows that a query reads."""
    for n, probes, most in ((1500, 8, 0.6), (4500, 8, 0.4)):
        r = np.random.RandomState(n)
        centres = r.normal(size=(60, 24))
        x = np.array([centres[i % 60] + 0.6 * r.normal(size=24) for i in range(n)])
        rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>").unionByName(spark.createDataFrame([("null", None), ("zero", [0.0] * 24)], "id string, vector array<double>"))
        index = vector_index.VectorIndex(spark, f"{tmp_path}/{n}")
        index.build(rows.where(f"try_cast(id as int) < {n - 300} or id in ('null', 'zero')"))
        index.append(rows.where(f"try_cast(id as int) >= {n - 300}"))
        report: list = []
        queries = rows.where("try_cast(id as int) % 50 = 0").select(F.col("id").alias("key"), "vector")
        found = index.search(queries, 10, probes, report=report).collect()
        u = knn.units(x)
        hits = total = 0
        for q in range(0, n, 50):
            want = {str(i) for i in np.argsort(-(u @ u[q]))[:10]}
            got = [(y["rank"], y.id, y.score) for y in found if y.key == str(q)]
            assert len(got) == 10 and all(abs(s - u[int(i)] @ u[q]) < 1e-6 for _, i, s in got)
            hits, total = hits + len(want & {i for _, i, _ in got}), total + 10
        assert hits >= 0.9 * total and report[0] < most, (hits / total, report)


def test_running_totals_of_a_group_that_holds_most_rows(spark):
    rows = [("hot", i, i % 13) for i in range(3000)] + [(f"g{i % 50}", i, i) for i in range(500)] + [(None, i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, at long, v long").repartition(6)
    cut = prefix.ranged(df, ["g"], [F.col("at")], ["g", "at", "v"], scratch.held, 16)
    assert cut.where("g = 'hot'").select("_range").distinct().count() > 8  # many tasks for one group
    got = {(r.g, r.at): (r.total, r.mixed) for r in prefix.running(cut, ["g"], ["_row"], {"total": ("sum", F.col("v")), "mixed": ("xor", F.col("v"))}).collect()}
    held: dict = {}
    for g, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        total, mixed = held.get(g, (0, 0))
        held[g] = total + (v or 0), mixed ^ (v or 0)
        assert got[g, at] == held[g]
    assert len(got) == len(rows)
