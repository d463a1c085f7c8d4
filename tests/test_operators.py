import hashlib
import hmac
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake import schema
from memlake.functions import scoring, seams, text
from memlake.operators import chunk, ingest, knn, lifecycle, profile, reconcile, retrieve, scan, sharing, stats
from memlake.plans import registry
from memlake.sources import store, tables, views, webhook
from memlake.streaming import flows

SF = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-04-03").cast("timestamp")


def test_fusion_and_normalisation(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, score double")
    t = spark.createDataFrame([("a", 3.0), ("c", 1.0)], "id string, score double")
    fused = {r.id: r.score for r in retrieve.fuse(v, t).collect()}
    assert fused == {"a": pytest.approx(1 / 61), "b": pytest.approx(0.7 / 62), "c": pytest.approx(0.3 / 62)}
    norm = lambda rows: [r.score for r in retrieve.normalise(spark.createDataFrame(rows, "id string, score double")).orderBy("id").collect()]
    assert norm([("a", 0.1), ("b", 0.3), ("c", 0.2)]) == [0, 1, pytest.approx(0.5)]
    assert norm([("a", 0.01)]) == [0.4] and norm([("a", 0.9)]) == [1.0] and norm([("a", 0.2), ("b", 0.2)]) == [1, 1]


def test_diversity_like_a_sequential_loop(spark):
    rows = [(f"m{i}", f"the quick brown fox jumps over a lazy dog near river bank number today and {'dog' if i % 3 else 'cat'} {'x' if i % 5 == 0 else ''}", 1 - i / 50) for i in range(30)]
    out = {r.id: r.score for r in retrieve.diversify(spark.createDataFrame(rows, "id string, content string, score double")).collect()}
    sets = [set(c.split()) for _, c, _ in rows]
    for i, (id_, _, s) in enumerate(rows):
        near = any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.85 for j in range(i))
        assert out[id_] == pytest.approx(s * (0.5 if near else 1))


def test_vector_search_orders_by_cosine(spark):
    e = lambda *xs: [float(x) for x in xs]
    m = spark.createDataFrame([("a", "active", e(1, 0)), ("b", "active", e(0.9, 0.1)), ("c", "active", e(0, 1)), ("d", "deleted", e(1, 0)), ("n", "active", None)], "id string, state string, vector array<double>")
    q = spark.createDataFrame([(e(1, 0),)], "qv array<double>")
    assert [r.id for r in retrieve.vector_topk(m, q, 10, 0.3).orderBy(F.desc("score")).collect()] == ["a", "b"]


def test_budget_like_a_sequential_loop(spark):
    rows = views.sessions(spark, SF).select("conv_id", "turn", "content")
    kept = {(r.conv_id, r.turn) for r in ingest.budget(rows, "conv_id", "turn", 3, 1500).collect()}
    want = set()
    by = {}
    for r in rows.collect():
        by.setdefault(r.conv_id, []).append((r.turn, len(r.content.encode())))
    for conv, turns in by.items():
        spent = 0
        for i, (turn, n) in enumerate(sorted(turns, reverse=True)[:3]):
            if i and spent + n > 1500:
                break
            spent += n
            want.add((conv, turn))
    assert kept == want


def test_candidates_of_more_facts_than_a_request_has(spark):
    r = np.random.RandomState(1)
    f, m = r.normal(size=(120, 6)), r.normal(size=(90, 6))
    facts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "fact_id long, vector array<double>")
    memories = spark.createDataFrame([(f"m{i}", "active", v.tolist()) for i, v in enumerate(m)], "id string, state string, vector array<double>").withColumn("updated_at", F.lit(0))
    cosine = (f @ m.T) / np.linalg.norm(f, axis=1)[:, None] / np.linalg.norm(m, axis=1)
    want = {(i, f"m{j}", n + 1) for i in range(120) for n, j in enumerate(sorted((j for j in range(90) if round(cosine[i, j], 6) >= 0.3), key=lambda j: (-round(cosine[i, j], 6), f"m{j}"))[:5])}
    for block in (4096, 32):
        assert {(x.fact_id, x.id, x["rank"]) for x in ingest.candidates(facts, memories, block=block).collect()} == want
    plan = ingest.candidates(facts, memories)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_nearest_rows_with_ties_odd_vectors_and_self(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0])]
    a = spark.createDataFrame(rows, "a long, vector array<double>")
    b = a.withColumnRenamed("a", "b")
    for block in (4096, 2):
        got = sorted((r.a, r.b, r.score) for r in knn.topk(a, b, 2, 0.5, block).collect())
        assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1), (4, 4, 1), (7, 7, 1)]
        assert sorted((r.a, r.b) for r in knn.topk(a, b, 2, 0.5, block, apart=True).collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert knn.topk(a.limit(0), b, 2, 0.5).count() == 0


def test_every_fact_has_a_decision(spark, tmp_path):
    rows = [(i, f"fact {i} of the user") for i in range(60)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(60).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry._facts(spark, str(tmp_path)).count() == 60


def test_text_leg_like_one_search_for_each_fact(spark):
    m = scan.live(views.memories(spark, SF))
    queries = [(i, " ".join(r.content.split()[3 * i : 3 * i + 9])) for i, r in enumerate(m.orderBy("id").limit(8).collect())] + [(98, "zzzz qqqq"), (99, "")]
    want = {(i, r.id, r.score) for i, q in queries for r in retrieve.bm25_topk(m, spark.range(1).select(retrieve.tokens(F.lit(q))).first()[0], 5).collect()}
    frame = spark.createDataFrame(queries, "fact_id long, query string")
    for block in (4096, 50):
        got = retrieve.bm25_topk_each(m, frame, 5, "fact_id", block).collect()
        assert {(r.fact_id, r.id) for r in got} == {w[:2] for w in want} and sorted((r.fact_id, r.id, r.score) for r in got) == [(*w[:2], pytest.approx(w[2], abs=2e-6)) for w in sorted(want)]


def test_text_leg_of_odd_tables(spark):
    schema = "id string, content string, l0_abstract string"
    rows = spark.createDataFrame([("b", "red fish", None), ("a", "red fish", None), ("c", None, None), ("d", "", "fish"), ("a", "blue", "")], schema)
    queries = spark.createDataFrame([(1, "Fish!"), (2, "fish, fish BLUE"), (3, None), (4, "none")], "fact_id int, query string")
    got = retrieve.bm25_topk_each(rows, queries, 2, "fact_id", 2).orderBy("fact_id", "rank").collect()
    one = lambda q: [(r.id, r.score) for r in retrieve.bm25_topk(rows, q, 2).orderBy(F.desc("score"), "id").collect()]
    assert [(r.id, pytest.approx(r.score, abs=2e-6)) for r in got if r.fact_id == 1] == one("fish")
    assert [(r.id, pytest.approx(r.score, abs=2e-6)) for r in got if r.fact_id == 2] == one("fish blue")
    assert {r.fact_id for r in got} == {1, 2}
    assert retrieve.bm25_topk_each(rows.limit(0), queries, 2, "fact_id").count() == 0
    assert retrieve.bm25_topk_each(rows, queries.limit(0), 2, "fact_id").count() == 0


def test_gather_takes_both_legs_by_first_appearance(spark):
    leg = lambda rows: spark.createDataFrame(rows, "request int, fact_id long, id string, rank int")
    v = leg([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1), (2, 3, "a", 1)])
    t = leg([(1, 1, "d", 1), (1, 1, "a", 2), (1, 2, "b", 1), (1, 2, "e", 2), (2, 3, "f", 1)])
    order = lambda rows: [r.id for r in rows.orderBy("ordinal").collect()]
    assert order(ingest.gather(v.where("request = 1"), t.where("request = 1"))) == ["a", "b", "d", "c", "e"]
    assert order(ingest.gather(v.where("request = 1"), t.where("request = 1"), 3)) == ["a", "b", "d"]
    out = ingest.gather(v, t, by=["request"])
    assert order(out.where("request = 1")) == ["a", "b", "d", "c", "e"] and order(out.where("request = 2")) == ["a", "f"]


def test_sections_and_chunks(spark):
    texts = ["# A\nx\n## B\ny\n", "plain", "", "\n# only\n\n## two\nz", "a\n\n# b\n# c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = {}
    for r in chunk.sections(docs, "i", "t").orderBy("i", "part").collect():
        out.setdefault(r.i, []).append(r.section)
    for i, t in enumerate(texts):
        want, now = [], ""
        for line in t.removesuffix("\n").split("\n") if t else []:
            if line.startswith(("# ", "## ")) and now.strip():
                want.append(now)
                now = ""
            now += line + "\n"
        want += [now] if now.strip() else []
        assert out[i] == (want or [t]), i
    long = "intro\n\n" + "word " * 300 + "\n## h\n" + "more " * 500
    parts = list(chunk.smart_chunks(long, 1000, 100))
    end = 0
    for p in parts:  # each starts where the one before ends, or up to the overlap before that
        assert 0 < len(p) <= 1000
        end = len(p) + next(s for s in range(max(0, end - 100), end + 1) if long.startswith(p, s))
    assert end == len(long) and any(p.startswith("## h") for p in parts)
    rows = chunk.chunked(spark.createDataFrame([(1, long), (2, "s")], "i int, t string"), "i", "t", 1000, 100).collect()
    assert sorted((r.i, r.part, r.chunk) for r in rows) == sorted([(1, n, p) for n, p in enumerate(parts)] + [(2, 0, "s")])
    assert list(chunk.code_blocks("a\nb\n\n\nc")) == [("a\nb", 1, 2), ("c", 5, 5)]
    assert [c[1:] for c in chunk.python_chunks("import x\n\ndef f():\n    return 1\n\nclass A:\n    pass\n")] == [(3, 4), (6, 7)]
    assert [c[0] for c in chunk.python_chunks("def broken(:\n\nx = 1")] == ["def broken(:", "x = 1"]


def test_reconcile_rules(spark):
    m = views.memories(spark, SF)
    facts = spark.createDataFrame([(i, f"fact {i}", "nonsense") for i in range(8)], "fact_id long, l0 string, category string")
    acts = ["create", "merge", "skip", "supersede", "support", "contextualize", "contradict", "???"]
    dec = spark.createDataFrame([(f"d{i}", a, i, "m3", "merged") for i, a in enumerate(acts)] + [("d9", "merge", 0, "m10", "x"), ("d8", "support", 1, "gone", "")], "decision_id string, action string, fact_id long, match_id string, merged_content string")
    resolved = reconcile.resolve(dec, facts, m)
    assert {r.decision_id: r.applied for r in resolved.collect()} == {"d0": "create", "d1": "merge", "d2": "skip", "d3": "supersede", "d4": "support", "d5": "contextualize", "d6": "contradict", "d7": "create", "d8": "create", "d9": "create"}
    before, after = m.count(), reconcile.apply(m, resolved, now())
    rows = {r.id: r for r in after.collect()}
    assert len(rows) == before + 7 and rows["m3"].content == "merged" and rows["m3"].superseded_by == "nd3" and rows["m3"].state == "active"
    assert rows["nd0"].category == "profile" and rows["nd5"].version == 2


def test_sharing(spark):
    m = views.memories(spark, SF)
    live = scan.live(m)
    made = sharing.copies(live.where("space_id = 'org/x'"), F.lit("team/b"), now(), F.lit("u1"), F.lit("")).drop("provenance", "invalidated_at", "updated_at")
    again = sharing.not_yet_shared(live.unionByName(made), "team/b").where("space_id = 'org/x'")
    assert again.count() == 0
    assert {r.id for r in sharing.bridge_space(views.spaces(spark), "u1", "u2").collect()} == {"team/a"}
    assert sharing.bridge_space(views.spaces(spark), "u1", "u9").count() == 0


def test_every_rule_is_met(spark, monkeypatch):
    rules = [(f"r{i}", i, f"s{i % 7}", f"t{i}", [], [], 0.0, i % 5 == 0) for i in range(1500)]
    rules = spark.createDataFrame(rules, "rule_id string, pos int, source_space string, to_space string, categories array<string>, tags array<string>, min_importance double, require_approval boolean")
    m = spark.createDataFrame([(f"m{i}", f"s{i}", "events", ["en"], 0.5) for i in range(7)], "id string, space_id string, category string, tags array<string>, importance double")
    want = sorted((f"m{i % 7}", f"t{i}", f"r{i}") for i in range(1500) if i % 5)
    for most in (10_000, 10):
        monkeypatch.setattr(sharing, "BROADCAST_RULES", most)
        assert sorted(tuple(r) for r in sharing.matched_rules(m, rules).collect()) == want


def test_context_ends_by_tokens_alone(spark):
    rows = spark.createDataFrame([(f"m{i:03}", "events", 1 - i / 1000, "ab" if i % 2 else "abcdef", "") for i in range(700)], "id string, category string, importance double, content string, l0_abstract string")
    for tokens in (0, 1, 3, 450, 2000):
        want, spent = [], 0
        for i in range(700):
            spent += 1 if i % 2 else 2
            want += [(f"m{i:03}", spent)] if spent <= tokens else []
        assert sorted((r.id, r.spent) for r in profile.context_lines(rows, tokens).collect()) == want


def test_store_versions_and_evolution(spark, tmp_path):
    t = store.Table(spark, f"{tmp_path}/m", schema.SESSION, None)
    assert t.read().count() == 0
    row = spark.createDataFrame([("1", "s", "user", "hi")], "id string, session_id string, role string, content string")
    t.append(row)
    t.append(row.withColumn("id", F.lit("2")))
    assert t.read().columns == [f.name for f in schema.SESSION.fields] and t.read().count() == 2
    t.replace(t.read().where("id = '2'"))
    assert [r.id for r in t.read().collect()] == ["2"] and t.read().first().tags is None
    assert store.uri({}) == "./memlake-data" and store.uri({"s3_bucket": "b"}) == "s3a://b" and store.uri({"oss_bucket": "o", "s3_bucket": "b"}) == "oss://o"
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.py").write_bytes(b"x = 1")
    kinds = {r.kind for r in store.files(spark, f"{tmp_path}/*.*").collect()}
    assert kinds == {"text", "code"}
    first = store.imports(spark, f"{tmp_path}/a.md", spark.createDataFrame([], "content_hash string"))
    assert first.count() == 1 and store.imports(spark, f"{tmp_path}/a.md", first.select("content_hash")).count() == 0


def test_webhooks(spark):
    rows = [("issues", '{"repository":{"full_name":"r"},"issue":{"number":3,"title":"t","body":"b"}}'), ("pull_request_review", '{"review":{"body":""}}'), ("ping", "{}"), ("push", '{"commits":[{"id":"0123456789","message":"m","added":["a.rs"],"removed":["b.py"]}]}')]
    df = spark.createDataFrame(rows, "event string, payload string")
    assert [(r.content, r.tags) for r in webhook.discussions(df).collect()] == [("Issue #3: t\nBy: unknown\n\nb", ["repo:r", "github:issue", "issue:3"])]
    both = spark.createDataFrame([("issue_comment", '{"issue":{"user":{"login":"a"}},"comment":{"body":"c","user":{"login":"z"}}}'), ("pull_request_review", '{"pull_request":{"number":4,"title":"p","head":{"ref":"f"},"base":{"ref":"m"}},"review":{"state":"ok","body":"r"}}'), ("push", '{"issue":{"number":1}}'), ("issues", None), ("issues", "no json")], "event string, payload string")
    assert sorted(r.content for r in webhook.discussions(both).collect()) == ["Comment on issue #0 by z:\nc", "Issue #0: Untitled\nBy: a\n\n", "PR #4: p\nBy: unknown\nBranch: f → m\n\n", "Review on PR #4 by unknown (ok):\nr"]
    assert sorted(r.content for r in webhook.commits(df).collect()) == ["Commit 01234567 by unknown: m\nChanged files: a.rs", "[File changed: a.rs in commit 0123456789]"]


def test_streams(spark, tmp_path):
    s = views.sessions(spark, SF).select("id", "session_id", "role", "content", "content_hash")
    s.union(s.limit(10)).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = flows.deduplicated(flows.session_stream(spark, f"{tmp_path}/in", s.schema)).writeStream.format("memory").queryName("deduped").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("deduped").count() == s.count()
    got = {"raw": 0, "kept": 0}

    def put(name):
        return lambda rows: got.__setitem__(name, got[name] + rows.count())

    q = flows.two_paths(flows.session_stream(spark, f"{tmp_path}/in", s.schema), f"{tmp_path}/ck", put("raw"), put("kept")).start()
    q.processAllAvailable()
    q.stop()
    assert got["raw"] == s.count() + 10 and got["kept"] <= got["raw"]


def test_noise_learning_is_first_in_first_out(spark):
    r = np.random.RandomState(0)
    v = r.normal(size=(300, 8))
    noisy = np.arange(300) % 2 == 0
    hits, known = flows.learn_noise(v, noisy, [])
    assert hits[noisy].all() and len(known) <= flows.MAX_PROTOTYPES
    rows = spark.createDataFrame([("t", i, v[i].tolist(), bool(noisy[i])) for i in range(300)], "tenant_id string, seq long, vector array<double>, noisy boolean")
    out = {x.seq: x.noise for x in flows.noise_by_tenant(rows).collect()}
    assert [out[i] for i in range(300)] == hits.tolist()


def test_seams(spark):
    df = spark.createDataFrame([("a b",), (None,), ("One. Two.",)], "t string")
    out = df.select(seams.embedder(seams.hashing_vectors)("t").alias("v")).collect()
    assert all(len(r.v) == 64 for r in out) and sum(x * x for x in out[0].v) == pytest.approx(1, abs=1e-5)
    facts = df.where("t is not null").select(F.from_json(seams.completer(seams.sentence_facts)("t"), seams.FACTS).alias("f")).select(F.explode("f.memories").alias("m")).collect()
    assert [r.m.l0_abstract for r in facts] == ["a b", "One.", "Two."]
    assert [r[0] for r in df.select(seams.overlap_scores("a c")("t")).collect()] == [0.5, 0, 0]


def test_pages_and_visibility(spark):
    m = scan.live(views.memories(spark, SF))
    ids = [r.id for p in range(4) for r in scan.page(m, 30, 30 * p).select("id").collect()]
    assert len(ids) == len(set(ids)) == 120
    assert m.where(scan.visible_to("", [])).select("visibility").distinct().collect()[0][0] == "global"
    copy = scan.upsert(m, m.limit(3).withColumn("content", F.lit("new")))
    assert copy.count() == m.count() and copy.where("content = 'new'").count() == 3


# --- formulas by hand, so that code and SQL can't err together


def test_frequency_uses_the_average_gap(spark):
    rows = [(4, "2024-01-01", "2024-01-31"), (1, "2024-01-01", "2024-03-01"), (11, "2024-01-01", None), (2, "2024-02-01", "2024-01-01"), (0, "2024-01-01", None)]
    df = spark.createDataFrame(rows, "access_count int, c string, l string").select("access_count", F.col("c").cast("timestamp").alias("created_at"), F.col("l").cast("timestamp").alias("last_accessed_at"))
    got = [r[0] for r in df.select(scoring.frequency()).collect()]
    base = lambda n: 1 - np.exp(-n / 5)
    assert got == pytest.approx([base(4) * (0.5 + 0.5 * np.exp(-10 / 30)), base(1), base(11), base(2), 0])


def test_relation_graph_by_hand(spark):
    none = "array<struct<relation_type:string,target_id:string,context_label:string>>"
    rows = [
        ("a", "s1", 0.9, [("supports", "b", "why"), ("supports", "gone", None)], None, None, None),
        ("b", "s2", 0.9, [("supports", "low", None)], "a", None, None),
        ("low", "s3", 0.1, [("supports", "a", None)], None, None, None),
        ("c", "s2", 0.8, [], None, "a", "s1"),
        ("lone", "s1", 1.0, [], None, None, None),
    ]
    m = spark.createDataFrame(rows, f"id string, space_id string, importance double, relations {none}, superseded_by string, provenance_source_id string, shared_from_space string").withColumns({"content": F.col("id"), "l0_abstract": F.lit(""), "category": F.lit("events")})
    got = sorted(tuple(r) for r in stats.edges(m, 0.5).collect())
    assert got == sorted([("a", "b", "supports", "why", True), ("a", "gone", "supports", None, False), ("b", "low", "supports", None, False), ("a", "b", "supersedes", None, False), ("a", "c", "shared_from", "s1 → s2", True)], key=lambda r: tuple(map(str, r)))
    assert [r.id for r in stats.nodes(m, 0.5, 10).orderBy("id").collect()] == ["a", "b", "c"]


def test_contradiction_goes_by_the_facts_category(spark):
    m = spark.createDataFrame([("m1", "preferences", "insight"), ("m2", "cases", "insight"), ("m3", "cases", "pinned")], "id string, category string, memory_type string")
    facts = spark.createDataFrame([(1, "f", "cases"), (2, "f", "Preferences"), (3, "f", "odd"), (4, "f", "entities")], "fact_id long, l0 string, category string")
    dec = spark.createDataFrame([("d1", "contradict", 1, "m1", None), ("d2", "CONTRADICT", 2, "m2", None), ("d3", "contradict", 3, "m2", None), ("d4", "contradict", 4, "m3", None)], "decision_id string, action string, fact_id long, match_id string, merged_content string")
    assert {r.decision_id: r.applied for r in reconcile.resolve(dec, facts, m).collect()} == {"d1": "contradict", "d2": "supersede", "d3": "contradict", "d4": "create"}


def test_merge_supersede_and_vectors(spark):
    rel = "array<struct<relation_type:string,target_id:string,context_label:string>>"
    m = spark.createDataFrame([(f"m{i}", "old", "cases", "active", "insight", 0.95, None, [], 1, [0.0]) for i in range(4)], f"id string, content string, category string, state string, memory_type string, confidence double, superseded_by string, relations {rel}, version long, vector array<float>").withColumn("invalidated_at", F.lit(None).cast("timestamp"))
    facts = spark.createDataFrame([(1, "fact", "cases", "its source")], "fact_id long, l0 string, category string, source_text string")
    dec = spark.createDataFrame([("a", "merge", 1, "m0", None), ("b", "supersede", 1, "m1", None), ("c", "support", 1, "m2", None)], "decision_id string, action string, fact_id long, match_id string, merged_content string")
    out = {r.id: r for r in reconcile.apply(m, reconcile.resolve(dec, facts, m), now(), seams.embedder(lambda ts: [[float(len(t))] for t in ts])).collect()}
    assert (out["m0"].content, out["m0"].vector, out["m0"].version) == ("fact", [4.0], 2)
    assert out["m1"].superseded_by == "nb" and out["m1"].invalidated_at is not None and out["m1"].state == "active" and out["m1"].vector == [0.0]
    assert out["nb"].content == "its source" and out["nb"].vector == [10.0] and out["nb"].invalidated_at is None
    assert out["m2"].confidence == 1.0 and [tuple(x) for x in out["m2"].relations] == [("supports", "m2", None)] and out["m3"].version == 1


def test_ordinals_out_of_range_end_the_job(spark):
    facts, existing = spark.createDataFrame([(0, 7)], "ordinal int, fact_id long"), spark.createDataFrame([(0, "m1")], "ordinal int, id string")
    d = lambda rows: spark.createDataFrame(rows, "decision_id string, action string, fact_index int, match_index int")
    assert [(r.fact_id, r.match_id) for r in reconcile.by_ordinal(d([("a", "MERGE", 0, 0), ("b", "CREATE", 0, None)]), facts, existing).orderBy("decision_id").collect()] == [(7, "m1"), (7, None)]
    for bad in (("a", "MERGE", 0, 5), ("a", "MERGE", 0, None), ("a", "CREATE", 3, None)):
        with pytest.raises(Exception, match="invalid (fact|match)_index"):
            reconcile.by_ordinal(d([bad]), facts, existing).collect()


def test_expired_takes_archived_rows_and_deletes_softly(spark):
    rows = [("a", "active", "see you tomorrow", "2024-03-31"), ("b", "archived", "due next week", "2024-03-20"), ("c", "deleted", "today", "2024-01-01"), ("d", "active", "this month", "2024-03-01"), ("e", "active", "plain", "2020-01-01")]
    m = spark.createDataFrame(rows, "id string, state string, content string, c string").select("id", "state", "content", F.col("c").cast("timestamp").alias("created_at"), F.lit(1).cast("long").alias("version"))
    assert sorted(r.id for r in lifecycle.expired(m, now()).collect()) == ["a", "b"]
    assert {r.id: (r.state, r.version) for r in lifecycle.cleanup_expired(m, now()).collect()} == {"a": ("deleted", 2), "b": ("deleted", 2), "c": ("deleted", 1), "d": ("active", 1), "e": ("active", 1)}


def test_copies_start_anew(spark):
    m = views.memories(spark, SF).where("id in ('m2', 'm18')").withColumns({"invalidated_at": now(), "updated_at": now()})
    first = sharing.copies(m, F.lit("team/b"), now(), F.lit("u1"), F.lit("ag")).collect()
    later = sharing.copies(m, F.lit("team/b"), F.lit("2024-04-04").cast("timestamp"), F.lit("u1"), F.lit("ag")).collect()
    assert len({r.id for r in first + later}) == 4
    for r in first:
        assert r.superseded_by is None and r.invalidated_at is None and r.last_accessed_at is None and str(r.created_at) == str(r.updated_at) == "2024-04-03 00:00:00" and (r.access_count, r.version, r.visibility) == (0, 1, "global")
        assert (r.provenance.shared_from_memory, r.provenance.shared_by_user, r.provenance.shared_by_agent) == (r.provenance_source_id, "u1", "ag") and r.provenance.source_version == 1 + int(r.provenance_source_id[1:]) % 4


def test_unshare_needs_the_sharer_or_an_admin(spark):
    m = scan.live(views.memories(spark, SF))
    made = sharing.shared(m, m.where("id in ('m13', 'm9')"), "team/a", now(), "u1").drop("provenance_source").withColumn("updated_at", F.lit(None).cast("timestamp"))
    whole = m.unionByName(made, allowMissingColumns=True)
    assert sharing.shared(whole, m.where("id in ('m13', 'm9')"), "team/a", now(), "u1").count() == 0
    left = lambda user: sharing.unshared(whole, m.where("id = 'm13'"), "team/a", views.spaces(spark), user).where("state = 'deleted' and space_id = 'team/a'").count()
    assert [left(u) for u in ("u1", "u0", "u2", "u4")] == [1, 1, 0, 0]
    again = sharing.reshared(whole, made.select("id"), F.lit("2024-05-01").cast("timestamp"), "u1")
    assert again.where("state = 'deleted'").count() == 2 and again.where("space_id = 'team/a' and provenance_source_id in ('m13', 'm9') and state <> 'deleted'").count() == 2


def test_org_setup(spark):
    asked = spark.createDataFrame([("u1", "Member"), ("u2", "boss"), ("u0", "reader"), ("u3", None)], "user_id string, role string")
    space, failed = sharing.org_setup("Org", "u0", asked, "org/1")
    assert [(m.user_id, m.role) for m in space.first().members] == [("u0", "admin"), ("u1", "member")] and sorted(r.user_id for r in failed.collect()) == ["u2", "u3"]
    with pytest.raises(ValueError):
        sharing.org_setup("", "u0", asked, "org/1")


def test_message_blocks_keep_the_tail(spark):
    rows = [(1, 0, "user", "a" * 9000), (2, 0, "user", None), (2, 1, "user", "b"), (3, 0, "user", "x" * 5000), (3, 1, "user", "y" * 5000), (4, 0, "user", "字" * 3000)]
    out = {r.conv_id: r.block for r in ingest.message_block(spark.createDataFrame(rows, "conv_id int, turn int, role string, content string"), "conv_id", "turn").collect()}
    assert out[1] == "a" * 7999 + "\n" and out[2] == "user: \nuser: b\n" and out[3] == "user: " + "y" * 5000 + "\n"
    assert out[4] == "字" * 2666 + "\n"  # 7999 bytes, the cut character goes
    tail = ingest.transcript(spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"{i}" * 2500) for i in range(12)] + [(2, 0, "user", "lone")], "conv_id int, turn int, role string, content string"), "conv_id", "turn").collect()
    assert sorted(r.turn for r in tail) == list(range(2, 12)) and {len(r.content) for r in tail} == {2000}


def plain_split(text, size, overlap):
    """Chunks by positions in characters, measured in bytes one character at a time."""
    out, start = [], 0
    while len(text[start:].encode()) > size:
        stop, used = start, 0
        while used + len(text[stop].encode()) <= size:
            used += len(text[stop].encode())
            stop += 1
        end = next((start + at + n for mark, n in (("\n## ", 1), ("\n\n", 2), ("\n", 1)) if (at := text[start:stop].rfind(mark)) >= 0), stop)
        out.append(text[start:end])
        back, total = end, 0
        while back > 0 and total < overlap:
            back -= 1
            total += len(text[back].encode())
        start = back if start < back and len(text[:end].encode()) > overlap else end
    return [*out, text[start:]]


def test_chunks_are_measured_in_bytes(spark):
    cjk = "字" * 70_000
    parts = list(chunk.smart_chunks(cjk))
    assert len(parts) == 3 and all(len(p.encode()) <= 80_000 for p in parts)
    rows = chunk.chunked(spark.createDataFrame([(1, cjk), (2, None), (3, "")], "i int, t string"), "i", "t").collect()
    assert sorted((r.i, r.part) for r in rows) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)] and [r.chunk for r in sorted(rows, key=lambda r: (r.i, r.part))][:3] == parts
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = sorted((i, n, len(c)) for i, t in docs.items() for n, c in enumerate(plain_split(t or "", 4000, 200)))
    assert sorted(tuple(r) for r in registry.QUERIES["smart_split"](spark, SF).collect()) == want


def test_code_chunks_query(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        n, first = 0, None
        lines = re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", r.html.replace("</p>", "\n\n"))
        for number, line in enumerate([*lines, ""], 1):
            if line.strip():
                first = first or number
            elif first:
                want.append((r.page_id, n, first, number - 1))
                n, first = n + 1, None
    assert sorted(tuple(r) for r in registry.QUERIES["code_chunks"](spark, SF).collect()) == sorted(want)


def test_items_between_braces():
    rust = "use x;\n\npub fn a(s: &str) -> u8 {\n    if s == \"}\" { 1 } else { 2 }\n}\n\nimpl T {\n    fn b() {}\n}\n"
    assert [c[1:] for c in chunk.code_chunks("rust", rust)] == [(3, 5), (7, 9)]
    js = "import a from 'a'\n\nexport class A {\n  go() { return `}` }\n}\nconst f = (x) => {\n  return x\n}\n// function no() {\n"
    assert [c[1:] for c in chunk.code_chunks("javascript", js)] == [(3, 5), (6, 8)]
    ts = "interface P {\n  a: string\n}\nexport type Q = { b: number };\nexport async function g(): Promise<void> {\n}\n"
    assert [c[1:] for c in chunk.code_chunks("typescript", ts)] == [(1, 3), (4, 4), (5, 6)]
    assert [c[0] for c in chunk.code_chunks("rust", "fn broken( {\n\nx")] == ["fn broken( {", "x"]
    assert [c[0] for c in chunk.code_chunks(None, "a\n\nb")] == ["a", "b"]


def test_noise_learning_query(spark):
    rows = sorted(((r.vec_id % 5, r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()), key=lambda r: r[:2])
    known, want = {}, {}
    for tenant, seq, v in rows:
        near = [v @ p / np.linalg.norm(v) / np.linalg.norm(p) for p in known.get(tenant, [])]
        want[seq] = bool(seq % 11 == 0 or max(near, default=-1) >= 0.82)
        if want[seq] and max(near, default=-1) < 0.95:
            known[tenant] = (known.get(tenant, []) + [v])[-200:]
    assert {r.seq: r.noise for r in registry.QUERIES["noise_learning"](spark, SF).collect()} == want


def test_import_routing_query(spark):
    def kind(t):
        if len(t.encode()) > 80_000:
            return "large_doc"
        if sum(t.count(m) for m in text.ROLE_MARKS) >= 3:
            return "conversation"
        headed = t.startswith(("# ", "## ")) or "\n# " in t or "\n## " in t
        return "structured_doc" if headed or len(t.split()) >= 500 else "short_note"

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {}
    for r in registry.QUERIES["import_routing"](spark, SF).collect():
        out.setdefault(r.doc_id, []).append((r.part, r.hint, r.bytes))
    assert {i: {h for _, h, _ in rows} for i, rows in out.items()} == {i: {kind(t)} for i, t in docs.items()}
    for i, rows in out.items():
        if kind(docs[i]) == "short_note":
            assert [n for _, _, n in rows] == [len(docs[i].encode())]
    assert {r.hint for r in chunk.import_chunks(spark.createDataFrame([(1, None), (2, "x")], "i int, t string"), "i", "t", "section").collect()} == {"structured_doc"}


def test_facts_are_found_once(spark):
    """Conversations are read, and facts extracted, once for all that is told of them."""
    rows = spark.createDataFrame([(1, 0, "user", "Anna moved to Lisbon in March 2023 for a new job.")], "conv_id int, turn int, role string, content string")
    plan = flows.reconcile_input(rows, seams.embedder(seams.hashing_vectors), seams.completer(seams.sentence_facts))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Join" not in plan


def test_ingest_to_the_end(spark, tmp_path):
    embed, extract = seams.embedder(seams.hashing_vectors), seams.completer(seams.sentence_facts)
    rel = "array<struct<relation_type:string,target_id:string,context_label:string>>"
    fields = f"id string, content string, l0_abstract string, category string, state string, memory_type string, confidence double, superseded_by string, invalidated_at timestamp, relations {rel}, n_relations long, version long, updated_at timestamp"
    held = [("m1", "user: The launch of rocket nine was moved to Friday by the team.", "", "events", "active", "insight", 0.5, None, None, [], 0, 1, None)]
    old = spark.createDataFrame(held, fields).withColumn("vector", embed(F.col("content")))
    said = [(1, 0, "user", "hello!"), (1, 1, "user", "The launch of rocket nine was moved to Friday by the team."), (1, 2, "user", "<private>the code</private>"), (2, 0, "user", "Anna moved to Lisbon in March 2023 for a new job. Anna moved to Lisbon in March 2023 for a new job.")]
    out = flows.ingest(spark.createDataFrame(said, "conv_id int, turn int, role string, content string"), old, now(), embed, extract)[0].collect()
    by = {r.id: r for r in out}
    new = sorted(r.content for r in out if r.id != "m1")
    assert all("code" not in c and c != "hello!" for c in new) and sum("Lisbon" in c for c in new) == 1
    assert by["m1"].content == held[0][1]
    # as a stream: a batch of the same messages again finds its facts and adds none
    t = store.Table(spark, f"{tmp_path}/t", old.schema, None)
    t.replace(old)
    rows = spark.createDataFrame(said[3:], "conv_id int, turn int, role string, content string")
    for n in (1, 2):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = flows.upserts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck", t, now(), embed, extract).start()
        q.processAllAvailable()
        q.stop()
        assert sum("Lisbon" in r.content for r in t.read().collect()) == 1, n


def _loop(rows, batches, stamp):
    """Ingest as a loop over requests and facts, of rows (id: dict of 31 columns). Facts are sentences of `role: content` lines; all of them are admitted."""
    vec = lambda t: np.array(seams.hashing_vectors([t])[0], dtype=np.float32)
    done = set()
    for batch in batches:
        before = {i: dict(r) for i, r in rows.items()}
        for conv in sorted({c for c, *_ in batch}):
            said = "".join(f"{role}: {content}\n" for c, _, role, content in sorted(batch) if c == conv)
            for f in json.loads(seams.sentence_facts(said))["memories"]:
                l0 = f["l0_abstract"]
                name = "i" + hashlib.sha256(f"{conv}\x1f{l0}".encode()).hexdigest()[:32]
                if name in done:
                    continue
                done.add(name)
                v = vec(l0).astype(float)
                best = max(((round(float(v @ np.array(r["vector"], dtype=float)) / (np.linalg.norm(v) * np.linalg.norm(np.array(r["vector"], dtype=float))), 6), r["id"]) for r in before.values() if r["state"] != "deleted"), default=(0, None))
                if best[0] >= 0.95:
                    continue
                if best[0] >= 0.85:
                    r = rows[best[1]]
                    r |= {"confidence": round(min(r["confidence"] + 0.1, max(1.0, r["confidence"])), 6), "version": r["version"] + 1, "updated_at": stamp, "relations": [*r["relations"], ("supports", best[1], None)]}
                    continue
                new = {c.name: None for c in schema.MEMORY.fields}
                new |= {"id": "n" + name, "content": l0, "l0_abstract": l0, "l1_overview": "", "l2_content": "", "vector": [float(x) for x in vec(l0)], "category": "events", "memory_type": "insight", "state": "active", "tier": "peripheral"}
                new |= {"importance": 0.5, "confidence": 0.5, "access_count": 0, "tags": [], "scope": "global", "tenant_id": "u1", "relations": [], "created_at": stamp, "updated_at": stamp, "space_id": "", "visibility": "global", "owner_agent_id": "", "version": 1}
                rows[new["id"]] = new
    return rows


def test_ingest_runs_twice_and_keeps_all_columns(spark, tmp_path):
    """Batches of one conversation, and one that comes again, give the rows of a loop on all 31 columns."""
    embed, extract = seams.embedder(seams.hashing_vectors), seams.completer(seams.sentence_facts)
    stamp = spark.range(1).select(now().alias("t")).first().t
    held = {}
    for i in range(3):
        content = ["The committee in Vienna approved the 2021 budget for bridges.", "Paula sold 14 sheep to the Meier farm near Graz last autumn.", "Old rule, no longer used by anyone in the Paris office."][i]
        held[f"m{i}"] = {f.name: None for f in schema.MEMORY.fields} | {
            "id": f"m{i}", "content": content, "l0_abstract": content, "l1_overview": "l1", "l2_content": "l2", "vector": seams.hashing_vectors([content])[0], "category": "cases", "memory_type": "insight", "state": "deleted" if i == 2 else "active", "tier": "core",
            "importance": 0.9, "confidence": 0.95 if i else 0.3, "access_count": 4, "tags": ["a", "b"], "scope": "s", "agent_id": "ag", "session_id": "se", "source": "so", "tenant_id": "u1", "relations": [("supports", "m1", "why")], "created_at": stamp, "updated_at": None,
            "last_accessed_at": stamp, "space_id": "team/a", "visibility": "private", "owner_agent_id": "ow", "provenance": ("x", "m9", "u", "a", "2020", stamp, 3), "version": 5, "provenance_source_id": "m9",
        }
    first = [(7, 0, "user", "Nora flew to Tokyo on 3 May 2022 with Flight 88. The committee in Vienna approved the 2021 budget for two very long bridges."), (8, 0, "user", "Greg planted 300 trees behind the Harbor Museum in June.")]
    second = [(7, 1, "user", "Nora flew to Osaka by train because Flight 91 was late in 2023. Paula sold 14 white sheep to the big old Meier farm near Graz last autumn."), (9, 0, "assistant", "Greg planted 300 trees behind the Harbor Museum in June.")]
    table = store.Table(spark, f"{tmp_path}/t", schema.MEMORY, None)
    columns = [f.name for f in schema.MEMORY.fields]
    start = spark.createDataFrame([tuple(r[c] for c in columns) for r in held.values()], schema.MEMORY)
    table.replace(start)
    out = flows.ingest(spark.createDataFrame(first, "conv_id int, turn int, role string, content string"), table.read(), now(), embed, extract, tenant="u1")
    assert out[0].columns == columns and {r.action for r in out[1].collect()} == {"CREATE", "SUPPORT"}
    for batch in (first, second, second):
        spark.createDataFrame(batch, "conv_id int, turn int, role string, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("conv_id int, turn int, role string, content string").parquet(f"{tmp_path}/in")
        q = flows.upserts(stream, f"{tmp_path}/ck", table, now(), embed, extract, tenant="u1").start()
        q.processAllAvailable()
        q.stop()
    expected = _loop(held, [first, second, second], stamp)
    plain = lambda r: tuple(tuple(map(tuple, v)) if c == "relations" and v is not None else tuple(v) if c in ("vector", "tags", "provenance") and v is not None else v for c, v in zip(columns, r, strict=True))
    got = sorted((plain(tuple(r)) for r in table.read().collect()), key=lambda r: r[0])
    want = sorted((plain(tuple(r[c] for c in columns)) for r in expected.values()), key=lambda r: r[0])
    assert [r[0] for r in got] == [r[0] for r in want] and len(got) == 6
    for a, b in zip(got, want, strict=True):
        assert {c: v for c, v in zip(columns, a, strict=True) if c != "vector"} == {c: v for c, v in zip(columns, b, strict=True) if c != "vector"}
        assert np.allclose(a[columns.index("vector")], b[columns.index("vector")])
    assert table.part("ledger").count() == 6


def test_changes_of_one_memory_count_in_order(spark):
    m = spark.createDataFrame([("m0", "old", "events", "active", "insight", 0.5, None, [], 1)], "id string, content string, category string, state string, memory_type string, confidence double, superseded_by string, relations array<struct<relation_type:string,target_id:string,context_label:string>>, version long")
    facts = spark.createDataFrame([(i, f"fact {i}", "cases") for i in range(6)], "fact_id long, l0 string, category string")
    acts = [("z", "merge", 0, 1), ("a", "merge", 1, 2), ("y", "support", 2, 3), ("b", "contradict", 3, 4), ("c", "contextualize", 4, 5), ("x", "support", 5, 6)]
    dec = spark.createDataFrame([(d, a, f, "m0", None, s) for d, a, f, s in acts], "decision_id string, action string, fact_id long, match_id string, merged_content string, seq int")
    resolved = reconcile.resolve(dec, facts, m)
    out = {r.id: r for r in reconcile.apply(m, resolved, now()).collect()}
    assert (out["m0"].content, out["m0"].version, out["m0"].confidence) == ("fact 1", 6, 0.7)
    assert [tuple(x) for x in out["m0"].relations] == [("supports", "m0", None), ("contradicts", "nb", None), ("supports", "m0", None)]
    assert [tuple(x) for x in out["nb"].relations] == [("contradicts", "m0", None)] and out["nc"].version == out["nb"].version == 2
    again = reconcile.apply(reconcile.apply(m, resolved, now()), resolved, now())
    assert again.count() == 3  # no id twice


def test_a_reader_sees_changes_whole(spark, tmp_path):
    t = store.Table(spark, f"{tmp_path}/m", schema.SESSION, "session_id")
    row = lambda i: spark.createDataFrame([(str(i), f"s{i % 2}", "user", "hi")], "id string, session_id string, role string, content string")
    t.replace(row(1), ledger=row(9).select("id"))
    t.append(row(2))
    half = store.Table(spark, f"{tmp_path}/m", schema.SESSION, "session_id")
    row(3).write.parquet(f"{tmp_path}/m/a={half._claim()}/rows")  # a writer that died before its mark
    assert sorted(r.id for r in t.read().collect()) == ["1", "2"] and [r.id for r in t.part("ledger").collect()] == ["9"]
    assert half._claim() != t._claim()  # numbers are never shared
    seen = t.read()
    t.replace(row(4))
    assert sorted(r.id for r in seen.collect()) == ["1", "2"] and [r.id for r in t.read().collect()] == ["4"] and t.part("ledger") is None
    t.replace(row(5))
    assert {p.name for p in (tmp_path / "m").iterdir() if p.name[0] in "va"} == {p.name for p in (tmp_path / "m").iterdir() if p.name.startswith("v=")}
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("v=")]) == 2


def test_signatures_tables_and_json(spark):
    long = "k" * 100
    made = lambda key, body: "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("p", made("key", "p")), ("p", made("other", "p")), ("p", "md5=1"), ("é", made("key", "é")), (None, "sha256=")], "payload string, signature string")
    assert [r[0] for r in df.select(text.signed_by(F.col("payload"), F.col("signature"), "key")).collect()] == [True, False, False, True, False]
    assert df.sparkSession.createDataFrame([("p", made(long, "p"))], "p string, s string").select(text.signed_by(F.col("p"), F.col("s"), long)).first()[0]
    answers = iter(["no json", '```json\n{"a": 1}\n```'])
    assert json.loads(seams.complete_json(lambda _: next(answers))("x")) == {"a": 1}
    with pytest.raises(ValueError):
        seams.complete_json(lambda _: "never")("x")
    t = spark.createDataFrame([("a", "pending", None), ("b", "running", None), ("c", "completed", None)], "id string, status string, completed_at timestamp")
    moved = {r.id: (r.status, r.completed_at is not None) for r in tables.move_tasks(t, spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "rolled_back")], "id string, to string"), now()).collect()}
    assert moved == {"a": ("pending", False), "b": ("completed", True), "c": ("rolled_back", False)}
    facts = spark.createDataFrame([("a",), ("a",)], "task_id string")
    assert {r.id: (r.extraction_facts, r.reconcile_status) for r in tables.task_results(t, facts, facts.limit(1)).collect()} == {"a": (2, "completed"), "b": (0, "skipped"), "c": (0, "skipped")}
    s = views.sessions(spark, SF).withColumn("session_id", F.when(F.col("conv_id") == 1, "import-x").otherwise(F.col("session_id")))
    m = views.memories(spark, SF).withColumn("source", F.when(F.col("i") % 2 == 0, "intelligence").otherwise("other"))
    after, kept = store.rollback(m, s, "x", F.lit("2024-02-01").cast("timestamp"))
    assert kept.where("session_id = 'import-x'").count() == 0 and kept.count() == s.where("conv_id <> 1").count()
    assert after.where("state <> 'deleted' and source = 'intelligence' and created_at >= '2024-02-01'").count() == 0 and after.where("state <> 'deleted'").count() < m.where("state <> 'deleted'").count()


def test_decoders_and_context():
    import zlib

    page = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\n" + zlib.compress(b"BT (Hello \\(PDF\\)) Tj [(a) 2 (b)] TJ ET") + b"\nendstream\n"
    assert seams.pdf_pages(page) == ["Hello (PDF)\nab"]
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")
    assert seams.image_facts(png) == ["[PNG image, 7x5, 24 bytes]"]


def test_context_block(spark):
    rows = [(1, "events", ["x"], "2024-04-02", "first"), (2, "cases", [], "2024-04-03", "y" * 600), (3, "events", [], "2024-01-01", "third"), (4, "", [], "2024-04-03", "none")]
    df = spark.createDataFrame(rows, "rank int, category string, tags array<string>, c string, content string").withColumn("created_at", F.col("c").cast("timestamp"))
    assert profile.context_block(df, now()).first().block.split("\n")[4:] == ["[Events]", "  - (1d [x]) first", "  - (3mo) third", "[Cases]", "  - (0m) " + "y" * 500 + "…", "[General]", "  - (0m) none", "</memory-context>"]
    assert profile.context_block(df.limit(0), now()).count() == 0


def test_import_chunks_of_rows_that_repeat_an_id(spark):
    long = "word " * 20_000
    rows = [(1, long), (1, long), (2, "user: a\nassistant: b\nuser: c\nassistant: d")]
    out = sorted((r.i, r.hint, r.part) for r in chunk.import_chunks(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect())
    assert out == [(1, "large_doc", 0), (1, "large_doc", 0), (1, "large_doc", 1), (1, "large_doc", 1), (2, "conversation", 0)]


def test_webhooks_as_a_stream(spark, tmp_path):
    issue = json.dumps({"repository": {"full_name": "r"}, "issue": {"number": 1, "title": "t"}})
    push = json.dumps({"commits": [{"id": "0123456789", "message": "m", "added": ["a.rs"]}]})
    (tmp_path / "in").mkdir()

    def run(name, *events):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"event": e, "payload": p}) + "\n" for e, p in events))
        rows = flows.webhook_stream(spark, str(tmp_path / "in"))
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run("1.json", ("issues", issue), ("push", push)) == ["commit", "file", "issue"]
    assert run("2.json", ("issues", issue), ("ping", "{}")) == ["commit", "file", "issue", "issue"]


def test_caps_raise_and_cut_nothing(spark):
    m = views.memories(spark, SF).cache()
    mine = m.where("space_id = 'personal/u2' and state <> 'deleted'")
    n = mine.count()
    wanted = mine.select("id")
    assert n > 2 and sharing.shared(m, wanted, "team/z", now(), "u2", most=n).count() == n
    assert sharing.shared_all(m, "u2", "team/z", now(), F.lit(True), most=n).count() == n
    for call in (lambda: sharing.shared(m, wanted, "team/z", now(), "u2", most=n - 1), lambda: sharing.shared_all(m, "u2", "team/z", now(), F.lit(True), most=n - 1)):
        with pytest.raises(ValueError, match=f"limited to {n - 1} memories"):
            call()
    assert sharing.shared(m, wanted.limit(0), "team/z", now(), "u2", most=0).count() == 0


def test_profile_sections(spark):
    m = views.memories(spark, SF)
    assert {r.section for r in profile.profile(m, views.as_of()).collect()} == {"static_facts", "dynamic_context"}
    assert {r.section for r in profile.profile(m, views.as_of(), ["zzzznone"]).collect()} == {"static_facts", "dynamic_context"}
    assert profile.profile(m.limit(0), views.as_of(), ["a"]).count() == 0


def test_facts_leave_their_conversation_behind(spark):
    """A fact carries how far its conversation backs it, and not the conversation's text."""
    said = [(1, i, "user", f"Fact {i} is about thing{i} and place{i}. Then some more of it.") for i in range(6)]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, content string")
    facts = flows.reconcile_input(rows, seams.embedder(seams.hashing_vectors), seams.completer(seams.sentence_facts))
    block = ingest.message_block(rows, "conv_id", "turn").first()["block"]
    assert "source_text" not in facts.columns and facts.count() > 3
    want = facts.select("fact_id", ingest.support(F.col("l0"), F.lit(block)).alias("s"))
    assert sorted(facts.select("fact_id", "support").collect()) == sorted(want.collect())


def test_rows_meet_parts_as_large_as_memory_holds(spark):
    """Rows of the left side are sent once for each part of the right one, and parts hold more than a block; what is found is the same by parts of any size."""
    r = np.random.RandomState(5)
    x, y = r.randint(-2, 3, size=(300, 6)).astype(float), r.randint(-2, 3, size=(9000, 6)).astype(float)  # ties
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], f"{name} long, vector array<double>") for z, name in ((x, "a"), (y, "b")))
    s = np.round(knn.units(x) @ knn.units(y).T, 6)
    want = sorted((i, int(j), s[i, j], n + 1) for i in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(y)), -s[i]))[:4]) if s[i, j] >= 0.9)
    for block in (None, 2500):
        assert sorted(map(tuple, knn.topk(a, b, 4, 0.9, block).select("a", "b", "score", "rank").collect())) == want
    sent = []
    knn_meet = knn.meet
    try:
        knn.meet = lambda data, asked, k, read: sent.append(asked.count()) or knn_meet(data, asked, k, read)
        knn.topk(a, b, 4, 0.9).count()
    finally:
        knn.meet = knn_meet
    assert sent == [300]


def test_search_across_spaces_searches_once(spark):
    """The result is read from candidates that were found once: its plan scans neither documents nor vectors."""
    plan = registry.QUERIES["cross_space_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "documents.parquet" not in plan
