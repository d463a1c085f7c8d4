"""Keyed stream state against loops and hand-computed records, with restarts between batches."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.functions import seams, text
from memlake.operators import chunk
from memlake.streaming import flows, state

ROWS = "tenant_id string, seq long, vector array<double>, noisy boolean"


def run(stream, at, mode="append"):
    """One start of the stream, to the end of what lies there, one file a batch."""

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    with state.rocksdb(stream.sparkSession):
        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns, *(["batch"] if mode == "update" else []))


def put(spark, rows, schema, at, name):
    """One file of the stream's folder, in the order of names."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}")
    os.makedirs(f"{at}/in", exist_ok=True)
    (part,) = [f for f in os.listdir(f"{at}/{name}") if f.endswith(".parquet")]
    os.rename(f"{at}/{name}/{part}", f"{at}/in/{name}.parquet")
    stamp = 1_700_000_000 + int(name[1:])
    os.utime(f"{at}/in/{name}.parquet", (stamp, stamp))


def test_noise_of_three_batches_equals_one_pass(spark, tmp_path):
    """Also: rows of a batch out of order, a tenant of null, null vectors and marks, zero vectors, repeated rows, prototypes that are pushed out, and a setting that comes back."""
    r, at = np.random.RandomState(3), str(tmp_path)
    fixed = [r.normal(size=6).tolist()]
    rows = []
    for i in range(1500):
        v = r.normal(size=6) + (4 * np.eye(6)[i % 6] if i % 4 == 0 else 0)
        v = np.zeros(6) if i % 97 == 0 else np.array(fixed[0]) * 2 if i % 101 == 0 else v
        rows.append((None if i % 50 == 7 else f"t{i % 3 and 1}", i, None if i % 89 == 5 else v.tolist(), None if i % 31 == 0 else i % 2 == 0))
    want, known = {}, {}
    for t, i, v, noisy in rows:  # a plain loop, by dot products
        near = -1.0
        if v is not None:
            for p in [*fixed, *known.get(t, [])]:
                size = np.linalg.norm(v) * np.linalg.norm(p)
                near = max(near, np.dot(v, p) / size if size else 0.0)
        want[i] = bool(noisy) or near >= 0.82
        if v is not None and want[i] and near < 0.95:
            known[t] = (known.get(t, []) + [v])[-200:]
    assert any(len(k) == 200 for k in known.values())
    os.makedirs(f"{at}/in")
    stream = state.learned_noise(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), fixed)
    for n, (a, b) in enumerate([(0, 500), (500, 1000)]):
        part = rows[a:b]
        put(spark, [part[j] for j in r.permutation(len(part))], ROWS, at, f"b{n}")
    run(stream, at)
    part = rows[1000:]
    put(spark, [part[j] for j in r.permutation(len(part))], ROWS, at, "b2")
    before = spark.conf.get(state.PROVIDER, None)
    out = run(stream, at).collect()
    assert spark.conf.get(state.PROVIDER, None) == before
    assert len(out) == len(rows) and {x.seq: x.noise for x in out} == want
    assert {x.seq: x.tenant_id for x in out} == {i: t for t, i, _, _ in rows}


def test_prototypes_are_known_from_the_start(spark):
    fixed = state.noise_prototypes(spark, seams.embedder(seams.hashing_vectors))
    assert len(fixed) == len(text.NOISE_TEXTS) and all(len(v) == 64 for v in fixed)
    hits, known = flows.learn_noise([np.array(fixed[4]) * 3, np.array(fixed[4]) * -1], np.array([False, False]), [], [np.array(v) for v in fixed])
    assert hits.tolist() == [True, False] and known == []


def minute(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def test_each_path_of_an_import_task(spark, tmp_path):
    """Two batches and a restart: what happened before it counts, events that come again change nothing, and who hears no more fails."""
    at = str(tmp_path)
    os.makedirs(f"{at}/in")
    e = lambda task, kind, at, part=None, n=None, message=None: (task, kind, part, n, message, minute(at))
    first = [
        e("plain", "created", 0, n=0), e("empty", "created", 0, n=1), e("empty", "chunked", 1, n=0),
        e("two", "extracted", 2, 1, 4), e("two", "created", 0, n=1), e("two", "chunked", 1, n=2), e("two", "extracted", 2, 1, 4),
        e("nofacts", "created", 0, n=1), e("nofacts", "chunked", 1, n=1), e("nofacts", "extracted", 2, 0, 0),
        e("late", "created", 0, n=1), e("late", "extracted", 1, 0, 3), e("badpart", "created", 0, n=1), e("badpart", "chunked", 1, n=2), e("badpart", "chunk_failed", 2, 0, None, "x"),
        e("fails", "created", 0, n=1), e("silent", "created", 0, n=1), e("silent", "chunked", 1, n=3), e("silent", "extracted", 2, 0, 1),
        e(None, "created", 0, n=1), ("two", "unheard", 0, 0, None, minute(0)), ("two", None, 0, 0, None, minute(0)), ("two", "failed", 0, 0, None, None),
    ]
    second = [
        e("two", "extracted", 3, 1, 9), e("two", "extracted", 3, 0, 2), e("two", "reconciled", 4, n=5), e("two", "failed", 5, message="too late"), e("late", "chunked", 3, n=1), e("late", "reconcile_failed", 4, message="y"),
        e("badpart", "extracted", 3, 1, 2), e("badpart", "reconciled", 4, n=1), e("badpart", "rolled_back", 9), e("fails", "failed", 5, message="no session"), e("fails", "chunked", 6, n=1), e("clock", "created", 500, n=1),
    ]
    stream = state.task_records(spark.readStream.schema(state.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), "1 hour", "10 minutes")
    put(spark, first, state.EVENTS, at, "b0")
    early = {r.task_id: r for r in state.latest(run(stream, at, "update")).collect()}
    assert early["two"].status == "processing" and early["two"].extraction_facts == 4 and early["late"].extraction_status == "pending"
    put(spark, second, state.EVENTS, at, "b1")
    got = {r.task_id: r for r in state.latest(run(stream, at, "update")).collect()}
    view = {k: (r.status, r.extraction_status, r.extraction_chunks, r.extraction_facts, r.extraction_progress, r.reconcile_status, r.reconcile_relations, r.reconcile_merged, r.errors) for k, r in got.items()}
    assert view == {
        "plain": ("completed", "skipped", 0, 0, 0, "skipped", 0, 0, []),
        "empty": ("completed", "completed", 0, 0, 0, "skipped", 0, 0, []),
        "two": ("completed", "completed", 2, 6, 2, "completed", 6, 5, []),
        "nofacts": ("completed", "completed", 1, 0, 1, "skipped", 0, 0, []),
        "late": ("completed", "completed", 1, 3, 1, "completed", 0, 0, ["reconciliation failed: y"]),
        "badpart": ("rolled_back", "completed", 2, 2, 2, "completed", 2, 1, ["chunk 0 extraction failed: x"]),
        "fails": ("failed", "pending", 0, 0, 0, "pending", 0, 0, ["no session"]),
        "silent": ("failed", "running", 3, 1, 1, "pending", 0, 0, ["timed out"]),
        "clock": ("processing", "pending", 0, 0, 0, "pending", 0, 0, []),
    }
    ended = {k: r.completed for k, r in got.items()}
    assert ended["plain"] == minute(0) and ended["two"] == minute(4) and ended["silent"] == minute(62) and ended["clock"] is None


def test_chunks_drive_their_tasks(spark, tmp_path):
    long = "\n\n".join(f"paragraph {i} " + "word " * 900 for i in range(40))
    docs = spark.createDataFrame([(1, long), (2, "# A\none\n# B\ntwo\n# C\nthree\n"), (3, "a short note"), (4, "another note")], "doc_id long, text string")
    chunks = chunk.import_chunks(docs, "doc_id", "text").cache()
    facts = F.when((F.col("doc_id") == 4) | ((F.col("doc_id") == 1) & (F.col("part") == 1)), F.lit(None)).otherwise(F.lit(2))
    events = state.chunk_events(chunks, "doc_id", facts, F.lit(minute(0)))
    made = {r.doc_id: r for r in chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = str(tmp_path)
    events.write.parquet(f"{at}/in")
    records = state.latest(state.finished(state.task_records(spark.readStream.schema(state.EVENTS).parquet(f"{at}/in")), f"{at}/checkpoint", f"{at}/out"))
    got = {int(r.task_id): (r.status, r.extraction_chunks, r.extraction_facts, r.reconcile_status, len(r.errors)) for r in records.collect()}
    assert made[1].n > 2
    assert got[1] == ("processing", made[1].n, 2 * (made[1].n - 1), "running", 1) and got[2] == ("processing", made[2].n, 2 * made[2].n, "running", 0)
    assert got[3] == ("processing", 1, 2, "running", 0) and got[4][0] == "failed"


@pytest.mark.parametrize("rows", [[], [("t", 1, None, None)]])
def test_noise_of_empty_and_null(spark, tmp_path, rows):
    at = str(tmp_path)
    os.makedirs(f"{at}/in")
    put(spark, rows, ROWS, at, "b0")
    out = run(state.learned_noise(spark.readStream.schema(ROWS).parquet(f"{at}/in")), at)
    assert [tuple(r) for r in out.collect()] == [(t, seq, False) for t, seq, _, _ in rows]


def test_a_task_is_one_row_of_state_however_many_chunks_it_has(spark, tmp_path):
    """A batch writes one row of state for each task it has events of, as each write would be a round trip; parts may be negative or far apart, and count once, also after a restart."""
    at = str(tmp_path)
    os.makedirs(f"{at}/in")
    e = lambda task, kind, at, part=None, n=None, message=None: (task, kind, part, n, message, minute(at))
    parts = [-64, -1, 0, 62, 63, 10**12, *range(200, 400)]
    names = [f"t{i}" for i in range(20)]
    updated = []

    def go():
        stream = state.task_records(spark.readStream.schema(state.EVENTS).parquet(f"{at}/in"))
        with state.rocksdb(spark):
            query = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        updated.extend(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"])

    put(spark, [e(t, "chunked", 0, n=len(parts) + 1) for t in names] + [e(t, "extracted", 1, p, 1) for t in names for p in parts], state.EVENTS, at, "b0")
    go()
    put(spark, [e(t, "extracted", 2, p, 1) for t in names for p in parts], state.EVENTS, at, "b1")
    go()
    assert updated == [len(names)] * 2
    put(spark, [e(t, "extracted", 3, 500, 1) for t in names], state.EVENTS, at, "b2")
    last = state.finished(state.task_records(spark.readStream.schema(state.EVENTS).parquet(f"{at}/in")), f"{at}/c", f"{at}/out").collect()
    assert {(r.extraction_status, r.reconcile_status, r.extraction_facts, r.extraction_progress, r.version) for r in last} == {("completed", "running", len(parts) + 1, 10**12 + 1, 3)} and len(last) == len(names)


def test_a_task_fails_when_the_watermark_meets_its_time(spark, tmp_path):
    """Exactly then, and at once if that was so when its events came."""
    at = str(tmp_path)
    os.makedirs(f"{at}/in")
    e = lambda task, kind, at: (task, kind, 0, 1, None, minute(at))
    put(spark, [e("clock", "failed", 100), e("on the mark", "created", 89), e("not yet", "created", 89.01), e("again", "created", 80)], state.EVENTS, at, "b0")
    put(spark, [e("behind", "created", 50), e("again", "extracted", 95), e("clock", "rolled_back", 100)], state.EVENTS, at, "b1")
    stream = state.task_records(spark.readStream.schema(state.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), "1 minute", "10 minutes")
    got = {r.task_id: (r.status, r.completed, r.errors) for r in state.latest(run(stream, at, "update")).collect()}
    assert got == {
        "clock": ("rolled_back", minute(100), [""]), "on the mark": ("failed", minute(90), ["timed out"]), "not yet": ("processing", None, []),
        "again": ("processing", None, []), "behind": ("failed", minute(51), ["timed out"]),
    }
