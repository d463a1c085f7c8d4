"""Files and transcripts as data sources, and table functions from SQL text."""

import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memlake.functions import table_functions
from memlake.operators import chunk, ingest
from memlake.plans import registry
from memlake.sources import files, views

SF = "/root/testdata/sf0.001"


def lines(*entries) -> str:
    return "".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in entries)


def put(path: Path, text, ago: float = 10) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, ns=(time.time_ns() - int(ago * 1e9),) * 2)


def test_files_as_chunk_rows(spark, tmp_path):
    files.register(spark)
    long = "word " * 3000
    put(tmp_path / "a" / "long.md", long)
    put(tmp_path / "a" / "short.TXT", "one\n\ntwo")
    put(tmp_path / "a" / "bytes.txt", b"x\xff")
    put(tmp_path / "a" / "b" / "code.py", "import x\n\ndef f():\n    return 1\n\nclass A:\n    pass\n")
    put(tmp_path / "a" / "b" / "other.go", "one\n\n\ntwo")
    put(tmp_path / "a" / "p.pdf", b"%PDF stream\nBT (hello) Tj ET\nendstream")
    put(tmp_path / "a" / "bad.pdf", b"none")
    put(tmp_path / "a" / "v.mp4", b"1234")
    put(tmp_path / "a" / "empty.txt", "")
    put(tmp_path / "a" / "large.txt", "y" * 30_000)
    put(tmp_path / "a" / "_hidden" / "no.txt", "no")
    put(tmp_path / "a" / ".no.txt", "no")
    rows = spark.read.format("memory_files").options(size=4000, overlap=200, longest=20_000, maxPartitionBytes=5000).load(str(tmp_path / "a"))
    got = {}
    for r in rows.orderBy("path", "part").collect():
        got.setdefault(Path(r.path).name, []).append(r)
    assert set(got) == {"long.md", "short.TXT", "bytes.txt", "code.py", "other.go", "p.pdf", "bad.pdf", "v.mp4", "large.txt"}
    assert [r.content for r in got["long.md"]] == list(chunk.smart_chunks(long, 4000, 200)) and [r.part for r in got["long.md"]] == list(range(len(got["long.md"])))
    assert [r.content for r in got["short.TXT"]] == ["one\n\ntwo"] and got["bytes.txt"][0].content == "x\ufffd"
    assert [(r.chunk_type, r.start_line, r.end_line) for r in got["code.py"]] == [("code_function", 3, 4), ("code_function", 6, 7)]
    assert [(r.chunk_type, r.content) for r in got["other.go"]] == [("code_block", "one"), ("code_block", "two")]
    assert [(got[n][0].chunk_type, got[n][0].content) for n in ("p.pdf", "bad.pdf", "v.mp4")] == [("pdf_page", "hello"), ("pdf_metadata", "[pdf file, 4 bytes]"), ("video_metadata", "[video file, 4 bytes]")]
    large = got["large.txt"][0]
    assert (large.content, large.error, large.size) == (None, "file too large: 30000 bytes (max 20000)", 30_000)
    assert got["code.py"][0].tags == ["file:code.py", "chunk_type:code_function"] and got["code.py"][0].source == "file_upload:code.py"
    only = spark.read.format("memory_files").option("pathGlobFilter", "*.go").load(str(tmp_path / "a"))
    assert {Path(r.path).name for r in only.collect()} == {"other.go"}
    assert spark.read.format("memory_files").load(f"file://{tmp_path}/a/short.TXT").count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("memory_files").load(str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_transcripts_are_read_once_however_they_are_split(spark, tmp_path, size):
    files.register(spark)
    texts = ["", "x", "é" * 30, "line\nbreak", "y" * 500, "last"]
    put(tmp_path / "one.jsonl", lines(*({"role": "user", "content": t, "session_id": i % 2} for i, t in enumerate(texts)), "", "no json", "[1]", {"role": "user"}, {"role": 1, "content": "z"}, {"role": "tool", "content": [{"type": "text", "text": "a"}, {"type": "image"}, 5, {"type": "text", "text": "b"}]}))
    put(tmp_path / "two.jsonl", lines({"role": "assistant", "content": "no end"})[:-1])
    put(tmp_path / "odd.jsonl", b'{"role": "user", "content": "half \\ud800"}\n{"role": "user", "content": "\xff"}\n\n')
    rows = spark.read.format("transcripts").option("maxPartitionBytes", size).load(str(tmp_path))
    got = [(Path(r.path).name, r.session, r.content) for r in rows.orderBy("path", "at").collect()]
    odd, two = (str(tmp_path / n) for n in ("odd.jsonl", "two.jsonl"))
    assert got == [
        ("odd.jsonl", odd, "half ?"), ("odd.jsonl", odd, "\ufffd"),
        *(("one.jsonl", str(i % 2), t) for i, t in enumerate(texts)), ("one.jsonl", str(tmp_path / "one.jsonl"), "a\nb"), ("two.jsonl", two, "no end"),
    ]
    if size == 7:
        assert rows.rdd.getNumPartitions() > 20
        tail = ingest.transcript(rows, "session", "at", keep=2).orderBy("session", "at").collect()
        assert [(r.session, r.content) for r in tail if r.session in "01"] == [("0", "é" * 30), ("0", "y" * 500), ("1", "line\nbreak"), ("1", "last")]


def test_a_stream_of_files_reads_none_again(spark, tmp_path):
    files.register(spark)
    inbox = tmp_path / "in"
    put(inbox / "a.txt", "first", 60)
    put(inbox / "b.txt", "second", 50)

    def run():
        stream = spark.readStream.format("memory_files").option("lag", 5).load(str(inbox))
        out = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        out.awaitTermination()
        return sorted(r.content for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())

    assert run() == ["first", "second"]
    assert run() == ["first", "second"]
    put(inbox / "c.txt", "third", 20)
    put(inbox / "d.txt", "at the same moment", 20)
    os.utime(inbox / "d.txt", ns=((inbox / "c.txt").stat().st_mtime_ns,) * 2)
    put(inbox / "young.txt", "too young", -100)
    assert run() == ["at the same moment", "first", "second", "third"]
    put(inbox / "young.txt", "old enough", 6)
    assert run() == ["at the same moment", "first", "old enough", "second", "third"]


def test_table_functions_give_the_operators_rows(spark):
    table_functions.register(spark)
    rows = [(1, "a b. " * 900), (2, None), (3, ""), (4, "é" * 3000), (5, "# h\n\nx\n\n\ny"), (5, "# h\n\nx\n\n\ny")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    docs.createOrReplaceTempView("tf_docs")
    cut = lambda t, *a: [tuple(r) for r in spark.sql(f"SELECT doc_id, f.* FROM tf_docs, LATERAL {t} f").collect()]
    assert sorted(cut("smart_chunks(text, 1000, 100)")) == sorted(tuple(r) for r in chunk.chunked(docs, "doc_id", "text", 1000, 100).collect())
    assert sorted(cut("code_blocks(text)")) == sorted(tuple(r) for r in chunk.blocks(docs, "doc_id", "text").collect())
    spark.createDataFrame([("def f():\n    return 1\n\nx = 2\n",)], "c string").createOrReplaceTempView("tf_code")
    assert [tuple(r) for r in spark.sql("SELECT f.* FROM tf_code, LATERAL code_blocks(c, 'python') f").collect()] == [(0, "def f():\n    return 1", 1, 2)]
    facts = spark.sql("SELECT doc_id, place, fact, category, tags FROM tf_docs, LATERAL sentence_facts(text) WHERE doc_id IN (1, 2) ORDER BY place").collect()
    assert len(facts) == 50 and tuple(facts[0]) == (1, 0, "a b.", "events", [])
    failing = table_functions.udtf(table_functions.facts_by(lambda _: "no json"))
    spark.udtf.register("failing_facts", failing)
    assert spark.sql("SELECT f.* FROM tf_docs, LATERAL failing_facts(text) f").collect() == []
    for bad in ("smart_chunks(text, 3, 0)", "smart_chunks(text, 100, 100)", "smart_chunks(text, doc_id, 0)", "smart_chunks(doc_id)", "code_blocks(doc_id)"):
        with pytest.raises(Exception, match="must be"):
            cut(bad)


def test_conversation_chunks(spark):
    table_functions.register(spark)
    rows = [(k, t, "user" if t % 2 else "assistant", None if t == 3 else f"{k}-{t} " * (t % 7 * 30)) for k in (1, 2, None) for t in range(40)] + [(3, 0, None, None), (2, 5, "assistant", "a tie"), (2, 5, "assistant", "a tie")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string").withColumn("part", F.lit("clash"))
    df.repartition(5).createOrReplaceTempView("tf_turns")
    got = {}
    for r in spark.sql("SELECT * FROM conversation_chunks(TABLE(tf_turns), 'conv_id', 'turn', 700, 60)").collect():
        got.setdefault(r.conv_id, []).append((r.part, r.chunk))
    assert set(got) == {1, 2, 3, None}
    for k, found in got.items():
        text = "".join(f"{r or ''}: {c or ''}\n" for _, _, r, c in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2] or "", x[3] or "")))
        assert sorted(found) == list(enumerate(chunk.smart_chunks(text, 700, 60)))
    assert spark.sql("SELECT * FROM conversation_chunks(TABLE(SELECT * FROM tf_turns WHERE turn < 0), 'conv_id', 'turn')").collect() == []
    with pytest.raises(Exception, match="must name a column"):
        spark.sql("SELECT * FROM conversation_chunks(TABLE(tf_turns), 'conv', 'turn')")


def test_queries_over_sources_and_functions(spark):
    rows = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, SF).collect())
    assert rows("transcript_source") == rows("transcript_tail")
    assert rows("smart_split_lateral") == rows("smart_split")
    assert rows("code_chunks_lateral") == rows("code_chunks")
    turns = {}
    for r in views.sessions(spark, SF).collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.content))
    want = sorted((k, n, len(c)) for k, ts in turns.items() for n, c in enumerate(chunk.smart_chunks("".join(f"{r}: {c}\n" for _, r, c in sorted(ts)), 1000, 100)))
    assert rows("conversation_chunks") == want
