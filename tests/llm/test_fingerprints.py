import hashlib
import re
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F

from memlake.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"[\s\x85\xa0  -     　]+", " ", folded).strip(" ")


def key(text):
    b = canonical(text).encode()
    salt = xxhash.xxh64(b"wide", seed=42).intdigest()
    return f"{xxhash.xxh64(b, seed=42).intdigest():016x}{xxhash.xxh64(b, seed=salt).intdigest():016x}"


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), key(text), key(edited), float(key(text) == key(edited)), float(key(text) == key(after)))
    return out


ROWS = [(1, "Straße  ﬁx"), (2, "STRASSE fix"), (3, "strasse fix "), (7, None), (8, ""), (9, "é" * 5000), (10, "é" * 5000), (12, "abc"), (13, "abd"), (900_000, "x y"), (900_001, "x Y"), (5_000_000_000, "last\n\tone"), (-4, "low")]


def test_against_brute_force(spark):
    out = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.edited_fingerprints(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert out == brute(ROWS)


def test_wide_repeated_and_outlying_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 40)
    wide = [(-6 * 10**18, "low"), (0, "mid"), (6 * 10**18, "high")]
    rows = wide + [(i, f"text {i % 90}") for i in range(1, 900)] + [(2**60, "outlier")]
    assert {r.doc_id: tuple(r)[1:] for r in fp.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    asked = fp.with_next(spark.createDataFrame([(i, "t") for i in range(20_000)] + [(2**60, "t")], SCHEMA), lambda x: x, ())
    sizes = [r["count"] for r in asked.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_001 and max(sizes) < 8000
    same = [(5, f"x{i}") for i in range(600)] + [(6, "y"), (4, "z")]  # one id with many texts
    out = fp.with_next(spark.createDataFrame(same, SCHEMA), lambda x: x, ()).collect()
    after = {r.text: r.next_text for r in out}
    seen, at = [], "y"
    for _ in range(602):
        seen.append(at)
        at = after[at]
    assert at == "y" and sorted(seen) == sorted(t for _, t in same) and seen[-1] == "z"


def test_query_on_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.op2_document_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert out == brute(rows)


@pytest.mark.parametrize("limit", [0, 400_000])
def test_collisions_are_told_apart_by_their_bytes(spark, monkeypatch, limit):
    monkeypatch.setattr(fp, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame([(i, f"text {i % 40}", "clash") for i in range(80)], SCHEMA + ", suffix string")
    rows = fp.fingerprint(docs, bits=4).collect()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.doc_id % 40)
    assert len(rows) == 80 and all(len(x) == 1 for x in by.values()) and len(by) == 40
    out = fp.edited_fingerprints(docs, bits=4).collect()
    assert len({r.fingerprint for r in out}) == 40


def test_empty_repeated_and_null_ids(spark):
    assert fp.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    out = fp.edited_fingerprints(spark.createDataFrame([(1, "a a a"), (1, "a a a"), (None, "b b b"), (1, "c")], SCHEMA)).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out}) == 3
    assert fp.edited_fingerprints(spark.createDataFrame([(3, "only one")], SCHEMA)).first().near_next == 1.0
