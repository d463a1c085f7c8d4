"""The audit of filters against a plain version and its SQL."""

import re
from itertools import permutations

import duckdb

from memlake.llm import audit


def brute(docs, labels):
    def fails(i, t, all_):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A"} if len(w) < 100 else set()
        out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        out |= {"D"} if re.search("[#$%&*|]", t) else set()
        return out | ({"E"} if i is not None and any(o is not None and o < i and u == t for o, u, _ in all_) else set())

    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    marked = [(i, lang, fails(i, t, docs)) for i, t, lang in docs]
    out = []
    for part in {lang for _, lang, _ in marked}:
        own = [(i, f) for i, lang, f in marked if lang == part]
        rows, removed_by = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                reached = [(i, m) for i, m in own if not m & set(order[:step])]
                lost = [i for i, m in reached if f in m]
                removed_by[f] += len(lost)
                hit = sum(f in m for _, m in own)
                rows.append(["".join(order), step + 1, len(reached) - len(lost), len(lost), hit - len(lost), sum(m == {f} for _, m in own), sum(i in good for i in lost), sum(i in toxic for i in lost), f])
        out += [(part, *r[:-1], removed_by[r[-1]]) for r in rows]
    return sorted(out)


DOCS = [
    (1, " ".join(f"w{i}" for i in range(120)), "en"), (2, " ".join(f"w{i}" for i in range(120)), "de"), (2, " ".join(f"w{i}" for i in range(120)), "de"), (3, "A B C", "en"), (4, None, "en"), (5, "", None),
    (6, "same " * 200, "en"), (7, "same " * 200, ""), (None, "same " * 200, "en"), (8, "a b # c", "fr"), (9, "\x1f\x0bx", "fr"), (10, "w " * 99 + "É" * 20, "fr"), (1, "x" * 5000 + " y" * 3000, "en"),
    (11, " ".join(f"W{i}|" for i in range(150)), "en"), (12, " ".join(f"W{i}|" for i in range(150)), "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (12, 1, None), (None, 1, 1), (6, 1, 0), (10, None, 1)]


def test_audit_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id long, text string, lang string, n int, mask string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.interactions(docs, labels).collect()))
    assert got == brute(DOCS, LABELS)
    assert len(got) == 600 * 4


def test_labels_are_never_broadcast(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id long, text string, lang string, n int, mask string")
    plan = audit.failures(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(none, labels).collect() == []
    one = audit.interactions(spark.createDataFrame([(1, "a", "en")], none.schema), labels).collect()
    assert len(one) == 600 and sum(r["removed"] for r in one) == 120


def test_audit_of_a_group_that_holds_most_rows(spark):
    docs = [(i, "copy", "en") for i in range(400)] + [(400 + i, f"other {i}", "en") for i in range(100)]
    got = audit.interactions(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    first = {r["filter_order"]: r for r in got.where("step = 1").collect()}
    assert first["EABCD"]["removed"] == 399 and first["EABCD"]["good_lost"] == 0 and first["ABCDE"]["good_lost"] == 1


def test_audit_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = audit.op13_filter_interactions(spark, "/root/testdata/sf0.001")
    cursor = con.execute(audit.ORACLE_SQL)
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
