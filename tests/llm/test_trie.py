"""The trie of conversations against a plain version, and the running totals that name its prefixes."""

import hashlib
import zlib

import pytest

from memlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(m[:-1] == n for m in members if m)]
        ends = sorted(c for c in who if len(paths[c]) == len(node))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(1 for m in members if m and m[:-1] == node), len(childless),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def ours(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)


def test_trie_of_odd_rows(spark):
    rows = []
    for c in (0, 1, 2, 3, 7, 11, 99, 100, 101, 142, 150, 5005, 7300, -5, -100, -107, 2**40 + 3):
        for t in range(c % 9):
            rows.append((c, t, "user" if t % 2 else None, ["a", "bb", "", None, "ünï 😀"][(t + c // 50) % 5]))
    rows += [(7, 3, "user", "tied"), (7, 3, "user", "tied"), (7, 3, "assistant", "x"), (8, None, None, None), (8, 1, "user", "late"), (None, 0, "user", "nobody's")]
    rows += [(100, t, "user", "long " * t) for t in range(40)]
    got = ours(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)


def test_trie_of_one_long_conversation_and_a_hot_beginning(spark):
    rows = [(200, t, "user", f"turn {t % 7}") for t in range(1500)] + [(300 + c, t, "user", "same" if t < 3 else f"own {c % 4}") for c in range(0, 300) for t in range(4)]
    got = ours(spark.createDataFrame(rows, SCHEMA).repartition(5))
    expected = brute([r for r in rows if r[0] != 200])
    assert [g for g in got if g[1] > 1 and g[0] != 200] == [e for e in expected if e[1] > 1]  # the first turns' parent, the root, is 200's here
    deep = {g[1]: g for g in got if g[0] == 200}
    assert len(deep) == 1501 and deep[0][3] == 301
    assert deep[1500][7] == hashlib.sha256(b"200").hexdigest() and deep[1][2] == 200 and deep[1][4:7] == (1, 1, 0)


def test_trie_of_an_empty_table_and_of_clashing_columns(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    odd = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA + ", depth int, k1 long, _range string, total int")
    assert ours(odd) == brute(rows)


def test_trie_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    df = trie.op12_conversation_trie(spark, "/root/testdata/sf0.001")
    cursor = con.execute(trie.ORACLE_SQL)
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
    assert {t for _, t in df.dtypes} == {"bigint", "string"}
