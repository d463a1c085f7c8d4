"""Every query against its SQL on the smallest tables, and the entry points without the training-data operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from memlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    theirs = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_training_part(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in ("memlake", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(root / p) if p.endswith(".py") else None
    import shutil

    shutil.copytree(root / "memlake", tmp_path / "memlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    (tmp_path / "__spark_entry__.py").unlink()
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split() == [str(len(registry.QUERIES)), "False"], out.stderr
