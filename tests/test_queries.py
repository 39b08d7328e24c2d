"""Every query with SQL against DuckDB on the smallest tables, and the entry point without the optional part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sagebrook import plans

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v).replace(" 00:00:00", "")


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, D)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part():
    code = "import sys; sys.modules['sagebrook.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True)
