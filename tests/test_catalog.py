import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from epistride.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x == y or (x is not None and y is not None and abs(float(x) - float(y)) <= 2e-5)
    return x == y


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(name, spark, db):
    df = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(([r[c] for c in sorted(columns)] for r in df.collect()), key=str)
    rows = sorted(([r[columns.index(c)] for c in sorted(columns)] for r in want.fetchall()), key=str)
    assert len(got) == len(rows)
    assert all(same(x, y) for a, b in zip(got, rows, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_catalog_stands_without_the_optional_part():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op1_') for n in q)"
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.abspath(entry.__file__))}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=120)


def test_nothing_but_the_entry_knows_the_optional_part():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(f"{root}/epistride"):
        if "/llm" not in folder:
            assert not any("epistride.llm" in open(f"{folder}/{f}").read() for f in files if f.endswith(".py"))
