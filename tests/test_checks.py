"""Every registered query against its SQL on the smallest data folder."""

import math
from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from canvasser.plans.bindings import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def bag(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in CHECKS:
        rel = engine.sql(CHECKS[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert bag(got, df.columns) == bag(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(CHECKS) <= set(QUERIES)
