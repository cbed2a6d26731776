import duckdb
import pytest

import __spark_entry__ as entry
from kinlink.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), got.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
