"""Every query against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from speechframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir, con):
    got = entry.queries()[name](spark, sf_dir)
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(x[0] for x in want.description)
    assert columns == sorted(got.columns)
    order = [[x[0] for x in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert rows == sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
