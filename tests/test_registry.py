"""Every query against its SQL in a second engine."""

import duckdb
import pytest

import __spark_entry__
from needlework.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == sorted(repr([r[columns.index(c)] for c in names]) for r in found.fetchall())


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
