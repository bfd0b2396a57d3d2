"""The queries that SQL can express, held against it, on the table and on awkward rows."""

import duckdb
import pytest

from needlework.llm import embedding_dedup, quality_rules, registry, url_filter
from tests.llm.fixtures import documents, frame
from tests.llm.test_more_operators import embedding_rows, pages

TABLES = ("documents", "pages", "embeddings")


def compare(df, names, sql, duck):
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(names)
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr([r[columns.index(c)] for c in names]) for r in found.fetchall())


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    compare(df, df.columns, registry.oracle_sql()[name], duck)


def test_quality_rules_equal_sql_on_awkward_rows(spark):
    rows = documents() + [(5000 + i, " ".join(f"w{i}###{j}" for j in range(30 + i)), None, "bad", None, None, None) for i in range(40)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    df = quality_rules.judge(frame(spark, rows))
    compare(df, df.columns, registry.oracle_sql()["op3_quality_rules"], duck)
    assert df.where("not kept and not base_failed").count() > 0


def test_url_filter_equals_sql_with_links(spark):
    rows = [
        (1, "http://good.org/", '<a href="http://a.net/x">a</a>'), (2, "http://a.net/", '<a href="//b.net">b</a><a href="http://x.com/de/">x</a>'),
        (3, "http://b.net/", None), (4, "http://x.com/de/1", '<a class=q href=http://b.net/>b</a>'), (5, "http://c.net/", "<a href='http://x.com/'>x</a>"), (6, None, ""),
    ]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    df = url_filter.judge(pages(spark, rows)).drop("trust", "distrust")
    compare(df, df.columns, registry.oracle_sql()["op7_url_filter"], duck)
    assert {r["page_id"] for r in df.where("verdict = 'block' and rule is null").collect()} == {5}


def test_embeddings_equal_sql(spark):
    rows = [r for r in embedding_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    duck = duckdb.connect()
    duck.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    duck.executemany("INSERT INTO embeddings VALUES (?, ?)", [r for r in rows if r[0] not in (2007, 2008)])
    df = embedding_dedup.near_duplicates(spark.createDataFrame([r for r in rows if r[0] not in (2007, 2008)], "vec_id long, embedding array<float>"))
    compare(df, df.columns, registry.oracle_sql()["op8_embedding_dedup"], duck)
