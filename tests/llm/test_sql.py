"""Operators that SQL can express, row by row against their SQL, on given tables and on odd rows."""

import duckdb
import pytest

from perron.llm import registry

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n"), (5, "word " * 3000), (6, "x" * 20_000), (7, "x" * 20_000), (8, "é 😀 İ"), (9, "Same\n\nsame\r\nSame\nSame"), (10, "A B c"), (11, "one"), (12, "ONE")]
PAGES = [(3, "http://a/b", "p" * 100), (1, "http://a/b", "p" * 100), (2, None, None), (4, "", "p" * 99), (5, "http://c", "p" * 99), (6, "http://c", "é" * 50), (7, "http://d", "é" * 50)]


def agree(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'' if folder == SF else '/*.parquet'}')")
    df, r = registry.queries()[name](spark, folder), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    at = [r.columns.index(c) for c in columns]
    assert sorted(str([x[c] for c in columns]) for x in df.collect()) == sorted(str([x[i] for i in at]) for x in r.fetchall())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_given_tables(spark, name):
    agree(spark, name, SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_odd_rows(spark, odd, name):
    agree(spark, name, odd)
