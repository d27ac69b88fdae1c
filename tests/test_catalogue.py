"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from tessitura.plans import catalogue, production  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_query_has_sql():
    assert set(catalogue.ORACLE_SQL) == set(catalogue.QUERIES)


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
