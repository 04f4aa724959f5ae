"""Catalogue queries against their DuckDB texts over whole tables."""

import duckdb
import pytest

from faircart.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def told(value):
    if value is None or isinstance(value, float) and value != value:
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    numbers = [[float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r] for r in rows]
    return sorted(tuple(told(r[i]) for i in order) for r in numbers)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry_names_the_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["p_partkey", "p_brand", "cents", "lowest_of"]
