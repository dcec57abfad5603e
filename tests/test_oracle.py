"""Every query with SQL against DuckDB."""

import math

import duckdb
import pytest

from watchgrid.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else v.item() if hasattr(v, "item") else v
    near = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return cols, sorted(repr(tuple(near(plain(v)) for v in r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    catalog.QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
