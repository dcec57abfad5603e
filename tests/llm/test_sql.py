"""Queries against their SQL."""

import duckdb
import pandas as pd
import pytest

from watchgrid.llm import caps, catalog, common

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = got.columns[0]
    as_text = lambda df: df[sorted(df.columns)].sort_values(key).reset_index(drop=True).astype(object).where(lambda x: x.notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).astype(str)
    pd.testing.assert_frame_equal(as_text(got), as_text(want))


def test_caps_of_repeated_ids(spark):
    """A key in two labels, or with two vectors, is two vectors, whose links do not add up."""
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (1, [0.0, 1.0], 1), (3, [0.01, 1.0], 1), (4, [0.02, 1.0], 1), (None, [1.0, 0.0], 0), (5, [-1.0, 0.0], 0)]
    df = common.written(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in caps.link(df).collect())
    assert got == [(0, 0, None, None), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True)]
