"""Every query with SQL gives DuckDB's rows on the same tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from statflow import queries

SLOW = {"strongly_connected_components", "page_rank"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_query_matches_sql(spark, sf_dir, con, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-5)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"g_means", "decision_tree"}))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
