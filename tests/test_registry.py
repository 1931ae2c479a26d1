"""The registry against DuckDB on the smallest folder."""

import os

import numpy as np
import pytest

from shelfcast.registry.given_sql import ORACLE
from shelfcast.registry.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["horizon_feature_table", "unpivot_wide_sales", "adjusted_forecast", "store_lookup",
           "leaderboard_search", "hold_out_rows", "weighted_moments", "encoded_categories"]
TABLES = ["region", "nation", "supplier", "part", "lineitem", "events"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in columns if got[c].dtype.kind != "f"] + [c for c in columns if got[c].dtype.kind == "f"]
    got = got.sort_values(keys).reset_index(drop=True)
    want = want.sort_values(keys).reset_index(drop=True)
    for c in columns:
        if got[c].dtype.kind in "fi":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, err_msg=c)
        else:
            assert (got[c].fillna("") == want[c].fillna("")).all(), c
