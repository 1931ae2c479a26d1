"""Retail tables from order lines that are read once."""

import pytest
from pyspark.sql import functions as F

from shelfcast.registry import tables as t
from shelfcast.sources import starschema

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "AFRICA"), (1, "ASIA")]),
    "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 1)]),
    "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 1), (None, 1)]),
    "part": ("p_partkey long, p_type string, p_size int", [(1, "TIN", 1), (2, "TIN", 9), (3, "BRASS", 50), (None, "TIN", 1)]),
    "lineitem": ("l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string", [
        (1, 1, 2.0, 10.0, "1995-01-02"), (2, 1, 3.0, 9.0, "1995-01-02"), (1, 1, 1.0, 8.0, "1995-01-05"),
        (3, 2, 4.0, None, "1995-01-03"), (3, 2, 0.0, 5.0, "1995-01-12"), (None, 2, 7.0, 7.0, "1995-01-04"),
        (9, 2, 7.0, 7.0, "1995-01-15")]),
}


@pytest.fixture
def folder(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        df = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            df = df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_totals_of_the_lines(spark, folder):
    sold = {(r["store_id"], r["item_id"], r["d"]): r["sales"] for r in starschema.daily_sales(spark, folder).collect()}
    assert sold == {("AFRICA", "TIN_001", 1): 5, ("AFRICA", "TIN_001", 4): 1,
                    ("ASIA", "BRASS_005", 2): 4, ("ASIA", "BRASS_005", 11): 0}
    prices = {(r["store_id"], r["wm_yr_wk"]): r["sell_price"] for r in starschema.prices(spark, folder).collect()}
    assert prices == {("AFRICA", 1): 3.0, ("ASIA", 1): None, ("ASIA", 2): None}
    assert starschema.last_day(spark, folder).first()[0] == 14          # of a line without a part, too
    long = t.prepared(spark, folder)
    assert long.count() == 28 and long.agg(F.sum("sales")).first()[0] == 10


def test_lines_are_read_once_and_parts_stay_off_the_driver(spark, folder):
    plan = t.prepared(spark, folder)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "part.parquet" not in plan
    lines = starschema.retail_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_partkey" in lines


def test_new_lines_give_new_totals(spark, folder):
    assert starschema.daily_sales(spark, folder).count() == 4
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    more = lines.filter("l_extendedprice = 8").withColumn("l_quantity", F.lit(30.0)).localCheckpoint()
    more.write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert starschema.daily_sales(spark, folder).agg(F.max("sales")).first()[0] == 31
