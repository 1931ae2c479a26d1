"""A feature table continued by days against one built from all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from shelfcast.plans import features, increments

COLUMNS = ["store_id", "item_id", "d", "sales", "sell_price", "lag_28", "price_norm", "price_momentum_7d",
           "price_momentum_28d", "roll_mean_7_lag_28", "roll_mean_28_lag_28", "masked_roll_mean_28_lag_28",
           "ema_lag_28", "days_since_last_sale_lag_28"]


def prepared(spark):
    rng = random.Random(4)
    rows = []
    for item, first, sold, last in [("often", 1, 0.6, 240), ("rare", 1, 0.01, 240), ("never", 1, 0.0, 240),
                                    ("once", 1, None, 240), ("late", 190, 0.4, 240), ("ended", 1, 0.3, 205),
                                    ("unborn", 215, 0.5, 240), ("short", 170, 0.2, 240)]:
        for d in range(first, last + 1):
            units = int(d == 20) if sold is None else (rng.random() < sold) * rng.randrange(1, 9)
            price = None if item == "rare" and d < 30 else 2.0 + d // 50 + rng.random()
            rows.append(("s", item, d, int(units), price))
    return spark.createDataFrame(rows, "store_id string, item_id string, d int, sales int, sell_price double")


def rows_of(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in df.select(*COLUMNS).collect()), key=str)


def test_continued_table_equals_a_full_one(spark, tmp_path):
    df, path = prepared(spark), str(tmp_path / "table")
    want = rows_of(features.horizon_features(df))
    increments.start(df.filter("d <= 200"), path)
    assert rows_of(increments.read(spark, path)) == rows_of(features.horizon_features(df.filter("d <= 200")))
    increments.append(df.filter("d = 201"), path)
    increments.append(df.filter("d between 202 and 218"), path)
    increments.append(df.filter("d > 300"), path)                       # no rows
    increments.append(df.filter("d > 218"), path)
    assert rows_of(increments.read(spark, path)) == want
    increments.append(df.filter("d > 218"), path)                       # once more
    assert rows_of(increments.read(spark, path)) == want
    with pytest.raises(ValueError):
        increments.append(df.filter("d <= 100"), path)


def test_append_reads_the_state_only(spark, tmp_path):
    df, path = prepared(spark), str(tmp_path / "table")
    increments.start(df.filter("d <= 200"), path)
    tail = spark.read.parquet(f"{path}/tail")
    assert tail.groupBy("store_id", "item_id").count().agg(F.max("count")).first()[0] == increments.TAIL_ROWS
    rows, after = increments.continued(df.filter("d > 200"), tail, spark.read.parquet(f"{path}/carry"))
    for plan in (rows, after):
        assert f"{path}/days" not in plan._jdf.queryExecution().toString()
