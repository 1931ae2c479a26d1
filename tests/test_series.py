"""Window operators against pandas on random and hand-made series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import series
from shelfcast.plans import features as plans


def frame(spark, data: dict[str, list], price=None):
    rows = []
    for item, sales in data.items():
        for i, s in enumerate(sales):
            p = price(item, i) if price else 2.0 + (i // 7) % 3
            rows.append(("S1", item, i + 1, s, p))
    return spark.createDataFrame(
        rows, "store_id string, item_id string, d int, sales int, sell_price double")


def random_sales(n, seed=0, zero=0.6):
    rng = np.random.default_rng(seed)
    return [int(x) for x in rng.poisson(5, n) * (rng.random(n) > zero)]


def expected(sales: list[int]) -> pd.DataFrame:
    lag = pd.Series(sales, dtype=float).shift(28)
    row = pd.Series(range(1, len(sales) + 1), dtype=float)
    masked = lag.where(lag > 0).rolling(28, min_periods=1).mean().ffill()
    return pd.DataFrame({
        "lag_28": lag,
        "roll_mean_7_lag_28": lag.rolling(7).mean(),
        "roll_mean_28_lag_28": lag.rolling(28).mean(),
        "masked_roll_mean_28_lag_28": masked,
        "ema_lag_28": lag.ewm(alpha=0.1, adjust=True, ignore_na=True).mean().where(lag.notna()),
        "days_since_last_sale_lag_28": (row - row.where(lag > 0).ffill()).fillna(0),
    })


@pytest.mark.parametrize("max_rows", [None, 500])
def test_horizon_features_match_pandas(spark, max_rows):
    data = {"A": random_sales(300), "B": random_sales(200, 1, 0.95), "Z": [0] * 120,
            "ONE": [5], "SHORT": random_sales(40, 2), "CONST": [3] * 100}
    df = plans.horizon_features(frame(spark, data), max_rows=max_rows, drop_incomplete=False)
    got = df.toPandas()
    for item, sales in data.items():
        part = got[got.item_id == item].sort_values("d").reset_index(drop=True)
        want = expected(sales)
        for c in want.columns:
            np.testing.assert_allclose(part[c].astype(float), want[c], atol=1e-9, err_msg=f"{item}.{c}")


def test_incomplete_rows_are_dropped(spark):
    df = plans.horizon_features(frame(spark, {"A": random_sales(80)}))
    assert df.agg(F.min("d")).first()[0] == 56
    assert plans.horizon_features(frame(spark, {"A": random_sales(50)})).count() == 0


def test_zero_and_missing_prices_give_null(spark):
    df = plans.horizon_features(
        frame(spark, {"A": [1] * 60, "N": [1] * 60},
              price=lambda item, i: None if item == "N" else 0.0), drop_incomplete=False)
    row = df.agg(F.count("price_momentum_7d"), F.count("price_norm")).first()
    assert tuple(row) == (0, 0)


@pytest.mark.parametrize("span,n", [(7, 400), (28, 400), (7, 3000)])
def test_weighted_moments_match_pandas(spark, span, n):
    sales = random_sales(n, span)
    df = frame(spark, {"A": sales}).withColumn("x", F.when(F.col("d") > 5, F.col("sales")))
    got = series.with_ewm(df, "x", series.span_alpha(span), "m", "s").orderBy("d").toPandas()
    x = pd.Series(sales, dtype=float).where(pd.Series(range(n)) >= 5)
    e = x.ewm(span=span, adjust=True)
    np.testing.assert_allclose(got.m, e.mean(), atol=1e-8)
    np.testing.assert_allclose(got.s, e.std(), atol=1e-6)


def test_weighted_std_of_constant_and_first_row(spark):
    got = series.with_ewm(frame(spark, {"A": [4] * 30}), "sales", 0.25, "m", "s").orderBy("d").toPandas()
    assert np.isnan(got.s[0]) and abs(got.s[1:]).max() < 1e-6 and (abs(got.m - 4) < 1e-9).all()


def test_short_blocks_equal_one_block(spark, monkeypatch):
    df = frame(spark, {"A": random_sales(900, 3)})
    whole = series.with_ewm(df, "sales", 0.5, "m", max_rows=10).orderBy("d").toPandas()
    monkeypatch.setattr(series, "ewm_block_rows", lambda alpha: 100)
    cut = series.with_ewm(df, "sales", 0.5, "m").orderBy("d").toPandas()
    np.testing.assert_allclose(cut.m[:500], whole.m[:500], atol=1e-9)
    want = pd.Series(random_sales(900, 3), dtype=float).ewm(alpha=0.5).mean()
    np.testing.assert_allclose(cut.m, want, atol=1e-9)


def test_feature_plan_moves_rows_once(spark):
    df = frame(spark, {"A": random_sales(100)})
    plan = plans.horizon_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(store_id") == 1
    assert "Python" not in plan
