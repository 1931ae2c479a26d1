"""Feature tables.  One hash exchange on the series key feeds every window of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions import scalars, series
from shelfcast.sources.schemas import SERIES


def attach_calendar(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Left join on the day.  A calendar is broadcast by its size, which days bound."""
    return sales.join(calendar, "d", "left")


def attach_prices(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join on (store, item, week).

    With both sides hashed by (store, item) the join leaves the rows where the windows need
    them.  Sales that come out of `unpivot_days` or `sales_long` are hashed that way already.
    """
    return sales.join(prices.repartition(*SERIES), [*SERIES, "wm_yr_wk"], "left")


def horizon_features(df: DataFrame, max_rows: int | None = None,
                     drop_incomplete: bool = True) -> DataFrame:
    """Lag-28 demand features, price features and the recency counter.

    Rolling sums are differences of running integer totals, so a row costs the same for any
    window length.
    """
    w = series.by_day()
    run = series.running(w)
    lagged = F.col("lag_28")
    sold = lagged > 0

    df = df.withColumns({
        "price_momentum_7d": series.momentum("sell_price", 7, w),
        "price_momentum_28d": series.momentum("sell_price", 28, w),
        "lag_28": F.lag("sales", 28).over(w),
        "_row": F.row_number().over(w),
    })
    df = df.withColumn("price_norm", series.max_normalised("sell_price"))
    df = df.withColumns({
        "_n": F.count(lagged).over(run),
        "_sum": F.sum(lagged).over(run),
        "_sold_n": F.count(F.when(sold, 1)).over(run),
        "_sold_sum": F.coalesce(F.sum(F.when(sold, lagged)).over(run), F.lit(0)),
        "_sold_row": F.last(F.when(sold, F.col("_row")), ignorenulls=True).over(run),
    })
    df = df.withColumn("_sum", F.coalesce("_sum", F.lit(0)))
    sold_n = series.window_difference("_sold_n", 28, w)
    df = df.withColumns({
        "roll_mean_7_lag_28": F.when(
            series.window_difference("_n", 7, w) == 7,
            series.window_difference("_sum", 7, w) / 7),
        "roll_mean_28_lag_28": F.when(
            series.window_difference("_n", 28, w) == 28,
            series.window_difference("_sum", 28, w) / 28),
        "_masked": F.when(sold_n > 0, series.window_difference("_sold_sum", 28, w) / sold_n),
    })
    df = df.withColumns({
        "masked_roll_mean_28_lag_28": series.forward_fill("_masked", w),
        "days_since_last_sale_lag_28": F.coalesce(F.col("_row") - F.col("_sold_row"), F.lit(0)),
    })
    df = df.drop("_row", "_n", "_sum", "_sold_n", "_sold_sum", "_sold_row", "_masked")
    df = series.with_ewm(df, "lag_28", 0.1, mean="ema_lag_28", max_rows=max_rows)
    if drop_incomplete:
        df = df.dropna(subset=["roll_mean_28_lag_28", "price_momentum_28d"])
    return df


def legacy_features(df: DataFrame, drop_incomplete: bool = True) -> DataFrame:
    """The smaller set the recursive models use: two rolling means and the relative price."""
    w = series.by_day()
    df = df.withColumn("_lag", F.lag("sales", 28).over(w))
    df = df.withColumns({
        "roll_mean_7": series.rolling_mean("_lag", 7, w),
        "roll_mean_28": series.rolling_mean("_lag", 28, w),
    }).withColumn("price_norm", series.max_normalised("sell_price")).drop("_lag")
    return df.dropna(subset=["roll_mean_28"]) if drop_incomplete else df


def department_features(sales: DataFrame) -> DataFrame:
    """Department-day totals with their lag-28 rolling means, one row per store, dept and day."""
    keys = ("store_id", "dept_id")
    totals = sales.groupBy(*keys, "d").agg(F.sum("sales").alias("dept_daily_sales"))
    w = series.by_day(*keys)
    lagged = totals.withColumn("_lag", F.lag("dept_daily_sales", 28).over(w))
    return lagged.select(
        *keys, "d", "dept_daily_sales",
        series.rolling_mean("_lag", 28, w).alias("dept_roll_mean_28"),
        series.rolling_mean("_lag", 7, w).alias("dept_roll_mean_7"))


def extended_features(df: DataFrame, snap_by_state: dict[str, str] | None = None,
                      max_rows: int | None = None, drop_incomplete: bool = True) -> DataFrame:
    """The wide study set: department roll-ups, weighted moments, sparsity, calendar, price."""
    dept = department_features(df).drop("dept_daily_sales")
    df = df.join(dept, ["store_id", "dept_id", "d"], "left")
    w = series.by_day()
    df = df.withColumns({
        "lag_7": F.lag("sales", 7).over(w),
        "lag_28": F.lag("sales", 28).over(w),
        "price_lag_28": F.lag("sell_price", 28).over(w),
        "_zero": F.lag((F.col("sales") == 0).cast("double"), 28).over(w),
    })
    df = df.withColumns({
        "roll_mean_7": series.rolling_mean("lag_28", 7, w),
        "roll_mean_28": series.rolling_mean("lag_28", 28, w),
        "sparsity_ratio_28": series.rolling_mean("_zero", 28, w),
    })
    df = df.withColumn("price_zscore", series.zscore("sell_price")).drop("_zero")
    for span in (7, 28):
        df = series.with_ewm(df, "lag_28", series.span_alpha(span), mean=f"ema_{span}",
                             std=f"ewm_std_{span}", max_rows=max_rows)
    df = df.withColumns({
        "is_weekend": scalars.is_weekend("wday"),
        "snap_active": scalars.snap_active("state_id", snap_by_state),
        "has_event": scalars.has_event("event_name_1"),
        "price_change_ratio": series.change_ratio("sell_price", "price_lag_28"),
    })
    return df.dropna(subset=["roll_mean_28"]) if drop_incomplete else df
