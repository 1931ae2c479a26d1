"""Schemas and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES = ("store_id", "item_id")

# --- fixed values: column names, quantile levels and stores that outside tables rely on ---
SALES_IDS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
CATEGORY_COLUMNS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
HORIZON_COLUMNS = [
    "item_id", "dept_id", "cat_id", "store_id", "state_id",
    "wday", "month", "sell_price", "price_norm",
    "snap_CA", "snap_TX", "snap_WI",
    "price_momentum_7d", "price_momentum_28d",
    "lag_28", "roll_mean_7_lag_28", "roll_mean_28_lag_28",
    "masked_roll_mean_28_lag_28", "ema_lag_28", "days_since_last_sale_lag_28",
]
LEGACY_COLUMNS = [
    "item_id", "dept_id", "cat_id", "store_id", "state_id",
    "wday", "month", "sell_price", "price_norm",
    "roll_mean_7", "roll_mean_28", "snap_CA", "snap_TX", "snap_WI",
]
QUANTILES = [0.005, 0.025, 0.165, 0.25, 0.5, 0.75, 0.835, 0.975, 0.995]
RETAIL_STORES = ["CA_1", "CA_2", "CA_3", "CA_4", "TX_1", "TX_2", "TX_3", "WI_1", "WI_2", "WI_3"]
NOT_FEATURES = ["id", "d", "date", "sales", "wm_yr_wk", "weight", "scale_factor"]
KNOWN_CATEGORICALS = [
    "item_id", "dept_id", "cat_id", "store_id", "state_id",
    "wday", "month", "snap_active", "is_weekend", "has_event",
]
# --- end of fixed values ---

HORIZON = 28
HISTORY_DAYS = 84      # sales kept per series for the weekday profile and the charts
STORE_DAYS = 112       # feature rows kept per series in the feature store
HORIZON_TRAIN_COLUMNS = HORIZON_COLUMNS + ["horizon_day", "target_wday"]
LEGACY_HORIZON_COLUMNS = LEGACY_COLUMNS + ["horizon_day"]
STORE_ROW_COLUMNS = ["d", "sales"] + HORIZON_COLUMNS

CALENDAR = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("d", T.StringType()),
    T.StructField("wday", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("event_name_1", T.StringType()),
    T.StructField("snap_CA", T.IntegerType()),
    T.StructField("snap_TX", T.IntegerType()),
    T.StructField("snap_WI", T.IntegerType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
])
PRICES = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("sell_price", T.DoubleType()),
])
LEADERBOARD = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("Popularity", T.DoubleType()),
    T.StructField("Volatility", T.DoubleType()),
    T.StructField("Sparsity", T.DoubleType()),
    T.StructField("store_id", T.StringType()),
])
MAPPING = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("code", T.IntegerType()),
])
PRODUCTS = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
])


def wide_sales_schema(columns: list[str]) -> T.StructType:
    """Ids as strings, every day column as int, in the order the file has them."""
    return T.StructType([
        T.StructField(c, T.StringType() if c in SALES_IDS else T.IntegerType()) for c in columns
    ])


def require_columns(df, required: list[str]) -> None:
    """Raise when a table lacks columns a job needs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
