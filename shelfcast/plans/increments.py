"""Feature table kept up to date by days: new rows continue a small state per series.

Layout below a folder: `days`, the feature rows partitioned by day; `tail`, the newest raw rows of each
series, and `carry`, one row per series with what reaches further back, both partitioned by the day
they hold for.  Every write replaces whole partitions and reads only those of an earlier day, so an
append that died half-way is simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfcast.functions import series
from shelfcast.operators.ranking import last_rows
from shelfcast.plans.features import horizon_features
from shelfcast.sources.schemas import SERIES

ALPHA = 0.1                 # weight of the newest value in ema_lag_28
# A row looks back 28 + 27 rows; 84 make sure that the last row of a window with a sale is seen whole
# whenever a sale is seen at all.
TAIL_ROWS = 84
COMPLETE = ["roll_mean_28_lag_28", "price_momentum_28d"]


def _weight(k: Column) -> Column:
    """Total weight of k values in an adjusted exponentially weighted mean."""
    return (1.0 - F.pow(F.lit(1.0 - ALPHA), k)) / ALPHA


def carry_of(features: DataFrame) -> DataFrame:
    """One row per series from feature rows that were not cut: number and weighted sum of the lagged
    values, the last masked mean, the recency counter, and the highest price."""
    seen = F.col("lag_28").isNotNull()
    found = features.groupBy(*SERIES).agg(
        F.count("lag_28").alias("n_lag"),
        F.max_by("ema_lag_28", F.when(seen, F.col("d"))).alias("_ema"),
        F.max_by("masked_roll_mean_28_lag_28", "d").alias("masked"),
        F.max_by("days_since_last_sale_lag_28", "d").alias("since"),
        F.coalesce(F.bool_or(F.col("lag_28") > 0), F.lit(False)).alias("sold"),
        F.max("sell_price").alias("price_max"))
    return found.withColumn("weighted", F.coalesce(
        F.col("_ema") * _weight(F.col("n_lag")), F.lit(0.0))).drop("_ema")


def continued(new: DataFrame, tail: DataFrame, carry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the new days, incomplete ones included, and the state after them.

    `new` holds prepared rows of days after the state's; series that the state doesn't know start
    with their first new row, and series without new rows keep their state.
    """
    raw = [*SERIES, "d", "sales", "sell_price"]
    both = tail.select(*raw).withColumn("_new", F.lit(False)).unionByName(
        new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    fresh = horizon_features(both, drop_incomplete=False).filter("_new").drop("_new", "ema_lag_28")
    fresh = series.with_ewm(fresh, "lag_28", ALPHA, mean="_ema")
    w = series.running(series.by_day())
    fresh = fresh.withColumns({
        "_j": F.count("lag_28").over(w), "_i": F.count(F.lit(1)).over(w),
        "_top": F.max("sell_price").over(series.whole())})
    rows = fresh.join(carry, list(SERIES), "left")
    before, n_before = F.coalesce("weighted", F.lit(0.0)), F.coalesce("n_lag", F.lit(0))
    here = F.col("_ema") * _weight(F.col("_j"))
    since = F.col("days_since_last_sale_lag_28")
    rows = rows.withColumns({
        "ema_lag_28": F.when(F.col("lag_28").isNotNull(), (
            before * F.pow(F.lit(1.0 - ALPHA), F.col("_j")) + here) / _weight(n_before + F.col("_j"))),
        "masked_roll_mean_28_lag_28": F.coalesce("masked_roll_mean_28_lag_28", "masked"),
        # 0 without a sale on the row itself: the last one lies before the tail, or nowhere
        "days_since_last_sale_lag_28": F.when((since > 0) | (F.col("lag_28") > 0), since).otherwise(
            F.when(F.col("sold"), F.col("since") + F.col("_i")).otherwise(0)).cast(
            fresh.schema["days_since_last_sale_lag_28"].dataType),
        "price_norm": F.try_divide(F.col("sell_price"), F.greatest("_top", "price_max"))})
    rows = rows.drop("_j", "_i", "_top", "_ema", "n_lag", "weighted", "masked", "since", "sold",
                     "price_max")
    return rows, _after(carry, rows)


def _after(carry: DataFrame, rows: DataFrame) -> DataFrame:
    """The carried values once the rows are part of the table."""
    late = carry_of(rows)
    new = {c: F.col(f"_{c}") for c in late.columns if c not in SERIES}
    both = carry.join(late.select(*SERIES, *[F.col(c).alias(f"_{c}") for c in new]),
                      list(SERIES), "full")
    n_lag = F.coalesce("n_lag", F.lit(0)) + F.coalesce("_n_lag", F.lit(0))
    sold = F.coalesce("sold", F.lit(False)) | F.coalesce("_sold", F.lit(False))
    # the new rows' mean covers all values so far: its weight is that of all of them
    weighted = F.when(F.coalesce("_n_lag", F.lit(0)) > 0,
                      F.col("_weighted") / _weight(F.col("_n_lag")) * _weight(n_lag)).otherwise(
        F.coalesce("weighted", F.lit(0.0)))
    return both.select(
        *SERIES, n_lag.alias("n_lag"), F.coalesce("_masked", "masked").alias("masked"),
        F.coalesce("_since", "since").alias("since"), sold.alias("sold"),
        F.greatest("price_max", "_price_max").alias("price_max"), weighted.alias("weighted"))


def _write(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _write_state(tail: DataFrame, carry: DataFrame, path: str, day: int) -> None:
    """The carry is written last: a state without it does not exist."""
    _write(last_rows(tail, TAIL_ROWS).withColumn("as_of", F.lit(day)), f"{path}/tail", "as_of")
    _write(carry.withColumn("as_of", F.lit(day)), f"{path}/carry", "as_of")


def _write_days(rows: DataFrame, path: str) -> None:
    """Complete rows, by day.  The quotient by the highest price is left to the reader, since a new
    highest price changes it on rows of all days."""
    kept = rows.dropna(subset=COMPLETE).drop("price_norm")
    # days gathered into files, a large day split over several
    _write(kept.hint("rebalance", "d"), f"{path}/days", "d")


def start(prepared: DataFrame, path: str) -> None:
    """Write the table and its state from all rows so far; the feature plan runs once."""
    spark = prepared.sparkSession
    day = prepared.agg(F.max("d")).first()[0]
    horizon_features(prepared, drop_incomplete=False).write.mode("overwrite").parquet(f"{path}/full")
    full = spark.read.parquet(f"{path}/full")
    _write_days(full, path)
    _write_state(full.select(*SERIES, "d", "sales", "sell_price"), carry_of(full), path, day)


def append(new: DataFrame, path: str) -> None:
    """Add the rows of days after the newest state before them.  Reads the state and the new rows, not
    the table; appending the same days again gives the same table.  No rows change nothing."""
    spark = new.sparkSession
    bounds = new.agg(F.min("d").alias("first"), F.max("d").alias("last")).first()
    if bounds["first"] is None:
        return
    known = spark.read.parquet(f"{path}/carry").filter(F.col("as_of") < bounds["first"])
    day = known.agg(F.max("as_of")).first()[0]
    if day is None:
        raise ValueError(f"no state before day {bounds['first']} at {path}")
    tail = spark.read.parquet(f"{path}/tail").filter(F.col("as_of") == day).drop("as_of")
    carry = known.filter(F.col("as_of") == day).drop("as_of")
    rows, after = continued(new, tail, carry)
    _write_days(rows, path)
    raw = [*SERIES, "d", "sales", "sell_price"]
    _write_state(tail.select(*raw).unionByName(new.select(*raw)), after, path, bounds["last"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The feature table as of its newest state, like one built from all rows at once."""
    days = spark.read.parquet(f"{path}/days")
    carry = spark.read.parquet(f"{path}/carry")
    newest = carry.agg(F.max("as_of")).first()[0]
    prices = carry.filter(F.col("as_of") == newest).select(*SERIES, "price_max")
    return days.filter(F.col("d") <= newest).join(prices, list(SERIES), "left").withColumn(
        "price_norm", F.try_divide("sell_price", "price_max")).drop("price_max")
