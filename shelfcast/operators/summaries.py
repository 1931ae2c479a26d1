"""Aggregates over series, stores and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.scalars import pad_history
from shelfcast.operators.ranking import last_rows
from shelfcast.sources.schemas import HISTORY_DAYS, SERIES


def totals(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"),
                  F.avg(column).alias("mean"))


def item_profile(sales: DataFrame) -> DataFrame:
    """Volume, coefficient of variation and share of zero days per item."""
    return sales.groupBy("item_id").agg(
        F.sum("sales").cast("double").alias("Popularity"),
        F.try_divide(F.stddev_samp("sales"), F.avg("sales")).alias("Volatility"),
        (100.0 * F.avg((F.col("sales") == 0).cast("double"))).alias("Sparsity"))


def history(df: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """The newest `days` sales of each series as an ordered list."""
    recent = last_rows(df.select(*SERIES, "d", "sales"), days)
    packed = F.array_sort(F.collect_list(F.struct("d", F.col("sales").cast("double").alias("sales"))))
    return recent.groupBy(*SERIES).agg(
        F.max("d").alias("last_d"), packed.alias("_packed")
    ).select(*SERIES, "last_d", F.col("_packed.sales").alias("history"))


def padded_history(df: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    return history(df, days).withColumn("history", pad_history("history", days))


def weekday_profile(histories: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean sales per weekday over each history list, as an array for weekdays 1..7.

    The list ends at `last_d` and is read as consecutive days; weekdays without a day get 0.
    """
    days = histories.select(
        *SERIES, "last_d", F.size("history").alias("_n"),
        F.posexplode("history").alias("_pos", "_sales"),
    ).select(*SERIES, (F.col("last_d") - F.col("_n") + 1 + F.col("_pos")).alias("d"), "_sales")
    dated = days.join(calendar.select("d", "wday"), "d", "left")
    level = [F.coalesce(F.avg(F.when(F.col("wday") == k, F.col("_sales"))), F.lit(0.0))
             for k in range(1, 8)]
    return dated.groupBy(*SERIES).agg(F.array(*level).alias("profile"))


def residual_histogram(df: DataFrame, residual: str, bins: int) -> DataFrame:
    """Counts per equal-width bin between the smallest and the largest residual; every residual is
    in a bin."""
    low = df.agg(F.min(residual).alias("x")).scalar()
    high = df.agg(F.max(residual).alias("x")).scalar()
    known = df.filter(F.col(residual).isNotNull())
    width = (high - low) / bins
    at = F.when(width > 0, F.least(
        F.floor((F.col(residual) - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return known.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
