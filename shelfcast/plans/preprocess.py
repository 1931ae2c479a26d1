"""Raw files to feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators.reshape import day_columns, unpivot_days
from shelfcast.plans.features import attach_calendar, attach_prices, horizon_features
from shelfcast.sources import readers, writers


def prepare(wide: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Long sales with calendar and price columns, hashed by series."""
    return attach_prices(attach_calendar(unpivot_days(wide), calendar), prices)


def preprocess(spark: SparkSession, raw_dir: str, output: str | None = None,
               add_features: bool = True) -> DataFrame:
    """Read the three raw CSV files, build the table and, if asked, write it by store."""
    calendar = readers.read_calendar(spark, f"{raw_dir}/calendar.csv")
    wide = readers.read_wide_sales(spark, f"{raw_dir}/sales_train_evaluation.csv")
    df = prepare(wide, calendar, readers.read_prices(spark, f"{raw_dir}/sell_prices.csv"))
    if add_features:
        df = horizon_features(df, max_rows=len(day_columns(wide)))
    if output is None:
        return df
    writers.write_features(df, output)
    return spark.read.parquet(output)
