"""Retail tables derived from a star schema (lineitem, part, supplier, nation, region).

Regions act as stores, part types as departments, and (type, size band) as items.  The order lines are
read once: their sums per series and day are written to the shared folder, and all tables come from these.
"""

from __future__ import annotations

from hashlib import sha256
from inspect import getsource

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions.series import by_day
from shelfcast.session import shared_dir, tune
from shelfcast.sources import readers, writers
from shelfcast.sources.schemas import HORIZON

FIRST_DATE = "1995-01-02"
SOURCES = ["lineitem", "part", "supplier", "nation", "region"]
DIMENSIONS = ["store_id", "item_id", "dept_id", "cat_id", "state_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def week_of(d) -> F.Column:
    return (F.floor((d - 1) / 7) + 1).cast("int")


def retail_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: dimensions, day, quantity, unit price.

    Parts are sort-merged, where adaptive execution splits the partition of a hot part: their rows take
    many times their file size, and a broadcast of them would pass through the driver.  The other
    dimensions are broadcast by their file size.
    """
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat("p_type", F.lit("_"), F.lpad(
            (F.floor((F.col("p_size") - 1) / 10).cast("int") + 1).cast("string"), 3, "0",
        )).alias("item_id"),
        F.col("p_type").alias("dept_id"),
        F.substring("p_type", 1, 1).alias("cat_id"),
    )
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey",
        (F.datediff(F.col("l_shipdate").cast("date"), F.lit(FIRST_DATE).cast("date")) + 1)
        .alias("d"),
        F.col("l_quantity").alias("qty"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    regions = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("store_id"))
    return (
        lines.join(parts.hint("merge"), "l_partkey").join(suppliers, "l_suppkey")
        .join(nations, "s_nationkey").join(regions, "n_regionkey")
        .withColumn("state_id", F.col("store_id"))
        .select(*DIMENSIONS, "d", "qty", "unit_price")
    )


def line_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Units and lowest unit price per series and day that had sales; formed map-side before the shuffle."""
    return retail_lines(spark, folder).groupBy(*DIMENSIONS, "d").agg(
        F.sum("qty").cast("int").alias("sales"), F.min("unit_price").alias("unit_price"))


def final_day(spark: SparkSession, folder: str) -> DataFrame:
    """The last sales day of all order lines."""
    first = F.lit(FIRST_DATE).cast("date")
    return table(spark, folder, "lineitem").agg(
        (F.datediff(F.max("l_shipdate").cast("date"), first) + 1).alias("last_day"))


def daily(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The line totals and the last day, written once per state of the sources and of this code."""
    files = readers.fingerprint(tune(spark), *[f"{folder}/{name}.parquet" for name in SOURCES])
    path = f"{shared_dir(spark)}/daily-{files}-{PLAN}"

    def write(fresh: str) -> None:
        line_totals(spark, folder).write.parquet(f"{fresh}/totals")
        final_day(spark, folder).write.parquet(f"{fresh}/last_day")
    writers.place_if_missing(spark, path, write, "/last_day")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("totals", "last_day")}


def last_day(spark: SparkSession, folder: str) -> DataFrame:
    """The last sales day as a one-row table, for use as a scalar subquery."""
    return daily(spark, folder)["last_day"]


def daily_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Units per series and day that had sales."""
    return daily(spark, folder)["totals"].select(*DIMENSIONS, "d", "sales")


def sales_long(spark: SparkSession, folder: str) -> DataFrame:
    """Zero-filled sales of every series on every day.

    Each sales row is stretched to the day before the next one, so the calendar grid needs no
    join and the rows stay hashed by series for the windows that follow.
    """
    w = by_day()
    known = daily(spark, folder)
    stretched = known["totals"].select(
        *DIMENSIONS, F.col("d").alias("sold_on"), "sales",
        F.when(F.lag("d").over(w).isNull(), F.lit(1)).otherwise(F.col("d")).alias("start"),
        (F.lead("d").over(w) - 1).alias("stop"),
    )
    last = known["last_day"].scalar()
    return stretched.select(
        *DIMENSIONS, "sold_on", "sales",
        F.explode(F.sequence("start", F.coalesce("stop", last))).alias("d"),
    ).select(
        *DIMENSIONS, "d",
        F.when(F.col("d") == F.col("sold_on"), F.col("sales")).otherwise(0).alias("sales"))


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day, running one horizon past the last sales day."""
    days = last_day(spark, folder).select(
        F.explode(F.sequence(F.lit(1), F.col("last_day") + HORIZON)).alias("d"))
    date = F.date_add(F.lit(FIRST_DATE).cast("date"), F.col("d") - 1)
    dom = F.dayofmonth(date)
    month = F.month(date)
    return days.select(
        "d",
        (F.dayofweek(date) % 7 + 1).alias("wday"),
        month.alias("month"),
        F.when((month == 12) & (dom == 25), F.lit("Christmas"))
        .when((month == 7) & (dom == 4), F.lit("July4th")).alias("event_name_1"),
        (dom <= 10).cast("int").alias("snap_CA"),
        ((dom <= 15) & (dom % 2 == 1)).cast("int").alias("snap_TX"),
        ((dom <= 15) & (dom % 2 == 0)).cast("int").alias("snap_WI"),
        week_of(F.col("d")).alias("wm_yr_wk"),
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Lowest unit price per series and week; weeks without sales have no row."""
    return daily(spark, folder)["totals"].groupBy(
        "store_id", "item_id", week_of(F.col("d")).alias("wm_yr_wk")).agg(
        F.min("unit_price").alias("sell_price"))


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Events per user, type and day as a second, short series (user = item, type = store)."""
    first = F.lit("2024-01-01").cast("date")
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("store_id"), F.col("user_id").cast("string").alias("item_id"),
        (F.datediff(F.col("ts").cast("date"), first) + 1).alias("d"),
    ).agg(F.count(F.lit(1)).cast("int").alias("sales"))


# changes with the code behind the written totals
PLAN = sha256("".join(map(getsource, (retail_lines, line_totals, final_day))).encode()).hexdigest()[:16]
