"""Tables the registered queries start from, built from a folder of Parquet files."""

from __future__ import annotations

from hashlib import sha256
from inspect import getsource

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions import series
from shelfcast.plans import features as feature_plans
from shelfcast.plans import forecast
from shelfcast.plans import store as stores
from shelfcast.plans.store import fingerprint, refresh
from shelfcast.session import shared_dir, tune
from shelfcast.sources import starschema, writers
from shelfcast.sources.schemas import QUANTILES
from shelfcast.sources.starschema import SOURCES

# Quantile factors of the model-free forecast: a quantile is the lag-28 sales times its factor.
FACTORS = [0.1, 0.2, 0.6, 0.75, 1.0, 1.3, 1.5, 2.2, 3.0]
SNAP_REGIONS = {"AFRICA": "snap_CA", "AMERICA": "snap_TX", "ASIA": "snap_WI"}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
# changes with the code behind the feature table
PLAN = sha256("".join(map(getsource, (feature_plans, series, starschema))).encode()).hexdigest()[:16]
STORE_PLAN = sha256(getsource(stores).encode()).hexdigest()[:16]


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return starschema.sales_long(tune(spark), sf)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return starschema.calendar(tune(spark), sf)


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return feature_plans.attach_prices(
        feature_plans.attach_calendar(sales(spark, sf), calendar(spark, sf)),
        starschema.prices(spark, sf))


def version(spark: SparkSession, sf: str) -> str:
    """Changes with the state of the source files and with the code that makes the feature table."""
    files = fingerprint(tune(spark), *[f"{sf}/{name}.parquet" for name in SOURCES])
    return f"{files}-{PLAN}"


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table, written once per version and read with the columns and days that a query
    needs."""
    path = f"{shared_dir(spark)}/features-{version(spark, sf)}"
    return writers.build_if_missing(spark, path, lambda: feature_plan(spark, sf))


def store(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The store's tables, written once per version and read from their files."""
    known = version(spark, sf)
    path = f"{shared_dir(spark)}/store-{known}-{STORE_PLAN}"
    writers.place_if_missing(
        spark, path, lambda fresh: refresh(features(spark, sf), fresh, known), "/meta")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("rows", "ctx", "sales", "meta")}


def feature_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table as a plan over its sources."""
    days = starschema.last_day(tune(spark), sf).first()[0]
    return feature_plans.horizon_features(prepared(spark, sf), max_rows=days)


def naive_scores(steps: DataFrame) -> DataFrame:
    """Model-free quantiles of an anchor row."""
    return steps.withColumn("yhat", F.array(*[F.col("lag_28") * F.lit(f) for f in FACTORS]))


def raw_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Packed model-free predictions before any adjustment."""
    from shelfcast.operators.reshape import repeat_horizons
    steps = repeat_horizons(forecast.anchors(features(spark, sf)))
    return naive_scores(steps).select(
        "store_id", "item_id", "kind", "last_d", F.col("horizon_day").alias("h"),
        "target_wday", "yhat")


def naive_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows with one model-free column per quantile, q0..q8."""
    df = features(spark, sf).select("store_id", "item_id", "d", "sales", "lag_28")
    return df.withColumns({f"q{i}": F.col("lag_28") * F.lit(f) for i, f in enumerate(FACTORS)})


# Engines break rounding ties differently; values with short decimal expansions do meet ties, so
# both sides shift by this before they round.
OFF_TIE = 1e-9


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison with another engine, except the `exact` columns."""
    return df.select(*[
        F.round(F.col(f.name) + OFF_TIE, digits).alias(f.name)
        if f.dataType.simpleString() in ("double", "float") and f.name not in exact
        else F.col(f.name) for f in df.schema.fields])


assert len(FACTORS) == len(QUANTILES)
