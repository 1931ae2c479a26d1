"""Feature store: a small set of Parquet tables that serving reads instead of the full table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.functions.scalars import finite_or_zero
from shelfcast.operators import summaries
from shelfcast.operators.ranking import last_rows
from shelfcast.operators.summaries import padded_history
from shelfcast.sources import writers
from shelfcast.sources.readers import fingerprint
from shelfcast.sources.schemas import (
    CATEGORY_COLUMNS, HISTORY_DAYS, SERIES, STORE_DAYS, STORE_ROW_COLUMNS, require_columns)


def newest_rows(features: DataFrame, days: int = STORE_DAYS) -> DataFrame:
    """The newest rows of each series, with the columns serving needs."""
    require_columns(features, list(SERIES) + STORE_ROW_COLUMNS)
    columns = list(dict.fromkeys(list(SERIES) + STORE_ROW_COLUMNS))
    return last_rows(features.select(*columns), days)


def serving_tables(rows: DataFrame, version: str) -> dict[str, DataFrame]:
    """ctx: the newest row per series; sales: the newest 84 as a list; meta: version and day."""
    history = summaries.history(rows).select(*SERIES, "history")
    return {
        "ctx": last_rows(rows, 1),
        "sales": history,
        "meta": rows.agg(F.lit(version).alias("version"), F.max("d").alias("max_d")),
    }


def sanitised(rows: DataFrame) -> DataFrame:
    """Numbers with null, NaN and infinities replaced by 0, counters and flags as int."""
    whole = {"d", "wday", "month", "horizon_day", "target_wday", "days_since_last_sale_lag_28",
             "snap_CA", "snap_TX", "snap_WI"}
    out = []
    for c in rows.columns:
        if c in CATEGORY_COLUMNS:
            out.append(F.col(c).cast("string").alias(c))
        else:
            clean = finite_or_zero(c)
            out.append((clean.cast("int") if c in whole else clean).alias(c))
    return rows.select(*out)


def current_version(spark: SparkSession, path: str) -> str | None:
    if not writers.exists(spark, f"{path}/meta"):
        return None
    row = spark.read.parquet(f"{path}/meta").first()
    return row["version"] if row else None


def refresh(features: DataFrame, path: str, version: str, force: bool = False) -> bool:
    """Write the store unless it is already at this version.  True when written.

    The feature plan runs once, into `rows`; the other tables are read off that.  Meta is
    emptied first and written last, so a store whose write was cut short has no version.
    """
    spark = features.sparkSession
    if not force and current_version(spark, path) == version:
        return False
    if current_version(spark, path):
        spark.createDataFrame([], "version string, max_d int").write.mode("overwrite").parquet(
            f"{path}/meta")
    newest_rows(features).write.mode("overwrite").partitionBy("store_id").parquet(f"{path}/rows")
    tables = serving_tables(spark.read.parquet(f"{path}/rows"), version)
    for name in ("ctx", "sales"):
        tables[name].write.mode("overwrite").partitionBy("store_id").parquet(f"{path}/{name}")
    tables["meta"].write.mode("overwrite").parquet(f"{path}/meta")
    return True


def lookup(wanted: DataFrame, stored: dict[str, DataFrame], features: DataFrame) -> DataFrame:
    """Context and history of each requested pair: from the store, else from the feature table,
    else nothing and a list of zeros."""
    pairs = wanted.select(*SERIES).distinct()
    body = [c for c in stored["ctx"].columns if c not in SERIES]
    # the table is read for pairs that the store lacks
    missing = pairs.join(stored["ctx"].select(*SERIES), list(SERIES), "left_anti").union(
        pairs.join(stored["sales"].select(*SERIES), list(SERIES), "left_anti")).distinct()
    asked = features.join(missing, list(SERIES), "left_semi")
    newest = asked.groupBy(*SERIES).agg(F.max_by(F.struct(*body), "d").alias("_late"))
    late_history = padded_history(asked).select(*SERIES, F.col("history").alias("_late_history"))
    ctx = stored["ctx"].select(*SERIES, F.struct(*body).alias("_ctx"))
    found = (
        pairs.join(ctx, list(SERIES), "left").join(newest, list(SERIES), "left")
        .join(stored["sales"], list(SERIES), "left").join(late_history, list(SERIES), "left")
    )
    picked = F.coalesce("_ctx", "_late")
    zeros = F.array_repeat(F.lit(0.0), HISTORY_DAYS)
    return found.select(
        *SERIES, *[picked[c].alias(c) for c in body],
        F.coalesce("history", "_late_history", zeros).alias("history"),
        F.when(F.col("_ctx").isNotNull(), "store").when(F.col("_late").isNotNull(), "table")
        .otherwise("none").alias("source"))
