"""Wide/long reshaping, selection and filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfcast.sources.schemas import KNOWN_CATEGORICALS, NOT_FEATURES, SALES_IDS, SERIES


def day_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("d_")]


def unpivot_days(wide: DataFrame, cluster: bool = True) -> DataFrame:
    """Wide daily sales to one row per series and day, nulls kept.

    The compact wide row is what gets shuffled (`cluster`): the exploded rows inherit its hash
    layout, so neither the price join nor the windows move the long table again.
    """
    ids = [c for c in SALES_IDS if c in wide.columns]
    columns = day_columns(wide)
    if cluster:
        wide = wide.repartition(*SERIES)
    # one SQL text instead of thousands of Column objects keeps planning fast
    values = ", ".join(f"`{c}`" for c in columns)
    days = ", ".join(c.removeprefix("d_") for c in columns)
    return wide.select(
        *ids, F.expr(f"posexplode(cast(array({values}) as array<int>))").alias("_pos", "sales"),
    ).select(*ids, F.expr(f"array({days})[_pos]").alias("d"), "sales")


def pivot_days(long: DataFrame, first: int, last: int) -> DataFrame:
    """Long sales to one row per series with columns d_first..d_last."""
    ids = [c for c in SALES_IDS if c in long.columns]
    days = list(range(first, last + 1))
    wide = long.groupBy(*ids).pivot("d", days).agg(F.first("sales"))
    return wide.toDF(*ids, *[f"d_{d}" for d in days])


def pivot_ranked_days(df: DataFrame, ranks: DataFrame, key: str, value: str,
                      width: int = 28, prefix: str = "F") -> DataFrame:
    """One row per key with columns F1..Fn, where day ranks give the column.

    `ranks` (d, day_rank) has one row per distinct day of the forecast window.
    """
    placed = df.join(ranks, "d")
    return placed.groupBy(key).pivot("day_rank", list(range(1, width + 1))).agg(
        F.first(value)).select(
        key, *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(1, width + 1)])


def feature_columns(df: DataFrame, exclude: list[str] = NOT_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def categorical_columns(df: DataFrame, features: list[str]) -> list[str]:
    """The known categoricals among the features, plus every other string column."""
    active = [c for c in KNOWN_CATEGORICALS if c in features]
    text = [f.name for f in df.schema.fields
            if f.name in features and isinstance(f.dataType, T.StringType)]
    return active + [c for c in text if c not in active]


def fill_missing(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Replace nulls; a fill is a literal or a Column (another column's value, say)."""
    return df.withColumns({
        c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v))
        for c, v in fills.items()})


def repeat_horizons(df: DataFrame, horizon: int = 28, wday: str = "wday") -> DataFrame:
    """Every row once per step 1..horizon, with the weekday the step lands on."""
    return df.withColumn("horizon_day", F.explode(F.sequence(F.lit(1), F.lit(horizon)))) \
        .withColumn("target_wday",
                    ((F.col(wday) + F.col("horizon_day") - 1) % 7 + 1).cast("int"))


def repeat_stores(df: DataFrame, stores: list[str]) -> DataFrame:
    """Every row once per store of a fixed list."""
    return df.withColumn("store_id", F.explode(F.array(*[F.lit(s) for s in stores])))
