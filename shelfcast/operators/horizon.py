"""Direct-horizon training rows and temporal splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.scalars import target_weekday
from shelfcast.functions.series import by_day
from shelfcast.sources.schemas import HORIZON


def expand_horizons(df: DataFrame, horizon: int = HORIZON, value: str = "sales",
                    strict_days: bool = False) -> DataFrame:
    """Each row once per horizon with the value found that many rows (or days) later.

    All targets come from one window over the series; rows whose target lies beyond the end are
    dropped.  `strict_days` looks up day d + h, so gaps in the series give no target.
    """
    w = by_day()
    if strict_days:
        days = Window.partitionBy("store_id", "item_id").orderBy("d")
        targets = [F.first(value).over(days.rangeBetween(h, h)) for h in range(1, horizon + 1)]
    else:
        targets = [F.lead(value, h).over(w) for h in range(1, horizon + 1)]
    stacked = df.withColumn("_targets", F.array(*targets))
    return stacked.select(
        *df.columns, F.posexplode("_targets").alias("_pos", "_target"),
    ).filter(F.col("_target").isNotNull()).select(
        *df.columns,
        F.col("_target").cast("double").alias("target"),
        (F.col("_pos") + 1).alias("horizon_day"),
        target_weekday("wday", F.col("_pos") + 1).alias("target_wday"),
    )


def last_day_of(df: DataFrame) -> Column:
    """Largest day of a table as a scalar subquery."""
    return df.agg(F.max("d").alias("d")).scalar()


def training_window(df: DataFrame, days: int = 365, horizon: int = HORIZON,
                    warm_up: int = 0) -> DataFrame:
    """The last `days` days before the hold-out, plus the hold-out itself."""
    return df.filter(F.col("d") >= last_day_of(df) - horizon - days - warm_up)


def hold_out(df: DataFrame, split: Column | int, on: str = "anchor") -> tuple[DataFrame, DataFrame]:
    """(train, valid) around the split day, by the anchor's day or by the target's day."""
    day = F.col("d") if on == "anchor" else F.col("d") + F.col("horizon_day")
    split = F.lit(split) if isinstance(split, int) else split
    return df.filter(day <= split), df.filter(day > split)


def fold_bounds(fold: int, end_day: int, horizon: int = HORIZON) -> tuple[int, int]:
    """First and last validation day of a fold; fold 1 is the newest, and training ends the day
    before.  The same arithmetic as `fold_column`."""
    return end_day - fold * horizon + 1, end_day - (fold - 1) * horizon


def fold_column(end_day: Column, folds: int, horizon: int = HORIZON) -> Column:
    """Fold whose validation window holds the row's day; null outside all of them.

    Validation windows do not overlap, so tagging is arithmetic and needs no range join.
    """
    fold = (F.floor((end_day - F.col("d")) / horizon) + 1).cast("int")
    return F.when((F.col("d") <= end_day) & (fold <= folds), fold)
