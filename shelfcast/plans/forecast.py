"""Forecasts for every series at once.

A packed prediction row is one (series, kind, horizon day) with the quantiles of that day as an
array ordered like `QUANTILES`; adjusting a day then needs neither a join nor a shuffle.  `kind`
is "forecast" (anchored at the last day) or "backtest" (anchored 28 days earlier).
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.functions.scalars import clamp_zero
from shelfcast.functions.series import whole
from shelfcast.operators.lookup import attach_product_names
from shelfcast.operators.reshape import repeat_horizons
from shelfcast.operators.summaries import padded_history, weekday_profile
from shelfcast.sources.schemas import HISTORY_DAYS, HORIZON, QUANTILES, SERIES

MEDIAN = QUANTILES.index(0.5)
# fixed value: bands widen by this share of the median distance at the last horizon day
WIDENING = 0.84


def quantile_names(quantiles: list[float] = QUANTILES) -> list[str]:
    return [str(q) for q in quantiles]


def pack(long: DataFrame, quantiles: list[float] = QUANTILES) -> DataFrame:
    """Long (…, h, q, yhat) rows to one row per horizon day."""
    keys = [c for c in long.columns if c not in ("q", "yhat")]
    return long.groupBy(*keys).agg(F.array(*[
        F.max(F.when(F.col("q") == q, F.col("yhat"))) for q in quantiles]).alias("yhat"))


def unpack(packed: DataFrame, quantiles: list[float] = QUANTILES) -> DataFrame:
    """One row per horizon day and quantile."""
    keys = [c for c in packed.columns if c != "yhat"]
    pairs = F.arrays_zip(F.array(*[F.lit(q) for q in quantiles]).alias("q"), F.col("yhat"))
    return packed.select(*keys, F.inline(pairs).alias("q", "yhat"))


def anchors(features: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The last row of each series and, where it exists, the row `horizon` days before."""
    dated = features.withColumn("last_d", F.max("d").over(whole()))
    back = F.col("d") == F.col("last_d") - horizon
    return dated.filter((F.col("d") == F.col("last_d")) | back).withColumn(
        "kind", F.when(back, F.lit("backtest")).otherwise(F.lit("forecast")))


def weekday_rescale(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Scale each day by its weekday's share of the series' usual level.

    The factor is the weekday's mean over the mean of the positive weekday means; a day is left
    alone when that is undefined, not positive, or 1.
    """
    levels = F.filter("profile", lambda x: x > 0)
    usual = F.aggregate(levels, F.lit(0.0), lambda a, x: a + x) / F.size(levels)
    level = F.element_at("profile", F.col("target_wday"))
    factor = F.when((F.size(levels) > 0) & (level > 0), level / usual)
    apply = factor.isNotNull() & (F.abs(factor - 1.0) >= 1e-6)
    joined = packed.join(profiles.select(*SERIES, "profile"), list(SERIES), "left")
    return joined.withColumn("_factor", F.when(apply, factor)).withColumn(
        "yhat",
        F.when(F.col("_factor").isNull(), F.col("yhat"))
        .otherwise(F.transform("yhat", lambda y: clamp_zero(y * F.col("_factor")))),
    ).drop("_factor", "profile")


def horizon_scales(horizon: int = HORIZON) -> list[float]:
    """Band scale per horizon day, used when no calibrated table is given."""
    return [1.0 + WIDENING * math.sqrt((h - 1) / (horizon - 1)) for h in range(1, horizon + 1)]


def widen(packed: DataFrame, scales: list[float] | None = None,
          median: int = MEDIAN) -> DataFrame:
    """Stretch the quantiles of a day around its median by the day's scale."""
    table = F.array(*[F.lit(float(s)) for s in (scales or horizon_scales())])
    scale = F.element_at(table, F.col("h"))
    mid = F.col("yhat")[median]
    stretched = F.transform("yhat", lambda y: clamp_zero(mid + (y - mid) * scale))
    return packed.withColumn("yhat", F.when(scale == 1.0, F.col("yhat")).otherwise(stretched))


def monotone(packed: DataFrame) -> DataFrame:
    """Sort the quantiles of each day so that none cross."""
    return packed.withColumn("yhat", F.array_sort("yhat"))


def direct_forecast(features: DataFrame, score: Callable[[DataFrame], DataFrame],
                    calendar: DataFrame | None = None, scales: list[float] | None = None,
                    end_at_anchor: bool = False) -> DataFrame:
    """Both forecasts of every series: score the anchors' 28 steps, rescale, widen.

    `score` adds the `yhat` array to (anchor row, horizon_day, target_wday).  With a calendar the
    weekday profile of the newest 84 sales is applied; `end_at_anchor` builds the backtest's
    profile from the days up to its own anchor only.
    """
    steps = repeat_horizons(anchors(features))
    packed = score(steps).select(
        *SERIES, "kind", F.col("d").alias("anchor_d"), "last_d",
        F.col("horizon_day").alias("h"), "target_wday",
        F.transform("yhat", lambda y: clamp_zero(y)).alias("yhat"))
    if calendar is not None:
        if end_at_anchor:
            early = features.withColumn("_last", F.max("d").over(whole())).filter(
                F.col("d") <= F.col("_last") - HORIZON)
            parts = []
            for kind, source in (("forecast", features), ("backtest", early)):
                profile = weekday_profile(padded_history(source), calendar)
                parts.append(weekday_rescale(packed.filter(F.col("kind") == kind), profile))
            packed = parts[0].unionByName(parts[1])
        else:
            packed = weekday_rescale(
                packed, weekday_profile(padded_history(features), calendar))
    return widen(packed, scales)


def series_status(features: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Per series: "ok", or why no forecast can be made for it."""
    latest = anchors(features)
    state = latest.groupBy(*SERIES).agg(
        F.max(F.when(F.col("kind") == "forecast", F.col("lag_28"))).alias("lag_28"),
        F.max((F.col("kind") == "backtest").cast("int")).alias("has_anchor"))
    recent = padded_history(features).select(
        *SERIES, F.aggregate(F.slice("history", -HORIZON, HORIZON), F.lit(0.0),
                             lambda a, x: a + x).alias("recent"))
    known = state.join(recent, list(SERIES)).withColumn("_known", F.lit(True))
    if wanted is not None:
        known = wanted.select(*SERIES).distinct().join(known, list(SERIES), "left")
    return known.select(*SERIES, (
        F.when(F.col("_known").isNull(), "not_found")
        .when((F.coalesce("lag_28", F.lit(0)) == 0) & (F.col("recent") > 0), "missing_lag")
        .when(F.col("has_anchor") == 0, "missing_anchor")
        .otherwise("ok")).alias("status"))


def forecast_records(packed: DataFrame, features: DataFrame, products: DataFrame,
                     quantiles: list[float] = QUANTILES) -> DataFrame:
    """One row per series: history, and per kind a map quantile name -> list over the horizon."""
    days = F.array_sort(F.collect_list(F.struct("h", "yhat")))

    def band(i: int) -> Column:
        return F.transform("days", lambda day: day["yhat"][i])

    lists = packed.groupBy(*SERIES, "kind").agg(days.alias("days")).select(
        *SERIES, "kind",
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in quantile_names(quantiles)]),
            F.array(*[band(i) for i in range(len(quantiles))])).alias("bands"))
    kinds = lists.groupBy(*SERIES).agg(
        F.max_by("bands", F.when(F.col("kind") == "backtest", 1)).alias("backtest"),
        F.max_by("bands", F.when(F.col("kind") == "forecast", 1)).alias("forecast"))
    past = padded_history(features).select(*SERIES, "history")
    recent = F.slice("history", -HORIZON, HORIZON)
    joined = attach_product_names(kinds.join(past, list(SERIES)), products)
    average = F.round(F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / HORIZON, 2)
    return joined.select(
        *SERIES, "product_name", "history", "backtest", "forecast",
        F.create_map(F.lit("accuracy"), average).alias("metrics"),
        average.alias("avg_sales_28"))


def attach_actuals(packed: DataFrame, histories: DataFrame) -> DataFrame:
    """Give backtest days their sales: the last 28 entries of the history list, in order."""
    past = histories.select(*SERIES, "history")
    n = F.size("history")
    return packed.join(past, list(SERIES)).withColumn(
        "actual", F.when(F.col("kind") == "backtest",
                         F.element_at("history", n - HORIZON + F.col("h")))).drop("history")


def cumulative_fan(packed: DataFrame, histories: DataFrame,
                   quantiles: list[float] = QUANTILES) -> DataFrame:
    """Running totals of every quantile, starting from the sales total before the first day.

    The backtest continues the history up to 28 days before its end, the forecast all of it.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    past = histories.select(
        *SERIES, total(F.col("history")).alias("_all"),
        total(F.slice("history", F.lit(1), F.size("history") - HORIZON)).alias("_before"))
    w = Window.partitionBy(*SERIES, "kind").orderBy("h").rowsBetween(
        Window.unboundedPreceding, 0)
    base = F.when(F.col("kind") == "backtest", F.col("_before")).otherwise(F.col("_all"))
    sums = F.array(*[base + F.sum(F.col("yhat")[i]).over(w) for i in range(len(quantiles))])
    return packed.join(past, list(SERIES)).select(*SERIES, "kind", "h", sums.alias("yhat"))


def peak_spread(packed: DataFrame, low: int, high: int, kind: str = "backtest") -> DataFrame:
    """Horizon day on which the band between two quantiles is widest; the first one on ties."""
    spread = F.col("yhat")[high] - F.col("yhat")[low]
    return packed.filter(F.col("kind") == kind).groupBy(*SERIES).agg(
        F.max_by(F.struct("h", spread.alias("spread")),
                 F.struct(spread.alias("s"), (-F.col("h")).alias("n"))).alias("peak")
    ).select(*SERIES, F.col("peak.h").alias("peak_h"), F.col("peak.spread").alias("spread"))
