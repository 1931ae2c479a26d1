"""Evaluation tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window, functions as F

from shelfcast.functions import metrics
from shelfcast.operators import encode, horizon as hz, reshape
from shelfcast.sources.schemas import HORIZON, QUANTILES, SERIES

# fixed values: labels and quantile pairs of the reported intervals
INTERVALS = [("99", 0.005, 0.995), ("95", 0.025, 0.975), ("67", 0.165, 0.835), ("50", 0.25, 0.75)]
PANEL = [("p50", 0.5), ("p75", 0.75), ("p95", 0.975), ("p99", 0.995)]


def _q(level: float):
    return F.col("yhat")[QUANTILES.index(level)]


def daily_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per day: total actual, total predicted, RMSE over the rows."""
    return df.groupBy("d").agg(
        F.sum(actual).alias("actual_total"), F.sum(predicted).alias("predicted_total"),
        metrics.rmse(actual, predicted).alias("daily_rmse"))


def horizon_errors(df: DataFrame, actual: str, predictions: list[str],
                   step: str = "horizon_step") -> DataFrame:
    """RMSE of each prediction column per horizon step, and its running total over the steps."""
    steps = df.groupBy(step).agg(*[
        metrics.rmse(actual, p).alias(f"rmse_{p}") for p in predictions])
    w = Window.partitionBy(F.lit(0)).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({
        f"cum_rmse_{p}": F.sum(f"rmse_{p}").over(w) for p in predictions})


def fold_metrics(df: DataFrame, actual: str, predicted: str, alpha: float = 0.5,
                 by: list[str] = ["fold"]) -> DataFrame:
    """RMSE, MAE and weighted scaled pinball loss per fold."""
    return df.groupBy(*by).agg(
        metrics.rmse(actual, predicted).alias("rmse"),
        metrics.mae(actual, predicted).alias("mae"),
        metrics.weighted_scaled_pinball(actual, predicted, alpha).alias("wspl"))


def fold_average(folds: DataFrame) -> DataFrame:
    return folds.agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "wspl")])


def horizon_quantile_loss(df: DataFrame, actual: str, predicted: str, alpha: float) -> DataFrame:
    """Loss per fold and horizon, averaged per fold and over folds (means of means)."""
    per_step = df.groupBy("fold", "horizon_day").agg(
        F.avg(metrics.pinball(actual, predicted, alpha)).alias("loss"))
    per_fold = per_step.groupBy("fold").agg(F.avg("loss").alias("fold_loss"))
    overall = per_fold.agg(F.avg("fold_loss")).scalar()
    return per_fold.withColumn("overall_loss", overall)


def backtest_kpis(with_actuals: DataFrame, histories: DataFrame) -> DataFrame:
    """Capture rate and median MAE of the backtest, forecast band width, mean history."""
    back = F.col("kind") == "backtest"
    inside = F.col("actual").between(_q(0.025), _q(0.975)).cast("double")
    kpis = with_actuals.groupBy(*SERIES).agg(
        (100.0 * F.sum(F.when(back, inside)) / HORIZON).alias("capture_rate"),
        F.avg(F.when(back, F.abs(F.col("actual") - _q(0.5)))).alias("backtest_mae"),
        F.avg(F.when(~back, _q(0.975) - _q(0.025))).alias("width_95"))
    mean = F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / F.size("history")
    return kpis.join(histories.select(*SERIES, mean.alias("avg_history")), list(SERIES))


def percentile_panel(packed: DataFrame) -> DataFrame:
    """28-day, 7-day and next-day totals of the forecast quantiles, and the safety stock."""
    future = packed.filter(F.col("kind") == "forecast")
    first, week = F.col("h") == 1, F.col("h") <= 7
    sums = [F.sum(_q(q)).alias(f"{name}_28d") for name, q in PANEL]
    for name, q in (("p50", 0.5), ("p95", 0.975)):
        sums.append(F.sum(F.when(first, _q(q))).alias(f"{name}_next_day"))
        sums.append(F.sum(F.when(week, _q(q))).alias(f"{name}_7d"))
    return future.groupBy(*SERIES).agg(*sums).withColumn(
        "safety_stock", F.greatest(F.col("p95_28d") - F.col("p50_28d"), F.lit(0.0)))


def interval_table(with_actuals: DataFrame) -> DataFrame:
    """Interval bounds per day, the 95 % width, and the median's residual where known."""
    bounds = []
    for label, low, high in INTERVALS:
        bounds += [_q(low).alias(f"lo_{label}"), _q(high).alias(f"hi_{label}")]
    return with_actuals.select(
        *SERIES, "kind", "h", _q(0.5).alias("median"), *bounds,
        (_q(0.975) - _q(0.025)).alias("width_95"), (F.col("actual") - _q(0.5)).alias("residual"))


def cross_validate(df: DataFrame, trainer: Callable[..., DataFrame], end_day: int,
                   folds: int = 3, horizon: int = HORIZON,
                   store: str | None = None) -> DataFrame:
    """Fold metrics of a pluggable trainer.

    `trainer(train, valid, features, categoricals)` returns the validation rows with `yhat`.
    Features, categoricals and weights follow the table: everything but keys and the target,
    with any other string column treated as a category.
    """
    if store is not None:
        df = df.filter(F.col("store_id") == store)
    df = encode.with_default_weights(df)
    features = reshape.feature_columns(df)
    categoricals = reshape.categorical_columns(df, features)
    parts = None
    for fold in range(1, folds + 1):
        first, last = hz.fold_bounds(fold, end_day, horizon)
        train = df.filter((F.col("d") < first) & F.col("sales").isNotNull())
        valid = df.filter(F.col("d").between(first, last))
        scored = trainer(train, valid, features, categoricals).withColumn(
            "fold", F.lit(fold)).select(
            "fold", "sales", "yhat", "weight", "scale_factor")
        parts = scored if parts is None else parts.unionByName(scored)
    return fold_metrics(parts, "sales", "yhat")
