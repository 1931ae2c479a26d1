"""Day-by-day forecasts that feed on their own output.

The 28 days depend on each other, the series do not: a task takes a batch of series and runs all its days
in one pass, with the rolling windows of the batch as one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfcast.models.bins import numbers, values
from shelfcast.models.scoring import ForecastModel
from shelfcast.operators.ranking import last_rows
from shelfcast.operators.summaries import padded_history
from shelfcast.sources.schemas import HORIZON, SERIES

DAY = ["wday", "month", "snap_CA", "snap_TX", "snap_WI"]
# days before the newest at which a rolling mean of the window begins; all end HORIZON before it
ROLLING = {"roll_mean_7": 7 + HORIZON, "roll_mean_28": 2 * HORIZON}
# fixed values: the fed-back sales are this mix of the quantiles' mean and the 75 % quantile
MEAN_SHARE, HIGH_SHARE, HIGH = 0.7, 0.3, 0.75


def seeds(features: DataFrame, full: bool = False) -> DataFrame:
    """Per series the backtest's and the forecast's start day and opening window.

    The backtest opens on the first 56 of the newest 84 sales.  The forecast opens on the last
    28, which leaves its rolling means short of input for the first days; `full` gives it 56.
    """
    past = padded_history(features).select(*SERIES, "history")
    latest = last_rows(features, 1)
    both = latest.join(past, list(SERIES)).withColumn("kind", F.explode(F.array(
        F.lit("backtest"), F.lit("forecast"))))
    back = F.col("kind") == "backtest"
    length = 2 * HORIZON if full else HORIZON
    return both.withColumns({
        "start_d": F.when(back, F.col("d") - (HORIZON - 1)).otherwise(F.col("d") + 1),
        "window": F.when(back, F.slice("history", 1, 2 * HORIZON)).otherwise(
            F.slice("history", -length, length)),
    }).drop("history", *DAY)


def upcoming_days(starts: DataFrame, calendar: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The calendar of the days from each start day on, one array per column; past its end the last
    row repeats."""
    day = F.struct(*DAY)
    final = calendar.agg(F.max_by(day, "d")).scalar()
    days = starts.select("start_d").distinct().select(
        "start_d", F.explode(F.sequence("start_d", F.col("start_d") + horizon - 1)).alias("d"))
    dated = days.join(calendar.select("d", day.alias("day")), "d", "left").select(
        "start_d", "d", F.coalesce("day", final).alias("day"))
    listed = dated.groupBy("start_d").agg(F.array_sort(F.collect_list(F.struct("d", "day"))).alias("_days"))
    return listed.select("start_d", *[F.transform("_days", lambda x: x["day"][c].cast("double")).alias(f"days_{c}")
                                      for c in DAY])


def tail_means(window: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Mean of each row's known values between `start` and `stop` from the end, NaN without any."""
    part = window[:, max(0, window.shape[1] - start):window.shape[1] - stop]
    known = ~np.isnan(part)
    n = known.sum(axis=1)
    return np.where(n > 0, np.where(known, part, 0.0).sum(axis=1) / np.maximum(n, 1), np.nan)


def aligned(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows that end together, NaN before shorter ones."""
    offsets = lists.offsets.to_numpy()
    size = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    out = np.full((len(lists), width), np.nan)
    row = np.repeat(np.arange(len(lists)), size)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[1:], size) + width
    out[row, place] = flat[offsets[0]:offsets[-1]]
    return out


def recursive_forecast(model: ForecastModel, seeded: DataFrame, calendar: DataFrame,
                       horizon: int = HORIZON) -> DataFrame:
    """Packed predictions (series, kind, h, yhat) from `seeds`."""
    rows = model.encoded(seeded.join(upcoming_days(seeded, calendar, horizon), "start_d"))
    names = model.trees.features
    moving = set(DAY) | set(ROLLING)
    fixed = [n for n in names if n not in moving]
    scorer = model.trees.scorer()
    high = model.quantiles.index(HIGH)
    width = 2 * HORIZON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, begin = batch.num_rows, 3
            columns = dict(zip(fixed, numbers(batch, range(begin, begin + len(fixed))), strict=True))
            days = {c: aligned(batch.column(begin + len(fixed) + i), horizon) for i, c in enumerate(DAY)}
            window = aligned(batch.column(batch.num_columns - 1), width)
            found = np.empty((n, horizon, len(scorer.walkers)))
            for h in range(horizon):
                columns.update({c: x[:, h] for c, x in days.items()})
                columns.update({c: tail_means(window, start, HORIZON) for c, start in ROLLING.items()})
                yhat = scorer.forecasts([columns[c] for c in names])
                fed_back = MEAN_SHARE * yhat.mean(axis=0) + HIGH_SHARE * yhat[high]
                window = np.column_stack([window[:, 1:], fed_back])
                found[:, h] = yhat.T
            lists = pa.ListArray.from_arrays(
                np.arange(0, found.size + 1, found.shape[2], dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(
                    np.arange(0, n * horizon + 1, horizon, dtype=np.int32), lists)], [*SERIES, "kind", "preds"])
    picked = rows.select(*SERIES, "kind", *values(fixed, model.trees.categories), *[f"days_{c}" for c in DAY],
                         F.col("window").cast("array<double>").alias("window"))
    done = picked.mapInArrow(run, "store_id string, item_id string, kind string, preds array<array<double>>")
    return done.select(*SERIES, "kind", F.posexplode("preds").alias("_pos", "yhat")).select(
        *SERIES, "kind", (F.col("_pos") + 1).alias("h"), "yhat")
