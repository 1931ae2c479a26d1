"""Window expressions over one time series, and the exponentially weighted moments.

Every expression partitions by the series key, so a chain of them needs one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from shelfcast.sources.schemas import SERIES


def by_day(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or SERIES)).orderBy("d")


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or SERIES))


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rolling_mean(value, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    """Mean of the last n rows; null until `min_periods` (default n) of them are non-null."""
    frame = trailing(w, n)
    need = n if min_periods is None else min_periods
    return F.when(F.count(_c(value)).over(frame) >= need, F.avg(_c(value)).over(frame))


def forward_fill(value, w: WindowSpec) -> Column:
    return F.last(_c(value), ignorenulls=True).over(running(w))


def window_difference(total: str, n: int, w: WindowSpec) -> Column:
    """Sum over the last n rows from a running total, in constant time per row.

    Exact for integer totals, which is what unit sales give.
    """
    return F.col(total) - F.lag(total, n, 0).over(w)


def max_normalised(value, *keys: str) -> Column:
    return F.try_divide(_c(value), F.max(_c(value)).over(whole(*keys)))


def momentum(value, n: int, w: WindowSpec) -> Column:
    return F.try_divide(_c(value), F.lag(_c(value), n).over(w))


def zscore(value, *keys: str, eps: float = 1e-5) -> Column:
    w = whole(*keys)
    return (_c(value) - F.avg(_c(value)).over(w)) / (F.stddev_samp(_c(value)).over(w) + eps)


def change_ratio(value, base, eps: float = 1e-5) -> Column:
    return (_c(value) - _c(base)) / (_c(base) + eps)


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def ewm_block_rows(alpha: float) -> int:
    """Rows over which the weights, scaled up to avoid a loop, stay below 1e150."""
    return int(345.0 / -math.log(1.0 - alpha))


def with_ewm(df: DataFrame, value: str, alpha: float, mean: str | None = None,
             std: str | None = None, keys: tuple[str, ...] = SERIES,
             max_rows: int | None = None) -> DataFrame:
    """Add the adjusted exponentially weighted mean and the bias-corrected std of `value`.

    With q = 1 - alpha the weighted sum at the k-th non-null value is the running sum of
    x_i * q**-i, scaled by q**k.  The scaled terms leave double range on long series, so rows
    are cut into blocks of `ewm_block_rows`: the sum restarts in each block and takes over the
    previous block's rows with their true weight.  Older blocks weigh below 1e-150 and fall
    away.  When the caller knows that no series exceeds one block (`max_rows`) the block step,
    and its extra sort, is left out.  Rows with a null input give null.
    """
    q = 1.0 - alpha
    block = ewm_block_rows(alpha)
    w = by_day(*keys)
    x = F.col(value).cast("double")
    k = F.col("_k")
    work = df.withColumn("_k", F.count(F.col(value)).over(running(w)))
    names: list[str] = ["_k"]

    if max_rows is not None and max_rows <= block:
        def weighted(expr: Column) -> Column:
            return F.sum(expr * F.pow(F.lit(1.0 / q), k)).over(running(w)) * F.pow(F.lit(q), k)
    else:
        work = work.withColumn("_b", F.floor((k - 1) / block).cast("int"))
        work = work.withColumn("_j", k - F.col("_b") * block)
        names += ["_b", "_j"]
        j = F.col("_j")
        inside = running(by_day(*keys, "_b"))
        before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)

        def weighted(expr: Column) -> Column:
            here = F.sum(expr * F.pow(F.lit(1.0 / q), j)).over(inside)
            carried = F.sum(expr * F.pow(F.lit(q), block - j)).over(before)
            return (here + F.coalesce(carried, F.lit(0.0))) * F.pow(F.lit(q), j)

    work = work.withColumn("_s1", weighted(x))
    names.append("_s1")
    if std:
        work = work.withColumn("_s2", weighted(x * x))
        names.append("_s2")
    w1 = (1.0 - F.pow(F.lit(q), k)) / (1.0 - q)
    average = F.col("_s1") / w1
    present = F.col(value).isNotNull()
    if mean:
        work = work.withColumn(mean, F.when(present, average))
    if std:
        w2 = (1.0 - F.pow(F.lit(q), 2 * k)) / (1.0 - q * q)
        spread = F.greatest(F.lit(0.0), F.col("_s2") / w1 - average * average)
        work = work.withColumn(
            std, F.when(present & (k > 1), F.sqrt(spread * w1 * w1 / (w1 * w1 - w2))))
    return work.drop(*names)
