"""Error measures as expressions; wrap them in avg() or use the aggregate forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pinball(actual, predicted, alpha) -> Column:
    """Quantile loss of one row as the larger of its two branches."""
    e = _c(actual) - _c(predicted)
    a = F.lit(alpha) if isinstance(alpha, float) else _c(alpha)
    return F.greatest(a * e, (a - 1.0) * e)


def pinball_branches(actual, predicted, alpha) -> Column:
    """The same loss written by the sign of the error."""
    e = _c(actual) - _c(predicted)
    a = F.lit(alpha) if isinstance(alpha, float) else _c(alpha)
    return F.when(e >= 0, a * e).otherwise((a - 1.0) * e)


def weighted_scaled_pinball(actual, predicted, alpha, weight="weight",
                            scale="scale_factor") -> Column:
    """Mean of loss times weight / (scale + 1e-5); not divided by the sum of the weights."""
    factor = _c(weight) / (_c(scale) + 1e-5)
    return F.avg(pinball_branches(actual, predicted, alpha) * factor)


def rmse(actual, predicted) -> Column:
    e = _c(predicted) - _c(actual)
    return F.sqrt(F.avg(e * e))


def mae(actual, predicted) -> Column:
    return F.avg(F.abs(_c(predicted) - _c(actual)))


def improvement(before, after) -> Column:
    """Reduction from `before` to `after` in per cent."""
    return F.try_divide(_c(before) - _c(after), _c(before)) * 100.0
