"""Losses for gradient boosting, as Column expressions.

A loss gives the start value, the negative gradient a tree is fitted to, the value each leaf of
that tree takes, and the loss of a row.  `f` is the raw score, which `link` turns into a forecast.
`begin`, `slopes` and `losses` are the same over NumPy arrays, for training over blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from shelfcast.functions import metrics


class Loss:
    alpha = None            # leaves take this percentile of their residuals, or else a Newton step
    log_link = False

    def begin(self, mean: float) -> float:
        """The start score from the mean target."""
        return float(mean)

    def slopes(self, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative gradient and curvature."""
        raise NotImplementedError

    def losses(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def start(self, y: Column) -> Column:
        """Aggregate: the best constant score."""
        raise NotImplementedError

    def gradient(self, y: Column, f: Column) -> Column:
        raise NotImplementedError

    def leaf_value(self, y: Column, f: Column) -> Column:
        """Aggregate over a leaf's rows: the step that lowers the loss most."""
        raise NotImplementedError

    def value(self, y: Column, f: Column) -> Column:
        raise NotImplementedError

    def link(self, f: Column) -> Column:
        return f


@dataclass(frozen=True)
class Quantile(Loss):
    """Pinball loss.  Leaf quantiles come from mergeable sketches, so no leaf, however large,
    is gathered anywhere; `accuracy` bounds the rank error by rows / accuracy."""

    alpha: float
    accuracy: int = 10_000

    def slopes(self, y, f):
        return np.where(y > f, self.alpha, self.alpha - 1.0), np.ones(len(y))

    def losses(self, y, f):
        return np.maximum(self.alpha * (y - f), (self.alpha - 1.0) * (y - f))

    def start(self, y):
        return F.percentile_approx(y, self.alpha, self.accuracy)

    def gradient(self, y, f):
        return F.when(y > f, self.alpha).otherwise(self.alpha - 1.0)

    def leaf_value(self, y, f):
        return F.percentile_approx(y - f, self.alpha, self.accuracy)

    def value(self, y, f):
        return metrics.pinball(y, f, self.alpha)


@dataclass(frozen=True)
class Squared(Loss):
    def slopes(self, y, f):
        return 2.0 * (y - f), np.full(len(y), 2.0)

    def losses(self, y, f):
        return (y - f) ** 2

    def start(self, y):
        return F.avg(y)

    def gradient(self, y, f):
        return 2.0 * (y - f)

    def leaf_value(self, y, f):
        return F.avg(y - f)

    def value(self, y, f):
        return (y - f) * (y - f)


@dataclass(frozen=True)
class Asymmetric(Loss):
    """Squared error that charges forecasts below the actual `penalty` times."""

    penalty: float = 1.05   # fixed value

    def slopes(self, y, f):
        w = np.where(y > f, self.penalty, 1.0)
        return 2.0 * w * (y - f), 2.0 * w

    def losses(self, y, f):
        return np.where(y > f, self.penalty, 1.0) * (y - f) ** 2

    def weight(self, y, f):
        return F.when(y > f, self.penalty).otherwise(1.0)

    def start(self, y):
        return F.avg(y)

    def gradient(self, y, f):
        return 2.0 * self.weight(y, f) * (y - f)

    def leaf_value(self, y, f):
        w = self.weight(y, f)
        return F.sum(w * (y - f)) / F.sum(w)

    def value(self, y, f):
        return self.weight(y, f) * (y - f) * (y - f)


@dataclass(frozen=True)
class Tweedie(Loss):
    """Tweedie deviance with a log link; the score is the log of the mean."""

    power: float = 1.15     # fixed value
    log_link = True

    def begin(self, mean):
        return float(np.log(max(mean, 1e-6)))

    def slopes(self, y, f):
        low, high = np.exp((1.0 - self.power) * f), np.exp((2.0 - self.power) * f)
        return y * low - high, -(1.0 - self.power) * y * low + (2.0 - self.power) * high

    def losses(self, y, f):
        return (-y * np.exp((1.0 - self.power) * f) / (1.0 - self.power)
                + np.exp((2.0 - self.power) * f) / (2.0 - self.power))

    def start(self, y):
        return F.log(F.greatest(F.avg(y), F.lit(1e-6)))

    def gradient(self, y, f):
        return y * F.exp((1.0 - self.power) * f) - F.exp((2.0 - self.power) * f)

    def curvature(self, y, f):
        return (-(1.0 - self.power) * y * F.exp((1.0 - self.power) * f)
                + (2.0 - self.power) * F.exp((2.0 - self.power) * f))

    def leaf_value(self, y, f):
        """One Newton step."""
        return F.try_divide(F.sum(self.gradient(y, f)), F.sum(self.curvature(y, f)))

    def value(self, y, f):
        return (-y * F.exp((1.0 - self.power) * f) / (1.0 - self.power)
                + F.exp((2.0 - self.power) * f) / (2.0 - self.power))

    def link(self, f):
        return F.exp(f)
