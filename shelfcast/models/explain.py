"""Shapley attribution and scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfcast.models.bins import Binning, numbers, values
from shelfcast.models.scoring import ForecastModel
from shelfcast.models.trees import Tree, TreeModel, Walker
from shelfcast.operators.ranking import top_per_group

ROWS_AT_ONCE = 2048


def leaf_paths(trees: list[Tree], binning: Binning) -> list[tuple[float, dict[int, tuple[np.ndarray, float]]]]:
    """Every leaf as (value, {feature: (bins that lead to it, share of rows kept)}).

    The share is the product of child-to-parent row counts over the path's splits on that feature.
    """
    leaves: list = []
    for tree in trees:
        goes_left = Walker(tree, binning).goes_left

        def walk(node: int, path: dict) -> None:
            f = tree.feature[node]
            if f < 0:
                leaves.append((tree.value[node], path))
                return
            for child, left in ((tree.left[node], True), (tree.right[node], False)):
                share = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
                open_, kept = path.get(f, (np.ones(binning.width, bool), 1.0))
                walk(child, {**path, f: (open_ & (goes_left[node] == left), kept * share)})
        walk(0, {})
    return leaves


def base_value(leaves: list) -> float:
    """Expected raw score over the training rows."""
    return sum(value * float(np.prod([kept for _, kept in path.values()])) for value, path in leaves)


def shapley_values(bins: np.ndarray, leaves: list) -> np.ndarray:
    """Path-dependent Shapley values of a batch of rows, one row per feature.

    For one leaf the game is a product over its path's features: a known feature contributes 1
    or 0 (the row's bin leads to the leaf or not), an unknown one its share of rows.  The weighted
    sum over coalitions is the integral over t in [0, 1] of the product of
    (share + t * (known - share)) over the other features, a polynomial of low degree that
    Gauss-Legendre quadrature integrates exactly.  Products of all but one come from both ends.
    """
    out = np.zeros(bins.shape)
    for value, path in leaves:
        features = list(path)
        if not features:
            continue
        nodes, weights = np.polynomial.legendre.leggauss(len(features) // 2 + 1)
        t, w = (nodes + 1.0) / 2.0, weights / 2.0
        known = [path[f][0][bins[f]].astype(float) for f in features]
        share = [path[f][1] for f in features]
        factors = [s + np.outer(t, k - s) for k, s in zip(known, share, strict=True)]
        after = [np.ones(factors[0].shape)]
        for factor in factors[:0:-1]:
            after.append(after[-1] * factor)
        before = np.ones(factors[0].shape)
        for i, f in enumerate(features):
            out[f] += value * (known[i] - share[i]) * (w @ (before * after[len(features) - 1 - i]))
            before = before * factors[i]
    return out


def attributions(df: DataFrame, model: TreeModel, keys: list[str], members: list[str]) -> DataFrame:
    """Long (keys, member, feature, value, impact) of rows that carry codes: a member's raw score is its base
    value plus all impacts.

    One pass over Arrow batches explains all members; leaf paths, bounded by the model's size,
    travel with the task.
    """
    binning = model.binning()
    leaves = {m: leaf_paths(model.trees[m], binning) for m in members}
    n, names = len(model.features), model.features

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                columns = numbers(batch, range(len(keys), len(keys) + n))
                bins = binning.matrix(columns)
                flat = pa.array(np.stack(columns, axis=1).ravel(), from_pandas=True)
                offsets = np.arange(0, batch.num_rows * n + 1, n, dtype=np.int32)
                for m in members:
                    impact = shapley_values(bins, leaves[m])
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:len(keys)], pa.array([m] * batch.num_rows),
                         pa.ListArray.from_arrays(offsets, flat),
                         pa.ListArray.from_arrays(offsets, pa.array(impact.T.ravel()))],
                        [*keys, "member", "_values", "_impacts"])

    narrow = df.select(*keys, *values(names, model.categories))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    wide = narrow.mapInArrow(explain, f"{fields}, member string, _values array<double>, _impacts array<double>")
    labels = F.array(*[F.lit(n) for n in names])
    return wide.select(*keys, "member", F.inline(F.arrays_zip(
        labels.alias("feature"), F.col("_values").alias("value"),
        F.col("_impacts").alias("impact"))).alias("feature", "value", "impact"))


def uncertainty_drivers(df: DataFrame, model: ForecastModel, keys: list[str], low: float,
                        high: float, k: int = 3) -> DataFrame:
    """Features that widen the band between two quantiles most, per row of `df`."""
    both = attributions(model.encoded(df), model.trees, keys, [str(low), str(high)])
    sign = F.when(F.col("member") == str(high), 1.0).otherwise(-1.0)
    spread = both.groupBy(*keys, "feature").agg(
        F.first("value").alias("value"), F.sum(sign * F.col("impact")).alias("contribution"))
    return top_per_group(spread, keys, [F.desc("contribution"), F.asc("feature")], k)


def scenarios(df: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Each row once per scenario with the scenario's non-null values put over its own.

    `overrides` is a short list of named what-ifs, so it travels as a literal-sized array.
    """
    cases = [r.asDict() for r in overrides.select("scenario", *columns).collect()]
    named = F.array(*[F.struct(F.lit(c["scenario"]).alias("scenario"), *[
        F.lit(c[n]).cast("double").alias(n) for n in columns]) for c in cases])
    widened = df.select("*", F.explode(named).alias("_case"))
    return widened.withColumns({
        "scenario": F.col("_case.scenario"),
        **{n: F.coalesce(F.col(f"_case.{n}"), F.col(n)) for n in columns},
    }).drop("_case")
