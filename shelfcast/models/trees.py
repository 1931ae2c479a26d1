"""Trees as rows, and walking them.

A model is a table (member, tree, node, feature, bound, codes, missing_left, left, right, value, cover, gain):
numbers up to `bound` and categories in `codes` go to the node `left`, others to `right`, and
missing ones by `missing_left`.  A node without a feature is a leaf.  The raw score of a member is
the sum of its leaves' values; its tree -1 is one leaf that holds the start value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfcast.models.bins import Binning, numbers, values

TREE_TABLE = ("member string, tree int, node int, feature string, bound double, codes array<int>, "
              "missing_left boolean, left int, right int, value double, cover double, gain double")
ROWS_AT_ONCE = 4096


@dataclass
class Tree:
    """Columns of one tree's nodes; feature -1 marks a leaf, which is its own child."""

    feature: list[int]
    bound: list[float | None]
    codes: list[list[int] | None]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[float]
    gain: list[float]

    @staticmethod
    def leaf(value: float, cover: float = 0.0) -> "Tree":
        return Tree([-1], [None], [None], [False], [0], [0], [value], [cover], [0.0])


class Walker:
    """A tree over bins: for every node, which bins go left."""

    def __init__(self, tree: Tree, binning: Binning):
        n = len(tree.feature)
        self.feature = np.maximum(tree.feature, 0).astype(np.int64)
        self.is_leaf = np.array(tree.feature) < 0
        self.child = np.stack([np.array(tree.right), np.array(tree.left)]).astype(np.int64)
        self.value = np.array(tree.value, float)
        self.goes_left = np.zeros((n, binning.width), bool)
        for i, f in enumerate(tree.feature):
            if f < 0:
                continue
            row = self.goes_left[i]
            if binning.bounds[f] is None:
                row[[c + 1 for c in tree.codes[i] if 0 <= c < binning.sizes[f] - 1]] = True
            else:
                row[1:np.searchsorted(binning.bounds[f], tree.bound[i]) + 2] = True
            row[0] = tree.missing_left[i]
        self.depth = self._depth(tree)

    @staticmethod
    def _depth(tree: Tree) -> int:
        depth = [0] * len(tree.feature)
        for i, f in enumerate(tree.feature):       # parents come before their children
            if f >= 0:
                depth[tree.left[i]] = depth[tree.right[i]] = depth[i] + 1
        return max(depth)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each column of a (features x rows) matrix."""
        n = bins.shape[1]
        at = np.zeros(n, np.int64)
        flat, place = bins.ravel(), np.arange(n)
        width = self.goes_left.shape[1]
        decide = self.goes_left.ravel()
        child = self.child.ravel()
        size = self.child.shape[1]
        for _ in range(self.depth):
            seen = flat[self.feature[at] * n + place]
            at = child[decide[at * width + seen] * size + at]
        return at


@dataclass
class TreeModel:
    """Trees per member (a quantile or any name), over named features."""

    features: list[str]
    categories: dict[str, int]
    trees: dict[str, list[Tree]]
    history: dict[str, list[float]] = field(default_factory=dict)
    log_links: frozenset[str] = frozenset()     # members whose forecast is the exponential of the score

    @property
    def members(self) -> list[str]:
        return list(self.trees)

    def binning(self) -> Binning:
        """Bins at the bounds that the trees ask for."""
        bounds: dict[str, set] = {n: set() for n in self.features}
        for tree in (t for ts in self.trees.values() for t in ts):
            for f, b in zip(tree.feature, tree.bound, strict=True):
                if f >= 0 and b is not None:
                    bounds[self.features[f]].add(b)
        return Binning.build(self.features, {n: np.array(sorted(b)) for n, b in bounds.items()}, self.categories)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The tree table; its size is that of the model."""
        found = []
        for member, trees in self.trees.items():
            for t, tree in enumerate(trees):
                for i, f in enumerate(tree.feature):
                    found.append((member, t - 1, i, self.features[f] if f >= 0 else None, tree.bound[i],
                                  tree.codes[i], bool(tree.missing_left[i]), int(tree.left[i]),
                                  int(tree.right[i]), float(tree.value[i]), float(tree.cover[i]),
                                  float(tree.gain[i])))
        return spark.createDataFrame(found, TREE_TABLE)

    @staticmethod
    def from_rows(table: DataFrame, features: list[str], categories: dict[str, int]) -> "TreeModel":
        trees: dict[str, dict[int, list]] = {}
        for r in table.orderBy("member", "tree", "node").collect():
            trees.setdefault(r["member"], {}).setdefault(r["tree"], []).append(r)
        index = {n: i for i, n in enumerate(features)}

        def tree(rows: list) -> Tree:
            if [r["node"] for r in rows] != list(range(len(rows))):
                raise ValueError("nodes of a tree are numbered from 0, parents first")
            return Tree([-1 if r["feature"] is None else index[r["feature"]] for r in rows],
                        *[[r[c] for r in rows] for c in (
                            "bound", "codes", "missing_left", "left", "right", "value", "cover", "gain")])
        return TreeModel(features, categories, {
            m: [tree(ts[t]) for t in sorted(ts)] for m, ts in trees.items()})

    def scorer(self) -> "Scorer":
        binning = self.binning()
        return Scorer(binning, [[Walker(t, binning) for t in ts] for ts in self.trees.values()],
                      np.array([m in self.log_links for m in self.trees]))

    def score(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        """Add each member's forecast, never below zero, as an array, to rows that carry codes.

        One pass over Arrow batches walks all trees of all members.
        """
        scorer, n = self.scorer(), len(self.features)
        width = len(df.columns)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = scorer.forecasts(numbers(batch, range(width, width + n)))
                flat = pa.array(found.T.ravel())
                offsets = pa.array(np.arange(0, len(flat) + 1, len(scorer.walkers), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], pa.ListArray.from_arrays(offsets, flat)],
                    [*batch.schema.names[:width], out])
        schema = df.withColumn(out, F.array().cast("array<double>")).schema
        return df.select("*", *values(self.features, self.categories)).mapInArrow(walk, schema)


@dataclass
class Scorer:
    """A model ready for bins."""

    binning: Binning
    walkers: list[list[Walker]]
    log_link: np.ndarray

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """Raw scores, one row per member."""
        out = np.zeros((len(self.walkers), bins.shape[1]))
        for begin in range(0, bins.shape[1], ROWS_AT_ONCE):
            part = np.ascontiguousarray(bins[:, begin:begin + ROWS_AT_ONCE])
            for m, walkers in enumerate(self.walkers):
                for w in walkers:
                    out[m, begin:begin + ROWS_AT_ONCE] += w.value[w.nodes(part)]
        return out

    def forecasts(self, columns: list[np.ndarray]) -> np.ndarray:
        raw = self.raw(self.binning.matrix(columns))
        raw[self.log_link] = np.exp(raw[self.log_link])
        return np.maximum(raw, 0.0)


def node_sums(df: DataFrame, model: TreeModel, label: str) -> DataFrame:
    """(member, tree, node, n, total): rows of a coded table that reach each node, and their labels' sum."""
    binning, width = model.binning(), len(model.features)
    walkers = [(m, t - 1, tree, Walker(tree, binning)) for m, trees in model.trees.items()
               for t, tree in enumerate(trees)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(tree.feature))) for _, _, tree, _ in walkers]
        for batch in batches:
            columns = numbers(batch, range(width + 1))
            bins = binning.matrix(columns[:width])
            for total, (_, _, tree, walker) in zip(sums, walkers, strict=True):
                leaf = walker.nodes(bins)
                total[0] += np.bincount(leaf, minlength=total.shape[1])
                total[1] += np.bincount(leaf, columns[width], total.shape[1])
        for total, (member, t, tree, _) in zip(sums, walkers, strict=True):
            for i in range(len(tree.feature) - 1, -1, -1):      # children come after their parents
                if tree.feature[i] >= 0:
                    total[:, i] = total[:, tree.left[i]] + total[:, tree.right[i]]
            n = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([member] * n), pa.array([t] * n, pa.int32()), pa.array(range(n), pa.int32()),
                 pa.array(total[0].astype(np.int64)), pa.array(total[1])], ["member", "tree", "node", "n", "total"])
    rows = df.select(*values(model.features, model.categories), F.col(label).cast("double").alias("_label"))
    return rows.mapInArrow(count, "member string, tree int, node int, n long, total double").groupBy(
        "member", "tree", "node").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def refreshed(df: DataFrame, model: TreeModel, label: str) -> DataFrame:
    """The tree table with covers and gains (falls of the squared error) as a given table has them."""
    sums = node_sums(df, model, label)
    fit = sums.withColumn("fit", F.coalesce(F.try_divide(F.col("total") * F.col("total"), F.col("n")), F.lit(0.0)))
    own = fit.select("member", "tree", "node", F.col("n").cast("double").alias("cover"), F.col("fit").alias("_own"))

    def child(side: str) -> DataFrame:
        return fit.select("member", "tree", F.col("node").alias(side), F.col("fit").alias(f"_{side}"))
    key = ["member", "tree"]
    table = model.rows(df.sparkSession).drop("cover", "gain").join(own, [*key, "node"])
    both = table.join(child("left"), [*key, "left"]).join(child("right"), [*key, "right"])
    gain = F.when(F.col("feature").isNotNull(), F.col("_left") + F.col("_right") - F.col("_own")).otherwise(0.0)
    return both.withColumn("gain", gain).select(*[c.split()[0] for c in TREE_TABLE.split(", ")])


def gains(table: DataFrame) -> DataFrame:
    """Total gain per member and feature of a tree table."""
    return table.filter(F.col("feature").isNotNull()).groupBy("member", "feature").agg(
        F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))


def importance(table: DataFrame, features: list[str], k: int = 15) -> DataFrame:
    """Gain per feature averaged over all members of the table; the k largest, unused features with 0."""
    spark = table.sparkSession
    members = table.agg(F.count_distinct("member").alias("n")).scalar()
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    summed = gains(table).groupBy("feature").agg(F.sum("gain").alias("gain"), F.sum("splits").alias("splits"))
    mean = names.join(summed, "feature", "left").select(
        "feature", (F.coalesce("gain", F.lit(0.0)) / members).alias("mean_gain"),
        F.coalesce("splits", F.lit(0)).alias("splits"))
    rank = F.row_number().over(Window.orderBy(F.desc("mean_gain"), "feature"))     # as many rows as features
    return mean.withColumn("rank", rank).filter(F.col("rank") <= k)
