"""Training and scoring of forecast models: all quantiles, or all quantiles of all folds, at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfcast.functions import metrics
from shelfcast.models import bins, leafwise
from shelfcast.models.leafwise import Member, Params
from shelfcast.models.losses import Quantile
from shelfcast.models.trees import TREE_TABLE, TreeModel
from shelfcast.operators import encode, horizon as hz
from shelfcast.session import cut_lineage
from shelfcast.sources import readers, writers
from shelfcast.sources.schemas import (
    CATEGORY_COLUMNS, HORIZON_TRAIN_COLUMNS, LEGACY_COLUMNS, QUANTILES)

WEEKDAYS = "target_wday"


@dataclass
class ForecastModel:
    """Trees with the category codes they were trained under."""

    trees: TreeModel
    mapping: DataFrame

    @property
    def quantiles(self) -> list[float]:
        return [float(m) for m in self.trees.members]

    def encoded(self, df: DataFrame) -> DataFrame:
        """Add the category codes of training time, null for values unseen then."""
        sizes = self.trees.categories
        columns = [c for c in self.trees.features if c in sizes and c != WEEKDAYS]
        coded = encode.encode(df, self.mapping, columns, unseen="null", sizes=sizes)
        if WEEKDAYS in sizes:
            coded = coded.withColumn(f"{WEEKDAYS}_code", F.col(WEEKDAYS) - 1)
        return coded

    def score_encoded(self, df: DataFrame) -> DataFrame:
        return self.trees.score(df)

    def score(self, df: DataFrame) -> DataFrame:
        """Add `yhat`, the members' forecasts of a row as an array."""
        return self.score_encoded(self.encoded(df)).drop(*[f"{c}_code" for c in self.trees.categories])

    def save(self, path: str) -> None:
        """The tree table, the features in order, and the codes."""
        spark = self.mapping.sparkSession
        self.trees.rows(spark).write.parquet(f"{path}/trees")
        writers.write_mapping(self.mapping, f"{path}/mapping")
        rows = [(i, n, self.trees.categories.get(n)) for i, n in enumerate(self.trees.features)]
        spark.createDataFrame(rows, "place int, feature string, codes int").coalesce(1).write.json(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str, members: list[str]) -> "ForecastModel":
        rows = spark.read.schema("place int, feature string, codes int").json(f"{path}/features").orderBy("place").collect()
        trees = TreeModel.from_rows(
            spark.read.schema(TREE_TABLE).parquet(f"{path}/trees"), [r["feature"] for r in rows],
            {r["feature"]: r["codes"] for r in rows if r["codes"] is not None})
        trees.trees = {m: trees.trees[m] for m in members}
        return ForecastModel(trees, readers.read_mapping(spark, f"{path}/mapping"))


def fit(rows: DataFrame, features: list[str], label: str, tag: Column, members: list[Member], params: Params,
        keys: list[str], category_rows: DataFrame) -> ForecastModel:
    """Train all members on one binned table.

    Codes are those of `category_rows`, which should hold training rows only; bins are those of all rows.
    The table and the mapping are checkpointed, so a lost executor costs a read and not the plan behind them.
    """
    columns = [c for c in CATEGORY_COLUMNS if c in features]
    mapping = cut_lineage(encode.build_mapping(category_rows, columns))
    sizes = encode.category_sizes(mapping)
    if WEEKDAYS in features:
        sizes[WEEKDAYS] = 7
    model = ForecastModel(TreeModel(features, sizes, {}), mapping)
    coded = model.encoded(rows)
    binning = bins.fit(coded, features, sizes, params.max_bins)
    blocks = cut_lineage(bins.blocks(coded, binning, sizes, label, tag, keys, len(members))).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        model.trees = leafwise.train(blocks, binning, sizes, members, params)
    finally:
        blocks.unpersist()
    return model


def quantile_members(quantiles: list[float], early_stop: bool) -> list[Member]:
    """Members that train on all rows but those of tag 0, the hold-out."""
    return [Member(str(q), Quantile(q), 1, 0 if early_stop else None) for q in quantiles]


def held_back(split: int) -> Column:
    """Tag 0 for rows past the split day, 1 for training rows."""
    return F.when(F.col("d") > split, 0).otherwise(1)


def train_horizon(features: DataFrame, quantiles: list[float] = QUANTILES, params: Params = Params(),
                  days: int = 365, early_stop: bool = False) -> ForecastModel:
    """Direct-horizon model: window of recent anchors, 28 targets each, split by anchor day."""
    window = hz.training_window(features, days)
    split = features.agg(F.max("d")).first()[0] - hz.HORIZON
    return fit(hz.expand_horizons(window), HORIZON_TRAIN_COLUMNS, "target", held_back(split),
               quantile_members(quantiles, early_stop), params, ["store_id", "item_id", "d", "horizon_day"],
               window.filter(F.col("d") <= split))


def train_recursive(features: DataFrame, quantiles: list[float] = QUANTILES, params: Params = Params(),
                    early_stop: bool = False) -> ForecastModel:
    """One-day model on the legacy features, split by day."""
    split = features.agg(F.max("d")).first()[0] - hz.HORIZON
    return fit(features, LEGACY_COLUMNS, "sales", held_back(split), quantile_members(quantiles, early_stop),
               params, ["store_id", "item_id", "d"], features.filter(F.col("d") <= split))


def train_folds(features: DataFrame, folds: int = 3, quantiles: list[float] = QUANTILES,
                params: Params = Params(), days: int = 365) -> tuple[ForecastModel, DataFrame]:
    """Quantile models of every expanding fold, and the folds' validation rows scored by their own models.

    A row's tag says how many horizons before the end its anchor lies.  Fold f is judged on tag f - 1 and
    trains on all tags from f on, so one pass over one table serves all folds and quantiles.
    """
    window = hz.training_window(features, days + folds * hz.HORIZON)
    last = features.agg(F.max("d")).first()[0]
    tag = F.least(F.floor((F.lit(last) - F.col("d")) / hz.HORIZON), F.lit(folds)).cast("int")
    stacked = hz.expand_horizons(window)
    members = [Member(f"{f}/{q}", Quantile(q), f, f - 1) for f in range(1, folds + 1) for q in quantiles]
    model = fit(stacked, HORIZON_TRAIN_COLUMNS, "target", tag, members, params,
                ["store_id", "item_id", "d", "horizon_day"], window.filter(F.col("d") <= last - folds * hz.HORIZON))
    scored = model.score(stacked.filter(tag < folds)).withColumn("fold", tag + 1)
    n = len(quantiles)
    own = F.slice("yhat", (F.col("fold") - 1) * n + 1, F.lit(n))
    return model, scored.withColumn("yhat", own)


def fold_quantile_losses(scored: DataFrame, quantiles: list[float], actual: str = "target") -> DataFrame:
    """Mean loss per fold, horizon and quantile, and the fold's mean over its horizons."""
    cells = F.array(*[F.struct(F.lit(q).alias("q"), F.col("yhat")[i].alias("p")) for i, q in enumerate(quantiles)])
    losses = scored.select("fold", "horizon_day", actual, F.inline(cells)).groupBy("fold", "horizon_day", "q").agg(
        F.avg(metrics.pinball(actual, "p", F.col("q"))).alias("loss"))
    per_fold = losses.groupBy("fold", "q").agg(F.avg("loss").alias("fold_loss"))
    return losses.join(per_fold, ["fold", "q"])
