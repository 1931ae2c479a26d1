"""Trainers for `cross_validate`: callables (train, valid, features, categoricals) -> scored rows."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from shelfcast.models import bins, leafwise
from shelfcast.models.leafwise import Member, Params
from shelfcast.models.losses import Loss
from shelfcast.operators import encode, horizon as hz, reshape
from shelfcast.plans import evaluation
from shelfcast.session import cut_lineage


def boosted(loss: Loss, params: Params = Params(learning_rate=0.03, leaves=256, min_leaf_rows=100),
            label: str = "sales") -> Callable[..., DataFrame]:
    """Boosted trees under any loss.  Categories are those of the training rows; a value first
    seen in validation counts as missing.  Weights serve the fold metrics only.
    With `params.patience` the newest 28 training days are set aside to stop early."""
    def train(train_df: DataFrame, valid_df: DataFrame, features: list[str],
              categoricals: list[str]) -> DataFrame:
        mapping = cut_lineage(encode.build_mapping(train_df, categoricals))
        sizes = encode.category_sizes(mapping)
        used = [f for f in features if f not in categoricals or f in sizes]
        kept = [c for c in categoricals if c in sizes]

        def coded(df: DataFrame) -> DataFrame:
            return encode.encode(df, mapping, kept, unseen="null", sizes=sizes)
        tag, member = F.lit(1), Member("m", loss, 1)
        if params.patience:
            tag = F.when(F.col("d") > hz.last_day_of(train_df) - hz.HORIZON, 0).otherwise(1)
            member = Member("m", loss, 1, 0)
        rows = coded(train_df)
        binning = bins.fit(rows, used, sizes, params.max_bins)
        blocks = cut_lineage(bins.blocks(rows, binning, sizes, label, tag, [*kept, *used, label], 1)).persist()
        try:
            model = leafwise.train(blocks, binning, sizes, [member], params)
        finally:
            blocks.unpersist()
        return model.score(coded(valid_df)).withColumn("yhat", F.col("yhat")[0])
    return train


def compare_losses(df: DataFrame, losses: dict[str, Loss], params: Params, folds: int = 3,
                   label: str = "sales") -> DataFrame:
    """Fold metrics of several losses, all folds and losses trained in one pass over one table.

    A row's tag says how many horizons before the last day it lies: fold f is judged on tag f - 1 and
    trains on all earlier days.  Categories are those of the rows before every fold.
    """
    df = encode.with_default_weights(df)
    features = reshape.feature_columns(df)
    categoricals = reshape.categorical_columns(df, features)
    tag = F.least(F.floor((hz.last_day_of(df) - F.col("d")) / hz.HORIZON), F.lit(folds)).cast("int")
    tagged = cut_lineage(df.filter(F.col(label).isNotNull()).withColumn("_fold", tag))
    mapping = cut_lineage(encode.build_mapping(tagged.filter(F.col("_fold") == folds), categoricals))
    sizes = encode.category_sizes(mapping)
    used = [f for f in features if f not in categoricals or f in sizes]
    rows = encode.encode(tagged, mapping, [c for c in categoricals if c in sizes], unseen="null", sizes=sizes)
    binning = bins.fit(rows, used, sizes, params.max_bins)
    members = [Member(f"{name}/{f}", loss, f) for name, loss in losses.items() for f in range(1, folds + 1)]
    blocks = cut_lineage(bins.blocks(rows, binning, sizes, label, F.col("_fold"), ["store_id", "item_id", "d"],
                                     len(members))).persist()
    try:
        model = leafwise.train(blocks, binning, sizes, members, params)
    finally:
        blocks.unpersist()
    scored = model.score(rows.filter(F.col("_fold") < folds))
    cells = F.array(*[F.struct(F.lit(name).alias("loss"), F.col("yhat")[i * folds + F.col("_fold")].alias("yhat"))
                      for i, name in enumerate(losses)])
    long = scored.select((F.col("_fold") + 1).alias("fold"), F.col(label).alias("sales"), "weight", "scale_factor",
                         F.inline(cells))
    return evaluation.fold_metrics(long, "sales", "yhat", by=["loss", "fold"])
