"""Given trees for the queries that SQL repeats; splits over data, with values chosen by hand.

A split is (feature, bound or stores that go left, missing values go left, left, right); a leaf is its value.
Each member starts with its start value.
"""

from __future__ import annotations

from shelfcast.models.scoring import ForecastModel
from shelfcast.models.trees import Tree, TreeModel
from shelfcast.registry.tables import REGIONS
from shelfcast.sources.schemas import MAPPING

FIXED = {
    "first": [1.5, ("lag_28", 3.0, True, -2.0, 3.0), ("wday", 2.0, True, 0.5, -0.5)],
    "second": [4.0, ("sell_price", 1000.0, True, 0.25, 2.5)],
}
DAY_FEATURES = ["lag_28", "roll_mean_28_lag_28", "price_momentum_28d", "sell_price", "store_id", "wday", "horizon_day"]
DAYS = {
    "0.25": [0.5, ("lag_28", 4.0, True, ("store_id", ["AFRICA", "EUROPE"], False, -0.75, 0.25), 2.0)],
    "0.5": [2.0, ("price_momentum_28d", 1.0, False, ("lag_28", 10.0, True, 0.5, 3.5), -0.25),
            ("roll_mean_28_lag_28", 4.5, False, -1.0, ("wday", 2.0, False, 2.5, 0.75))],
    "0.75": [6.0, ("roll_mean_28_lag_28", 6.0, True, ("store_id", ["ASIA"], True, 1.5, -2.0),
                   ("horizon_day", 14.0, False, 4.0, 5.5)),
             ("sell_price", 1500.0, True, 0.5, ("lag_28", 0.0, False, -0.5, 1.25))],
}
STEP_FEATURES = ["roll_mean_7", "roll_mean_28", "sell_price", "store_id", "wday", "snap_CA"]
STEPS = {
    "0.25": [0.25, ("roll_mean_7", 2.0, True, 0.125, ("wday", 2.0, False, 2.5, 1.5))],
    "0.5": [1.0, ("roll_mean_28", 3.0, False, ("store_id", ["AMERICA", "ASIA"], False, 0.75, 0.25), 3.25)],
    "0.75": [3.0, ("roll_mean_7", 5.0, True, ("snap_CA", 0.0, False, 0.5, 1.0), 6.5),
             ("sell_price", 1200.0, True, -0.5, 0.75)],
}


def tree(spec, features: list[str]) -> Tree:
    """The nodes of one given tree, by level."""
    out = Tree([], [], [], [], [], [], [], [], [])
    specs = [spec]
    for node in specs:
        inner = isinstance(node, tuple)
        stores = inner and isinstance(node[1], list)
        out.feature.append(features.index(node[0]) if inner else -1)
        out.bound.append(node[1] if inner and not stores else None)
        out.codes.append([REGIONS.index(x) for x in node[1]] if stores else None)
        out.missing_left.append(bool(inner and node[2]))
        at = len(out.left)
        out.left.append(len(specs) if inner else at)
        out.right.append(len(specs) + 1 if inner else at)
        if inner:
            specs += node[3:]
        out.value.append(0.0 if inner else node)
        out.cover.append(0.0)
        out.gain.append(0.0)
    return out


def model(specs: dict[str, list], features: list[str], spark) -> ForecastModel:
    """Trees over features; stores are coded in alphabetical order."""
    categories = {"store_id": len(REGIONS)} if "store_id" in features else {}
    mapping = spark.createDataFrame([("store_id", x, i) for i, x in enumerate(REGIONS)], MAPPING)
    return ForecastModel(TreeModel(features, categories, {
        name: [tree(s, features) for s in trees] for name, trees in specs.items()}), mapping)
