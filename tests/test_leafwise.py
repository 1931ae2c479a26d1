"""Leaf-wise boosting against a plain version that grows one best leaf at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.models import bins, leafwise, losses
from shelfcast.models.leafwise import Growing, Member, Params, Split
from shelfcast.models.trees import TreeModel, importance

NAMES = ["a", "b", "kind"]
SIZES = {"kind": 6}
EVERYTHING = {"bagging_share": 1.0, "feature_share": 1.0}


def make(n=1500, seed=5):
    rng = np.random.default_rng(seed)
    a, b, k = rng.random(n) * 10, rng.normal(size=n).round(1), rng.integers(0, 6, n)
    y = a + 4.0 * (k % 3 == 1) + np.where(rng.random(n) < 0.3, 3 * b, 0) + rng.exponential(2.0, n)
    a[rng.random(n) < 0.15] = np.nan
    y = y + np.where(np.isnan(a), 6.0, 0.0)
    return a, b, k.astype(float), y


@pytest.fixture(scope="module")
def rows(spark):
    a, b, k, y = make()
    data = [(i, None if np.isnan(a[i]) else float(a[i]), float(b[i]), None if i % 50 == 0 else int(k[i]),
             float(y[i]), i % 4) for i in range(len(a))]
    return spark.createDataFrame(
        data, "id long, a double, b double, kind_code int, target double, tag int").repartition(5).cache()


def fitted(rows, members, params, names=NAMES, sizes=SIZES):
    binning = bins.fit(rows, names, sizes, params.max_bins)
    table = bins.blocks(rows, binning, sizes, "target", F.col("tag"), ["id"], len(members))
    return leafwise.train(table, binning, sizes, members, params), binning


def plain_tree(columns, y, f, alpha, binning, params):
    """Best leaf first, every split searched anew over the rows; returns the leaf of each row."""
    matrix = binning.matrix(columns)
    g = np.where(y > f, alpha, alpha - 1.0)

    def best(rows):
        found = None
        for j in range(len(columns)):
            x, category = matrix[j, rows], binning.bounds[j] is None
            l2 = params.category_l2 if category else 0.0
            if category:
                values = [v for v in np.unique(x)]
                values.sort(key=lambda v: g[rows][x == v].sum() / ((x == v).sum() + params.category_smooth))
                options = [np.isin(x, values[:i]) for i in range(1, len(values))]
            else:
                cuts = range(1, binning.sizes[j] - 1)
                options = [(x > 0) & (x <= c) for c in cuts] + [x <= c for c in cuts]
            total = g[rows].sum() ** 2 / (len(rows) + l2)
            for left in options:
                n = left.sum()
                if min(n, len(rows) - n) < params.min_leaf_rows:
                    continue
                gain = (g[rows][left].sum() ** 2 / (n + l2) + g[rows][~left].sum() ** 2 / (len(rows) - n + l2) - total)
                if gain > 1e-10 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left)
        return found
    leaves = [(best(np.arange(len(y))), np.arange(len(y)))]
    while len(leaves) < params.leaves:
        i = max(range(len(leaves)), key=lambda i: leaves[i][0][0] if leaves[i][0] else -1)
        if not leaves[i][0]:
            break
        (_, left), at = leaves.pop(i)
        leaves += [(best(at[left]), at[left]), (best(at[~left]), at[~left])]
    return [at for _, at in leaves]


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.9])
def test_trees_equal_plain_growth(rows, alpha):
    params = Params(rounds=3, leaves=9, learning_rate=0.5, min_leaf_rows=15, max_bins=16, **EVERYTHING)
    model, binning = fitted(rows, [Member("m", losses.Quantile(alpha))], params)
    got = rows.orderBy("id").toPandas()
    columns = [got["a"].to_numpy(float), got["b"].to_numpy(float), got["kind_code"].to_numpy(float)]
    y = got["target"].to_numpy()

    def percentile(v):
        return np.sort(v)[max(0, int(np.ceil(alpha * len(v) - 1e-9)) - 1)]
    f = np.full(len(y), percentile(y))
    for _ in range(params.rounds):
        step = np.zeros(len(y))
        for at in plain_tree(columns, y, f, alpha, binning, params):
            step[at] = params.learning_rate * percentile(y[at] - f[at])
        f = f + step
    raw = model.scorer().raw(model.binning().matrix(columns))[0]
    np.testing.assert_allclose(raw, f, atol=1e-9)


def test_members_grow_together_as_alone(rows):
    params = Params(rounds=4, leaves=12, learning_rate=0.3, patience=2, seed=3)
    members = [Member(f"{q}/{t}", losses.Quantile(q), t, t - 1) for q in (0.2, 0.8) for t in (1, 2)]
    together, _ = fitted(rows, members, params)
    x = [np.array([1.0, np.nan, 9.0]), np.array([0.0, 1.0, np.nan]), np.array([0.0, 5.0, np.nan])]
    for member in members[:1]:
        alone, _ = fitted(rows, [member], params)
        np.testing.assert_allclose(alone.scorer().forecasts(x)[0], together.scorer().forecasts(x)[0])
        assert alone.history[member.name] == pytest.approx(together.history[member.name])
    for member in members:
        history = together.history[member.name]
        assert len(together.trees[member.name]) == 1 + min(len(history), int(np.argmin(history)) + 1)


def test_the_spread_of_rows_changes_nothing(rows):
    params = Params(rounds=3, leaves=16, min_leaf_rows=5)
    members = [Member("q", losses.Quantile(0.7)), Member("t", losses.Tweedie()), Member("s", losses.Asymmetric())]
    one, _ = fitted(rows, members, params)
    other, _ = fitted(rows.repartition(3), members, params)
    for m in one.trees:
        for a, b in zip(one.trees[m], other.trees[m], strict=True):
            assert (a.feature, a.bound, a.codes, a.left) == (b.feature, b.bound, b.codes, b.left)
            np.testing.assert_allclose(a.value, b.value, atol=1e-9)


def test_missing_values_go_where_they_belong(spark):
    rows = spark.createDataFrame(
        [(i, None if i % 2 else float(i % 10), 10.0 if i % 2 or i % 10 > 5 else 0.0, 1) for i in range(400)],
        "id long, a double, target double, tag int")
    model, _ = fitted(rows, [Member("m", losses.Squared())], Params(rounds=1, leaves=2, learning_rate=1.0, **EVERYTHING),
                      ["a"], {})
    tree = model.trees["m"][1]
    assert tree.feature[0] == 0 and not tree.missing_left[0]
    np.testing.assert_allclose(model.scorer().forecasts([np.array([np.nan, 0.0, 4.0, 6.0])])[0], [10, 0, 0, 10])


def test_three_thousand_categories(spark):
    rng = np.random.default_rng(2)
    good = set(rng.choice(3000, 1500, replace=False).tolist())
    rows = spark.createDataFrame(
        [(i, i % 3000, 5.0 if i % 3000 in good else 1.0, 1) for i in range(30_000)],
        "id long, shop_code int, target double, tag int")
    model, _ = fitted(rows, [Member("m", losses.Squared())],
                      Params(rounds=1, leaves=2, learning_rate=1.0, **EVERYTHING), ["shop"], {"shop": 3000})
    x = np.arange(3000.0)
    want = np.array([5.0 if i in good else 1.0 for i in range(3000)])
    np.testing.assert_allclose(model.scorer().forecasts([x])[0], want, atol=1e-6)
    assert model.scorer().forecasts([np.array([np.nan, 3000.0, -4.0])]).shape == (1, 3)


def test_losses_fall_and_cover(rows):
    params = Params(rounds=15, leaves=8, learning_rate=0.2)
    members = [Member(n, x, 1, 0) for n, x in (
        ("q", losses.Quantile(0.8)), ("s", losses.Squared()), ("a", losses.Asymmetric()), ("t", losses.Tweedie()))]
    model, _ = fitted(rows, members, params)
    for m in model.members:
        assert len(model.history[m]) == 15 and model.history[m][-1] < model.history[m][0]
    quantile = TreeModel(model.features, model.categories, {"q": model.trees["q"]})
    covered = quantile.score(rows.filter("tag > 0")).agg(
        F.avg((F.col("target") <= F.col("yhat")[0]).cast("double"))).first()[0]
    assert abs(covered - 0.8) < 0.05


def test_tree_table_round_trip(spark, rows, tmp_path):
    params = Params(rounds=3, leaves=6, min_leaf_rows=10)
    model, _ = fitted(rows, [Member("0.2", losses.Quantile(0.2)), Member("0.8", losses.Quantile(0.8))], params)
    model.rows(spark).write.parquet(str(tmp_path / "trees"))
    table = spark.read.parquet(str(tmp_path / "trees"))
    back = TreeModel.from_rows(table, NAMES, SIZES)
    a, b = (sorted(map(tuple, m.score(rows).select("id", F.col("yhat")[0], F.col("yhat")[1]).collect()))
            for m in (model, back))
    assert a == b
    first = importance(table, NAMES).collect()
    assert [r["rank"] for r in first] == [1, 2, 3] and first[0]["mean_gain"] >= first[1]["mean_gain"]
    for trees in model.trees.values():
        for tree in trees[1:]:
            inner = [i for i, f in enumerate(tree.feature) if f >= 0]
            assert all(tree.cover[i] == tree.cover[tree.left[i]] + tree.cover[tree.right[i]] for i in inner)


def test_order_of_splits():
    tree = Growing()
    tree.learn(0, Split(5.0, 0, 1, False, [], 10, 10))
    assert tree.expand(3) == [(0, 1, 2)]
    tree.learn(1, Split(9.0, 0, 1, False, [], 5, 5))
    tree.learn(2, Split(4.0, 0, 1, False, [], 4, 6))
    assert tree.taken(3) == [0, 1] and tree.taken(4) == [0, 1, 2]
    assert tree.expand(3) == [(1, 3, 4)]


def test_no_rows_to_learn_from_and_constant_target(spark):
    rows = spark.createDataFrame([(i, float(i), 2.0, 1) for i in range(100)], "id long, a double, target double, tag int")
    model, _ = fitted(rows, [Member("m", losses.Quantile(0.5))], Params(rounds=2), ["a"], {})
    np.testing.assert_allclose(model.scorer().forecasts([np.array([1.0, np.nan])]), 2.0)
