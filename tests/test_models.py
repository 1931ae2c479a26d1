"""Scoring, recursion, attribution and evaluation on small tables."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.models import bins, explain, leafwise, losses, recursive, scoring, trainers
from shelfcast.models.leafwise import Member, Params
from shelfcast.plans import evaluation
from shelfcast.sources.schemas import CATEGORY_COLUMNS, LEGACY_COLUMNS

NAMES = ["a", "b", "kind"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 900
    a, b, k = rng.random(n) * 10, rng.random(n), rng.integers(0, 4, n)
    y = a + 3.0 * (k == 2) + rng.exponential(2.0, n)
    return spark.createDataFrame(
        [(int(i), None if i % 9 == 0 else float(a[i]), float(b[i]), int(k[i]), float(y[i])) for i in range(n)],
        "id long, a double, b double, kind_code int, target double").cache()


@pytest.fixture(scope="module")
def fitted(rows):
    params = Params(rounds=4, leaves=8, learning_rate=0.4)
    binning = bins.fit(rows, NAMES, {"kind": 4}, params.max_bins)
    blocks = bins.blocks(rows, binning, {"kind": 4}, "target", F.lit(1), ["id"], 2)
    return leafwise.train(blocks, binning, {"kind": 4},
                          [Member("0.2", losses.Quantile(0.2)), Member("0.8", losses.Quantile(0.8))], params)


@pytest.mark.parametrize("loss", [losses.Squared(), losses.Asymmetric(), losses.Tweedie()])
def test_gradients_match_differences(spark, loss):
    df = spark.createDataFrame([(0.0, 0.3), (2.0, 0.7), (5.0, 1.9)], "y double, f double")
    y, f, h = F.col("y"), F.col("f"), 1e-5
    slope = -(loss.value(y, f + h) - loss.value(y, f - h)) / (2 * h)
    got = df.select(F.max(F.abs(slope - loss.gradient(y, f)))).first()[0]
    assert got < 1e-5
    if isinstance(loss, losses.Tweedie):
        bend = -(loss.gradient(y, f + h) - loss.gradient(y, f - h)) / (2 * h)
        assert df.select(F.max(F.abs(bend - loss.curvature(y, f)))).first()[0] < 1e-5
    ys, fs = np.array([0.0, 2.0, 5.0]), np.array([0.3, 0.7, 1.9])
    both = df.select(loss.gradient(y, f), loss.value(y, f)).collect()
    np.testing.assert_allclose(loss.slopes(ys, fs)[0], [r[0] for r in both])
    np.testing.assert_allclose(loss.losses(ys, fs), [r[1] for r in both])


def brute_force(x, leaves, width):
    """Shapley values by definition, over all coalitions of all features."""
    def value(known):
        total = 0.0
        for v, path in leaves:
            p = v
            for f, (open_, kept) in path.items():
                p *= float(open_[x[f]]) if f in known else kept
            total += p
        return total
    out = np.zeros(width)
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        for size in range(width):
            w = factorial(size) * factorial(width - size - 1) / factorial(width)
            for s in combinations(rest, size):
                out[i] += w * (value(set(s) | {i}) - value(set(s)))
    return out


def test_attribution_by_definition_and_additivity(rows, fitted):
    binning = fitted.binning()
    leaves = {m: explain.leaf_paths(fitted.trees[m], binning) for m in fitted.members}
    sample = rows.orderBy("id").limit(12).toPandas()
    columns = [sample[c].to_numpy(float) for c in ("a", "b", "kind_code")]
    matrix = binning.matrix(columns)
    raw = fitted.scorer().raw(matrix)
    for i, m in enumerate(fitted.members):
        got = explain.shapley_values(matrix, leaves[m])
        for j in range(12):
            np.testing.assert_allclose(got[:, j], brute_force(matrix[:, j], leaves[m], 3), atol=1e-9)
        np.testing.assert_allclose(raw[i], got.sum(axis=0) + explain.base_value(leaves[m]), atol=1e-9)
    table = explain.attributions(rows, fitted, ["id"], fitted.members).filter("id < 12").toPandas()
    total = table.groupby(["member", "id"])["impact"].sum()
    for i, m in enumerate(fitted.members):
        np.testing.assert_allclose(total[m].to_numpy(), raw[i] - explain.base_value(leaves[m]), atol=1e-9)
    assert table[(table["feature"] == "a") & (table["id"] == 0)]["value"].isna().all()


def test_scenarios_override_only_given_values(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, p double, r double")
    cases = spark.createDataFrame([("same", None, None), ("cheap", 1.0, None)], "scenario string, p double, r double")
    got = {r["scenario"]: (r["p"], r["r"]) for r in explain.scenarios(df, cases, ["p", "r"]).collect()}
    assert got == {"same": (2.0, 3.0), "cheap": (1.0, 3.0)}


def legacy_rows(spark, n=130):
    rng = np.random.default_rng(3)
    rows = []
    for i, item in enumerate(["I1", "I2"]):
        for d in range(1, n + 1):
            rows.append((item, "D", "C", "S", "CA", d, int(rng.poisson(4 + 4 * i)), (d - 1) % 7 + 1, 1,
                         2.0, 1.0, float(rng.random() * 9), float(rng.random() * 9), 1, 0, 0))
    return spark.createDataFrame(
        rows, "item_id string, dept_id string, cat_id string, store_id string, state_id string, d int, "
        "sales int, wday int, month int, sell_price double, price_norm double, roll_mean_7 double, "
        "roll_mean_28 double, snap_CA int, snap_TX int, snap_WI int")


def short(**more):
    return Params(rounds=2, leaves=6, learning_rate=0.5, **more)


def days(first, last):
    return [(d, (d - 1) % 7 + 1, 1, 1, 0, 0) for d in range(first, last)]


CALENDAR = "d int, wday int, month int, snap_CA int, snap_TX int, snap_WI int"


def test_recursion_follows_its_own_output(spark, tmp_path):
    df = legacy_rows(spark)
    fitted = scoring.train_recursive(df, [0.25, 0.5, 0.75], short())
    fitted.save(str(tmp_path / "m"))
    model = scoring.ForecastModel.load(spark, str(tmp_path / "m"), fitted.trees.members)
    calendar = spark.createDataFrame(days(1, 140), CALENDAR)
    got = recursive.recursive_forecast(model, recursive.seeds(df), calendar)
    assert got.count() == 2 * 2 * 28

    sales = [r["sales"] for r in df.filter("item_id = 'I2'").orderBy("d").collect()][-84:]
    mapped = {(r["column"], r["value"]): r["code"] for r in fitted.mapping.collect()}
    window = [float(x) for x in sales[56:]]
    scorer = fitted.trees.scorer()

    def mean(v):
        return float(np.mean(v)) if len(v) else np.nan
    want = []
    for i in range(28):
        d = min(131 + i, 139)
        codes = [mapped[c, v] for c, v in zip(CATEGORY_COLUMNS, ["I2", "D", "C", "S", "CA"])]
        x = [float(v) for v in [*codes, (d - 1) % 7 + 1, 1, 2.0, 1.0, mean(window[-35:-28]), mean(window[-56:-28]), 1, 0, 0]]
        assert len(x) == len(LEGACY_COLUMNS)
        q = scorer.forecasts([np.array([v]) for v in x])[:, 0]
        want.append(q)
        window.append(0.7 * float(np.mean(q)) + 0.3 * q[2])
    found = got.filter("item_id = 'I2' and kind = 'forecast'").orderBy("h").collect()
    np.testing.assert_allclose([r["yhat"] for r in found], want, atol=1e-9)


def test_recursion_is_one_stage_over_the_series(spark):
    df = legacy_rows(spark)
    model = scoring.train_recursive(df, [0.25, 0.5, 0.75], short())
    plan = recursive.recursive_forecast(model, recursive.seeds(df), spark.createDataFrame(days(1, 170), CALENDAR))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") == 1


def test_cross_validation_with_pluggable_trainer(spark):
    df = legacy_rows(spark)
    table = evaluation.cross_validate(df, trainers.boosted(losses.Squared(), short(patience=1)), 130, folds=2)
    got = {r["fold"]: r for r in table.collect()}
    assert set(got) == {1, 2} and all(r["rmse"] >= r["mae"] > 0 for r in got.values())


def test_losses_compared_over_folds_in_one_training(spark):
    df = legacy_rows(spark)
    table = trainers.compare_losses(df, {"s": losses.Squared(), "t": losses.Tweedie()}, short(), folds=2).collect()
    got = {(r["loss"], r["fold"]): r for r in table}
    assert set(got) == {("s", 1), ("s", 2), ("t", 1), ("t", 2)}
    alone = {r["fold"]: r for r in trainers.compare_losses(
        df.filter("d <= 130"), {"s": losses.Squared()}, short(), folds=2).collect()}
    assert alone[1]["rmse"] == pytest.approx(got["s", 1]["rmse"])


def test_validation_days_do_not_reach_training(spark):
    df = legacy_rows(spark)
    changed = df.withColumn("sales", F.when(F.col("d") > 102, F.col("sales") * 9).otherwise(F.col("sales"))) \
        .withColumn("item_id", F.when(F.col("d") > 102, F.concat("item_id", F.lit("x"))).otherwise(F.col("item_id")))
    a, b = (scoring.train_recursive(x, [0.5], short(), early_stop=True) for x in (df, changed))
    assert a.trees.categories == b.trees.categories
    for left, right in zip(a.trees.trees["0.5"], b.trees.trees["0.5"]):
        assert (left.feature, left.value) == (right.feature, right.value)
