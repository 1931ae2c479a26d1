"""Reshaping, ranking, horizons, encoding, store and reports on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import metrics, scalars
from shelfcast.operators import encode, horizon, lookup, ranking, reshape, summaries
from shelfcast.plans import forecast, leaderboard, store, submission
from shelfcast.plans.preprocess import preprocess
from shelfcast.session import cut_lineage, shared_dir
from shelfcast.sources import readers, writers
from shelfcast.sources.schemas import QUANTILES, require_columns


def long_table(spark, n=70, items=("FOODS_1_001", "FOODS_2_002")):
    rows = [("CA_1" if i % 2 == 0 else "TX_1", item, d, (d * (i + 1)) % 5, (d - 1) % 7 + 1)
            for i, item in enumerate(items) for d in range(1, n + 1)]
    return spark.createDataFrame(rows, "store_id string, item_id string, d int, sales int, wday int")


def test_unpivot_inverts_pivot_and_keeps_nulls(spark):
    long = long_table(spark, 30).withColumn(
        "sales", F.when(F.col("d") % 4 > 0, F.col("sales")))
    wide = reshape.pivot_days(long, 1, 30)
    back = reshape.unpivot_days(wide)
    key = ["store_id", "item_id", "d"]
    assert back.count() == 60
    assert back.select(*key, "sales").exceptAll(long.select(*key, "sales")).count() == 0


def test_numbered_is_the_same_for_any_cut(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k"))
    one = ranking.numbered(df, "k")
    many = ranking.numbered(df, "k", buckets=7, single_task_rows=100)
    assert many.select("k", "rn").exceptAll(one.select("k", F.col("rn").cast("int").alias("rn"))).count() == 0
    assert many.agg(F.max("rn")).first()[0] == 5000


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(3000).withColumn("id", F.col("id") % 1000)
    a = ranking.sample_ids(df, "id", 0.05)
    b = ranking.sample_ids(df.repartition(7), "id", 0.05, single_task_rows=10)
    assert a.count() == 50 and a.exceptAll(b).count() == 0


def test_horizon_expansion_row_count_and_gaps(spark):
    df = long_table(spark, 50)
    out = horizon.expand_horizons(df)
    assert out.count() == 2 * sum(min(28, 50 - k) for k in range(1, 51))
    gaps = df.filter(F.col("d") % 10 != 0)
    strict = horizon.expand_horizons(gaps, strict_days=True)
    wrong = strict.join(gaps.select("store_id", "item_id", (F.col("d")).alias("t"), F.col("sales").alias("s")),
                        ["store_id", "item_id"]).filter(
        (F.col("t") == F.col("d") + F.col("horizon_day")) & (F.col("s") != F.col("target")))
    assert wrong.count() == 0
    assert strict.filter((F.col("d") + F.col("horizon_day")) % 10 == 0).count() == 0


def test_fold_bounds_agree_with_the_fold_column(spark):
    assert [horizon.fold_bounds(f, 1913) for f in (1, 2)] == [(1886, 1913), (1858, 1885)]
    days = spark.range(1800, 1920).select(F.col("id").cast("int").alias("d")).withColumn(
        "fold", horizon.fold_column(F.lit(1913), 3)).groupBy("fold").agg(F.min("d"), F.max("d"))
    assert {r[0]: (r[1], r[2]) for r in days.collect() if r[0]} == {
        f: horizon.fold_bounds(f, 1913) for f in (1, 2, 3)}


def test_unknown_pairs_are_not_filtered(spark):
    ask = spark.createDataFrame([("A", "x"), ("A", "y")], "store_id string, item_id string")
    other = spark.createDataFrame([("B", "x")], "store_id string, item_id string")
    one = spark.createDataFrame([("A", "y"), ("B", "x")], "store_id string, item_id string")
    assert lookup.keep_available(ask, other).count() == 2
    assert [tuple(r) for r in lookup.keep_available(ask, one).collect()] == [("A", "y")]


def test_csv_is_read_by_name_and_strictly(spark, tmp_path):
    (tmp_path / "p.csv").write_text("sell_price,item_id,extra,wm_yr_wk,store_id\n1.5,i,x,3,s\n")
    row = readers.read_prices(spark, str(tmp_path / "p.csv")).first()
    assert (row.store_id, row.item_id, row.wm_yr_wk, row.sell_price) == ("s", "i", 3, 1.5)
    (tmp_path / "bad.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\ns,i,x,1.0\n")
    with pytest.raises(Exception):
        readers.read_prices(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "short.csv").write_text("store_id,item_id\ns,i\n")
    with pytest.raises(ValueError):
        readers.read_prices(spark, str(tmp_path / "short.csv"))
    (tmp_path / "board.csv").write_text("store_id,item_id,Popularity,Volatility,Sparsity\nA,x,1,2,3\n")
    assert readers.read_leaderboard(spark, str(tmp_path / "board.csv")).first().store_id == "A"
    (tmp_path / "scales.json").write_text('{"2": 0.5, "1": 1.5}')
    assert readers.read_band_scales(spark, str(tmp_path / "scales.json")) == [1.5, 0.5]


def test_histogram_holds_every_value(spark):
    df = spark.createDataFrame([(float(v),) for v in (-100, 0, 1, 2, 300)] + [(None,)], "e double")
    got = {r.bin: r.n for r in summaries.residual_histogram(df, "e", 50).collect()}
    assert sum(got.values()) == 5 and got[0] == 1 and got[49] == 1
    same = spark.createDataFrame([(1.0,), (1.0,)], "e double")
    assert [tuple(r) for r in summaries.residual_histogram(same, "e", 50).collect()] == [(0, 2)]


def test_weekday_has_period_seven(spark):
    df = spark.range(1, 8).select(F.col("id").cast("int").alias("w"))
    same = df.filter(scalars.target_weekday("w", 7) != F.col("w"))
    assert same.count() == 0
    assert [r[0] for r in df.orderBy("w").select(scalars.target_weekday("w", 1)).collect()] == [2, 3, 4, 5, 6, 7, 1]


def test_encoding_of_unseen_values(spark):
    seen = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    mapping = encode.build_mapping(seen, ["c"])
    def codes(mode):
        return {r["c"]: r["c_code"] for r in encode.encode(new, mapping, ["c"], mode).collect()}
    assert codes("zero") == {"a": 0, "b": 1, "z": 0, None: 0}
    assert codes("new") == {"a": 0, "b": 1, "z": 2, None: 2}
    assert codes("null") == {"a": 0, "b": 1, "z": None, None: None}


def test_mapping_codes_with_many_parts(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").cast("string").alias("x"), (F.col("id") % 9).cast("string").alias("y"))
    monkeypatch.setattr(ranking.numbered, "__defaults__", ("rn", 5, 10))
    got = {(r["column"], r["value"]): r["code"] for r in encode.build_mapping(df, ["y", "x"]).collect()}
    for c, n in (("x", 400), ("y", 9)):
        want = {v: i for i, v in enumerate(sorted(str(i) for i in range(n)))}
        assert {v: k for (cc, v), k in got.items() if cc == c} == want


def test_text_helpers(spark):
    row = spark.range(1).select(
        scalars.units(F.lit(1234.6)).alias("a"), scalars.units(F.lit(12.34)).alias("b"),
        scalars.units(F.lit(float("nan"))).alias("c"),
        scalars.pattern_caption(F.lit(1234.0), F.lit(None).cast("double"), F.lit(85.2)).alias("d"),
        scalars.finite_or_zero(F.lit(float("inf"))).alias("e"),
        scalars.pad_history(F.array(F.lit(1.0), F.lit(2.0)), 4).alias("f"),
    ).first()
    assert row["a"] == "1,235" and row["b"] == "12.3" and row["c"] == "—"
    assert row["d"] == "Volume 1,234 · 85% zero days" and row["e"] == 0.0
    assert row["f"] == [0.0, 0.0, 1.0, 2.0]


def test_product_name_rule(spark):
    df = spark.createDataFrame([("FOODS_1_017",), ("FOODS_3_002",), ("ODD",)], "item_id string")
    brands, names, default = ["B0", "B1", "B2"], {"FOODS_1": ["x0", "x1"]}, ["y0", "y1", "y2", "y3"]
    got = [r[0] for r in df.select(scalars.product_name("item_id", brands, names, default)).collect()]
    assert got[:2] == ["B2 x1", "B2 y2"] and got[2].split()[1].startswith("y")


def test_pinball_forms_agree(spark):
    df = spark.range(200).select((F.rand(1) * 10).alias("y"), (F.rand(2) * 10).alias("f"))
    for a in (0.05, 0.5, 0.95):
        gap = df.agg(F.max(F.abs(metrics.pinball("y", "f", a) - metrics.pinball_branches("y", "f", a)))).first()[0]
        assert gap < 1e-12


def packed_rows(spark, days=28, kind="forecast"):
    rows = [("S", "I", kind, h, (h % 7) + 1, [float(q * 10) for q in QUANTILES]) for h in range(1, days + 1)]
    return spark.createDataFrame(
        rows, "store_id string, item_id string, kind string, h int, target_wday int, yhat array<double>")


def test_widening_keeps_median_and_first_day(spark):
    packed = packed_rows(spark)
    wide = forecast.widen(packed)
    assert forecast.widen(packed, [1.0] * 28).exceptAll(packed).count() == 0
    for r in wide.collect():
        assert r["yhat"][forecast.MEDIAN] == 5.0
        if r["h"] == 28:
            assert abs(r["yhat"][8] - (5 + 4.95 * 1.84)) < 1e-9 and r["yhat"][0] == 0.0
    low = packed.withColumn("yhat", F.transform("yhat", lambda y: y - 8.0))
    assert min(min(r["yhat"]) for r in forecast.widen(low).filter("h > 1").collect()) == 0.0


def test_rescaling_by_weekday(spark):
    packed = packed_rows(spark)
    def with_profile(p):
        prof = spark.createDataFrame([("S", "I", p)], "store_id string, item_id string, profile array<double>")
        return forecast.weekday_rescale(packed, prof)
    assert with_profile([2.0] * 7).exceptAll(packed).count() == 0
    assert with_profile([0.0] * 7).exceptAll(packed).count() == 0
    got = {r["target_wday"]: r["yhat"][4] for r in with_profile([1.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0]).collect()}
    assert got[1] == 2.5 and got[2] == 7.5 and got[3] == 5.0


def test_submission_overwrites_only_predicted_cells(spark):
    pred = spark.createDataFrame([("S", "I", 10 + h, float(h)) for h in range(28)],
                                 "store_id string, item_id string, d int, yhat double")
    ids = ["I_S_validation", "I_S_evaluation"]
    template = spark.createDataFrame([(i, *[7] * 28) for i in ids], ["id"] + [f"F{i}" for i in range(1, 29)])
    out = {r["id"]: r for r in submission.submission(pred, template).collect()}
    assert out[ids[0]]["F1"] == 0.0 and out[ids[0]]["F28"] == 27.0 and out[ids[1]]["F5"] == 7.0


def test_availability_filter(spark):
    rows = spark.createDataFrame([("S", "I"), ("S", "J")], "store_id string, item_id string")
    have = rows.filter("item_id = 'I'")
    assert lookup.keep_available(rows, have).count() == 1
    assert lookup.keep_available(rows, have.filter("false")).count() == 2


def test_leaderboard_falls_back_to_all_stores(spark):
    items = spark.createDataFrame([("I", 5.0, 1.0, 0.0)], "item_id string, Popularity double, Volatility double, Sparsity double")
    names = spark.createDataFrame([("I", "Ice Cream")], "item_id string, product_name string")
    known = spark.createDataFrame([("K", "S", "D")], "item_id string, store_id string, dept_id string")
    assert leaderboard.leaderboard(items, None, names).count() == 10
    board = leaderboard.leaderboard(items, known, names)
    assert board.count() == 10 and board.first()["dept_id"] == "N/A"
    assert leaderboard.search(board, "CA_1", "ICE").count() == 1
    assert leaderboard.search(board, "CA_1", ".*").count() == 0


def test_weekday_profile_counts_padding_and_missing_days(spark):
    hist = spark.createDataFrame([("S", "I", 3, [0.0, 4.0, 6.0])], "store_id string, item_id string, last_d int, history array<double>")
    cal = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "d int, wday int")
    assert summaries.weekday_profile(hist, cal).first()["profile"] == [0.0, 5.0, 0, 0, 0, 0, 0]


def raw_files(spark, path):
    n, items = 80, [("FOODS_1_001", "CA_1"), ("FOODS_1_002", "CA_1"), ("FOODS_1_001", "WI_1")]
    wide = pd.DataFrame([{
        "id": f"{i}_{s}_evaluation", "item_id": i, "dept_id": i[:7], "cat_id": "FOODS", "store_id": s,
        "state_id": s[:2], **{f"d_{d}": (d * k) % 4 for d in range(1, n + 1)}}
        for k, (i, s) in enumerate(items, 1)])
    cal = pd.DataFrame([{
        "date": f"day{d}", "wm_yr_wk": 100 + (d - 1) // 7, "weekday": "x", "wday": (d - 1) % 7 + 1, "month": 1,
        "d": f"d_{d}", "event_name_1": "E" if d == 3 else "", "snap_CA": 1, "snap_TX": 0, "snap_WI": 0}
        for d in range(1, n + 29)])
    prices = pd.DataFrame([{"store_id": s, "item_id": i, "wm_yr_wk": 100 + w, "sell_price": 1.0 + w % 2}
                           for i, s in items for w in range(16)])
    wide.to_csv(path / "sales_train_evaluation.csv", index=False)
    cal.to_csv(path / "calendar.csv", index=False)
    prices.to_csv(path / "sell_prices.csv", index=False)


def test_csv_to_store(spark, tmp_path):
    raw_files(spark, tmp_path)
    out = str(tmp_path / "features")
    df = preprocess(spark, str(tmp_path), out)
    assert df.count() == 3 * (80 - 55)
    assert preprocess(spark, str(tmp_path), add_features=False).count() == 240
    pruned = readers.read_features(spark, out, ["item_id", "d", "lag_28"], ["CA_1"], 60, 70)
    assert pruned.count() == 2 * 11 and pruned.columns == ["item_id", "d", "lag_28"]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "GreaterThanOrEqual(d,60)" in plan

    version = store.fingerprint(spark, out)
    assert len(version) == 16 and version == store.fingerprint(spark, out)
    path = str(tmp_path / "store")
    assert store.refresh(df, path, version) and not store.refresh(df, path, version)
    assert store.refresh(df, path, version, force=True)
    assert spark.read.parquet(f"{path}/ctx").count() == 3
    with pytest.raises(ValueError):
        require_columns(df, ["nope"])

    calls = []
    def build():
        calls.append(1)
        return df
    cached = str(tmp_path / "cached")
    for _ in range(2):
        assert writers.build_if_missing(spark, cached, build).count() == df.count()
    assert len(calls) == 1


def test_text_sinks_round_trip(spark, tmp_path):
    mapping = encode.build_mapping(long_table(spark), ["item_id"])
    writers.write_mapping(mapping, str(tmp_path / "map"))
    assert readers.read_mapping(spark, str(tmp_path / "map")).exceptAll(mapping).count() == 0
    rows = horizon.expand_horizons(long_table(spark, 40))
    writers.write_training_csv(rows, str(tmp_path / "train"), ["sales", "horizon_day"])
    back = spark.read.csv(str(tmp_path / "train"), header=True)
    assert back.columns == ["target", "sales", "horizon_day"] and back.count() == rows.count()
    board = spark.createDataFrame([("I", 1.0, 2.0, 3.0)], "item_id string, Popularity double, Volatility double, Sparsity double")
    writers.write_csv(board, str(tmp_path / "board"))
    assert readers.read_leaderboard(spark, str(tmp_path / "board")).first()["Sparsity"] == 3.0


def test_checkpoints_go_to_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    assert cut_lineage(spark.range(10)).count() == 10 and folder


def test_sources_hold_no_local_checkpoint():
    import pathlib
    root = pathlib.Path(__file__).resolve().parent.parent / "shelfcast"
    text = "".join(p.read_text() for p in root.rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text
