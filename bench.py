"""Times the headline plans and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from shelfcast.models import bins, leafwise, recursive, scoring
from shelfcast.models.leafwise import Params
from shelfcast.models.trees import TreeModel
from shelfcast.operators import encode, horizon, reshape
from shelfcast.plans import features as plans, forecast
from shelfcast.registry import given, tables
from shelfcast.registry.queries import QUERIES
from shelfcast.session import local_session
from shelfcast.sources.schemas import CATEGORY_COLUMNS, HORIZON_TRAIN_COLUMNS, QUANTILES

HEADLINES = [
    "prepared_sales", "horizon_feature_table", "legacy_feature_table", "extended_feature_table",
    "department_day_totals", "item_profiles", "horizon_expansion", "adjusted_forecast",
    "backtest_indicators", "store_context", "leaderboard", "event_series_lags",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    run(tables.sales(spark, folder))            # start the JVM's code paths once
    times: dict[str, float] = {}
    for name in HEADLINES:
        begin = time.perf_counter()
        run(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - begin, 3)

    # the binned horizon-stacked training window, and one round of all nine quantiles with 128 leaves
    begin = time.perf_counter()
    df = tables.features(spark, folder)
    window = horizon.training_window(df)
    mapping = encode.build_mapping(window, CATEGORY_COLUMNS).cache()
    sizes = {**encode.category_sizes(mapping), "target_wday": 7}
    model = scoring.ForecastModel(TreeModel(HORIZON_TRAIN_COLUMNS, sizes, {}), mapping)
    coded = model.encoded(horizon.expand_horizons(window))
    members = scoring.quantile_members(QUANTILES, False)
    binning = bins.fit(coded, HORIZON_TRAIN_COLUMNS, sizes, 64)
    blocks = bins.blocks(coded, binning, sizes, "target", F.lit(1), ["store_id", "item_id", "d", "horizon_day"],
                         len(members)).persist()
    n = blocks.agg(F.sum("n")).first()[0]
    times["training_table"] = round(time.perf_counter() - begin, 3)
    begin = time.perf_counter()
    model.trees = leafwise.train(blocks, binning, sizes, members, Params(rounds=1))
    times["boosting_round_9_quantiles"] = round(time.perf_counter() - begin, 3)
    begin = time.perf_counter()
    run(model.score(reshape.repeat_horizons(forecast.anchors(df))))
    times["scoring"] = round(time.perf_counter() - begin, 3)
    begin = time.perf_counter()
    run(recursive.recursive_forecast(
        given.model(given.STEPS, given.STEP_FEATURES, spark),
        recursive.seeds(plans.legacy_features(tables.prepared(spark, folder))), tables.calendar(spark, folder)))
    times["recursion"] = round(time.perf_counter() - begin, 3)

    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
        "long_rows": tables.sales(spark, folder).count(), "training_rows": n,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
