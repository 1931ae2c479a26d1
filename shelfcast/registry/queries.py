"""The registered queries: one or more per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfcast.functions import metrics, scalars, series
from shelfcast.models import explain, losses, recursive, scoring, trainers, trees
from shelfcast.models.leafwise import Params
from shelfcast.operators import encode, horizon, lookup, ranking, reshape, summaries
from shelfcast.plans import (
    evaluation, features as plans, forecast, increments, leaderboard as boards)
from shelfcast.plans import store as stores, submission as submissions
from shelfcast.plans.preprocess import preprocess
from shelfcast.registry import given, tables as t
from shelfcast.session import cut_lineage, scratch_path, tune
from shelfcast.sources import readers, starschema, writers
from shelfcast.sources.schemas import CATEGORY_COLUMNS, LEGACY_HORIZON_COLUMNS, QUANTILES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = ["store_id", "item_id", "d"]
PAIR = ["store_id", "item_id"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources, reshaping, joins -------------------------------------------------------------

@query
def horizon_feature_table(spark, sf):
    df = t.feature_plan(spark, sf)
    return t.rounded(df.select(
        *KEY, "sales", "wday", "month", "sell_price", "price_norm", "price_momentum_7d",
        "price_momentum_28d", "lag_28", "roll_mean_7_lag_28", "roll_mean_28_lag_28",
        "masked_roll_mean_28_lag_28", "ema_lag_28", "days_since_last_sale_lag_28"))


@query
def appended_feature_table(spark, sf):
    """The feature table up to 30 days before the end, continued by 9 days and then by 21."""
    df = t.prepared(spark, sf)
    last = starschema.last_day(spark, sf).first()[0]
    path = scratch_path(spark, "increments")
    increments.start(df.filter(F.col("d") <= last - 30), path)
    increments.append(df.filter(F.col("d").between(last - 29, last - 21)), path)
    increments.append(df.filter(F.col("d") > last - 21), path)
    return t.rounded(increments.read(spark, path).select(
        *KEY, "sales", "wday", "month", "sell_price", "price_norm", "price_momentum_7d",
        "price_momentum_28d", "lag_28", "roll_mean_7_lag_28", "roll_mean_28_lag_28",
        "masked_roll_mean_28_lag_28", "ema_lag_28", "days_since_last_sale_lag_28"))


@query
def preprocess_from_csv(spark, sf):
    """Raw CSV files (wide sales, calendar, prices) to a partitioned feature table and back."""
    tune(spark)
    raw = scratch_path(spark, "raw")
    last = starschema.last_day(spark, sf).first()[0]
    wide = reshape.pivot_days(
        t.sales(spark, sf).withColumn("id", scalars.series_key("item_id", "store_id")), 1, last)
    writers.write_csv(wide, f"{raw}/sales_train_evaluation.csv")
    writers.write_csv(
        t.calendar(spark, sf).withColumn("d", F.concat(F.lit("d_"), "d")), f"{raw}/calendar.csv")
    writers.write_csv(starschema.prices(spark, sf), f"{raw}/sell_prices.csv")
    df = preprocess(spark, raw, f"{raw}/features")
    return t.rounded(df.select(*KEY, "sales", "sell_price", "lag_28", "roll_mean_28_lag_28",
                               "ema_lag_28"))


@query
def unpivot_wide_sales(spark, sf):
    tune(spark)
    last = starschema.last_day(spark, sf).first()[0]
    wide = reshape.pivot_days(t.sales(spark, sf), 1, last)
    return reshape.unpivot_days(wide, cluster=False).select(*KEY, "dept_id", "cat_id", "sales")


@query
def prepared_sales(spark, sf):
    """Sales with calendar and price columns."""
    return t.rounded(t.prepared(spark, sf).select(
        *KEY, "sales", "wday", "month", "event_name_1", "snap_CA", "snap_TX", "snap_WI",
        "wm_yr_wk", "sell_price"))


@query
def calendar_table(spark, sf):
    return t.calendar(spark, sf)


@query
def filtered_store_days(spark, sf):
    """One store, a day range, days with sales and a known price, chosen columns."""
    df = t.prepared(spark, sf).filter(
        (F.col("store_id") == "ASIA") & F.col("d").between(500, 2000) & (F.col("sales") > 0))
    df = df.dropna(subset=["sell_price"]).withColumnRenamed("sell_price", "price")
    return t.rounded(df.select(
        "item_id", "d", F.col("sales").cast("double").alias("units"), "price",
        F.lit("ASIA").alias("store")))


@query
def rows_without_nulls(spark, sf):
    """Rows complete in every column, counted per series."""
    return t.prepared(spark, sf).dropna().groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales").alias("units"))


@query
def selected_features(spark, sf):
    """Feature columns chosen by exclusion, marked categorical or numeric, with their fill."""
    df = t.prepared(spark, sf)
    names = reshape.feature_columns(df)
    text = set(reshape.categorical_columns(df, names))
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "feature", "n_known").withColumn(
        "categorical", F.col("feature").isin(*text).cast("int"))


@query
def filled_prices(spark, sf):
    """Missing prices and events replaced by constants, counters by 0."""
    df = t.prepared(spark, sf).withColumn("label", F.col("event_name_1"))
    df = reshape.fill_missing(df, {
        "sell_price": 0.0, "event_name_1": "N/A", "label": F.col("item_id")})
    return t.rounded(df.select(*KEY, "sell_price", "event_name_1", "label"))


@query
def sampled_users(spark, sf):
    """5% of the users without replacement, by seeded hash order, with their event counts."""
    tune(spark)
    events = starschema.table(spark, sf, "events").select("user_id", "value")
    chosen = ranking.sample_ids(events, "user_id", 0.05)
    return t.rounded(lookup.keep_ids(events, chosen, "user_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query
def sampled_item_rows(spark, sf):
    """Sales rows of a 5% item sample."""
    df = t.sales(spark, sf)
    chosen = ranking.sample_ids(starschema.daily_sales(spark, sf), "item_id", 0.05)
    return lookup.keep_ids(df, chosen).select(*KEY, "sales")


@query
def pivoted_last_days(spark, sf):
    """Last 28 days of every series as F1..F28."""
    df = t.sales(spark, sf)
    df = df.filter(F.col("d") > starschema.last_day(spark, sf).scalar() - 28).withColumn(
        "id", scalars.series_key("item_id", "store_id", "validation"))
    return reshape.pivot_ranked_days(df.select("id", "d", "sales"), ranking.day_ranks(df),
                                     "id", "sales")


@query
def repeated_horizons(spark, sf):
    """Anchor rows once per horizon day with the weekday the day falls on."""
    return reshape.repeat_horizons(forecast.anchors(t.features(spark, sf))).select(
        *PAIR, "kind", "d", "wday", "horizon_day", "target_wday")


@query
def items_at_every_store(spark, sf):
    profiles = summaries.item_profile(t.sales(spark, sf))
    return t.rounded(reshape.repeat_stores(
        profiles.select("item_id", "Popularity"), t.REGIONS))


@query
def leaderboard_store_fanout(spark, sf):
    sales = t.sales(spark, sf)
    return t.rounded(boards.attach_stores(
        summaries.item_profile(sales).select("item_id", "Popularity"),
        starschema.daily_sales(spark, sf)))


@query
def servable_pairs(spark, sf):
    """Item-store pairs with a context row in the store."""
    ctx = t.store(spark, sf)["ctx"]
    everywhere = reshape.repeat_stores(
        t.sales(spark, sf).select("item_id").distinct(), t.REGIONS)
    return lookup.keep_available(everywhere, ctx).select("store_id", "item_id")


@query
def unfiltered_when_pairs_unknown(spark, sf):
    """A store that holds none of the asked pairs filters nothing."""
    ctx = t.store(spark, sf)["ctx"]
    elsewhere = reshape.repeat_stores(
        t.sales(spark, sf).select("item_id").distinct(), ["NOWHERE"])
    return lookup.keep_available(elsewhere, ctx).select("store_id", "item_id")


@query
def unfiltered_when_store_empty(spark, sf):
    """An empty store filters nothing."""
    empty = t.features(spark, sf).filter(F.col("sales") < 0)
    everywhere = reshape.repeat_stores(
        t.sales(spark, sf).select("item_id").distinct(), t.REGIONS)
    return lookup.keep_available(everywhere, empty).select("store_id", "item_id")


def product_lists() -> tuple[list[str], dict[str, list[str]], list[str]]:
    """Caller-supplied name lists: brands as in the part table, nouns by rule."""
    brands = [f"Brand#{i}" for i in range(1, 26)]
    nouns = {"ECONOMY": [f"Saver {i}" for i in range(1, 31)],
             "PROMO": [f"Deal {i}" for i in range(1, 31)]}
    return brands, nouns, [f"Classic {i}" for i in range(1, 32)]


def named_items(spark, sf):
    items = starschema.daily_sales(spark, sf).select("item_id", "dept_id").distinct()
    return items.withColumn("product_name", scalars.product_name("item_id", *product_lists()))


@query
def product_names(spark, sf):
    tune(spark)
    return named_items(spark, sf)


@query
def named_sales(spark, sf):
    """Product names looked up from a table that lacks one department; ids stand in."""
    known = named_items(spark, sf).filter(F.col("dept_id") != "LARGE")
    df = starschema.daily_sales(tune(spark), sf)
    return lookup.attach_product_names(df, known).groupBy("product_name").agg(
        F.sum("sales").alias("units"))


@query
def anchor_rows(spark, sf):
    """The feature row exactly 28 days before each series' last one."""
    df = t.features(spark, sf)
    wanted = df.groupBy(*PAIR).agg((F.max("d") - 28).alias("d"))
    return t.rounded(lookup.rows_at_day(df, wanted).select(
        *KEY, "sales", "lag_28", "ema_lag_28"))


# ---- aggregates ----------------------------------------------------------------------------

@query
def department_day_totals(spark, sf):
    return t.sales(spark, sf).groupBy("store_id", "dept_id", "d").agg(
        F.sum("sales").alias("dept_daily_sales"))


@query
def store_day_quantile_totals(spark, sf):
    return t.rounded(summaries.totals(
        t.naive_quantiles(spark, sf), ["store_id", "d"], ["sales"] + [f"q{i}" for i in range(9)]))


@query
def daily_forecast_errors(spark, sf):
    return t.rounded(evaluation.daily_errors(t.naive_quantiles(spark, sf), "sales", "q4"))


def horizon_targets(spark, sf):
    """Feature rows expanded to horizons, with model-free predictions of the target."""
    df = horizon.expand_horizons(t.features(spark, sf).select(*KEY, "wday", "sales", "lag_28"))
    return df.withColumns({
        "direct": F.col("lag_28") * F.lit(1.0), "recursive": F.col("lag_28") * F.lit(1.3)})


@query
def horizon_step_errors(spark, sf):
    df = horizon_targets(spark, sf).withColumnRenamed("horizon_day", "horizon_step")
    return t.rounded(evaluation.horizon_errors(df, "target", ["recursive", "direct"]))


@query
def architecture_improvement(spark, sf):
    """Overall error of two forecasts and the reduction in per cent."""
    df = horizon_targets(spark, sf).agg(
        metrics.rmse("target", "recursive").alias("rmse_recursive"),
        metrics.rmse("target", "direct").alias("rmse_direct"))
    return t.rounded(df.withColumn(
        "improvement", metrics.improvement("rmse_recursive", "rmse_direct")))


@query
def distinct_counts(spark, sf):
    return t.sales(spark, sf).agg(
        F.count_distinct("item_id").alias("items"), F.count_distinct("store_id").alias("stores"),
        F.count_distinct("dept_id").alias("depts"), F.count_distinct(*PAIR).alias("pairs"))


@query
def distinct_series(spark, sf):
    return starschema.daily_sales(tune(spark), sf).select(
        "item_id", "store_id", "dept_id").distinct()


@query
def day_range(spark, sf):
    return t.rounded(summaries.value_range(t.features(spark, sf), "d"))


@query
def item_profiles(spark, sf):
    return t.rounded(summaries.item_profile(t.sales(spark, sf)))


@query
def weekday_profiles(spark, sf):
    profiles = summaries.weekday_profile(
        summaries.padded_history(t.features(spark, sf)), t.calendar(spark, sf))
    return t.rounded(profiles.select(
        *PAIR, F.posexplode("profile").alias("pos", "level")).select(
        *PAIR, (F.col("pos") + 1).alias("wday"), "level"))


@query
def history_lists(spark, sf):
    """The newest 84 sales per series, one row per position."""
    df = summaries.history(t.features(spark, sf))
    return df.select(*PAIR, "last_d", F.posexplode("history").alias("pos", "sales"))


@query
def padded_history_means(spark, sf):
    """Fixed-length histories and the two lagged means read from them."""
    df = summaries.padded_history(t.features(spark, sf))
    return t.rounded(df.select(
        *PAIR, F.size("history").alias("n"),
        scalars.tail_mean("history", 35, 28).alias("mean_7"),
        scalars.tail_mean("history", 56, 28).alias("mean_28"),
        scalars.tail_mean("history", 28, 28).alias("mean_empty")))


@query
def residual_bins_15(spark, sf):
    """Residuals of the model-free median over the whole feature table in 15 bins."""
    df = t.naive_quantiles(spark, sf).withColumn("residual", F.col("sales") - F.col("q4"))
    return summaries.residual_histogram(df, "residual", 15)


@query
def residual_bins_50(spark, sf):
    """The same with the sign turned, in 50 bins over the whole range."""
    df = t.naive_quantiles(spark, sf).withColumn("residual", F.col("q4") - F.col("sales"))
    return summaries.residual_histogram(df, "residual", 50)


# ---- series operators ----------------------------------------------------------------------

@query
def lagged_values(spark, sf):
    w = series.by_day()
    return t.rounded(t.prepared(spark, sf).select(
        *KEY, F.lag("sales", 7).over(w).alias("lag_7"), F.lag("sales", 28).over(w).alias("lag_28"),
        F.lag("sell_price", 28).over(w).alias("price_lag_28")))


@query
def lead_values(spark, sf):
    w = series.by_day()
    return t.sales(spark, sf).select(
        *KEY, F.lead("sales", 1).over(w).alias("target_1"),
        F.lead("sales", 28).over(w).alias("target_28"))


@query
def rolling_means(spark, sf):
    return t.rounded(plans.legacy_features(t.prepared(spark, sf), drop_incomplete=False).select(
        *KEY, "roll_mean_7", "roll_mean_28"))


@query
def legacy_feature_table(spark, sf):
    return t.rounded(plans.legacy_features(t.prepared(spark, sf)).select(
        *KEY, "sales", "sell_price", "price_norm", "roll_mean_7", "roll_mean_28"))


@query
def demand_recency(spark, sf):
    """Zero-masked rolling mean, weighted mean and days since the last sale, all rows."""
    df = plans.horizon_features(t.prepared(spark, sf), drop_incomplete=False)
    return t.rounded(df.select(*KEY, "masked_roll_mean_28_lag_28", "ema_lag_28",
                               "days_since_last_sale_lag_28"))


@query
def forward_filled_prices(spark, sf):
    w = series.by_day()
    return t.rounded(t.prepared(spark, sf).select(
        *KEY, F.row_number().over(w).alias("row_nr"),
        series.forward_fill("sell_price", w).alias("price_filled")))


@query
def price_features(spark, sf):
    w = series.by_day()
    df = t.prepared(spark, sf).select(
        *KEY, "sell_price", F.lag("sell_price", 28).over(w).alias("price_lag_28"),
        series.momentum("sell_price", 7, w).alias("price_momentum_7d"),
        series.momentum("sell_price", 28, w).alias("price_momentum_28d"))
    return t.rounded(df.select(
        *KEY, "price_momentum_7d", "price_momentum_28d",
        series.max_normalised("sell_price").alias("price_norm"),
        series.zscore("sell_price").alias("price_zscore"),
        series.change_ratio("sell_price", "price_lag_28").alias("price_change_ratio")))


def _extended(spark, sf):
    return plans.extended_features(t.prepared(spark, sf), t.SNAP_REGIONS)


@query
def weighted_moments(spark, sf):
    return t.rounded(_extended(spark, sf).select(
        *KEY, "ema_7", "ema_28", "ewm_std_7", "ewm_std_28"), 5)


@query
def extended_feature_table(spark, sf):
    return t.rounded(_extended(spark, sf).select(
        *KEY, "dept_roll_mean_28", "dept_roll_mean_7", "roll_mean_7", "roll_mean_28", "lag_7",
        "sparsity_ratio_28", "is_weekend", "snap_active", "has_event", "price_zscore",
        "price_change_ratio"))


@query
def department_rolling_means(spark, sf):
    return t.rounded(plans.department_features(t.sales(spark, sf)))


@query
def cumulative_sales(spark, sf):
    run = series.running(series.by_day())
    return t.rounded(t.naive_quantiles(spark, sf).select(
        *KEY, F.sum("sales").over(run).alias("cum_sales"),
        *[F.sum(f"q{i}").over(run).alias(f"cum_q{i}") for i in range(len(QUANTILES))]))


@query
def store_cumulative_fan(spark, sf):
    """Running store totals of actuals and quantiles."""
    columns = ["sales", *[f"q{i}" for i in range(len(QUANTILES))]]
    daily = summaries.totals(t.naive_quantiles(spark, sf), ["store_id", "d"], columns)
    run = series.running(series.by_day("store_id"))
    return t.rounded(daily.select("store_id", "d", *[F.sum(c).over(run).alias(f"cum_{c}") for c in columns]))


@query
def anchored_fan(spark, sf):
    fan = forecast.cumulative_fan(
        t.raw_predictions(spark, sf), summaries.padded_history(t.features(spark, sf)))
    return t.rounded(forecast.unpack(fan))


@query
def last_rows(spark, sf):
    return ranking.last_rows(t.sales(spark, sf), 28).select(*KEY, "sales")


@query
def peak_uncertainty(spark, sf):
    packed = forecast.widen(t.raw_predictions(spark, sf))
    return t.rounded(forecast.peak_spread(packed, 1, 7))


@query
def ranked_days(spark, sf):
    df = t.sales(spark, sf)
    return ranking.day_ranks(df.filter(
        F.col("d") > starschema.last_day(spark, sf).scalar() - 28))


@query
def event_series_lags(spark, sf):
    """Lags, trailing means and row numbers of daily event counts per user and event type."""
    df = starschema.event_series(tune(spark), sf)
    w = series.by_day()
    return t.rounded(df.select(
        *KEY, "sales", F.lag("sales", 1).over(w).alias("lag_1"),
        series.rolling_mean("sales", 3, w).alias("roll_mean_3"),
        F.row_number().over(w).alias("row_nr")))


# ---- sorts, top-k, set operations ----------------------------------------------------------

@query
def top_items(spark, sf):
    return t.rounded(boards.head_items(summaries.item_profile(t.sales(spark, sf))))


@query
def top_days_per_series(spark, sf):
    """The three best sales days of each series."""
    return ranking.top_per_group(
        t.sales(spark, sf).select(*KEY, "sales"), PAIR,
        [F.col("sales").desc(), F.col("d").asc()], 3)


@query
def united_stores(spark, sf):
    """Store slices put back together give the whole table."""
    df = t.sales(spark, sf).select(*KEY, "sales")
    parts = [df.filter(F.col("store_id") == r) for r in t.REGIONS]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sales").alias("units"))


# ---- scalar functions ----------------------------------------------------------------------

@query
def calendar_flags(spark, sf):
    df = t.prepared(spark, sf)
    return df.select(
        *KEY, scalars.target_weekday("wday", 28).alias("target_wday"),
        scalars.cyclic_step("d").alias("horizon_step"),
        scalars.is_weekend("wday").alias("is_weekend"),
        scalars.has_event("event_name_1").alias("has_event"),
        scalars.snap_active("state_id", t.SNAP_REGIONS).alias("snap_active"))


@query
def series_ids(spark, sf):
    return starschema.daily_sales(tune(spark), sf).select(
        scalars.series_key("item_id", "store_id", "evaluation").alias("id")).distinct()


@query
def item_captions(spark, sf):
    df = summaries.item_profile(t.sales(spark, sf))
    return df.select("item_id", scalars.pattern_caption(
        F.col("Popularity"), F.when(F.col("Volatility") < 2.5, F.col("Volatility")),
        F.col("Sparsity")).alias("caption"))


@query
def formatted_units(spark, sf):
    df = t.sales(spark, sf).groupBy("store_id", "d").agg(
        F.sum("sales").cast("double").alias("units"))
    return df.select("store_id", "d", scalars.units(F.when(
        F.col("units") > 0, F.col("units"))).alias("label"))


@query
def clamped_errors(spark, sf):
    e = F.col("q4") - F.col("sales")
    return t.rounded(t.naive_quantiles(spark, sf).select(
        *KEY, scalars.clamp_zero(e).alias("clamped"), F.abs(e).alias("absolute"),
        F.pow(e, F.lit(2.0)).alias("squared"), F.sqrt(F.abs(e)).alias("root")))


@query
def sanitised_store_rows(spark, sf):
    """Prepared rows as the store serves them: missing numbers as 0, flags as int."""
    df = plans.horizon_features(t.prepared(spark, sf), drop_incomplete=False)
    clean = stores.sanitised(df.select(*KEY, "sales", "sell_price", "price_norm", "snap_CA",
                                       "lag_28", "days_since_last_sale_lag_28"))
    return t.rounded(clean)


# ---- training rows, encoding ---------------------------------------------------------------

@query
def horizon_expansion(spark, sf):
    """The 28-fold training expansion, folded to one checksum row per anchor."""
    df = horizon.expand_horizons(t.features(spark, sf).select(*KEY, "wday", "sales"))
    return df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("target_sum"),
        F.sum(F.col("target") * F.col("horizon_day")).alias("by_horizon"),
        F.sum(F.col("target") * F.col("target_wday")).alias("by_wday"))


@query
def strict_horizon_expansion(spark, sf):
    """The same with targets found by day: gaps in a series give no target."""
    df = horizon.expand_horizons(
        t.features(spark, sf).select(*KEY, "wday", "sales"), strict_days=True)
    return df.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("target_sum"),
        F.sum(F.col("target") * F.col("horizon_day")).alias("by_horizon"))


@query
def training_window(spark, sf):
    return horizon.training_window(t.features(spark, sf)).select(*KEY, "sales")


@query
def hold_out_rows(spark, sf):
    """Rows and target totals on both sides of the split, per horizon, by anchor and target."""
    df = horizon.expand_horizons(horizon.training_window(
        t.features(spark, sf).select(*KEY, "wday", "sales")))
    split = horizon.last_day_of(t.features(spark, sf)) - 28
    parts = []
    for on in ("anchor", "target"):
        for side, rows in zip(("train", "valid"), horizon.hold_out(df, split, on)):
            parts.append(rows.groupBy("horizon_day").agg(
                F.count(F.lit(1)).alias("n"), F.sum("target").alias("target_sum")
            ).withColumns({"split_on": F.lit(on), "side": F.lit(side)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def cv_folds(spark, sf):
    """Rows per fold of three expanding-window validation folds, with their training rows."""
    df = t.features(spark, sf)
    end = horizon.last_day_of(df)
    tagged = df.withColumn("fold", horizon.fold_column(end, 3))
    valid = tagged.filter(F.col("fold").isNotNull()).groupBy("fold").agg(
        F.min("d").alias("first_d"), F.max("d").alias("last_d"),
        F.count(F.lit(1)).alias("n_valid"))
    train = df.select(F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("fold"), "d") \
        .filter(F.col("d") <= end - F.col("fold") * 28).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_train"))
    return valid.join(train, "fold")


@query
def category_codes(spark, sf):
    return encode.build_mapping(starschema.daily_sales(tune(spark), sf)).unionByName(
        encode.weekday_mapping(spark))


@query
def encoded_categories(spark, sf):
    """Codes on every row; the mapping knows only rows before day 300 and is written once."""
    df = starschema.daily_sales(tune(spark), sf)
    path = scratch_path(spark, "mapping")
    writers.write_mapping(encode.build_mapping(df.filter(F.col("d") < 300)), path)
    mapping = readers.read_mapping(spark, path)
    sizes = encode.category_sizes(mapping)
    zero = encode.encode(df, mapping, sizes=sizes)
    both = encode.encode(zero, mapping, ["item_id"], unseen="null", suffix="_or_null", sizes=sizes)
    return both.select(*KEY, "item_id_code", "dept_id_code", "cat_id_code", "store_id_code",
                       "state_id_code", "item_id_or_null")


@query
def sample_weights(spark, sf):
    df = encode.with_default_weights(t.prepared(spark, sf).select(*KEY, "sales", "sell_price"))
    df = df.withColumn("weight", F.coalesce(F.col("sales") * F.col("sell_price"), F.lit(0.0)))
    return t.rounded(df.select(*KEY, encode.sample_weight().alias("w"), "scale_factor"))


# ---- forecast adjustment -------------------------------------------------------------------

@query
def rescaled_forecast(spark, sf):
    profiles = summaries.weekday_profile(
        summaries.padded_history(t.features(spark, sf)), t.calendar(spark, sf))
    packed = forecast.weekday_rescale(t.raw_predictions(spark, sf), profiles)
    return t.rounded(forecast.unpack(packed).drop("last_d", "target_wday"))


@query
def widened_forecast(spark, sf):
    packed = forecast.widen(t.raw_predictions(spark, sf))
    return t.rounded(forecast.unpack(packed).drop("last_d", "target_wday"))


def _adjusted(spark, sf):
    return forecast.direct_forecast(
        t.features(spark, sf), t.naive_scores, t.calendar(spark, sf))


@query
def adjusted_forecast(spark, sf):
    """Backtest and forecast of every series, rescaled by weekday and then widened."""
    return t.rounded(forecast.unpack(_adjusted(spark, sf)).drop("target_wday"))


@query
def forecast_records(spark, sf):
    products = named_items(spark, sf)
    records = forecast.forecast_records(
        _adjusted(spark, sf), t.features(spark, sf), products)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return t.rounded(records.select(
        *PAIR, "product_name", F.size("history").alias("n_history"), "avg_sales_28",
        F.size("forecast").alias("n_quantiles"),
        total(F.col("forecast")["0.5"]).alias("median_total"),
        F.col("forecast")["0.975"][27].alias("upper_last"),
        total(F.col("backtest")["0.25"]).alias("backtest_low_total")))


@query
def series_states(spark, sf):
    """Whether each item-store pair can be forecast, and if not why."""
    wanted = reshape.repeat_stores(
        starschema.daily_sales(tune(spark), sf).select("item_id").distinct(),
        t.REGIONS + ["NOWHERE"])
    return forecast.series_status(t.features(spark, sf), wanted)


# ---- store, evaluation, reports ------------------------------------------------------------

@query
def store_rows(spark, sf):
    rows = t.store(spark, sf)["rows"]
    return t.rounded(rows.select(*KEY, "sales", "wday", "lag_28", "ema_lag_28"))


@query
def store_context(spark, sf):
    """Context rows written to Parquet by version and read back."""
    path = scratch_path(tune(spark), "store")
    stores.refresh(t.features(spark, sf), path, "v1")
    ctx = spark.read.parquet(f"{path}/ctx")
    meta = spark.read.parquet(f"{path}/meta").select("max_d").scalar()
    return t.rounded(ctx.select(*KEY, "sales", "price_norm", "lag_28",
                                meta.alias("max_d")))


@query
def store_lookup(spark, sf):
    """Requested pairs found in the store, in the table, or nowhere."""
    df = t.features(spark, sf)
    kept = {k: v.filter(F.col("store_id") != "ASIA")
            for k, v in t.store(spark, sf).items() if k in ("ctx", "sales")}
    wanted = reshape.repeat_stores(
        starschema.daily_sales(spark, sf).select("item_id").distinct(), t.REGIONS + ["NOWHERE"])
    found = stores.lookup(wanted, kept, df)
    return t.rounded(found.select(
        *PAIR, "d", "lag_28", "source",
        F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("history_total")))


@query
def required_columns(spark, sf):
    """The feature table passes the column check; its known values per required column."""
    from shelfcast.sources.schemas import STORE_ROW_COLUMNS, require_columns
    df = t.features(spark, sf)
    require_columns(df, STORE_ROW_COLUMNS)
    return df.agg(*[F.count(c).alias(c) for c in STORE_ROW_COLUMNS])


@query
def pinball_losses(spark, sf):
    """Mean quantile loss of each quantile in both of its forms."""
    from shelfcast.sources.schemas import QUANTILES
    df = t.naive_quantiles(spark, sf)
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("yhat"))
                      for i, q in enumerate(QUANTILES)])
    long = df.select("sales", F.inline(pairs))
    return t.rounded(long.groupBy("q").agg(
        F.avg(metrics.pinball("sales", "yhat", F.col("q"))).alias("loss"),
        F.avg(metrics.pinball_branches("sales", "yhat", F.col("q"))).alias("loss_branches")))


def _fold_rows(spark, sf):
    df = t.naive_quantiles(spark, sf)
    end = horizon.last_day_of(t.features(spark, sf))
    return df.withColumns({
        "fold": horizon.fold_column(end, 3), "weight": F.col("lag_28") + F.lit(1.0),
        "scale_factor": F.lit(2.0)}).filter(F.col("fold").isNotNull())


@query
def fold_scores(spark, sf):
    return t.rounded(evaluation.fold_metrics(_fold_rows(spark, sf), "sales", "q4"))


@query
def average_scores(spark, sf):
    return t.rounded(evaluation.fold_average(
        evaluation.fold_metrics(_fold_rows(spark, sf), "sales", "q4")))


@query
def horizon_quantile_losses(spark, sf):
    """Loss of the 95% quantile per fold from anchors at each fold's split day."""
    df = horizon_targets(spark, sf)
    end = horizon.last_day_of(t.features(spark, sf))
    behind = end - F.col("d")
    rows = df.filter((behind % 28 == 0) & behind.between(28, 84)).withColumns({
        "fold": F.floor(behind / 28).cast("int"), "upper": F.col("lag_28") * F.lit(2.2)})
    return t.rounded(evaluation.horizon_quantile_loss(rows, "target", "upper", 0.95))


@query
def backtest_indicators(spark, sf):
    past = summaries.padded_history(t.features(spark, sf))
    rows = forecast.attach_actuals(_adjusted(spark, sf), past)
    return t.rounded(evaluation.backtest_kpis(rows, past))


@query
def percentile_panel(spark, sf):
    return t.rounded(evaluation.percentile_panel(_adjusted(spark, sf)))


@query
def interval_bounds(spark, sf):
    past = summaries.padded_history(t.features(spark, sf))
    return t.rounded(evaluation.interval_table(
        forecast.attach_actuals(_adjusted(spark, sf), past)))


def _board(spark, sf):
    return boards.leaderboard(
        summaries.item_profile(t.sales(spark, sf)), starschema.daily_sales(spark, sf), named_items(spark, sf),
        available=t.store(spark, sf)["ctx"])


@query
def leaderboard(spark, sf):
    return t.rounded(_board(spark, sf))


@query
def leaderboard_search(spark, sf):
    return t.rounded(boards.search(_board(spark, sf), "EUROPE", "saVer"))


def _template(spark, sf):
    ids = starschema.daily_sales(spark, sf).select("item_id", "store_id").distinct()
    suffix = F.explode(F.array(F.lit("validation"), F.lit("evaluation"))).alias("suffix")
    return ids.select("item_id", "store_id", suffix).select(
        F.concat_ws("_", "item_id", "store_id", "suffix").alias("id"),
        *[F.lit(0.0).alias(f"F{i}") for i in range(1, 29)])


@query
def submission_table(spark, sf):
    """Forecast medians of three regions laid over the full template."""
    packed = t.raw_predictions(spark, sf).filter(
        (F.col("kind") == "forecast") & F.col("store_id").isin("AFRICA", "ASIA", "EUROPE"))
    predicted = packed.select(
        *PAIR, F.col("h").alias("d"), F.col("yhat")[forecast.MEDIAN].alias("yhat"))
    return t.rounded(submissions.submission(predicted, _template(spark, sf)))


# ---- models (no SQL counterpart) -----------------------------------------------------------
# The trained models are kept per session and folder, so that the queries below share them.

_MODELS: dict[tuple, object] = {}
MODEL_QUANTILES = QUANTILES
# Far below the defaults (50 rounds, 128 leaves): README.md gives the time that those take.
SHORT = dict(rounds=6, leaves=32, learning_rate=0.3)


def _once(spark, name, sf, build):
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def _horizon_model(spark, sf):
    return _once(spark, "horizon", sf, lambda: scoring.train_horizon(
        t.features(spark, sf), MODEL_QUANTILES, Params(**SHORT)))


def _legacy(spark, sf):
    return plans.legacy_features(t.prepared(spark, sf))


def _recursive_model(spark, sf):
    """Stops early on the newest 28 days."""
    return _once(spark, "recursive", sf, lambda: scoring.train_recursive(
        _legacy(spark, sf), MODEL_QUANTILES, Params(**SHORT, patience=3, min_delta=1e-4), early_stop=True))


@query
def quantile_model_losses(spark, sf):
    """Validation loss after every boosting round of each quantile."""
    model = _recursive_model(spark, sf)
    rows = [(q, i + 1, loss) for q in model.quantiles
            for i, loss in enumerate(model.trees.history[str(q)])]
    return spark.createDataFrame(rows, "quantile double, round int, loss double")


@query
def fold_model_losses(spark, sf):
    """Loss per fold, horizon and quantile of quantile models trained for all folds at once."""
    _, scored = scoring.train_folds(
        t.features(spark, sf), 3, MODEL_QUANTILES, Params(rounds=2, leaves=16, learning_rate=0.5))
    return t.rounded(scoring.fold_quantile_losses(scored, MODEL_QUANTILES))


@query
def direct_model_forecast(spark, sf):
    """Model forecasts of every series from both anchors, rescaled and widened."""
    model = _horizon_model(spark, sf)
    steps = reshape.repeat_horizons(forecast.anchors(t.features(spark, sf)))
    packed = model.score(steps).select(
        *PAIR, "kind", F.col("horizon_day").alias("h"), "target_wday", "yhat")
    profiles = summaries.weekday_profile(
        summaries.padded_history(t.features(spark, sf)), t.calendar(spark, sf))
    packed = forecast.widen(forecast.weekday_rescale(packed, profiles),
                            median=MODEL_QUANTILES.index(0.5))
    return t.rounded(forecast.unpack(packed, MODEL_QUANTILES).drop("target_wday"))


@query
def recursive_model_forecast(spark, sf):
    """Day-by-day forecasts fed back into their own rolling means."""
    packed = recursive.recursive_forecast(
        _recursive_model(spark, sf), recursive.seeds(_legacy(spark, sf)), t.calendar(spark, sf))
    return t.rounded(forecast.unpack(packed, MODEL_QUANTILES))


@query
def loss_comparison(spark, sf):
    """Three folds of squared, asymmetric and Tweedie boosting, trained together."""
    return t.rounded(trainers.compare_losses(
        t.features(spark, sf), {"squared": losses.Squared(), "asymmetric": losses.Asymmetric(),
                                "tweedie": losses.Tweedie()},
        Params(rounds=3, leaves=16, learning_rate=0.3, min_leaf_rows=100)))


def _cases(spark):
    return spark.createDataFrame(
        [("as_is", None, None), ("free", 0.0, None), ("busy", None, 20.0)],
        "scenario string, sell_price double, roll_mean_28_lag_28 double")


def _what_if(model, spark, sf):
    steps = reshape.repeat_horizons(forecast.anchors(t.features(spark, sf)).filter(
        F.col("kind") == "forecast"))
    scored = model.score(explain.scenarios(steps, _cases(spark), ["sell_price", "roll_mean_28_lag_28"]))
    return t.rounded(scored.select(
        *PAIR, "scenario", F.col("horizon_day").alias("h"),
        *[F.col("yhat")[i].alias(f"q{i}") for i in range(len(model.quantiles))]))


@query
def scenario_forecast(spark, sf):
    """Every series' next 28 days rescored under changed prices and demand levels."""
    return _what_if(_horizon_model(spark, sf), spark, sf)


@query
def feature_importance(spark, sf):
    model = _horizon_model(spark, sf).trees
    return t.rounded(trees.importance(model.rows(spark), model.features))


def _forecast_days(spark, sf):
    return reshape.repeat_horizons(forecast.anchors(t.features(spark, sf)).filter(F.col("kind") == "forecast"))


@query
def feature_attribution(spark, sf):
    """Shapley values of both ends of the 95 % band for every day of every forecast."""
    model = _horizon_model(spark, sf)
    return t.rounded(explain.attributions(
        model.encoded(_forecast_days(spark, sf)), model.trees, [*PAIR, "horizon_day"], ["0.025", "0.975"]))


@query
def uncertainty_drivers(spark, sf):
    """Top three features behind the width of the band, per series, on its widest day."""
    model = _horizon_model(spark, sf)
    steps = cut_lineage(model.score(reshape.repeat_horizons(
        forecast.anchors(t.features(spark, sf)).filter(F.col("kind") == "backtest"))))
    peaks = forecast.peak_spread(
        steps.withColumnRenamed("horizon_day", "h"), MODEL_QUANTILES.index(0.025),
        MODEL_QUANTILES.index(0.975)).select(
        *PAIR, F.col("peak_h").alias("horizon_day"))
    rows = steps.drop("yhat").join(peaks, [*PAIR, "horizon_day"])
    return t.rounded(explain.uncertainty_drivers(
        rows, model, [*PAIR, "horizon_day"], 0.025, 0.975))


# ---- given trees: the same code on trees that SQL can repeat ---------------------------------

@query
def fixed_tree_scores(spark, sf):
    """Every feature row scored by two ensembles of given trees, missing numbers below all others."""
    model = given.model(given.FIXED, ["lag_28", "sell_price", "wday"], spark).trees
    scored = model.score(t.features(spark, sf))
    return t.rounded(scored.select(
        *KEY, F.col("yhat")[0].alias("first"), F.col("yhat")[1].alias("second")))


@query
def given_tree_scores(spark, sf):
    """Every feature row scored by three quantiles of given trees with missing values and categories."""
    model = given.model(given.DAYS, given.DAY_FEATURES, spark)
    scored = model.score(t.features(spark, sf).withColumn("horizon_day", F.lit(1)))
    return t.rounded(scored.select(*KEY, *[F.col("yhat")[i].alias(f"q{i}") for i in range(3)]))


@query
def given_tree_scenarios(spark, sf):
    """What-ifs of every series' next 28 days under given trees."""
    return _what_if(given.model(given.DAYS, given.DAY_FEATURES, spark), spark, sf)


@query
def given_tree_recursion(spark, sf):
    """Backtest and forecast of every series, day by day, under given trees."""
    model = given.model(given.STEPS, given.STEP_FEATURES, spark)
    packed = recursive.recursive_forecast(
        model, recursive.seeds(_legacy(spark, sf)), t.calendar(spark, sf))
    return t.rounded(packed.select(*PAIR, "kind", "h", *[F.col("yhat")[i].alias(f"q{i}") for i in range(3)]))


def _refreshed(spark, sf):
    model = given.model(given.DAYS, given.DAY_FEATURES, spark)
    rows = model.encoded(t.features(spark, sf).withColumn("horizon_day", F.lit(1)))
    return model, trees.refreshed(rows, model.trees, "sales")


@query
def given_tree_nodes(spark, sf):
    """Rows that reach each node of given trees, and what its split takes off the squared error."""
    _, table = _refreshed(spark, sf)
    return t.rounded(table.select("member", "tree", "node", "feature", "cover", "gain"))


@query
def given_tree_importance(spark, sf):
    """Gain per feature over all feature rows, averaged over the members."""
    model, table = _refreshed(spark, sf)
    return t.rounded(trees.importance(table, model.trees.features))


@query
def given_tree_attribution(spark, sf):
    """Shapley values of every forecast day under given trees, weighed by all feature rows."""
    model, table = _refreshed(spark, sf)
    weighed = trees.TreeModel.from_rows(table, model.trees.features, model.trees.categories)
    return t.rounded(explain.attributions(
        model.encoded(_forecast_days(spark, sf)), weighed, [*PAIR, "horizon_day"], ["0.25", "0.75"]))


@query
def given_uncertainty_drivers(spark, sf):
    """Top three features behind the band between two quantiles of given trees, per forecast day."""
    model, table = _refreshed(spark, sf)
    weighed = scoring.ForecastModel(
        trees.TreeModel.from_rows(table, model.trees.features, model.trees.categories), model.mapping)
    return t.rounded(explain.uncertainty_drivers(
        _forecast_days(spark, sf), weighed, [*PAIR, "horizon_day"], 0.25, 0.75))


@query
def loss_terms(spark, sf):
    """Start, mean gradient, leaf step and mean loss of each loss per store, from a given score."""
    df = t.features(spark, sf).select(
        "store_id", F.col("sales").cast("double").alias("y"), (F.col("lag_28") * 0.05).alias("f"))
    y, f = F.col("y"), F.col("f")
    parts = None
    for name, loss in (("squared", losses.Squared()), ("asymmetric", losses.Asymmetric()),
                       ("tweedie", losses.Tweedie())):
        part = df.groupBy("store_id").agg(
            loss.start(y).alias("start"), F.avg(loss.gradient(y, f)).alias("gradient"),
            loss.leaf_value(y, f).alias("step"), F.avg(loss.value(y, f)).alias("loss"),
        ).withColumn("name", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return t.rounded(parts)


@query
def mapping_file(spark, sf):
    """Category codes written as JSON and read back."""
    path = scratch_path(tune(spark), "mapping")
    writers.write_mapping(encode.build_mapping(starschema.daily_sales(spark, sf)), path)
    return readers.read_mapping(spark, path)


@query
def leaderboard_file(spark, sf):
    """Item profiles with a store written as CSV and read by name."""
    path = scratch_path(tune(spark), "board")
    board = summaries.item_profile(t.sales(spark, sf)).withColumn("store_id", F.lit("ASIA"))
    writers.write_csv(board.select("store_id", "Sparsity", "item_id", "Volatility", "Popularity"), path)
    return t.rounded(readers.read_leaderboard(spark, path))


@query
def product_file(spark, sf):
    """Product names written as JSON and as CSV, read back, and joined to the items' sales."""
    path = scratch_path(tune(spark), "products")
    names = named_items(spark, sf).select("item_id", "product_name")
    names.write.json(f"{path}/names")
    writers.write_csv(names, f"{path}/names.csv")
    sold = starschema.daily_sales(spark, sf).groupBy("item_id").agg(F.sum("sales").alias("units"))
    found = lookup.attach_product_names(sold, readers.read_products(spark, f"{path}/names"))
    again = readers.read_products(spark, f"{path}/names.csv").select(
        "item_id", F.col("product_name").alias("name_in_csv"))
    return found.join(again, "item_id").select("item_id", "product_name", "name_in_csv", "units")


@query
def submission_file(spark, sf):
    """Forecast medians of every series laid over the template, written as CSV and read back."""
    path = scratch_path(tune(spark), "submission")
    packed = t.raw_predictions(spark, sf).filter(F.col("kind") == "forecast")
    predicted = packed.select(*PAIR, F.col("h").alias("d"), F.col("yhat")[forecast.MEDIAN].alias("yhat"))
    writers.write_csv(submissions.submission(predicted, _template(spark, sf)), path)
    days = ", ".join(f"F{i} double" for i in range(1, 29))
    return t.rounded(spark.read.schema(f"id string, {days}").csv(path, header=True, mode="FAILFAST"))


@query
def dataset_versions(spark, sf):
    """Whether the version of a written table stays, and changes as files join it; per store of the table."""
    path = scratch_path(tune(spark), "versioned")
    daily = starschema.daily_sales(spark, sf)
    daily.write.parquet(path)
    found = [stores.fingerprint(spark, path) for _ in range(2)]
    daily.filter(F.col("d") % 2 == 0).write.mode("append").parquet(path)
    found.append(stores.fingerprint(spark, path))
    return spark.read.parquet(path).groupBy("store_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "digits": F.lit(len(found[0])), "same": F.lit(found[0] == found[1]), "grown": F.lit(found[1] != found[2])})


@query
def horizon_v1_vectors(spark, sf):
    """Per series and horizon, the rows, the target's sum and the means of the first horizon model's 15 features."""
    df = plans.legacy_features(t.prepared(spark, sf))
    mapping = encode.build_mapping(df)
    coded = encode.encode(df, mapping, sizes=encode.category_sizes(mapping))
    stacked = horizon.expand_horizons(coded)
    source = {c: f"{c}_code" for c in CATEGORY_COLUMNS}
    return t.rounded(stacked.groupBy(*PAIR, F.col("horizon_day").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("target"),
        *[F.avg(F.col(source.get(c, c)).cast("double")).alias(f"x_{c}") for c in LEGACY_HORIZON_COLUMNS]))


@query
def training_file(spark, sf):
    """Horizon rows written as the training CSV and read back, per horizon."""
    path = scratch_path(tune(spark), "training")
    writers.write_training_csv(horizon_targets(spark, sf), path, ["horizon_day", "target_wday"])
    rows = spark.read.schema("target double, horizon_day int, target_wday int").csv(
        path, header=True, mode="FAILFAST")
    return rows.groupBy("horizon_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("target_sum"),
        F.sum("target_wday").alias("weekdays"))


@query
def store_refresh_flags(spark, sf):
    """Whether a store was written: first, again at its version, forced, at a new version."""
    path = scratch_path(tune(spark), "store")
    df = t.features(spark, sf)
    written = [stores.refresh(df, path, version, force) for version, force in (
        ("a", False), ("a", False), ("a", True), ("b", False))]
    rows = spark.read.parquet(f"{path}/ctx").groupBy().agg(F.count(F.lit(1)).alias("series"))
    return rows.select("series", *[
        F.lit(w).alias(n) for w, n in zip(written, ("first", "again", "forced", "newer"), strict=True)])


@query
def store_refresh(spark, sf):
    """Dataset fingerprint, and that a second refresh at the same version is skipped."""
    version = stores.fingerprint(tune(spark), *[
        f"{sf}/{name}.parquet" for name in t.SOURCES])
    path = scratch_path(spark, "store")
    df = t.features(spark, sf)
    written = [stores.refresh(df, path, version) for _ in range(2)]
    meta = spark.read.parquet(f"{path}/meta")
    return meta.withColumns({"first": F.lit(written[0]), "second": F.lit(written[1])})
