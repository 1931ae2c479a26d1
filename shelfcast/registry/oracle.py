"""The same queries in SQL, composed from named common table expressions."""

from __future__ import annotations

from shelfcast.registry.tables import FACTORS, REGIONS
from shelfcast.sources.schemas import (
    CATEGORY_COLUMNS, HORIZON_COLUMNS, LEGACY_HORIZON_COLUMNS, QUANTILES, STORE_ROW_COLUMNS)

# name -> (CTEs it reads, body)
CTES: dict[str, tuple[list[str], str]] = {}
ORACLE: dict[str, str] = {}
P = "PARTITION BY store_id, item_id"
W = f"({P} ORDER BY d)"
RUN = f"({P} ORDER BY d ROWS UNBOUNDED PRECEDING)"
IDS = "store_id, item_id, dept_id, cat_id, state_id"


def trailing(n: int, keys: str = P) -> str:
    return f"({keys} ORDER BY d ROWS {n - 1} PRECEDING)"


def strict_mean(col: str, n: int, keys: str = P) -> str:
    f = trailing(n, keys)
    return f"CASE WHEN count({col}) OVER {f} = {n} THEN avg({col}) OVER {f} END"


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (needs.split(), body)


def oracle(name: str, needs: str, body: str) -> None:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in CTES[n][0]:
            visit(m)
        if n not in order:
            order.append(n)
    for n in needs.split():
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    ORACLE[name] = (f"WITH {head}\n" if head else "") + body


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round({expr} + 1e-9, {digits}) AS {alias or expr}"


cte("lines", "", """
  SELECT r_name AS store_id,
         p_type || '_' || lpad(CAST(CAST(floor((p_size - 1) / 10.0) AS INTEGER) + 1 AS VARCHAR), 3, '0') AS item_id,
         p_type AS dept_id, substr(p_type, 1, 1) AS cat_id, r_name AS state_id,
         CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) + 1 AS INTEGER) AS d,
         l_quantity AS qty, l_extendedprice / l_quantity AS unit_price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("daily", "lines", f"""
  SELECT {IDS}, d, CAST(sum(qty) AS INTEGER) AS sales FROM lines GROUP BY ALL""")
cte("bound", "", """
  SELECT CAST(date_diff('day', DATE '1995-01-02', CAST(max(l_shipdate) AS DATE)) + 1 AS INTEGER) AS last_day
  FROM lineitem""")
cte("sales", "daily bound", f"""
  SELECT s.*, g.d, coalesce(q.sales, 0) AS sales
  FROM (SELECT DISTINCT {IDS} FROM daily) s
  CROSS JOIN (SELECT CAST(unnest(range(1, last_day + 1)) AS INTEGER) AS d FROM bound) g
  LEFT JOIN daily q ON q.store_id = s.store_id AND q.item_id = s.item_id AND q.d = g.d""")
cte("calendar", "bound", """
  SELECT d, CAST((dayofweek(dt) + 1) % 7 + 1 AS INTEGER) AS wday,
         CAST(month(dt) AS INTEGER) AS month,
         CASE WHEN month(dt) = 12 AND day(dt) = 25 THEN 'Christmas'
              WHEN month(dt) = 7 AND day(dt) = 4 THEN 'July4th' END AS event_name_1,
         CAST(day(dt) <= 10 AS INTEGER) AS "snap_CA",
         CAST(day(dt) <= 15 AND day(dt) % 2 = 1 AS INTEGER) AS "snap_TX",
         CAST(day(dt) <= 15 AND day(dt) % 2 = 0 AS INTEGER) AS "snap_WI",
         CAST(floor((d - 1) / 7.0) + 1 AS INTEGER) AS wm_yr_wk
  FROM (SELECT d, DATE '1995-01-02' + (d - 1) AS dt
        FROM (SELECT CAST(unnest(range(1, last_day + 29)) AS INTEGER) AS d FROM bound))""")
cte("prices", "lines", """
  SELECT store_id, item_id, CAST(floor((d - 1) / 7.0) + 1 AS INTEGER) AS wm_yr_wk,
         min(unit_price) AS sell_price FROM lines GROUP BY ALL""")
cte("prepared", "sales calendar prices", """
  SELECT s.*, c.* EXCLUDE (d), p.sell_price FROM sales s LEFT JOIN calendar c ON s.d = c.d
  LEFT JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk""")
cte("feat_a", "prepared", f"""
  SELECT *, sell_price / lag(sell_price, 7) OVER {W} AS price_momentum_7d,
         sell_price / lag(sell_price, 28) OVER {W} AS price_momentum_28d,
         lag(sales, 28) OVER {W} AS lag_28,
         sell_price / max(sell_price) OVER ({P}) AS price_norm,
         row_number() OVER {W} AS row_nr
  FROM prepared""")
cte("feat_b", "feat_a", f"""
  SELECT *, {strict_mean('lag_28', 7)} AS roll_mean_7_lag_28,
         {strict_mean('lag_28', 28)} AS roll_mean_28_lag_28,
         avg(CASE WHEN lag_28 > 0 THEN lag_28 END) OVER {trailing(28)} AS masked,
         max(CASE WHEN lag_28 > 0 THEN row_nr END) OVER {RUN} AS sold_row,
         count(lag_28) OVER {RUN} AS k
  FROM feat_a""")
cte("feat_all", "feat_b", f"""
  SELECT * EXCLUDE (masked, sold_row, k),
         last_value(masked IGNORE NULLS) OVER {RUN} AS masked_roll_mean_28_lag_28,
         CASE WHEN lag_28 IS NOT NULL THEN
           sum(lag_28 * pow(1 / 0.9::DOUBLE, k)) OVER {RUN} * pow(0.9::DOUBLE, k)
           / ((1 - pow(0.9::DOUBLE, k)) / 0.1::DOUBLE) END AS ema_lag_28,
         CAST(coalesce(row_nr - sold_row, 0) AS INTEGER) AS days_since_last_sale_lag_28
  FROM feat_b""")
cte("feat", "feat_all", """
  SELECT * FROM feat_all WHERE roll_mean_28_lag_28 IS NOT NULL AND price_momentum_28d IS NOT NULL""")
cte("naive", "feat", "SELECT store_id, item_id, d, sales, lag_28, " + ", ".join(
    f"lag_28 * {f}::DOUBLE AS q{i}" for i, f in enumerate(FACTORS)) + " FROM feat")
cte("ends", "feat", "SELECT max(d) AS end_d FROM feat")
cte("profiles", "sales", """
  SELECT item_id, CAST(sum(sales) AS DOUBLE) AS "Popularity",
         stddev_samp(sales) / avg(sales) AS "Volatility",
         100.0 * avg(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END) AS "Sparsity"
  FROM sales GROUP BY item_id""")
cte("items", "daily", "SELECT DISTINCT item_id, dept_id FROM daily")
cte("stores", "", "SELECT unnest([" + ", ".join(f"'{s}'" for s in REGIONS) + "]) AS store_id")
cte("wanted", "items", "SELECT item_id, unnest([" + ", ".join(
    f"'{s}'" for s in REGIONS + ["NOWHERE"]) + "]) AS store_id FROM items")
cte("latest", "feat", f"""
  SELECT *, max(d) OVER ({P}) AS last_d, row_number() OVER ({P} ORDER BY d DESC) AS age FROM feat""")
cte("slots", "latest", """
  SELECT store_id, item_id, max(last_d) AS last_d, unnest(range(84)) AS pos FROM latest GROUP BY store_id, item_id""")
# 84 positions per series, oldest first; missing ones are zeros on the left
cte("hist", "slots latest", """
  SELECT s.store_id, s.item_id, s.last_d, CAST(s.pos AS INTEGER) AS pos,
         CAST(coalesce(l.sales, 0) AS DOUBLE) AS sales
  FROM slots s LEFT JOIN latest l
  ON l.store_id = s.store_id AND l.item_id = s.item_id AND l.age = 84 - s.pos""")
cte("levels", "hist calendar", """
  SELECT k.store_id, k.item_id, k.wday, coalesce(v.level, 0.0) AS level
  FROM (SELECT DISTINCT store_id, item_id, unnest(range(1, 8)) AS wday FROM hist) k
  LEFT JOIN (SELECT h.store_id, h.item_id, c.wday, avg(h.sales) AS level
             FROM hist h JOIN calendar c ON c.d = h.last_d - 83 + h.pos
             GROUP BY ALL) v
  ON v.store_id = k.store_id AND v.item_id = k.item_id AND v.wday = k.wday""")
cte("anchors", "latest", """
  SELECT *, CASE WHEN d = last_d THEN 'forecast' ELSE 'backtest' END AS kind
  FROM latest WHERE d = last_d OR d = last_d - 28""")
cte("steps", "anchors", """
  SELECT store_id, item_id, kind, d, last_d, wday, lag_28, CAST(h AS INTEGER) AS h,
         CAST((wday + h - 1) % 7 + 1 AS INTEGER) AS target_wday
  FROM anchors CROSS JOIN (SELECT unnest(range(1, 29)) AS h)""")
cte("levelq", "", "SELECT unnest([" + ", ".join(map(str, QUANTILES)) + "])::DOUBLE AS q, "
    "unnest([" + ", ".join(map(str, FACTORS)) + "])::DOUBLE AS f")
cte("pred", "steps levelq", """
  SELECT store_id, item_id, kind, d AS anchor_d, last_d, h, target_wday, q, lag_28 * f AS yhat
  FROM steps CROSS JOIN levelq""")
cte("usual", "levels", """
  SELECT store_id, item_id, avg(CASE WHEN level > 0 THEN level END) AS usual FROM levels GROUP BY ALL""")
cte("rescaled", "pred levels usual", """
  SELECT p.* EXCLUDE (yhat),
         CASE WHEN u.usual IS NULL OR l.level <= 0 OR abs(l.level / u.usual - 1) < 1e-6 THEN p.yhat
              ELSE greatest(0.0, p.yhat * (l.level / u.usual)) END AS yhat
  FROM pred p JOIN levels l ON l.store_id = p.store_id AND l.item_id = p.item_id AND l.wday = p.target_wday
  JOIN usual u ON u.store_id = p.store_id AND u.item_id = p.item_id""")


def widen(source: str) -> str:
    return f"""
  SELECT w.* EXCLUDE (yhat, med, scale),
         CASE WHEN scale = 1 THEN yhat ELSE greatest(0.0, med + (yhat - med) * scale) END AS yhat
  FROM (SELECT *, 1 + 0.84::DOUBLE * sqrt((h - 1) / 27.0::DOUBLE) AS scale,
               max(CASE WHEN q = 0.5 THEN yhat END) OVER (PARTITION BY store_id, item_id, kind, h) AS med
        FROM {source}) w"""


cte("adjusted", "rescaled", widen("rescaled"))
cte("wide", "adjusted", "SELECT store_id, item_id, kind, h, " + ", ".join(
    f"max(CASE WHEN q = {q} THEN yhat END) AS b{i}" for i, q in enumerate(QUANTILES))
    + " FROM adjusted GROUP BY ALL")
cte("scored", "wide hist", """
  SELECT w.*, CASE WHEN kind = 'backtest' THEN h2.sales END AS actual
  FROM wide w JOIN hist h2 ON h2.store_id = w.store_id AND h2.item_id = w.item_id AND h2.pos = 55 + w.h""")
cte("numbered", "feat", f"SELECT *, row_number() OVER {W} AS rn FROM feat")
cte("targets", "numbered", """
  SELECT a.store_id, a.item_id, a.d, a.wday, a.lag_28, CAST(h AS INTEGER) AS horizon_day,
         CAST((a.wday + h - 1) % 7 + 1 AS INTEGER) AS target_wday,
         CAST(b.sales AS DOUBLE) AS target
  FROM numbered a CROSS JOIN (SELECT unnest(range(1, 29)) AS h)
  JOIN numbered b ON b.store_id = a.store_id AND b.item_id = a.item_id AND b.rn = a.rn + h""")
cte("dept", "sales", """
  SELECT store_id, dept_id, d, CAST(sum(sales) AS BIGINT) AS dept_daily_sales FROM sales GROUP BY ALL""")
DP = "PARTITION BY store_id, dept_id"
cte("dept_lag", "dept", f"SELECT *, lag(dept_daily_sales, 28) OVER ({DP} ORDER BY d) AS lg FROM dept")
cte("dept_roll", "dept_lag", f"""
  SELECT store_id, dept_id, d, dept_daily_sales, {strict_mean('lg', 28, DP)} AS dept_roll_mean_28,
         {strict_mean('lg', 7, DP)} AS dept_roll_mean_7 FROM dept_lag""")
cte("ext_a", "prepared", f"""
  SELECT *, lag(sales, 7) OVER {W} AS lag_7, lag(sales, 28) OVER {W} AS lag_28,
         lag(sell_price, 28) OVER {W} AS price_lag_28,
         lag(CASE WHEN sales = 0 THEN 1.0 ELSE 0.0 END, 28) OVER {W} AS zero_lag,
         (sell_price - avg(sell_price) OVER ({P}))
           / (stddev_samp(sell_price) OVER ({P}) + 1e-5) AS price_zscore
  FROM prepared""")
cte("ext", "ext_a", f"""
  SELECT *, {strict_mean('lag_28', 7)} AS roll_mean_7, {strict_mean('lag_28', 28)} AS roll_mean_28,
         {strict_mean('zero_lag', 28)} AS sparsity_ratio_28, count(lag_28) OVER {RUN} AS k,
         (sell_price - price_lag_28) / (price_lag_28 + 1e-5) AS price_change_ratio
  FROM ext_a""")

KEY = "store_id, item_id, d"

oracle("horizon_feature_table", "feat", f"""
SELECT {KEY}, sales, wday, month, {r('sell_price')}, {r('price_norm')}, {r('price_momentum_7d')},
  {r('price_momentum_28d')}, lag_28, {r('roll_mean_7_lag_28')}, {r('roll_mean_28_lag_28')},
  {r('masked_roll_mean_28_lag_28')}, {r('ema_lag_28')}, days_since_last_sale_lag_28 FROM feat""")
ORACLE["appended_feature_table"] = ORACLE["horizon_feature_table"]
oracle("preprocess_from_csv", "feat", f"""
SELECT {KEY}, sales, {r('sell_price')}, lag_28, {r('roll_mean_28_lag_28')}, {r('ema_lag_28')} FROM feat""")
oracle("unpivot_wide_sales", "sales", f"SELECT {KEY}, dept_id, cat_id, sales FROM sales")
oracle("prepared_sales", "prepared", f"""
SELECT {KEY}, sales, wday, month, event_name_1, "snap_CA", "snap_TX", "snap_WI", wm_yr_wk, {r('sell_price')}
FROM prepared""")
oracle("calendar_table", "calendar", "SELECT * FROM calendar")
oracle("filtered_store_days", "prepared", f"""
SELECT item_id, d, {r('CAST(sales AS DOUBLE)', 'units')}, {r('sell_price', 'price')}, 'ASIA' AS store
FROM prepared WHERE store_id = 'ASIA' AND d BETWEEN 500 AND 2000 AND sales > 0 AND sell_price IS NOT NULL""")
oracle("rows_without_nulls", "prepared", """
SELECT store_id, item_id, count(*) AS n, CAST(sum(sales) AS BIGINT) AS units FROM prepared
WHERE event_name_1 IS NOT NULL AND sell_price IS NOT NULL GROUP BY ALL""")
_names = ["store_id", "item_id", "dept_id", "cat_id", "state_id", "wday", "month", "event_name_1",
          "snap_CA", "snap_TX", "snap_WI", "sell_price"]
_cats = ["item_id", "dept_id", "cat_id", "store_id", "state_id", "wday", "month", "event_name_1"]
oracle("selected_features", "prepared", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count(\"{c}\") AS n_known, {int(c in _cats)} AS categorical FROM prepared"
    for c in _names))
oracle("filled_prices", "prepared", f"""
SELECT {KEY}, {r('coalesce(sell_price, 0.0)', 'sell_price')}, coalesce(event_name_1, 'N/A') AS event_name_1,
  coalesce(event_name_1, item_id) AS label FROM prepared""")
oracle("sampled_users", "", f"""
WITH ids AS (SELECT user_id, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR) || '42')) AS rn,
             count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL))
SELECT user_id, count(*) AS n, {r('sum(value)', 'total', 4)} FROM events
WHERE user_id IN (SELECT user_id FROM ids WHERE rn <= floor(n * 0.05)) GROUP BY user_id""")
oracle("sampled_item_rows", "sales", f"""
SELECT {KEY}, sales FROM sales WHERE item_id IN (
  SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY md5(item_id || '42')) AS rn,
                       count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM sales))
  WHERE rn <= floor(n * 0.05))""")
oracle("pivoted_last_days", "sales bound", "SELECT item_id || '_' || store_id || '_validation' AS id, "
       + ", ".join(f'max(CASE WHEN d = last_day - 28 + {i} THEN sales END) AS "F{i}"' for i in range(1, 29))
       + " FROM sales CROSS JOIN bound GROUP BY 1")
oracle("repeated_horizons", "steps", """
SELECT store_id, item_id, kind, d, wday, h AS horizon_day, target_wday FROM steps""")
oracle("items_at_every_store", "profiles stores", f"""
SELECT item_id, {r('"Popularity"', '"Popularity"')}, store_id FROM profiles CROSS JOIN stores""")
oracle("leaderboard_store_fanout", "profiles daily", f"""
SELECT p.item_id, {r('"Popularity"', '"Popularity"')}, k.store_id, k.dept_id FROM profiles p
LEFT JOIN (SELECT DISTINCT item_id, store_id, dept_id FROM daily) k ON k.item_id = p.item_id""")
oracle("servable_pairs", "items stores feat", """
SELECT store_id, item_id FROM items CROSS JOIN stores
WHERE (store_id, item_id) IN (SELECT (store_id, item_id) FROM feat)""")
oracle("unfiltered_when_pairs_unknown", "items", "SELECT 'NOWHERE' AS store_id, item_id FROM items")
oracle("unfiltered_when_store_empty", "items stores", "SELECT store_id, item_id FROM items CROSS JOIN stores")


def product_sql(item: str) -> str:
    n = f"CAST(split_part({item}, '_', 2) AS INTEGER)"
    return f"""('Brand#' || CAST({n} % 25 + 1 AS VARCHAR) || ' ' ||
  CASE WHEN contains({item}, 'ECONOMY') THEN 'Saver ' || CAST({n} % 30 + 1 AS VARCHAR)
       WHEN contains({item}, 'PROMO') THEN 'Deal ' || CAST({n} % 30 + 1 AS VARCHAR)
       ELSE 'Classic ' || CAST({n} % 31 + 1 AS VARCHAR) END)"""


oracle("product_names", "items", f"SELECT item_id, dept_id, {product_sql('item_id')} AS product_name FROM items")
oracle("named_sales", "daily", f"""
SELECT CASE WHEN dept_id = 'LARGE' THEN item_id ELSE {product_sql('item_id')} END AS product_name,
  CAST(sum(sales) AS BIGINT) AS units FROM daily GROUP BY 1""")
oracle("anchor_rows", "anchors", f"""
SELECT {KEY}, sales, lag_28, {r('ema_lag_28')} FROM anchors WHERE kind = 'backtest'""")

oracle("department_day_totals", "dept", "SELECT * FROM dept")
oracle("store_day_quantile_totals", "naive", "SELECT store_id, d, CAST(sum(sales) AS BIGINT) AS sales, "
       + ", ".join(r(f"sum(q{i})", f"q{i}") for i in range(9)) + " FROM naive GROUP BY store_id, d")
oracle("daily_forecast_errors", "naive", f"""
SELECT d, CAST(sum(sales) AS BIGINT) AS actual_total, {r('sum(q4)', 'predicted_total')},
  {r('sqrt(avg((q4 - sales) * (q4 - sales)))', 'daily_rmse')} FROM naive GROUP BY d""")
_sq = "(lag_28 * {f}::DOUBLE - target) * (lag_28 * {f}::DOUBLE - target)"
_rec, _dir = _sq.format(f="1.3"), _sq.format(f="1.0")
oracle("horizon_step_errors", "targets", f"""
SELECT horizon_step, {r('rr', 'rmse_recursive')}, {r('rd', 'rmse_direct')},
  {r('sum(rr) OVER (ORDER BY horizon_step)', 'cum_rmse_recursive')},
  {r('sum(rd) OVER (ORDER BY horizon_step)', 'cum_rmse_direct')}
FROM (SELECT horizon_day AS horizon_step, sqrt(avg({_rec})) AS rr, sqrt(avg({_dir})) AS rd
      FROM targets GROUP BY 1)""")
oracle("architecture_improvement", "targets", f"""
SELECT {r('rr', 'rmse_recursive')}, {r('rd', 'rmse_direct')}, {r('(rr - rd) / rr * 100', 'improvement')}
FROM (SELECT sqrt(avg({_rec})) AS rr, sqrt(avg({_dir})) AS rd FROM targets)""")
oracle("distinct_counts", "sales", """
SELECT count(DISTINCT item_id) AS items, count(DISTINCT store_id) AS stores,
  count(DISTINCT dept_id) AS depts, count(DISTINCT (store_id, item_id)) AS pairs FROM sales""")
oracle("distinct_series", "daily", "SELECT DISTINCT item_id, store_id, dept_id FROM daily")
oracle("day_range", "feat", f"SELECT min(d) AS low, max(d) AS high, {r('avg(d)', 'mean')} FROM feat")
_prof = f"""{r('"Popularity"', '"Popularity"')}, {r('"Volatility"', '"Volatility"')}, {r('"Sparsity"', '"Sparsity"')}"""
oracle("item_profiles", "profiles", f"SELECT item_id, {_prof} FROM profiles")
oracle("weekday_profiles", "levels", f"SELECT store_id, item_id, CAST(wday AS INTEGER) AS wday, {r('level')} FROM levels")
oracle("history_lists", "latest", """
SELECT store_id, item_id, last_d, CAST(least(84, count(*) OVER (PARTITION BY store_id, item_id)) - age AS INTEGER) AS pos,
  CAST(sales AS DOUBLE) AS sales FROM latest QUALIFY age <= 84""")
oracle("padded_history_means", "hist", f"""
SELECT store_id, item_id, CAST(count(*) AS INTEGER) AS n,
  {r('avg(CASE WHEN pos BETWEEN 49 AND 55 THEN sales END)', 'mean_7')},
  {r('avg(CASE WHEN pos BETWEEN 28 AND 55 THEN sales END)', 'mean_28')},
  CAST(NULL AS DOUBLE) AS mean_empty FROM hist GROUP BY store_id, item_id""")
oracle("residual_bins_15", "naive", """
SELECT CAST(least(floor((e - lo) / ((hi - lo) / 15)), 14) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT sales - q4 AS e FROM naive), (SELECT min(sales - q4) AS lo, max(sales - q4) AS hi FROM naive)
GROUP BY 1""")
oracle("residual_bins_50", "naive", """
SELECT CAST(least(floor((e - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT q4 - sales AS e FROM naive), (SELECT min(q4 - sales) AS lo, max(q4 - sales) AS hi FROM naive)
GROUP BY 1""")

oracle("lagged_values", "ext_a", f"SELECT {KEY}, lag_7, lag_28, {r('price_lag_28')} FROM ext_a")
oracle("lead_values", "sales", f"""
SELECT {KEY}, lead(sales, 1) OVER {W} AS target_1, lead(sales, 28) OVER {W} AS target_28 FROM sales""")
oracle("rolling_means", "ext", f"SELECT {KEY}, {r('roll_mean_7')}, {r('roll_mean_28')} FROM ext")
oracle("legacy_feature_table", "ext", f"""
SELECT * FROM (SELECT {KEY}, sales, {r('sell_price')},
  {r(f'sell_price / max(sell_price) OVER ({P})', 'price_norm')}, {r('roll_mean_7')}, {r('roll_mean_28')} FROM ext)
WHERE roll_mean_28 IS NOT NULL""")
oracle("demand_recency", "feat_all", f"""
SELECT {KEY}, {r('masked_roll_mean_28_lag_28')}, {r('ema_lag_28')}, days_since_last_sale_lag_28 FROM feat_all""")
oracle("forward_filled_prices", "prepared", f"""
SELECT {KEY}, CAST(row_number() OVER {W} AS INTEGER) AS row_nr,
  {r(f'last_value(sell_price IGNORE NULLS) OVER {RUN}', 'price_filled')} FROM prepared""")
oracle("price_features", "ext", f"""
SELECT {KEY}, {r(f'sell_price / lag(sell_price, 7) OVER {W}', 'price_momentum_7d')},
  {r(f'sell_price / lag(sell_price, 28) OVER {W}', 'price_momentum_28d')},
  {r(f'sell_price / max(sell_price) OVER ({P})', 'price_norm')}, {r('price_zscore')}, {r('price_change_ratio')}
FROM ext""")


def moments(span: int) -> str:
    """Weighted sums in blocks short enough for double range; the previous block is carried over."""
    q = f"({span - 1}.0::DOUBLE / {span + 1}.0::DOUBLE)"
    size = 800
    return f"""
  SELECT {KEY}, lag_28 AS x, k, {q} AS q, b, k - b * {size} AS j,
    (sum(lag_28 * pow(1 / {q}, k - b * {size})) OVER inside
      + coalesce(sum(lag_28 * pow({q}, {size} - (k - b * {size}))) OVER before, 0)) * pow({q}, k - b * {size}) AS s1,
    (sum(lag_28 * lag_28 * pow(1 / {q}, k - b * {size})) OVER inside
      + coalesce(sum(lag_28 * lag_28 * pow({q}, {size} - (k - b * {size}))) OVER before, 0)) * pow({q}, k - b * {size}) AS s2
  FROM (SELECT *, CAST(floor((k - 1) / {size}.0) AS INTEGER) AS b FROM ext WHERE roll_mean_28 IS NOT NULL OR lag_28 IS NOT NULL)
  WINDOW inside AS (PARTITION BY store_id, item_id, b ORDER BY d ROWS UNBOUNDED PRECEDING),
         before AS ({P} ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"""


def moment_columns(n: int) -> str:
    w1 = f"((1 - pow(m{n}.q, m{n}.k)) / (1 - m{n}.q))"
    w2 = f"((1 - pow(m{n}.q, 2 * m{n}.k)) / (1 - m{n}.q * m{n}.q))"
    mean = f"(m{n}.s1 / {w1})"
    std = (f"CASE WHEN m{n}.k > 1 THEN sqrt(greatest(0.0, m{n}.s2 / {w1} - {mean} * {mean}) * {w1} * {w1}"
           f" / ({w1} * {w1} - {w2})) END")
    return f"{r(mean, f'ema_{n}', 5)}, {r(std, f'ewm_std_{n}', 5)}"


cte("m7", "ext", moments(7))
cte("m28", "ext", moments(28))
oracle("weighted_moments", "ext m7 m28", f"""
SELECT e.store_id, e.item_id, e.d, {moment_columns(7)}, {moment_columns(28)}
FROM ext e JOIN m7 ON m7.store_id = e.store_id AND m7.item_id = e.item_id AND m7.d = e.d
JOIN m28 ON m28.store_id = e.store_id AND m28.item_id = e.item_id AND m28.d = e.d
WHERE e.roll_mean_28 IS NOT NULL""")
oracle("extended_feature_table", "ext dept_roll", f"""
SELECT e.store_id, e.item_id, e.d, {r('t.dept_roll_mean_28', 'dept_roll_mean_28')},
  {r('t.dept_roll_mean_7', 'dept_roll_mean_7')}, {r('roll_mean_7')}, {r('roll_mean_28')}, lag_7,
  {r('sparsity_ratio_28')}, CAST(wday IN (1, 2) AS INTEGER) AS is_weekend,
  CASE state_id WHEN 'AFRICA' THEN "snap_CA" WHEN 'AMERICA' THEN "snap_TX" WHEN 'ASIA' THEN "snap_WI" ELSE 0 END AS snap_active,
  CAST(event_name_1 IS NOT NULL AS INTEGER) AS has_event, {r('price_zscore')}, {r('price_change_ratio')}
FROM ext e LEFT JOIN dept_roll t ON t.store_id = e.store_id AND t.dept_id = e.dept_id AND t.d = e.d
WHERE roll_mean_28 IS NOT NULL""")
oracle("department_rolling_means", "dept_roll", f"""
SELECT store_id, dept_id, d, dept_daily_sales, {r('dept_roll_mean_28')}, {r('dept_roll_mean_7')} FROM dept_roll""")
oracle("cumulative_sales", "naive", f"""
SELECT {KEY}, CAST(sum(sales) OVER {RUN} AS BIGINT) AS cum_sales,
  """ + ", ".join(r(f"sum(q{i}) OVER {RUN}", f"cum_q{i}") for i in range(9)) + " FROM naive")
_srun = "(PARTITION BY store_id ORDER BY d ROWS UNBOUNDED PRECEDING)"
oracle("store_cumulative_fan", "naive", f"""
SELECT store_id, d, CAST(sum(s) OVER {_srun} AS BIGINT) AS cum_sales,
  """ + ", ".join(r(f"sum(a{i}) OVER {_srun}", f"cum_q{i}") for i in range(9)) + """
FROM (SELECT store_id, d, sum(sales) AS s, """ + ", ".join(f"sum(q{i}) AS a{i}" for i in range(9))
       + " FROM naive GROUP BY ALL)")
oracle("anchored_fan", "pred hist", f"""
SELECT p.store_id, p.item_id, p.kind, p.h, round(q + 1e-9, 6) AS q, round(1e-9 + CASE WHEN p.kind = 'backtest' THEN b.early ELSE b.total END
  + sum(yhat) OVER (PARTITION BY p.store_id, p.item_id, p.kind, q ORDER BY h ROWS UNBOUNDED PRECEDING), 6) AS yhat
FROM pred p JOIN (SELECT store_id, item_id, sum(sales) AS total,
                  sum(CASE WHEN pos < 56 THEN sales ELSE 0 END) AS early FROM hist GROUP BY ALL) b
ON b.store_id = p.store_id AND b.item_id = p.item_id""")
oracle("last_rows", "sales", f"""
SELECT {KEY}, sales FROM sales QUALIFY row_number() OVER ({P} ORDER BY d DESC) <= 28""")
cte("widened", "pred", widen("pred"))
oracle("peak_uncertainty", "widened", f"""
SELECT store_id, item_id, h AS peak_h, {r('s', 'spread')} FROM (
  SELECT store_id, item_id, h, max(CASE WHEN q = 0.975 THEN yhat END) - max(CASE WHEN q = 0.025 THEN yhat END) AS s
  FROM widened WHERE kind = 'backtest' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY store_id, item_id ORDER BY s DESC, h) = 1""")
oracle("ranked_days", "bound", """
SELECT d, CAST(d - last_day + 28 AS INTEGER) AS day_rank
FROM (SELECT last_day, CAST(unnest(range(last_day - 27, last_day + 1)) AS INTEGER) AS d FROM bound)""")
cte("ev", "", """
  SELECT event_type AS store_id, CAST(user_id AS VARCHAR) AS item_id,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS d,
    CAST(count(*) AS INTEGER) AS sales FROM events GROUP BY ALL""")
oracle("event_series_lags", "ev", f"""
SELECT {KEY}, sales, lag(sales, 1) OVER {W} AS lag_1, {r(strict_mean('sales', 3), 'roll_mean_3')},
  CAST(row_number() OVER {W} AS INTEGER) AS row_nr FROM ev""")

oracle("top_items", "profiles", f"""
SELECT item_id, {_prof} FROM profiles ORDER BY profiles."Popularity" DESC, item_id LIMIT 500""")
oracle("top_days_per_series", "sales", f"""
SELECT * FROM (SELECT {KEY}, sales, CAST(row_number() OVER ({P} ORDER BY sales DESC, d) AS INTEGER) AS rank FROM sales)
WHERE rank <= 3""")
oracle("united_stores", "sales", """
SELECT store_id, item_id, count(*) AS n, CAST(sum(sales) AS BIGINT) AS units FROM sales GROUP BY ALL""")

oracle("calendar_flags", "prepared", f"""
SELECT {KEY}, CAST((wday + 27) % 7 + 1 AS INTEGER) AS target_wday, CAST((d - 1) % 28 + 1 AS INTEGER) AS horizon_step,
  CAST(wday <= 2 AS INTEGER) AS is_weekend, CAST(event_name_1 IS NOT NULL AS INTEGER) AS has_event,
  CASE state_id WHEN 'AFRICA' THEN "snap_CA" WHEN 'AMERICA' THEN "snap_TX" WHEN 'ASIA' THEN "snap_WI" ELSE 0 END AS snap_active
FROM prepared""")
oracle("series_ids", "daily", "SELECT DISTINCT item_id || '_' || store_id || '_evaluation' AS id FROM daily")
oracle("item_captions", "profiles", """
SELECT item_id, concat_ws(' · ', 'Volume ' || format('{:,}', CAST("Popularity" AS BIGINT)),
  CASE WHEN "Volatility" < 2.5 THEN 'CV ' || printf('%.2f', "Volatility") END,
  printf('%.0f', "Sparsity") || '% zero days') AS caption FROM profiles""")
oracle("formatted_units", "sales", """
SELECT store_id, d, CASE WHEN u = 0 THEN '—' WHEN u >= 100 THEN format('{:,}', u)
  ELSE CAST(u AS VARCHAR) || '.0' END AS label
FROM (SELECT store_id, d, CAST(sum(sales) AS BIGINT) AS u FROM sales GROUP BY ALL)""")
oracle("clamped_errors", "naive", f"""
SELECT {KEY}, {r('greatest(0.0, q4 - sales)', 'clamped')}, {r('abs(q4 - sales)', 'absolute')},
  {r('(q4 - sales) * (q4 - sales)', 'squared')}, {r('sqrt(abs(q4 - sales))', 'root')} FROM naive""")
oracle("sanitised_store_rows", "feat_all", f"""
SELECT {KEY}, {r('sales', 'sales')}, {r('coalesce(sell_price, 0.0)', 'sell_price')},
  {r('coalesce(price_norm, 0.0)', 'price_norm')}, "snap_CA", {r('coalesce(lag_28, 0)', 'lag_28')},
  days_since_last_sale_lag_28 FROM feat_all""")

oracle("horizon_expansion", "targets", f"""
SELECT {KEY}, count(*) AS n, sum(target) AS target_sum, sum(target * horizon_day) AS by_horizon,
  sum(target * target_wday) AS by_wday FROM targets GROUP BY ALL""")
oracle("strict_horizon_expansion", "feat", """
SELECT a.store_id, a.item_id, a.d, count(*) AS n, CAST(sum(b.sales) AS DOUBLE) AS target_sum,
  CAST(sum(b.sales * (b.d - a.d)) AS DOUBLE) AS by_horizon
FROM feat a JOIN feat b ON b.store_id = a.store_id AND b.item_id = a.item_id AND b.d > a.d AND b.d <= a.d + 28
GROUP BY ALL""")
oracle("training_window", "feat ends", f"SELECT {KEY}, sales FROM feat CROSS JOIN ends WHERE d >= end_d - 28 - 365")
cte("window_feat", "feat ends", "SELECT feat.*, end_d FROM feat CROSS JOIN ends WHERE d >= end_d - 28 - 365")
cte("window_rows", "window_feat", f"SELECT *, row_number() OVER {W} AS rn FROM window_feat")
cte("window_targets", "window_rows", """
  SELECT a.d, a.end_d, CAST(h AS INTEGER) AS horizon_day, CAST(b.sales AS DOUBLE) AS target
  FROM window_rows a CROSS JOIN (SELECT unnest(range(1, 29)) AS h)
  JOIN window_rows b ON b.store_id = a.store_id AND b.item_id = a.item_id AND b.rn = a.rn + h""")
oracle("hold_out_rows", "window_targets", "\nUNION ALL ".join(f"""
SELECT horizon_day, count(*) AS n, sum(target) AS target_sum, '{on}' AS split_on, '{side}' AS side
FROM window_targets WHERE {day} {op} end_d - 28 GROUP BY horizon_day"""
    for on, day in (("anchor", "d"), ("target", "d + horizon_day"))
    for side, op in (("train", "<="), ("valid", ">"))))
oracle("cv_folds", "feat ends", """
SELECT CAST(fold AS INTEGER) AS fold, min(CASE WHEN d > stop - 28 THEN d END) AS first_d,
  max(CASE WHEN d <= stop THEN d END) AS last_d, count(CASE WHEN d > stop - 28 AND d <= stop THEN 1 END) AS n_valid,
  count(CASE WHEN d <= stop - 28 THEN 1 END) AS n_train
FROM (SELECT d, fold, end_d - (fold - 1) * 28 AS stop FROM feat CROSS JOIN ends CROSS JOIN (SELECT unnest([1, 2, 3]) AS fold))
GROUP BY fold""")
_dims = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


def code_union(source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT {c} FROM {source})" for c in _dims)


oracle("category_codes", "daily", code_union("daily") + """
UNION ALL SELECT 'target_wday', CAST(w AS VARCHAR), CAST(w - 1 AS INTEGER) FROM (SELECT unnest(range(1, 8)) AS w)""")
cte("early", "daily", "SELECT * FROM daily WHERE d < 300")
cte("codes", "early", code_union("early"))
oracle("encoded_categories", "daily codes", "SELECT x.store_id, x.item_id, x.d, " + ", ".join(
    f"coalesce(c{i}.code, 0) AS {c}_code" for i, c in enumerate(_dims)) + ", c0.code AS item_id_or_null FROM daily x "
    + " ".join(f"LEFT JOIN codes c{i} ON c{i}.\"column\" = '{c}' AND c{i}.value = x.{c}" for i, c in enumerate(_dims)))
oracle("sample_weights", "prepared", f"""
SELECT {KEY}, {r('sqrt(coalesce(sales * sell_price, 0.0) / 2.0)', 'w')}, round(1.0 + 1e-9, 6)::DOUBLE AS scale_factor FROM prepared""")

oracle("rescaled_forecast", "rescaled", f"SELECT store_id, item_id, kind, h, round(q + 1e-9, 6) AS q, {r('yhat')} FROM rescaled")
oracle("widened_forecast", "widened", f"SELECT store_id, item_id, kind, h, round(q + 1e-9, 6) AS q, {r('yhat')} FROM widened")
oracle("adjusted_forecast", "adjusted", f"""
SELECT store_id, item_id, kind, anchor_d, last_d, h, round(q + 1e-9, 6) AS q, {r('yhat')} FROM adjusted""")
oracle("forecast_records", "wide hist", f"""
SELECT w.store_id, w.item_id, {product_sql('w.item_id')} AS product_name, 84 AS n_history, x.avg_sales_28,
  9 AS n_quantiles, {r("sum(CASE WHEN kind = 'forecast' THEN b4 END)", 'median_total')},
  {r("max(CASE WHEN kind = 'forecast' AND h = 28 THEN b7 END)", 'upper_last')},
  {r("sum(CASE WHEN kind = 'backtest' THEN b3 END)", 'backtest_low_total')}
FROM wide w JOIN (SELECT store_id, item_id, round(round(avg(CASE WHEN pos >= 56 THEN sales END), 2) + 1e-9, 6) AS avg_sales_28
                  FROM hist GROUP BY ALL) x ON x.store_id = w.store_id AND x.item_id = w.item_id
GROUP BY w.store_id, w.item_id, x.avg_sales_28""")
oracle("series_states", "wanted anchors hist", """
SELECT w.store_id, w.item_id, CASE WHEN f.store_id IS NULL THEN 'not_found'
  WHEN f.lag_28 = 0 AND x.recent > 0 THEN 'missing_lag'
  WHEN b.store_id IS NULL THEN 'missing_anchor' ELSE 'ok' END AS status
FROM wanted w
LEFT JOIN anchors f ON f.store_id = w.store_id AND f.item_id = w.item_id AND f.kind = 'forecast'
LEFT JOIN anchors b ON b.store_id = w.store_id AND b.item_id = w.item_id AND b.kind = 'backtest'
LEFT JOIN (SELECT store_id, item_id, sum(CASE WHEN pos >= 56 THEN sales END) AS recent FROM hist GROUP BY ALL) x
ON x.store_id = w.store_id AND x.item_id = w.item_id""")

oracle("store_rows", "latest", f"""
SELECT {KEY}, sales, wday, lag_28, {r('ema_lag_28')} FROM latest WHERE age <= 112""")
oracle("store_context", "latest ends", f"""
SELECT {KEY}, sales, {r('price_norm')}, lag_28, end_d AS max_d FROM latest CROSS JOIN ends WHERE age = 1""")
oracle("store_lookup", "wanted anchors hist", f"""
SELECT w.store_id, w.item_id, f.d, f.lag_28, CASE WHEN f.d IS NULL THEN 'none' WHEN w.store_id = 'ASIA' THEN 'table'
  ELSE 'store' END AS source, {r('coalesce(x.total, 0.0)', 'history_total')}
FROM wanted w LEFT JOIN anchors f ON f.store_id = w.store_id AND f.item_id = w.item_id AND f.kind = 'forecast'
LEFT JOIN (SELECT store_id, item_id, sum(sales) AS total FROM hist GROUP BY ALL) x
ON x.store_id = w.store_id AND x.item_id = w.item_id""")
oracle("required_columns", "feat", "SELECT " + ", ".join(
    f'count("{c}") AS "{c}"' for c in STORE_ROW_COLUMNS) + " FROM feat")
cte("naive_long", "naive", "\nUNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, sales, q{i} AS yhat FROM naive" for i, q in enumerate(QUANTILES)))
oracle("pinball_losses", "naive_long", f"""
SELECT round(q + 1e-9, 6) AS q, {r('avg(greatest(q * (sales - yhat), (q - 1) * (sales - yhat)))', 'loss')},
  {r('avg(CASE WHEN sales >= yhat THEN q * (sales - yhat) ELSE (q - 1) * (sales - yhat) END)', 'loss_branches')}
FROM naive_long GROUP BY q""")
cte("folded", "naive ends", """
  SELECT *, CAST(floor((end_d - d) / 28.0) + 1 AS INTEGER) AS fold, lag_28 + 1.0::DOUBLE AS weight
  FROM naive CROSS JOIN ends WHERE d > end_d - 84""")
cte("fold_scores", "folded", """
  SELECT fold, sqrt(avg((q4 - sales) * (q4 - sales))) AS rmse, avg(abs(q4 - sales)) AS mae,
    avg(greatest(0.5 * (sales - q4), -0.5 * (sales - q4)) * weight / (2.0::DOUBLE + 1e-5)) AS wspl
  FROM folded GROUP BY fold""")
_sc = f"{r('rmse')}, {r('mae')}, {r('wspl')}"
oracle("fold_scores", "fold_scores", f"SELECT fold, {_sc} FROM fold_scores")
oracle("average_scores", "fold_scores", f"""
SELECT {r('avg(rmse)', 'rmse')}, {r('avg(mae)', 'mae')}, {r('avg(wspl)', 'wspl')} FROM fold_scores""")
oracle("horizon_quantile_losses", "targets ends", f"""
SELECT fold, {r('fold_loss')}, {r('avg(fold_loss) OVER ()', 'overall_loss')} FROM (
  SELECT fold, avg(loss) AS fold_loss FROM (
    SELECT CAST((end_d - d) / 28 AS INTEGER) AS fold, horizon_day,
      avg(greatest(0.95::DOUBLE * (target - lag_28 * 2.2::DOUBLE), (0.95::DOUBLE - 1) * (target - lag_28 * 2.2::DOUBLE))) AS loss
    FROM targets CROSS JOIN ends WHERE end_d - d IN (28, 56, 84) GROUP BY ALL) GROUP BY fold)""")
oracle("backtest_indicators", "scored hist", f"""
SELECT s.store_id, s.item_id,
  {r("100.0::DOUBLE * sum(CASE WHEN kind = 'backtest' THEN CASE WHEN actual BETWEEN b1 AND b7 THEN 1.0 ELSE 0.0 END END) / 28", 'capture_rate')},
  {r("avg(CASE WHEN kind = 'backtest' THEN abs(actual - b4) END)", 'backtest_mae')},
  {r("avg(CASE WHEN kind = 'forecast' THEN b7 - b1 END)", 'width_95')}, {r('max(x.m)', 'avg_history')}
FROM scored s JOIN (SELECT store_id, item_id, avg(sales) AS m FROM hist GROUP BY ALL) x
ON x.store_id = s.store_id AND x.item_id = s.item_id GROUP BY s.store_id, s.item_id""")
oracle("percentile_panel", "wide", f"""
SELECT store_id, item_id, {r('sum(b4)', 'p50_28d')}, {r('sum(b5)', 'p75_28d')}, {r('sum(b7)', 'p95_28d')},
  {r('sum(b8)', 'p99_28d')}, {r('sum(CASE WHEN h = 1 THEN b4 END)', 'p50_next_day')},
  {r('sum(CASE WHEN h <= 7 THEN b4 END)', 'p50_7d')}, {r('sum(CASE WHEN h = 1 THEN b7 END)', 'p95_next_day')},
  {r('sum(CASE WHEN h <= 7 THEN b7 END)', 'p95_7d')}, {r('greatest(sum(b7) - sum(b4), 0.0)', 'safety_stock')}
FROM wide WHERE kind = 'forecast' GROUP BY store_id, item_id""")
oracle("interval_bounds", "scored", f"""
SELECT store_id, item_id, kind, h, {r('b4', 'median')}, {r('b0', 'lo_99')}, {r('b8', 'hi_99')}, {r('b1', 'lo_95')},
  {r('b7', 'hi_95')}, {r('b2', 'lo_67')}, {r('b6', 'hi_67')}, {r('b3', 'lo_50')}, {r('b5', 'hi_50')},
  {r('b7 - b1', 'width_95')}, {r('actual - b4', 'residual')} FROM scored""")
cte("board", "profiles daily feat", f"""
  SELECT p.item_id, {_prof}, k.store_id, k.dept_id, {product_sql('p.item_id')} AS product_name
  FROM (SELECT * FROM profiles ORDER BY "Popularity" DESC, item_id LIMIT 500) p
  JOIN (SELECT DISTINCT item_id, store_id, dept_id FROM daily) k ON k.item_id = p.item_id
  WHERE (k.store_id, p.item_id) IN (SELECT (store_id, item_id) FROM feat)""")
oracle("leaderboard", "board", "SELECT * FROM board")
oracle("leaderboard_search", "board", """
SELECT * FROM board WHERE store_id = 'EUROPE' AND (contains(lower(product_name), 'saver') OR contains(lower(item_id), 'saver'))""")
oracle("submission_table", "daily anchors", "SELECT k.item_id || '_' || k.store_id || '_' || x.suffix AS id, " + ", ".join(
    f"CASE WHEN x.suffix = 'validation' AND k.store_id IN ('AFRICA', 'ASIA', 'EUROPE') THEN round(coalesce(a.lag_28, 0) + 1e-9, 6) "
    f'ELSE 0.0::DOUBLE END AS "F{i}"' for i in range(1, 29)) + """
FROM (SELECT DISTINCT item_id, store_id FROM daily) k CROSS JOIN (SELECT unnest(['validation', 'evaluation']) AS suffix) x
LEFT JOIN anchors a ON a.store_id = k.store_id AND a.item_id = k.item_id AND a.kind = 'forecast'""")

oracle("fixed_tree_scores", "feat", f"""
SELECT {KEY}, {r("greatest(0.0, 1.5 + 0.5 * (CASE WHEN coalesce(lag_28, -1) <= 3 THEN -4 ELSE 6 END"
                 " + CASE WHEN coalesce(wday, -1) <= 2 THEN 1 ELSE -1 END))", 'first')},
  {r("4.0 + CASE WHEN coalesce(sell_price, -1) <= 1000 THEN 0.25 ELSE 2.5 END", 'second')} FROM feat""")
_w = "CASE WHEN y > f THEN 1.05 ELSE 1.0 END"
_g = "(y * exp(-0.15 * f) - exp(0.85 * f))"
_c = "(0.15 * y * exp(-0.15 * f) + 0.85 * exp(0.85 * f))"
cte("scored", "feat", "SELECT store_id, CAST(sales AS DOUBLE) AS y, CAST(lag_28 AS DOUBLE) * 0.05::DOUBLE AS f FROM feat")
oracle("loss_terms", "scored", "\nUNION ALL ".join(
    f"SELECT store_id, {r(start, 'start')}, {r(f'avg({gradient})', 'gradient')}, {r(step, 'step')}, "
    f"{r(f'avg({loss})', 'loss')}, '{name}' AS name FROM scored GROUP BY store_id"
    for name, start, gradient, step, loss in (
        ("squared", "avg(y)", "2.0 * (y - f)", "avg(y - f)", "(y - f) * (y - f)"),
        ("asymmetric", "avg(y)", f"2.0 * {_w} * (y - f)", f"sum({_w} * (y - f)) / sum({_w})",
         f"{_w} * (y - f) * (y - f)"),
        ("tweedie", "ln(greatest(avg(y), 1e-6))", _g, f"sum({_g}) / sum({_c})",
         "y * exp(-0.15 * f) / 0.15 + exp(0.85 * f) / 0.85"))))
oracle("mapping_file", "daily", code_union("daily"))
oracle("leaderboard_file", "profiles", f"SELECT item_id, {_prof}, 'ASIA' AS store_id FROM profiles")
oracle("store_refresh_flags", "feat", """
SELECT count(*) AS series, true AS first, false AS again, true AS forced, true AS newer
FROM (SELECT DISTINCT store_id, item_id FROM feat)""")
oracle("training_file", "targets", """
SELECT horizon_day, count(*) AS n, sum(target) AS target_sum, CAST(sum(target_wday) AS BIGINT) AS weekdays
FROM targets GROUP BY horizon_day""")


oracle("product_file", "daily", f"""
SELECT item_id, {product_sql('item_id')} AS product_name, {product_sql('item_id')} AS name_in_csv,
  CAST(sum(sales) AS BIGINT) AS units FROM daily GROUP BY item_id""")
oracle("submission_file", "daily anchors", "SELECT k.item_id || '_' || k.store_id || '_' || x.suffix AS id, " + ", ".join(
    f"CASE WHEN x.suffix = 'validation' THEN round(coalesce(a.lag_28, 0) + 1e-9, 6) ELSE 0.0::DOUBLE END AS \"F{i}\""
    for i in range(1, 29)) + """
FROM (SELECT DISTINCT item_id, store_id FROM daily) k CROSS JOIN (SELECT unnest(['validation', 'evaluation']) AS suffix) x
LEFT JOIN anchors a ON a.store_id = k.store_id AND a.item_id = k.item_id AND a.kind = 'forecast'""")
oracle("dataset_versions", "daily", """
SELECT store_id, count(*) + count(*) FILTER (d % 2 = 0) AS n, 16 AS digits, true AS same, true AS grown
FROM daily GROUP BY store_id""")
cte("v1_rows", "ext", f"""
  SELECT *, row_number() OVER {W} AS rn, sell_price / top AS price_norm
  FROM (SELECT *, max(sell_price) OVER ({P}) AS top FROM ext) WHERE roll_mean_28 IS NOT NULL""")
cte("v1_coded", "v1_rows", "SELECT *, count(*) OVER (PARTITION BY store_id, item_id) AS n_rows, " + ", ".join(
    f"dense_rank() OVER (ORDER BY {c}) - 1 AS code_{c}" for c in CATEGORY_COLUMNS) + " FROM v1_rows")
# a row has the horizons up to the number of rows after it, so the first h rows of a series are targets of none
oracle("horizon_v1_vectors", "v1_coded", f"""
SELECT store_id, item_id, CAST(h AS INTEGER) AS h, count(*) FILTER (rn + h <= n_rows) AS n,
  sum(sales) FILTER (rn > h)::DOUBLE AS target, """ + ", ".join(
    r((f"avg(code_{c})" if c in CATEGORY_COLUMNS else "avg(h)" if c == "horizon_day" else f'avg("{c}"::DOUBLE)')
      + " FILTER (rn + h <= n_rows)", f'"x_{c}"') for c in LEGACY_HORIZON_COLUMNS) + """
FROM v1_coded CROSS JOIN (SELECT unnest(range(1, 29)) AS h) GROUP BY store_id, item_id, h
HAVING count(*) FILTER (rn + h <= n_rows) > 0""")
