"""Row-level expressions.  Everything here is a Column built from JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day_index(col) -> Column:
    """'d_12' -> 12."""
    return F.regexp_replace(_c(col), "^d_", "").cast("int")


def target_weekday(wday, horizon) -> Column:
    """Weekday 1..7 that lies `horizon` days after weekday `wday`."""
    h = F.lit(horizon) if isinstance(horizon, int) else _c(horizon)
    return ((_c(wday) + h - 1) % 7 + 1).cast("int")


def cyclic_step(d, horizon: int = 28) -> Column:
    """Day index folded onto 1..horizon."""
    return ((_c(d) - 1) % horizon + 1).cast("int")


def is_weekend(wday) -> Column:
    """Weekdays 1 and 2 are Saturday and Sunday."""
    return _c(wday).isin(1, 2).cast("int")


def has_event(name) -> Column:
    return _c(name).isNotNull().cast("int")


def snap_active(state, by_state: dict[str, str] | None = None) -> Column:
    """Benefit-day flag of the row's own state; 0 for states without a column."""
    by_state = by_state or {"CA": "snap_CA", "TX": "snap_TX", "WI": "snap_WI"}
    picked = F.lit(None).cast("int")
    for value, column in by_state.items():
        picked = F.coalesce(picked, F.when(_c(state) == value, F.col(column)))
    known = _c(state).isin(*by_state)
    return F.when(known, picked).otherwise(0).cast("int")


def series_key(item, store, suffix: str = "") -> Column:
    """'ITEM_STORE' with an optional '_suffix'."""
    parts = [_c(item), _c(store)] + ([F.lit(suffix)] if suffix else [])
    return F.concat_ws("_", *parts)


def product_name(item, brands: list[str], names: dict[str, list[str]],
                 default: list[str]) -> Column:
    """Display name picked by the number at the end of the item id.

    `names` maps a fragment of the item id to its list; other items use `default`.  Ids without
    a trailing number fall back to a hash of the id in 1..99.
    """
    number = F.coalesce(
        F.expr(f"try_cast(element_at(split({item}, '_'), -1) as int)"),
        F.pmod(F.xxhash64(F.col(item)), F.lit(99)).cast("int") + 1,
    )

    def pick(values: list[str]) -> Column:
        words = F.array(*[F.lit(v) for v in values])
        return F.element_at(words, (F.pmod(number, F.lit(len(values))) + 1).cast("int"))

    noun = None
    for fragment, values in names.items():
        hit = F.col(item).contains(fragment)
        noun = F.when(hit, pick(values)) if noun is None else noun.when(hit, pick(values))
    noun = pick(default) if noun is None else noun.otherwise(pick(default))
    return F.concat_ws(" ", pick(brands), noun)


def pattern_caption(volume, volatility, sparsity) -> Column:
    """'Volume 1,234 · CV 1.20 · 85% zero days', leaving out what is missing."""
    def known(c):
        return _c(c).isNotNull() & ~F.isnan(_c(c))
    return F.concat_ws(
        " · ",
        F.when(known(volume), F.concat(F.lit("Volume "), F.format_number(_c(volume), 0))),
        F.when(known(volatility), F.concat(F.lit("CV "), F.format_string("%.2f", _c(volatility)))),
        F.when(known(sparsity),
               F.concat(F.format_string("%.0f", _c(sparsity)), F.lit("% zero days"))),
    )


def units(value) -> Column:
    """Thousands separators; no decimals from 100 up, one below; a dash for a missing value."""
    v = _c(value)
    return (
        F.when(v.isNull() | F.isnan(v), F.lit("—"))
        .when(F.abs(v) >= 100, F.format_number(v, 0))
        .otherwise(F.format_number(v, 1))
    )


def clamp_zero(value) -> Column:
    return F.greatest(F.lit(0.0), _c(value))


def pad_history(history, length: int) -> Column:
    """Exactly `length` values: the newest ones, zero-filled on the left."""
    filled = F.concat(F.array_repeat(F.lit(0.0), length), _c(history))
    return F.slice(filled, -length, length)


def tail_mean(history, start: int, stop: int) -> Column:
    """Mean of the values between `start` and `stop` counted from the end; null when empty.

    tail_mean(h, 35, 28) averages the seven values that end 28 before the newest.
    """
    h = _c(history)
    n = F.size(h)
    first = F.greatest(n - start, F.lit(0))
    length = F.greatest(n - stop - first, F.lit(0))
    part = F.slice(h, first + 1, length)
    total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(length > 0, total / length)


def finite_or_zero(value) -> Column:
    """Null, NaN and infinities become 0."""
    v = _c(value).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def contains_text(query: str, *columns: str) -> Column:
    """Case-insensitive literal search in any of the columns."""
    needle = query.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False))
    return hit
