"""Category codes and training weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.operators.ranking import numbered
from shelfcast.sources.schemas import CATEGORY_COLUMNS

BROADCAST_CODES = 200_000


def weekday_mapping(spark) -> DataFrame:
    """Weekdays 1..7 map to 0..6."""
    return spark.range(1, 8).select(
        F.lit("target_wday").alias("column"), F.col("id").cast("string").alias("value"),
        (F.col("id") - 1).cast("int").alias("code"))


def build_mapping(df: DataFrame, columns: list[str] = CATEGORY_COLUMNS) -> DataFrame:
    """(column, value, code): 0-based codes of the non-null values in alphabetical order.

    All columns are deduplicated in one pass and numbered together; a code is the position
    after its column's first value.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    pairs = df.select(F.inline(cells)).dropna(subset=["value"]).distinct()
    keyed = pairs.withColumn("_key", F.concat("column", F.lit("\u0001"), "value"))
    return _codes(keyed)


def _codes(keyed: DataFrame) -> DataFrame:
    ranked = numbered(keyed, "_key", "_rn")
    first = ranked.groupBy("column").agg(F.min("_rn").alias("_first"))
    return ranked.join(first, "column").select(
        "column", "value", (F.col("_rn") - F.col("_first")).cast("int").alias("code"))


def encode(df: DataFrame, mapping: DataFrame, columns: list[str] = CATEGORY_COLUMNS,
           unseen: str = "zero", suffix: str = "_code",
           sizes: dict[str, int] | None = None) -> DataFrame:
    """Add each column's code.

    With known `sizes` a mapping of up to BROADCAST_CODES values is broadcast and the rows stay
    where they are; a larger one, or one of unknown size, is left to the join planner.

    `unseen` decides what a value outside the mapping gets: "zero" (collides with the first
    value, as served models expect), "new" (one past the last code) or "null".
    """
    for c in columns:
        codes = mapping.filter(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code"))
        if sizes is not None and sizes.get(c, 0) <= BROADCAST_CODES:
            codes = F.broadcast(codes)
        df = df.join(codes, F.trim(F.col(c).cast("string")) == F.col("_value"), "left")
        if unseen == "zero":
            value = F.coalesce("_code", F.lit(0))
        elif unseen == "new":
            value = F.coalesce(F.col("_code"), F.lit(
                codes.agg(F.coalesce(F.max("_code") + 1, F.lit(0))).first()[0]))
        else:
            value = F.col("_code")
        df = df.withColumn(c + suffix, value).drop("_value", "_code")
    return df


def sample_weight(weight: str = "weight", scale: str = "scale_factor"):
    return F.sqrt(F.col(weight) / (F.col(scale) + 1))


def with_default_weights(df: DataFrame) -> DataFrame:
    """Weight and scale of 1 where the table brings none."""
    missing = {c: F.lit(1.0) for c in ("weight", "scale_factor") if c not in df.columns}
    return df.withColumns(missing) if missing else df


def category_sizes(mapping: DataFrame) -> dict[str, int]:
    """Number of codes per column."""
    return {r["column"]: r["n"] for r in mapping.groupBy("column").agg(
        (F.max("code") + 1).alias("n")).collect()}
