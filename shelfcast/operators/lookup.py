"""Lookups and semi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.sources.schemas import SERIES


def attach_product_names(df: DataFrame, products: DataFrame) -> DataFrame:
    """Add product_name; items without one show their id."""
    return df.join(products.select("item_id", "product_name"), "item_id", "left").withColumn(
        "product_name", F.coalesce("product_name", "item_id"))


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    return df.join(ids, key, "left_semi")


def keep_available(df: DataFrame, available: DataFrame) -> DataFrame:
    """Rows whose (store, item) is in the feature store; all rows when the store has none of them.

    Whether any is known is a scalar subquery, so the choice is made at run time inside one plan.
    """
    pairs = available.select(*SERIES).distinct()
    known = df.select(*SERIES).join(pairs, list(SERIES), "left_semi")
    none = known.select(F.count(F.lit(1)) == 0).scalar()
    return df.join(pairs.withColumn("_known", F.lit(True)), list(SERIES), "left").filter(
        F.col("_known").isNotNull() | none).drop("_known")


def rows_at_day(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """The feature row of each requested (store, item, d)."""
    return features.join(wanted.select(*SERIES, "d"), [*SERIES, "d"])


def update_template(template: DataFrame, predicted: DataFrame, key: str,
                    columns: list[str]) -> DataFrame:
    """Template rows with predicted cells put over the template's; other cells stay."""
    new = predicted.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return template.join(new, key, "left").select(
        key, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).cast("double").alias(c)
               for c in columns])
