"""Item leaderboard with stores, product names and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.scalars import contains_text
from shelfcast.operators.lookup import attach_product_names, keep_available
from shelfcast.operators.reshape import repeat_stores
from shelfcast.sources.schemas import RETAIL_STORES


def head_items(profiles: DataFrame, n: int = 500) -> DataFrame:
    """The n most popular items; the limit comes before stores are attached."""
    return profiles.orderBy(F.col("Popularity").desc(), "item_id").limit(n)


def attach_stores(items: DataFrame, features: DataFrame | None,
                  stores: list[str] = RETAIL_STORES) -> DataFrame:
    """One row per item and store that sells it.

    Without a feature table, or when it knows none of the items, every item is listed at every
    store of the given list.
    """
    if "store_id" in items.columns:
        return items
    if features is None:
        return repeat_stores(items, stores)
    known = features.select("item_id", "store_id", "dept_id").distinct()
    joined = items.join(known, "item_id", "left")
    nothing = joined.select(F.count("store_id") == 0).scalar()
    choice = F.when(nothing, F.array(*[F.lit(s) for s in stores])).otherwise(F.array("store_id"))
    rest = [c for c in joined.columns if c != "store_id"]
    return joined.select(*rest, F.explode(choice).alias("store_id"))


def leaderboard(profiles: DataFrame, features: DataFrame | None, products: DataFrame,
                available: DataFrame | None = None, n: int = 500,
                stores: list[str] = RETAIL_STORES) -> DataFrame:
    """Top items, their stores, names, "N/A" for missing text, limited to what can be served."""
    board = attach_product_names(attach_stores(head_items(profiles, n), features, stores),
                                 products)
    text = [f.name for f in board.schema.fields if f.dataType.simpleString() == "string"]
    board = board.fillna("N/A", subset=text)
    return keep_available(board, available) if available is not None else board


def search(board: DataFrame, store: str, query: str = "") -> DataFrame:
    """A store's rows whose name or id contains the text."""
    rows = board.filter(F.col("store_id") == store)
    return rows.filter(contains_text(query, "product_name", "item_id")) if query else rows
