"""Submission table: predictions laid out as F1..F28 over a template."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.scalars import series_key
from shelfcast.operators.lookup import update_template
from shelfcast.operators.ranking import day_ranks
from shelfcast.operators.reshape import pivot_ranked_days


def submission(predicted: DataFrame, template: DataFrame, value: str = "yhat",
               suffix: str = "validation", width: int = 28) -> DataFrame:
    """Template with the predicted series filled in; all its other rows unchanged."""
    rows = predicted.select(series_key("item_id", "store_id", suffix).alias("id"), "d", value)
    wide = pivot_ranked_days(rows, day_ranks(rows), "id", value, width)
    return update_template(template, wide, "id", [f"F{i}" for i in range(1, width + 1)])
