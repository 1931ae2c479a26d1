"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SINGLE_TASK_ROWS = 100_000   # up to this many rows one task may sort
SAMPLE_PER_BUCKET = 40
ROWS_PER_PART = 1_000_000    # larger tables are cut into parts of about this size


def split_points(df: DataFrame, key: str, rows: int, buckets: int) -> list:
    """Key values that cut the table into about equal parts, from a hash-chosen sample."""
    stride = max(1, rows // (buckets * SAMPLE_PER_BUCKET))
    sample = [r[0] for r in df.filter(F.pmod(F.xxhash64(key), F.lit(stride)) == 0)
              .select(key).orderBy(key).collect()]
    if len(sample) <= buckets:
        return sample
    step = len(sample) / buckets
    return [sample[int(i * step)] for i in range(1, buckets)]


def numbered(df: DataFrame, key: str, out: str = "rn", buckets: int | None = None,
             single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Add the 1-based position of each row in ascending order of a unique key.

    Large tables are cut at sampled key values: rows are numbered inside each part and shifted
    by the sizes of the parts before it.  Any cut gives the same numbers; the sample only
    balances the work.
    """
    rows = df.count()
    if rows <= single_task_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)))
    buckets = buckets or max(64, -(-rows // ROWS_PER_PART))
    points = F.array(*[F.lit(p) for p in split_points(df, key, rows, buckets)])
    part: Column = F.size(F.filter(points, lambda p: p <= F.col(key)))
    tagged = df.withColumn("_part", part)
    sizes = tagged.groupBy("_part").count()
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return tagged.withColumn("_inside", inside).join(offsets, "_part").withColumn(
        out, (F.col("_inside") + F.col("_offset")).cast("long")
    ).drop("_part", "_inside", "_offset")


def sample_ids(df: DataFrame, key: str, share: float, seed: int = 42,
               single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """A fixed share of the distinct ids, without replacement, chosen by seeded hash order."""
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(
        "_order", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))))
    wanted = ids.agg(F.floor(F.count(F.lit(1)) * share).alias("wanted")).scalar()
    ranked = numbered(ids, "_order", "_rn", single_task_rows=single_task_rows)
    return ranked.filter(F.col("_rn") <= wanted).select(key)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """The k first rows of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def last_rows(df: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The newest n rows of each series."""
    keys = keys or ["store_id", "item_id"]
    return top_per_group(df, keys, [F.col("d").desc()], n, "_newest").drop("_newest")


def day_ranks(df: DataFrame, day: str = "d", out: str = "day_rank") -> DataFrame:
    """Dense rank of the distinct days of a forecast window (a few dozen rows)."""
    return df.select(day).distinct().withColumn(
        out, F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(day)))
