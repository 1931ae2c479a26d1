"""Readers.  Paths may be local or on an object store; credentials live in the Hadoop conf."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfcast.functions.scalars import day_index
from shelfcast.sources import schemas


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, from its first line alone."""
    row = spark.read.text(path).first()
    return next(csv.reader([row[0]])) if row else []


def read_csv(spark: SparkSession, path: str, layout: T.StructType,
             optional: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the layout by their name in the header, wherever they stand.

    A cell that doesn't parse stops the job, and so does a missing column unless it is optional.
    """
    header = csv_header(spark, path)
    missing = [f.name for f in layout.fields if f.name not in header and f.name not in optional]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    types = {f.name: f.dataType for f in layout.fields}
    own = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    raw = spark.read.schema(own).csv(
        path, header=True, mode="FAILFAST", maxColumns=max(len(header), 1) + 1)
    return raw.select(*[c for c in layout.fieldNames() if c in header])


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar by integer day; only the columns the file has and the jobs use are kept."""
    names = tuple(schemas.CALENDAR.fieldNames())
    return read_csv(spark, path, schemas.CALENDAR, optional=tuple(
        c for c in names if c != "d")).withColumn("d", day_index("d"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PRICES)


def read_wide_sales(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.wide_sales_schema(csv_header(spark, path)))


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None,
                  stores: list[str] | None = None, first_day: int | None = None,
                  last_day: int | None = None) -> DataFrame:
    """Feature table; store filters prune folders, day filters reach the Parquet footer."""
    df = spark.read.parquet(path)
    if stores is not None:
        df = df.filter(F.col("store_id").isin(stores))
    if first_day is not None:
        df = df.filter(F.col("d") >= first_day)
    if last_day is not None:
        df = df.filter(F.col("d") <= last_day)
    return df.select(*columns) if columns else df


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MAPPING).json(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product names from JSON lines or, by suffix, from CSV."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schemas.PRODUCTS)
    return spark.read.schema(schemas.PRODUCTS).json(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Ranked items; the file may name a store for each."""
    return read_csv(spark, path, schemas.LEADERBOARD, optional=("store_id",))


def read_band_scales(spark: SparkSession, path: str) -> list[float]:
    """Calibrated scale of each forecast day, from one JSON object that maps "1", "2", ... to it."""
    row = spark.read.json(path, multiLine=True).first()
    scales = {int(k): float(v) for k, v in (row.asDict() if row else {}).items()}
    return [scales[h] for h in sorted(scales)]


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """16 hex digits over path, size and modification time of every file below the paths.

    The binary reader lists files without opening them, and the per-file hashes are combined by
    order-free aggregates, so nothing is sorted or gathered.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    fact = F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))
    summary = files.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(fact)).alias("x"),
        F.bit_xor(F.xxhash64(F.reverse(fact))).alias("y"))
    return summary.select(F.substring(F.sha2(F.concat_ws(
        "|", "n", F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))), 256), 1, 16)).first()[0]
