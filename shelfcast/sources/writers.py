"""Sinks."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One partitioned write; a store folder is written by many tasks, not by one.

    Rows arrive hashed by series, so clustering each task by store first keeps one open file
    per store and task.
    """
    df.sortWithinPartitions("store_id", "item_id", "d").write.mode(mode) \
        .partitionBy("store_id").parquet(path)


def write_training_csv(df: DataFrame, path: str, features: list[str],
                       mode: str = "overwrite") -> None:
    """Target first, then the features, with a header in every part file."""
    df.select("target", *features).write.mode(mode).csv(path, header=True)


def write_mapping(mapping: DataFrame, path: str, mode: str = "overwrite") -> None:
    mapping.select("column", "value", "code").write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def _path(spark: SparkSession, path: str):
    """A Hadoop path and the file system that holds it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """True when a finished Spark output is at the path, whatever file system holds it."""
    done, files = _path(spark, path.rstrip("/") + "/_SUCCESS")
    return files.exists(done)


def place_if_missing(spark: SparkSession, path: str, write: Callable[[str], None],
                     last: str = "") -> None:
    """Have `write` fill a folder beside the path and rename it when it is complete, unless the path has
    its `last` table already.

    A job that died half-way is redone, and of two jobs that start together the second one takes the
    first one's tables.
    """
    if exists(spark, path + last):
        return
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    write(fresh)
    source, files = _path(spark, fresh)
    target, _ = _path(spark, path)
    if not exists(spark, path + last) and not files.rename(source, target) \
            and not exists(spark, path + last):
        raise RuntimeError(f"cannot put the table at {path}")


def build_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                     force: bool = False, write: Callable = write_features) -> DataFrame:
    """Read the table at the path; build and write it first when absent or forced."""
    if force:
        write(build(), path)
    else:
        place_if_missing(spark, path, lambda fresh: write(build(), fresh))
    return spark.read.parquet(path)
