"""Reading the corpus tables and writing intermediate tables to the shared folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfcast.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary; every executor has the package installed."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so extra columns can't clash; null text is empty."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def stored(df: DataFrame, name: str, batch_bytes: str | None = None) -> DataFrame:
    """Write a table once to the shared folder and read it back: later readers don't repeat the
    work, and a lost executor takes nothing with it.  The shuffle files of the write go when it ends; else
    they would lie on the disks until the driver collects its garbage.  `batch_bytes` bounds the batches
    that go to Python meanwhile; a longer row is a batch of its own."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {CLEANUP: spark.conf.get(CLEANUP, "false")}
    spark.conf.set(CLEANUP, "true")
    if batch_bytes:
        before[BATCH_BYTES] = spark.conf.get(BATCH_BYTES)
        spark.conf.set(BATCH_BYTES, batch_bytes)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
