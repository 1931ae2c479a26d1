"""The training-data pipeline: quality rules, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfcast.llm import decontaminate, near_duplicates, packing, quality, secrets_scan
from shelfcast.llm.common import stored, table

# Tokenising has no SQL form, so the rows of run() have none; a brute-force version is in the tests.
ORACLE_SQL = None
KEY = "__row_key"
MASK = "[SECRET]"


def row_key() -> Column:
    """Names a row by its id and text: rows that repeat both stay or go together."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed = docs.withColumn(KEY, row_key())
    judged = quality.judge_quality(keyed, id_column=KEY).filter("kept")
    return keyed.join(judged.select(F.col("doc_id").alias(KEY)), KEY, "left_semi").select(docs.columns)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    kept = near_duplicates.labelled(docs).filter("kept").select(
        F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (
        F.xxhash64("text") == F.col("__kept_key")), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages."""
    keyed = docs.withColumn(KEY, row_key())
    judged = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), doc_id=KEY)
    return keyed.join(judged.filter("contaminated").select(F.col("doc_id").alias(KEY)), KEY,
                      "left_anti").select(docs.columns)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, in order of start, replaced; spans that overlap become one."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.substring(
                text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit(MASK)).alias("out"))).otherwise(F.struct(
                    F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted anew."""
    keyed = docs.withColumn(KEY, row_key())
    found = secrets_scan.scan(keyed, id_column=KEY).filter(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias(KEY), F.col("spans").alias("__spans")).dropDuplicates([KEY])
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(
        masked(F.col("text"), F.col("__spans")))
    out = keyed.join(found, KEY, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(
            F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicate_documents),
    ("decontamination", decontaminated),
    ("secret scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again by the next.

    Null ids and texts pass through the stages as their operators define: without text a document
    has no words and goes with the quality rules.  Ties of equal documents keep the least id, rows
    that repeat an id and a text stay or go together, further columns are kept up to packing, and an
    empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
