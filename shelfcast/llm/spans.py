"""Places of pattern matches in whole texts, with SQL functions only.

``split`` and ``regexp_extract_all`` see the same leftmost, non-overlapping matches, so the text
between matches and the matches themselves, added up in order, give every place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.llm.common import stored

CONTEXT = 32


def _pieces(kind: str, pattern: str, matches: Column, text: Column) -> Column:
    """Per match: kind, its number, length of the text since the match before, match, and the
    text on both sides."""
    parts = F.split(text, pattern, -1)
    rows = F.arrays_zip(
        F.sequence(F.lit(0), F.size(matches) - 1).alias("nth"), matches.alias("match"),
        F.slice(parts, 1, F.size(matches)).alias("gap"),
        F.slice(parts, 2, F.size(matches)).alias("next"))
    return F.transform(rows, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["nth"].alias("nth"), F.length(x["gap"]).alias("gap"),
        x["match"].alias("match"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"),
        F.left(x["next"], F.lit(CONTEXT)).alias("right")))


NOTHING = ("array<struct<kind:string,nth:int,gap:int,match:string,left:string,right:string>>")


def find(docs: DataFrame, patterns: dict[str, tuple[str, Column | None]], id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """(row, doc_id, found): one row per document row with all its matches, written once.

    ``patterns`` maps a kind to its pattern and a cheap condition without which it can't match.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    nothing = F.array().cast("array<string>")
    rows = rows.select("*", *[
        (F.when(may(F.col("text")), F.regexp_extract_all("text", F.lit(p), F.lit(0)))
         .otherwise(nothing) if may is not None
         else F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{kind}")
        for kind, (p, may) in patterns.items()])
    parts = [F.when(F.size(f"m_{kind}") > 0, _pieces(kind, p, F.col(f"m_{kind}"), F.col("text")))
             .otherwise(F.array().cast(NOTHING)) for kind, (p, _) in patterns.items()]
    return stored(rows.select("row", "doc_id", F.concat(*parts).alias("found")), "spans")


def located(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, left, right), code points, end exclusive."""
    one = found.select("row", F.explode("found").alias("x")).select("row", "x.*")
    line = Window.partitionBy("row", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("match")).over(line)
    return one.withColumn("end", end).select(
        "row", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "left",
        "right")


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, for an ordered array of (…, kind, start, end)."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution, by a logistic form good to 2e-4."""
    a = F.abs(z)
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))
