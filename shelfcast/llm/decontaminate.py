"""Benchmark decontamination with a positional inverted index.

The index holds, for every term of the benchmark, its postings (document, position) in all
documents.  Each phrase is looked up by its rarest term; a posting of it fixes the diagonal
(position in the document minus position in the item) on which the phrase would lie.  The lists of
the item's terms around that place are shifted to that diagonal and intersected; unbroken runs of at
least a phrase are exact matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.llm.common import ascii_lower, stored

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_TERMS = 500_000
CELL = 128          # places of an item that are looked up together, at least
END = ""            # the posting of this term is a document's number of words


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def item_terms(benchmark: DataFrame, id_column: str = "item_id",
               text_column: str = "text") -> DataFrame:
    """(item, item_id, at, term, size): the words of each benchmark row with their places."""
    rows = benchmark.select(
        F.monotonically_increasing_id().alias("item"),
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item_id"),
        terms_of(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("words"))
    return rows.select("item", "item_id", F.size("words").alias("size"),
                       F.posexplode("words").alias("at", "term"))


def sent_if_small(rows: DataFrame) -> DataFrame:
    """Sent to every task if its counted rows are few, else joined by a shuffle."""
    return rows if rows.count() > BROADCAST_TERMS else F.broadcast(rows)


def build_index(docs: DataFrame, vocabulary: DataFrame, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """Postings (term_id, row, doc_id, pos) of the vocabulary's terms in all rows, written to the
    shared folder.  Each row also posts its number of words under the term id -1."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    found = rows.select("row", "doc_id", F.posexplode(
        F.concat(terms_of(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    return stored(found.join(sent_if_small(vocabulary), "term").select("term_id", "row", "doc_id", "pos"), "postings")


def phrase_hits(index: DataFrame, items: DataFrame, words: int = 13) -> DataFrame:
    """(row, item_id, first, last): the stretches of document words, inclusive, in which a phrase
    of ``words`` consecutive item words, or a whole shorter item, occurs."""
    # the rarest term of each phrase; phrases with a term that no document holds can't occur
    df = index.filter("term_id >= 0").groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    known = items.join(df, "term_id", "left")
    phrase = Window.partitionBy("item").orderBy("at").rowsBetween(
        Window.currentRow, words - 1)
    heads = known.withColumn("terms", F.collect_list(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), F.col("at"), F.col("term_id"))).over(phrase))
    heads = heads.filter(F.size("terms") == F.least(F.lit(words), F.col("size")))
    heads = heads.withColumn("rarest", F.array_min("terms")).filter("rarest.n > 0")
    anchors = stored(heads.select(
        "item", F.col("rarest.at").alias("at"), F.col("rarest.term_id").alias("term_id")).distinct(),
        "anchors")
    # a phrase lies less than its length from its anchor: only cells of the item that reach there
    # are looked up, so that a posting costs the same in an item of any length
    width = max(CELL, words)
    cell = F.floor(F.col("at") / width)
    diagonals = index.join(sent_if_small(anchors), "term_id").select(
        "row", "item", (F.col("pos") - F.col("at")).alias("shift"), F.explode(F.sequence(
            F.floor(F.greatest(F.col("at") - (words - 1), F.lit(0)) / width),
            F.floor((F.col("at") + words - 1) / width))).alias("cell")).distinct()
    # the terms of these cells, moved to the diagonal, against the stored lists
    wanted = diagonals.join(items.withColumn("cell", cell), ["item", "cell"]).select(
        "row", "item", "item_id", "size", "shift", "at", "term_id",
        (F.col("at") + F.col("shift")).alias("pos")).filter("pos >= 0")
    met = wanted.join(index.select("row", "pos", "term_id"), ["row", "pos", "term_id"])
    line = Window.partitionBy("row", "item", "shift").orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy(
        "row", "item", "shift", "run").agg(
        F.first("item_id").alias("item_id"), F.first("size").alias("size"),
        F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.filter(
        F.col("last") - F.col("first") + 1 >= F.least(F.lit(words), F.col("size"))).select(
        "row", "item_id", "first", "last")


def proximity_hits(index: DataFrame, terms: DataFrame, within: int) -> DataFrame:
    """(row, query, pos): places where the rarest term of a query has all its other terms at most
    ``within`` words away.  ``terms`` holds (query, term_id)."""
    df = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    known = terms.distinct().join(df, "term_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = known.groupBy("query").agg(
        F.min(F.struct("n", "term_id")).alias("rarest"), F.count(F.lit(1)).alias("wanted"))
    start = index.join(per.select("query", "wanted", F.col("rarest.term_id").alias("term_id")),
                       "term_id").select("row", "query", "wanted", "pos")
    # postings meet in cells as wide as the reach, so that a join on equal cells finds them all
    cell = F.floor(F.col("pos") / within)
    near = start.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = index.join(known.select("query", "term_id"), "term_id").select(
        "row", "query", "term_id", cell.alias("cell"), F.col("pos").alias("other"))
    return near.join(other, ["row", "query", "cell"]).filter(
        F.abs(F.col("pos") - F.col("other")) <= within).groupBy("row", "query", "pos").agg(
        F.countDistinct("term_id").alias("met"), F.first("wanted").alias("wanted")).filter(
        "met = wanted").select("row", "query", "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 13, share: int = 20,
                  doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts document words inside any occurrence of a phrase; a row is contaminated when
    ``share * n_hit >= n_words`` and n_hit > 0.  Null and empty texts have no words.  Null ids are
    kept, and rows that repeat an id are judged each for itself; items that share an id count
    once, null item ids as the empty string; an empty benchmark marks nothing; other columns are
    not read.
    """
    spark = docs.sparkSession
    raw = stored(item_terms(benchmark, item_id, item_text), "items")
    vocabulary = stored(raw.select("term").distinct().withColumn(
        "term_id", F.monotonically_increasing_id()).unionByName(
        spark.createDataFrame([(END, -1)], "term string, term_id long")), "terms")
    index = build_index(docs, vocabulary, doc_id, doc_text)
    items = raw.join(vocabulary, "term").select("item", "item_id", "size", "at", "term_id")
    hits = phrase_hits(index, items, words)
    # the union of the stretches: each adds what lies beyond the furthest end before it
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(
        Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(
        F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))))
    per_row = hits.select("row", "first", "last").distinct().withColumn("new", new).groupBy(
        "row").agg(F.sum("new").alias("n_hit"))
    per_item = hits.select("row", "item_id").groupBy("row").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    found = per_row.join(per_item, "row")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return index.filter("term_id = -1").select(
        "row", "doc_id", F.col("pos").cast("long").alias("n_words")).join(
        found, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
