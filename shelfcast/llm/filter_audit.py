"""How filters interact: what each removes in every order of applying them.

A document is the set of filters it fails, a mask.  Per part of the corpus, documents with equal masks
are one cell with its counts, and there are at most 2^k cells for k filters.  The survivors of every set
of filters come from one Gray-code walk: consecutive sets differ by one filter, so a step changes only
the cells that fail it, whose counters of active failures say when they leave or return.  With all 2^k
states stored, a step of any order is the difference of two of them.

Defined results: null text is empty, and so equal to other empty texts; a null lang is the part "".
Documents without labels are neither good nor toxic; of several labels of one document any may
make it so.  A row that repeats a document counts again; as only a smaller id makes a text a copy,
rows with one id and text are no copies of each other.  A null doc_id is larger than any other id.  Texts are
compared by 128-bit digests.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfcast.llm.common import stored

NAMES = "ABCDE"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))      # bytes of a code point after its first
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 18
BATCH = "4m"                              # bytes of texts that a task hands to Python at once
COPY = 1 << NAMES.index("E")
MEASURED = "doc_id long, part string, mask int, digest binary"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def pieces(text) -> Iterator[bytes]:
    """The bytes of a text in pieces of about PIECE, cut at white space, so no word is parted."""
    view, begin = memoryview(text), 0
    while begin < len(view):
        space = SPACE.search(view, begin + PIECE)
        end = space.start() if space else len(view)
        yield bytes(view[begin:end])
        begin = end


def text_mask(text) -> int:
    """Failures of the filters A to D, which look at one text alone.  Of a long text only its distinct
    words and one piece are held."""
    n_words, distinct, upper, points, symbols = 0, set(), 0, 0, False
    for piece in pieces(text):
        words = piece.split()
        n_words += len(words)
        distinct.update(words)
        upper += len(piece) - len(piece.translate(None, UPPER))
        points += len(piece.translate(None, CONTINUED))
        symbols = symbols or len(piece.translate(None, SYMBOLS)) < len(piece)
    fails = (n_words < 200, 100 * len(distinct) < 50 * n_words, 100 * upper > 3 * points, symbols)
    return sum(fail << i for i, fail in enumerate(fails))


def measure(batches):
    """Texts are read where they lie in the batch, one after the other."""
    for batch in batches:
        masked, digests = [], []
        for text in batch.column(2):
            data = text.as_buffer()
            masked.append(text_mask(data))
            digests.append(hashlib.blake2b(data, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masked, pa.int32()), pa.array(digests, pa.binary())],
            ["doc_id", "part", "mask", "digest"])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document part, mask of failed filters, good and toxic (0 or 1).

    The least id of each text is an aggregate; whether a row has it is looked up by text and id
    together, so a text with millions of copies is no hot key.
    """
    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    ).mapInArrow(measure, MEASURED), "filter-masks", BATCH)
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    # a null id is a first text only among null ids, where the least id is null as well
    a, b = rows.alias("a"), least.alias("b")
    met = a.join(b, F.col("a.digest").eqNullSafe(F.col("b.digest"))
                 & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left").select(
        "a.doc_id", "a.part", (F.col("a.mask") + F.when(F.col("b.first"), 0).otherwise(COPY)).alias("mask"))
    return met.join(marks, "doc_id", "left").select(
        "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def survivors(cells: list[tuple[int, tuple[int, ...]]], k: int) -> list[tuple[int, ...]]:
    """Counts that survive each of the 2^k sets of filters, by Gray-code walk over (mask, counts)."""
    width = len(cells[0][1]) if cells else 0
    failing = [0] * len(cells)
    holders = [[i for i, (mask, _) in enumerate(cells) if mask >> f & 1] for f in range(k)]
    now = [sum(counts[j] for _, counts in cells) for j in range(width)]
    states: list[tuple[int, ...]] = [()] * (1 << k)
    states[0] = tuple(now)
    active = 0
    for step in range(1, 1 << k):
        f = (step & -step).bit_length() - 1
        active ^= 1 << f
        on = active >> f & 1
        for i in holders[f]:
            if on:
                failing[i] += 1
            leaves, returns = on and failing[i] == 1, not on and failing[i] == 1
            if not on:
                failing[i] -= 1
            if leaves or returns:
                sign = -1 if leaves else 1
                for j in range(width):
                    now[j] += sign * cells[i][1][j]
        states[active] = tuple(now)
    return states


def audit_part(cells: list[tuple[int, tuple[int, int, int]]], names: str = NAMES) -> list[tuple]:
    """Rows (order, step, counts) of one part's cells (mask, (documents, good, toxic))."""
    k = len(names)
    states = survivors(cells, k)
    everything = states[0][0]
    sole = [sum(counts[0] for mask, counts in cells if mask == 1 << f) for f in range(k)]
    shapley = [sum(
        factorial(size) * factorial(k - 1 - size) * (states[s][0] - states[s | 1 << f][0])
        for s in range(1 << k) if not s >> f & 1 for size in [s.bit_count()]) for f in range(k)]
    out = []
    for order in permutations(range(k)):
        name, active = "".join(names[f] for f in order), 0
        for step, f in enumerate(order, 1):
            before, active = states[active], active | 1 << f
            after = states[active]
            removed = before[0] - after[0]
            failed = everything - states[1 << f][0]
            out.append((name, step, after[0], removed, failed - removed, sole[f],
                        before[1] - after[1], before[2] - after[2], shapley[f]))
    return out


def audit(failed: DataFrame, names: str = NAMES) -> DataFrame:
    """Every order and step per part, from rows (part, mask, good, toxic)."""
    cells = failed.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"),
        F.sum("toxic").cast("long").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = audit_part([(c["mask"], (c["n"], c["good"], c["toxic"])) for c in found], names)
                columns = [pa.array([part] * len(rows), pa.string()), *[
                    pa.array(c, t) for c, t in zip(
                        zip(*rows), [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)], strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS])
    return parts.mapInArrow(walk, AUDIT)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masks(docs, labels))
