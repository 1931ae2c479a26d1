"""Packing by cutting-stock column generation.

Documents longer than a sequence are cut at multiples of its length.  The lengths of what is left
are counted in size classes; a linear program over cutting patterns decides how often each pattern
is used, and a knapsack by dynamic programming finds the pattern that improves it most.  The
rounded patterns then take the pieces of each class in ranked order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfcast.llm import tokens
from shelfcast.llm.common import id_and_text, stored, vocabulary

CAPACITY = 4096
STEP = 16
PIECES = "doc_id long, copy long, start long, length long, doc_tokens long, ids binary"


def pieces_of(docs: DataFrame, vocab: str, capacity: int) -> DataFrame:
    """Each document's ids, cut at multiples of the capacity.  ``copy`` tells apart rows that
    repeat an id."""

    def run(batches):
        rows: list[tuple] = []
        size = 0

        def out():
            columns = zip(*rows, strict=True)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in PIECES.split(", ")])

        def keyed():
            for batch in batches:
                keys.extend(batch.column(2).to_pylist())
                yield batch

        keys: list[int] = []
        for k, (doc_id, ids) in enumerate(tokens.encoded_batches(keyed(), vocab)):
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[4 * start:4 * (start + capacity)]
                # ids of a vocabulary below 65,536 travel as two bytes
                part = np.frombuffer(part, "<u4").astype("<u2").tobytes()
                rows.append((doc_id, keys[k], start, len(part) // 2, n, part))
                size += len(part)
            if size > 4_000_000:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return id_and_text(docs).withColumn("copy", F.monotonically_increasing_id()).mapInArrow(
        run, PIECES)


def best_pattern(values: np.ndarray, units: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack: counts of the classes 1..units with the largest value in ``units``."""
    best = np.zeros(units + 1)
    took = np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        gain = best[room - 1::-1][:room] + values[:room]     # class k+1 leaves room - k - 1
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], took[room] = gain[k], k + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(units, np.int64), units
    while room > 0:
        if took[room]:
            counts[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return counts, float(best[units])


def cutting_patterns(demand: np.ndarray, most_rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns over size classes 1..n (one class fills ``n`` units) and how often each is used.

    Column generation by the revised simplex method, from one pattern per class; then whole
    numbers: each use is rounded down and the rest is packed first-fit, largest class first.
    Every item of the demand is in exactly one pattern.
    """
    n = len(demand)
    basis = [np.eye(n, dtype=np.int64)[k] * (n // (k + 1)) for k in range(n)]
    inverse = np.diag([1.0 / (n // (k + 1)) for k in range(n)])
    # a little demand everywhere keeps the ratio test from stalling on empty classes
    use = inverse @ (demand + 1e-6 * (1 + np.arange(n) / n))
    for _ in range(most_rounds):
        price = inverse.sum(axis=0)
        pattern, value = best_pattern(price, n)
        if value <= 1 + 1e-7:
            break
        turn = inverse @ pattern
        ratio = np.where(turn > 1e-9, use / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        use = use - step * turn
        use[out] = step
        row = inverse[out] / turn[out]
        inverse = inverse - np.outer(turn, row)
        inverse[out] = row
        basis[out] = pattern
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for pattern, x in zip(basis, use, strict=True):
        whole = int(np.floor(max(x, 0) + 1e-4))
        held = pattern > 0
        if whole and held.any():
            whole = min(whole, int((left[held] // pattern[held]).min()))
        if whole:
            plan.append((pattern.copy(), whole))
            left -= whole * pattern
    # the rest holds less than one pattern's items per class of the basis
    rooms: list[int] = []
    bins: list[np.ndarray] = []
    for k in range(n - 1, -1, -1):
        for _ in range(int(left[k])):
            at = next((i for i, r in enumerate(rooms) if r >= k + 1), None)
            if at is None:
                rooms.append(n)
                bins.append(np.zeros(n, np.int64))
                at = len(rooms) - 1
            rooms[at] -= k + 1
            bins[at][k] += 1
    return plan + [(b, 1) for b in bins]


def slots(spark, plan: list[tuple[np.ndarray, int]], first: int = 0) -> DataFrame:
    """One row per pattern and class: the ranks it takes and where its sequences begin."""
    rows, taken, base = [], {}, first
    for pattern, uses in plan:
        slot = 0
        for k in np.flatnonzero(pattern).tolist():
            each = int(pattern[k])
            begin = taken.get(k + 1, 0)
            taken[k + 1] = begin + each * uses
            rows.append((k + 1, begin, taken[k + 1], each, base, slot))
            slot += each
        base += uses
    return spark.createDataFrame(
        rows, "class int, rank_from long, rank_to long, each long, base long, slot long")


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY,
         step: int = STEP) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids
    (little-endian unsigned 16-bit).

    A document is its ids and the end id; null text is empty and has the end id alone.  Each id is
    in exactly one piece.  A null doc_id is kept; rows that repeat an id are packed each for
    itself; equal lengths are ranked by a hash of the row.  An empty table gives an empty result.
    The lengths reach the driver as ``capacity / step`` counts only.  A vocabulary with ids beyond
    16 bits is refused.
    """
    vocab = vocab or vocabulary()
    if tokens.encoder(vocab).most_ids > 1 << 16:
        raise ValueError("ids of this vocabulary need more than 16 bits")
    pieces = stored(pieces_of(docs, vocab, capacity), "pieces")
    spark = pieces.sparkSession
    units = capacity // step
    narrow = pieces.select(
        "doc_id", "copy", "start", "length",
        F.ceil(F.col("length") / step).cast("int").alias("class"))

    # ranks inside a class: shares of it are ranked apart and moved by what the shares before
    # them hold, so a class with a third of all rows is spread over as many tasks as there are
    n_rows = narrow.count()
    shares = max(64, -(-n_rows // 100_000))
    shared = narrow.withColumn("share", F.pmod(F.xxhash64("doc_id", "copy", "start"),
                                               F.lit(shares)))
    counts = shared.groupBy("class", "share").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("class").orderBy("share")) - F.col("n"))
    demand = np.zeros(units)
    for k, n in counts.groupBy("class").agg(F.sum("n")).collect():     # at most ``units`` rows
        demand[k - 1] = n
    own = Window.partitionBy("class", "share").orderBy("doc_id", "copy", "start")
    ranked = shared.withColumn("own_rank", F.row_number().over(own) - 1).join(
        before.select("class", "share", "before"), ["class", "share"]).withColumn(
        "rank", F.col("own_rank") + F.col("before"))
    # a few rows per pattern: at most 2 * units patterns besides the last, small rest
    placed = ranked.join(
        F.broadcast(slots(spark, cutting_patterns(demand))),
        "class").filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    placed = placed.select(
        "doc_id", "copy", "start", "length",
        (F.col("base") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("slot") + nth % F.col("each")).alias("place"))
    line = Window.partitionBy("sequence_id").orderBy("place")
    placed = placed.select(
        "copy", "start", "sequence_id",
        (F.sum("length").over(line) - F.col("length")).alias("offset"))
    return pieces.join(placed, ["copy", "start"]).select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
