"""Product codes of vectors: k-means per part with adaptive distance bounds.

A vector becomes integers, is cut into equal parts, and each part is assigned to the nearest entry of its
part's codebook.  Rounds of assigning and moving the entries would compare every part with every
entry.  Instead each part keeps its `listed` closest entries in order, a lower bound of the distance to
each, and one outer bound for all others.  When entries move, a bound falls by what its entry moved,
the outer bound by the longest move.  The distance to the assigned entry is worked out exactly; only
entries whose bound doesn't exceed it are verified, in integers, and only a part whose outer bound
doesn't exceed the best verified distance is compared with all entries.  How many entries stay
listed adapts to how many were needed (`best_listed`).

Vectors lie in blocks of rows with the state of their parts, one table per round, so that a lost
executor costs a read.  Bounds are kept as 16-bit multiples of a step per block, rounded down.  Per round the
driver gets the sums of the codebooks' entries, never rows.

Defined results: rows whose vector is null or holds null, NaN or infinite components go; a vector
of zero rows gives an empty result.  Fewer rows than entries give a smaller codebook.  Rows that
repeat a vec_id are all coded; the first codebook takes them in the order of their components, null
vec_ids last.  Distances that tie go to the lower entry.  A null label is a label of its own.  Other
columns are ignored.  Vectors of different lengths, of a length that the parts don't divide, or with components
beyond about 4,000,000 / scale raise an error: distances are exact below 2^53.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from shelfcast.llm.common import stored

BLOCK = 4096
UNLIMITED = 65535       # stands for a bound that nothing reaches
SALTS = 64


@dataclass
class Codebooks:
    """Entries by part and entry, and how far each moved since the bounds were stored."""

    entries: np.ndarray     # (parts, entries, width) int64
    moved: np.ndarray       # (parts, entries) float64, rounded up

    @staticmethod
    def still(entries: np.ndarray) -> "Codebooks":
        return Codebooks(entries, np.zeros(entries.shape[:2]))

    def since(self, old: np.ndarray) -> "Codebooks":
        squares = ((self.entries - old) ** 2).sum(axis=2)
        return Codebooks(self.entries, np.nextafter(np.sqrt(squares), np.inf))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


@dataclass
class Bounds:
    """Listed entries of n parts, nearest first, lower bounds of their distances and of all others'."""

    listed: np.ndarray      # (n, b) uint8
    lower: np.ndarray       # (n, b) float64; the first is the assigned entry's
    outer: np.ndarray       # (n,) float64

    def cut(self, b: int) -> "Bounds":
        if b >= self.listed.shape[1]:
            return self
        return Bounds(self.listed[:, :b], self.lower[:, :b],
                      np.minimum(self.outer, self.lower[:, b:].min(axis=1)))

    def pack(self) -> bytes:
        values = np.concatenate([self.lower, self.outer[:, None]], axis=1)
        finite = np.isfinite(values)
        step = max(float(values[finite].max(initial=0.0)), 1.0) / (UNLIMITED - 1)
        whole = np.where(finite, np.floor(np.maximum(np.where(finite, values, 0.0), 0.0) / step), UNLIMITED)
        head = np.array([step, self.listed.shape[1]], "<f8").tobytes()
        # column by column, so that like stands by like and compresses
        return head + self.listed.T.tobytes() + whole.astype("<u2").T.tobytes()

    @staticmethod
    def unpack(data: bytes, n: int) -> "Bounds":
        step, b = np.frombuffer(data, "<f8", 2)
        b = int(b)
        listed = np.frombuffer(data, np.uint8, n * b, 16).reshape(b, n).T
        whole = np.frombuffer(data, "<u2", n * (b + 1), 16 + n * b).reshape(b + 1, n).T
        values = np.where(whole == UNLIMITED, np.inf, whole * step * (1 - 1e-12))
        return Bounds(listed, values[:, :b], values[:, b])


def full_search(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds and exact squared distances of the assigned entries, by comparing with all entries."""
    k = len(entries)
    b = min(b, k)
    xf, cf = x.astype(float), entries.astype(float)
    square = ((x * x).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)
              - 2 * np.rint(xf @ cf.T).astype(np.int64))
    key = square * 256 + np.arange(k)                   # ties to the lower entry
    if b < k:
        near = np.argpartition(key, b, axis=1)
        outer = np.sqrt(np.take_along_axis(square, near[:, b:b + 1], 1)[:, 0])
        key = np.sort(np.take_along_axis(key, near[:, :b], 1), axis=1)
    else:
        key, outer = np.sort(key, axis=1), np.full(len(x), np.inf)
    return Bounds((key & 255).astype(np.uint8), np.sqrt(key >> 8), outer), key[:, 0] >> 8


def search(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, old: Bounds, b: int, needed: np.ndarray
           ) -> tuple[Bounds, np.ndarray]:
    """The same as `full_search`, by the bounds of earlier entries that have `moved`.

    Adds to `needed`, per list length that would have settled them, the parts; the last place
    counts the parts compared with all entries.
    """
    n, width = old.listed.shape
    listed = old.listed.astype(np.int64)
    lower = old.lower - moved[listed]
    outer = old.outer - moved.max(initial=0.0)
    square = ((x - entries[listed[:, 0]]) ** 2).sum(axis=1)
    best = square * 256 + listed[:, 0]
    upper = np.nextafter(np.sqrt(square), np.inf)
    lower[:, 0] = np.sqrt(square)
    bound = lower.copy()
    unsure = lower <= upper[:, None]
    unsure[:, 0] = False
    row, place = np.nonzero(unsure)
    entry = listed[row, place]
    exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    lower[row, place] = np.sqrt(exact)
    np.minimum.at(best, row, exact * 256 + entry)
    open_ = outer <= np.nextafter(np.sqrt(best >> 8), np.inf)
    # a list cut after place j would have the least bound from j on as its outer bound
    rest = np.minimum.accumulate(np.column_stack([bound[:, 1:], outer])[:, ::-1], axis=1)[:, ::-1]
    used = 1 + (rest <= np.nextafter(np.sqrt(best >> 8), np.inf)[:, None]).sum(axis=1)
    needed += np.bincount(np.where(open_, len(needed) - 1, used), minlength=len(needed))
    # nearest first; the assigned entry leads among equal bounds
    order = np.argsort(np.where(listed == (best & 255)[:, None], -1.0, lower), axis=1, kind="stable")
    found = Bounds(np.take_along_axis(old.listed, order, 1), np.take_along_axis(lower, order, 1), outer)
    again = np.flatnonzero(open_)
    if len(again):
        whole, squares = full_search(x[again], entries, width)
        best[again] = squares * 256 + whole.listed[:, 0]
        for name in ("listed", "lower", "outer"):
            getattr(found, name)[again] = getattr(whole, name)
    return found.cut(b), best >> 8


def best_listed(needed: np.ndarray, entries: int, least: int) -> int:
    """The list length that makes the next round cheapest if parts need what they needed now.

    A part that needs more than is listed costs a comparison with all entries, a listed entry
    its upkeep.  Lists only get shorter, as a longer one needs that comparison, and not below
    `least`, as entries move less from round to round.
    """
    places = np.arange(len(needed))
    costs = {b: entries * needed[places > b].sum() + b * needed.sum() for b in range(least, len(places) - 1)}
    return min(costs, key=lambda b: (costs[b], b), default=least)


# ---- blocks --------------------------------------------------------------------------------

def narrow(values: np.ndarray) -> bytes:
    """Integers as bytes, two or four each."""
    kind = "<i2" if np.abs(values).max(initial=0) < 1 << 15 else "<i4"
    return kind[-1].encode() + values.astype(kind).T.tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).reshape(-1, n).T.astype(np.int64)


def integers(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) of a list column without nulls."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = len(flat) // n
    if width * n != len(flat) or (np.diff(column.offsets.to_numpy()) != width).any() or width % parts:
        raise ValueError(f"vectors need one length that {parts} divides")
    values = np.floor(flat * scale)
    if np.abs(values).max(initial=0.0) ** 2 * 4 * max(1, width // parts) >= 2.0 ** 53:
        raise ValueError("components are too large for exact distances")
    return values.astype(np.int64).reshape(n, width)


def block_schema(label) -> StructType:
    return StructType([
        StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(label)),
        StructField("data", BinaryType()), StructField("bounds", ArrayType(BinaryType())),
        StructField("sums", BinaryType())])


class Tally:
    """Sums of assigned parts: components and count per entry, and the list lengths needed."""

    def __init__(self, books: Codebooks, listed: int):
        self.parts, self.k, self.width = books.entries.shape
        self.cells = np.zeros((self.parts, self.k, self.width + 1), np.int64)
        self.needed = np.zeros(listed + 2, np.int64)

    def add(self, part: int, x: np.ndarray, assigned: np.ndarray) -> None:
        order = np.argsort(assigned, kind="stable")
        entry, starts, counts = np.unique(assigned[order], return_index=True, return_counts=True)
        self.cells[part, entry, :-1] += np.add.reduceat(x[order], starts, axis=0)
        self.cells[part, entry, -1] += counts

    def pack(self) -> bytes:
        return np.concatenate([self.cells.ravel(), self.needed]).astype("<i8").tobytes()


def assign(data: np.ndarray, packed: list[bytes] | None, books: Codebooks, b: int, tally: Tally
           ) -> tuple[list[Bounds], np.ndarray]:
    """Bounds of each part and the exact squared distances, one column per part."""
    width = books.entries.shape[2]
    found, squares = [], []
    for p, entries in enumerate(books.entries):
        x = data[:, p * width:(p + 1) * width]
        if packed is None:
            bounds, square = full_search(x, entries, b)
        else:
            old = Bounds.unpack(packed[p], len(x))
            bounds, square = search(x, entries, books.moved[p], old, b, tally.needed)
        tally.add(p, x, bounds.listed[:, 0])
        found.append(bounds)
        squares.append(square)
    return found, np.stack(squares, axis=1)


def first_blocks(rows: DataFrame, books: Codebooks, listed: int, scale: int) -> DataFrame:
    """Blocks with bounds of rows (vec_id, label, vector), and one row of sums per task."""
    schema = block_schema(rows.schema["label"].dataType)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def build(batches):
        books = shared.value
        tally, arrow = Tally(books, listed), None
        for batch in batches:
            arrow = batch.schema
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                n = part.num_rows
                data = integers(part.column(2), scale, len(books.entries))
                bounds, _ = assign(data, None, books, listed, tally)
                yield _block([0, n], part.column(0), part.column(1), narrow(data),
                             [x.pack() for x in bounds], None)
        if arrow is not None:
            yield _block([0, 0], pa.array([], arrow.field(0).type), pa.array([], arrow.field(1).type),
                         None, None, tally.pack())
    return rows.select("vec_id", "label", "vector").mapInArrow(build, schema)


def _block(offsets, ids, labels, data, bounds, sums) -> pa.RecordBatch:
    offsets = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays([
        pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, labels),
        pa.array([data], pa.binary()), pa.array([bounds], pa.list_(pa.binary())),
        pa.array([sums], pa.binary())], ["ids", "labels", "data", "bounds", "sums"])


def next_blocks(blocks: DataFrame, books: Codebooks, listed: int, b: int, keep: bool) -> DataFrame:
    """Blocks (if kept) and sums after another assignment."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def move(batches):
        tally, seen = Tally(shared.value, listed), None
        for batch in batches:
            seen = seen or batch
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                data, packed = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                bounds, _ = assign(widen(data, len(ids)), packed, shared.value, b, tally)
                if keep:
                    yield _block([0, len(ids)], ids, labels, data, [x.pack() for x in bounds], None)
        if seen is not None:
            yield _block([0, 0], seen.column(0).values[:0], seen.column(1).values[:0], None, None, tally.pack())
    return blocks.filter(F.col("data").isNotNull()).mapInArrow(move, blocks.schema)


def total(blocks: DataFrame, books: Codebooks, listed: int) -> Tally:
    """The sums of all tasks; their size is that of the codebooks, whatever the number of rows."""
    def spread(batches):
        whole = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                sums = np.frombuffer(data, "<i8")
                whole = sums if whole is None else whole + sums
        if whole is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(whole)], ["place", "value"])
    sums = blocks.filter(F.col("sums").isNotNull()).select("sums").mapInArrow(spread, "place int, value long")
    rows = sums.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(books.entries.shape[0] * books.entries.shape[1] * (books.entries.shape[2] + 1) + listed + 2,
                    np.int64)
    flat[rows.column("place").to_numpy()] = rows.column("value").to_numpy()
    tally = Tally(books, listed)
    cut = tally.cells.size
    tally.cells, tally.needed = flat[:cut].reshape(tally.cells.shape), flat[cut:]
    return tally


def moved_entries(books: Codebooks, tally: Tally) -> np.ndarray:
    """Floors of the means; an entry without parts stays."""
    count = tally.cells[..., -1:]
    return np.where(count > 0, tally.cells[..., :-1] // np.maximum(count, 1), books.entries)


def codes(blocks: DataFrame, books: Codebooks, listed: int, label) -> DataFrame:
    """(vec_id, label, code, error) of each row by the final codebooks."""
    schema = StructType([StructField("vec_id", LongType()), StructField("label", label),
                         StructField("code", StringType()), StructField("error", LongType())])
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                data = widen(batch.column(2)[i].as_py(), len(ids))
                bounds, squares = assign(data, batch.column(3)[i].as_py(), shared.value, listed,
                                         Tally(shared.value, listed))
                code = np.stack([x.listed[:, 0] for x in bounds], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([c.tobytes().hex() for c in code], pa.string()),
                     pa.array(squares.sum(axis=1))], ["vec_id", "label", "code", "error"])
    return blocks.filter(F.col("data").isNotNull()).mapInArrow(read, schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add the errors' sum over each label.  Rows meet it in SALTS shares, as one label may hold most."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    a, b = salted.alias("a"), sums.alias("b")
    return a.join(b, (F.col("a.salt") == F.col("b.salt")) & F.col("a.label").eqNullSafe(F.col("b.label"))).select(
        "a.vec_id", "a.label", "a.code", "a.error", "b.label_error")


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def product_codes(vectors: DataFrame, vector_column: str = "embedding", parts: int = 4, entries: int = 256,
                  rounds: int = 4, scale: int = 1024, listed: int = 16) -> DataFrame:
    """Per kept row vec_id, code, error, label_error and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                          F.col(vector_column).cast("array<double>").alias("vector")).filter(
        F.coalesce(finite(F.col("vector")), F.lit(False)))
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).toArrow()
    label = rows.schema["label"].dataType
    if not first.num_rows:
        empty = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                            F.lit(0).cast("long").alias("label_error"))
        return empty.withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    start = integers(first.column("vector").combine_chunks(), scale, parts)
    books = Codebooks.still(np.ascontiguousarray(
        start.reshape(len(start), parts, -1).transpose(1, 0, 2)))
    bounded, b = None, listed                   # codebooks the stored bounds belong to
    blocks = None
    for i in range(rounds):
        if blocks is None:
            blocks = sums = stored(first_blocks(rows, books, listed, scale), "vector-blocks")
            bounded = books.entries
        elif i < rounds - 1:
            blocks = sums = stored(next_blocks(blocks, books.since(bounded), listed, b, True), "vector-blocks")
            bounded = books.entries
        else:       # the last round's bounds would serve one reading; the ones before it do
            sums = stored(next_blocks(blocks, books.since(bounded), listed, b, False), "vector-sums")
        tally = total(sums, books, listed)
        if tally.needed.any():
            b = min(b, best_listed(tally.needed, entries, max(1, listed // 2)))
        books = Codebooks.still(moved_entries(books, tally))
    if blocks is None:
        blocks, bounded = first_blocks(rows, books, listed, scale), books.entries
    coded = stored(codes(blocks, books.since(bounded), listed, label), "vector-codes")
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
