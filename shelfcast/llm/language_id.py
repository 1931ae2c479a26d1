"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to four bytes with the counts of the byte that
followed, over all training texts.  A byte costs what an arithmetic coder with these frozen counts
would spend: from the longest context that is in the tree, an escape (as many parts as the context
has different bytes) for each context that never saw the byte, with the bytes of the longer context
excluded, then the byte itself, and past the empty context one of the bytes never seen.  Code lengths
are whole multiples of 2^-16 bit, so a text's length doesn't depend on the order of addition.  The
language with the shortest code wins, the alphabetically first among equals.

Spark counts windows of five bytes over all training rows; all shorter contexts are their sums.
What travels to the tasks is bounded by `most_nodes`: if the trees hold more, contexts seen
less often than a power of two are left out, and coding starts at the next shorter one.

Defined results: null text or text without a letter is `und` with score 0, and so is everything if
no row may be learnt from.  Rows with null lang are judged but not learnt from; a null doc_id counts as
held out.  Repeated rows count as often as they stand there.  Very long texts are read in slices that
overlap by a context.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfcast.llm.common import stored

DEPTH = 4                     # bytes of the longest context
UNIT = 1 << 16                # parts of a bit
SLICE = 1 << 20               # bytes counted or scored at once
ASCII_LETTER = re.compile(rb"[A-Za-z]")
COUNTED = "lang string, gram long, n long"
JUDGED = "doc_id long, lang_pred string, score double, bits double, n_bytes long"


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its id; never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# ---- windows -------------------------------------------------------------------------------

def slices(texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Buffers of about SLICE bytes with (text, first window, end window) of each piece.

    A piece is led by the four bytes before it, zeros at the start of a text.
    """
    parts: list[bytes] = []
    places: list[tuple[int, int, int]] = []
    size = 0
    for i, text in texts:
        for begin in range(0, len(text), SLICE):
            piece = text[begin:begin + SLICE]
            lead = (bytes(DEPTH) + text[max(0, begin - DEPTH):begin])[-DEPTH:]
            parts += [lead, piece]
            places.append((i, size, size + len(piece)))
            size += DEPTH + len(piece)
            if size >= SLICE:
                yield b"".join(parts), places
                parts, places, size = [], [], 0
    if parts:
        yield b"".join(parts), places


def windows(buffer: bytes) -> np.ndarray:
    """Every five neighbouring bytes as one number; the last byte is the one to be coded."""
    one = np.frombuffer(buffer, np.uint8).astype(np.int64)
    two = one[:-1] << 8 | one[1:]
    four = two[:-2] << 16 | two[2:]
    return four[:-1] << 8 | one[4:]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.add.reduceat(count[order], starts)


def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, window, count) of the task's rows (lang, text)."""
    found: dict[str, tuple[list, list]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = batch.column(1)
        for lang in sorted(set(langs.tolist())):
            rows = np.flatnonzero(langs == lang)
            keys, counts = found.setdefault(lang, ([], []))
            for buffer, places in slices((0, texts[int(i)].as_py()) for i in rows):
                grams = windows(buffer)
                key, count = np.unique(
                    np.concatenate([grams[a:b] for _, a, b in places]), return_counts=True)
                keys.append(key)
                counts.append(count)
                if sum(map(len, keys)) > 4 * len(keys[0]) + SLICE:
                    key, count = summed(keys, counts)
                    keys[:], counts[:] = [key], [count]
    for lang, (keys, counts) in found.items():
        if keys:
            key, count = summed(keys, counts)
            for i in range(0, len(key), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key[part]), pa.string()), pa.array(key[part]),
                     pa.array(count[part])], ["lang", "gram", "n"])


# ---- trees ---------------------------------------------------------------------------------

@dataclass
class Order:
    """The contexts of one length: nodes are context and next byte, with their counts."""

    nodes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    distinct: np.ndarray
    covered: np.ndarray     # counts that the next shorter context has for this context's bytes

    @staticmethod
    def build(nodes: np.ndarray, counts: np.ndarray, shorter: "Order | None", length: int) -> "Order":
        order = np.argsort(nodes)
        nodes, counts = nodes[order], counts[order]
        contexts, starts, distinct = np.unique(nodes >> 8, return_index=True, return_counts=True)
        below = np.zeros(len(nodes), np.int64)
        if shorter is not None and len(nodes):
            below = shorter.counts[np.searchsorted(shorter.nodes, nodes & ((1 << 8 * length) - 1))]
        def add(x):
            return np.add.reduceat(x, starts) if len(starts) else x
        return Order(nodes, counts, contexts, add(counts), distinct, add(below))


def position(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def code_lengths(grams: np.ndarray, orders: list[Order]) -> np.ndarray:
    """Cost of the last byte of each window after the bytes before it, in 1 / UNIT bit."""
    bits = np.zeros(len(grams))
    left = np.ones(len(grams), bool)
    gone_total = np.zeros(len(grams), np.int64)     # counts and bytes excluded by the longer context
    gone_bytes = np.zeros(len(grams), np.int64)
    for length in range(DEPTH, -1, -1):
        order = orders[length]
        at = position(order.contexts, (grams >> 8) & ((1 << 8 * length) - 1))
        there = left & (at >= 0)
        if not there.any():
            continue
        node = position(order.nodes, grams & ((1 << 8 * (length + 1)) - 1))
        total = order.totals[at] - gone_total
        fresh = order.distinct[at] - gone_bytes
        hit = there & (node >= 0)
        bits[hit] += np.log2((total + fresh)[hit] / order.counts[node[hit]])
        escape = there & (node < 0) & (fresh > 0)
        bits[escape] += np.log2((total + fresh)[escape] / fresh[escape])
        left &= ~hit
        gone_total = np.where(there, order.covered[at], gone_total)
        gone_bytes = np.where(there, order.distinct[at], gone_bytes)
    bits[left] += np.log2(256 - gone_bytes[left])
    return np.rint(bits * UNIT).astype(np.int64)


class KnownWindows:
    """Code lengths of all windows of the trees, found by hashing; others are worked out when met."""

    def __init__(self, trees: list[list[Order]]):
        self.trees = trees
        self.keys = np.unique(np.concatenate([t[DEPTH].nodes for t in trees]))
        self.costs = [code_lengths(self.keys, t).astype(np.int32) for t in trees]
        self.bits = max(4, int(2 * len(self.keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, step = np.arange(len(self.keys), dtype=np.int32), 0
        while len(todo):
            slot = self.place(self.keys[todo], step)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]         # of several rivals the last one stays
            todo = todo[self.slots[slot] != todo]
            step += 1
        self.most_steps = step

    def place(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Place of each window among the keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(grams), -1, np.int32)
        found = self.slots[self.place(grams, 0)]
        wrong = np.flatnonzero((found >= 0) & (self.keys[np.maximum(found, 0)] != grams))
        for step in range(1, self.most_steps):
            if not len(wrong):
                break
            next_ = self.slots[self.place(grams[wrong], step)]
            found[wrong] = next_
            wrong = wrong[(next_ >= 0) & (self.keys[np.maximum(next_, 0)] != grams[wrong])]
        found[wrong] = -1
        return found

    def lengths(self, texts: list[tuple[int, bytes]], n: int) -> np.ndarray:
        """Code length of text i of n under each language."""
        out = np.zeros((len(self.trees), n), np.int64)
        for buffer, places in slices(texts):
            grams = windows(buffer)
            at = self.find(grams)
            new = np.flatnonzero(at < 0)
            keys, inverse = np.unique(grams[new], return_inverse=True)
            ends = np.array([p[1:] for p in places]).ravel()
            owners = [p[0] for p in places]
            for l, tree in enumerate(self.trees):
                cost = self.costs[l][at] if len(self.keys) else np.zeros(len(at), np.int32)
                cost[new] = code_lengths(keys, tree)[inverse]
                # the last end may be the array's; windows between two pieces fall away
                sums = np.add.reduceat(np.append(cost, 0), ends, dtype=np.int64)[::2]
                np.add.at(out[l], owners, sums)
        return out


@dataclass
class Model:
    languages: list[str]
    known: KnownWindows | None

    @staticmethod
    def build(nodes: pa.Table) -> "Model":
        """From rows (lang, length, node, n) of the kept contexts."""
        langs = np.array(nodes.column("lang").to_pylist(), dtype=object)
        length, node, n = (nodes.column(c).to_numpy() for c in ("length", "node", "n"))
        names = sorted(set(langs.tolist()))
        trees = []
        for lang in names:
            orders: list[Order] = []
            for k in range(DEPTH + 1):
                rows = (langs == lang) & (length == k)
                orders.append(Order.build(node[rows], n[rows], orders[-1] if orders else None, k))
            trees.append(orders)
        return Model(names, KnownWindows(trees) if trees else None)


def learn(docs: DataFrame, most_nodes: int = 1_000_000) -> Model:
    """Trees of every language of rows (lang, text), all of which are counted."""
    counted = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(
        count_windows, COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = F.array(*[F.struct(
        F.lit(k).alias("length"), F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("node"))
        for k in range(DEPTH + 1)])
    nodes = counted.select("lang", "n", F.inline(levels)).groupBy("lang", "length", "node").agg(
        F.sum("n").alias("n"))
    context = Window.partitionBy("lang", "length", F.shiftright("node", 8))    # at most 256 rows
    nodes = stored(nodes.withColumn("total", F.sum("n").over(context)), "byte-contexts")
    # contexts by the power of two below their count: as many powers as a long has bits
    sizes = {r["power"]: r["n"] for r in nodes.groupBy(
        F.floor(F.log2("total")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least = min(sizes, default=0)
    while sum(n for p, n in sizes.items() if p >= least) > most_nodes:
        least += 1
    kept = nodes.filter(F.floor(F.log2("total")) >= least)
    return Model.build(kept.select("lang", "length", "node", "n").toArrow())


# ---- judging -------------------------------------------------------------------------------

def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row (doc_id, text): language, its share of the probability, code length in bits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        frozen = shared.value
        for batch in batches:
            n = batch.num_rows
            texts = batch.column(1).to_pylist()
            judged = [i for i, t in enumerate(texts) if t and frozen.known and has_letter(t)]
            lang, score, bits = ["und"] * n, np.zeros(n), np.zeros(n)
            if judged:
                lengths = frozen.known.lengths([(i, texts[i]) for i in judged], n)
                best = lengths.argmin(axis=0)
                least = lengths.min(axis=0)
                share = 1.0 / np.exp2((least - lengths) / UNIT).sum(axis=0)
                for i in judged:
                    lang[i], score[i], bits[i] = frozen.languages[best[i]], share[i], least[i] / UNIT
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang), pa.array(score), pa.array(bits),
                 pa.array([len(t or b"") for t in texts], pa.int64())],
                ["doc_id", "lang_pred", "score", "bits", "n_bytes"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(judge, JUDGED)


def languages(docs: DataFrame, most_nodes: int = 1_000_000) -> DataFrame:
    """Learn from the rows that are not held out, then judge every row."""
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = learn(train.select(F.col("lang").cast("string").alias("lang"),
                               F.col("text").cast("string").alias("text")), most_nodes)
    return identify(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits", "n_bytes")
