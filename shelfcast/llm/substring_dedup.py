"""Substring deduplication with an FM-index per shard.

A window is a run of ``WINDOW`` words.  Its anchor is the least hash of its short word groups, so equal
windows have equal anchors wherever they stand; neighbouring windows with one anchor form a segment.
Only segments whose anchor occurs more than once, elsewhere or in themselves, can repeat.  Segments with equal words are one
entry, kept with its first place: all later places repeat it whole.  Entries that share an anchor but
differ go to the shard of that anchor.  The shard builds an FM-index of its entries, streams them
through it, and reports the windows whose interval holds an earlier place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfcast.llm.common import stored
from shelfcast.llm.fm_index import FMIndex
from shelfcast.llm.shingles import POWERS, mix, powers, word_hashes

WINDOW = 20
GROUP = 5
RUN = 64                # windows of a segment at most; longer runs are several segments
SHARD_WORDS = 150_000   # an index is closed at the first anchor beyond this
HOT_ENTRIES = 4096      # anchors with more entries are settled window by window
_P = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(RUN + WINDOW)], np.uint64)


def sequence_hash(w: np.ndarray) -> int:
    total = mix((w * _P[:len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    return int(total.view(np.int64)[0])


def segments(w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, start and number of windows of each segment of hashed words, and
    whether its anchor stands in it twice, so that it may repeat its own windows."""
    n = len(w) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 5
    g = np.zeros(len(w) - GROUP + 1, np.uint64)
    for k in range(GROUP):
        g += w[k:len(g) + k] * POWERS[k]
    g = groups = mix(g)
    span, width = WINDOW - GROUP + 1, 1
    while 2 * width <= span:
        g, width = np.minimum(g[:-width], g[width:]), 2 * width
    if width < span:
        g = np.minimum(g[:len(g) - (span - width)], g[span - width:])
    change = np.flatnonzero(g[1:] != g[:-1]) + 1
    starts = np.concatenate([[0], change])
    lengths = np.diff(np.concatenate([starts, [n]]))
    if lengths.max() > RUN:
        parts = [np.arange(s, s + m, RUN) for s, m in zip(starts, lengths, strict=True)]
        ends = np.repeat(starts + lengths, [len(p) for p in parts])
        starts = np.concatenate(parts)
        lengths = np.minimum(RUN, ends - starts)
    # the hash of all words of a segment, as a difference of running sums freed from its place
    up, down = powers(len(w) + 1)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[:len(w)], out=sums[1:])
    ends = starts + lengths + WINDOW - 1
    content = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    twice = np.zeros(len(starts), np.int64)
    values, counts = np.unique(groups, return_counts=True)
    for k in np.flatnonzero(np.isin(g[starts], values[counts > 1])):
        inside = groups[starts[k]:starts[k] + lengths[k] + span - 1]
        twice[k] = (inside == g[starts[k]]).sum() > 1
    return (g[starts].view(np.int64), content.view(np.int64), starts.astype(np.int64),
            lengths.astype(np.int64), twice)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    doc = F.col(id_column).cast("long")
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("key"), text.alias("text"))


def anchored(rows: DataFrame) -> DataFrame:
    """(anchor, content, doc_id, key, start, n, twice) of every segment of every document."""
    names = ["anchor", "content", "doc_id", "key", "start", "n", "twice"]

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, size = [], 0
            for i in range(len(ids)):
                found = segments(word_hashes(batch.column(2)[i].as_py().encode("utf-8", "replace")))
                m = len(found[0])
                if m:
                    out.append([pa.array(found[0]), pa.array(found[1]),
                                pa.array([ids[i]] * m, pa.int64()), pa.array(np.full(m, keys[i])),
                                *(pa.array(x) for x in found[2:])])
                    size += m
                if out and (size > 100_000 or i + 1 == len(ids)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays(c) for c in zip(*out, strict=True)], names=names)
                    out, size = [], 0

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def repeated_windows(entries: list[tuple]) -> list[list[int]]:
    """For each entry (place, words) of a shard the offsets of its windows that an entry with an
    earlier place holds too.  A place is (document rank, start)."""
    words = [np.frombuffer(e[1], "<u8") for e in entries]
    codes = np.unique(np.concatenate(words), return_inverse=True)[1]
    top, at = int(codes.max()) + 1, 0
    parts, owner, offset, firsts, base = [], [], [], [], []
    for i, w in enumerate(words):
        base.append(at + i)
        parts += [codes[at:at + len(w)], [top + i]]          # a separator of its own after each
        owner.append(np.full(len(w) + 1, i))
        offset.append(np.arange(len(w) + 1))
        firsts.append(at + i + np.arange(len(w) - WINDOW + 1))
        at += len(w)
    text, owner, offset = (np.concatenate(x).astype(np.int64) for x in (parts, owner, offset))
    index = FMIndex(text)
    doc = np.array([e[0][0] for e in entries])
    start = np.array([e[0][1] for e in entries])
    rank = np.empty(len(text), np.int64)
    rank[np.lexsort((start[owner] + offset, doc[owner]))] = np.arange(len(text))
    begin = np.concatenate(firsts)
    low, high = index.search(np.lib.stride_tricks.sliding_window_view(text, WINDOW)[begin])
    # intervals of windows are equal or apart, so their least ranks come from one pass
    lows, which = np.unique(low, return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[which] = high
    edges = np.append(np.stack([lows, highs], 1).ravel(), len(text))
    ranks = np.append(rank[index.order], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(ranks, edges)[0:-1:2]
    repeated = least[which] < rank[begin]
    out: list[list[int]] = [[] for _ in entries]
    for p in begin[repeated].tolist():
        out[owner[p]].append(int(offset[p]))
    return out


def shard_windows(entries: DataFrame) -> DataFrame:
    """(key, first, last): repeated windows of entries (anchor, doc_id, key, start, words)."""

    def settle(held):
        order = sorted({(d is not None, d or 0, k) for _, d, k, _, _ in held})
        docs = {x: i for i, x in enumerate(order)}
        found = repeated_windows([((docs[d is not None, d or 0, k], s), w) for _, d, k, s, w in held])
        rows = [(k, s + o, s + o + WINDOW) for (_, _, k, s, _), offsets in zip(held, found, strict=True)
                for o in offsets]
        columns = zip(*rows, strict=True) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          names=["key", "first", "last"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_WORDS and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) // 8
        if held:
            yield settle(held)

    return entries.select("anchor", "doc_id", "key", "start", "words").repartition(
        "anchor").sortWithinPartitions("anchor").mapInArrow(run, "key long, first long, last long")


def removed(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Words, removed words and the hash of the kept words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    gone = np.zeros(len(words) + 1, np.int64)
    for first, last in spans:
        gone[first] += 1
        gone[last] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if spans else words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A word goes when a window over it starts earlier elsewhere: in a smaller doc_id, or earlier in
    the same document.  Null and empty texts have no words.  Null ids come first; rows that share an
    id are in order of a hash of their text, and rows that share both are one document and get the
    same result.  An empty table gives an empty result; other columns are not read.
    """
    rows = keyed(docs, id_column, text_column)
    every = anchored(rows)
    several = every.groupBy("anchor").agg(F.sum(1 + F.col("twice")).alias("c")).filter(
        "c > 1").select("anchor")
    shared = stored(every.join(several, "anchor"), "segments")
    first = shared.groupBy("anchor", "content").agg(
        F.min(F.struct("doc_id", "key", "start", "n")).alias("first"), F.max("twice").alias("twice"))
    first = stored(first, "entries")
    kinds = first.groupBy("anchor").agg(F.sum(1 + F.col("twice")).alias("entries")).filter("entries > 1")
    later = shared.join(first, ["anchor", "content"]).filter(
        (F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start"))).select(
        "key", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("last"),
        F.lit(None).cast("long").alias("anchor"), F.lit(0).alias("hot"))
    unsure = first.join(kinds, "anchor").select(
        "first.key", "first.start", (F.col("first.start") + F.col("first.n") + WINDOW - 1).alias("last"),
        "anchor", (F.col("entries") > HOT_ENTRIES).cast("int").alias("hot"))
    listed = later.union(unsure).groupBy("key").agg(
        F.collect_set(F.struct("start", "last", "anchor", "hot")).alias("spans"))

    entry = pa.list_(pa.struct([("anchor", pa.int64()), ("hot", pa.int32()), ("start", pa.int64()),
                                ("words", pa.binary())]))
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def judge(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_id, key, text, spans = row
                sure = [(s["start"], s["last"]) for s in spans or [] if s["anchor"] is None]
                open_ones = [s for s in spans or [] if s["anchor"] is not None]
                entries = []
                if open_ones:
                    w = word_hashes(text.encode("utf-8", "replace"))
                    entries = [{"anchor": s["anchor"], "hot": s["hot"], "start": s["start"],
                                "words": w[s["start"]:s["last"]].tobytes()} for s in open_ones]
                done = (None, None, None) if entries else removed(text, sure)
                for c, v in zip(out, (doc_id, key, text if entries else None,
                                      [{"first": a, "last": b} for a, b in sure] if entries else [],
                                      entries, done[0:2], done[2]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                pa.array(out[3], span), pa.array(out[4], entry),
                pa.array([x[0] for x in out[5]], pa.int64()), pa.array([x[1] for x in out[5]], pa.int64()),
                pa.array(out[6], pa.string())],
                names=["doc_id", "key", "text", "sure", "entries", "n_words", "n_removed", "kept_sha256"])

    judged = stored(rows.join(listed, "key", "left").select("doc_id", "key", "text", "spans").mapInArrow(
        judge, "doc_id long, key long, text string, sure array<struct<first:long,last:long>>, "
        "entries array<struct<anchor:long,hot:int,start:long,words:binary>>, n_words long, "
        "n_removed long, kept_sha256 string"), "judged")
    result = judged.filter("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    waiting = judged.filter("text is not null")
    entries = waiting.dropDuplicates(["key"]).select("doc_id", "key", F.explode("entries").alias("e")).select(
        "doc_id", "key", "e.*")
    found = shard_windows(entries.filter("hot = 0")).union(hot_windows(entries.filter("hot = 1")))
    spans = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("found"))

    def finish(batches):
        for batch in batches:
            got = [removed(t, [(s["first"], s["last"]) for s in [*sure, *(more or [])]])
                   for t, sure, more in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            columns = list(zip(*got, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rest = waiting.select("doc_id", "key", "text", "sure").join(spans, "key", "left").select(
        "doc_id", "text", "sure", "found").mapInArrow(finish, result.schema)
    return result.union(rest)


def hot_windows(entries: DataFrame) -> DataFrame:
    """The same for anchors with very many entries: each window by its own hash, whose first place is
    a minimum that Spark combines before the shuffle."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, key, _, _, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.frombuffer(words, "<u8")
                rows += [(sequence_hash(w[o:o + WINDOW]), doc_id, key, start + o)
                         for o in range(len(w) - WINDOW + 1)]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["window", "doc_id", "key", "start"])

    windows = entries.mapInArrow(run, "window long, doc_id long, key long, start long")
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"))
    return windows.join(first, "window").filter(
        (F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start"))).select(
        "key", F.col("start").alias("first"), (F.col("start") + WINDOW).alias("last"))
