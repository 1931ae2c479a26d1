"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

Sketch: in round after round each element of a set is thrown into one of ``t`` bins; a bin keeps the
first, least value that falls into it.  Rounds ``t`` to ``2t - 1`` throw everything into one bin
each, so every bin is full at the end, and the share of equal bins of two sets concentrates around
their similarity.  Bands of bins give buckets.  Documents with equal sets are one node.  Each node is
compared with the first node, in a fixed order, of one of its buckets; then with those of its other
buckets that are not in its component; then, in buckets that still hold several components, with all nodes of other
components, where sizes and sketches allow a link, the likeliest pair of two components first.
All links are confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.llm.common import stored
from shelfcast.llm.components import components
from shelfcast.llm.shingles import mix, set_key, shingle_set

ROWS, BANDS = 5, 51               # a pair at 0.75 shares no bucket once in a million
BINS = ROWS * BANDS
SIG_LONGS = (BINS + 15) // 16     # four bits of every bin
# equal four-bit bins of a pair at 0.75 are 195 +- 6.8 of 255; a pair below this many is passed over
LEAST_EQUAL = 164
# the finer sketch of nodes that are compared across components: 1,568 +- 19.2 of 2,048
FINE_BINS = 2048
LEAST_FINE = 1482
SKETCH = ("row long, doc_id long, text_key long, n long, set_key long, bands array<long>, "
          "sig array<long>")
SEEDS = mix(np.arange(1, 2 * FINE_BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values per non-empty set, by rounds over all sets that have gaps."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), bins), full, np.uint64)
    flat = out.reshape(-1)
    left = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for i in range(2 * bins):
        if not len(left):
            break
        values = np.concatenate([sets[k] for k in left])
        owner = np.repeat(left, [len(sets[k]) for k in left])
        h = mix(values ^ SEEDS[i])
        if i < bins:
            at = (h >> np.uint64(32)) % np.uint64(bins)
        else:
            at = np.full(len(h), i - bins, np.uint64)
        placed = (np.uint64(i) << np.uint64(52)) | (mix(h) >> np.uint64(12))
        np.minimum.at(flat, owner * bins + at.astype(np.int64), placed)
        left = left[(out[left] == full).any(axis=1)]
    return out


def packed(table: np.ndarray) -> np.ndarray:
    """Four bits of every bin, sixteen bins to a long; missing bins of the last long are zero."""
    n, bins = table.shape
    nibbles = np.zeros((n, -(-bins // 16) * 16), np.uint64)
    nibbles[:, :bins] = mix(table) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (nibbles.reshape(n, -1, 16) << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def bucket_keys(table: np.ndarray) -> np.ndarray:
    """A key for each band of bins."""
    value = mix(table)
    keys = np.zeros((len(table), BANDS), np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(31) + value[:, k::ROWS][:, :BANDS])
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Set size, set key, bucket keys and packed sketch of every row, written once."""

    def run(batches):
        for batch in batches:
            group: list[np.ndarray] = []
            first, size = 0, 0
            for i, text in enumerate(batch.column(3)):
                group.append(shingle_set(text.as_py() or ""))
                size += len(group[-1])
                if size < 200_000 and i + 1 < batch.num_rows:
                    continue
                table = sketches(group)
                keys, sig = bucket_keys(table), packed(table)
                rows = batch.slice(first, len(group))
                empty = [len(s) == 0 for s in group]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), rows.column(2),
                    pa.array([len(s) for s in group], pa.int64()),
                    pa.array([None if e else set_key(s) for s, e in zip(group, empty, strict=True)],
                             pa.int64()),
                    pa.array([None if e else k for k, e in zip(keys, empty, strict=True)],
                             pa.list_(pa.int64())),
                    pa.array([None if e else s for s, e in zip(sig, empty, strict=True)],
                             pa.list_(pa.int64()))],
                    names=[x.split()[0] for x in SKETCH.split(", ")])
                group, first, size = [], i + 1, 0

    return stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_column).cast("string")).alias("text_key"),
        F.col(text_column).cast("string").alias("text")).mapInArrow(run, SKETCH), "sketches")


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str,
             text_column: str) -> DataFrame:
    """(set_key, text): one text of each node in ``wanted`` (set_key), written once."""
    named = nodes.join(wanted.distinct(), "set_key", "left_semi").select("set_key", "doc", "text_key")
    texts = docs.select(F.col(id_column).cast("long").alias("own_id"),
                        F.col(text_column).cast("string").alias("text")).withColumn(
        "own_key", F.xxhash64("text"))
    return stored(texts.join(named, (texts.own_key == named.text_key) & texts.own_id.eqNullSafe(
        named.doc)).select("set_key", "text").dropDuplicates(["set_key"]), "texts")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str,
              text_column: str, percent: int) -> DataFrame:
    """Pairs (hub, node) whose full sets have ``percent`` of their union in common."""
    texts = texts_of(pairs.select(F.col("hub").alias("set_key")).union(pairs.select("node")),
                     nodes, docs, id_column, text_column)

    def run(batches):
        hub, hub_set = None, None
        for batch in batches:
            keep, hubs, others = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (a, b) in enumerate(zip(hubs, others, strict=True)):
                if a != hub:
                    hub, hub_set = a, shingle_set(batch.column(2)[i].as_py())
                own = shingle_set(batch.column(3)[i].as_py())
                both = np.concatenate([hub_set, own])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    # the member's text joins first; the second join leaves the rows of a hub next to each other
    members = pairs.join(texts.select(F.col("set_key").alias("node"), F.col("text").alias("own")),
                         "node")
    both = members.join(texts.select(F.col("set_key").alias("hub"), F.col("text").alias("other")),
                        "hub")
    return both.select("hub", "node", "other", "own").mapInArrow(run, "a long, b long")


def like_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def unequal(x: Column) -> Column:
    """How many of the sixteen four-bit fields of an exclusive or aren't zero."""
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))              # last bit of a field: not zero
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def equal_bins(a: str, b: str) -> Column:
    """How many four-bit bins of two packed sketches are equal."""
    total = F.lit(BINS)
    for k in range(SIG_LONGS):
        total = total - unequal(F.col(f"{a}.sig")[k].bitwiseXOR(F.col(f"{b}.sig")[k]))
    return total


def equal_fine(a: str, b: str) -> Column:
    return F.lit(FINE_BINS) - F.aggregate(
        F.zip_with(f"{a}.fine", f"{b}.fine", lambda x, y: unequal(x.bitwiseXOR(y))),
        F.lit(0), lambda total, x: total + x)


def first_shared(a: str, b: str) -> Column:
    """Whether two nodes share no earlier band, so that a pair comes from one bucket only."""
    return ~F.exists(F.slice(F.zip_with(f"{a}.bands", f"{b}.bands", lambda x, y: x == y), F.lit(1),
                             F.col(f"{a}.band")), lambda same: same)


def apart(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, band, node, root) of the buckets with more than one component."""
    rooted = buckets.join(roots, "node", "left").select(
        "bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    return stored(rooted.join(several.select("bucket"), "bucket", "left_semi"), "apart")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (hub, node) of different components, with their roots; a node without links is its own."""
    a, b = (roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in ("hub", "node"))
    rooted = pairs.join(a, "hub", "left").join(b, "node", "left").withColumns({
        f"{n}_root": F.coalesce(f"{n}_root", n) for n in ("hub", "node")})
    return rooted.filter("hub_root != node_root")


def fine_sketches(texts: DataFrame) -> DataFrame:
    """(node, fine) of the texts (set_key, text)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                table = sketches([shingle_set(t.as_py()) for t in part.column(1)], FINE_BINS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(packed(table)), pa.list_(pa.int64()))],
                    names=["node", "fine"])

    return texts.mapInArrow(run, "node long, fine array<long>")


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id of the group.  Null and empty texts have no shingles and
    are groups of their own.  Rows without an id take part; they are kept only if their whole group
    has no id.  Rows that repeat an id are judged by their own texts, so each may be kept; a tie in
    the bucket order is one node.  An empty table gives an empty result; other columns are not read.
    """
    return labelled(docs, id_column, text_column, percent).drop("text_key")


def labelled(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             percent: int = 75) -> DataFrame:
    """``groups`` with the hash of each row's text, to find the row again."""
    rows = sketch_rows(docs, id_column, text_column)
    nodes = stored(rows.filter("n > 0").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("named"), F.min("doc_id").alias("least"),
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    ).select("set_key", F.col("named.doc_id").alias("doc"), F.col("named.text_key").alias("text_key"),
             "least", "n", "bands", "sig"), "nodes")

    member = nodes.select(F.posexplode("bands").alias("band", "bucket"),
                          F.col("set_key").alias("node"), "n")
    # set keys are hashes, so the least key is a random but fixed order: near copies share hubs
    first = member.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("hub")).filter("size > 1")
    buckets = stored(member.join(first.select("bucket", "hub"), "bucket").select(
        "bucket", "band", "node", "n", F.col("hub.node").alias("hub"),
        F.col("hub.n").alias("hub_n")), "buckets")
    hubs = stored(buckets.filter("node != hub").filter(
        like_sizes(F.col("n"), F.col("hub_n"), percent)).select("hub", "node").distinct(), "hubs")

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(confirmed(pairs, nodes, docs, id_column, text_column, percent), "links")

    # one hub of each node, then its other hubs if they are in another component
    tried = stored(hubs.groupBy("node").agg(F.min("hub").alias("hub")).select("hub", "node"), "tried")
    links = linked(tried)
    others = stored(across(hubs.join(tried, ["hub", "node"], "left_anti"), components(links)).select(
        "hub", "node"), "tried")
    links = links.union(linked(others))
    roots = components(links)

    # buckets that still hold several components: all pairs across them that sketches allow
    still = apart(buckets, roots)
    fine = fine_sketches(texts_of(still.select(F.col("node").alias("set_key")), nodes, docs,
                                  id_column, text_column))
    wide = stored(nodes.select(F.col("set_key").alias("node"), "n", "sig", "bands").join(fine, "node"), "fine")
    still = stored(still.join(wide, "node"), "apart")
    equal = equal_fine("a", "b")
    pairs = still.alias("a").join(
        still.alias("b"), (F.col("a.bucket") == F.col("b.bucket"))
        & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
        & like_sizes(F.col("a.n"), F.col("b.n"), percent)
        & (equal_bins("a", "b") >= LEAST_EQUAL) & first_shared("a", "b")
        & (equal >= LEAST_FINE)).select(
        F.col("a.node").alias("hub"), F.col("b.node").alias("node"), equal.alias("equal"),
        F.least("a.root", "b.root").alias("low"), F.greatest("a.root", "b.root").alias("high"))
    rest = stored(pairs.join(tried.union(others), ["hub", "node"], "left_anti"), "rest")
    # the likeliest pair of two components may make the others needless
    likely = rest.groupBy("low", "high").agg(F.max_by(
        F.struct("hub", "node"), F.struct("equal", "hub", "node")).alias("pair")).select("pair.hub", "pair.node")
    likely = stored(likely, "likely")
    links = links.union(linked(likely))
    rest = across(rest.select("hub", "node").join(likely, ["hub", "node"], "left_anti"), components(links))
    more = confirmed(stored(rest.select("hub", "node"), "rest"), nodes, docs, id_column, text_column, percent)
    roots = components(links.union(more))

    least = roots.join(nodes.select(F.col("set_key").alias("node"), "least"), "node").groupBy(
        "root").agg(F.min("least").alias("component"))
    named = nodes.select(F.col("set_key").alias("node"), "least").join(
        roots.join(least, "root").select("node", "component"), "node", "left").select(
        F.col("node").alias("set_key"), F.coalesce("component", "least").alias("component"))
    found = rows.select("doc_id", "text_key", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
