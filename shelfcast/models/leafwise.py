"""Leaf-wise gradient boosting over binned blocks, many models at once.

All members (quantiles, folds, losses) grow together: a pass over the blocks sums gradients per
(member, node, feature, bin) in each task, Spark adds the sums of all tasks by (member, feature), gets
the larger sibling as parent less smaller child, and finds each node's best split there; only
the best splits reach the driver.  The number of passes does not depend on the number of members.

A tree takes the splits that growing the best leaf first would take, but not one per pass.  A node is
taken in the order of the least gain on its path, so the nodes within the first `leaves - 1` of that
order are all expanded at once, and those that fall behind as more become known are dropped at the end.

Splits of numbers learn where missing values go.  Categories are ordered in each node by their mean
gradient and parted along that order, so any set may go left.  Gradients are summed in counts or in multiples of
2^-16, exactly, so that a tree doesn't depend on how rows are spread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from shelfcast.models.bins import BLOCKS, Binning, block_arrays, block_batch
from shelfcast.models.losses import Loss
from shelfcast.models.trees import Tree, TreeModel, Walker
from shelfcast.session import cut_lineage, scratch_path

SUMS = "member int, feature int, node int, hist binary"
SPLITS = (SUMS + ", gain double, cut int, missing_left boolean, codes array<int>, n_left long, n_right long")
LOSSES = -1             # feature number of the rows that carry losses
POINTS = 1000           # of a summary of a leaf's residuals: its ranks are right to a thousandth


@dataclass(frozen=True)
class Params:
    rounds: int = 50
    leaves: int = 128
    learning_rate: float = 0.05
    min_leaf_rows: int = 20
    max_bins: int = 64
    bagging_share: float = 0.8
    bagging_every: int = 5
    feature_share: float = 0.8
    patience: int | None = None
    min_delta: float = 0.0
    category_smooth: float = 10.0
    category_l2: float = 10.0
    seed: int = 42
    checkpoint_every: int = 10


@dataclass(frozen=True)
class Member:
    """One model: it trains on rows whose tag is at least `first_tag` and is judged on `valid_tag`."""

    name: str
    loss: Loss
    first_tag: int = 0
    valid_tag: int | None = None


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    codes: list[int]
    n_left: int
    n_right: int


@dataclass
class Growing:
    """A tree on the driver while it grows: per node its split, children and place in the order."""

    rows: int = 0
    splits: dict[int, Split] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    worth: dict[int, float] = field(default_factory=dict)      # least gain on the way to a node
    parent: dict[int, int] = field(default_factory=dict)
    size: int = 1

    def learn(self, node: int, split: Split) -> None:
        self.splits[node] = split
        self.worth[node] = min(split.gain, self.worth.get(self.parent.get(node, -1), np.inf))

    def taken(self, leaves: int) -> list[int]:
        return sorted(self.splits, key=lambda i: (-self.worth[i], i))[:leaves - 1]

    def expand(self, leaves: int) -> list[tuple[int, int, int]]:
        """(node, smaller child, other child) of all nodes that are taken and not expanded yet."""
        found = []
        for node in self.taken(leaves):
            if node not in self.children:
                left, right = self.size, self.size + 1
                self.children[node] = (left, right)
                self.parent[left] = self.parent[right] = node
                self.size += 2
                s = self.splits[node]
                found.append((node, left, right) if s.n_left <= s.n_right else (node, right, left))
        return found

    def tree(self, binning: Binning, only: set[int] | None = None) -> Tree:
        """The tree of all expanded nodes, which keep their numbers, or of `only` some, by level."""
        order = list(range(self.size)) if only is None else [0]
        numbers = dict(zip(order, order))
        out = Tree([], [], [], [], [], [], [], [], [])
        for at in order:
            inner = at in self.children and (only is None or at in only)
            if inner and only is not None:
                for child in self.children[at]:
                    numbers[child] = len(order)
                    order.append(child)
            s = self.splits.get(at)
            bounds = binning.bounds[s.feature] if inner else None
            out.feature.append(s.feature if inner else -1)
            out.bound.append(float(bounds[s.cut - 1]) if bounds is not None else None)
            out.codes.append(s.codes if inner and bounds is None else None)
            out.missing_left.append(inner and s.missing_left)
            out.left.append(numbers[self.children[at][0]] if inner else numbers[at])
            out.right.append(numbers[self.children[at][1]] if inner else numbers[at])
            out.value.append(0.0)
            out.gain.append(s.gain if inner else 0.0)
            p = self.parent.get(at)
            out.cover.append(float(self.rows if p is None else (
                self.splits[p].n_left if self.children[p][0] == at else self.splits[p].n_right)))
        return out


# ---- tasks ---------------------------------------------------------------------------------

def bag(key: np.ndarray, share: float, seed: int) -> np.ndarray:
    """A share of the rows by key; the same rows wherever they are."""
    if share >= 1.0:
        return np.ones(len(key), bool)
    x = key + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * (1 << 53)) << 11)


@dataclass
class Pass:
    """What a task needs: members, their trees so far, and the nodes to be summed."""

    members: list[Member]
    walkers: dict[int, Walker]
    slots: dict[int, np.ndarray]        # per member, place of each node among those summed, or -1
    used: dict[int, list[int]]          # features of each member's tree
    sizes: list[int]
    share: float
    seed: int
    losses: bool                        # whether validation losses are wanted as well

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        lost = np.zeros((len(self.members), 2))
        for batch in batches:
            for row in batch.to_pylist():
                self.add(row, found, lost)
        names, kinds = ["member", "feature", "node", "hist"], [pa.int32()] * 3 + [pa.binary()]
        rows = [(m, LOSSES, 0, lost[m].tobytes()) for m in range(len(lost)) if lost[m, 1]]
        for (m, f), cells in found.items():
            for node in np.flatnonzero(self.slots[m] >= 0):
                rows.append((m, f, int(node), cells[self.slots[m][node]].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    def add(self, row: dict, found: dict, lost: np.ndarray) -> None:
        bins, y, tag, key, scores = block_arrays(row, len(self.members))
        picked = bag(key, self.share, self.seed)
        parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m, member in enumerate(self.members):
            if self.losses and member.valid_tag is not None:
                at = np.flatnonzero(tag == member.valid_tag)
                lost[m] += member.loss.losses(y[at], scores[m, at]).sum(), len(at)
            if m not in self.slots:
                continue
            if member.first_tag not in parts:
                at = np.flatnonzero(picked & (tag >= member.first_tag))
                parts[member.first_tag] = at, np.ascontiguousarray(bins[:, at])
            at, part = parts[member.first_tag]
            slot = self.slots[m][self.walkers[m].nodes(part)]
            here = np.flatnonzero(slot >= 0)
            at, slot = at[here], slot[here]
            n_slots = int(self.slots[m].max()) + 1
            g, h = member.loss.slopes(y[at], scores[m, at])
            up = np.flatnonzero(g > 0) if member.loss.alpha is not None else None
            for f in self.used[m]:
                size = self.sizes[f]
                cell = slot * size + part[f, here]
                shape = (n_slots, size)
                count = np.bincount(cell, minlength=n_slots * size).reshape(shape)
                if up is not None:      # two values only: counts say all
                    above = np.bincount(cell[up], minlength=n_slots * size).reshape(shape)
                    cells = np.stack([count, above], axis=-1).astype(float)
                else:
                    cells = np.stack([count, *[np.bincount(cell, np.rint(v * 65536), n_slots * size).reshape(shape)
                                               for v in (g, h)]], axis=-1).astype(float)
                old = found.get((m, f))
                found[m, f] = cells if old is None else old + cells


def terms(hist: np.ndarray, loss: Loss) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, gradient and curvature per bin."""
    n = hist[..., 0]
    if loss.alpha is not None:
        return n, loss.alpha * hist[..., 1] + (loss.alpha - 1.0) * (n - hist[..., 1]), n
    return n, hist[..., 1] / 65536, hist[..., 2] / 65536


def best_cuts(hist: np.ndarray, loss: Loss, is_category: bool, params: Params) -> list[tuple | None]:
    """(gain, cut, missing_left, codes, n_left, n_right) of one feature in each of several nodes, or None."""
    n, g, h = terms(hist, loss)
    total = [x.sum(axis=1, keepdims=True) for x in (n, g, h)]
    l2 = params.category_l2 if is_category else 0.0
    k, at = len(hist), np.arange(len(hist))

    def gain(left_n, left_g, left_h):
        right_n, right_g, right_h = (t - x for t, x in zip(total, (left_n, left_g, left_h), strict=True))
        fits = (left_n >= params.min_leaf_rows) & (right_n >= params.min_leaf_rows) & (left_h > 0) & (right_h > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (left_g ** 2 / (left_h + l2) + right_g ** 2 / (right_h + l2)
                     - total[1] ** 2 / (total[2] + l2))
        return np.where(fits, value, -np.inf)

    if is_category:
        mean = np.where(n > 0, g / (h + params.category_smooth), np.inf)       # bins without rows come last
        order = np.argsort(mean, axis=1, kind="stable")
        sums = [np.cumsum(np.take_along_axis(x, order, 1), axis=1)[:, :-1] for x in (n, g, h)]
        value = gain(*sums)
        cut = value.argmax(axis=1)
        best, n_left = value[at, cut], sums[0][at, cut]
        left = [np.sort(order[i, :cut[i] + 1]) for i in at]
        missing_left = [bool(len(x) and x[0] == 0) for x in left]
        codes = [[int(v) - 1 for v in x if v > 0] for x in left]
        cut = np.zeros(k, int)
    elif hist.shape[1] < 3:
        return [None] * k
    else:
        below = [np.cumsum(x[:, 1:], axis=1)[:, :-1] for x in (n, g, h)]
        value = np.stack([gain(*below), gain(*(b + x[:, :1] for b, x in zip(below, (n, g, h), strict=True)))])
        side = value.max(axis=2).argmax(axis=0)             # 1: missing ones go left
        cut = value[side, at].argmax(axis=1)
        best = value[side, at, cut]
        n_left = below[0][at, cut] + side * n[:, 0]
        missing_left = np.where(n[:, 0] > 0, side > 0, 2 * n_left >= total[0][:, 0]).tolist()
        codes, cut = [[]] * k, cut + 1
    return [(float(best[i]), int(cut[i]), bool(missing_left[i]), codes[i], int(n_left[i]), int(total[0][i, 0] - n_left[i]))
            if best[i] > 1e-10 else None for i in at]


@dataclass
class Search:
    """Adds up the tasks' sums of a (member, feature), gets siblings, finds splits."""

    members: list[Member]
    family: dict[int, dict[int, tuple[int, int]]]   # per member: summed child -> (parent, other child)
    categories: list[bool]
    params: Params

    def splits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for m, f, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hist = np.frombuffer(data)
                old = sums.get((m, f, node))
                sums[m, f, node] = hist if old is None else old + hist
        rows, found = [], {}
        for (m, f, node), hist in sums.items():
            if f == LOSSES:
                rows.append((m, f, node, None, float(hist[0]), 0, False, [], int(hist[1]), 0))
            elif node in self.family.get(m, {}):
                parent, other = self.family[m][node]
                found.setdefault((m, f), []).append((node, hist))
                if other >= 0:
                    found[m, f].append((other, sums[m, f, parent] - hist))
        for (m, f), nodes in found.items():
            loss = self.members[m].loss
            cells = np.stack([hist for _, hist in nodes]).reshape(len(nodes), -1, 2 if loss.alpha is not None else 3)
            cuts = best_cuts(cells, loss, self.categories[f], self.params)
            rows += [(m, f, node, hist.tobytes(), *(cut or (None,) * 6))
                     for (node, hist), cut in zip(nodes, cuts, strict=True)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int32(), pa.bool_(),
                 pa.list_(pa.int32()), pa.int64(), pa.int64()]
        names = ["member", "feature", "node", "hist", "gain", "cut", "missing_left", "codes", "n_left", "n_right"]
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows[i:i + 1000]), kinds, strict=True)], names)


@dataclass
class Leaves:
    """Residuals of each leaf: a summary for percentiles, sums for Newton steps."""

    members: list[Member]
    walkers: dict[int, Walker]
    share: float
    seed: int

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, tag, key, scores = block_arrays(row, len(self.members))
                picked = bag(key, self.share, self.seed)
                for m, walker in self.walkers.items():
                    loss = self.members[m].loss
                    at = np.flatnonzero(picked & (tag >= self.members[m].first_tag))
                    leaf = walker.nodes(np.ascontiguousarray(bins[:, at]))
                    order = np.argsort(leaf, kind="stable")
                    at, leaf = at[order], leaf[order]
                    starts = np.flatnonzero(np.diff(leaf, prepend=-1))
                    for i, begin in enumerate(starts):
                        rows = at[begin:starts[i + 1] if i + 1 < len(starts) else None]
                        if loss.alpha is not None:
                            part = summary(np.stack([y[rows] - scores[m, rows], np.ones(len(rows))]))
                        else:
                            g, h = loss.slopes(y[rows], scores[m, rows])
                            part = np.array([[y[rows].sum()], [g.sum()], [h.sum()], [len(rows)]])
                        parts = found.setdefault((m, int(leaf[begin])), [])
                        parts.append(part)
                        if len(parts) == 16:
                            parts[:] = [self.merge(m, parts)]
        yield from _named([(m, leaf, 0, self.merge(m, parts).tobytes()) for (m, leaf), parts in found.items()])

    def merge(self, m: int, parts: list[np.ndarray]) -> np.ndarray:
        if self.members[m].loss.alpha is None:
            return np.sum(parts, axis=0)
        return summary(np.concatenate(parts, axis=1))

    def values(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The step of each (member, leaf): percentile, or start mean, gradient and curvature sums."""
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for m, leaf, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                rows = 2 if self.members[m].loss.alpha is not None else 4
                found.setdefault((m, leaf), []).append(np.frombuffer(data).reshape(rows, -1))
        out = []
        for (m, leaf), parts in found.items():
            alpha = self.members[m].loss.alpha
            if alpha is None:
                got = np.sum(parts, axis=0).ravel()
            else:
                points = np.concatenate(parts, axis=1)
                got = np.array([percentile(points, alpha), points[1].sum()])
            out.append((m, leaf, 0, got.tobytes()))
        yield from _named(out)


def _named(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.int32()] * 3 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)],
                                         ["member", "feature", "node", "hist"])


def summary(points: np.ndarray) -> np.ndarray:
    """At most POINTS weighted values of (values, weights), in order, at even ranks."""
    points = points[:, np.argsort(points[0], kind="stable")]
    if points.shape[1] <= POINTS:
        return points
    ends = np.cumsum(points[1])
    ranks = (np.arange(POINTS) + 0.5) * ends[-1] / POINTS
    at = np.minimum(np.searchsorted(ends, ranks), points.shape[1] - 1)
    return np.stack([points[0, at], np.full(POINTS, ends[-1] / POINTS)])


def percentile(points: np.ndarray, alpha: float) -> float:
    """The least value with at least a share alpha of the weight up to it."""
    points = points[:, np.argsort(points[0], kind="stable")]
    ends = np.cumsum(points[1])
    return float(points[0, min(np.searchsorted(ends, alpha * ends[-1] * (1 - 1e-12)), len(ends) - 1)])


# ---- rounds --------------------------------------------------------------------------------

def moved(blocks: DataFrame, walkers: dict[int, Walker], members: int) -> DataFrame:
    """Blocks with each walked tree's values added to the scores."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins, _, _, _, scores = block_arrays(row, members)
                scores = scores.copy()
                for m, walker in walkers.items():
                    scores[m] += walker.value[walker.nodes(bins)]
                yield block_batch([row | {"scores": scores.tobytes()}])
    return blocks.mapInArrow(move, BLOCKS)


def train(blocks: DataFrame, binning: Binning, categories: dict[str, int], members: list[Member],
          params: Params = Params()) -> TreeModel:
    """Fit all members.  With a `valid_tag` and `patience` a member stops once its loss has not fallen by
    `min_delta` for that many rounds, and keeps its best ones; its losses are in `history`."""
    spark = blocks.sparkSession
    reducers = max(1, min(len(members) * len(binning.names),
                          int(spark.conf.get("spark.sql.shuffle.partitions"))))
    is_category = [b is None for b in binning.bounds]
    wanted = max(1, round(len(binning.names) * params.feature_share))
    model = TreeModel(binning.names, categories, {m.name: [] for m in members},
                      {m.name: [] for m in members},
                      frozenset(m.name for m in members if m.loss.log_link))
    best = {m: (np.inf, 0) for m in range(len(members))}
    active = list(range(len(members)))

    def leaf_steps(blocks, trees: dict[int, Tree], share, seed) -> dict[tuple[int, int], np.ndarray]:
        task = Leaves(members, {m: Walker(t, binning) for m, t in trees.items()}, share, seed)
        gathered = blocks.mapInArrow(task.gather, SUMS).repartition(reducers, "member", "feature")
        return {(r["member"], r["feature"]): np.frombuffer(r["hist"])
                for r in gathered.mapInArrow(task.values, SUMS).collect()}

    roots = {m: Tree.leaf(0.0) for m in active}
    for (m, _), got in leaf_steps(blocks, roots, 1.0, 0).items():
        loss = members[m].loss
        roots[m].value[0] = float(got[0]) if loss.alpha is not None else loss.begin(got[0] / got[3])
        roots[m].cover[0] = float(got[-1])
    for m in active:
        model.trees[members[m].name].append(roots[m])
    state = moved(blocks, {m: Walker(t, binning) for m, t in roots.items()}, len(members)).persist(
        StorageLevel.MEMORY_AND_DISK)
    old = None

    for i in range(params.rounds + 1):
        last = i == params.rounds
        seed = params.seed + i // params.bagging_every
        used = {m: sorted(np.random.default_rng([params.seed, i, zlib.crc32(members[m].name.encode())]).choice(
            len(binning.names), wanted, replace=False).tolist()) for m in active}
        if last and all(members[m].valid_tag is None for m in active):
            break
        growing = {m: Growing() for m in active}
        family = {m: {0: (-1, -1)} for m in active}
        before = None
        step = 0
        while family and not (last and step):
            walkers, slots = {}, {}
            for m in family:
                walkers[m] = Walker(growing[m].tree(binning), binning)
                slots[m] = np.full(growing[m].size, -1)
                slots[m][sorted(family[m])] = np.arange(len(family[m]))
            task = Pass(members, walkers, {} if last else slots, used, binning.sizes, params.bagging_share, seed,
                        step == 0)
            sums = state.mapInArrow(task.sums, SUMS)
            if before is not None:
                kept = before.filter(F.col("member").isin(list(family)) & (F.col("feature") != LOSSES))
                sums = sums.unionByName(kept.select("member", "feature", "node", "hist"))
            search = Search(members, family, is_category, params)
            # written, so that the next pass reads a table instead of nesting this pass's plan
            path = scratch_path(spark, "tree-sums")
            sums.repartition(reducers, "member", "feature").mapInArrow(search.splits, SPLITS).write.option(
                "compression", "zstd").parquet(path)
            found = spark.read.schema(SPLITS).parquet(path)
            chosen = found.filter(F.col("gain").isNotNull()).select(
                "member", "node", "gain", "feature", "cut", "missing_left", "codes", "n_left", "n_right").toArrow()
            if old is not None:
                old.unpersist()
                old = None
            best_splits: dict[tuple[int, int], Split] = {}
            for m, node, gain, feature, *rest in zip(*(c.to_pylist() for c in chosen.columns), strict=True):
                if feature == LOSSES:
                    _judge(members[m], m, gain, rest[3], i, active, best, model.history, params)
                elif (m, node) not in best_splits or (gain, -feature) > (
                        best_splits[m, node].gain, -best_splits[m, node].feature):
                    best_splits[m, node] = Split(gain, feature, *rest)
            if step == 0:
                family = {m: f for m, f in family.items() if m in active}
            for (m, node), split in best_splits.items():
                if m in family:
                    growing[m].learn(node, split)
            before, step = found, step + 1
            family = {m: {small: (node, other) for node, small, other in growing[m].expand(params.leaves)}
                      for m in family}
            family = {m: f for m, f in family.items() if f}
        if last or not active:
            break
        trees = {}
        for m in active:
            only = set(growing[m].taken(params.leaves))
            s = growing[m].splits.get(0)
            growing[m].rows = s.n_left + s.n_right if s else 0
            trees[m] = growing[m].tree(binning, only)
        for (m, leaf), got in leaf_steps(state, trees, params.bagging_share, seed).items():
            loss = members[m].loss
            step_value = got[0] if loss.alpha is not None else got[1] / got[2] if got[2] else 0.0
            trees[m].value[leaf] = params.learning_rate * float(step_value)
            trees[m].cover[leaf] = float(got[-1])
        for m, tree in trees.items():
            model.trees[members[m].name].append(tree)
        old = state
        state = moved(state, {m: Walker(t, binning) for m, t in trees.items()}, len(members))
        if (i + 1) % params.checkpoint_every == 0 and i + 1 < params.rounds:
            state = cut_lineage(state)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    if old is not None:
        old.unpersist()
    if params.patience is not None:
        for m, member in enumerate(members):
            if member.valid_tag is not None:
                del model.trees[member.name][best[m][1] + 1:]
    return model


def _judge(member: Member, m: int, lost: float, rows: int, done: int, active: list[int], best: dict,
           history: dict[str, list[float]], params: Params) -> None:
    """Note a member's loss after `done` rounds; take it out once it stopped improving."""
    if m not in active or not rows:
        return
    loss = lost / rows
    if done:
        history[member.name].append(loss)
    if loss < best[m][0] - params.min_delta:
        best[m] = (loss, done)
    elif params.patience is not None and done - best[m][1] >= params.patience:
        active.remove(m)
