"""Product codes against plain k-means in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from shelfcast.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, salt int, data string"


def rows_of(n, width, seed, scale=0.1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(7)]
    return [(i, [float(np.float32(c + rng.gauss(0, scale / 3))) for c in centres[i % 7]], i % 4 or None)
            for i in range(n)]


def plain(rows, parts, entries, rounds, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, rows_key(rows, kept[j])))
    books = [[cut[j][p] for j in first[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in cut:
                members.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for e, xs in members.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for (i, _, label), x in zip(kept, cut):
        found = [nearest(x[p], books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    totals = {}
    for _, _, d, label in coded:
        totals[label] = totals.get(label, 0) + d
    return sorted([(i, c, d, totals[label], digest) for i, c, d, label in coded], key=repr)


def rows_key(rows, kept):
    return next(v for i, v, _ in rows if i == kept[0] and v is not None and len(v)
                and all(x is not None and math.isfinite(x) for x in v)
                and [math.floor(1024 * x) for x in v] == kept[1])


def coded(spark, rows, **how):
    df = spark.createDataFrame([(*r, "c", 1, 2, "d") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, vc.product_codes(df, **how).collect()), key=repr)


@pytest.mark.parametrize("listed", [1, 3, 16])
def test_codes_equal_plain_rounds(spark, listed):
    rows = rows_of(300, 8, 1)
    rows += [(400, None, 1), (401, [0.1] * 7 + [None], 1), (402, [float("nan")] * 8, 2),
             (403, [float("inf")] + [0.0] * 7, 2), (404, rows[3][1], None), (404, rows[3][1], None),
             (None, [0.5] * 8, 9), (5, rows[9][1], 1), (405, [-3.0, 2.5] * 4, 0)]
    rows += [(500 + i, rows[11][1], 77) for i in range(200)]         # one vector holds two fifths of all rows
    assert coded(spark, rows, entries=20, listed=listed) == plain(rows, 4, 20, 4)


def test_few_rows_ties_and_no_rows(spark):
    rows = [(i, [i % 2 * 1.0, 0.0, 0.0, 1.0], None) for i in range(6)]
    assert coded(spark, rows) == plain(rows, 4, 256, 4)
    assert coded(spark, rows, rounds=0, entries=2) == plain(rows, 4, 2, 0)
    assert coded(spark, [(1, None, None)]) == []
    df = spark.createDataFrame([], SCHEMA)
    assert vc.product_codes(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vectors_that_do_not_fit(spark):
    for bad in ([(1, [0.0] * 6, 1)], [(1, [0.0] * 8, 1), (2, [0.0] * 4, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="one length|too large"):
            coded(spark, bad)


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (64, 6))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-30, 30, (5000, 6))
    bounds, squares = vc.full_search(x, centres, 8)
    for step in range(3):
        moved = centres + rng.integers(-6, 7, centres.shape)
        books = vc.Codebooks.still(moved[None]).since(centres[None])
        packed = vc.Bounds.unpack(bounds.pack(), len(x))
        needed = np.zeros(10, np.int64)
        bounds, squares = vc.search(x, moved, books.moved[0], packed, 8, needed)
        truth = ((x[:, None] - moved) ** 2).sum(axis=2)
        assert (squares == truth.min(axis=1)).all() and (bounds.listed[:, 0] == truth.argmin(axis=1)).all()
        distance = np.sqrt(truth)
        assert (bounds.lower[:, 1:] <= np.take_along_axis(distance, bounds.listed.astype(int), 1)[:, 1:]).all()
        np.put_along_axis(distance, bounds.listed.astype(int), np.inf, 1)
        assert (bounds.outer <= distance.min(axis=1)).all()
        assert needed[-1] < 500 and needed.sum() == 5000
        centres = moved


def test_list_lengths_adapt():
    assert vc.best_listed(np.array([0, 90, 5, 0, 5, 0, 0, 0, 0, 0]), 256, 1) == 4
    assert vc.best_listed(np.array([0, 100, 0, 0, 0, 0, 0, 0, 0, 0]), 256, 3) == 3
    assert vc.best_listed(np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 100]), 256, 2) == 2
