"""Feature tables as blocks of small integers.

A number falls into one of up to `max_bins` bins between approximate quantiles of its column; a
category's bin is its code.  Bin 0 of every feature is for what is missing or was never seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 1 << 15
MOST_CODES = (1 << 16) - 2
BLOCKS = ("n int, bins array<binary>, target binary, tag binary, key binary, scores binary")


@dataclass
class Binning:
    """Per feature the ascending upper bounds of its bins, or None and a count for categories."""

    names: list[str]
    bounds: list[np.ndarray | None]
    sizes: list[int]                # bins with the missing one

    @staticmethod
    def build(names: list[str], bounds: dict[str, np.ndarray], categories: dict[str, int]) -> "Binning":
        if any(n > MOST_CODES for n in categories.values()):
            raise ValueError(f"a category may have {MOST_CODES} values")
        found = [None if n in categories else np.asarray(bounds[n], float) for n in names]
        return Binning(names, found, [
            categories[n] + 1 if b is None else len(b) + 2 for n, b in zip(names, found, strict=True)])

    @property
    def width(self) -> int:
        return max(self.sizes)

    def column(self, i: int, x: np.ndarray) -> np.ndarray:
        """Bins of one feature's values, NaN for missing ones."""
        bounds = self.bounds[i]
        if bounds is None:
            known = (x >= 0) & (x < self.sizes[i] - 1)
            return np.where(known, np.where(known, x, 0) + 1, 0).astype(np.uint16)
        return np.where(np.isnan(x), 0, np.searchsorted(bounds, x) + 1).astype(np.uint16)

    def matrix(self, columns: list[np.ndarray]) -> np.ndarray:
        """One row of bins per feature."""
        return np.stack([self.column(i, x) for i, x in enumerate(columns)])


def numbers(batch: pa.RecordBatch, columns: range) -> list[np.ndarray]:
    """Columns of an Arrow batch as doubles, nulls as NaN."""
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in columns]


def values(names: list[str], categories: dict[str, int]) -> list[Column]:
    """The features as doubles in fixed order, categories by their codes."""
    return [F.col(f"{n}_code" if n in categories else n).cast("double").alias(f"_{i}")
            for i, n in enumerate(names)]


def quantile_bounds(df: DataFrame, columns: list[str], max_bins: int) -> dict[str, np.ndarray]:
    """Bounds of all columns from one pass of mergeable sketches."""
    if not columns:
        return {}
    shares = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")),
                                       shares, max(10_000, 20 * max_bins)).alias(f"_{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: np.unique(row[f"_{i}"] or []) for i, c in enumerate(columns)}


def fit(df: DataFrame, names: list[str], categories: dict[str, int], max_bins: int) -> Binning:
    plain = [n for n in names if n not in categories]
    return Binning.build(names, quantile_bounds(df, plain, max_bins), categories)


def block_arrays(row: dict, members: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins (features x rows), target, tag, key and scores (members x rows) of a block."""
    kinds = [np.uint8 if len(b) == row["n"] else np.uint16 for b in row["bins"]]
    bins = np.stack([np.frombuffer(b, k).astype(np.uint16) for b, k in zip(row["bins"], kinds, strict=True)])
    return (bins, np.frombuffer(row["target"]), np.frombuffer(row["tag"], np.int16),
            np.frombuffer(row["key"], np.uint64), np.frombuffer(row["scores"]).reshape(members, row["n"]))


def block_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"n": pa.int32(), "bins": pa.list_(pa.binary())}
    names = ["n", "bins", "target", "tag", "key", "scores"]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in names], names)


def blocks(df: DataFrame, binning: Binning, categories: dict[str, int], label: str, tag: Column,
           keys: list[str], members: int) -> DataFrame:
    """Blocks of rows with zero scores.  `tag` is a small integer that members select rows by; `keys` name
    a row, so that a bag holds the same rows wherever they are."""
    n = len(binning.names)
    kinds = [np.uint8 if size <= 256 else np.uint16 for size in binning.sizes]

    def block(parts: list[tuple]) -> dict:
        bins, target, tags, key = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        return {"n": len(target), "bins": [b.astype(k).tobytes() for b, k in zip(bins, kinds, strict=True)],
                "target": target.tobytes(), "tag": tags.astype(np.int16).tobytes(),
                "key": key.astype(np.uint64).tobytes(), "scores": np.zeros((members, len(target))).tobytes()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append((binning.matrix(numbers(batch, range(n))),
                          *numbers(batch, range(n, n + 1)),
                          batch.column(n + 1).to_numpy(zero_copy_only=False),
                          batch.column(n + 2).to_numpy(zero_copy_only=False).view(np.uint64)))
            size += batch.num_rows
            if size >= BLOCK:
                yield block_batch([block(parts)])
                parts, size = [], 0
        if size:
            yield block_batch([block(parts)])
    return df.select(*values(binning.names, categories), F.col(label).cast("double").alias("_target"),
                     tag.cast("short").alias("_tag"), F.xxhash64(*keys).alias("_key")).mapInArrow(build, BLOCKS)
