"""Sets of hashed word shingles, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
POWERS = np.array([pow(_FACTOR, k, 1 << 64) for k in range(WIDTH)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0xD1342543DE82EF95            # odd, so that powers of it have inverses
BLOCK = 1 << 20
_PLACES = BLOCK + 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE, _PLACES), _powers(pow(BASE, -1, 1 << 64), _PLACES)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of the base and of its inverse."""
    return (UP, DOWN) if n <= _PLACES else (_powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order.

    A running sum of bytes times powers of a base gives every word's polynomial as a difference,
    which the inverse power frees from the word's place.  Long texts go block by block; a block ends
    at white space, and a word longer than a block is hashed by itself.
    """
    if len(text) <= BLOCK:
        return _block_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut < at:                                  # one word fills the block
                cut = min([k for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")
                           if (k := text.find(c, end)) >= 0], default=len(text))
                parts.append(np.array([xxhash.xxh3_64_intdigest(text[at:cut])], np.uint64))
                at = cut
                continue
            end = cut + 1
        parts.append(_block_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def _block_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    edge = np.ones(len(b) + 2, bool)                      # white space before and behind
    edge[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * UP[:len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * DOWN[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z count as a-z.  A text of fewer
    words than a shingle has is one shingle; one without words has none."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    if n < WIDTH:
        return mix((w * POWERS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = np.zeros(n - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        total += w[k:n - WIDTH + 1 + k] * POWERS[k]
    return np.unique(mix(total))


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)) - (1 << 63)
