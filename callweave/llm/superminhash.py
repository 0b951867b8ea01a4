"""SuperMinHash signatures: each element ranks all positions by one permutation (Ertl, 2017).

An element's step j draws a fraction r and gives the value j + r to the j-th
position of the element's own permutation; a position keeps its least value.  The
ranks of one element are correlated, so that a signature estimates similarity
with less variance than independent minima.  A text is done after step j when
all its positions hold values below j + 1: a large set stops after a step or two.
"""

from __future__ import annotations

import numpy as np

from .bytesvec import mix, pair

U = np.uint64
#: Positions of a signature, and those that make up a band.
POSITIONS, DEPTH = 128, 4
#: Elements that are worked on at a time.
BLOCK = 1 << 17
_LOW = U(0xFFFFFFFF)


def signatures(got: np.ndarray, begin: np.ndarray, positions: int = POSITIONS, block: int = BLOCK) -> np.ndarray:
    """One row of `positions` values for each set got[begin[k]:begin[k + 1]] of distinct hashes: the step in the upper 32 bits, the fraction below; an empty set keeps the largest value."""
    n = len(begin) - 1
    held = np.full((n, positions), np.iinfo(np.uint64).max, np.uint64)
    flat = held.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(begin))
    seeds = mix(np.arange(1, positions + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    kind = np.min_scalar_type(positions)
    for a in range(0, len(got), block):
        own, of = got[a : a + block], owner[a : a + block]
        order = np.tile(np.arange(positions, dtype=kind), (len(own), 1))
        live = np.arange(len(own))
        for j in range(positions):
            if j:
                texts = np.unique(of[live])
                texts = texts[(held[texts].max(axis=1) >> U(32)) >= U(j)]
                live = live[np.isin(of[live], texts, assume_unique=False)]
                if not len(live):
                    break
            x = mix(own[live] ^ seeds[j])
            k = j + (((x >> U(32)) * U(positions - j)) >> U(32)).astype(np.int64)
            at = order[live, k]
            order[live, k] = order[live, j]
            np.minimum.at(flat, of[live] * positions + at, (x & _LOW) | U(j << 32))
    return held


def band_keys(held: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A hash for each run of `depth` positions, and its number with it."""
    bands = held.shape[1] // depth
    keys = np.empty((len(held), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(held), b, np.uint64)
            for k in range(b * depth, (b + 1) * depth):
                key = pair(key, held[:, k])
            keys[:, b] = key
    return keys


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated similarity: the share of positions that are equal."""
    return float((a == b).mean())
