"""Words of many documents as arrays: positions, 64-bit hashes, window hashes.

All of it works on UTF-8 bytes, with numpy passes over a whole piece of the
corpus instead of a Python object for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_UPPER = bytes(range(0x41, 0x5B))
#: White space to one byte, letters as they are.
SPACED = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c for c in range(256))
#: White space to one byte, A-Z to a-z.
SPACED_LOWER = bytes(c + 32 if c in _UPPER else SPACED[c] for c in range(256))
#: Only ASCII letters, digits and non-ASCII bytes are parts of words; A-Z to a-z.
ALNUM_LOWER = bytes(c + 32 if c in _UPPER else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

U = np.uint64
#: Spans hashed at a time.
_BLOCK = 1 << 16


@dataclass
class Words:
    buf: np.ndarray  # uint8: all texts after the byte table, joined by spaces
    start: np.ndarray  # int64: a word's first byte
    end: np.ndarray
    doc: np.ndarray  # int64: number of the first word of each text, and the number of words

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), self.per_doc)


def words(texts: list[bytes], table: bytes) -> Words:
    joined = b" ".join([b"", *texts, b""]).translate(table)
    buf = np.frombuffer(joined, np.uint8)
    space = buf == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return Words(buf, start, end, np.searchsorted(start, at))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


# The primes of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: What is kept of eight loaded bytes when 0 .. 8 of them belong to the span.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 512


def rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _lane(h: np.ndarray, c: np.ndarray, lane: int) -> np.ndarray:
    """One multiply-and-rotate round, not linear in what came before, so that no fixed pair of spans collides for all seeds."""
    if lane == 0:
        return rot(h ^ (rot(c * P2, 31) * P1), 27) * P1 + P4
    return rot(h ^ (rot(c * P3, 29) * P2), 23) * P2 + P5


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64-bit hashes of the spans buf[start:end] of a byte array; with two lanes an n x 2 array of independent ones."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    out = np.empty((len(start), lanes), np.uint64)
    for a in range(0, len(start), _BLOCK):
        at = start[a : a + _BLOCK].astype(np.int64)
        size = end[a : a + _BLOCK].astype(np.int64) - at
        seeds = [mix(size.astype(np.uint64) * P5 + U(k + 1)) for k in range(lanes)]
        c = wide[at] & _KEEP[np.minimum(size, 8)]
        h = [_lane(x, c, k) for k, x in enumerate(seeds)]
        go, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(go):
            c = wide[at[go] + done] & _KEEP[np.minimum(size[go] - done, 8)]
            for k in range(lanes):
                h[k][go] = _lane(h[k][go], c, k)
            done += 8
            go = go[size[go] > done]
        for k in np.flatnonzero(size > _LONG).tolist():
            whole = xxhash.xxh3_128_intdigest(buf[at[k] : at[k] + size[k]])
            for lane in range(lanes):
                h[lane][k] = U((whole >> (64 * lane)) & 0xFFFFFFFFFFFFFFFF)
        for k in range(lanes):
            out[a : a + _BLOCK, k] = mix(h[k])
    return out if lanes > 1 else out[:, 0]


def word_hashes(w: Words, lanes: int = 1) -> np.ndarray:
    return span_hashes(w.buf, w.start, w.end, lanes)


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(a * U(0x9FB21C651E98DF25) + (b ^ (b >> U(29))) * U(0xC2B2AE3D27D4EB4F) + U(0x165667B19E3779F9 * (salt + 1) % (1 << 64)))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` entries, by doubling."""
    have = 1
    while have < length:
        step = min(have, length - have)
        h = pair(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n entries lie in a run of `length` from one of the starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
