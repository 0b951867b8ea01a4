"""SimHash near-duplicates: fingerprints linked by Hamming radius through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import P1, P2, P3, P4, P5, SPACED_LOWER, rot
from .common import arrow_map, as_table, id_in, id_out, meet, text_bytes
from .components import components

U = np.uint64


def _round(acc, lane):
    return rot(acc + lane * P2, 31) * P1


def xxh64(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42, most: int = 256) -> np.ndarray:
    """XXH64 of every span data[start:end], all spans of a step at a time; longer ones than `most` singly."""
    start, size = start.astype(np.int64), (end - start).astype(np.int64)
    padded = data + bytes(8)
    wide = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    half = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    byte = np.frombuffer(padded, np.uint8)
    with np.errstate(over="ignore"):
        h = np.full(len(start), U(seed) + P5, np.uint64)
        at = start.copy()
        big = np.flatnonzero((size >= 32) & (size <= most))
        if len(big):
            v = [np.full(len(big), x, np.uint64) for x in (U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1)]
            left, p = size[big].copy(), at[big].copy()
            while True:
                go = np.flatnonzero(left >= 32)
                if not len(go):
                    break
                for k in range(4):
                    v[k][go] = _round(v[k][go], wide[p[go] + 8 * k])
                left[go] -= 32
                p[go] += 32
            acc = rot(v[0], 1) + rot(v[1], 7) + rot(v[2], 12) + rot(v[3], 18)
            for k in range(4):
                acc = (acc ^ _round(U(0), v[k])) * P1 + P4
            h[big], at[big] = acc, p
        h += size.astype(np.uint64)
        left = np.where(size > most, 0, start + size - at)
        go = np.flatnonzero(left >= 8)
        while len(go):
            h[go] = rot(h[go] ^ _round(U(0), wide[at[go]]), 27) * P1 + P4
            at[go] += 8
            left[go] -= 8
            go = go[left[go] >= 8]
        go = np.flatnonzero(left >= 4)
        h[go] = rot(h[go] ^ half[at[go]].astype(np.uint64) * P1, 23) * P2 + P3
        at[go] += 4
        left[go] -= 4
        go = np.flatnonzero(left >= 1)
        while len(go):
            h[go] = rot(h[go] ^ byte[at[go]].astype(np.uint64) * P5, 11) * P1
            at[go] += 1
            left[go] -= 1
            go = go[left[go] >= 1]
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    for k in np.flatnonzero(size > most):
        h[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + size[k]], seed)
    return h


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text; 0 for texts without words."""
    joined = b" ".join([b"", *texts, b""]).translate(SPACED_LOWER)
    buf = np.frombuffer(joined, np.uint8)
    space = buf == 32
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(space[1:] & space[:-1])  # one space between words
    place = np.cumsum(keep) - 1
    flat = buf[keep]
    space = flat == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    doc = np.searchsorted(start, place[np.minimum(at, len(place) - 1)])
    n = np.diff(doc)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.repeat(doc[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = np.minimum(first + shingle - 1, np.repeat(doc[1:], count) - 1)
    h = xxh64(flat.tobytes(), start[first], end[last], seed)
    return majority(h, count)


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each run of count hashes the bits that over half of them have; 0 for an empty run."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    cut = np.concatenate([[0], np.cumsum(count[some])])
    k = 0
    while k < len(some):  # a bounded number of shingles as bits at a time
        to = max(k + 1, int(np.searchsorted(cut, cut[k] + 200_000, "right")) - 1)
        ones = np.zeros((to - k, 64), np.int64)
        if to == k + 1:
            for a in range(cut[k], cut[to], 200_000):
                ones[0] += np.unpackbits(h[a : min(cut[to], a + 200_000)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            bits = np.unpackbits(h[cut[k] : cut[to]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[:] = np.add.reduceat(bits, cut[k:to] - cut[k], axis=0, dtype=np.int64)
        major = 2 * ones > count[some[k:to], None]
        out[some[k:to]] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
        k = to
    return out


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values) - 1
                return
            at = nxt

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the entries within the radius: only edges within it of the distance are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if len(kids) <= 2 * radius + 1:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
            else:
                todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect what lies within the radius of each other: at most one for each value."""
    tree, up = BKTree(), list(range(len(values)))

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, v in enumerate(values):
        for other in tree.near(v, radius):
            up[find(other)] = find(k)
        tree.add(v)
    return [(v, values[find(k)]) for k, v in enumerate(values) if find(k) != k]


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    cut = [len(bits) * k // n for k in range(n + 1)]
    return [bits[cut[k] : cut[k + 1]] for k in range(n)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(distinct: DataFrame, radius: int = 2, hot: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within the radius.

    Of radius + 2 blocks of the 64 bits, two fingerprints within the radius share
    two whole ones.  Each pair of blocks and its value names a shard; a shard's
    BK-tree is built and asked where the shard is.  A shard of more than `hot`
    entries is dealt again by pairs of blocks of its other bits, which bounds any
    shard by the bits then left (65,536 entries for radius 2).  fp is distinct and
    not null, as `near_duplicates` makes it; a single fingerprint has no edges.
    """
    blocks = _blocks(list(range(64)), radius + 2)
    tops, subs = [], []
    for i, j in combinations(range(len(blocks)), 2):
        own = blocks[i] + blocks[j]
        rest = _blocks([b for b in range(64) if b not in own], radius + 2)
        tops.append(_mask(own))
        subs.append([_mask(own + x + y) for x, y in combinations(rest, 2)])
    masked = lambda masks: F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])
    top = distinct.select("fp", F.inline(masked(tops)))
    sizes = top.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    within = as_table(top.join(sizes, ["kind", "key"]), "shards")  # fingerprints alone in their shard are out
    again = F.array(*[F.struct(F.lit(s).alias("kind"), F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(sub[s]).cast("long") for sub in subs]), F.col("was") + 1)).alias("key")) for s in range(len(subs[0]))])
    split = within.where(F.col("n") > hot).select("fp", F.col("kind").alias("was"), F.col("key").alias("old")).select("fp", "was", "old", F.inline(again)).groupBy("was", "kind", "key").agg(F.collect_list("fp").alias("fps"))
    whole = within.where(F.col("n") <= hot).groupBy("kind", "key").agg(F.collect_list("fp").alias("fps"))
    shards = whole.select("fps").unionByName(split.where(F.size("fps") > 1).select("fps"))

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [e for fps in pdf["fps"] for e in forest(sorted(int(x) % (1 << 64) for x in fps), radius)]
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return shards.repartition(F.col("fps")[0], F.size("fps")).mapInPandas(ask, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    fp is the SimHash over XXH64 (seed 42) of the word shingles, repeats included,
    of the text with A-Z lower-cased; a text of fewer words is one shingle, a text
    without words has 0.  Rows are linked at `radius` or fewer differing bits;
    component_id is the least id that links reach, the row's own included.

    Null texts count as empty; a null id is passed over as a component's least id
    unless there is no other; repeated rows and equal fingerprints are one node;
    other columns are ignored.
    """
    source = df.select(id_in(id_col), text_bytes(text_col).alias("text"))
    marked = arrow_map(source, lambda pdf: pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fingerprints(list(pdf["text"]), shingle).view(np.int64)}), "doc_id long, fp long")
    fps = as_table(id_out(marked).withColumn("row", F.monotonically_increasing_id()), "fingerprints")  # rows alike in id and text are dealt, too
    least = as_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    sizes = least.select("fp", "n")
    roots = components(links(least.select("fp"), radius))
    joined = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    reach = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = as_table(joined.join(reach, "root").join(sizes, "fp").select("fp", "component_id", "n"), "by-fingerprint")
    return meet(fps, by_fp, "fp", "row").select("doc_id", "fp", "component_id")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
