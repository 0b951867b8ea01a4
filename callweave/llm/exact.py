"""Exact duplicates by a minimal perfect hash over distinct digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_table, id_in, id_out, text_bytes

_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Digests in an index shard, about, and rows that look into one copy of it.
SHARD, ASKERS = 8192, 65536
_M = (1 << 64) - 1


def _spread(x: int, seed: int) -> int:
    x = (x ^ (seed * 0x9E3779B97F4A7C15)) & _M
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _M
    return x ^ (x >> 29)


def _spread_all(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x = x ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    w = np.frombuffer(digests, "<u8").reshape(-1, 4)
    return w[:, 1].astype(np.uint64), w[:, 2].astype(np.uint64)


class PerfectHash:
    """n distinct 32-byte digests to slots 0 .. n-1 by one displacement for four keys (hash and displace)."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, digests: bytes) -> tuple[PerfectHash, np.ndarray]:
        a, b = _halves(digests)
        n = len(a)
        m = max(1, -(-n // 4))
        group = (a % np.uint64(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(m + 1))
        seeds, used = np.zeros(m, np.int64), bytearray(n)
        keys, free = b.tolist(), 0
        for g in np.argsort(-np.diff(cut), kind="stable").tolist():
            own = [keys[k] for k in order[cut[g] : cut[g + 1]]]
            if not own:
                break
            if len(own) == 1:  # the last ones take what is free
                free = used.index(0, free)
                seeds[g] = -1 - free
                used[free] = 1
                continue
            seed = 1
            while True:
                slots = [_spread(k, seed) % n for k in own]
                if len(set(slots)) == len(slots) and not any(used[s] for s in slots):
                    break
                seed += 1
                if seed > 1 << 24:
                    raise ValueError("two of the digests are equal")
            seeds[g] = seed
            for s in slots:
                used[s] = 1
        out = cls(seeds, n)
        return out, out.slots(digests)

    def slots(self, digests: bytes) -> np.ndarray:
        a, b = _halves(digests)
        seed = self.seeds[(a % np.uint64(len(self.seeds))).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, (_spread_all(b, np.maximum(seed, 0)) % np.uint64(max(1, self.n))).astype(np.int64))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; null counts as empty."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "digest": [hashlib.sha256(t.translate(_UPPER)).digest() for t in pdf["text"]]})

    return id_out(arrow_map(df.select(id_in(id_col), text_bytes(text_col).alias("text")), run, "doc_id long, digest binary"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def build_index(groups: DataFrame) -> tuple[DataFrame, int]:
    """Index shards over distinct digests (digest, keep_id, n): seeds and slots with digest, winner and group size.

    Returns the table (shard, salts, seeds, slots) and the number of shards.  A
    shard is copied `salts` times for its askers, one for each ASKERS rows of it.
    """
    count = groups.count()
    shards = max(1, -(-count // SHARD))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        all_digests = b"".join(pdf["digest"])
        mph, slot = PerfectHash.build(all_digests)
        n = len(pdf)
        body = np.zeros((n, 48), np.uint8)
        body[slot, :32] = np.frombuffer(all_digests, np.uint8).reshape(n, 32)
        body[slot, 32:40] = pdf["keep_id"].to_numpy(np.int64).view(np.uint8).reshape(n, 8)
        body[slot, 40:] = pdf["n"].to_numpy(np.int64).view(np.uint8).reshape(n, 8)
        salts = 1 + int(pdf["n"].sum()) // ASKERS
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "salts": salts, "seeds": mph.seeds.tobytes(), "slots": body.tobytes()}])

    table = groups.select(_shard(shards), "digest", F.coalesce("keep_id", F.lit((1 << 63) - 1)).alias("keep_id"), "n").groupBy("shard").applyInPandas(run, "shard long, salts int, seeds binary, slots binary")
    return as_table(table, "digest-index"), shards


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """rows (doc_id, digest) with member, keep_id and group_size; a member's digest equals its slot's byte for byte."""
    salts = index.select("shard", "salts")
    asked = rows.select("doc_id", "digest", _shard(shards)).join(salts, "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "digest")
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "seeds", "slots")

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        keep, size, member = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        if n and len(own):
            raw = b"".join(pdf["digest"])
            body = np.frombuffer(own["slots"].iloc[0], np.uint8).reshape(-1, 48)
            at = PerfectHash(np.frombuffer(own["seeds"].iloc[0], np.int64), len(body)).slots(raw)
            member = (body[at, :32] == np.frombuffer(raw, np.uint8).reshape(n, 32)).all(axis=1)
            keep, size = body[at, 32:40].copy().view(np.int64).ravel(), body[at, 40:].copy().view(np.int64).ravel()
        return pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "member": member, "keep_id": keep, "group_size": size})

    found = asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(run, "doc_id long, digest binary, member boolean, keep_id long, group_size long")
    return id_out(found, "doc_id", "keep_id")


def grouped(rows: DataFrame) -> DataFrame:
    """Distinct digests with the largest id and the number of rows; copies meet after a partial aggregate only."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


def dedup_exact(df: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, historical) for every row of df.

    Texts are equal when identical after lower-casing A-Z.  Without `history` the
    table's own distinct digests are the historical ones: each row finds its
    group's winner, the row with the largest id.  With `history` (same columns)
    rows whose text it has are removed in favour of its winner, group_size counts
    the historical rows; the others group among themselves in a second index.

    Null texts count as empty.  A null id loses to any other; in a group of null
    ids alone keep_id is null and all rows are kept, as rows with equal ids and
    texts are.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = as_table(digests(df, id_col, text_col), "digests")
    old = None
    if history is not None:
        index, shards = build_index(grouped(digests(history, id_col, text_col)))
        found = as_table(look_up(rows, index, shards), "historical")
        old = found.where("member").select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest", F.lit(True).alias("historical"))
        rows = found.where("not member").select("doc_id", "digest")
    index, shards = build_index(grouped(rows))
    found = look_up(rows, index, shards)
    new = found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", F.lit(False).alias("historical"))
    return new if old is None else new.unionByName(old)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
