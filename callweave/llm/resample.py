"""Importance resampling towards a target corpus: hashed n-gram features, counted in a dictionary of distinct strings."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import ALNUM_LOWER, span_hashes, words
from .common import as_table, numbered, release, small_batches, text_bytes

#: Rows in an Arrow batch, bytes of text that are counted at a time, and bytes of text for each part of the dictionary.
ROWS = 500
UNIT, PART = 8 << 20, 16 << 20
#: Strings of a part that come together before they are merged, at least, and slices of a part that are merged one after another.
STEP, SLICES = 1 << 21, 4


def units(batches: Iterator[pa.RecordBatch], most: int = UNIT) -> Iterator[pa.Table]:
    """Runs of rows with about `most` bytes of text each, put together from small batches."""
    held, size = [], 0
    for batch in batches:
        begin = 0
        for k, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
            if size and size + n > most:
                yield pa.Table.from_batches([*held, batch.slice(begin, k - begin)])
                held, size, begin = [], 0, k
            size += n
        held.append(batch.slice(begin))
    if size or any(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


@dataclass
class Grams:
    """The runs of n words of a unit of texts: the text that each is in, its string's number, and for each distinct string how often it occurs and what it is made of."""

    doc: np.ndarray
    at: np.ndarray
    often: np.ndarray
    before: np.ndarray | None  # number of the string of n - 1 words that it begins with
    last: np.ndarray  # number of its last word


def grams(texts: list[bytes], longest: int) -> tuple[np.ndarray, pa.Array, Iterator[Grams]]:
    """Words of each text, distinct words, and the runs of 1 to `longest` words inside a text."""
    w = words(texts, ALNUM_LOWER)
    doc = w.doc_of()
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(w.buf[w.buf != 32])]).dictionary_encode()
    one = coded.indices.to_numpy().astype(np.int64)

    def each() -> Iterator[Grams]:
        kinds, starts, at = len(coded.dictionary), np.arange(len(doc)), one
        yield Grams(doc, one, np.bincount(one, minlength=kinds), None, np.arange(kinds))
        for n in range(2, longest + 1):
            keep = np.flatnonzero(starts + n - 1 < len(doc))
            keep = keep[doc[starts[keep]] == doc[starts[keep] + n - 1]]
            starts = starts[keep]
            at, distinct = pd.factorize(at[keep] * kinds + one[starts + n - 1])
            yield Grams(doc[starts], at, np.bincount(at, minlength=len(distinct)), distinct // max(1, kinds), distinct % max(1, kinds))

    return w.per_doc, coded.dictionary, each()


def spelled(own: Grams, word: pa.Array, shorter: pa.Array | None) -> pa.Array:
    """The distinct strings: the words joined by one space."""
    return word if own.before is None else pc.binary_join_element_wise(shorter.take(pa.array(own.before)), word.take(pa.array(own.last)), pa.scalar(b" "))


# Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320


def _image(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit, c in enumerate(columns):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), c, np.uint32(0))
    return out


@cache
def _zeros(power: int) -> np.ndarray:
    """What 2 ** power zero bytes make of a CRC, as a table for each of its four bytes."""
    if not power:
        columns = np.array([1 << b for b in range(32)], np.uint32)
        for _ in range(8):
            columns = np.where(columns & np.uint32(1), (columns >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), columns >> np.uint32(1)).astype(np.uint32)
    else:
        half = _zeros(power - 1)[:, [1 << b for b in range(8)]].reshape(-1)  # images of the single bits
        columns = _image(half, half)
    return np.stack([_image(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def appended(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of strings from those of their beginnings and of the rest of `size` bytes."""
    out = crc.astype(np.uint32)
    for power in range(int(size.max(initial=0)).bit_length()):
        go = np.flatnonzero((size >> power) & 1)
        t, x = _zeros(power), out[go]
        out[go] = t[0][x & np.uint32(255)] ^ t[1][(x >> np.uint32(8)) & np.uint32(255)] ^ t[2][(x >> np.uint32(16)) & np.uint32(255)] ^ t[3][x >> np.uint32(24)]
    return out ^ more


def ends_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    _, ends, data = strings.buffers()
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    return np.frombuffer(ends, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def crcs(strings: pa.Array, before: bytes = b"") -> np.ndarray:
    """CRC-32 of each string, of `before` and the string."""
    ends, data = ends_of(strings)
    view, at, begin = memoryview(data), ends.tolist(), zlib.crc32(before)
    return np.fromiter((zlib.crc32(view[a:b], begin) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint32, len(strings))


_PACK, _PACK_NUMBERS = zstandard.ZstdCompressor(level=5), zstandard.ZstdCompressor(level=1)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _dealt(strings: pa.Array, n: np.ndarray, part: np.ndarray, parts: int, order: np.ndarray) -> Iterator[dict]:
    """The strings of each part, packed in the given order, with their counts."""
    order = order[np.argsort(part[order], kind="stable")]
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    n, (ends, data) = n[order], ends_of(strings.take(pa.array(order)))
    for p in np.flatnonzero(np.diff(cut)):
        a, b = cut[p], cut[p + 1]
        lens, often = _small(np.diff(ends[a : b + 1])), _small(n[a:b])
        yield {"part": int(p), "strings": int(b - a), "lens": _PACK_NUMBERS.compress(lens.tobytes()), "data": _PACK.compress(data[ends[a] : ends[b]].tobytes()), "often": _PACK_NUMBERS.compress(often.tobytes())}


def _rank(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct values, and each one's place in it."""
    order = np.argsort(x)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    return order, place


PACKED = "part int, strings int, lens binary, data binary, often binary"


def _slice_of(ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A number below SLICES that follows from the string alone: from its length, its last byte and the one in the middle."""
    size = np.diff(ends)
    some = np.flatnonzero(size)
    out = size.astype(np.uint32) * np.uint32(0x9E3779B1)
    out[some] ^= data[ends[some + 1] - 1] * np.uint32(0x85EBCA77) ^ data[ends[some] + size[some] // 2] * np.uint32(0xC2B2AE3D)
    return (out >> np.uint32(16)) % np.uint32(SLICES)


def _unpacked(row: dict, piece: int | None = None) -> pa.Table:
    """(gram, n) of a packed row, or of one slice of its strings."""
    lens, data, n = (zstandard.decompress(row[c]) for c in ("lens", "data", "often"))
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    whole = lambda x: np.frombuffer(x, kinds[len(x) // row["strings"]])
    ends = np.concatenate([[0], np.cumsum(whole(lens), dtype=np.int64)]).astype(np.int32)
    strings, n = pa.Array.from_buffers(pa.binary(), row["strings"], [None, pa.py_buffer(ends), pa.py_buffer(data)]), whole(n)
    if piece is not None:
        own = _slice_of(ends, np.frombuffer(data, np.uint8)) == piece
        strings, n = strings.filter(pa.array(own)), n[own]
    return pa.table({"gram": strings, "n": n.astype(np.int64)})


def merged(packed: pa.Table, step: int = STEP, piece: int | None = None) -> pa.Table:
    """(gram, n) of distinct strings of the packed rows of a part, or of one slice of it.

    They are merged when more have come together than are merged already, and than
    `step`, so that a string is merged a few times at most.
    """
    held, size, known = [], 0, 0
    for k in range(packed.num_rows):
        held.append(_unpacked(packed.slice(k, 1).to_pylist()[0], piece))
        size += held[-1].num_rows
        if size > max(step, known) or k == packed.num_rows - 1:
            both = pa.concat_tables(held).group_by("gram").aggregate([("n", "sum")]).rename_columns(["gram", "n"])
            held, size, known = [both], 0, both.num_rows
    return held[0] if held else pa.table({"gram": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})


def dictionary_counts(df: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of df fall into each bucket: distinct strings are counted over the whole table, and each is hashed once.

    A unit of texts sends each of its distinct strings once, packed, to the part of
    the dictionary that the string belongs to; there its counts from all units are
    added up, one slice of the part after the other, so that a task holds the
    strings of one.  What reaches the driver is one number a bucket.
    """
    texts = df.select(text_bytes(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            _, word, each = grams(unit["text"].to_pylist(), longest)
            strings, crc, rest, size = None, crcs(word), crcs(word, b" "), np.diff(ends_of(word)[0]) + 1
            order, place = _rank(pc.rank(word).to_numpy().astype(np.int64))
            begins = place
            for own in each:
                strings = spelled(own, word, strings)
                if own.before is not None:  # strings in the order of their words
                    crc = appended(crc[own.before], rest[own.last], size[own.last])
                    order, begins = _rank(begins[own.before] * len(word) + place[own.last])
                rows = list(_dealt(strings, own.often, (crc % np.uint32(parts)).astype(np.min_scalar_type(parts)), parts, order)) if len(strings) else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema({"part": pa.int32(), "strings": pa.int32(), "lens": pa.binary(), "data": pa.binary(), "often": pa.binary()}))
            release()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(buckets, np.int64)
        for piece in range(SLICES):
            for own in merged(t, piece=piece).to_batches(max_chunksize=1 << 16):
                np.add.at(total, crcs(own["gram"]) % np.uint32(buckets), own["n"].to_numpy())
            release()
        some = np.flatnonzero(total)
        return pa.table({"bucket": some, "n": total[some]})

    sums = texts.mapInArrow(send, PACKED).groupBy("part").applyInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of a bucket's share in the target to that in the source."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): a unit's distinct strings, their CRCs put together from those of their words, meet the gains of their buckets, which come back to its texts by their counts."""
    source = df.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            per_doc, word, each = grams(unit["text"].to_pylist(), longest)
            features, weight = np.zeros(len(per_doc), np.int64), np.zeros(len(per_doc), np.int64)
            crc, rest, size = crcs(word), crcs(word, b" "), np.diff(ends_of(word)[0]) + 1
            for own in each:
                crc = crc if own.before is None else appended(crc[own.before], rest[own.last], size[own.last])
                told = gain[crc % np.uint32(len(gain))][own.at] if len(crc) else own.at
                here = np.searchsorted(own.doc, np.arange(len(per_doc) + 1))
                total = np.concatenate([[0], np.cumsum(told)])
                weight += total[here[1:]] - total[here[:-1]]
                features += np.diff(here)
            yield pa.RecordBatch.from_arrays([unit["doc_id"].combine_chunks(), pa.array(per_doc.astype(np.int64)), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
            release()

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 3, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of df.

    Features are all runs of 1 to `longest` words (A-Z lower-cased; ASCII letters,
    digits and other characters beyond ASCII), repeats counted.  weight adds up
    the gains of a row's features, score adds Gumbel noise drawn from the id, and
    of the N rows with at least `least_words` words the `percent` N / 100 best get
    a rank, ties by the smaller id; the others' rank is null.  That is a draw
    without replacement in proportion to exp(weight / 1000).

    Null and empty texts have no features.  A null id draws the noise of `<seed>:`
    and comes last among equal scores; rows that are equal in id and score are
    ranked in any order, each by itself.  Other columns are ignored; an empty table
    gives an empty result, an empty target gains from smoothing alone.
    """
    with small_batches(df.sparkSession, ROWS):
        gain = gains(dictionary_counts(df, text_col, longest, buckets), dictionary_counts(target, target_text_col, longest, buckets))
        found = as_table(weights(df, gain, id_col, text_col, longest), "weights")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))
    scored = as_table(found.select("*", (F.col("weight") + noise).cast("long").alias("score"), F.monotonically_increasing_id().alias("row")), "scores")
    enough = scored.where(F.col("n_words") >= least_words).select(F.lit(0).alias("all"), "row", "score", F.col("doc_id").alias("by"))
    order = ["all", F.desc("score"), F.asc_nulls_last("by"), "row"]
    best = numbered(enough, "all", order).where(F.expr(f"at < n * {percent} div 100")).select("row", (F.col("at") + 1).alias("rank"))
    return scored.join(best, "row", "left").drop("row")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_features", "weight", "score", "rank")
