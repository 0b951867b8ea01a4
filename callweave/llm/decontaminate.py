"""Benchmark decontamination by winnowing.

Of every run of w consecutive k-grams the least hash is a fingerprint, with
w = window - k + 1: a window of `window` words has one of its own k-grams among
them, and equal windows have the same.  Documents are compared with the
benchmark's fingerprints; only windows around a common one are hashed whole and
looked up, and a hit extends over all words of its window.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import ALNUM_LOWER, Words, covered, pair, runs, sliding_min, window_hashes, word_hashes, words
from .common import ANSWER, SENT, answers, arrow_map, bucket_rows, id_in, id_out, merge, pieces, reduce_buckets, release, sliced, text_bytes

U = np.uint64
#: A benchmark of up to so many bytes is sent to the executors whole; a larger one is joined by key.
BLOCK = 8 << 20
#: Bytes of text that `clean` looks at a time.
CLEANED = 1 << 19
#: Bytes of text that a task of the join by key holds.
SLICE = 4 << 20
SCHEMA = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<long>"


def gram(window: int) -> int:
    """Words of a fingerprinted gram: half the window."""
    return max(1, window // 2)


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` word hashes the least hash of its grams."""
    k = gram(window)
    return sliding_min(window_hashes(h, k), window - k + 1)


def starts_of(per_doc: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n words lie inside one text."""
    left = np.repeat(doc[1:], per_doc) - np.arange(int(per_doc.sum()))
    return np.flatnonzero(left >= n)


def item_windows(w: Words, window: int) -> dict[int, np.ndarray]:
    """Starts of the windows of each length: `window`, or all words of a shorter item."""
    n = w.per_doc
    out = {m: w.doc[:-1][n == m] for m in range(1, window) if (n == m).any()}
    full = starts_of(n, w.doc, window)
    return out | ({window: full} if len(full) else {})


def flattened(w: Words) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and where each begins (plus the end)."""
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(at[-1]), 32, np.uint8)
    place = np.repeat(at[:-1] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat[place] = w.buf[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return flat.tobytes(), at


@dataclass
class Windows:
    """All windows of one length of the benchmark; an entry for each window text and item."""

    length: int
    marks: np.ndarray  # sorted distinct fingerprints
    keys: np.ndarray  # sorted hashes of the entries
    begin: np.ndarray  # an entry's first byte in the benchmark's flat text, and the end
    end: np.ndarray
    item: np.ndarray


@dataclass
class Index:
    flat: bytes
    windows: list[Windows]


def index(items: list[tuple[int, bytes]], window: int = 10) -> Index:
    """The windows of all items as arrays: some sixty bytes for each word of the benchmark."""
    w = words([t for _, t in items], ALNUM_LOWER)
    lanes, doc = word_hashes(w, 2).T, w.doc_of()
    ids = np.array([k for k, _ in items], np.int64)
    flat, at = flattened(w)
    out = []
    for n, first in item_windows(w, window).items():
        one, two = (window_hashes(lane, n)[first] for lane in lanes)
        own = ids[doc[first]]
        order = np.lexsort((own, two, one))
        one, two, own, first = one[order], two[order], own[order], first[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (own[1:] != own[:-1])
        first = first[new]
        out.append(Windows(n, np.unique(winnow(lanes[0], n)[first]), one[new], at[first], at[first + n], own[new]))
    return Index(flat, out)


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def hits(texts: list[bytes], benchmark: Index) -> tuple[Words, np.ndarray, list[set[int]]]:
    """Which words lie in an occurrence of a window, and each text's items; words are compared, not only hashes."""
    w = words(texts, ALNUM_LOWER)
    h, doc = word_hashes(w), w.doc_of()
    hit = np.zeros(len(h), bool)
    items: list[set[int]] = [set() for _ in texts]
    flat = None
    for b in benchmark.windows:
        near = starts_of(w.per_doc, w.doc, b.length)
        if len(near):
            near = near[_among(winnow(h, b.length)[near], b.marks)]
        if not len(near):
            continue
        key = window_hashes(h, b.length)[near]
        low, high = np.searchsorted(b.keys, key), np.searchsorted(b.keys, key, "right")
        some = np.flatnonzero(high > low)
        if flat is None and len(some):
            flat, at = flattened(w)
        sure = []
        for p, x, y in zip(near[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            text = flat[at[p] : at[p + b.length]]
            for e in range(x, y):
                if benchmark.flat[b.begin[e] : b.end[e]] == text:
                    sure.append(p)
                    items[doc[p]].add(int(b.item[e]))
        hit |= covered(np.array(sure, np.int64), b.length, len(h))
    return w, hit, items


def _rows(ids, w: Words, hit: np.ndarray, items: list[set[int]]) -> pd.DataFrame:
    spans = []
    count = np.concatenate([[0], np.cumsum(hit)])
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        begins, ends = runs(hit[a:b]) if count[b] > count[a] else ((), ())
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(begins, ends, strict=True)])
    return pd.DataFrame({"doc_id": ids, "n_words": w.per_doc, "hits": spans, "items": [sorted(x) for x in items]})


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item"), text_bytes(text_col).alias("text")).where("item is not null")


def _fits(items: DataFrame, most: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0) <= most


def _collected(items: DataFrame, window: int) -> Index:
    return index([(r["item"], bytes(r["text"])) for r in items.orderBy("item", "text").collect()], window)


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, hits, items) for every row of df.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
    lower-cased.  A window is `window` consecutive words of an item, or all words
    of a shorter one that is not empty.  `hits` are the (start, end) word ranges
    inside occurrences of windows, `items` the sorted ids of the items they are
    from.  Every occurrence is found.

    A benchmark of at most block_bytes (its size is measured first) goes to the
    executors whole, as arrays, without a shuffle, and words are compared.  A larger
    one never passes the driver: fingerprints, then windows, of both tables meet
    by key, each distinct one once from a slice; there two independent 64-bit
    hashes of the window's words decide.

    Null and empty texts have no words; items without words, or with a null id,
    are not looked for; an id that several items share is reported once.  Null
    doc_ids are kept, repeated rows are reported each; other columns are ignored.
    """
    items = _items(benchmark, item_col, item_text_col)
    if not _fits(items, block_bytes):
        return id_out(_by_key(df, items, id_col, text_col, window).drop("text_key"))
    known = _collected(items, window)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows(pdf["doc_id"], *hits(list(pdf["text"]), known))

    return id_out(arrow_map(df.select(id_in(id_col), text_bytes(text_col).alias("text")), run, SCHEMA))


class _Keys:
    """Fingerprints and window keys of one slice of either table, told apart by the window's length."""

    def __init__(self, texts: list[bytes]):
        self.w = words(texts, ALNUM_LOWER)
        self.lanes = word_hashes(self.w, 2).T

    def marks(self, n: int, at: np.ndarray) -> np.ndarray:
        return pair(winnow(self.lanes[0], n)[at], np.full(len(at), n, np.uint64))

    def windows(self, n: int, at: np.ndarray) -> np.ndarray:
        return np.stack([pair(window_hashes(lane, n)[at], np.full(len(at), n, np.uint64)) for lane in self.lanes], axis=1)


def _distinct(parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts in order, and each entry's number among them."""
    both = np.concatenate(parts).reshape(-1, width) if parts else np.zeros((0, width), np.uint64)
    keys, _, number = merge(both, np.zeros((len(both), 1), np.int64), ("max",))
    return keys, number


def _by_key(df: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Contamination by two exchanges of distinct keys; also gives text_key, the SHA-256 of the row's text."""
    docs, buckets = sliced(df, id_col, text_col, slice_bytes=SLICE)
    bench, _ = sliced(items, "item", "text", slice_bytes=SLICE)
    lengths = [r["n"] for r in bench.groupBy("slice").applyInPandas(lambda pdf: pd.DataFrame({"n": sorted(item_windows(words(list(pdf["text"]), ALNUM_LOWER), window))}, dtype="int32"), "n int").distinct().collect()]  # at most `window` rows

    def doc_starts(k: _Keys) -> list[tuple[int, np.ndarray]]:
        return [(n, starts_of(k.w.per_doc, k.w.doc, n)) for n in sorted(lengths)]

    def send_marks(pdf: pd.DataFrame) -> pd.DataFrame:
        k = _Keys(list(pdf["text"]))
        keys, _ = _distinct([k.marks(n, at) for n, at in doc_starts(k)], 1)
        return bucket_rows(0, int(pdf["slice"].iloc[0]), keys, np.zeros((len(keys), 1), np.int64), buckets)

    def bench_marks(pdf: pd.DataFrame) -> pd.DataFrame:
        k = _Keys(list(pdf["text"]))
        keys, _ = _distinct([k.marks(n, at) for n, at in item_windows(k.w, window).items()], 1)
        return bucket_rows(0, -1 - int(pdf["slice"].iloc[0]), keys, np.ones((len(keys), 1), np.int64), buckets)

    sent = docs.groupBy("slice").applyInPandas(send_marks, SENT).unionByName(bench.groupBy("slice").applyInPandas(bench_marks, SENT))
    told = reduce_buckets(sent, 1, ("max",), lambda v: v[:, 0].astype(np.uint8)).where("slice >= 0")

    def near(k: _Keys, back: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
        starts = doc_starts(k)
        _, number = _distinct([k.marks(n, at) for n, at in starts], 1)
        known = answers(back, 0, np.uint8)[number] if len(number) else number
        cut = np.cumsum([0] + [len(at) for _, at in starts])
        return [(n, at[known[a:b] > 0]) for (n, at), a, b in zip(starts, cut[:-1], cut[1:], strict=True)]

    def send_windows(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        k = _Keys(list(pdf["text"]))
        keys, _ = _distinct([k.windows(n, at) for n, at in near(k, back)], 2)
        return bucket_rows(1, int(pdf["slice"].iloc[0]), keys, np.zeros((len(keys), 0), np.int64), buckets)

    def bench_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        k = _Keys(list(pdf["text"]))
        ids, doc = pdf["doc_id"].to_numpy(np.int64), k.w.doc_of()
        some = list(item_windows(k.w, window).items())
        keys = np.concatenate([k.windows(n, at) for n, at in some]) if some else np.zeros((0, 2), np.uint64)
        own = np.concatenate([ids[doc[at]] for _, at in some]) if some else np.zeros(0, np.int64)
        rows, _ = _distinct([np.column_stack([keys, own.view(np.uint64)])], 3)
        return bucket_rows(1, -1, rows[:, :2], rows[:, 2:].view(np.int64), buckets)

    def found(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in known["keys"]]) if len(known) else np.zeros((0, 2), np.uint64)
        own = np.concatenate([np.frombuffer(b, np.int64) for b in known["vals"]]) if len(known) else np.zeros(0, np.int64)
        uniq, number = _distinct([keys], 2)
        order = np.argsort(number, kind="stable")
        own, cut = own[order], np.searchsorted(number[order], np.arange(len(uniq) + 1))
        place = {k: j for j, k in enumerate(map(bytes, uniq))}
        out = []
        for r in asked.itertuples():
            lists = []
            for key in np.frombuffer(r.keys, np.uint64).reshape(-1, 2):
                j = place.get(bytes(key))
                lists.append(np.unique(own[cut[j] : cut[j + 1]]) if j is not None else own[:0])
            counts = np.array([len(x) for x in lists], np.int64)
            out.append((r.level, r.slice, r.bucket, counts.tobytes(), np.concatenate(lists).tobytes() if lists else b""))
        return pd.DataFrame(out, columns=["level", "slice", "bucket", "vals", "own"])

    by = lambda x: x.groupBy("slice")
    asked = by(docs).cogroup(by(told)).applyInPandas(send_windows, SENT)
    there = bench.groupBy("slice").applyInPandas(bench_windows, SENT)
    lists = asked.groupBy("bucket").cogroup(there.groupBy("bucket")).applyInPandas(found, ANSWER + ", own binary")
    back = told.withColumn("own", F.lit(None).cast("binary")).unionByName(lists)

    def finish(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        k = _Keys(list(pdf["text"]))
        doc, hit = k.w.doc_of(), np.zeros(len(k.lanes[0]), bool)
        items: list[set[int]] = [set() for _ in range(len(pdf))]
        some = near(k, back)
        _, number = _distinct([k.windows(n, at) for n, at in some], 2)
        counts = answers(back, 1, np.int64)
        own = [np.frombuffer(b, np.int64) for b in back[back["level"] == 1].sort_values("bucket")["own"]]
        own, cut = np.concatenate(own) if own else counts, np.concatenate([[0], np.cumsum(counts)])
        begin = 0
        for n, at in some:
            mine = number[begin : begin + len(at)]
            begin += len(at)
            sure = np.flatnonzero(counts[mine] > 0) if len(at) else mine
            hit |= covered(at[sure], n, len(hit))
            for p, j in zip(at[sure].tolist(), mine[sure].tolist(), strict=True):
                items[doc[p]].update(own[cut[j] : cut[j + 1]].tolist())
        out = _rows(pdf["doc_id"], k.w, hit, items)
        out["text_key"] = [hashlib.sha256(t).digest() for t in pdf["text"]]
        return out

    return by(docs).cogroup(by(back)).applyInPandas(finish, SCHEMA + ", text_key binary")


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, block_bytes: int = BLOCK) -> DataFrame:
    """The rows of df without any window of the benchmark, with all their columns.

    Rows are judged by their text alone, as in `find_contamination`: null and empty
    texts stay, repeated rows stay or go together, an empty benchmark keeps all.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    items = _items(benchmark, "item_id", "text")
    if not _fits(items, block_bytes):
        texts = df.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
        gone = _by_key(texts, items, "id", "text", window).where(F.size("hits") > 0).select("text_key").distinct()
        key = F.unhex(F.sha2(text_bytes(text_col), 256))
        return df.join(gone, key == F.col("text_key"), "left_anti")
    known = _collected(items, window)

    @pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0, bool)]
        for at in pieces(texts, CLEANED):
            w, hit, _ = hits(list(texts.iloc[at]), known)
            count = np.concatenate([[0], np.cumsum(hit)])
            out.append(count[w.doc[1:]] == count[w.doc[:-1]])
        release()
        return pd.Series(np.concatenate(out))

    return df.where(free(text_bytes(text_col)))


def digest(df: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return df.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
