"""Substring removal by level-wise doubling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import SPACED, Words, covered, mix, pair, runs, sliding_min, window_hashes, word_hashes, words
from .common import ANSWER, SENT, answers, bucket_rows, id_out, merge, reduce_buckets, sliced


def lengths(start: int, window: int) -> list[int]:
    """start, 2 start, 4 start, ... and the window itself."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


#: Bytes of text that one task holds with its windows; a window takes some forty bytes beside its text.
SLICE = 4 << 20


def word_windows(w: Words, length: int) -> list[np.ndarray]:
    """Two hashes of each run of `length` words that share nothing: each begins with its own hash of the words."""
    return [window_hashes(lane, length) for lane in word_hashes(w, 2).T]


class Slice:
    """The windows of one slice; what the levels so far say is in `told`."""

    def __init__(self, pdf: pd.DataFrame, levels: list[int]):
        self.ids = pdf["doc_id"].to_numpy(np.int64)
        self.w: Words = words(list(pdf["text"]), SPACED)
        self.levels = levels
        self.word_doc = self.w.doc_of()
        self.left = self.w.doc[1:][self.word_doc] - np.arange(len(self.word_doc))  # words from here to the end of the text
        self.first = word_windows(self.w, levels[0])

    def owners(self, at: np.ndarray) -> np.ndarray:
        return self.ids[self.word_doc[at]]

    def _keys(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.owners(at)
        return merge(h, np.stack([ids, ids], axis=1), ("min", "max"))

    def level(self, number: int, told: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, their (least, greatest) owner here, where the windows start, and each one's key.

        Level 0 stands for every window of the next length by the least hash of
        the short windows inside it: equal long windows have equal ones, so no
        repeat is lost, and a slice sends about one key for thirteen words.
        """
        second = self.levels[min(1, len(self.levels) - 1)]
        at = np.flatnonzero(self.left >= second)
        low = mix(sliding_min(self.first[0], second - self.levels[0] + 1)[at])  # least hashes are small numbers: mixed, they deal evenly
        if number == 0:
            new = np.ones(len(at), bool)  # runs of one owner and one key need one entry
            new[1:] = (low[1:] != low[:-1]) | (self.word_doc[at[1:]] != self.word_doc[at[:-1]])
            keys, vals, of = self._keys(low[new].reshape(-1, 1), at[new])
            return keys, vals, at, of[np.cumsum(new) - 1]
        _, _, at, of = self.level(0, told)
        at = at[told[0][of] > 0]
        length, h = self.levels[0], self.first
        flagged = None
        for k in range(1, number + 1):
            step = self.levels[k] - length
            if flagged is not None:  # both halves were repeated one level below
                at = at[(self.left[at] >= self.levels[k]) & flagged[np.minimum(at + step, len(flagged) - 1)]]
            key = np.stack([pair(lane[at], lane[at + step], k) for lane in h], axis=1)
            keys, vals, of = self._keys(key, at)
            if k < number:
                hold = told[k][of] > 0
                flagged = np.zeros(len(self.left), bool)
                flagged[at[hold]] = True
                h = [np.zeros(len(self.left), np.uint64) for _ in h]
                for lane, own in zip(h, key.T, strict=True):
                    lane[at] = own
                at, length = at[hold], self.levels[k]
        return keys, vals, at, of


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, start: int = 25) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) for every row.

    Words are runs of bytes other than ASCII white space.  A word goes if a window
    of `window` words that covers it also starts in a document with a smaller id;
    windows are judged on the input.  `removed` has (start, end) word offsets,
    `kept` the other words joined by one space.

    Windows of `start` words are looked at first; only where those repeat in two
    documents are windows of twice the length hashed, and so on up to `window`.
    The first level's keys are 64 bits (a filter); later ones, the last that decides
    among them, are two 64-bit hashes that are independent from the words up.

    Null and empty texts have no words.  A row with a null id comes after all
    others: it loses what they have, and none loses words to it.  Rows with equal
    ids never lose words to each other.  Other columns are ignored.
    """
    levels = lengths(start, window)
    if len(levels) == 1:
        levels = [max(1, window // 2), window] if window > 1 else [1, 1]
    last = len(levels) - 1
    docs, buckets = sliced(df, id_col, text_col, slice_bytes=SLICE)
    flag = lambda v: (v[:, 0] != v[:, 1]).astype(np.uint8)
    least = lambda v: v[:, 0].copy()

    def said(back: pd.DataFrame, upto: int) -> list[np.ndarray]:
        return [answers(back, k, np.uint8) for k in range(upto)]

    def send(level: int, piece: int, pdf: pd.DataFrame, told: list[np.ndarray]) -> pd.DataFrame:
        keys, vals, _, _ = Slice(pdf, levels).level(level, told)
        return bucket_rows(level, piece, keys, vals, buckets)

    sent = docs.groupBy("slice").applyInPandas(lambda pdf: send(0, int(pdf["slice"].iloc[0]), pdf, []), SENT)
    back = reduce_buckets(sent, 1, ("min", "max"), flag if last else least)

    def extend(level: int):
        def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            return send(level, int(pdf["slice"].iloc[0]), pdf, said(told, level))

        return run

    for level in range(1, last + 1):
        sent = docs.groupBy("slice").cogroup(back.groupBy("slice")).applyInPandas(extend(level), SENT)
        more = reduce_buckets(sent, 2, ("min", "max"), flag if level < last else least, ANSWER)
        back = back.unionByName(more)

    def finish(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        s = Slice(pdf, levels)
        _, _, at, of = s.level(last, said(told, last))
        first = answers(told, last, np.int64)
        gone = at[first[of] < s.owners(at)]
        hit = covered(gone, levels[last], len(s.left))
        joined, w = s.w.buf.tobytes(), s.w
        out = {"doc_id": [], "n_words": [], "n_removed": [], "removed": [], "kept": []}
        for k in range(len(s.ids)):
            a, b = int(w.doc[k]), int(w.doc[k + 1])
            m = hit[a:b]
            begins, ends = runs(m)
            kept = [joined[x:y] for x, y in zip(w.start[a:b][~m].tolist(), w.end[a:b][~m].tolist(), strict=True)]
            out["doc_id"].append(int(s.ids[k]))
            out["n_words"].append(b - a)
            out["n_removed"].append(int(m.sum()))
            out["removed"].append([{"start": x, "end": y} for x, y in zip(begins.tolist(), ends.tolist(), strict=True)])
            out["kept"].append(b" ".join(kept).decode("utf-8", "replace"))
        return pd.DataFrame(out)

    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    return id_out(docs.groupBy("slice").cogroup(back.groupBy("slice")).applyInPandas(finish, schema))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
