"""Quality classifier: supervised subword embeddings, averaged over a document.

A word's features are its own hash bucket and those of its character n-grams (with
marks at both ends).  Their learned vectors are averaged over all features of the
document and go to a softmax over two outcomes.  As that is linear in the average,
a word adds the same to every document: scoring looks at each distinct word once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import SPACED, mix, span_hashes, word_hashes, words
from .common import arrow_map, id_in, id_out, pieces, release, text_bytes


#: Words whose features are made at a time, and bytes of text that are scored at a time.
WORDS, SCORED = 4000, 1 << 19


@dataclass(frozen=True)
class Setting:
    buckets: int = 1 << 16
    size: int = 8
    low: int = 2  # characters of the shortest and longest n-gram
    high: int = 4
    epochs: int = 6
    rate: float = 0.5
    seed: int = 11
    #: At most so many labelled rows are fitted, those with the least hash of the id,
    sample: int = 4000
    #: and at most so many bytes of their texts: a text beyond what is left is passed over.
    sample_bytes: int = 16 << 20


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each word, flat, and where each word's begin (plus the end)."""
    size = end - start
    total = int((size + 2).sum())
    head = np.cumsum(size + 2) - (size + 2)
    marked = np.full(total, 32, np.uint8)  # a space at both ends of each word
    inside = np.ones(total, bool)
    inside[head] = False
    inside[head + size + 1] = False
    pick = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    marked[inside] = buf[pick]
    letter = np.flatnonzero((marked & 0xC0) != 0x80)  # where a character begins
    own = np.searchsorted(letter, np.append(head, total))
    letter = np.append(letter, total)
    begins, ends, owner = [head], [head + size + 2], [np.arange(len(size))]
    for n in range(s.low, s.high + 1):
        count = np.maximum(np.diff(own) + 1 - n, 0)
        first = np.repeat(own[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        begins.append(letter[first])
        ends.append(letter[first + n])
        owner.append(np.repeat(np.arange(len(size)), count))
    h = np.concatenate([mix(span_hashes(marked, a, b) + np.uint64(k)) for k, (a, b) in enumerate(zip(begins, ends, strict=True))])
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return (h % np.uint64(s.buckets)).astype(np.int64)[order], np.searchsorted(who[order], np.arange(len(size) + 1))


def features(text: bytes, s: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and how often it has each: at most s.buckets of them."""
    w = words([text], SPACED)
    ids = [word_features(w.buf, w.start[a : a + WORDS], w.end[a : a + WORDS], s)[0] for a in range(0, len(w.start), WORDS)]
    count = np.bincount(np.concatenate(ids) if ids else np.zeros(0, np.int64), minlength=s.buckets)
    some = np.flatnonzero(count)
    return some, count[some]


class Model:
    def __init__(self, s: Setting):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.table = rng.uniform(-1 / s.size, 1 / s.size, (s.buckets, s.size)).astype(np.float32)
        self.out = np.zeros((s.size, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
        """Stochastic gradient descent over documents given by `features`, one at a time; the rate falls to nothing."""
        s, rng = self.s, np.random.default_rng(self.s.seed)
        prior = np.bincount(labels, minlength=2) + 1.0
        self.bias[:] = np.log(prior / prior.sum())
        steps, done = max(1, s.epochs * len(docs)), 0
        for _ in range(s.epochs):
            for k in rng.permutation(len(docs)):
                rate = s.rate * (1 - done / steps)
                done += 1
                ids, n = docs[k]
                weight = (n / np.float64(max(1, n.sum()))).astype(np.float32)
                hidden = weight @ self.table[ids]
                z = hidden @ self.out + self.bias
                p = np.exp(z - z.max())
                g = p / p.sum()
                g[labels[k]] -= 1
                back = self.out @ g
                self.out -= rate * np.outer(hidden, g)
                self.bias -= 0.1 * rate * g
                self.table[ids] -= rate * np.outer(weight, back) * np.float32(20)  # a mean spreads the step over many rows
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1."""
        each = (self.table @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)  # what a feature adds
        w = words(texts, SPACED)
        some, of = np.unique(word_hashes(w), return_index=True, return_inverse=True)[1:]
        total, count = np.zeros(len(some)), np.zeros(len(some))
        for a in range(0, len(some), WORDS):
            at = some[a : a + WORDS]
            ids, cut = word_features(w.buf, w.start[at], w.end[at], self.s)
            total[a : a + len(at)] = np.add.reduceat(each[ids], cut[:-1])
            count[a : a + len(at)] = np.diff(cut)
        owner = w.doc_of()
        sums = lambda x: np.bincount(owner, weights=x[of], minlength=len(texts))
        z = sums(total) / np.maximum(sums(count), 1) + float(self.bias[1] - self.bias[0])
        return 1 / (1 + np.exp(-z))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", setting: Setting = Setting()) -> Model:
    """A model from the rows of df that at most setting.sample labels (id_col, label_col 0 or 1) name.

    The labels drawn are those with the least hash of the id: a top-k plan over ids
    alone.  They are broadcast (setting.sample is their bound) and met with the
    lengths of their texts; rows are taken in that order while setting.sample_bytes
    last.  The texts taken become feature counts where they are, so neither a text
    nor a shuffle of texts reaches the driver.  Null ids and other labels are passed
    over; of rows alike in id and length one is fitted; without any row the model
    gives one half to every text.
    """
    good = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    drawn = good.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(setting.sample)
    texts = df.select(F.col(id_col).alias("_key"), text_bytes(text_col).alias("text"))
    named = F.col("_key") == F.col("_id")
    sizes = texts.select("_key", F.octet_length("text").alias("n")).join(F.broadcast(drawn), named).groupBy(F.xxhash64("_id").alias("h"), "_id", "_label", "n").agg(F.lit(1)).orderBy("h", "_id", "_label", "n").limit(setting.sample).collect()
    taken, left = [], setting.sample_bytes
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            taken.append((len(taken), r["_id"], r["_label"], r["n"]))
    if not taken:
        return Model(setting)
    spark = df.sparkSession
    columns = dict(zip(("k", "_id", "n"), ([t[c] for t in taken] for c in (0, 1, 3)), strict=True))
    chosen = spark.createDataFrame(pa.table(columns), f"k int, _id {drawn.schema['_id'].dataType.simpleString()}, n int")  # rows of Python's would start further workers on the executors

    ids = np.min_scalar_type(setting.buckets - 1)

    def unpacked(r) -> tuple[np.ndarray, np.ndarray]:
        some = np.frombuffer(r["ids"], ids)
        return some, np.frombuffer(r["counts"], f"u{len(r['counts']) // max(1, len(some)) or 1}")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [features(t, setting) for t in pdf["text"]]
        narrow = lambda c: c.astype(np.min_scalar_type(c.max(initial=0)))
        return pd.DataFrame({"k": pdf["k"], "ids": [x.astype(ids).tobytes() for x, _ in found], "counts": [narrow(c).tobytes() for _, c in found]})

    met = texts.join(F.broadcast(chosen), named & (F.octet_length("text") == F.col("n"))).groupBy("k").agg(F.min("text").alias("text"))
    rows = arrow_map(met, count, "k int, ids binary, counts binary").collect()
    by = {r["k"]: unpacked(r) for r in rows}
    model = Model(setting).fit([by[t[0]] for t in taken if t[0] in by], np.array([t[2] for t in taken if t[0] in by]))
    del rows, by
    release()  # the driver's, too
    return model


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row, from its whole text and nothing else.

    Null and empty texts get the score of the learned bias; null ids are kept,
    repeated rows are scored each, other columns are ignored.  No shuffle.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score = model.scores(list(pdf["text"]))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return id_out(arrow_map(df.select(id_in(id_col), text_bytes(text_col).alias("text")), run, "doc_id long, score double, predicted int"))


def keep_good(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that the model does not reject, with all their columns.

    Null and empty texts get the score of the learned bias, as in `classify`; each
    row is judged alone, repeated rows alike; an empty table stays empty.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def good(texts: pd.Series) -> pd.Series:
        parts = [model.scores(list(texts.iloc[at])) for at in pieces(texts, SCORED)]
        release()
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return df.where(good(text_bytes(text_col)) >= threshold)
