"""Log-bilinear language model: trained by noise-contrastive estimation, scored with normalised probabilities.

A word is predicted from the vectors of the word before it, the one before that,
and the mean of the last `span` words of its text:

    p = R[a] * C0 + R[b] * C1 + mean(R[...]) * C2

in two steps, of a group and of a class in the group, each a softmax over
products with p.  The number of classes grows with the square root of the
distinct words, that of groups with its root, so that a token's cost grows far
slower than the corpus.  Frequent words are groups or classes of their own; the
others share classes by a hash, and inside one a word has its smoothed share of
the corpus counts.  The probabilities of all words sum to one.

Counts come from every training text, and every training text is trained on.  The
unit of training is a fixed part of a fixed slice of the corpus: units begin a
round at the same parameters, their steps are averaged parameter row by parameter
row over the units that touched it (in whole numbers, so that no order of adding
shows), and the next round begins there.  Neither partitions nor their order enter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesvec import SPACED_LOWER, word_hashes, words
from .common import ANSWER, SENT, answers, as_table, bucket_rows, id_out, merge, reduce_buckets, sliced

U = np.uint64
#: The class of a text's end.
END = 0
#: The key of a text's end among the word hashes.
END_KEY = np.array([0x0E2D0E2D0E2D0E2D, 0x1D0C1D0C1D0C1D0C], U)
#: Cells of the hash range by which the smoothed counts of rare words reach the driver.
CELLS = 1 << 18
#: Parameter steps are added up in units of 1 / SCALE.
SCALE = 1 << 24


@dataclass(frozen=True)
class Setting:
    #: Classes for a vocabulary of V words: this times the square root of V, rounded up to a power of two.
    spread: int = 2
    size: int = 8
    span: int = 32
    noise: int = 32
    inner_noise: int = 2
    batch: int = 2048
    rate: float = 0.2
    rounds: int = 6
    seed: int = 7


@dataclass(frozen=True)
class Shape:
    """Groups 0 .. single-1 are one frequent word each; the others have `members` classes, `named` of them one word each."""

    single: int
    multi: int
    members: int
    named: int

    @classmethod
    def of(cls, kinds: int, spread: int) -> Shape:
        bits = max(6, math.ceil(math.log2(spread * math.sqrt(max(kinds, 1)))))
        single = multi = 1 << (bits // 2)
        members = max(2, (1 << bits) // multi)
        return cls(single, multi, members, members // 2)

    @property
    def groups(self) -> int:
        return self.single + self.multi

    @property
    def classes(self) -> int:
        return self.single + self.multi * self.members

    @property
    def words(self) -> int:
        """Words with a class of their own."""
        return self.single + self.multi * self.named

    def class_of_rank(self, rank: np.ndarray) -> np.ndarray:
        k = rank - self.single
        return np.where(k < 0, rank, self.single + (k % self.multi) * self.members + k // self.multi)

    def class_of_cell(self, cell: np.ndarray) -> np.ndarray:
        rest = self.members - self.named
        k = cell * (self.multi * rest) // CELLS
        return self.single + (k % self.multi) * self.members + self.named + k // self.multi


def cell_of(keys: np.ndarray) -> np.ndarray:
    return (keys[:, 0] >> U(46)).astype(np.int64)


@dataclass
class Vocabulary:
    shape: Shape
    keys: np.ndarray  # first hashes of the words with classes of their own, sorted
    of_key: np.ndarray  # their classes
    mass: np.ndarray  # smoothed counts of each class
    total: int  # N: training tokens
    kinds: int  # V: distinct training tokens

    def classes_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and whether the word is alone in its class."""
        at = np.minimum(np.searchsorted(self.keys, keys[:, 0]), len(self.keys) - 1)
        own = self.keys[at] == keys[:, 0]
        return np.where(own, self.of_key[at], self.shape.class_of_cell(cell_of(keys))), own


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (two each) of all words, an end after each text; and where each text's tokens begin."""
    w = words(texts, SPACED_LOWER)
    h = np.insert(word_hashes(w, 2), w.doc[1:], END_KEY, axis=0)
    return h, w.doc + np.arange(len(w.doc))


def log_sum(z: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; overwrites z."""
    top = z.max(axis=1)
    z -= top[:, None]
    np.exp(z, out=z)
    return top + np.log(z.sum(axis=1))


class Model:
    def __init__(self, s: Setting, shape: Shape, mass: np.ndarray):
        rng = np.random.default_rng(s.seed)
        k, g, d = shape.classes, shape.groups, s.size
        share = mass / mass.sum()
        self.s, self.shape = s, shape
        self.group = np.concatenate([np.arange(shape.single), shape.single + np.arange(shape.multi * shape.members) // shape.members])
        outer = np.bincount(self.group, weights=share, minlength=g)
        inner = share / outer[self.group]
        self.log_outer, self.log_inner = np.log(s.noise * outer).astype(np.float32), np.log(s.inner_noise * inner).astype(np.float32)
        self.cdf = np.cumsum(outer)
        flat = inner[shape.single :].reshape(shape.multi, shape.members)
        self.inner_cdf = (np.cumsum(flat, axis=1) / flat.sum(axis=1, keepdims=True) + np.arange(shape.multi)[:, None]).ravel()
        self.r = rng.normal(0, 0.3, (k, d)).astype(np.float32)
        self.c = np.ones((3, d), np.float32)
        self.c[1] = 0.5
        self.q = np.column_stack([rng.normal(0, 0.05, (g, d)), np.log(outer)]).astype(np.float32)  # the last column is the bias
        self.v = np.column_stack([rng.normal(0, 0.05, (k, d)), np.log(inner)]).astype(np.float32)
        self.grown = [np.zeros_like(p) for p in (self.r, self.c, self.q, self.v)]  # Adagrad's sums

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.v, *self.grown]

    @property
    def rows(self) -> int:
        return sum(len(p) for p in self.parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def spread_rows(self, per_row: list[np.ndarray]) -> np.ndarray:
        """One number a row of r, c, q, v to one a parameter, Adagrad's sums included."""
        return np.concatenate([np.repeat(n, p.shape[1]) for n, p in zip(per_row * 2, self.parts, strict=True)])

    def look_back(self, c: np.ndarray, first: np.ndarray, a: int, b: int):
        """p of tokens a .. b, and what the gradient needs: `first` is the place of each token's text."""
        span = self.s.span
        low = max(0, a - span)
        e = self.r[c[low:b]]
        sums = np.zeros((len(e) + 1, e.shape[1]), np.float32)
        np.cumsum(e, axis=0, out=sums[1:])
        t = np.arange(a, b) - low
        since = first[a:b] - low
        left = np.maximum(since, t - span)
        share = (1 / np.maximum(t - left, 1)).astype(np.float32)[:, None]
        one, two = t > since, t > since + 1
        end = self.r[END]
        x, y = np.where(one[:, None], e[t - 1], end), np.where(two[:, None], e[t - 2], end)
        bag = (sums[t] - sums[left]) * share
        return x * self.c[0] + y * self.c[1] + bag * self.c[2], (low, t, left, share, one, two, x, y, bag)

    def log_probs(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logs of the classes' probabilities; exact sums over groups, and over the classes of the group."""
        out, shape = np.empty(len(c)), self.shape
        outer, bias = np.ascontiguousarray(self.q[:, :-1].T), self.q[:, -1]
        for a in range(0, len(c), 32768):
            own = c[a : a + 32768]
            g = self.group[own]
            p = np.empty((len(own), self.s.size), np.float32)
            best = np.empty(len(own), np.float32)
            for b in range(0, len(own), 1024):  # so many rows of products stay in the cache
                x, _ = self.look_back(c, first, a + b, a + min(b + 1024, len(own)))
                p[b : b + len(x)] = x
                z = x @ outer
                z += bias
                best[b : b + len(x)] = z[np.arange(len(x)), g[b : b + len(x)]] - log_sum(z)
            order = np.argsort(g, kind="stable")
            order = order[g[order] >= shape.single]
            for run in np.split(order, np.flatnonzero(np.diff(g[order])) + 1) if len(order) else []:
                low = shape.single + (int(g[run[0]]) - shape.single) * shape.members
                v = self.v[low : low + shape.members]
                z = p[run] @ v[:, :-1].T
                z += v[:, -1]
                best[run] += z[np.arange(len(run)), own[run] - low] - log_sum(z)
            out[a : a + len(own)] = best
        return out

    def step(self, k: int, rows, g: np.ndarray) -> None:
        param, acc = self.parts[k], self.grown[k]
        acc[rows] += g * g
        param[rows] += self.s.rate * g / np.sqrt(acc[rows] + np.float32(1e-6))

    def train(self, c: np.ndarray, first: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        """One pass of noise-contrastive steps over texts; returns how often each row of r, c, q, v took part."""
        s, shape = self.s, self.shape
        drawn = np.zeros(shape.classes, np.int64)
        for a in range(0, len(c), s.batch):
            own = c[a : a + s.batch]
            n = len(own)
            p, (low, t, left, share, one, two, x, y, bag) = self.look_back(c, first, a, a + n)
            g = self.group[own]
            noise = np.minimum(np.searchsorted(self.cdf, rng.random(s.noise) * self.cdf[-1]), shape.groups - 1)
            q, far = self.q[g], self.q[noise]
            up = 1 / (1 + np.exp(np.einsum("ij,ij->i", p, q[:, :-1]) + q[:, -1] - self.log_outer[g]))
            down = -1 / (1 + np.exp(-(p @ far[:, :-1].T + far[:, -1] - self.log_outer[noise])))
            gp = up[:, None] * q[:, :-1] + down @ far[:, :-1]
            gq = np.zeros_like(self.q)
            ids, sums = by_row(g, np.column_stack([up[:, None] * p, up]))
            gq[ids] = sums
            np.add.at(gq, noise, np.column_stack([down.T @ p, down.sum(axis=0)]))

            inside = np.flatnonzero(g >= shape.single)
            if len(inside):
                w, pi = own[inside], p[inside]
                u = rng.random((len(inside), s.inner_noise))
                other = shape.single + np.minimum(np.searchsorted(self.inner_cdf, u + (g[inside] - shape.single)[:, None]), shape.multi * shape.members - 1)
                drawn += np.bincount(other.ravel(), minlength=shape.classes)
                v, far = self.v[w], self.v[other]
                up = 1 / (1 + np.exp(np.einsum("ij,ij->i", pi, v[:, :-1]) + v[:, -1] - self.log_inner[w]))
                down = -1 / (1 + np.exp(-(np.einsum("ij,ikj->ik", pi, far[:, :, :-1]) + far[:, :, -1] - self.log_inner[other])))
                gp[inside] += up[:, None] * v[:, :-1] + np.einsum("ik,ikj->ij", down, far[:, :, :-1])
                wide = np.column_stack([pi, np.ones(len(pi), np.float32)])
                gv = np.concatenate([up[:, None] * wide, (down[:, :, None] * wide[:, None, :]).reshape(-1, wide.shape[1])])
                ids, sums = by_row(np.concatenate([w, other.ravel()]), gv)
                self.step(3, ids, sums / n)
            self.step(2, slice(None), gq / n)

            ge = np.zeros((len(c[low : a + n]) + 1, s.size), np.float32)
            gb = gp * self.c[2] * share
            begins = np.flatnonzero(np.diff(left, prepend=-1))
            ge[left[begins]] += np.add.reduceat(gb, begins)
            ge[t] -= gb
            ge = np.cumsum(ge, axis=0)[:-1]
            gx, gy = gp * self.c[0], gp * self.c[1]
            ge[t[one] - 1] += gx[one]
            ge[t[two] - 2] += gy[two]
            at_end = gx[~one].sum(axis=0) + gy[~two].sum(axis=0)
            ids, sums = by_row(np.append(c[low : a + n], END), np.vstack([ge, at_end]))
            gc = np.stack([(gp * x).sum(axis=0), (gp * y).sum(axis=0), (gp * bag).sum(axis=0)])
            self.step(0, ids, sums / n)
            self.step(1, slice(None), gc / n)
        met = np.bincount(c, minlength=shape.classes)
        n = len(c)
        return [met, np.full(3, n), np.full(shape.groups, n), met + drawn]


def by_row(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return own[first], np.add.reduceat(values[order], first)


def count_words(docs: DataFrame, buckets: int, spread: int) -> DataFrame:
    """Each slice's words with their training counts, by bucket; rows with slice -1 sum up a bucket.

    Such a row has the bucket's tokens, its distinct words, its most frequent ones
    (four times its even share of the words that get classes, and 512), and the
    smoothed counts of its words by cell of the hash range.
    """

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        h, begin = tokens(list(pdf["text"]))
        learn = np.repeat(~pdf["held_out"].to_numpy(bool), np.diff(begin)).astype(np.int64)
        keys, vals, _ = merge(h, learn.reshape(-1, 1), ("sum",))
        return bucket_rows(0, int(pdf["slice"].iloc[0]), keys, vals, buckets)

    def whole(keys: np.ndarray, vals: np.ndarray) -> dict:
        c = vals[:, 0]
        seen = np.flatnonzero(c > 0)
        own = Shape.of(len(seen) * buckets, spread).words
        best = seen[np.lexsort((keys[seen, 1], keys[seen, 0], -c[seen]))[: 512 + 4 * own // buckets]]
        cell = cell_of(keys[seen])
        low = int(cell[0]) if len(seen) else 0  # keys are in order, cells too
        mass = np.bincount(cell - low, weights=(c[seen] + 1).astype(float)).astype(np.int64) if len(seen) else np.zeros(0, np.int64)
        return {"tokens": int(c.sum()), "kinds": len(seen), "top": keys[best, 0].astype(np.int64).tolist(), "counts": c[best].tolist(), "cell": low, "mass": mass.tobytes()}

    schema = ANSWER + ", tokens long, kinds long, top array<long>, counts array<long>, cell long, mass binary"
    return as_table(reduce_buckets(docs.groupBy("slice").applyInPandas(send, SENT), 2, ("sum",), lambda v: v[:, 0].copy(), schema, whole), "word-counts")


def vocabulary(counts: DataFrame, spread: int) -> Vocabulary:
    """Classes for the words of all buckets; what reaches the driver grows with the root of the distinct words, and CELLS sums."""
    whole = counts.where("slice = -1")
    sums = whole.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    total, kinds = int(sums["n"] or 0), int(sums["v"] or 0)
    shape = Shape.of(kinds, spread)
    best = whole.select(F.inline(F.arrays_zip("top", "counts"))).orderBy(F.desc("counts"), "top").limit(shape.words).collect()
    freq = {int(r["top"]) % (1 << 64): r["counts"] for r in best}
    end = int(END_KEY[0])
    ranked = [(end, freq.pop(end, 0)), *sorted(freq.items(), key=lambda x: (-x[1], x[0]))][: shape.words]
    keys, own = np.array([k for k, _ in ranked], U), np.array([c for _, c in ranked], np.int64)
    classes = shape.class_of_rank(np.arange(len(ranked)))
    cells = np.zeros(CELLS, np.int64)
    for r in whole.where("kinds > 0").select("cell", "mass").toLocalIterator():
        part = np.frombuffer(r["mass"], np.int64)
        cells[r["cell"] : r["cell"] + len(part)] += part
    at = cell_of(keys.reshape(-1, 1))
    np.subtract.at(cells, at[own > 0], own[own > 0] + 1)
    mass = np.bincount(shape.class_of_cell(np.arange(CELLS)), weights=cells.astype(float), minlength=shape.classes) + 1  # one for words not seen
    mass[: shape.single] = 1
    mass[classes] = own + 1.0
    order = np.argsort(keys)
    return Vocabulary(shape, keys[order], classes[order], mass, total, kinds)


#: A unit: texts of one slice that train in one round, as classes of their tokens; and what needs no model.
UNIT = "slice int, round int, learn long, doc_id binary, held_out binary, begin binary, classes binary, known binary, base binary, inside binary"


def encode(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, s: Setting) -> DataFrame:
    def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[f.split()[0] for f in UNIT.split(", ")])
        pdf = pdf.sort_values(["doc_id", "text"], ignore_index=True)
        piece = int(pdf["slice"].iloc[0])
        h, begin = tokens(list(pdf["text"]))
        keys, _, of = merge(h, np.zeros((len(h), 1), np.int64), ("max",))
        count = answers(told, 0, np.int64)
        cls, own = vocab.classes_of(keys)
        base = np.log10((count + 1) / (vocab.total + vocab.kinds + 1))
        inside = np.where(own, 0, np.log10((count + 1) / vocab.mass[cls]))
        add = lambda x: np.add.reduceat(x[of], begin[:-1])
        each = pd.DataFrame({"known": add((count > 0).astype(np.int64)), "base": add(base), "inside": add(inside)})
        cls = cls[of].astype(np.int32)
        held, ids = pdf["held_out"].to_numpy(bool), pdf["doc_id"].to_numpy(np.int64)
        dealt = np.random.default_rng([s.seed, piece]).permutation(len(pdf))
        rows = []
        for r in range(s.rounds):
            at = dealt[r :: s.rounds]
            if not len(at):
                continue
            size = (begin[1:] - begin[:-1])[at]
            own = np.concatenate([cls[begin[k] : begin[k + 1]] for k in at])
            rows.append((piece, r, int(size[~held[at]].sum()), ids[at].tobytes(), held[at].tobytes(), np.concatenate([[0], np.cumsum(size)]).tobytes(), own.tobytes(), *[each[c].to_numpy()[at].tobytes() for c in each]))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in UNIT.split(", ")])

    back = counts.where("slice >= 0").select("level", "slice", "bucket", "vals")
    return as_table(docs.groupBy("slice").cogroup(back.groupBy("slice")).applyInPandas(run, UNIT), "lm-units")


def first_of(begin: np.ndarray) -> np.ndarray:
    return np.repeat(begin[:-1], np.diff(begin))


def learned(row) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a unit's training texts, and the place of each token's text."""
    begin, held = np.frombuffer(row.begin, np.int64), np.frombuffer(row.held_out, bool)
    size = np.diff(begin)
    c = np.frombuffer(row.classes, np.int32)[~np.repeat(held, size)]
    return c, first_of(np.concatenate([[0], np.cumsum(size[~held])]))


def trained_unit(row, base: Model, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A unit's steps from the round's parameters times its weights, and the weights, both in whole numbers."""
    model = base.load(flat)
    times = model.train(*learned(row), np.random.default_rng([base.s.seed, row.slice, row.round]))
    weight = model.spread_rows([np.ceil(np.sqrt(n)).astype(np.int64) for n in times])
    return np.rint((model.flat().astype(np.float64) - flat) * weight * SCALE).astype(np.int64), weight


def train(units: DataFrame, vocab: Vocabulary, s: Setting) -> Model:
    """Rounds of training; a round's sums are added by task, then by block of parameters, and one model's size reaches the driver."""
    model, blocks = Model(s, vocab.shape, vocab.mass), 8
    schema = "part int, block int, steps binary, weights binary"

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, weights = (sum(np.frombuffer(b, np.int64) for b in pdf[c]) for c in ("steps", "weights"))
        return pd.DataFrame([{"part": 0, "block": int(pdf["block"].iloc[0]), "steps": steps.tobytes(), "weights": weights.tobytes()}])

    for number in range(s.rounds):
        now = model.flat()

        def local(it: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            own, total, key = Model(s, vocab.shape, vocab.mass), None, 0
            for pdf in it:
                for row in pdf.itertuples():
                    steps, weight = trained_unit(row, own, now)
                    if total is None:
                        total, key = [steps, weight], row.slice
                    else:
                        total[0] += steps
                        total[1] += weight
            if total:
                cut = [np.array_split(x, blocks) for x in total]
                yield pd.DataFrame([{"part": key, "block": k, "steps": cut[0][k].tobytes(), "weights": cut[1][k].tobytes()} for k in range(blocks)])

        told = units.where((F.col("round") == number) & (F.col("learn") > 0)).select("slice", "round", "held_out", "begin", "classes").mapInPandas(local, schema)
        told = told.groupBy("block", F.pmod("part", F.lit(64))).applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
        rows = sorted(told.collect(), key=lambda r: r["block"])
        if rows:
            steps, weights = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("steps", "weights"))
            model.load((now + steps / (np.maximum(weights, 1) * float(SCALE))).astype(np.float32))
    return model


def score_texts(df: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", setting: Setting = Setting()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, and
    one end a text.  The rows where held_out is not true are learned from; all are
    scored.  base_score is the add-one unigram's log10 probability, score the
    model's.  n_known counts tokens that the training rows have.

    Words are told apart by 128-bit hashes.  Scores follow from the rows alone, not
    from their partitions.  Null and empty texts are an end alone; null ids are kept,
    null held_out counts as false, repeated rows count each time, other columns are
    ignored.  Without any training token every token's base probability is 1.
    """
    flag = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    docs, buckets = sliced(df, id_col, text_col, {"held_out": flag})
    counts = count_words(docs, buckets, setting.spread)
    vocab = vocabulary(counts, setting.spread)
    units = encode(docs, counts, vocab, setting)
    model = train(units, vocab, setting)

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                begin = np.frombuffer(row.begin, np.int64)
                p = model.log_probs(np.frombuffer(row.classes, np.int32), first_of(begin)) / math.log(10)
                read = lambda b, t: np.frombuffer(b, t)
                yield pd.DataFrame(
                    {
                        "doc_id": read(row.doc_id, np.int64),
                        "held_out": read(row.held_out, bool),
                        "n_tokens": np.diff(begin),
                        "n_known": read(row.known, np.int64),
                        "train_tokens": vocab.total,
                        "base_score": read(row.base, np.float64),
                        "score": np.add.reduceat(p, begin[:-1]) + read(row.inside, np.float64),
                    }
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return id_out(units.mapInPandas(score, schema))
