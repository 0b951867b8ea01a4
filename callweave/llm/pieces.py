"""Subword encoding and decoding by suffix-array matching.

For a batch, the distinct words of all texts are put in a row and suffix-sorted; each
piece of the vocabulary finds its occurrences as a range by binary search, and the
occurrences, put in order of position, are the edges over which a word is relaxed
to its segmentation.  A BPE vocabulary has no additive score, so the relaxation is
its own: of all edges that join two neighbouring symbols the best-ranked, leftmost
one is taken, until none is left.  All words of a batch take their step together.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import span_hashes
from .common import id_in, id_out, release, text_bytes

GAP = 0x2581  # stands for a space inside pieces
#: Symbols of a word up to which all words step together; longer words are relaxed singly.
LONG = 48


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


@dataclass
class Vocabulary:
    text: np.ndarray  # code points of all pieces, flat
    at: np.ndarray  # where each piece begins, plus the end
    rank: np.ndarray  # 0 is merged first; equal scores share a rank
    normal: np.ndarray  # whether a piece can be matched
    byte_id: np.ndarray  # ids of the 256 byte pieces
    raw: list[bytes]  # what an id decodes to
    symbols: np.ndarray | None = None  # the text in the encoder's alphabet

    @property
    def longest(self) -> int:
        return int(np.diff(self.at).max(initial=1))


def load(path: str) -> Vocabulary:
    """Read a .model file.  Only BPE with byte fallback, identity normalisation and a leading gap is taken."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    norm, kinds = m.normalizer_spec, [p.type for p in m.pieces]
    plain = m.trainer_spec.model_type == 2 and m.trainer_spec.byte_fallback and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not m.trainer_spec.treat_whitespace_as_suffix
    inner = any(chr(GAP) in p.piece.lstrip(chr(GAP)) for p in m.pieces)
    if not plain or inner or {4, 5} & set(kinds):
        raise ValueError("the model is not a plain byte-fallback BPE vocabulary")
    texts = [p.piece if k == 1 else "" for p, k in zip(m.pieces, kinds, strict=True)]
    codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    _, rank = np.unique(-np.array([p.score for p in m.pieces]), return_inverse=True)
    byte_id = np.zeros(256, np.int32)
    raw = [t.replace(chr(GAP), " ").encode() for t in texts]
    for k, p in enumerate(m.pieces):
        if p.type == 6:
            byte_id[int(p.piece[3:5], 16)] = k
            raw[k] = bytes([int(p.piece[3:5], 16)])
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum([len(c) for c in codes], out=at[1:])
    return Vocabulary(np.concatenate(codes), at, rank.astype(np.int64), np.array(kinds) == 1, byte_id, raw)


def _prefix(levels: list, block: Callable, size: np.ndarray, which: np.ndarray, skip: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of ranks at a level whose text begins with the pieces' symbols from skip on.

    Not a closure of `suffix_ranges`: one that calls itself is part of a cycle, and
    keeps the level's arrays until the garbage collector happens to run.
    """
    width, keys, _ = levels[level]
    if level == 0:
        return block(which, skip)
    m = levels[level - 1][2] + 1
    lo, hi = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    short = size[which] - skip <= width // 2
    for sel, both in ((np.flatnonzero(short), False), (np.flatnonzero(~short), True)):
        if not len(sel):
            continue
        a, b = _prefix(levels, block, size, which[sel], skip, level - 1)
        if both:  # the first half is whole: one rank or none
            c, d = _prefix(levels, block, size, which[sel], skip + width // 2, level - 1)
            lo[sel] = np.searchsorted(keys, a * m + c + 1)
            hi[sel] = np.where(b > a, np.searchsorted(keys, a * m + d + 1), lo[sel])
        else:
            lo[sel] = np.searchsorted(keys, a * m)
            hi[sel] = np.searchsorted(keys, b * m)
    return lo, hi


def suffix_ranges(text: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of text (by as many symbols as a piece can have) and each piece's range in it.

    Ranks of 4 symbols are doubled to 8, 16, ...; a piece is searched in the
    sorted ranks of the level that covers it.  Symbols are below 65,536 (0 ends
    a word, 65,535 stands for what no piece has).
    """
    n, wide = len(text), np.uint64(16)

    def four(get) -> np.ndarray:
        key = np.zeros_like(get(0), np.uint64)
        for k in range(4):
            key = (key << wide) | get(k).astype(np.uint64)
        return key

    padded = np.concatenate([text, np.zeros(4, text.dtype)])
    uniq, rank = np.unique(four(lambda k: padded[k : k + n]), return_inverse=True)
    rank = rank.astype(np.int64)
    size = np.diff(vocab.at)
    symbols, low, high = vocab.symbols, np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)

    def piece_fours(which: np.ndarray, skip: int, fill: int) -> np.ndarray:
        """Symbols skip .. skip+3 of the pieces, with fill after a piece's end."""
        return four(lambda k: np.where(size[which] > skip + k, symbols[np.minimum(vocab.at[which] + skip + k, len(symbols) - 1)], fill))

    def block(which: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers among the text's four-symbol ranks that the pieces' symbols from skip on can have: [low, high)."""
        return np.searchsorted(uniq, piece_fours(which, skip, 0)), np.searchsorted(uniq, piece_fours(which, skip, 65535), "right")

    # per level: distinct sorted keys (rank of first half, rank of second half) for looking up pieces
    levels = [(4, None, len(uniq))]
    width = 4
    while width < vocab.longest:
        m = levels[-1][2] + 1
        second = np.concatenate([rank[width:], np.full(min(width, n), -1)])[:n] + 1
        keys, rank = np.unique(rank * m + second, return_inverse=True)
        rank = rank.astype(np.int64)
        width *= 2
        levels.append((width, keys, len(keys)))
    order = np.argsort(rank, kind="stable")
    final = rank[order]

    which = np.flatnonzero(vocab.normal & (size > 0))
    lo, hi = _prefix(levels, block, size, which, 0, len(levels) - 1)
    low[which] = np.searchsorted(final, lo)
    high[which] = np.maximum(np.searchsorted(final, hi), low[which])
    return order, low, high


def distinct_words(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words that stand for all, and for each word the place of its own among them.

    Words are brought together by a hash and compared letter by letter with the one
    that stands for them; a word that only shares the hash stands for itself.  The
    words follow each other without gaps.
    """
    _, one, of = np.unique(span_hashes(codes.view(np.uint8), 4 * start, 4 * end), return_index=True, return_inverse=True)
    size, like = end - start, one[of]
    other = size[like] != size
    like[other] = np.flatnonzero(other)
    differs = codes[start[0] :] != codes[ragged(start[like], size)]
    other |= np.logical_or.reduceat(differs, start - start[0])
    alone = np.flatnonzero(other)
    of[alone] = len(one) + np.arange(len(alone))
    return np.concatenate([one, alone]), of


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        alphabet = np.unique(vocab.text)
        if len(alphabet) > 65_000:
            raise ValueError("the pieces have too many distinct characters")
        self.alphabet = alphabet
        vocab.symbols = self.symbols(vocab.text)
        self.raw_at = np.zeros(len(vocab.raw) + 1, np.int64)
        np.cumsum([len(r) for r in vocab.raw], out=self.raw_at[1:])
        self.raw = np.frombuffer(b"".join(vocab.raw), np.uint8)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 65535).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text's begin (plus the end)."""
        full = [chr(GAP) + t if t else "" for t in texts]
        codes = np.frombuffer("".join(full).encode("utf-32-le"), "<u4").copy()
        codes[codes == 32] = GAP
        doc = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in full], out=doc[1:])
        if not len(codes):
            return np.zeros(0, np.int32), doc
        gap = codes == GAP
        head = gap.copy()
        head[1:] &= ~gap[:-1]
        head[doc[:-1][doc[:-1] < len(codes)]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(codes))
        one, of = distinct_words(codes, start, end)
        ids, at = self.words(codes, start[one], end[one])
        count = np.diff(at)[of]
        out = ids[ragged(at[:-1][of], count)]
        cut = np.concatenate([[0], np.cumsum(count)])
        return out, cut[np.searchsorted(start, doc)]

    def words(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word codes[start:end], flat, and where they begin."""
        size = end - start
        text = np.zeros(int(size.sum()) + len(size), np.int64)  # a 0 after each word
        plain = np.zeros(len(text), np.uint32)
        base = np.cumsum(size + 1) - (size + 1)
        place = ragged(base, size)
        plain[place] = codes[ragged(start, size)]
        text[place] = self.symbols(plain[place])
        order, low, high = suffix_ranges(text, self.v)
        length = np.diff(self.v.at)
        # the edges by position and length: edge[length, position] is the piece
        edge = np.full((self.v.longest + 1, len(text)), -1, np.int16 if len(length) < 1 << 15 else np.int32)
        for a in range(0, len(length), 2000):  # so many pieces' ranges at a time
            own = slice(a, a + 2000)
            hits = high[own] - low[own]
            edge[np.repeat(length[own], hits), order[ragged(low[own], hits)]] = np.repeat(np.arange(a, a + len(hits)), hits)
        sym_start, sym_len, owner = [], [], []
        short = size <= LONG
        for got in (self._together(edge, base[short], size[short], np.flatnonzero(short)), self._singly(edge, base[~short], size[~short], np.flatnonzero(~short))):
            for all_of, part in zip((sym_start, sym_len, owner), got, strict=True):
                all_of.append(part)
        s, n, w = (np.concatenate(x) for x in (sym_start, sym_len, owner))
        by = np.argsort(s, kind="stable")
        s, n, w = s[by], n[by], w[by]
        piece = edge[n, s].astype(np.int32)
        lost = np.flatnonzero(piece < 0)  # characters without a piece: their UTF-8 bytes
        utf8 = [chr(c).encode("utf-8", "replace") for c in plain[s[lost]]]
        count = np.ones(len(s), np.int64)
        count[lost] = [len(b) for b in utf8]
        ids = np.repeat(piece, count)
        if len(lost):
            first = np.cumsum(count) - count
            ids[ragged(first[lost], count[lost])] = self.v.byte_id[np.frombuffer(b"".join(utf8), np.uint8)]
        per_word = np.bincount(w, weights=count, minlength=len(size)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_word)])

    def _together(self, edge: np.ndarray, base: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, w = ragged(base, size), np.repeat(word, size)
        n = np.ones(len(s), np.int64)
        out: tuple[list, list, list] = ([], [], [])
        never = np.int64(1) << 62
        while len(s):
            both = n[:-1] + n[1:]
            fits = (w[1:] == w[:-1]) & (both < len(edge))
            piece = np.where(fits, edge[np.where(fits, both, 0), s[:-1]], -1)
            key = np.full(len(s), never)
            some = np.flatnonzero(piece >= 0)
            key[some] = self.v.rank[piece[some]] * len(s) + some  # the best rank, then the leftmost
            first = np.flatnonzero(np.diff(w, prepend=-1))
            best = np.minimum.reduceat(key, first)
            going = best < never
            at = best[going] % len(s)
            n[at] += n[at + 1]
            alive = np.repeat(going, np.diff(np.append(first, len(s))))
            for part, x in zip(out, (s, n, w), strict=True):
                part.append(x[~alive])
            alive[at + 1] = False
            s, n, w = s[alive], n[alive], w[alive]
        return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in out)

    def _singly(self, edge: np.ndarray, base: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same steps with a heap, for words so long that steps by round would not end."""
        starts, sizes, owners = [], [], []
        for b, m, w in zip(base.tolist(), size.tolist(), word.tolist(), strict=True):
            length, nxt, prev = [1] * m, list(range(1, m + 1)), list(range(-1, m - 1))
            heap: list[tuple[int, int, int]] = []

            def offer(i: int) -> None:
                j = nxt[i]
                if j < m and (t := length[i] + length[j]) < len(edge) and (p := edge[t, b + i]) >= 0:  # noqa: B023
                    heapq.heappush(heap, (int(self.v.rank[p]), i, t))  # noqa: B023

            for i in range(m):
                offer(i)
            while heap:
                _, i, t = heapq.heappop(heap)
                j = nxt[i]
                if not length[i] or j >= m or length[i] + length[j] != t:
                    continue
                length[i], length[j], nxt[i] = t, 0, nxt[j]
                if nxt[j] < m:
                    prev[nxt[j]] = i
                if prev[i] >= 0:
                    offer(prev[i])
                offer(i)
            own = [i for i in range(m) if length[i]]
            starts += [b + i for i in own]
            sizes += [length[i] for i in own]
            owners += [w] * len(own)
        return np.array(starts, np.int64), np.array(sizes, np.int64), np.array(owners, np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of ids[at[k]:at[k+1]]."""
        size = np.diff(self.raw_at)
        out = []
        for k, m in _runs(np.diff(at).tolist(), 1 << 17):  # so many ids at a time
            own = ids[at[k] : at[m]]
            count = size[own]
            data = self.raw[ragged(self.raw_at[own], count)].tobytes()
            cut = np.concatenate([[0], np.cumsum(count)])[at[k : m + 1] - at[k]].tolist()
            out += [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in pairwise(cut)]
        return out


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    size, begin = 0, 0
    for k, n in enumerate(sizes):
        if size and size + n > most:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(df: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, ids, decoded) for every row: the ids of the whole text, and their text again.

    The ids are those of the vocabulary's own reference encoder.  Null and empty
    texts have no ids and decode to the empty text.  `decoded` equals the text
    unless that has the gap character itself (it decodes to a space).  Null ids
    are kept, repeated rows encoded each, other columns ignored.  No shuffle.
    """
    coder = Encoder(vocab)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text")
            for a, b in _runs(pc.binary_length(texts).to_pylist(), batch_bytes):
                own = [t.decode("utf-8", "replace") for t in texts.slice(a, b - a).to_pylist()]
                ids, at = coder.encode(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(coder.decode(ids, at), pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )
                del own, ids, at
                release()

    source = df.select(id_in(id_col), text_bytes(text_col).alias("text"))
    return id_out(source.mapInArrow(run, "doc_id long, ids array<int>, decoded string"))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
