"""Byte-level tokenizers: token ids, and what bytes each token stands for.

A token of a byte-level vocabulary may be a part of a character, so that one token
has no text of its own.  What stands here gives lengths in bytes; places in a text
follow from their running sums.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np

# Fixed value: how a text is cut before the byte pairs are merged, as the public byte-level vocabularies ask for.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Tokens:
    """encode gives a text's ids; sizes has the bytes of each id; lead is what the vocabulary puts before a text."""

    encode: Callable[[str], list[int]]
    sizes: np.ndarray
    lead: int = 0


@cache
def from_ranks(path: str, pattern: str = PATTERN) -> Tokens:
    """A byte-level vocabulary of base64 tokens with their ranks, a line each."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    return Tokens(tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes)


@cache
def from_pieces(path: str) -> Tokens:
    """A vocabulary of pieces with byte fallback: an unknown character is a token for each of its bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda piece: 1 if re.fullmatch("<0x[0-9A-F]{2}>", piece) else len(piece.replace("▁", " ").encode())
    sizes = np.array([0 if model.is_control(k) else of(model.id_to_piece(k)) for k in range(model.get_piece_size())], np.int64)
    begin = model.encode("a")
    return Tokens(model.encode, sizes, int(sizes[begin].sum()) - 1)


@cache
def _blanks() -> np.ndarray:
    return np.array([c for c in range(0x110000) if chr(c).isspace()], np.uint32)


def starts(tokens: Tokens, ids: list[int], text: str) -> np.ndarray:
    """Character in which each token begins, and at the end the text's length: a token that goes on inside a character begins with it."""
    at = np.concatenate([[0], np.cumsum(tokens.sizes[np.asarray(ids, np.int64)])]) - tokens.lead
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    begun = np.cumsum((data & 0xC0) != 0x80) - 1
    inside = np.clip(at, 0, len(data))
    return np.append(begun, len(text))[inside] if len(data) else np.zeros(len(at), np.int64)


def windows(tokens: Tokens, text: str, size: int, overlap: int) -> list[tuple[str, int]]:
    """(text, its own number of tokens) of windows of `size` tokens, each `size - overlap` behind the one before.

    Both ends move outward to white space, so that no word is cut; blank windows
    and equal neighbours are left out, and the window that reaches the end is the
    last.  A text costs time in proportion to its length and its windows' lengths.
    """
    ids = tokens.encode(text)
    if not len(ids):
        return []
    place = starts(tokens, ids, text)
    blank = np.isin(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _blanks())
    n, spots = len(text), np.arange(len(text))
    word = np.maximum.accumulate(np.concatenate([[0], np.where(blank, spots + 1, 0)]))  # the last place behind a blank, up to each place
    rest = np.append(np.minimum.accumulate(np.where(blank, spots, n)[::-1])[::-1], n)  # the next blank, from each place on
    out: list[tuple[str, int]] = []
    for at in range(0, len(ids), max(1, size - overlap)):
        to = min(at + size, len(ids))
        body = text[word[place[at]] : rest[place[to] if to < len(ids) else n]].strip()
        if body and (not out or body != out[-1][0]):
            out.append((body, len(tokens.encode(body))))
        if to == len(ids):
            break
    return out
