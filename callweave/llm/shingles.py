"""Near copies by the exact similarity of word shingle sets: SimHash links first where asked for, SuperMinHash bands for the rest.

The similarity of two texts is that of their sets of word shingles (shared ones
through all distinct ones).  Texts whose SimHash fingerprints lie within a small
radius are found by the BK-trees of `simhash.links`; at a similarity of 0.8 two
fingerprints differ in ten bits on average, so that no radius a tree can search
finds most such pairs.  Bands of four of 128 positions bring the others together:
two texts of similarity 0.8 meet but for one pair in twenty million, more similar
ones sooner.  No pair is linked unless its sets pass the comparison; see
`setlinks` for what becomes of large groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesvec import SPACED_LOWER, mix, window_hashes, word_hashes, words
from .common import arrow_map, as_table, id_in, id_out, meet, short_plans, small_batches, text_bytes
from .setlinks import ASKERS, settle
from .simhash import links, majority
from .superminhash import band_keys, signatures

U = np.uint64
#: Rows in an Arrow batch, and bytes of text that are worked on at a time.
ROWS, MARKED = 1000, 1 << 19


def shingle_sets(texts: list[bytes], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and where each text's begin; a text of fewer words is one shingle."""
    w = words(texts, SPACED_LOWER)
    h, n = word_hashes(w), w.per_doc
    starts = np.arange(max(0, len(h) - shingle + 1))
    doc = w.doc_of()
    starts = starts[doc[starts] == doc[starts + shingle - 1]]
    of, got = [doc[starts]], [window_hashes(h, shingle)[starts]]
    for m in range(1, shingle):
        short = np.flatnonzero(n == m)
        if len(short):
            of.append(short)
            got.append(window_hashes(h, m)[w.doc[short]])
    of, got = np.concatenate(of), np.concatenate(got)
    order = np.lexsort((got, of))
    of, got = of[order], got[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (got[1:] != got[:-1])
    of, got = of[new], got[new]
    return got, np.searchsorted(of, np.arange(len(texts) + 1))


def set_keys(got: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """16 bytes for each whole set, equal for equal sets; zeros for an empty one."""
    n = len(begin) - 1
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                out[some, k] = mix(np.add.reduceat(mix(got ^ U(salt)), begin[some]) + np.diff(begin)[some].astype(np.uint64))
    return [row.tobytes() for row in out]


def text_key(text_col: str):
    """16 bytes of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text_bytes(text_col), 256), 1, 32))


def likely(rows: DataFrame, asked: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """rows that may have one of the asked keys, all that do among them: few rows travel to a join that most of them would not survive.

    Keys are told by their hash modulo `most`, so that at most that many numbers are
    broadcast; where the keys asked for are more, the filter would pass most rows
    and is left out.
    """
    number = F.pmod(F.xxhash64(key), F.lit(most))
    if asked.count() > most // 2:
        return rows
    return rows.join(F.broadcast(asked.select(number.alias("number")).distinct()), number == F.col("number"), "left_semi")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, at_least: float = 0.8, radius: int | None = 2) -> DataFrame:
    """(doc_id, of, size, root, component_id) for every row; size is that of its shingle set, root stands for its component, of for its text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  Rows are
    linked when their sets' similarity is at_least or more, as far as the fingerprints'
    radius (None: without) or a band brings them together; component_id is the least id
    that links reach, the row's own included.  Texts without words are equal to each
    other only.

    Null texts count as empty; a null id is passed over as a component's least id
    unless there is no other; other columns are ignored.
    """
    with small_batches(df.sparkSession, ROWS), short_plans(df.sparkSession):  # all Python steps end in written tables inside
        return _near_copies(df.select(id_in(id_col), text_bytes(text_col).alias("text")), shingle, at_least, radius)


def _near_copies(rows: DataFrame, shingle: int, at_least: float, radius: int | None) -> DataFrame:
    source = rows.withColumn("of", text_key("text"))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        got, begin = shingle_sets(list(pdf["text"]), shingle)
        sizes = np.diff(begin)
        keys = band_keys(signatures(got, begin)).view(np.int64)
        bands = [row if n else row[:0] for row, n in zip(keys, sizes, strict=True)]
        fp = majority(got, sizes).view(np.int64) if radius is not None else 0
        return pd.DataFrame({"doc_id": pdf["doc_id"], "of": pdf["of"], "sig": set_keys(got, begin), "size": sizes, "fp": fp, "bands": bands})

    def items(pdf: pd.DataFrame) -> pd.DataFrame:
        got, begin = shingle_sets(list(pdf["text"]), shingle)
        got = got.view(np.int64)
        return pd.DataFrame({"node": pdf["node"], "items": [got[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]})

    marked = id_out(arrow_map(source, mark, "doc_id long, of binary, sig binary, size long, fp long, bands array<long>", MARKED))
    marked = as_table(marked.withColumn("row", F.monotonically_increasing_id()), "shingles")
    least = marked.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min("of").alias("of"), F.min("fp").alias("fp"), F.max("bands").alias("bands"))
    least = as_table(least.withColumn("node", F.monotonically_increasing_id()), "distinct")
    some = least.where(F.size("bands") > 0)

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = as_table(some.join(nodes, "node", "left_semi").groupBy("of").agg(F.min("node").alias("node")), "asked")
        found = likely(source.select("of", "text"), asked, "of").join(asked, "of").groupBy("node").agg(F.first("text").alias("text"))
        return arrow_map(found, items, "node long, items array<long>", MARKED)

    roots = settle(some.select("node", "bands"), sets_of, at_least, _close(some, radius) if radius is not None else None)
    joined = least.select("sig", "node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    reach = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    by_sig = as_table(joined.join(reach, "root").select("sig", "n", "root", "component_id"), "by-set")
    return meet(marked.select("doc_id", "of", "sig", "size", "row"), by_sig, "sig", "row", ASKERS).select("doc_id", "of", "size", "root", "component_id")


def _close(some: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of sets within the fingerprints' radius: a tree's edges between fingerprints, and each other set of a fingerprint with its first."""
    named = as_table(some.groupBy("fp").agg(F.min("node").alias("named"), F.count("*").alias("n")), "fingerprints")
    edges = as_table(links(named.select("fp"), radius), "simhash")
    ends = lambda c: named.select(F.col("fp").alias(c), F.col("named").alias(f"node_{c}"))
    close = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    twins = meet(some.select("fp", "node"), named.where("n > 1"), "fp", "node", ASKERS).where("node <> named").select(F.col("node").alias("a"), F.col("named").alias("b"))
    return as_table(close.unionByName(twins), "close")
