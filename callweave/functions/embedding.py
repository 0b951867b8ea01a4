"""Offline embedders, as Arrow batches: they hash byte digests, which columns cannot."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.staging import staged
from . import text as X

#: Texts whose vectors are held at a time: an Arrow batch has ten thousand texts, and 512 values each would be 40 MB, several times over.
AT_ONCE = 256

_WORD = re.compile(r"[\w؀-ۿ]+")


def _unit(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt((v * v).sum()))
    return v / n if n else v


def hash_vector(text: str, size: int = 256) -> np.ndarray:
    """Meaningless but stable: digest bytes mixed with their position."""
    digest = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8).astype(int)
    at = np.arange(size)
    return _unit((digest[at % len(digest)] ^ (at * 31 % 256)) / 255.0 - 0.5)


def lexical_vector(text: str, size: int = 512, gram: int = 4) -> np.ndarray:
    """Signed hashing of words (weight 2) and padded character 4-grams (weight 1), logarithmic in their count."""
    weight: Counter = Counter()
    for w in _WORD.findall(text.lower()):
        weight[f"w:{w}"] += 2.0
        padded = f" {w} "
        weight.update(f"c:{padded[k : k + gram]}" for k in range(len(padded) - gram + 1))
    out = np.zeros(size)
    for feature, n in weight.items():
        d = hashlib.blake2b(feature.encode(), digest_size=8).digest()
        out[int.from_bytes(d[:4], "little") % size] += (1.0 if d[4] & 1 else -1.0) * (1.0 + np.log(n))
    return _unit(out)


class Provider(Protocol):
    """What turns a text into a vector; `name` goes into the cache's key."""

    name: str

    def vector(self, text: str) -> np.ndarray: ...


class Offline:
    """The two embedders that need no network, by name: lexical and hash."""

    def __init__(self, name: str = "lexical"):
        self.name, self.vector = name, {"lexical": lexical_vector, "hash": hash_vector}[name]


# What model families want before a question and before a passage; the first name found in the model's counts.
PREFIXES = {"e5": ("query: ", "passage: "), "bge-m3": ("", ""), "gte-": ("", ""), "mpnet": ("", "")}


def prefix(model: str, question: bool) -> str:
    return next((q if question else p for k, (q, p) in PREFIXES.items() if k in model.lower()), "")


def embedder(kind: str | Provider = "lexical", question: bool = False):
    provider = Offline(kind) if isinstance(kind, str) else kind
    lead = prefix(provider.name, question)

    @arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                vectors = [np.asarray(provider.vector(lead + (t or "")), float) for t in batch.slice(at, AT_ONCE).to_pylist()]
                ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vectors)))

    return embed


def embedded(df: DataFrame, text: str = "text", kind: str | Provider = "lexical") -> DataFrame:
    """df with `vector`; each distinct text is embedded once."""
    known = df.select(F.col(text).alias("_text")).distinct().withColumn("vector", embedder(kind)(F.col("_text")))
    return df.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


CACHE = "key string, vector array<double>"


def embedded_through(df: DataFrame, cache: DataFrame, text: str = "text", kind: str | Provider = "lexical") -> tuple[DataFrame, DataFrame]:
    """(df with `vector`, the cache's new rows): texts whose key, a hash of model and text, the cache (CACHE) has are not embedded again.

    The new rows are written once, so that the caller can append them to the kept
    table without a second run of the model.
    """
    name = kind if isinstance(kind, str) else kind.name
    keyed = df.withColumn("_key", X.content_hash(F.lit(name), text))
    wanted = keyed.select("_key", F.coalesce(text, F.lit("")).alias("_text")).dropDuplicates(["_key"]).join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    new = staged(wanted.select(F.col("_key").alias("key"), embedder(kind)(F.col("_text")).alias("vector")), "vectors")
    return keyed.join(cache.unionByName(new).withColumnRenamed("key", "_key"), "_key", "left").drop("_key"), new


def mean_pool(tokens: DataFrame, key: str = "id") -> DataFrame:
    """Mean of the token vectors (column vector) of each key, component by component."""
    parts = tokens.select(key, F.posexplode("vector").alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
