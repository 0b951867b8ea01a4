"""Shared plumbing: shared-folder tables, slices, and a keyed all-reduce.

Several operators need "for each key of my slice, what do all slices say about
it": word counts, repeated windows.  Exploding one row per word into a shuffle
costs far more than the answer, so the exchange here moves packed arrays:

1. every *slice* (a few MB of documents, chosen by hash) sends each of its
   distinct keys once, sorted, cut into key-range *buckets*;
2. a bucket reduces the keys of all slices and answers each slice in the order
   in which that slice listed its keys;
3. the slice, met again by a cogroup, lines the answers up with its own keys.

A key that is in every row therefore costs one entry a slice, never one a row.
"""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null id between JVM and Python, where a column with nulls would turn to floats.
NO_ID = (1 << 63) - 1


def id_in(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id")


def id_out(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in names or ("doc_id",)})


#: Bytes of text in a slice, about.
SLICE_BYTES = 6 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one only where none is set and the master is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "callweave-shared")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Intermediate tables written by this process and not deleted yet.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_folder(spark)}/callweave-{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append(path)
    return path


def as_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there.  `scratch` and `clear` delete it unless keep is set."""
    path = fresh_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(table: DataFrame) -> None:
    """Delete a table that `as_table` gave, once nothing reads it any more."""
    paths = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    gone = [p for p in _made if any(f.endswith(p.rsplit("/", 1)[1]) for f in paths)]
    _delete(table.sparkSession, gone)
    _made[:] = [p for p in _made if p not in gone]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end: results must have been written, or read, by then."""
    begin = len(_made)
    try:
        yield
    finally:
        _delete(spark, _made[begin:])
        del _made[begin:]


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside: JVM and Python hold one of them for each task."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def short_plans(spark: SparkSession, most: int = 4000):
    """The driver's record of what has run keeps so many characters of a plan, which is told anew with each of its steps: for operators of some hundred plans."""
    return _set(spark, "spark.sql.maxPlanStringLength", str(most))


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; no DataFrame built on them can be read afterwards."""
    _delete(spark, _made)
    _made.clear()


def meet(rows: DataFrame, groups: DataFrame, key: str, spread: str, askers: int = 1024) -> DataFrame:
    """rows joined with groups (one row a key, n: the key's rows); a key of many rows meets copies of its group, dealt by `spread`.

    Keys are copied from `askers` rows on, or from 1/4096 of all rows where that is
    more: the list of them has at most 4096 entries, and a key that is not copied
    has less than 1/4096 of the rows.
    """
    least = max(askers, (groups.agg(F.sum("n").alias("n")).first()["n"] or 0) // 4096)
    more = F.floor(F.col("n") / least)
    hot = F.broadcast(groups.where(F.col("n") >= least).select(key, more.alias("more")))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("more") + 1), F.lit(0).cast("long"))).drop("more")
    return dealt.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), more))), [key, "salt"]).drop("salt")


def numbered(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with `at`, from 0 in each group, and `n`, the group's rows; rows are a written table, `order` begins with the group and tells all rows apart.

    Rows are sorted by ranges; what stands before a group's rows in each range is
    counted and joined back by range and group, so that a group of any size is
    spread over as many tasks as its rows ask for.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = as_table(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "numbered")
    counts = placed.groupBy("part", group).agg(F.count("*").alias("own"), F.min("place").alias("first"))
    since, whole = Window.partitionBy(group).orderBy("part"), Window.partitionBy(group)
    starts = counts.select("part", group, (F.sum("own").over(since) - F.col("own") - F.col("first")).alias("move"), F.sum("own").over(whole).alias("n"))
    return placed.join(starts, ["part", group]).withColumn("at", F.col("place") + F.col("move")).drop("part", "place", "move")


def text_bytes(text_col: str):
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def sliced(df: DataFrame, id_col: str, text_col: str, extra: dict | None = None, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, int]:
    """(slice, doc_id, text as bytes, *extra) with slices of about slice_bytes, and the number of buckets for them.

    The slice depends on id and text alone, so equal input gives equal slices.
    """
    total = df.select(F.octet_length(F.col(text_col).cast("string")).alias("n")).agg(F.sum("n")).first()[0] or 0
    n = max(1, math.ceil(total / slice_bytes))
    docs = df.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), F.lit(n)).cast("int").alias("slice"),
        id_in(id_col),
        text_bytes(text_col).alias("text"),
        *[c.alias(k) for k, c in (extra or {}).items()],
    )
    return docs, max(2 * df.sparkSession.sparkContext.defaultParallelism, n // 4)


#: What a slice sends to a bucket.
SENT = "level int, slice int, bucket int, keys binary, vals binary"
#: What a bucket answers.
ANSWER = "level int, slice int, bucket int, vals binary"


def bucket_rows(level: int, piece: int, keys: np.ndarray, vals: np.ndarray, buckets: int) -> pd.DataFrame:
    """Cut sorted unique keys (n x words, uint64) and their values (n x m, int64) into buckets."""
    at = ((keys[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
    some = np.flatnonzero(cut[1:] > cut[:-1])
    return pd.DataFrame(
        {
            "level": np.full(len(some), level, np.int32),
            "slice": np.full(len(some), piece, np.int32),
            "bucket": some.astype(np.int32),
            "keys": [keys[cut[b] : cut[b + 1]].tobytes() for b in some],
            "vals": [vals[cut[b] : cut[b + 1]].tobytes() for b in some],
        }
    )


def merge(keys: np.ndarray, vals: np.ndarray, ops: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their reduced values, and for each input row the number of its key."""
    n = len(keys)
    if not n:
        return keys, vals, np.zeros(0, np.int64)
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    ordered, v = keys[order], vals[order]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    how = {"sum": np.add, "min": np.minimum, "max": np.maximum}
    out = np.stack([how[op].reduceat(v[:, k], first) for k, op in enumerate(ops)], axis=1)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[first], out, number


def reduce_buckets(sent: DataFrame, width: int, ops: tuple[str, ...], answer: Callable[[np.ndarray], np.ndarray], schema: str = ANSWER, also: Callable[[np.ndarray, np.ndarray], dict] | None = None) -> DataFrame:
    """Reduce each bucket's keys and answer each slice; `also` adds one row about the whole bucket with slice -1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        parts = [np.frombuffer(k, np.uint64).reshape(-1, width) for k in pdf["keys"]]
        vals = [np.frombuffer(v, np.int64).reshape(-1, len(ops)) for v in pdf["vals"]]
        uniq, reduced, number = merge(np.concatenate(parts), np.concatenate(vals), ops)
        told = answer(reduced)
        cuts = np.cumsum([0] + [len(p) for p in parts])
        out = pd.DataFrame({"level": pdf["level"].to_numpy(), "slice": pdf["slice"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "vals": [told[number[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})
        if also:
            whole = also(uniq, reduced)
            rows = out.to_dict("records") + [{"level": int(pdf["level"].iloc[0]), "slice": -1, "bucket": int(pdf["bucket"].iloc[0]), "vals": b""}]
            out = pd.DataFrame(rows)
            for name, value in whole.items():
                out[name] = pd.Series([None] * (len(rows) - 1) + [value], dtype=object)
        return out

    return sent.groupBy("bucket").applyInPandas(run, schema)


def answers(pdf: pd.DataFrame, level: int, dtype) -> np.ndarray:
    """A slice's answers of one level, in the order of its keys."""
    own = pdf[pdf["level"] == level].sort_values("bucket")
    return np.concatenate([np.frombuffer(v, dtype) for v in own["vals"]]) if len(own) else np.zeros(0, dtype)


def release() -> None:
    """Give memory that is free back to the system: workers are used again, and the allocators keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release_executors(spark: SparkSession) -> None:
    """Executors collect their garbage and give back what their heaps no longer need: Python workers stand beside a heap that is as large as any step before made it."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def arrow_map(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 2 << 20) -> DataFrame:
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in pieces(pdf["text"], most):
                yield run(pdf.iloc[at].reset_index(drop=True))
                release()

    return df.mapInPandas(batches, schema)


def pieces(texts: pd.Series, most: int = 2 << 20) -> Iterator[slice]:
    """Runs of rows with about `most` bytes each, so that temporary arrays stay small whatever the batch."""
    size, begin = 0, 0
    for k, n in enumerate(len(t) for t in texts):
        if size and size + n > most:
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))
