"""A table in stored buckets by key: a change rewrites the buckets that it touches, and no others.

A bucket is a folder of one version; the manifest, a small versioned table, says which
version of each bucket is in force.  A change reads the buckets of its keys, writes
them anew under the next version and then puts the next manifest in force, so that
readers see all of it or nothing, and a writer that is lost leaves the table as it
was.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..streaming.files import committed, current_table, replace_table
from . import mutations

#: Buckets of a new table.
BUCKETS = 64
MANIFEST = "bucket int, version int, key string, buckets int, columns string"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _dirs(spark: SparkSession, pattern: str) -> list[str]:
    fs, where = _folder(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def _write(rows: DataFrame, path: str, key: str, buckets: int, version: int) -> list[int]:
    """The rows' buckets under this version; their numbers."""
    target = f"{path}/data/v{version:08d}"
    rows.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)
    return [int(d.rsplit("=", 1)[1]) for d in _dirs(rows.sparkSession, f"{target}/_bucket=*")]


def _commit(spark: SparkSession, path: str, held: list[tuple], key: str, buckets: int, columns: str) -> None:
    rows = [(b, v, key, buckets, columns) for b, v in held] or [(-1, 0, key, buckets, columns)]
    replace_table(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{path}/manifest")


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write df as a new table by the key; rows with a null key have a bucket, too."""
    written = _write(df, path, key, buckets, 1)
    _commit(df.sparkSession, path, [(b, 1) for b in written], key, buckets, df.schema.json())


def _manifest(spark: SparkSession, path: str) -> list:
    found = current_table(spark, f"{path}/manifest")
    if found is None:
        raise ValueError(f"there is no table at {path}")
    return found.collect()  # a row a bucket


def read(spark: SparkSession, path: str, only: set[int] | None = None) -> DataFrame:
    """The table as the manifest in force has it, or some of its buckets."""
    rows = _manifest(spark, path)
    schema = StructType.fromJson(json.loads(rows[0]["columns"]))
    dirs = [f"{path}/data/v{r['version']:08d}/_bucket={r['bucket']}" for r in rows if r["bucket"] >= 0 and (only is None or r["bucket"] in only)]
    return spark.read.schema(schema).parquet(*dirs) if dirs else spark.createDataFrame([], schema)


def touched(spark: SparkSession, path: str, keys: DataFrame) -> set[int]:
    """Buckets of the keys (a column of the table's key)."""
    row = _manifest(spark, path)[0]
    return {r["b"] for r in keys.select(_bucket(row["key"], row["buckets"]).alias("b")).distinct().collect()}


def change(spark: SparkSession, path: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> set[int]:
    """Put make(rows of the keys' buckets) in the place of those rows; the buckets rewritten.

    All rows that make gives must be of those buckets: others are an error.
    """
    rows = _manifest(spark, path)
    key, buckets, columns = rows[0]["key"], rows[0]["buckets"], rows[0]["columns"]
    own = touched(spark, path, keys)
    if not own:
        return own
    version = max(r["version"] for r in rows) + 1
    new = make(read(spark, path, own))
    inside = _bucket(key, buckets).isin(sorted(own))
    stray = F.raise_error(F.lit("a row belongs to a bucket that the change does not touch")).cast(new.schema[key].dataType)
    written = _write(new.withColumn(key, F.when(inside, F.col(key)).otherwise(stray)), path, key, buckets, version)
    _commit(spark, path, [(r["bucket"], r["version"]) for r in rows if r["bucket"] >= 0 and r["bucket"] not in own] + [(b, version) for b in written], key, buckets, columns)
    _vacuum(spark, path)
    return own


def _vacuum(spark: SparkSession, path: str) -> None:
    """Buckets that no manifest kept names are deleted."""
    named = {f"v{r['version']:08d}/_bucket={r['bucket']}" for m in committed(spark, f"{path}/manifest") for r in spark.read.parquet(m).collect()}
    for d in _dirs(spark, f"{path}/data/v*/_bucket=*"):
        if "/".join(d.rsplit("/", 2)[1:]) not in named:
            fs, where = _folder(spark, d)
            fs.delete(where, True)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "chunk_id") -> set[int]:
    """Rows replace those of their key, in the buckets of the new rows: a key stays in its bucket."""
    return change(spark, path, new, lambda rows: mutations.upsert(rows, new.select(rows.columns), key))


def update(spark: SparkSession, path: str, changes: DataFrame, fields: list[str], now, key: str = "id") -> set[int]:
    """The fields that a change names in `set`, as `mutations.update`; changes have the table's key column."""
    return change(spark, path, changes, lambda rows: mutations.update(rows, changes, fields, now, key))


def delete(spark: SparkSession, path: str, keys: DataFrame, on: list[str]) -> tuple[set[int], int]:
    """Rows that equal one of the keys in the columns `on` go; the buckets rewritten, and how many rows went.

    keys have the table's key column, by which their buckets are found: document and
    chunk ids for chunks, the session's id for its messages.
    """
    before = read(spark, path, touched(spark, path, keys)).join(keys.select(on).distinct(), on, "left_semi").count()
    return change(spark, path, keys, lambda rows: rows.join(keys.select(on).distinct(), on, "left_anti").select(rows.columns)), before
