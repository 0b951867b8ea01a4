"""Incremental ingestion of a landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import landed

FILE = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Call each(paths, number) with the paths (a DataFrame) of every batch of new files; returns the query.

    A batch that is tried again has the same number and names the same files.  `each`
    must replace what it wrote for them; `follow_into` does so.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(folder).select("path")
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_into(spark: SparkSession, folder: str, checkpoint: str, table: str, make: Callable[[DataFrame, DataFrame | None], DataFrame], name: str = "files", keep: int = 2):
    """Follow a folder into a versioned table, each batch exactly once: make(paths, table so far) gives the next version.

    A version's folder carries the follower's name and the number of the batch that it
    ends with, and both count once the version has its success mark.  So the versions
    are the ledger: a batch that was written and then tried again, as the stream was
    lost before it noted the batch, finds its number there and is passed over.
    """

    def batch(paths: DataFrame, number: int) -> None:
        if number <= max(applied(spark, table).get(name, -1), -1):
            return
        ledger = applied(spark, table) | {name: number}
        replace_table(make(paths, current_table(spark, table)), table, keep, "".join(f"-{k}.{n}" for k, n in sorted(ledger.items())))

    return follow(spark, folder, checkpoint, batch)


def applied(spark: SparkSession, table: str) -> dict[str, int]:
    """The last batch of each follower in the newest finished version."""
    versions = committed(spark, table)
    parts = versions[-1].rsplit("/", 1)[1].split("-")[1:] if versions else []
    return {k: int(n) for k, n in (p.rsplit(".", 1) for p in parts)}


def committed(spark: SparkSession, path: str) -> list[str]:
    """Finished versions of a table, the oldest first: a version counts once its job has left its success mark."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(s.getPath().getParent().toString() for s in found or [])


def replace_table(df: DataFrame, path: str, keep: int = 2, tag: str = "") -> str:
    """Write df as the next version of the table at path, and delete versions older than the last `keep`.

    Readers take the newest finished version (`current_table`): none meets a
    half-written one, and a writer that is lost leaves the one before in force.
    One writer at a time.  The tag goes behind the version's number in its name.
    """
    spark = df.sparkSession
    old = committed(spark, path)
    number = int(old[-1].rsplit("/v", 1)[1].split("-")[0]) + 1 if old else 1
    target = f"{path}/v{number:08d}{tag}"
    df.write.mode("overwrite").parquet(target)
    for gone in old[: max(0, len(old) + 1 - keep)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(gone)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return target


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished version, None if there is none yet."""
    versions = committed(spark, path)
    return spark.read.parquet(versions[-1]) if versions else None


__all__ = ["applied", "committed", "current_table", "follow", "follow_into", "landed", "replace_table"]
