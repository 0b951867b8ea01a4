"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where none is set and the master is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or os.path.join(tempfile.gettempdir(), "callweave-shared")).rstrip("/")


#: Folders made by this process and not deleted yet.
_made: list[str] = []


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `scratch` deletes what is written there."""
    _made.append(f"{shared_folder(spark)}/callweave-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: later uses do not compute it again, and a lost executor costs no rerun of it."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end: results must have been written, or read, by then."""
    begin = len(_made)
    try:
        yield
    finally:
        for path in _made[begin:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _made[begin:]
