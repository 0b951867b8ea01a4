"""The corpus pipeline: documents in, token ids of clean documents out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  A stage's result is written as Parquet and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import decontaminate, exact, pieces, quality, shingles
from callweave.llm.common import as_table, release_executors, scratch, small_batches
from callweave.llm.queries import VOCABULARY, quality_model

#: Rows in an Arrow batch: Python workers are used again by later stages and keep what the largest batch took.
BATCH_ROWS = 500
#: Bytes of text that are encoded at a time: less than by itself, as the executors' memory has been touched by four stages then.
ENCODED_BYTES = 1 << 17


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rested(stage: Stage) -> Stage:
    """The stage, begun with what the one before left of the executors' memory given back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@_rested
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, judged each by its text alone: null and empty ones by the learned bias, repeated rows alike."""
    return quality.keep_good(docs, quality_model(spark, sf_dir))


def _without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, key: Column) -> DataFrame:
    """docs without the rows (id, key) of gone, and one row for each key of repeated; null ids are equal here.

    A row is one struct meanwhile, so that no column of docs meets a helper's name.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    gone = as_table(gone.distinct(), "gone").select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"))
    left = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    order = F.struct(F.sha2(F.col("row.text").cast("binary"), 256), F.xxhash64("row"))
    one = left.join(repeated, "key", "left_semi").groupBy("key", "id").agg(F.max_by("row", order).alias("row"))
    return left.join(repeated, "key", "left_anti").select("row.*").unionByName(one.select("row.*"))


@_rested
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of those with the largest doc_id; a null doc_id loses to any other.

    Rows are told apart by doc_id and text: other texts with a dropped row's id stay.
    Of rows that share the largest id (or have null ids only) and the text, one stays.
    """
    found = as_table(exact.dedup_exact(docs).select(F.col("doc_id").alias("id"), "kept", F.col("digest").alias("key")), "exact")
    repeated = as_table(found.where("kept").groupBy("key").count().where("count > 1").select("key"), "repeated")
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _without(docs, found.where("not kept").select("id", "key"), repeated, F.unhex(F.sha2(lowered.cast("binary"), 256)))


@_rested
def distinct_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of those with the smallest doc_id; a null doc_id loses to any other.

    Rows are linked where their sets of five-word shingles are similar by 0.8 or more:
    SimHash links within two bits, and for the rest SuperMinHash bands, each confirmed exactly.
    They are told apart by doc_id and text: other texts with a dropped row's id stay.
    Of rows that share the smallest id (or have null ids only) in a group, one stays.
    """
    found = shingles.near_copies(docs, shingle=5, at_least=0.8)
    found = as_table(found.select(F.col("doc_id").alias("id"), F.col("of").alias("key"), "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first")), "near")
    # A root is met again only where several rows of a group have its least id.
    tied = found.where("first").groupBy("root").agg(F.min("key").alias("best"), F.count("*").alias("n")).where("n > 1")
    ties = as_table(found.where("first").join(tied, "root").select("id", "key", "best"), "ties")
    gone = found.where("not first").select("id", "key").unionByName(ties.where("key <> best").select("id", "key"))
    return _without(docs, gone, ties.select(F.col("best").alias("key")).distinct(), shingles.text_key("text"))


@_rested
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go; null and empty texts stay, repeated rows stay or go together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_rested
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document left, one for each row: null ids are kept, null and empty texts have no ids."""
    return pieces.digest(pieces.encode(docs, pieces.load(VOCABULARY), batch_bytes=ENCODED_BYTES))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", distinct_near),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The classifier is trained and the ids come from a vocabulary file: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's intermediate tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark), small_batches(spark, BATCH_ROWS):
            docs = as_table(stage(spark, docs, sf_dir), "pipeline-" + "".join(c for c in name if c.isalpha()), keep=True)
    return docs
