"""Bodies that a telephony provider posts, as rows: a permissive schema, so that nothing in a body stops a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "uuid string, status string, duration string, detail string, timestamp string"
SPEECH = "uuid string, speech struct<results:array<struct<text:string,confidence:string>>>"


def _parsed(raw: DataFrame, schema: str, body: str) -> DataFrame:
    """Bodies that are objects, with their fields as text; others (no JSON, lists, no uuid) are left out."""
    return raw.where(F.col(body).rlike(r"^\s*\{")).withColumn("_b", F.from_json(body, schema)).where("_b.uuid IS NOT NULL")


def call_events(raw: DataFrame, body: str = "body", seq: str = "seq", arrived: str = "ts") -> DataFrame:
    """(seq, uuid, status, duration, detail, ts) of call-status bodies, for `lifecycle` and `lifecycle_stream`.

    ts is the body's own time where it reads as one, else that of arrival.  Works on
    batches and streams alike; bodies that are no objects or name no call are left out.
    """
    told = F.try_to_timestamp(F.col("_b.timestamp"))
    return _parsed(raw, STATUS, body).select(F.col(seq).alias("seq"), "_b.uuid", "_b.status", "_b.duration", "_b.detail", F.coalesce(told, F.col(arrived).cast("timestamp")).alias("ts"))


def speech_inputs(raw: DataFrame, body: str = "body", seq: str = "seq", attempt: str = "attempt") -> DataFrame:
    """(seq, uuid, attempt, results) of speech bodies, for `best_hypothesis` and `speech_action`; without results the array is null."""
    return _parsed(raw, SPEECH, body).select(F.col(seq).alias("seq"), "_b.uuid", F.coalesce(F.col(attempt), F.lit(1)).alias("attempt"), F.col("_b.speech.results").alias("results"))
