"""Changes as new snapshots: parquet has no MERGE, so a change set is joined and a partition rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task numbers, about, and the most parts they are dealt to.
NUMBERED, MOST_CHUNKS = 20_000, 1 << 16


def insert(table: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """rows with ids that go on from the table's largest.

    Ids are given out by counted chunks, not by one task: rows are dealt by hash to
    as many chunks as their number asks for, numbered inside their chunk, and each
    chunk is moved by what stands before it.
    """
    start = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    columns = [c for c in table.columns if c != key]
    chunks = min(MOST_CHUNKS, -(-rows.count() // NUMBERED) or 1)
    dealt = rows.select(*columns).withColumn("_chunk", F.pmod(F.xxhash64(*columns), F.lit(chunks)))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_chunk").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("_chunk").orderBy(*([order] if order else columns))
    numbered = dealt.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(counts.select("_chunk", "_before")), "_chunk")  # at most MOST_CHUNKS rows
    new = numbered.withColumn(key, (F.lit(start) + F.col("_before") + F.col("_rank")).cast(table.schema[key].dataType)).select(table.columns)
    return table.unionByName(new)


def update(table: DataFrame, changes: DataFrame, fields: list[str], now, key: str = "id") -> DataFrame:
    """Apply the fields that a change sets: `set` is the array of their names, as NULL is a value too."""
    given = changes.select(F.col(key), F.struct(*fields).alias("_new"), F.col("set").alias("_set"))
    joined = table.join(given, key, "left")
    hit = F.col("_set").isNotNull()
    out = {f: F.when(F.array_contains("_set", f), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields}
    out["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return joined.withColumns(out).select(table.columns)


def toggle(table: DataFrame, key_value: int, active: bool, now, key: str = "id") -> DataFrame:
    hit = F.col(key) == key_value
    return table.withColumns({"is_active": F.when(hit, F.lit(active)).otherwise(F.col("is_active")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def upsert(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace old ones by key; of several new ones with a key the last (by ordinal) stays."""
    last = Window.partitionBy(key).orderBy(F.desc("ordinal"))
    new = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return store.join(new.select(key), key, "left_anti").select(store.columns).unionByName(new)


def add(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Append; a key that is there already is an error, raised when the rows are computed."""
    held = store.select(key, F.lit(True).alias("_there"))
    joined = new.join(held, key, "left")
    checked = joined.withColumn(key, F.when(F.col("_there"), F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast(new.schema[key].dataType)).otherwise(F.col(key)))
    return store.unionByName(checked.select(store.columns))


def delete_document(store: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and one row with the number of chunks that go."""
    hit = F.col("document_id").eqNullSafe(document_id)
    return store.where(~hit), store.where(hit).agg(F.count("*").alias("deleted"))


def delete_keys(store: DataFrame, keys: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """As above for keys; only those that were there are counted."""
    return store.join(keys.select(key), key, "left_anti"), store.join(keys.select(key), key, "left_semi").agg(F.count("*").alias("deleted"))


def delete_session(sessions: DataFrame, messages: DataFrame, session_id, company_id: int) -> tuple[DataFrame, DataFrame]:
    """The session goes with its messages, if the company owns it."""
    gone = sessions.where((F.col("id") == session_id) & (F.col("company_id") == company_id)).select("id")
    return sessions.join(gone, "id", "left_anti"), messages.join(gone.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def save(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a snapshot; with a partition column only the partitions in df are replaced."""
    writer = df.write.mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition) if partition else writer).parquet(path)


def exported(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON lines: the text, and the metadata with arrays joined and absent values as sentinels."""
    text = [c for c, t in chunks.dtypes if t == "string" and c not in ("text", "chunk_id")]
    ints = [c for c, t in chunks.dtypes if t in ("int", "bigint")]
    arrays = [c for c, t in chunks.dtypes if t == "array<string>"]
    meta = [F.coalesce(c, F.lit("")).alias(c) for c in text] + [F.coalesce(c, F.lit(-1)).alias(c) for c in ints] + [F.concat_ws(" > ", c).alias(c) for c in arrays]
    return chunks.select("chunk_id", F.to_json(F.struct("text", F.struct(*meta).alias("metadata"))).alias("json"))
