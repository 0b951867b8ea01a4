"""Greedy de-duplication by similarity inside a document, of any length, in bounded tasks.

A chunk goes if it is similar enough to one that was kept before it, so that the
outcome depends on the order.  Documents are cut into blocks of parts.  All
documents' k-th blocks are settled in one round: first each is compared with the
kept vectors of every earlier block of its document, a task for each pair of
blocks, then what is left is settled in order within the block.  A task holds two
blocks' vectors, whatever the document; what a round keeps is written before the
next.  Most documents have one block and end in the first round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import fresh_folder, staged

#: Parts in a block; places to which similarities are compared.
BLOCK, PLACES = 4096, 12
_KEPT = "document_id {}, part long, rank int, vector array<double>"


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one as rows; a zero vector stays."""
    m = np.array([np.asarray(v, float) for v in vectors])
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def settled(unit: np.ndarray, threshold: float, step: int = 256) -> np.ndarray:
    """Numbers of the rows kept, in order: each is compared with the ones kept before it."""
    kept = np.zeros(0, np.int64)
    for a in range(0, len(unit), step):
        rows = np.arange(a, min(a + step, len(unit)))
        if len(kept):
            rows = rows[~(np.round(unit[rows] @ unit[kept].T, PLACES) >= threshold).any(axis=1)]
        near = np.round(unit[rows] @ unit[rows].T, PLACES) >= threshold
        own: list[int] = []
        for k in range(len(rows)):
            if not near[k, own].any():
                own.append(k)
        kept = np.concatenate([kept, rows[own]])
    return kept


def dedupe_similar(chunks: DataFrame, threshold: float = 0.92, block: int = BLOCK) -> DataFrame:
    """chunks (document_id, part, vector, ...) without those whose cosine with one kept before reaches the threshold; parts are numbered anew.

    Parts are whole numbers that tell a document's chunks apart; chunks without a
    part or a vector are left out.  A zero vector is similar to nothing.  Only
    document, part and vector travel; the other columns are joined at the end.
    """
    spark = chunks.sparkSession
    kind = dict(chunks.dtypes)["document_id"]
    narrow = chunks.where("part IS NOT NULL AND vector IS NOT NULL").select("document_id", F.col("part").cast("long").alias("part"), F.col("vector").cast("array<double>").alias("vector"))
    cell = F.expr(f"(part - pmod(part, {block}L)) div {block}L")
    before = Window.partitionBy("document_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = narrow.groupBy("document_id", cell.alias("cell")).agg(F.count("*").alias("n"))
    cells = cells.select("document_id", "cell", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block).alias("block"))
    rows = staged(narrow.withColumn("cell", cell).join(cells, ["document_id", "cell"]).drop("cell"), "vectors")
    path, schema = fresh_folder(spark, "kept"), _KEPT.format(kind)
    blocks = [r["block"] for r in rows.select("block").distinct().orderBy("block").collect()]  # one number for each `block` parts of the longest document

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part").reset_index(drop=True)
        unit = _unit(pdf["vector"])
        at = settled(unit, threshold)
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[at], "part": pdf["part"].iloc[at], "rank": np.arange(1, len(at) + 1, dtype=np.int32), "vector": list(unit[at])})

    def against(pdf: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(old):
            return pd.DataFrame({"document_id": pdf["document_id"].iloc[:0], "part": pdf["part"].iloc[:0]})
        unit, held = _unit(pdf["vector"]), np.array(old["vector"].tolist(), float)
        near = np.zeros(len(unit), bool)
        for a in range(0, len(unit), 1024):
            near[a : a + 1024] = (np.round(unit[a : a + 1024] @ held.T, PLACES) >= threshold).any(axis=1)
        return pdf.loc[near, ["document_id", "part"]]

    for k, number in enumerate(blocks):
        left = rows.where(F.col("block") == number).drop("block")
        if k:
            old = _kept(spark, path, schema, blocks[:k])
            earlier = _kept(spark, path, schema, blocks[:k]).select(F.col("document_id").alias("of"), F.col("block").alias("earlier")).distinct()
            asked = left.join(earlier, F.col("document_id") == F.col("of")).drop("of")
            gone = asked.groupBy("document_id", "earlier").cogroup(old.groupBy("document_id", "block")).applyInPandas(against, f"document_id {kind}, part long").distinct()
            left = left.join(gone, ["document_id", "part"], "left_anti")
        left.groupBy("document_id").applyInPandas(within, schema).write.parquet(f"{path}/{number}")
    kept = _kept(spark, path, schema, blocks).drop("vector")
    before = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    since = kept.groupBy("document_id", "block").agg(F.count("*").alias("n")).select("document_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("since"))
    numbered = kept.join(since, ["document_id", "block"]).select("document_id", F.col("part").alias("_old"), (F.col("since") + F.col("rank")).cast("int").alias("_new"))
    whole = chunks.withColumnRenamed("part", "_old").join(numbered, ["document_id", "_old"])
    return whole.select(*[F.col("_new").alias("part") if c == "part" else F.col(c) for c in chunks.columns])


def _kept(spark, path: str, schema: str, blocks: list[int]) -> DataFrame:
    """What the rounds of these blocks kept."""
    out = spark.createDataFrame([], schema + ", block long")
    for b in blocks:
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/{b}").withColumn("block", F.lit(b).cast("long")))
    return out
