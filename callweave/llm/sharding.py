"""Balanced shards by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table

#: Hash bundles that small groups are packed by; the driver sees at most 13 times as many items.
BUNDLES = 2048
#: A group that is over half a shard's share is cut into parts of about 1/SPLIT of it.
SPLIT = 8
#: Rows numbered in one task, about.
NUMBERED = 20_000


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (n x dimensions).

    Large items first, each to the shard where the dot product of its size with
    the residual capacity is highest (sizes as shares of a shard's capacity); an
    item goes only where the first dimension keeps room, unless none does.  Items of
    equal size go in their order; without items there is nothing to place.
    """
    total = np.maximum(items.sum(axis=0), 1).astype(float)
    share = items / total * shards
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for k in np.lexsort((np.arange(len(items)), -share.max(axis=1))):
        fit = left @ share[k]
        room = left[:, 0] >= share[k, 0]
        s = int(np.argmax(np.where(room, fit, -np.inf) if room.any() else left[:, 0]))
        out[k] = s
        left[s] -= share[k]
    return out


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; the law held is `bytes`.

    size is the text's UTF-8 bytes plus 1.  Rows with equal texts form a group and
    stay together.  Bytes, tokens (runs of other bytes than white space) and rows
    are balanced jointly.  Groups of over 1/(4 BUNDLES) of the bytes, tokens or
    rows are items of their own, at most 12 BUNDLES of them; all others go by a
    hash to BUNDLES items: the packing's input is bounded whatever the table's size.
    A group of over half a shard's share in any dimension is first cut by row into
    parts of about 1/SPLIT of it: no group makes its shard larger than others.

    slot numbers a shard's rows from 0 without gaps: rows are counted by chunks
    and numbered inside a chunk.  Rows are told apart by their place in the written
    table, so that rows alike in everything are dealt over parts and chunks as
    others are.  Null texts count as empty (size 1, checksum 0); null ids and
    repeated rows are rows like others; other columns are ignored; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = as_table(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long").alias("tokens"),
            F.unhex(F.md5(text.cast("binary"))).alias("grp"),
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),
        ),
        "shard-rows",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    kinds = ("bytes", "tokens", "rows")
    groups = as_table(rows.groupBy("grp").agg(*sums), "shard-groups")
    whole = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kinds]).first()
    largest = F.greatest(*[F.col(c) / F.lit(float(max(1, whole[c]))) for c in kinds])  # a group's share of the table
    heavy = groups.where(largest * (4 * BUNDLES) > 1).select("*", F.when(largest * (2 * shards) > 1, F.ceil(largest * (shards * SPLIT))).otherwise(1).cast("int").alias("parts")).orderBy("grp").collect()
    spark = df.sparkSession
    # at most 12 BUNDLES rows: a bound that no table exceeds
    parts = F.broadcast(spark.createDataFrame([(bytes(r["grp"]), r["parts"]) for r in heavy], "grp binary, parts int"))
    dealt = rows.join(parts, "grp", "left").withColumn("part", F.pmod("row", "parts").cast("int"))
    split = F.broadcast(spark.createDataFrame([(bytes(r["grp"]), r["parts"]) for r in heavy if r["parts"] > 1], "grp binary, parts int"))
    pieces = rows.join(split, "grp").groupBy("grp", F.pmod("row", "parts").cast("int").alias("part")).agg(*sums).orderBy("grp", "part").collect()
    items = [(bytes(r["grp"]), 0, r) for r in heavy if r["parts"] == 1] + [(bytes(r["grp"]), r["part"], r) for r in pieces]
    bundle = F.pmod(F.xxhash64("grp"), F.lit(BUNDLES)).cast("int")
    light = groups.where(largest * (4 * BUNDLES) <= 1).groupBy(bundle.alias("bundle")).agg(*[F.sum(c).alias(c) for c in kinds]).orderBy("bundle").collect()
    sizes = np.array([[r[c] for c in kinds] for r in [*(r for _, _, r in items), *light]], float).reshape(-1, 3)
    where = pack(sizes, shards).tolist()
    of_bundle = [0] * BUNDLES
    for r, s in zip(light, where[len(items) :], strict=True):
        of_bundle[r["bundle"]] = s
    own = F.broadcast(spark.createDataFrame([(g, k, s) for (g, k, _), s in zip(items, where, strict=False)], "grp binary, part int, own int"))
    by_bundle = F.element_at(F.array(*[F.lit(s) for s in of_bundle]), bundle + 1)
    placed = dealt.join(own, ["grp", "part"], "left").select("doc_id", "size", "text_crc32", "row", F.coalesce("own", by_bundle).alias("shard"))
    return _numbered(placed, max(1, -(-int(whole["rows"]) // NUMBERED)))


def _numbered(placed: DataFrame, chunks: int) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard."""
    from pyspark.sql import Window

    dealt = as_table(placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")), "placed")
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "row")
    return dealt.withColumn("rank", F.row_number().over(inside)).join(before, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
