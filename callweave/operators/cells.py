"""Approximate search: vectors filed by their nearest centroid, of which a question reads only the nearest few.

Centroids are fitted on a bounded sample; every vector is filed.  Cells are
partitions of the stored table, so that what a search does not ask for is not read,
and inside the cells it reads the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieval

#: Vectors that the centroids are fitted on at most, centroids at most, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 1 << 16, 4096, 12
#: Recall that a search is tuned for, and vectors of the sample that it is tuned on.
RECALL, TUNED = 0.95, 1 << 14
#: Cells that a scan is filtered by; beyond it the list is joined.
FILTERED = 4096


def fit(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors: the mean direction of what is nearest, again and again; an empty cell takes the vector that lies farthest off."""
    rng = np.random.default_rng(seed)
    centre = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        at, near = assigned(vectors, centre)
        total = np.zeros_like(centre)
        np.add.at(total, at, vectors)
        far = np.argsort(near, kind="stable")
        for k, empty in enumerate(np.flatnonzero(np.bincount(at, minlength=len(centre)) == 0)):
            total[empty] = vectors[far[k % len(far)]]
        centre = retrieval.unit_rows(total)
    return centre


def assigned(vectors: np.ndarray, centre: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the first among equals, and the cosine with it."""
    at, near = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for a in range(0, len(vectors), step):
        product = vectors[a : a + step] @ centre.T
        at[a : a + step] = product.argmax(axis=1)
        near[a : a + step] = product.max(axis=1)
    return at, near


def cells_needed(vectors: np.ndarray, centre: np.ndarray, target: float, n: int = 10, asked: int = 256) -> int:
    """How many of a question's nearest cells hold the `target` share of its n nearest vectors: asked on the sample, each of `asked` vectors once."""
    at, _ = assigned(vectors, centre)
    q = vectors[:: max(1, len(vectors) // asked)][:asked]
    near = np.argsort(-(q @ vectors.T), axis=1, kind="stable")[:, : n + 1]  # itself among them
    place = np.argsort(np.argsort(-(q @ centre.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, at[near], axis=1)[:, 1:]
    return int(np.quantile(ranks, target, method="higher")) + 1 if ranks.size else 1


def build(chunks: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, target: float = RECALL) -> None:
    """Write the table of vectors by cell, and the centroids, of chunks (chunk_id, ordinal, vector) to path.

    The number of cells is the square root of the vectors' number, unless given, at
    most MOST_CELLS.  The fit reads the `sample` vectors with the least hash of their
    id; all vectors are filed, zero ones in the first cell.  With the centroids goes
    the number of cells that a search must read for the `target` recall, as measured
    on TUNED vectors of the sample.  Chunks without a vector are left out.
    """
    spark = chunks.sparkSession
    rows = chunks.where("vector IS NOT NULL").select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("vector").cast("array<double>").alias("vector"))
    count = rows.count()
    some = rows.select("vector", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(sample).select("vector").collect()  # bounded above
    vectors = retrieval.unit_rows(np.array([r["vector"] for r in some], float)) if some else np.zeros((0, 1))
    centre = fit(vectors, min(MOST_CELLS, cells or max(1, round(count**0.5)))) if some else vectors
    near = cells_needed(vectors[:TUNED], centre, target) if some else 1
    spark.createDataFrame([(k, [float(x) for x in c], near) for k, c in enumerate(centre)], "cell int, centre array<double>, near int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    def file(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                at, _ = assigned(retrieval.unit_rows(np.array(pdf["vector"].tolist(), float)), centre)
                yield pdf.assign(cell=at.astype(np.int32))

    filed = rows.mapInPandas(file, "chunk_id string, ordinal long, vector array<double>, cell int")
    # a cell of many rows is dealt to several writers, so that no task holds a whole one
    filed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, -(-count // (1 << 20)))))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def probes(spark: SparkSession, path: str, queries: list, near: int | None) -> dict[int, list[int]]:
    """For each cell the numbers of the given questions (rows with qvec) that have it among their `near` nearest ones, as many as the index was tuned for if None."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    centre = np.array([r["centre"] for r in rows], float)
    near = near if near is not None else rows[0]["near"] if rows else 0
    asked = retrieval.unit_rows(np.array([r["qvec"] for r in queries], float))
    out: dict[int, list[int]] = {}
    if len(centre):
        for q, row in enumerate(np.argsort(-(asked @ centre.T), axis=1, kind="stable")[:, :near]):
            for c in row.tolist():
                out.setdefault(c, []).append(q)
    return out


def search(spark: SparkSession, path: str, queries: DataFrame, n: int, near: int | None = None) -> DataFrame:
    """(query_id, chunk_id, ordinal, rank, score, distance) as `retrieval.semantic_search`, over the cells nearest to each question (query_id, qvec): `near` of them, or as many as the index was tuned for.

    A question's rows are exact within its cells; rows of other cells may be missed.
    """
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, chunk_id string, ordinal long, d double"
    table, found = spark.read.schema("chunk_id string, ordinal long, vector array<double>, cell int").parquet(f"{path}/vectors"), None
    for block in retrieval._question_blocks(queries):
        rows = block.collect()  # bounded by the size of the vectors
        ids, wanted = pd.Series([r["query_id"] for r in rows]), probes(spark, path, rows, near)
        asked = retrieval.unit_rows(np.array([r["qvec"] for r in rows], float))
        cells = sorted(wanted)
        if len(cells) <= FILTERED:
            read = table.where(F.col("cell").isin(cells))
        else:
            read = table.join(F.broadcast(spark.createDataFrame([(c,) for c in cells], "cell int")), "cell", "left_semi")

        def run(it: Iterator[pd.DataFrame], ids: pd.Series = ids, asked: np.ndarray = asked, wanted: dict = wanted) -> Iterator[pd.DataFrame]:
            for whole in it:
                for cell, pdf in whole.groupby("cell", sort=False):
                    who = np.array(wanted[int(cell)])
                    rows = max(1, min(1024, retrieval.PRODUCT_BYTES // (8 * len(who))))
                    for a in range(0, len(pdf), rows):
                        part = pdf.iloc[a : a + rows]
                        d = np.round(1 - asked[who] @ retrieval.unit_rows(np.array(part["vector"].tolist(), float)).T, 12)
                        ordinal = part["ordinal"].to_numpy()
                        order = np.lexsort((np.broadcast_to(ordinal, d.shape), d), axis=1)[:, :n]
                        q = np.repeat(np.arange(len(who)), order.shape[1])
                        yield pd.DataFrame({"query_id": ids.to_numpy()[who[q]], "chunk_id": part["chunk_id"].to_numpy()[order.ravel()], "ordinal": ordinal[order.ravel()], "d": d[q, order.ravel()]})

        near_rows = read.mapInPandas(run, schema)
        found = near_rows if found is None else found.unionByName(near_rows)
    if found is None:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("d", "ordinal")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("query_id", "chunk_id", "ordinal", "rank", F.round(F.greatest(F.lit(0.0), 1 - F.col("d")), 6).alias("score"), F.round("d", 6).alias("distance"))
