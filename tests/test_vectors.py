"""Greedy de-duplication by blocks against the plain loop, and approximate search against the exact one."""

import numpy as np
import pytest
from callweave.operators import cells, greedy, retrieval


def _plain(vectors, threshold):
    kept = []
    for k, v in enumerate(vectors):
        n = np.linalg.norm(v)
        if not (n > 0 and any(np.linalg.norm(vectors[j]) > 0 and round(float(v @ vectors[j] / n / np.linalg.norm(vectors[j])), 12) >= threshold for j in kept)):
            kept.append(k)
    return kept


def _vectors(n, seed, size=8, near=0.2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 6), size))
    out = base[rng.integers(0, len(base), n)] + near * rng.normal(size=(n, size))
    out[:: max(2, n // 7)] = 0
    out[1::9] = out[min(2, n - 1)]
    return out


@pytest.mark.parametrize("step", [1, 7, 256])
def test_settled_equals_the_loop(step):
    for seed in range(20):
        v = _vectors(60, seed)
        unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
        assert greedy.settled(unit, 0.9, step).tolist() == _plain(v, 0.9)


@pytest.mark.parametrize("block", [4096, 16])
def test_documents_of_any_length(spark, block):
    rows, want = [], []
    for d, n in (("long", 150), ("one", 1), ("mid", 33), ("zeros", 3)):
        v = _vectors(n, n) if d != "zeros" else np.zeros((3, 8))
        rows += [(d, k + 1, f"{d}{k}", v[k].tolist()) for k in range(n)]
        want += [(d, new, f"{d}{k}") for new, k in enumerate(_plain(v, 0.9), 1)]
    rows += [("mid", None, "no part", [1.0] * 8), ("mid", 99, "no vector", None)]
    df = spark.createDataFrame(rows, "document_id string, part int, chunk_id string, vector array<double>").repartition(3)
    got = greedy.dedupe_similar(df, 0.9, block)
    assert got.columns == df.columns
    assert sorted((r["document_id"], r["part"], r["chunk_id"]) for r in got.collect()) == sorted(want)
    assert greedy.dedupe_similar(df.limit(0), 0.9).count() == 0


def test_a_document_of_many_chunks(spark):
    """Twenty thousand chunks in blocks of 4,096: as many are kept as there are directions, and no task holds more than two blocks."""
    n, sides = 20_000, 64
    df = spark.range(n).selectExpr("'d' AS document_id", "CAST(id + 1 AS INT) AS part", f"transform(sequence(0, {sides - 1}), k -> IF(k = pmod(xxhash64(id), {sides}), 1.0D + id, 0.0D)) AS vector")
    assert greedy.dedupe_similar(df, 0.92).count() == sides


def _recall(spark, tmp_path, chunks, queries, near, n=10):
    path = str(tmp_path / f"c{near}")
    cells.build(chunks, path)
    want = {(r["query_id"], r["chunk_id"]) for r in retrieval.semantic_search(chunks, queries, n).collect()}
    rows = cells.search(spark, path, queries, n, near).collect()
    got = {(r["query_id"], r["chunk_id"]) for r in rows}
    read = spark.read.parquet(f"{path}/vectors").groupBy("cell").count().collect()
    own = cells.probes(spark, path, queries.where("qvec IS NOT NULL").collect(), near)
    scanned = sum(r["count"] * len(own.get(r["cell"], ())) for r in read) / max(1, queries.count() * sum(r["count"] for r in read))
    print(f"near {near}: recall@{n} {len(got & want) / len(want):.3f}, rows scanned a question {scanned:.3f}")
    return len(got & want) / len(want), scanned


def test_recall_on_the_tables_vectors(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS ordinal", "concat('c', vec_id) AS chunk_id", "embedding AS vector")
    q = e.where("ordinal % 50 = 0").selectExpr("ordinal AS query_id", "vector AS qvec")
    recall, scanned = _recall(spark, tmp_path, e, q, None)
    assert recall >= 0.9 and scanned < 0.8


def test_recall_on_many_clusters(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(100, 16))
    v = centre[rng.integers(0, 100, 6000)] + 0.35 * rng.normal(size=(6000, 16))
    chunks = spark.createDataFrame([(f"c{k}", k, x.tolist()) for k, x in enumerate(v)] + [("none", 9999, None), ("zero", 9998, [0.0] * 16)], "chunk_id string, ordinal long, vector array<double>")
    queries = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 6000, 50)] + [(-1, None)], "query_id int, qvec array<double>")
    recall, scanned = _recall(spark, tmp_path, chunks, queries, None)
    assert recall >= 0.9 and scanned < 0.3
    every, _ = _recall(spark, tmp_path, chunks, queries, 4096)
    assert every == 1.0


def test_a_search_reads_its_cells_only(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{k}", k, [float(k % 3 == 0), float(k % 3 == 1), float(k % 3 == 2)]) for k in range(90)], "chunk_id string, ordinal long, vector array<double>")
    cells.build(chunks, str(tmp_path / "i"), cells=3)
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0])], "query_id int, qvec array<double>")
    found = cells.search(spark, str(tmp_path / "i"), q, 40, near=1)
    assert sorted(r["ordinal"] for r in found.collect()) == list(range(0, 90, 3))
    assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().toString()
    empty = chunks.limit(0)
    cells.build(empty, str(tmp_path / "e"))
    assert cells.search(spark, str(tmp_path / "e"), q, 5).count() == 0
