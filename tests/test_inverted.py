"""Keyword search in the stored index against every chunk scored by itself."""

import random

import numpy as np
import pytest
from callweave.operators import inverted, retrieval


def _plain(rows, terms, n):
    own = list(dict.fromkeys(t for t in terms if len(t) > 1))
    out = []
    for chunk, ordinal, tokens in rows:
        both = [t for t in own if tokens and t in tokens]
        if both:
            out.append((len(both) / len(own) + 0.75 * sum(t.isdecimal() for t in both), ordinal, chunk))
    return [(c, k + 1, s) for k, (s, o, c) in enumerate(sorted(out, key=lambda r: (-r[0], r[1]))[:n])]


@pytest.mark.parametrize(("shard", "filtered"), [(32768, 4096), (40, 4096), (40, 3)])
def test_search_equals_a_full_scan(spark, tmp_path, monkeypatch, shard, filtered):
    monkeypatch.setattr(inverted, "FILTERED", filtered)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + [str(k) for k in range(12)] + ["ما", "x"]
    pick = lambda n: sorted({words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n)})
    rows = [(f"c{k}", k * 3 % 1000, pick(rng.randrange(1, 30))) for k in range(300)] + [("none", 5000, None), ("empty", 5001, [])]
    asked = [(q, [rng.choice(words) for _ in range(rng.randrange(0, 9))]) for q in range(40)] + [(90, ["absent", "w1"]), (91, ["absent"]), (92, None), (93, ["x", "w0", "w0"])]
    inverted.build(spark.createDataFrame(rows, "chunk_id string, ordinal long, tokens array<string>").repartition(3), str(tmp_path / "i"), shard)
    found = inverted.search(spark, str(tmp_path / "i"), spark.createDataFrame(asked, "query_id int, terms array<string>"), 10).collect()
    for q, terms in asked:
        got = [(r["chunk_id"], r["rank"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == _plain(rows, terms or [], 10)
    assert all(r["distance"] == 1 - r["score"] for r in found)


def test_bounds_change_no_result():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size, total, n = int(rng.integers(1, 400)), int(rng.integers(1, 9)), int(rng.integers(1, 8))
        lists = [np.sort(rng.choice(size, int(rng.integers(1, size + 1)), replace=False)) for _ in range(int(rng.integers(1, total + 1)))]
        worth = [inverted.NUMBER * (rng.random() < 0.3) for _ in lists]
        score, hits = np.zeros(size), np.zeros(size, int)
        for own, w in zip(lists, worth, strict=True):
            hits[own] += 1
            score[own] += w
        score += hits / total
        want = sorted(np.flatnonzero(hits).tolist(), key=lambda k: (-round(score[k], 9), k))[:n]
        at, got = inverted.best(lists, worth, total, n, size)
        assert at.tolist() == want and np.allclose(got, score[want])


def test_a_search_reads_no_text(spark, tmp_path):
    rows = [(f"c{k}", k, ["one", f"t{k}"]) for k in range(50)]
    inverted.build(spark.createDataFrame(rows, "chunk_id string, ordinal long, tokens array<string>"), str(tmp_path / "i"))
    q = spark.createDataFrame([(1, ["t3", "one"])], "query_id int, terms array<string>")
    plan = inverted.search(spark, str(tmp_path / "i"), q, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), In(term" in plan.replace("[In(term", "[IsNotNull(term), In(term") and "/tokens" not in plan
    empty = spark.createDataFrame([], "chunk_id string, ordinal long, tokens array<string>")
    inverted.build(empty, str(tmp_path / "e"))
    assert inverted.search(spark, str(tmp_path / "e"), q, 5).count() == 0


def test_retrieval_with_and_without_an_index(spark, tmp_path):
    rows = [(f"c{k}", k, ["one", f"t{k % 7}"], [float(k % 5), 1.0]) for k in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ordinal long, tokens array<string>, vector array<double>")
    q = spark.createDataFrame([(1, ["t3", "one"], [1.0, 0.0]), (2, ["t9"], [0.0, 1.0])], "query_id int, terms array<string>, qvec array<double>")
    inverted.build(chunks, str(tmp_path / "i"))
    a, b = (sorted(map(tuple, retrieval.keyword_search(chunks, q, 8, i).collect())) for i in (None, str(tmp_path / "i")))
    assert a == b and a


def test_products_are_bounded(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{k}", k, [float(k % 5), 1.0]) for k in range(60)], "chunk_id string, ordinal long, vector array<double>")
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "query_id int, qvec array<double>")
    want = sorted(map(tuple, retrieval.semantic_search(chunks, q, 8).collect()))
    monkeypatch.setattr(retrieval, "PRODUCT_BYTES", 8 * 9 * 4)
    assert sorted(map(tuple, retrieval.semantic_search(chunks, q, 8).collect())) == want
