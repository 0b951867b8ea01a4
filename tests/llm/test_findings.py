"""Cases of the failed checks of round 3."""

import gc
import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from callweave.llm import common, pieces, quality, resample, shingles
from callweave.llm.queries import VOCABULARY
from pyspark.sql import functions as F


def test_slices_of_a_part_are_merged_one_by_one():
    texts = [" ".join(f"w{(k * j) % 97} x{j % 13}" for j in range(200)).encode() for k in range(20)] * 2
    rows, want, strings = [], Counter(), None
    for _ in range(2):
        _, word, each = resample.grams(texts, 3)
        for own in each:
            strings = resample.spelled(own, word, strings if own.before is not None else None)
            rows += resample._dealt(strings, own.often, np.zeros(len(strings), np.int64), 1, np.arange(len(strings)))
            want.update(dict(zip(strings.to_pylist(), own.often.tolist(), strict=True)))
    parts = [resample.merged(pa.Table.from_pylist(rows), step, piece) for step in (1, resample.STEP) for piece in range(resample.SLICES)]
    assert max(p.num_rows for p in parts) < len(want) / 2  # a task holds one slice
    for half in (parts[: resample.SLICES], parts[resample.SLICES :]):
        got = [(g, n) for p in half for g, n in zip(p["gram"].to_pylist(), p["n"].to_pylist(), strict=True)]
        assert len(got) == len(want) and dict(got) == want


def test_the_near_copies_plans_are_kept_short(spark, monkeypatch):
    key, seen, step = "spark.sql.maxPlanStringLength", [], shingles.settle
    before = spark.conf.get(key)
    monkeypatch.setattr(shingles, "settle", lambda *a: seen.append(spark.conf.get(key)) or step(*a))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")], "doc_id long, text string")
    assert sorted(tuple(r) for r in shingles.near_copies(docs).select("doc_id", "component_id").collect()) == [(1, 1), (2, 1), (3, 3)]
    assert seen == ["4000"] and spark.conf.get(key) == before


def test_the_encoder_keeps_nothing_of_a_batch():
    coder = pieces.Encoder(pieces.load(VOCABULARY))
    batch = lambda k: [" ".join(f"word{k * j % 9973}" for j in range(3000))]
    coder.encode(batch(1))
    gc.collect()
    gc.disable()  # numpy code makes few objects, so that the collector hardly runs
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for k in range(2, 8):
            ids, at = coder.encode(batch(k))
            assert coder.decode(ids, at) == batch(k)
        del ids, at
        assert tracemalloc.get_traced_memory()[0] - before < 100_000
    finally:
        tracemalloc.stop()
        gc.enable()


def test_the_quality_model_is_the_one_of_the_whole_counts(spark):
    texts = {1: "good words " * 400, 2: "bad", 3: "", 4: "other good text", 5: "bad bad text " * 90}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in texts], "doc_id long, label int")
    plans, make = [], type(spark).createDataFrame
    try:
        type(spark).createDataFrame = lambda self, *a, **b: (plans.append(made := make(self, *a, **b)), made)[1]
        got = quality.fit(docs, labels)
    finally:
        type(spark).createDataFrame = make
    assert all("ExistingRDD" not in p._jdf.queryExecution().toString() for p in plans) and plans  # no Python workers of their own
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    s = quality.Setting()
    want = quality.Model(s).fit([quality.features(texts[k].encode(), s) for k in order], np.array([int(k % 2 == 0) for k in order]))
    assert (got.table == want.table).all() and (got.out == want.out).all() and (got.bias == want.bias).all()


def test_each_stage_begins_with_executors_at_rest(spark, monkeypatch):
    begun = []
    monkeypatch.setattr(corpus_pipeline, "release_executors", begun.append)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, "/root/testdata/sf0.001")
        assert begun == [spark] * n
    common.release_executors(spark)
