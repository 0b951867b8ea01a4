import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names that a stage might use for itself.
OTHERS = ("_digest", "_of", "_id", "_key", "row", "id", "key", "gone_id", "gone_key", "root", "of", "sig", "slice", "bucket", "first", "n", "Text2")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.exceptAll(kept).isEmpty()
        kept = out
    rows = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in kept.collect()}
    texts = kept.select(F.lower(F.sha2("text", 256)).alias("h"), "doc_id")
    assert rows.join(texts, "doc_id").where("h <> decoded_sha256").count() == 0


def _odd(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, None), (2, ""), (None, "a b"), (None, "A b"), (4, "a b c d e"), (4, "a b c d e"), (5, long), (6, long + " x"), (7, "é\x00"), (8, "y " * 30_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    return rows, odd.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in OTHERS})


#: Ids that each stage keeps of the odd rows; a stage that judges texts by learned weights keeps some of them.
KEPT = {
    "exact dedup": [None, 2, 4, 5, 6, 7, 8],
    "SimHash near-dedup": [None, 1, 4, 5, 7, 8],
    "benchmark decontamination": [None, None, 1, 2, 4, 4, 5, 6, 7, 8],
}


def test_stages_on_odd_tables(spark):
    rows, docs = _odd(spark)
    order = lambda ids: sorted(ids, key=lambda i: (i is not None, i or 0))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        found = got.collect()
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        if name == corpus_pipeline.STAGES[-1][0]:
            assert order(r["doc_id"] for r in found) == order(i for i, _ in rows)
            continue
        assert got.columns == docs.columns, name
        if name in KEPT:
            assert order(r["doc_id"] for r in found) == KEPT[name], name
        for r in found:  # whole rows, none of whose columns has changed
            assert (r["doc_id"], r["text"]) in rows
            assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in OTHERS), name
