"""Cases from the review of round 3, each against DuckDB or a plain version."""

import random
import unicodedata
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave import models, registry
from callweave.functions import embedding
from callweave.functions import text as X
from callweave.operators import greedy, html_sections, inverted, relational
from callweave.streaming import keyed

REPLIES = ["ja noñmi", "noíta", "éno", "no", "Still, a", "ſtill", "aſtill", "NOT\u00a0x", "çfixed", "fixedé", "worKs", "isn't", "not_x", "x2no", "thanks!", " ", "", None]


def test_outcomes_end_words_as_the_sql_does(spark, tmp_path):
    rows = [(k, 0, "user", t) for k, t in enumerate(REPLIES)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in registry.queries()["l2_outcomes"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.oracle_sql()["l2_outcomes"]).fetchall())
    assert models.LexiconClassifier().classify("ja noñmi") == "not_resolved"


@pytest.mark.parametrize("partitions", [1, 7])
def test_session_list_has_places(spark, tmp_path, partitions):
    rows = [(k, t, "user", f"s{k}") for k in range(1500) for t in range(1 + k % 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.repartition(partitions).write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.queries()["r17_session_list"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["r17_session_list"])
    assert got.columns == want.columns == ["id", "updated_at", "title", "place"]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_places_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("updated_at"))
        got = relational.placed(rows, F.desc("updated_at"), F.asc("id")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_place = sorted(got, key=lambda r: r["place"])
    assert [r["place"] for r in by_place] == list(range(1, 1001))
    assert [(r["updated_at"], r["id"]) for r in by_place] == sorted(((k * 7919 % 101, k) for k in range(1000)), key=lambda x: (-x[0], x[1]))
    assert relational.placed(rows.where("id < 0"), "id").collect() == []


def test_pages_without_html_are_not_parsed(spark, monkeypatch):
    seen, whole = [], html_sections.elements
    monkeypatch.setattr(html_sections, "elements", lambda pages: seen.append(pages) or whole(pages))
    long = "A sentence of some length that goes on for a while, and ends here. " * 2
    rows = [(1, None, f"Title\n{long}"), (2, "", long), (3, f"<h1>Head</h1><p>{long}</p>", long), (4, "<p>short</p>", long), (5, None, None), (6, None, "  \n"), (7, " ", long), (8, None, " x")]
    got = html_sections.page_sections(spark.createDataFrame(rows, "page_id long, html string, fallback string")).collect()
    assert sorted((r["page_id"], r["section_title"], r["extraction_method"]) for r in got) == sorted(
        [(1, "Title", "text_fallback"), (2, None, "no_section"), (3, "Head", "html_structure"), (4, None, "no_section"), (7, None, "no_section"), (8, None, "no_section")], key=lambda r: r[:1]
    )
    assert {r["page_id"] for r in seen[0].select("page_id").collect()} == {3, 4, 7}


@pytest.mark.parametrize("gap", [1, 10_000])
def test_blocks_go_by_the_parts_that_a_document_has(spark, monkeypatch, gap):
    folders, make = [], greedy.fresh_folder
    monkeypatch.setattr(greedy, "fresh_folder", lambda s, name: folders.append(make(s, name)) or folders[-1])
    rows = [(f"d{k // 20}", gap * (k - 30), [float(k % 7), 1.0, float(k % 3)]) for k in range(200)]
    df = spark.createDataFrame(rows, "document_id string, part long, vector array<double>")
    got = sorted(tuple(r) for r in greedy.dedupe_similar(df.withColumn("was", F.col("part")), 0.99, block=64).select("document_id", "was", "part").collect())
    want = []
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: r[1])
        kept = greedy.settled(greedy._unit(pd.Series([r[2] for r in own])), 0.99)
        want += [(d, own[k][1], n + 1) for n, k in enumerate(kept)]
    assert got == sorted(want)
    assert sorted(p.name for p in Path(folders[0]).iterdir()) == ["0"]  # one round, as no document has more than a block


def test_vectors_are_made_some_at_a_time():
    texts = [f"text {k}" for k in range(1000)] + [None]
    parts = list(embedding.embedder("lexical").func(iter([pa.array(texts)])))
    assert max(map(len, parts)) <= embedding.AT_ONCE and sum(map(len, parts)) == len(texts)
    assert pa.chunked_array(parts)[3].as_py() == embedding.lexical_vector("text 3").tolist() and pa.chunked_array(parts)[1000].as_py() == embedding.lexical_vector("").tolist()


def test_texts_are_normalised_some_at_a_time(spark):
    texts = ["ﬁ" * 200_000, None, "a", "", "é" * 400_000, "x" * 3_000_000] * 3
    parts = list(X.nfkc.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 2 * X.AT_ONCE for p in parts) and len(parts) > 3
    assert pa.chunked_array(parts).to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in texts]
    rows = spark.createDataFrame([(k, f"ﬁ{k}" if k % 3 else None) for k in range(25_000)], "k int, t string").coalesce(1)
    assert rows.select("k", X.nfkc("t").alias("n")).where("n <> concat('fi', k) OR (n IS NULL) <> (k % 3 = 0)").count() == 0


def test_characters_are_counted_without_a_match_for_each(spark):
    spaces = [chr(k) for k in range(1, 0x3100) if k not in range(0xD800, 0xE000)]
    df = spark.createDataFrame([(c, f"{c}a{c}b{c}") for c in spaces], "c string, t string")
    assert df.where(X.stripped("t") != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    rng = random.Random(4)
    texts = ["", " ", "ab", "ال في على", *("".join(rng.choices("ab \n\t-12٣'_ﻻﭐݐ ‎‏ل ا في́é😀�☃|", k=rng.randint(1, 300))) for _ in range(200))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    n = lambda p: F.regexp_count("t", F.lit(p))
    marks = X.PROSE_MARKS
    plain = {
        "letters": n(r"\p{L}"), "visible": n(r"(?U)\S"), "arabic": F.when(n(r"\p{L}") > 0, n(rf"(?=\p{{L}}){X.ARABIC}") / n(r"\p{L}")).otherwise(0.0),
        "filler": F.when(n(r"(?U)\S") > 0, n(rf"(?U)[^\s\p{{L}}\p{{N}}{marks}]") / n(r"(?U)\S")).otherwise(0.0), "words": n(r"[؀-ۿ]+"), "marked": n(" في "),
        "tokens": F.size(X.words("t")), "norm": F.regexp_replace(F.regexp_replace("t", "ـ|[ً-ْٰۖ-ۭ]", ""), "[ \t\xa0‏‎]+", " "),
    }
    quick = {
        "letters": X.letters("t"), "visible": X._visible(F.col("t")), "arabic": X.arabic_ratio("t"), "filler": X.non_text_ratio("t"), "words": X.reversal("t")["arabic_words"], "marked": X._times(F.col("t"), " في "),
        "tokens": X._times(X.squeezed("t", r"(?U)[^\w؀-ۿ]"), " "), "norm": F.regexp_replace(F.regexp_replace(F.regexp_replace("t", "[ـً-ْٰۖ-ۭ]", ""), "[\t\xa0‏‎]", " "), " {2,}", " "),
    }
    got = df.select(*[F.struct(plain[k].alias("plain"), quick[k].alias("quick")).alias(k) for k in plain]).collect()
    assert [(k, r[k]) for r in got for k in plain if r[k]["plain"] != r[k]["quick"]] == []
    plan = df.select(X.quality("t", F.lit(1), F.lit(1), F.lit(0)).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?U)\\S" not in plan and plan.count("regexp_extract_all") <= 2 and plan.count("regexp_count") <= 2


def test_posting_lists_take_one_exchange(spark, tmp_path):
    rows = [(f"c{k:02}", (k * 7 % 20) if k % 9 else None, [f"t{k % 4}", None, "é", "Z"] if k % 5 else [[], None][k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "chunk_id string, ordinal long, tokens array<string>").repartition(3)
    inverted.build(df, str(tmp_path / "i"), 1 << 20)
    got = spark.read.parquet(str(tmp_path / "i/lists")).collect()
    places = {(r["shard"], r["place"]): (r["chunk_id"], r["ordinal"]) for r in got if r["place"] is not None}
    assert sorted(c for c, _ in places.values()) == sorted(r[0] for r in rows)
    for shard in {s for s, _ in places}:
        own = [places[s, p] for s, p in sorted(places) if s == shard]
        assert own == sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    found = sorted((places[r["shard"], p][0], r["term"]) for r in got if r["term"] is not None for p in r["places"])
    assert found == sorted((c, t) for c, _, tokens in rows for t in tokens or [] if t)
    assert all(r["df"] == len(r["places"]) and r["places"] == sorted(r["places"]) for r in got if r["term"] is not None)
    assert not (tmp_path / "i/places").exists()  # tokens are not joined with their chunks' places any more


def test_a_new_key_has_no_timers_to_ask_for():
    asked = []

    class Handle:
        def listTimers(self):
            asked.append("list")
            return iter([(5,)])

        def deleteTimer(self, at):
            asked.append(at)

        def registerTimer(self, at):
            asked.append(-at)

    alone = keyed._Ends(1)
    alone.handle = Handle()
    alone.renew(9, False)
    alone.renew(10, True)
    assert asked == [-9, "list", 5, -10]
