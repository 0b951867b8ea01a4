"""Operators that SQL does not express, on literals and against plain versions."""

import random
import re
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callweave import models
from callweave.functions import embedding
from callweave.functions import reading_order
from callweave.functions import text as X
from callweave.operators import chunking, evaluation, greedy, html_sections, metrics, mutations, retrieval, tables
from callweave.plans import ingest
from callweave.plans.intent import AnalyticsIntent, RuleParser, follow_up, verbalise
from callweave.plans.tenancy import Tenant, TenantScopeError, clean_filters, require, resolve
from callweave.sources import files, webhooks
from callweave.streaming import calls as C
from callweave.streaming import files as streaming_files

NOW = datetime(2001, 8, 1)


@pytest.fixture(scope="module")
def desk(spark):
    t = [(1, 1, 10, "Internet", "resolved"), (2, 1, 11, "Internet", "needs_agent"), (3, 1, 11, "Billing", "needs_agent"), (5, 1, 12, "New issue", "pending_follow_up"), (4, 2, 20, "Other company issue", "resolved")]
    c = [(1, 1, "completed", "resolved", 60, "Internet connection"), (1, 2, "completed", "not_resolved", 180, "Internet connection"), (1, 3, "no_answer", None, None, None), (2, 4, "completed", "resolved", 90, "Billing")]
    tickets = spark.createDataFrame([(*r, NOW) for r in t], "id int, company_id int, customer_id int, subject string, status string, created_at timestamp_ntz")
    calls = spark.createDataFrame([(*r, NOW) for r in c], "company_id int, ticket_id int, status string, outcome string, duration_seconds int, reason string, created_at timestamp_ntz")
    return tickets, calls


def ask(desk, name, period="all_time", limit=5, company=1):
    return [tuple(r) for r in metrics.metric(AnalyticsIntent(name, period, limit), Tenant(company), *desk, "2001-08-01 00:00:00").collect()]


def test_metric_fixture(desk):
    ones = {"resolved_tickets": 1, "unresolved_tickets": 3, "total_tickets": 4, "customers_with_unresolved_tickets": 2, "total_calls": 3, "resolved_calls": 1, "unresolved_calls": 1, "no_answer_calls": 1, "failed_calls": 0, "unclear_calls": 0, "average_call_duration": 120.0}
    for name, value in ones.items():
        assert ask(desk, name) == [(value,)], name
    assert ask(desk, "top_issues") == [("Internet", 2), ("Billing", 1), ("New issue", 1)]
    assert ask(desk, "common_call_reasons") == [("Internet connection", 2), ("Billing", 1)]
    assert ask(desk, "calls_by_outcome") == [("no_answer", 1), ("not_resolved", 1), ("resolved", 1)]
    assert ask(desk, "unresolved_ticket_list") == [("Billing", "needs_agent", 1), ("Internet", "needs_agent", 1), ("New issue", "pending_follow_up", 1)]
    assert ask(desk, "tickets_needing_agent_call") == [(1, 1, [(5, "New issue")])]
    assert ask(desk, "average_call_duration", company=9) == [(None,)] and ask(desk, "total_calls", company=9) == [(0,)]
    old = desk[0].unionByName(desk[0].where("id = 1").withColumns({"id": F.lit(9), "created_at": F.lit(NOW - timedelta(60)).cast("timestamp_ntz")}))
    edge = old.unionByName(desk[0].where("id = 1").withColumns({"id": F.lit(8), "created_at": F.lit(NOW - timedelta(30)).cast("timestamp_ntz")}))
    assert ask((edge, desk[1]), "resolved_tickets", "last_30_days") == [(2,)] and ask((edge, desk[1]), "resolved_tickets") == [(3,)]


def test_plans():
    assert follow_up("which are they? which ones", "unresolved_tickets", "this_month") == AnalyticsIntent("unresolved_ticket_list", "this_month", 20)
    assert follow_up("are these all", "unresolved_ticket_list", None).metric == "tickets_needing_agent_call"
    assert follow_up("ايه هما", "resolved_tickets", None).metric == "resolved_ticket_list"
    assert follow_up("how many", "resolved_tickets", None) is None and follow_up("list them", "total_calls", None) is None
    for bad in (("x", "all_time", 1), ("total_calls", "ever", 1), ("total_calls", "all_time", 21)):
        with pytest.raises(ValueError):
            AnalyticsIntent(*bad)
    assert RuleParser().parse("top 3 call reasons this month") == AnalyticsIntent("common_call_reasons", "this_month", 3)
    assert "value" not in verbalise(AnalyticsIntent("total_calls"), [{"value": 3}])
    with pytest.raises(TenantScopeError):
        require(None)
    assert resolve(True, "super_admin", None, 4) == 4 and resolve(True, "agent", 2, None) == 2
    with pytest.raises(PermissionError):
        resolve(True, "admin", 2, 3)
    assert clean_filters({"language": "ar", "domain": "x", "source": None}) == ({"language": "ar"}, ["domain", "source"])


def plain_chain(sem, kw, meta, k, weight):
    """Fusion, content de-duplication and diversification one row at a time."""
    fused, first = Counter(), {}
    for w, rows in ((1.0, sem), (weight, kw)):
        for r, (c, s) in enumerate(rows, 1):
            first.setdefault(c, s)
            fused[c] += w / (60 + r)
    order = sorted(first, key=lambda c: -fused[c])
    best, slots = {}, []
    for c in order:
        h = meta[c][0]
        if h not in best:
            best[h] = (c, [])
            slots.append(h)
            continue
        o, alts = best[h]
        keep, drop = (o, c) if first[o] >= first[c] else (c, o)
        alts = list(alts) if keep == o else []
        if meta[drop][3] and meta[drop][3] not in alts:
            alts.append(meta[drop][3])
        best[h] = (keep, alts)
    rows = [best[h] for h in slots]
    seen, now, later = set(), [], []
    for c, alts in rows:
        d, s = meta[c][1], meta[c][2]
        if s in (None, -1) or (d, s) in seen:
            later.append((c, alts))
        else:
            seen.add((d, s))
            now.append((c, alts))
    return (now + later)[:k]


def test_ranking_chain_with_ties(spark):
    rng = random.Random(1)
    sem_rows, kw_rows, meta_rows, q_rows, want = [], [], [], [], {}
    for q in range(40):
        ids = [f"q{q}c{i}" for i in range(12)]
        meta = {c: (rng.choice("abcdef"), rng.choice("xy"), rng.choice([None, -1, 0, 1, 2]), rng.choice(["", "u1", "u2", "u3"])) for c in ids}
        sem = [(c, rng.choice([0.2, 0.5, 0.9])) for c in rng.sample(ids, 8)]
        kw = [(c, rng.choice([0.2, 0.5, 1.5])) for c in rng.sample(ids, 7)]
        digit = rng.random() < 0.5
        want[q] = plain_chain(sem, kw, meta, 6, 2.0 if digit else 1.25)
        sem_rows += [(q, c, 0, r, s) for r, (c, s) in enumerate(sem, 1)]
        kw_rows += [(q, c, 0, r, s) for r, (c, s) in enumerate(kw, 1)]
        meta_rows += [(c, *meta[c]) for c in ids]
        q_rows.append((q, ["12", "a"] if digit else ["a"]))
    lists = "query_id int, chunk_id string, ordinal int, rank int, score double"
    fused = retrieval.fuse(spark.createDataFrame(sem_rows, lists), spark.createDataFrame(kw_rows, lists), spark.createDataFrame(q_rows, "query_id int, terms array<string>"))
    rows = fused.join(spark.createDataFrame(meta_rows, "chunk_id string, content_hash string, document_id string, section_index int, source_url string"), "chunk_id")
    got = {}
    for r in retrieval.diversify(retrieval.dedupe_content(rows), 6).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], list(r["duplicate_source_urls"])))
    assert {q: [c for c, _ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items()}
    assert got == want


def test_terms_and_vectors(spark):
    one = spark.createDataFrame([("هل ينفع أقل اوردر 880 الطلبات؟",)], "t string").select(retrieval.query_terms("t"), retrieval.document_tokens("t")).first()
    assert {"اقل", "minimum", "طلبيه", "order", "880", "طلبات", "الطلبات"} <= set(one[0]) and not {"هل", "ينفع"} & set(one[0])
    assert {"هل", "طلبات"} <= set(one[1])
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>").select(retrieval.cosine_distance("a", "b")).collect()
    assert [r[0] for r in v] == [1.0, 0.0]
    parts = spark.createDataFrame([("d", 1, [1.0, 0.0]), ("d", 2, [0.99, 0.1]), ("d", 3, [0.0, 1.0]), ("d", 4, [0.0, 0.0])], "document_id string, part int, vector array<double>")
    assert [(r["part"], r["vector"][1]) for r in greedy.dedupe_similar(parts, 0.95).orderBy("part").collect()] == [(1, 0.0), (2, 1.0), (3, 0.0)]
    assert abs(sum(x * x for x in embedding.lexical_vector("a word")) - 1) < 1e-9 and len(embedding.hash_vector("a")) == 256


def test_ranking_examples(spark):
    rows = spark.createDataFrame([(1, r + 1, int(g > 0), float(g)) for r, g in enumerate([3, 2, 3, 0, 1, 2])] + [(2, 3, 1, 1.0), (2, 1, 0, 0.0), (2, 2, 0, 0.0)], "question_id int, rank int, rel int, gain double")
    out = {r["question_id"]: r for r in evaluation.ranking_metrics(rows, spark.createDataFrame([(1, 5), (2, 1), (3, 0)], "question_id int, n_relevant int"), (3, 6)).collect()}
    assert abs(out[1]["dcg_6"] - 6.861) < 0.001 and out[2]["ndcg_3"] == 0.5 and abs(out[2]["mrr"] - 1 / 3) < 1e-12
    assert out[3]["mrr"] == 0 and out[3]["recall_3"] == 0 and out[1]["precision_6"] == 5 / 6
    q = spark.createDataFrame([("q", ["http://A/x/"], [], [], {"http://a/X": 3.0})], "id string, relevant_source_urls array<string>, relevant_document_ids array<string>, relevant_sections array<string>, graded_relevance map<string,double>")
    r = spark.createDataFrame([("q", 1, " http://a/X ", "d", ["S"]), ("q", 2, "http://b", "d", ["S"])], "question_id string, rank int, source_url string, document_id string, section_path array<string>")
    assert [tuple(x) for x in evaluation.graded(r, q).orderBy("rank").select("rel", "gain").collect()] == [(1, 3.0), (0, 0.0)]
    one = spark.range(1).select(
        evaluation.citation_validity(F.lit("[1][9]"), F.lit(2)), evaluation.citation_validity(F.lit("x"), F.lit(2)), evaluation.citation_completeness(F.lit("It is 5 GB [1]. It costs 7 EGP.")), evaluation.citation_completeness(F.lit("none here")),
        evaluation.token_f1(F.lit("a b"), F.lit("b a")), evaluation.token_f1(F.lit("a"), F.lit("b")), evaluation.token_f1(F.lit("a"), F.lit(None).cast("string")), evaluation.judge_scores(F.lit('so {"faithfulness": 5, "context_recall": -2, "x": 1}')), evaluation.refusal_score(F.lit(True), F.lit(False)),
        evaluation.citation_correctness(F.lit("a b c"), F.array(F.lit("a z"), F.lit("q"))),
    ).first()
    assert list(one[:7]) == [0.5, None, 0.5, None, 1.0, 0.0, None]
    assert (one[7]["faithfulness"], one[7]["context_recall"], one[7]["answer_relevance"], one[8], one[9]) == (1.0, 0.0, None, 1.0, 0.5)
    cost = evaluation.priced(spark.createDataFrame([("gpt-4o-mini-x", 1_000_000, 0), ("other", 1, 1)], "model string, tokens_in long, tokens_out long"), spark.createDataFrame([(1, "gpt-4o", 2.5, 10.0), (2, "gpt-4o-mini", 0.15, 0.6)], "ord int, prefix string, usd_in double, usd_out double"))
    assert [r["cost"] for r in cost.collect()] == [2.5, None]


def test_text_functions(spark):
    cols = {
        "lang_ar": X.language(F.lit("مرحبا بكم")), "lang_mixed": X.language(F.lit("مرحبا بكم hello")), "lang_en": X.language(F.lit("hello 12")), "lang_none": X.language(F.lit(" \n ")), "digits": X.language(F.lit("123")),
        "fold": X.fold_term(F.lit("الأُمّــة")), "phrase": X.fold_phrase(F.lit(" أمة ")), "phone": X.phone(F.lit("+20 (10)-55")), "nophone": X.phone(F.lit("20x")), "cited": X.cited(F.lit("b[2] [1][2]")),
        "strip": X.strip_invalid(F.lit("a [1] b  [9]. c[2]"), F.array(F.lit(1), F.lit(2))), "red": X.redacted(F.lit('Authorization: Bearer abcdef api_key="zzzz9" sk-12345678')), "lines": X.reversed_lines(F.lit("abc\nde")), "norm": X.normalised(F.lit(" a  b \r\n\n\n\n c\t")),
        "follow": X.is_follow_up(F.lit("and how long does it usually take")), "alone": X.is_follow_up(F.lit("opening hours of the main branch")), "query": X.contextual_query(F.lit("how long does it take"), F.lit("What is the refund policy")),
        "title": X.infer_title(F.array(F.lit("A sentence."), F.lit(" Real title ")), F.lit("a-b")), "stem": X.infer_title(F.array(F.lit("x")), F.lit("a-b_c")), "label": X.citation_label(F.array(F.lit("A"), F.lit("B")), F.lit("t"), F.lit("m.pdf"), F.lit(3)),
        "same": X.same_script(F.lit("مرحبا"), F.lit("hello")), "bad": X.quality(F.lit("·" * 400), F.lit(1), F.lit(1), F.lit(0)), "layout": chunking.repaired_layout(F.lit("1.\nfirst (a)-b - | c")),
    }
    r = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert (r["lang_ar"], r["lang_mixed"], r["lang_en"], r["lang_none"], r["digits"]) == ("ar", "mixed", "en", "unknown", "unknown")
    assert (r["fold"], r["phrase"], r["phone"], r["nophone"], r["cited"]) == ("الامه", "امة", "201055", None, [2, 1])
    assert r["strip"] == "a [1] b. c[2]" and "abcdef" not in r["red"] and "zzzz9" not in r["red"] and "sk-1" not in r["red"]
    assert (r["lines"], r["norm"], r["follow"], r["alone"]) == ("cba\ned", "a b\n\nc", True, False)
    assert r["query"] == "how long does it take What the refund policy" and (r["title"], r["stem"]) == ("Real title", "a b c")
    assert r["label"] == "A > B | m.pdf | page 3" and not r["same"] and not r["bad"]["ok"] and r["bad"]["needs_ocr"]
    assert r["layout"] == "1. first (a) - b | c"
    good = "سياسة الاستبدال والاسترجاع في الشركة من خلال الفرع\nكل العملاء على علم من خلال الموقع الرسمي في البلد"
    back = "\n".join(x[::-1] for x in good.split("\n"))
    rows = spark.createDataFrame([(good,), (back,), ("plain english text of more than eight words for sure",)], "t string").select("t", X.reversal("t")["is_reversed"].alias("b"), X.repaired("t").alias("fixed")).collect()
    assert [x["b"] for x in rows] == [False, True, False] and [x["fixed"] for x in rows] == [good, good, rows[2]["t"]]


@pytest.mark.parametrize(("text", "n"), [("Dial *880# now. Then wait.", 2), ("See https://a.b/c now. Next one!", 2), ("See https://a.b/c.d?x=1. A URL takes its stop along", 1), ("It costs 1.5 GB. Or 2,000.50 EGP.", 2), ("Dr. Smith came. He left.", 2), ("- a\n- b\n- c", 3), ("", 0), ("What?! Really... yes.", 2), ("هل؟ نعم.", 2), ("mail a.b@c.com now. done", 2)])
def test_sentences(spark, text, n):
    got = [r["sentence"] for r in chunking.sentences(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("n").collect()]
    assert len(got) == n and " ".join(" ".join(got).split()) == " ".join(text.split())


def test_short_pieces_join_the_one_before(spark):
    rows = spark.createDataFrame([("a", "One two.\n!\n- b\nx\n\ny z"), ("b", None)], "document_id string, text string")
    assert [(r["document_id"], r["sentence"]) for r in chunking.sentences(rows).orderBy("document_id", "n").collect()] == [("a", "One two. !"), ("a", "- b x"), ("a", "y z")]


def test_windows_and_sections(spark):
    words = [f"w{k}" for k in range(40)]
    for size, lap in ((10, 3), (8, 2), (5, 99), (40, 0), (41, 5)):
        got = [r["text"].split() for r in chunking.fixed_parts(spark.createDataFrame([("d", " ".join(words))], "document_id string, text string"), size, lap).orderBy("part").collect()]
        step, want, at = size - min(lap, size - 1), [], 0
        while True:
            want.append(words[at : at + size])
            if at + size >= 40:
                break
            at += step
        assert got == want
    assert chunking.fixed_parts(spark.createDataFrame([("d", "  ")], "document_id string, text string")).count() == 0
    heads = [{"text": "Chapter One", "page_number": 1, "level": 1, "order": 0, "reason": "markdown"}, {"text": "Sub A", "page_number": 2, "level": 2, "order": 1, "reason": "bold"}]
    schema = "document_id string, pages array<struct<page_number:int,text:string>>, headings array<struct<text:string,page_number:int,level:int,order:int,reason:string>>"
    rows = [
        ("a", [(1, "intro\nChapter One\n" + "x " * 30), (2, "Sub A\n" + "y " * 30)], heads),
        ("b", [(3, " \n "), (4, None)], heads), ("c", [(5, "only text")], []), ("d", [(6, "text")], heads), ("e", None, None),
        # one heading stands twice, one comes out of order, a body is too short, levels jump
        ("f", [(1, "A\nbody a\nB\nbody b\nA\nagain\nC\nD\nbody d")], [{"text": t, "page_number": 1, "level": v, "order": k, "reason": "toc"} for k, (t, v) in enumerate([("A", 1), ("B", 3), ("A", 2), ("C", 1), ("D", 2), ("B", 1)])]),
    ]
    got: dict = {}
    for r in chunking.build_sections(spark.createDataFrame(rows, schema), 2).orderBy("document_id", "section_index").collect():
        got.setdefault(r["document_id"], []).append(r)
    s = got["a"]
    assert [x["section_path"] for x in s] == [None, ["Chapter One"], ["Chapter One", "Sub A"]] and s[2]["page_range"] == "2" and s[2]["extraction_method"] == "pdf_bold" and s[1]["page_range"] == "1"
    assert (s[0]["text"], s[0]["page_number"], s[1]["text"]) == ("intro", 1, ("x " * 30).strip())
    assert set(got) == {"a", "c", "d", "f"} and (got["c"][0]["text"], got["c"][0]["page_number"], got["d"][0]["page_number"]) == ("only text", 5, None)
    assert [(x["section_title"], x["section_path"], x["text"]) for x in got["f"]][:2] == [("A", ["A"], "body a"), ("B", ["B"], "body b")]  # the last heading stands where the second does
    assert [(x["section_title"], x["section_path"], x["text"]) for x in got["f"]][2:] == [("A", ["B", "A"], "again"), ("D", ["B", "D"], "body d")]
    spans = spark.createDataFrame([("d", 1, k, t, z, b) for k, (t, z, b) in enumerate([("Big title", 20.0, False), ("body text one", 10.0, False), ("1.2 Numbered", 10.0, False), ("Bold line", 10.0, True), ("body two.", 10.0, False), ("Ends.", 20.0, False)])], "document_id string, page_number int, ordinal int, text string, size double, bold boolean")
    assert [(r["text"], r["level"], r["reason"]) for r in chunking.headings_of_spans(spans).orderBy("order").collect()] == [("Big title", 1, "font_size"), ("1.2 Numbered", 2, "numbering"), ("Bold line", 2, "bold")]
    pages = spark.createDataFrame([("d", p, f"head\nbody {p}\nfoot") for p in range(1, 5)], "document_id string, page_number int, text string")
    assert [r["text"] for r in chunking.strip_running_lines(pages).orderBy("page_number").collect()] == [f"body {p}" for p in range(1, 5)]
    pages = spark.createDataFrame([("d", p, f"0 head\nbody {p}\n2 foot") for p in range(1, 5)], "document_id string, page_number int, text string")
    assert [r["text"] for r in chunking.strip_running_lines(pages).orderBy("page_number").collect()] == [f"body {p}" for p in range(1, 5)]


def test_html(spark):
    body = "real prose of some length that is long enough to count as a section body here"
    acc = f'<h3 id="h0" class="accordion-title js-collapser" aria-controls="c0" aria-expanded="false">Question one</h3><div id="c0" aria-labelledby="h0"><p>{body} {body}</p></div>'
    pages = {
        1: (f"<html><body><nav>menu</nav><main><h1>Top</h1><p>{body}</p><h2>Sub</h2><ul><li>one {body}</li><li>two</li></ul><table><tr><th>a</th><td>b</td></tr></table></main><footer>f</footer></body></html>", None),
        2: (f"<body>{acc}</body>", None), 3: ("<p>unclosed <b>" + body, None), 4: (f"<h5>Small</h5><p>{body}</p>", None), 5: (None, f"A title\n{body}\n- no\n"), 6: ("", ""), 7: (None, "just a line"),
        # a list item closes the one before; hidden text goes; the main part wins; a panel outside it is added
        8: (f"<body><main><h1>One</h1><ul><li>a {body}<li>b<ul><li>inner</ul></ul><p aria-hidden=true>secret</p><h3>Deep</h3><p>{body}<h2>{'x' * 260}</h2><p>lost</p><h2>Two</h2><p>{body}</p></main>{acc}</body>", None),
        9: (f"<div class='cookie-box'><h2>Cookies</h2><p>{body}</p></div><h2>Kept</h2><p>{body} &amp; ﬁne</p>", None),
    }
    df = spark.createDataFrame([(k, *v) for k, v in pages.items()], "page_id long, html string, fallback string")
    got: dict = {k: [] for k in pages}
    for r in html_sections.page_sections(df).orderBy("page_id", "section_index").collect():
        got[r["page_id"]].append(r)
    s = got[1]
    assert [(x["section_title"], x["section_path"], x["heading_level"]) for x in s] == [("Top", ["Top"], 1), ("Sub", ["Top", "Sub"], 2)]
    assert "- two" in s[1]["text"] and "a | b" in s[1]["text"] and "menu" not in str(s)
    assert [(x["section_title"], x["extraction_method"], x["component_type"], x["anchor_id"]) for x in got[2]] == [("Question one", "html_component", "accordion", "c0")]
    assert [(x["section_title"], x["extraction_method"]) for x in got[3]] == [(None, "no_section")] and [x["section_title"] for x in got[4]] == ["Small"]
    assert [(x["section_title"], x["extraction_method"], x["text"]) for x in got[5]] == [("A title", "text_fallback", f"{body}\n- no")]
    assert got[6] == [] and [(x["section_title"], x["text"]) for x in got[7]] == [(None, "just a line")]
    assert [(x["section_title"], x["section_path"], x["extraction_method"]) for x in got[8]] == [("One", ["One"], "html_structure"), ("Deep", ["One", "Deep"], "html_structure"), ("Two", ["One", "Two"], "html_structure"), ("Question one", ["Question one"], "html_component")]
    assert got[8][0]["text"].split("\n") == [f"- a {body}", "- b inner", "- inner"] and "secret" not in str(got[8]) and "lost" not in str(got[8])
    assert [(x["section_title"], x["text"]) for x in got[9]] == [("Kept", f"{body} & fine")]
    assert html_sections.page_sections(df.select("page_id", "html")).where("page_id = 5").count() == 0


def test_mutations(spark):
    store = spark.createDataFrame([("a", "d1", 1, "x"), ("b", "d1", 2, "y")], "chunk_id string, document_id string, ordinal int, text string")
    for _ in range(3):
        store = mutations.upsert(store, spark.createDataFrame([("a", "d1", 1, "old"), ("a", "d1", 3, "new")], store.schema))
    assert {r["chunk_id"]: r["text"] for r in store.collect()} == {"a": "new", "b": "y"}
    left, gone = mutations.delete_document(store, "d1")
    assert left.count() == 0 and gone.first()["deleted"] == 2
    with pytest.raises(Exception, match="duplicate key a"):
        mutations.add(store, store.where("chunk_id = 'a'")).collect()


EVENTS = [(1, "u", "started", None), (2, "u", "answered", None), (3, "u", "completed", "61.9"), (4, "u", "ringing", None), (5, "u", "failed", None), (6, "u", "odd", None), (7, "v", "completed", "x"), (8, "w", "busy", None), (9, "nobody", "busy", None)]


def test_lifecycle_batch_and_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(s, u, k, d, at + timedelta(seconds=10 * s)) for s, u, k, d in EVENTS]
    schema = "seq long, uuid string, status string, duration string, ts timestamp"
    events = spark.createDataFrame(rows, schema)
    calls = spark.createDataFrame([("u", at, "resolved", 1, 1), ("v", at, None, 1, 1), ("w", None, "x", 2, 1)], "uuid string, started_at timestamp, outcome string, ticket_id int, company_id int")
    got = {r["uuid"]: r for r in C.lifecycle(events, calls).collect()}
    assert set(got) == {"u", "v", "w"}
    assert (got["u"]["status"], got["u"]["outcome"], got["u"]["duration_seconds"], got["u"]["ticket_status"], got["u"]["events"]) == ("failed", None, 61, "pending_follow_up", 5)
    assert (got["v"]["status"], got["v"]["duration_seconds"], got["w"]["duration_seconds"]) == ("completed", 70, None)
    strict = {r["uuid"]: r for r in C.lifecycle(events, calls, strict=True).collect()}
    assert (strict["u"]["status"], strict["u"]["outcome"], strict["u"]["ticket_status"]) == ("completed", "resolved", None)
    assert {r["ticket_id"] for r in C.ticket_updates(C.lifecycle(events, calls), calls).collect()} == {1, 2}
    for n in range(3):  # three files, one a micro-batch
        events.where(F.col("seq") % 3 == n).orderBy("seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = {}
    for name, known in (("lives", None), ("known_lives", calls)):
        q = C.lifecycle_stream(read(), known).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for r in spark.sql(f"SELECT * FROM {name}").collect():
            old = state.setdefault(name, {}).get(r["uuid"])
            if not old or r["events"] > old["events"]:
                state[name][r["uuid"]] = r
    lives, known = state["lives"], state["known_lives"]
    assert {u: (lives[u]["events"], lives[u]["duration_seconds"]) for u in ("u", "v", "w")} == {u: (got[u]["events"], {"u": 61}.get(u)) for u in ("u", "v", "w")}
    assert (lives["u"]["cleared"], lives["w"]["status"]) == (True, "busy") and "nobody" in lives
    assert {u: r["duration_seconds"] for u, r in known.items()} == {u: r["duration_seconds"] for u, r in got.items()}


def test_speech_and_memory(spark):
    rows = [(1, "", None, "resolved"), (2, "", None, "resolved"), (1, "yes", 0.4, "resolved"), (1, "yes", None, "resolved"), (1, "x", 0.9, "unclear"), (2, "x", 0.9, "unclear"), (2, "no", 0.5, "not_resolved")]
    df = spark.createDataFrame(rows, "a int, t string, c double, k string").coalesce(1)
    assert [r[0] for r in df.select(C.speech_action("a", "t", "c", "k")).collect()] == ["repeat", "unclear", "repeat", "resolved", "redirect", "unclear", "not_resolved"]
    lines = spark.createDataFrame([("u", 2, 2, "no"), ("u", 1, 1, "yes"), ("u", 3, 2, "")], "uuid string, seq int, attempt int, text string")
    assert C.transcript(lines).first()["transcript"] == "Attempt 1: yes\nAttempt 2: no"
    turns = spark.createDataFrame([(1, "c", k, NOW + timedelta(seconds=k)) for k in range(9)] + [(1, "old", 1, NOW - timedelta(1))], "company_id int, conversation_id string, seq int, ts timestamp")
    kept = C.memory(turns, now=F.lit(NOW + timedelta(seconds=60))).collect()
    assert sorted(r["seq"] for r in kept) == [3, 4, 5, 6, 7, 8]


def test_ingest_is_idempotent(spark, tmp_path):
    text = "# One\n" + "alpha beta gamma delta. " * 30 + "\n# Two\n" + "epsilon zeta eta theta. " * 30
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/guide-a.md").write_text(text)
    (tmp_path / ".hidden.md").write_text(text)
    (tmp_path / "short.txt").write_text("tiny")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>{"body " * 40}</w:t></w:r></w:p></w:body></w:document>')
    docs = files.load_documents(spark, str(tmp_path))
    by = {r["path"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert set(by) == {"guide-a.md", "short.txt", "x.pdf", "w.docx"}
    assert by["guide-a.md"]["title"] == "One" and len(by["guide-a.md"]["headings"]) == 2 and by["x.pdf"]["error"] and by["w.docx"]["headings"][0]["level"] == 2
    ready = ingest.prepared(docs, 1)
    chunks = ingest.chunked(ready, 60, 10)
    report = ingest.ingest_report(ready, chunks).first()
    assert (report["files_seen"], report["failed"], report["skipped"], report["ingested"]) == (4, 1, 1, 2)
    cols = ["chunk_id", "document_id", "ordinal", "text"]
    once = ingest.ingested(chunks.select(cols).limit(0), chunks.select(cols))
    twice = ingest.ingested(once, chunks.select(cols))
    assert once.count() == twice.count() == report["total_chunks"] > 2
    assert all(re.match(r"1:[0-9a-f]{20}:\d+:[0-9a-f]{12}$", r["chunk_id"]) for r in twice.collect())


def test_table_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert streaming_files.current_table(spark, path) is None
    for n in (1, 2, 3):
        streaming_files.replace_table(spark.range(n), path)
        assert streaming_files.current_table(spark, path).count() == n
    (tmp_path / "t/v00000009").mkdir()  # a writer that was lost
    assert streaming_files.current_table(spark, path).count() == 3 and len(list((tmp_path / "t").glob("v*/_SUCCESS"))) == 2
    mutations.save(spark.range(4).withColumn("p", F.col("id") % 2), str(tmp_path / "s"), "p")
    mutations.save(spark.range(10, 11).withColumn("p", F.lit(1)), str(tmp_path / "s"), "p")
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [0, 2, 10]


def test_new_files_are_followed(spark, tmp_path):
    seen = []
    for n in (1, 2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{n}.txt").write_text("x")
        assert streaming_files.follow(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda paths, _: seen.append(sorted(r["path"][-5:] for r in paths.collect()))).awaitTermination(120)
    assert seen == [["1.txt"], ["2.txt"]] or seen == [["/1.txt"], ["/2.txt"]]


def test_quantiles_and_unavailable(spark):
    rng = random.Random(3)
    v = [rng.choice([rng.random(), 0.5, -2.0]) for _ in range(501)]
    got = evaluation.quantiles(spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").repartition(7), F.col("v"), a=(0.5, "cont"), b=(0.95, "disc"), c=(0.25, "disc"), d=(0.9, "cont")).first()
    o = sorted(v)
    assert list(got)[:3] == [o[250], o[475], o[125]] and abs(got["d"] - (o[450])) < 1e-12
    assert list(evaluation.quantiles(spark.createDataFrame([], "v double"), F.col("v"), a=(0.5, "cont")).first()) == [None]
    q = spark.createDataFrame([("1", "answer", None), ("2", None, None)], "id string, reference_answer string, expect_insufficient boolean")
    said = {r["metric"]: r["reason"] for r in evaluation.unavailable(q, False, True).collect()}
    assert "answer_correctness" in said and said["faithfulness"] == "no judge is configured" and said["answer_token_f1"].startswith("answers come")
    assert {r["metric"] for r in evaluation.unavailable(q, True).collect()} == {"insufficient_context_handling"}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "question": "q", "graded_relevance": {"u": 2.0}, "relevant_source_urls": ["u"]}]')
    (tmp_path / "b.json").write_text('{"questions": [{"id": "2", "question": "q"}]}')
    a, b = files.load_questions(spark, str(tmp_path / "a.json")).first(), files.load_questions(spark, str(tmp_path / "b.json")).first()
    assert a["graded_relevance"] == {"u": 2.0} and b["id"] == "2"
    assert files.snapshot(spark, str(tmp_path / "none"), "a int").count() == 0
    assert files.report(str(tmp_path / "none.json")) is None
    files.write_report(str(tmp_path / "r.json"), spark.range(1))
    assert files.report(str(tmp_path / "r.json")) == [{"id": 0}]


def test_models(spark):
    df = spark.createDataFrame([("yes it works",), ("no",), ("",), (None,), ("hmm",)], "t string")
    assert [r[0] for r in df.select(models.outcome_of(F.col("t"), models.LexiconClassifier())).collect()] == ["resolved", "not_resolved", "unclear", "unclear", "unclear"]
    packed = spark.createDataFrame([(1, "q", "en", "[1] a\nbody"), (2, "q", "ar", None)], "query_id int, question string, language string, context string")
    out = {r["query_id"]: r for r in models.answers(packed, models.EchoGenerator()).collect()}
    assert out[1]["answer"] == "body [1]" and out[1]["sufficient"] and out[2]["answer"] == models.NOTHING["ar"] and not out[2]["sufficient"]
    assert models.parse_verdict('x {"is_relevant": true, "confidence": 0.3}').relevant is False and models.parse_verdict("junk").relevant is True
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma"), (4, "nothing here")], "id long, question string")
    retrieve = lambda q: q.where("NOT contains(query, 'nothing')").select("id", F.array("query").alias("passages"))
    judge = lambda q: q.select("id", ((F.col("id") == 1) | ((F.col("id") == 2) & F.exists("passages", lambda p: p.contains("more")))).alias("relevant"), F.lit("thin").alias("reason"))
    rewrite = lambda q: q.select("id", F.when(F.col("id") == 3, "?").otherwise(F.concat(F.lit(' "'), "query", F.lit(' more"\nand so on'))).alias("proposed"))
    done, trace = models.agentic(asked, retrieve, judge, rewrite)
    got = {r["id"]: (r["attempts"], r["sufficient"], list(r["passages"])) for r in done.collect()}
    assert got == {1: (1, True, ["alpha"]), 2: (2, True, ["beta more"]), 3: (3, False, []), 4: (3, False, [])}
    rows = {(r["id"], r["attempt"]): (r["query"], r["reason"]) for r in trace.collect()}
    assert len(rows) == 9 and rows[2, 2] == ("beta more", "thin") and rows[3, 3][0] == "gamma" and rows[4, 1] == ("nothing here", "nothing found")
    clock, waits, fails = [0.0], [], [True, True, False]

    def wait(s):
        waits.append(s)
        clock[0] += s

    def call(x):
        if fails.pop(0):
            raise OSError
        return x

    assert models.Paced(call, 30, 3, 1.0, wait, lambda: clock[0])("y") == "y" and waits == [1.0, 1.0, 2.0, 0.0]


def test_webhooks(spark):
    bodies = ['{"uuid": "u", "status": "completed", "duration": 61.5, "timestamp": "2024-01-01T00:00:05Z", "x": {"y": 1}}', '{"uuid": "u", "status": ["odd"]}', "no json", "[1]", '{"status": "busy"}', None, '{"uuid": "s", "speech": {"results": [{"text": " yes ", "confidence": "0.8"}]}}', '{"uuid": "s"}']
    raw = spark.createDataFrame([(k, b, datetime(2024, 1, 2), k % 2 or None) for k, b in enumerate(bodies)], "seq long, body string, ts timestamp, attempt int")
    got = {r["seq"]: r for r in webhooks.call_events(raw).collect()}
    assert set(got) == {0, 1, 6, 7} and (got[0]["duration"], got[0]["ts"], got[1]["ts"]) == ("61.5", datetime(2024, 1, 1, 0, 0, 5), datetime(2024, 1, 2))
    said = {r["seq"]: r for r in webhooks.speech_inputs(raw).withColumn("best", C.best_hypothesis("results")).collect()}
    assert (said[6]["best"]["text"], said[6]["best"]["confidence"], said[6]["attempt"], said[7]["best"]["text"]) == ("yes", 0.8, 1, "")


def test_intake_and_walk(spark, tmp_path):
    for name, size in (("company_7/b.txt", 3), ("company_7/a.md", 50), ("company_8/x.exe", 1), ("loose.pdf", 1), ("company_8/.hid.txt", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    got = {r["name"]: (r["company_id"], r["status"]) for r in files.intake(spark, str(tmp_path), 20).collect()}
    assert got == {"b.txt": (7, 201), "a.md": (7, 413), "x.exe": (8, 415), "loose.pdf": (None, 201)}
    assert [r["name"] for r in files.walk(spark, str(tmp_path)).collect()] == ["a.md", "b.txt", "loose.pdf"]


def test_word_order(spark):
    lines = ["الفرع في المدينة القديمة هل", "الطلب على الموقع الرسمي كيف", "السعر في المتجر الجديد ما"] * 3
    wrong, right = "\n".join(lines), "\n".join(" ".join(x.split()[::-1]) for x in lines)
    cell = {"20% (السعر من)": "20% (من السعر)", "15 العرض سعر%": "سعر العرض 15%", "10 , 20": "20 , 10", ")نعم(": "(نعم)", ".كلمة هنا": "هنا كلمة."}
    rows = spark.createDataFrame([(wrong,), (right,), ("\n".join(lines[:6]),)], "t string").select(reading_order.word_order_reversed("t").alias("w"), reading_order.repaired_word_order("t").alias("r")).collect()
    assert [x["w"] for x in rows] == [True, False, False] and rows[0]["r"] == right
    one = spark.createDataFrame([("19888 - خدمة العملاء",), ("50% خصم اليوم فقط",), ("a | ب ج د",), ("plain words stay",)], "t string").select(reading_order.repaired_word_order("t")).collect()
    assert [x[0] for x in one] == ["العملاء خدمة - 19888", "50% خصم اليوم فقط", "a | ب ج د", "plain words stay"]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in cell], "t string").coalesce(1).select(reading_order.repaired_cell("t")).collect()] == list(cell.values())
    report = X.repair_report(spark.createDataFrame([(1, "ﬁne"), (2, "plain")], "id int, text string")).orderBy("id").collect()
    assert [(r["text"], r["report"]["nfkc_applied"], r["report"]["reversal"]["is_reversed"]) for r in report] == [("fine", True, False), ("plain", False, False)]


def test_table_regions(spark):
    t = spark.createDataFrame([(1, "a", 10.0, 0.0, 50.0, 30.0), (1, "b", 10.0, 100.0, 50.0, 110.0)], "page int, table_id string, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame([("a", k, 10.0 * k, 10.0 * k + 10) for k in range(3)] + [("b", 0, 100.0, 110.0)], "table_id string, row int, y0 double, y1 double")
    c = spark.createDataFrame([("a", 0, 0, "Name"), ("a", 0, 1, "City\nname"), ("a", 1, 0, "x"), ("a", 1, 1, None), ("a", 2, 0, "مرحبا"), ("a", 2, 1, "بكم جميعا"), ("b", 0, 0, " ")], "table_id string, row int, col int, text string")
    lines = spark.createDataFrame([(1, 1, 0.0, 2.0, 9.0, 8.0, "left0"), (1, 2, 0.0, 12.0, 9.0, 18.0, "left1"), (1, 3, 60.0, 12.0, 70.0, 18.0, "once"), (1, 4, 20.0, 50.0, 30.0, 55.0, "prose")], "page int, line int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {x["table_id"]: x for x in tables.table_regions(t, r, c, lines).collect()}
    assert set(got) == {"a"} and got["a"]["text"].split("\n")[:2] == ["left0 | Name | City name", "left1 | x | "] and (got["a"]["x0"], got["a"]["x1"]) == (0.0, 50.0)
    assert got["a"]["text"].split("\n")[2] == f"{'بكم جميعا'[::-1]} | {'مرحبا'[::-1]}"
    assert {x["line"] for x in tables.prose_lines(lines, tables.table_regions(t, r, c, lines)).collect()} == {3, 4}


def test_vectors_are_kept_between_runs(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        name = "e5-small"

        def vector(self, text):
            calls.add(1)
            return embedding.hash_vector(text, 4)

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    out, new = embedding.embedded_through(df, spark.createDataFrame([], embedding.CACHE), kind=Counting())
    first = {r["text"]: list(r["vector"]) for r in out.collect()}
    assert calls.value == 3 and new.count() == 3 and first["a"] == list(embedding.hash_vector("passage: a", 4))
    out, more = embedding.embedded_through(df.union(spark.createDataFrame([("c",)], "text string")), new, kind=Counting())
    assert {r["text"]: list(r["vector"]) for r in out.collect()}.items() >= first.items() and more.count() == 1 and calls.value == 4
    assert embedding.prefix("multilingual-E5-base", True) == "query: " and embedding.prefix("other", True) == ""
