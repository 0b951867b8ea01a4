"""Named queries of the scalar functions, answer scores, document structure and call rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import models
from .catalog import TENANT, query
from .functions import embedding, reading_order
from .functions import text as X
from .functions import tokens
from .operators import chunking, evaluation, relational, retrieval
from .plans import views as V
from .plans.intent import METRICS, RuleParser, follow_ups, parsed
from .plans.tenancy import Tenant, clean_filters, predicate, scoped
from .sources import webhooks
from .streaming import calls as C

_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'))"


def said(s, d) -> DataFrame:
    return V.messages(s, d).select("session_id", "id", "role", "content")


def md5(c):
    return F.md5(c.cast("binary"))


# --- F, J ----------------------------------------------------------------------------------------

query("f2_second_guard", "SELECT chunk_id FROM chunks WHERE language = 'fr'", "chunks")(
    lambda s, d: scoped(V.chunks(s, d).where(predicate(clean_filters({"language": "fr"})[0])), TENANT).select("chunk_id")
)
query("f3_allow_list", "SELECT chunk_id FROM chunks WHERE source = 'src1'", "chunks")(lambda s, d: V.chunks(s, d).where(predicate(clean_filters({"source": "src1", "language": None, "owner": "x"})[0])).select("chunk_id"))
query("f10_active_call", "SELECT id, ticket_id, status FROM (SELECT seq AS id, seq % 97 AS ticket_id, CASE status WHEN 'ringing' THEN 'ringing' WHEN 'started' THEN 'initiating' WHEN 'answered' THEN 'in_progress' ELSE 'x' END AS status FROM call_events) WHERE ticket_id = 7 AND status <> 'x' ORDER BY id LIMIT 1", "call_events")(
    lambda s, d: relational.active_call(V.call_events(s, d).select(F.col("seq").alias("id"), (F.col("seq") % 97).alias("ticket_id"), C.call_status("status").alias("status")), 7)
)
query("j11_section_methods", "SELECT chunk_id, CASE WHEN section_index < 3 AND document_id <> 'd4' THEN 'markdown' ELSE 'no_section' END AS extraction_method FROM chunks", "chunks")(
    lambda s, d: relational.section_methods(V.chunks(s, d), V.chunks(s, d).where("section_index < 3 AND document_id <> 'd4'").select("document_id", "section_index", F.lit("markdown").alias("extraction_method"))).select("chunk_id", "extraction_method")
)
query("r11_dedupe_content", """WITH b AS (SELECT ordinal % 10 AS query_id, chunk_id, sha256(trim(text) || chr(31)) AS h, (ordinal * 7) % 5 AS score, row_number() OVER (PARTITION BY ordinal % 10 ORDER BY ordinal) AS pos FROM chunks),
    k AS (SELECT *, min(pos) OVER (PARTITION BY query_id, h) AS slot, row_number() OVER (PARTITION BY query_id, h ORDER BY score DESC, pos) AS best FROM b)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS pos FROM k WHERE best = 1""", "chunks")(
    lambda s, d: retrieval.dedupe_content(
        V.chunks(s, d).select((F.col("ordinal") % 10).alias("query_id"), "chunk_id", X.content_hash(F.trim("text")).alias("content_hash"), (F.col("ordinal") * 7 % 5).alias("score"), F.lit("").alias("source_url"), F.row_number().over(Window.partitionBy(F.col("ordinal") % 10).orderBy("ordinal")).alias("pos"))
    ).select("query_id", "chunk_id", "pos")
)

# --- E, A: scores --------------------------------------------------------------------------------


def graded_rows(s, d) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth chunk asks; the fifty from there on are what it got."""
    c = V.chunks(s, d)
    url = F.concat(F.lit("http://x/c"), F.col("ordinal").cast("string"))
    rows = c.select((F.col("ordinal") - F.col("ordinal") % 50).alias("question_id"), (F.col("ordinal") % 50 + 1).alias("rank"), "document_id", url.alias("source_url"), F.array("source", "language").alias("section_path"))
    first = F.col("ordinal") % 100 == 0
    asked = c.where("ordinal % 50 = 0").select(
        F.col("ordinal").alias("id"), F.when(first, F.array(F.concat(F.upper(url), F.lit("/")))).alias("relevant_source_urls"), F.array(F.lit("d3"), F.lit("d5")).alias("relevant_document_ids"),
        F.when(~first, F.array(F.lit("SRC1 > EN"))).otherwise(F.array().cast("array<string>")).alias("relevant_sections"), F.create_map(F.upper(url), F.lit(3.0)).alias("graded_relevance"),
    )
    return rows, asked


_GRADED = "g AS (SELECT ordinal - ordinal % 50 AS question_id, ordinal % 50 + 1 AS rank, ordinal % 50 = 0 AND ordinal % 100 = 0 AS u, document_id IN ('d3', 'd5') AS doc, (ordinal - ordinal % 50) % 100 <> 0 AND source = 'src1' AND language = 'en' AS sec, ordinal % 50 = 0 AS own FROM chunks)"
query("e7_graded", f"WITH {_GRADED} SELECT question_id, rank, CAST(u OR doc OR sec AS INT) AS rel, CASE WHEN own THEN 3.0::DOUBLE ELSE CAST(u OR doc OR sec AS INT)::DOUBLE END AS gain FROM g", "chunks")(lambda s, d: evaluation.graded(*graded_rows(s, d)))
query("e8_accuracy", f"WITH {_GRADED}, p AS (SELECT question_id, question_id % 100 = 0 AS by_url, " + ", ".join(f"max(CAST(sec AND rank <= {k} AS DOUBLE)) AS s{k}, max(CAST(u AND rank <= {k} AS DOUBLE)) AS u{k}" for k in (1, 3, 5, 10)) + " FROM g GROUP BY 1) SELECT " + ", ".join(f"round(avg(s{k}) FILTER (NOT by_url), 4) AS section_top_{k}, round(avg(u{k}) FILTER (by_url), 4) AS source_top_{k}" for k in (1, 3, 5, 10)) + " FROM p", "chunks")(
    lambda s, d: evaluation.accuracy(*graded_rows(s, d))
)
query("e9_with_truth", "SELECT ordinal AS id FROM chunks WHERE ordinal % 3 > 0", "chunks")(
    lambda s, d: evaluation.with_truth(V.chunks(s, d).select(F.col("ordinal").alias("id"), F.when(F.col("ordinal") % 3 == 1, F.array("chunk_id")).alias("relevant_source_urls"), F.array().cast("array<string>").alias("relevant_document_ids"), F.when(F.col("ordinal") % 3 == 2, F.array("source")).alias("relevant_sections"))).select("id")
)
query("e11_citation_correctness", f"WITH w AS (SELECT session_id, id, {_WORDS.format('content')} AS a, {_WORDS.format('role || chr(32) || content')} AS b FROM messages) SELECT session_id, id, CASE WHEN len(a) = 0 THEN 0.0 WHEN len(list_intersect(a, b)) / len(a) >= 0.12 THEN 0.5 ELSE 0.0 END::DOUBLE AS correct FROM w", "messages")(
    lambda s, d: said(s, d).select("session_id", "id", evaluation.citation_correctness(F.col("content"), F.array(F.concat_ws(" ", "role", "content"), F.lit("###"))).alias("correct"))
)
query("e15_refusal", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(value > 50 AS DOUBLE) ELSE CAST(value <= 50 AS DOUBLE) END AS score FROM events")(
    lambda s, d: V.table(s, d, "events").select("event_id", evaluation.refusal_score(F.col("value") > 50, F.when(F.col("event_id") % 3 == 1, False).when(F.col("event_id") % 3 == 2, True)).alias("score"))
)
query("e16_judge_scores", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(1, event_id % 20 / 10.0::DOUBLE) END AS faithfulness, CASE event_id % 3 WHEN 0 THEN 0.0 END::DOUBLE AS context_recall FROM events")(
    lambda s, d: V.table(s, d, "events").select("event_id", evaluation.judge_scores(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('Verdict: {"faithfulness": '), (F.col("event_id") % 20 / 10).cast("string"), F.lit(', "answer_relevance": "n/a", "context_recall": -2} end'))).when(F.col("event_id") % 3 == 1, "no object").otherwise('{"other": 1}')).alias("j")).select("event_id", "j.faithfulness", "j.context_recall")
)


def usage(s, d) -> DataFrame:
    used = V.table(s, d, "events").select("event_id", F.element_at(F.array(F.lit("big-1"), F.lit("big-1-mini"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("model"), (F.col("event_id") % 1000 * 2).alias("tokens_in"), F.lit(100).alias("tokens_out"))
    return evaluation.priced(used, s.createDataFrame([(0, "big-1", 2.5, 10.0), (1, "big-1-mini", 0.15, 0.6)], "ord int, prefix string, usd_in double, usd_out double"))


_COST = "CASE WHEN event_id % 3 < 2 THEN round((event_id % 1000 * 2 * 2.5::DOUBLE + 100 * 10.0::DOUBLE) / 1e6, 6) END"
query("e18_token_price", f"SELECT event_id, {_COST} AS cost FROM events")(lambda s, d: usage(s, d).select("event_id", "cost"))
query("a14_usage", f"SELECT sum(event_id % 1000 * 2 + 100)::BIGINT AS tokens, round(sum(coalesce({_COST}, 0)), 4) AS cost FROM events")(lambda s, d: usage(s, d).agg(F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost")))
query("e21_mean_pool", "SELECT label, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, len(v) AS size FROM (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)")(
    lambda s, d: embedding.mean_pool(V.table(s, d, "embeddings").select(F.col("label").alias("id"), F.col("embedding").alias("vector"))).select(F.col("id").alias("label"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.size("vector").cast("long").alias("size"))
)
query("a8_compared", "SELECT config, count(*) AS total, quantile_disc(n, 0.95)::DOUBLE AS p95, avg(n) AS mean FROM (SELECT 'short' AS config, length(text) AS n FROM chunks WHERE ordinal % 2 = 0 UNION ALL SELECT 'all', length(text) FROM chunks) GROUP BY 1", "chunks")(
    lambda s, d: evaluation.compared({"short": evaluation.chunk_report(V.chunks(s, d).where("ordinal % 2 = 0"), 500, 4000), "all": evaluation.chunk_report(V.chunks(s, d), 500, 4000)}, "total", "p95", "mean")
)
query("a18_transcript", "SELECT CAST(user_id AS VARCHAR) AS uuid, string_agg('Attempt ' || (event_id % 2 + 1) || ': ' || event_type, chr(10) ORDER BY event_id) AS transcript FROM events WHERE event_id % 5 > 0 GROUP BY 1")(
    lambda s, d: C.transcript(V.table(s, d, "events").select(F.col("user_id").cast("string").alias("uuid"), F.col("event_id").alias("seq"), (F.col("event_id") % 2 + 1).alias("attempt"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).otherwise("").alias("text")))
)

# --- X: text -------------------------------------------------------------------------------------

query("x1_fold_term", "SELECT doc_id, md5(lower(text) || ' ااا يه بيت') AS h FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", md5(X.fold_term(X.nfkc(F.concat("text", F.lit(" أإآ ىة بَيْـت")))) ).alias("h")))
query("x2_fold_phrase", "SELECT session_id, id, md5(lower(content) || ' ا ية') AS h FROM messages", "messages")(lambda s, d: said(s, d).select("session_id", "id", md5(X.fold_phrase(X.nfkc(F.concat(F.lit("  "), "content", F.lit(" أ ىة "))))).alias("h")))
query("x6_same_script", "SELECT session_id, id, id % 4 = 2 OR id % 4 = 3 AS same FROM messages", "messages")(
    lambda s, d: said(s, d).select("session_id", "id", X.same_script(F.concat(F.lit("say "), "content"), F.element_at(F.array(F.lit("مرحبا بكم"), F.lit("12 34"), F.lit("hello"), F.lit("hello مرحبا")), (F.col("id") % 4 + 1).cast("int"))).alias("same"))
)
_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه")
#: Texts in Arabic letters, with an article and a preposition of Arabic prose for two frequent words.
_IN_ARABIC = f"replace(replace(translate(lower(text), '{_LETTERS[0]}', '{_LETTERS[1]}'), ' {'the'.translate(str.maketrans(*_LETTERS))} ', ' في '), ' {'of'.translate(str.maketrans(*_LETTERS))} ', ' ال')"


def in_arabic(s, d) -> DataFrame:
    """Documents as above, every second one with its lines back to front."""
    turned = F.translate(F.lower("text"), *_LETTERS)
    for word, new in (("the", " في "), ("of", " ال")):
        turned = F.replace(turned, F.lit(f" {word.translate(str.maketrans(*_LETTERS))} "), F.lit(new))
    docs = V.table(s, d, "documents").select("doc_id", turned.alias("t"))
    return docs.withColumn("t", F.when(F.col("doc_id") % 2 == 1, X.reversed_lines("t")).otherwise(F.col("t")))


_MARKED = " + ".join(f"(len(string_split({{t}}, ' {m} ')) - 1)" for m in X.MARKERS)
_PROSE = "(len(list_filter(regexp_extract_all({t}, '[؀-ۿ]+'), lambda w: starts_with(w, 'ال') AND length(w) > 2)) + " + _MARKED + ")"
_LINES = "array_to_string(list_transform(string_split({t}, chr(10)), lambda x: reverse(x)), chr(10))"
query("x10_reversal", f"""WITH a AS (SELECT doc_id, {_IN_ARABIC} AS t FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN {_LINES.format(t='t')} ELSE t END AS t FROM a),
    s AS (SELECT doc_id, t, {_LINES.format(t='t')} AS u, len(regexp_extract_all(t, '[؀-ۿ]+')) AS n FROM b), k AS (SELECT *, {_PROSE.format(t='t')} AS f, {_PROSE.format(t='u')} AS r FROM s),
    v AS (SELECT *, n >= 8 AND r > f AND (r - f) / (r + f) >= 0.5 AS back FROM k) SELECT doc_id, back AS is_reversed, md5(CASE WHEN back THEN u ELSE t END) AS text FROM v""")(
    lambda s, d: in_arabic(s, d).select("doc_id", X.reversal("t")["is_reversed"].alias("is_reversed"), md5(X.repaired("t")).alias("text"))
)
_LEAD = r"'^(\d[\d,./+%]*)\s+(?:[-–]\s*)?(.*)$'"
_MOVED = r"CASE WHEN regexp_matches(w, '^\).*\($') THEN regexp_replace(w, '^\)(.*)\($', '(\1)') ELSE regexp_replace(regexp_replace(regexp_replace(w, '^([:،؛!?؟.]+)(.*)$', '\2\1'), '^\)(.*)$', '\1)'), '^(.*)\($', '(\1') END"
_TURNED = "array_to_string(list_reverse(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''), lambda w: " + _MOVED + ")), ' ')"
_ARABIC_OF = r"(len(regexp_extract_all({x}, '\p{{Arabic}}')) / greatest(1, len(regexp_extract_all({x}, '\p{{L}}'))))"
query("x12_word_order", f"""WITH a AS (SELECT doc_id, {_IN_ARABIC} AS t FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN {_LINES.format(t='t')} ELSE t END AS t FROM a),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM b),
    m AS (SELECT doc_id, k, x, regexp_extract(x, {_LEAD}, 1) AS lead, regexp_extract(x, {_LEAD}, 2) AS rest FROM l),
    r AS (SELECT doc_id, k, CASE WHEN len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) < 2 OR {_ARABIC_OF.format(x='x')} < 0.65 OR (contains(x, '|') AND {_ARABIC_OF.format(x='x')} >= 0.45) OR contains(lead, '%') THEN x
        ELSE regexp_replace(CASE WHEN lead <> '' AND {_ARABIC_OF.format(x='rest')} >= 0.65 THEN {_TURNED.format(x='rest')} || ' - ' || lead ELSE {_TURNED.format(x='x')} END, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}])-(\\d+)\\b', '\\1\\2-', 'g') END AS x FROM m)
    SELECT doc_id, md5(string_agg(x, chr(10) ORDER BY k)) AS text FROM r GROUP BY 1""")(lambda s, d: in_arabic(s, d).select("doc_id", md5(reading_order.repaired_word_order("t")).alias("text")))
query("x13_non_text", r"SELECT session_id, id, round((id % 5) / (len(regexp_extract_all(content, '\S')) + id % 5), 9) AS ratio FROM messages", "messages")(
    lambda s, d: said(s, d).select("session_id", "id", F.round(X.non_text_ratio(F.concat("content", F.repeat(F.lit("☃"), (F.col("id") % 5).cast("int")))), 9).alias("ratio"))
)


def marked():
    return F.concat("content", F.lit(" a ["), (F.col("id") % 4).cast("string"), F.lit("] b [2] c [9]"))


query("x19_strip_invalid", "SELECT session_id, id, md5(trim(regexp_replace(content || CASE WHEN id % 4 IN (1, 2) THEN ' a [' || (id % 4) || '] b [2] c' ELSE ' a b [2] c' END, '[ \\t]{2,}', ' ', 'g'))) AS text FROM messages", "messages")(lambda s, d: said(s, d).select("session_id", "id", md5(X.strip_invalid(marked(), F.array(F.lit(1), F.lit(2)))).alias("text")))
query("x20_resolve", "SELECT session_id, id, CASE id % 4 WHEN 1 THEN 'p1,p2' ELSE 'p2' END AS found, CASE WHEN id % 4 IN (1, 2) THEN 'p' || (id % 4) ELSE 'p1,p2' END AS kept FROM messages", "messages")(
    lambda s, d: said(s, d).withColumn("p", F.array(F.lit("p1"), F.lit("p2"))).select("session_id", "id", F.array_join(X.resolve_citations(X.cited(marked()), F.col("p"), False), ",").alias("found"), F.array_join(X.resolve_citations(F.array((F.col("id") % 4).cast("int")), F.col("p"), True), ",").alias("kept"))
)
query("x21_label", "SELECT chunk_id, concat_ws(' | ', CASE WHEN ordinal % 2 = 0 THEN document_id || ' > ' || source ELSE 'title' END, nullif(source, 'src1'), CASE WHEN section_index > 0 THEN 'page ' || section_index END) AS label FROM chunks", "chunks")(
    lambda s, d: V.chunks(s, d).select("chunk_id", X.citation_label(F.when(F.col("ordinal") % 2 == 0, F.array("document_id", "source")), F.lit("title"), F.when(F.col("source") == "src1", "").otherwise(F.col("source")), F.col("section_index")).alias("label"))
)


_KIND = "CASE WHEN {f} LIKE '%are these all%' OR {f} LIKE '%all of them%' THEN 'all' WHEN {f} LIKE '%which ones%' OR {f} LIKE '%list them%' THEN 'which' END"
_NEXT = "CASE WHEN metric = 'tickets_needing_agent_call' AND kind IS NOT NULL THEN metric WHEN metric IN ('unresolved_tickets', 'unresolved_ticket_list') THEN CASE kind WHEN 'all' THEN 'tickets_needing_agent_call' WHEN 'which' THEN 'unresolved_ticket_list' END WHEN metric IN ('resolved_tickets', 'resolved_ticket_list') AND kind IS NOT NULL THEN 'resolved_ticket_list' END"
_METRIC_OF = "([" + ", ".join(f"'{m}'" for m in METRICS) + f"])[CAST(session_id % {len(METRICS)} AS INT) + 1]"


@query("x24_follow_up_intent", f"WITH a AS (SELECT session_id, id, {_METRIC_OF} AS metric, lower(content) || CASE id % 4 WHEN 0 THEN ' Which ones' WHEN 1 THEN ' are THESE all?' WHEN 2 THEN '' ELSE ' list them, all of them' END AS f FROM messages), k AS (SELECT *, " + _KIND.format(f="lower(f)") + f" AS kind FROM a) SELECT session_id, id, metric, {_NEXT} AS next FROM k", "messages")
def follow_up_intents(s, d) -> DataFrame:
    """Every turn, with a phrase of each kind behind it, as a question about each metric."""
    tail = F.element_at(F.array(F.lit(" Which ones"), F.lit(" are THESE all?"), F.lit(""), F.lit(" list them, all of them")), (F.col("id") % 4 + 1).cast("int"))
    metric = F.element_at(F.array(*[F.lit(m) for m in METRICS]), (F.col("session_id") % len(METRICS) + 1).cast("int"))
    return follow_ups(said(s, d).select("session_id", "id", F.concat("content", tail).alias("question"), metric.alias("metric"))).select("session_id", "id", "metric", "next")


query("x26_token_set", f"SELECT session_id, id, md5(array_to_string(list_sort({_WORDS.format('content')}), ' ')) AS h FROM messages", "messages")(lambda s, d: said(s, d).select("session_id", "id", md5(F.array_join(F.array_sort(X.token_set("content")), " ")).alias("h")))
query("x28_history", "SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY id) AS history FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 3) GROUP BY 1", "messages")(lambda s, d: relational.history(V.messages(s, d), 3))

# --- U: document structure -----------------------------------------------------------------------


def two_pages(s, d) -> DataFrame:
    """Documents of two pages with a preamble, a heading that has a smaller one, and one without a body."""
    page = lambda n, *text: F.struct(F.lit(n).alias("page_number"), F.concat(*text).alias("text"))
    head = lambda t, p, level, k: F.struct(F.lit(t).alias("text"), F.lit(p).alias("page_number"), F.lit(level).alias("level"), F.lit(k).alias("order"), F.lit("markdown").alias("reason"))
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    pages = F.array(page(1, F.lit("Start of "), key, F.lit("\nAlpha\n"), "text", F.lit("\nBeta\ninner")), page(2, F.lit("more\nGamma\n\nDelta\nlast")))
    return V.table(s, d, "documents").select(key.alias("document_id"), pages.alias("pages"), F.array(head("Alpha", 1, 1, 0), head("Beta", 1, 2, 1), head("Gamma", 2, 1, 2), head("Delta", 2, 2, 3), head("Omega", 2, 1, 4)).alias("headings"))


_SECTIONS = """sections AS (SELECT 'd' || doc_id AS document_id, k AS section_index, CASE k WHEN 1 THEN 'Alpha' WHEN 2 THEN 'Alpha > Beta' WHEN 3 THEN 'Alpha > Delta' END AS path,
    CASE k WHEN 0 THEN 'Start of d' || doc_id WHEN 1 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN 2 THEN 'inner' || chr(10) || chr(10) || 'more' ELSE 'last' END AS text, CASE k WHEN 1 THEN '1' WHEN 2 THEN '1-2' WHEN 3 THEN '2' END AS page_range FROM documents, (VALUES (0), (1), (2), (3)) v(k) WHERE k <> 1 OR trim(text) <> '')"""
query("u2_u3_sections", f"WITH {_SECTIONS} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_index) - 1 AS INT) AS section_index, path, text, page_range FROM sections")(lambda s, d: chunking.build_sections(two_pages(s, d)).select("document_id", "section_index", F.array_join("section_path", " > ").alias("path"), "text", "page_range"))
query("u14_section_parts", f"""WITH {_SECTIONS}, w AS (SELECT *, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS u FROM sections),
    k AS (SELECT *, unnest(range(0, CASE WHEN len(u) <= 50 THEN 1 ELSE 1 + CAST(ceil((len(u) - 50) / 45) AS BIGINT) END)) AS k FROM w)
    SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_index, k) AS INT) AS part, CASE WHEN len(u) <= 50 THEN text ELSE array_to_string(u[k * 45 + 1 : k * 45 + 50], ' ') END AS text, CASE WHEN len(u) <= 50 THEN 'section_based' ELSE 'section_based_split' END AS strategy FROM k""")(
    lambda s, d: chunking.section_parts(chunking.build_sections(two_pages(s, d)), 50, 5).select("document_id", "part", "text", "strategy")
)

@query("u15_strategy", """WITH p AS (SELECT doc_id, text, left(text, CASE WHEN doc_id % 2 = 0 THEN length(text) // 2 ELSE length(text) // 5 END) AS part FROM documents)
    SELECT 'd' || doc_id AS document_id, CASE WHEN trim(part) <> '' AND 2 * length(part) / greatest(1, length(trim(text))) >= 0.5 THEN 'section_based' ELSE 'fixed_size' END AS strategy FROM p""")
def strategies(s, d) -> DataFrame:
    """Documents with two titled sections of a half, or a fifth, of their text."""
    docs = V.table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), "text", "doc_id")
    part = F.left("text", F.floor(F.length("text") / F.when(F.col("doc_id") % 2 == 0, 2).otherwise(5)).cast("int"))
    return chunking.strategy(docs, docs.select("document_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("section_title"), part.alias("text")))


query("u1_a12_a13_headings", r"""WITH s AS (SELECT document_id, ordinal, CASE WHEN ordinal % 4 = 0 THEN '1.2 ' ELSE '' END || 'Title ' || ordinal || CASE WHEN ordinal % 5 = 0 THEN '.' ELSE '' END AS text, 10 + 2.0 * ((ordinal // 7) % 3) AS size, ordinal % 3 = 0 AS bold FROM chunks),
    f AS (SELECT document_id, size, count(*) AS n, min(ordinal) AS first FROM s GROUP BY 1, 2), b AS (SELECT document_id, size AS body FROM f QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first) = 1),
    r AS (SELECT s.*, CASE WHEN size >= body * 1.15 THEN 'font_size' WHEN bold AND size >= body THEN 'bold' WHEN text LIKE '1.2 %' THEN 'numbering' END AS reason FROM s JOIN b USING (document_id))
    SELECT document_id, text, reason, CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY size DESC) AS INT) AS level FROM r WHERE reason = 'numbering' OR (reason IS NOT NULL AND text NOT LIKE '%.')""", "chunks")(
    lambda s, d: chunking.headings_of_spans(
        V.chunks(s, d).select("document_id", F.lit(1).alias("page_number"), "ordinal", F.concat(F.when(F.col("ordinal") % 4 == 0, "1.2 ").otherwise(""), F.lit("Title "), F.col("ordinal").cast("string"), F.when(F.col("ordinal") % 5 == 0, ".").otherwise("")).alias("text"), (10 + 2.0 * (F.floor(F.col("ordinal") / 7) % 3)).alias("size"), (F.col("ordinal") % 3 == 0).alias("bold"))
    ).select("document_id", "text", "reason", "level")
)
#: The public byte-level vocabulary that the query uses; a parameter of `tokens.from_ranks`.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
query("u12_token_windows")(lambda s, d: chunking.token_windows(V.chunks(s, d).select(F.col("chunk_id").alias("document_id"), "text"), partial(tokens.from_ranks, VOCABULARY), 400, 40))
query("u17_layout", "SELECT doc_id, md5(regexp_replace(text || chr(10), '[ \\t]+\\n', chr(10), 'g') || (doc_id % 100) || '. item' || chr(10) || '(a) - b |') AS text FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", md5(chunking.repaired_layout(F.concat("text", F.lit("\n"), (F.col("doc_id") % 100).cast("string"), F.lit(".\n  item  \n(a)-b - |")))).alias("text")))

# --- T: calls ------------------------------------------------------------------------------------

query("s11_webhook_events", "SELECT seq, uuid, status, duration FROM call_events", "call_events")(
    lambda s, d: webhooks.call_events(V.call_events(s, d).select("seq", "ts", F.to_json(F.struct("uuid", "status", "duration", F.lit("x").alias("other"))).alias("body"))).select("seq", "uuid", "status", "duration")
)
query("t3_whole_seconds", "SELECT seq, CAST(trunc(try_cast(duration AS DOUBLE)) AS INT) AS seconds FROM call_events", "call_events")(lambda s, d: V.call_events(s, d).select("seq", C.whole_seconds("duration").alias("seconds")))
query("t5_hypothesis", "SELECT seq, CASE WHEN seq % 3 > 0 THEN coalesce(status, '') ELSE '' END AS text, CASE seq % 3 WHEN 1 THEN 0.75::DOUBLE END AS confidence FROM call_events", "call_events")(
    lambda s, d: V.call_events(s, d).select("seq", C.best_hypothesis(F.from_json(F.when(F.col("seq") % 3 == 1, F.concat(F.lit('[{"text": " '), "status", F.lit(' ", "confidence": "0.75"}, {"text": "no"}]'))).when(F.col("seq") % 3 == 2, F.concat(F.lit('[{"text": "'), "status", F.lit('", "confidence": "bad"}]'))).otherwise("[]"), "array<struct<text:string,confidence:string>>")).alias("h")).select("seq", "h.text", "h.confidence")
)
_HAND = "(['resolved', 'not_resolved', 'unclear', 'no_answer', 'failed', 'odd'])[CAST(seq % 6 AS INT) + 1]"
query("t7_set_by_hand", f"""WITH e AS (SELECT seq, seq % 6 = 5 OR coalesce(status IN ('completed', 'unanswered', 'timeout', 'failed', 'rejected', 'cancelled'), false) AS rejected, {_HAND} AS r, seq % 500 - 100 AS took FROM call_events)
    SELECT seq, rejected, CASE WHEN rejected THEN NULL WHEN r IN ('no_answer', 'failed') THEN r ELSE 'completed' END AS status, CASE WHEN NOT rejected AND r NOT IN ('no_answer', 'failed') THEN r END AS outcome,
    CASE WHEN rejected THEN NULL WHEN r = 'resolved' THEN r WHEN r IN ('no_answer', 'failed') THEN 'pending_follow_up' ELSE 'needs_agent' END AS ticket_status, CASE WHEN NOT rejected THEN took END AS duration_seconds FROM e""", "call_events")(
    lambda s, d: V.call_events(s, d).withColumn("now", F.timestamp_add("SECOND", (F.col("seq") % 500 - 100).cast("int"), F.col("ts").cast("timestamp"))).select("seq", C.set_by_hand(C.call_status("status"), F.element_at(F.array(*[F.lit(x) for x in (*C.BY_HAND, "odd")]), (F.col("seq") % 6 + 1).cast("int")), F.col("ts").cast("timestamp"), F.col("now")).alias("c")).select("seq", "c.*")
)
query("t8_can_start_call", "SELECT t.id FROM tickets t JOIN customers c ON c.id = t.customer_id WHERE t.company_id = 3 AND assigned_agent_id = 4 AND status = 'pending_follow_up' AND is_active AND c.id % 3 > 0 AND t.id % 7 > 0", "tickets", "customers")(
    lambda s, d: relational.can_start_call(V.tickets(s, d), V.customers(s, d).withColumn("phone", F.when(F.col("id") % 3 > 0, "01").otherwise(" ")), V.tickets(s, d).where("id % 7 = 0").select(F.col("id").alias("ticket_id"), F.lit("ringing").alias("status")), Tenant(3), 4).select("id")
)

# --- L: model-backed, with the offline stand-ins --------------------------------------------------


_ASKED = (" How many calls this month?", " top 5 reasons", " unresolved tickets in the last 30 days", "")


@query("l1_intents", r"WITH q AS (SELECT session_id, id, id % 4 AS k, lower(content) AS c FROM messages) SELECT session_id, id, CASE k WHEN 0 THEN 'total_calls' WHEN 1 THEN 'common_call_reasons' WHEN 2 THEN 'unresolved_tickets' ELSE 'top_issues' END AS metric, CASE k WHEN 0 THEN 'this_month' WHEN 2 THEN 'last_30_days' ELSE 'all_time' END AS period, CASE k WHEN 1 THEN 5 ELSE 10 END AS n FROM q", "messages")
def intents(s, d) -> DataFrame:
    """Every turn, three of four with a question behind it."""
    tail = F.element_at(F.array(*[F.lit(a) for a in _ASKED]), (F.col("id") % 4 + 1).cast("int"))
    return parsed(said(s, d).select("session_id", "id", F.concat("content", tail).alias("question")), RuleParser()).select("session_id", "id", "intent.metric", "intent.period", "intent.n")


query("l2_outcomes", r"SELECT session_id, id, CASE WHEN regexp_matches(content, '(?i)\b(no|not|still|isn''t|doesn''t|never)\b') THEN 'not_resolved' WHEN regexp_matches(content, '(?i)\b(yes|yeah|solved|fixed|resolved|works|thanks)\b') THEN 'resolved' ELSE 'unclear' END AS outcome FROM messages", "messages")(
    lambda s, d: said(s, d).select("session_id", "id", models.outcome_of(F.col("content"), models.LexiconClassifier()).alias("outcome"))
)
query("l5_answers", "SELECT ordinal AS query_id, CASE ordinal % 3 WHEN 0 THEN left(string_split(text, chr(10))[1], 200) || ' [1]' ELSE 'There is not enough information to answer.' END AS answer, ordinal % 3 = 0 AS sufficient FROM chunks", "chunks")(
    lambda s, d: models.answers(V.chunks(s, d).select(F.col("ordinal").alias("query_id"), F.lit("what?").alias("question"), F.lit("en").alias("language"), F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("[1] x\n"), "text")).when(F.col("ordinal") % 3 == 1, "[1] only a label").alias("context")), models.EchoGenerator())
)
query("l11_search_reply", "SELECT session_id, id, CASE id % 4 WHEN 0 THEN content WHEN 1 THEN 't' ELSE '' END AS answer, CASE id % 4 WHEN 0 THEN '{\"title\":\"' || role || '\"}' WHEN 2 THEN '{\"url\":\"' || role || '\"}' ELSE '' END AS sources FROM messages WHERE id % 4 < 3", "messages")(
    lambda s, d: said(s, d).select("session_id", "id", models.search_reply(F.when(F.col("id") % 4 == 0, F.to_json(F.struct(F.lit("t").alias("text"), F.col("content").alias("answer"), F.array("role").alias("sources")))).when(F.col("id") % 4 == 1, '{"output": "o", "text": "t"}').when(F.col("id") % 4 == 2, F.concat(F.lit('[{"url":"'), "role", F.lit('"}]'))).otherwise("oops")).alias("r")).where("r IS NOT NULL").select("session_id", "id", "r.answer", F.array_join("r.sources", ",").alias("sources"))
)
