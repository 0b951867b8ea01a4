"""Named queries over the warehouse tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import registry_functions  # noqa: F401  (registers its queries)
from .catalog import SQL, TENANT, Q, query
from .functions import embedding
from .functions import text as X
from .operators import cells, chunking, evaluation, greedy, html_sections, metrics, mutations, relational, retrieval, store
from .plans import views as V
from .plans.intent import METRICS, AnalyticsIntent
from .plans.tenancy import clean_filters, predicate, scoped
from .sources.staging import fresh_folder
from .streaming import calls as C
from .streaming import keyed



# --- M: metrics ----------------------------------------------------------------------------------

_T, _C = "company_id = 3", "company_id = 3"
_MONTH = "created_at >= date_trunc('month', TIMESTAMP '2001-08-01 00:00:00')"
_DAYS = "created_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY"
_OPEN = "status IN ('needs_agent', 'pending_follow_up')"
_COUNT = "SELECT count(*) AS value FROM {} WHERE company_id = 3{}"
_GROUP = "SELECT subject, status, count(*) AS count FROM tickets WHERE company_id = 3 AND {} GROUP BY 1, 2 ORDER BY count DESC, subject, status LIMIT 10"
METRIC_SQL = {
    "resolved_tickets": _COUNT.format("tickets", " AND status = 'resolved'"),
    "unresolved_tickets": _COUNT.format("tickets", f" AND {_OPEN}"),
    "total_tickets": _COUNT.format("tickets", ""),
    "customers_with_unresolved_tickets": f"SELECT count(DISTINCT customer_id) AS value FROM tickets WHERE {_T} AND {_OPEN}",
    "resolved_ticket_list": _GROUP.format("status = 'resolved'"),
    "unresolved_ticket_list": _GROUP.format(_OPEN),
    "tickets_needing_agent_call": """WITH w AS (SELECT * FROM tickets WHERE company_id = 3 AND status = 'pending_follow_up'), f AS (SELECT * FROM w ORDER BY created_at, id LIMIT 10)
        SELECT (SELECT count(*) FROM w) AS total, (SELECT count(*) FROM f) AS returned, (SELECT string_agg(id || ':' || subject, '|' ORDER BY created_at, id) FROM f) AS tickets""",
    "top_issues": f"SELECT subject, count(*) AS count FROM tickets WHERE {_T} GROUP BY 1 ORDER BY count DESC, subject LIMIT 10",
    "total_calls": _COUNT.format("calls", ""),
    "resolved_calls": _COUNT.format("calls", " AND outcome = 'resolved'"),
    "unresolved_calls": _COUNT.format("calls", " AND outcome = 'not_resolved'"),
    "unclear_calls": _COUNT.format("calls", " AND outcome = 'unclear'"),
    "no_answer_calls": _COUNT.format("calls", " AND status = 'no_answer'"),
    "failed_calls": _COUNT.format("calls", " AND status = 'failed'"),
    "calls_by_outcome": f"SELECT coalesce(outcome, status) AS outcome, count(*) AS count FROM calls WHERE {_C} GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10",
    "common_call_reasons": "SELECT coalesce(nullif(trim(reason), ''), t.subject) AS reason, count(*) AS count FROM calls c JOIN tickets t ON t.id = c.ticket_id WHERE c.company_id = 3 AND t.company_id = 3 GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10",
    "average_call_duration": f"SELECT avg(duration_seconds) AS value FROM calls WHERE {_C}",
}


def run_metric(spark, d, name, period="all_time", limit=10) -> DataFrame:
    out = metrics.metric(AnalyticsIntent(name, period, limit), TENANT, V.tickets(spark, d), V.calls(spark, d), V.AS_OF)
    if name == "tickets_needing_agent_call":  # one string, which any engine compares
        out = out.withColumn("tickets", F.array_join(F.transform("tickets", lambda t: F.concat_ws(":", t["id"].cast("string"), t["subject"])), "|"))
    return out


#: Where each metric stands in the catalogue: resolved_tickets is m1, average_call_duration m17.
for _n, _m in enumerate(METRICS, 1):
    query(f"m{_n}_{_m}", METRIC_SQL[_m], "tickets", "calls")(lambda s, d, m=_m: run_metric(s, d, m))
query("f6_this_month_tickets", _COUNT.format("tickets", f" AND {_MONTH}"), "tickets")(lambda s, d: run_metric(s, d, "total_tickets", "this_month"))
query("f6_last_30_days_tickets", _COUNT.format("tickets", f" AND {_DAYS}"), "tickets")(lambda s, d: run_metric(s, d, "total_tickets", "last_30_days"))
query("f6_last_30_days_calls_by_outcome", f"SELECT coalesce(outcome, status) AS outcome, count(*) AS count FROM calls WHERE {_C} AND {_DAYS} GROUP BY 1 ORDER BY count DESC, 1 LIMIT 10", "calls")(lambda s, d: run_metric(s, d, "calls_by_outcome", "last_30_days"))

# --- S, F, J, A, R: relational -------------------------------------------------------------------

query("s1_scan", "SELECT n_nationkey AS id, n_name AS name FROM nation")(V.companies)
query("s2_get", "SELECT * FROM tickets WHERE id = 7", "tickets")(lambda s, d: relational.get(V.tickets(s, d), 7))
query("f1_scoped_customers", "SELECT * FROM customers WHERE company_id = 3", "customers")(lambda s, d: scoped(V.customers(s, d), TENANT))
query("f4_where_builder", "SELECT chunk_id, language, source FROM chunks WHERE language IN ('fr', 'es') AND source = 'src1'", "chunks")(
    lambda s, d: V.chunks(s, d).where(predicate(clean_filters({"language": ["fr", "es", None], "source": "src1", "domain": "x", "document_id": []})[0])).select("chunk_id", "language", "source")
)
query("f5_absent_sentinel", "SELECT ticket_id, status FROM calls WHERE coalesce(outcome, '') = '' AND company_id = 3 ORDER BY ticket_id, status", "calls")(lambda s, d: scoped(V.calls(s, d), TENANT).where(predicate({"outcome": ""})).select("ticket_id", "status"))
query("f9_lookup", "SELECT * FROM tickets WHERE company_id = 3 AND assigned_agent_id = 4 ORDER BY id LIMIT 1", "tickets")(lambda s, d: relational.first_match(scoped(V.tickets(s, d), TENANT), assigned_agent_id=4))
query("f12_blank_to_null", "SELECT ticket_id, coalesce(nullif(trim(reason), ''), 'none') AS reason FROM calls WHERE company_id = 3", "calls")(lambda s, d: scoped(V.calls(s, d), TENANT).select("ticket_id", F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("none")).alias("reason")))
query("f13_flatten", "SELECT chunk_id, document_id || ' > ' || source AS section_path, coalesce(nullif(section_index, 0), -1) AS section_index FROM chunks", "chunks")(
    lambda s, d: V.chunks(s, d).select("chunk_id", F.concat_ws(" > ", F.array("document_id", "source")).alias("section_path"), F.coalesce(F.nullif("section_index", F.lit(0)), F.lit(-1)).alias("section_index"))
)
query("f14_agent_queue", "SELECT t.id, t.subject, c.id AS customer, c.full_name FROM tickets t LEFT JOIN customers c ON c.id = t.customer_id WHERE t.company_id = 3 AND assigned_agent_id = 4 AND status = 'pending_follow_up'", "tickets", "customers")(
    lambda s, d: relational.agent_queue(V.tickets(s, d), V.customers(s, d), TENANT, 4).select("id", "subject", F.col("customer.id").alias("customer"), "customer.full_name")
)
query("f15_visible", "SELECT id, subject FROM tickets WHERE company_id = 3 AND assigned_agent_id = 4 AND id = (SELECT min(id) FROM tickets WHERE company_id = 3 AND assigned_agent_id = 4)", "tickets")(
    lambda s, d: relational.visible_ticket(V.tickets(s, d), TENANT, "agent", 4, scoped(V.tickets(s, d), TENANT).where("assigned_agent_id = 4").agg(F.min("id")).first()[0] or 0).select("id", "subject")
)
query("j2_users_of_role", "SELECT u.* FROM users u JOIN roles r ON r.id = u.role_id WHERE r.name = 'agent' ORDER BY u.id", "users", "roles")(lambda s, d: relational.by_role(V.users(s, d), V.roles(s, d), "agent").select("id", "company_id", "full_name", "role_id", "is_active"))
query("j3_with_customer", "SELECT t.id, c.full_name FROM tickets t LEFT JOIN customers c ON c.id = t.customer_id", "tickets", "customers")(lambda s, d: relational.with_customer(V.tickets(s, d), V.customers(s, d)).select("id", "customer.full_name"))
query("j5_owned_messages", "SELECT * FROM messages WHERE session_id % 25 = 3", "messages")(lambda s, d: relational.owned_messages(V.messages(s, d), V.messages(s, d).select(F.col("session_id").alias("id"), (F.col("session_id") % 25).alias("company_id")).distinct(), TENANT))
query("a1_document_listing", "SELECT document_id, arg_min(source, ordinal) AS source, arg_min(language, ordinal) AS language, count(*) AS chunks FROM chunks GROUP BY 1", "chunks")(lambda s, d: relational.document_listing(V.chunks(s, d)))
query("a2_count", "SELECT count(*) AS n FROM chunks", "chunks")(lambda s, d: V.chunks(s, d).agg(F.count("*").alias("n")))
query("a4_chunk_report", """WITH p AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1), s AS (SELECT length(text) AS n, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM chunks)
    SELECT count(*) AS total, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS min, max(n) AS max, quantile_disc(n, 0.25)::DOUBLE AS p25, quantile_disc(n, 0.75)::DOUBLE AS p75, quantile_disc(n, 0.95)::DOUBLE AS p95,
    round(100.0 * count(*) FILTER (n < 500) / count(*), 2) AS below_min_pct, round(100.0 * count(*) FILTER (n >= 4000) / count(*), 2) AS at_max_pct, count(*) FILTER (n > 4000) AS violations, count(*) FILTER (body = '') AS empty,
    count(*) - count(DISTINCT body) AS duplicates, (SELECT avg(n) FROM p) AS chunks_per_document, (SELECT max(n) FROM p) AS most_per_document FROM s""", "chunks")(lambda s, d: evaluation.chunk_report(V.chunks(s, d), 500, 4000))
query("a4_histogram", "SELECT CAST(floor(length(text) / 500) * 500 AS BIGINT) AS bucket, count(*) AS chunks FROM chunks GROUP BY 1", "chunks")(lambda s, d: evaluation.histogram(V.chunks(s, d), 500))
query("a6_latency", """SELECT count(value) AS count, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS median, round(quantile_disc(value, 0.95), 3) AS p95, round(quantile_disc(value, 0.99), 3) AS p99,
    round(min(value), 3) AS min, round(max(value), 3) AS max FROM events""")(lambda s, d: evaluation.latency_summary(V.table(s, d, "events"), "value"))
query("a10_exact_dedup", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY document_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY ordinal) AS n FROM chunks)
    SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS INT) AS part FROM k WHERE n = 1""", "chunks")(
    lambda s, d: chunking.dedupe_exact(V.chunks(s, d).select("document_id", "chunk_id", "text", F.col("ordinal").alias("part"))).select("document_id", "chunk_id", "part")
)
query("a16_session_summary", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM messages)
    SELECT session_id, right(string_agg(upper(role[1]) || role[2:] || ': ' || content, chr(10) ORDER BY id), 6000) AS summary FROM m WHERE back > 4 GROUP BY 1""", "messages")(lambda s, d: relational.session_summary(V.messages(s, d), keep=4))
query("a17_id_union", "SELECT session_id, list_sort(list_distinct(list(role) || ['user', 'zz']))::VARCHAR AS ids FROM messages GROUP BY 1".replace("::VARCHAR", "").replace("list_sort(", "array_to_string(list_sort(").replace(" AS ids", ", ',') AS ids"), "messages")(
    lambda s, d: V.messages(s, d).groupBy("session_id").agg(F.collect_list("role").alias("a")).select("session_id", F.array_join(relational.id_union("a", F.array(F.lit("user"), F.lit("zz"))), ",").alias("ids"))
)
query("r16_ticket_list", "SELECT id, subject, status FROM tickets WHERE company_id = 3", "tickets")(lambda s, d: relational.ticket_list(V.tickets(s, d), TENANT).select("id", "subject", "status"))
query("r18_last_messages", "SELECT session_id, id, role FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 4", "messages")(lambda s, d: relational.last_messages(V.messages(s, d), 4).select("session_id", "id", "role"))
_SESSIONS = "s AS (SELECT session_id AS id, session_id % 25 AS company_id, max(id) AS updated_at, coalesce(nullif(left(arg_min(content, id) FILTER (role = 'user'), 80), ''), 'New chat') AS title FROM messages GROUP BY 1, 2)"


def sessions(s, d) -> DataFrame:
    m = V.messages(s, d)
    last = m.groupBy(F.col("session_id").alias("id"), (F.col("session_id") % 25).alias("company_id")).agg(F.max("id").alias("updated_at"))
    return relational.titled(last, m)


query("r17_session_list", f"WITH {_SESSIONS} SELECT id, updated_at, title, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM s WHERE company_id = 3", "messages")(
    lambda s, d: relational.session_list(sessions(s, d), TENANT).select("id", "updated_at", "title", "place")
)
query("t10_session_titles", f"WITH {_SESSIONS} SELECT id, title FROM s", "messages")(lambda s, d: sessions(s, d).select("id", "title"))
query("r17_message_order", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS place FROM messages", "messages")(
    lambda s, d: relational.ordered_messages(V.messages(s, d), "id").select("session_id", "id", "place")
)
query("r19_stratified", "SELECT ordinal, language FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY ordinal) AS cycle FROM chunks) ORDER BY cycle, language LIMIT 30", "chunks")(lambda s, d: retrieval.stratified(V.chunks(s, d), 30, "language").select("ordinal", "language"))

# --- K: snapshots --------------------------------------------------------------------------------

query("k1_insert", "SELECT id, company_id, full_name FROM users UNION ALL SELECT (SELECT max(id) FROM users) + row_number() OVER (), company_id, full_name FROM (SELECT company_id, 'copy' AS full_name FROM users WHERE company_id = 3)", "users")(
    lambda s, d: mutations.insert(V.users(s, d).select("id", "company_id", "full_name"), scoped(V.users(s, d), TENANT).select("company_id", F.lit("copy").alias("full_name")))
)
query("k2_partial_update", "SELECT id, company_id, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'renamed' ELSE full_name END AS full_name, CASE WHEN id % 3 = 2 THEN NOT is_active ELSE is_active END AS is_active, 'now' AS updated_at FROM users", "users")(
    lambda s, d: mutations.update(
        V.users(s, d).select("id", "company_id", "full_name", "is_active", F.lit(None).cast("string").alias("updated_at")),
        V.users(s, d).select("id", F.when(F.col("id") % 3 == 1, "renamed").alias("full_name"), (~F.col("is_active")).alias("is_active"), F.when(F.col("id") % 3 == 2, F.array(F.lit("is_active"))).otherwise(F.array(F.lit("full_name"))).alias("set")),
        ["full_name", "is_active"],
        F.lit("now"),
    )
)
query("k3_toggle", "SELECT id, CASE WHEN id = 3 THEN false ELSE is_active END AS is_active, CASE WHEN id = 3 THEN 'now' END AS updated_at FROM users", "users")(lambda s, d: mutations.toggle(V.users(s, d).select("id", "is_active", F.lit(None).cast("string").alias("updated_at")), 3, False, F.lit("now")))
_K = ("chunk_id", "document_id", "ordinal", "text")
query("k4_upsert", "SELECT chunk_id, document_id, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'new' ELSE text END AS text FROM chunks", "chunks")(
    lambda s, d: mutations.upsert(V.chunks(s, d).select(*_K), V.chunks(s, d).where("ordinal % 3 = 0").select(*_K[:3], F.lit("new").alias("text")))
)


def stored(s, d) -> str:
    """The chunks as a table in buckets of their documents."""
    path = fresh_folder(s, "store")
    store.create(V.chunks(s, d).select(*_K), path, "document_id")
    return path


def stored_upsert(s, d) -> DataFrame:
    path = stored(s, d)
    store.upsert(s, path, V.chunks(s, d).where("ordinal % 3 = 0").select(*_K[:3], F.lit("new").alias("text")))
    return store.read(s, path)


def stored_delete(s, d) -> DataFrame:
    path = stored(s, d)
    store.delete(s, path, V.chunks(s, d).where("document_id = 'd5'").select("document_id"), ["document_id"])
    return store.read(s, path).select("chunk_id")


query("k4_stored_upsert", "SELECT chunk_id, document_id, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'new' ELSE text END AS text FROM chunks", "chunks")(stored_upsert)
query("k6_stored_delete", "SELECT chunk_id FROM chunks WHERE document_id <> 'd5'", "chunks")(stored_delete)
query("k5_add", "SELECT chunk_id, ordinal FROM chunks UNION ALL SELECT 'x' || chunk_id, ordinal FROM chunks", "chunks")(lambda s, d: mutations.add(V.chunks(s, d).select("chunk_id", "ordinal"), V.chunks(s, d).select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), "ordinal")))
query("k6_delete_document", "SELECT chunk_id FROM chunks WHERE document_id <> 'd5'", "chunks")(lambda s, d: mutations.delete_document(V.chunks(s, d), "d5")[0].select("chunk_id"))
query("k7_delete_chunks", "SELECT count(*) AS deleted FROM chunks WHERE ordinal % 7 = 0", "chunks")(lambda s, d: mutations.delete_keys(V.chunks(s, d), V.chunks(s, d).where("ordinal % 7 = 0").select("chunk_id").unionByName(s.createDataFrame([("no",)], "chunk_id string")))[1])
query("k8_export", "SELECT chunk_id, md5(text) AS text, document_id, CASE WHEN ordinal % 3 > 0 THEN source ELSE '' END AS source, CASE WHEN section_index > 0 THEN section_index ELSE -1 END AS section_index, language || ' > ' || source AS path FROM chunks", "chunks")(
    lambda s, d: mutations.exported(
        V.chunks(s, d).select("chunk_id", "text", "document_id", F.when(F.col("ordinal") % 3 > 0, F.col("source")).alias("source"), F.nullif("section_index", F.lit(0)).alias("section_index"), F.array("language", "source").alias("path"))
    ).select("chunk_id", F.from_json("json", "text string, metadata struct<document_id:string,source:string,section_index:int,path:string>").alias("j")).select("chunk_id", F.md5(F.col("j.text").cast("binary")).alias("text"), "j.metadata.*")
)
query("k12_delete_session", "SELECT session_id, id FROM messages WHERE session_id <> 3", "messages")(
    lambda s, d: mutations.delete_session(V.messages(s, d).select(F.col("session_id").alias("id"), F.lit(3).alias("company_id")).distinct(), V.messages(s, d), 3, 3)[1].select("session_id", "id")
)

# --- R: retrieval --------------------------------------------------------------------------------

_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
_QQ, _CC, _QC = _DOT.format("q.qvec", "q.qvec"), _DOT.format("c.vector", "c.vector"), _DOT.format("q.qvec", "c.vector")
_SCORED = f"""scored AS (SELECT q.query_id, q.wanted, c.chunk_id, c.ordinal, c.label, CASE WHEN {_QQ} * {_CC} = 0 THEN 1.0 ELSE 1 - {_QC} / (sqrt({_QQ}) * sqrt({_CC})) END AS d
    FROM corpus c, questions q WHERE c.vector IS NOT NULL AND q.qvec IS NOT NULL)"""
_NEAR = "near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ordinal) AS rank FROM scored)"
_TOK = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'))"
_TERMS = f"terms AS (SELECT query_id, list_filter({_TOK.format('text')}, lambda t: length(t) > 1) AS terms FROM questions)"
_WORDS = f"tokens AS (SELECT chunk_id, ordinal, {_TOK.format('text')} AS tokens FROM chunks)"
_KEYS = r"""hits AS (SELECT query_id, chunk_id, ordinal, len(list_intersect(terms, tokens)) / len(terms) + 0.75 * len(list_filter(list_intersect(terms, tokens), lambda t: regexp_matches(t, '^\p{Nd}+$'))) AS score FROM terms, tokens WHERE len(list_intersect(terms, tokens)) > 0),
    words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM hits)"""
_FUSED = r"""kw AS (SELECT query_id, CASE WHEN len(list_filter(terms, lambda t: regexp_matches(t, '^\p{Nd}+$'))) > 0 THEN 2.0 ELSE 1.25 END::DOUBLE AS w FROM terms),
    both_lists AS (SELECT query_id, chunk_id, rank, 0 AS list, 1.0::DOUBLE / (60 + rank) AS part FROM near WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, rank, 1, w / (60 + rank) FROM words JOIN kw USING (query_id) WHERE rank <= 50),
    fused AS (SELECT query_id, chunk_id, sum(CASE WHEN list = 0 THEN part ELSE 0 END) + sum(CASE WHEN list = 1 THEN part ELSE 0 END) AS hybrid_score, min(list * 1000 + rank) AS place FROM both_lists GROUP BY 1, 2),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, place) AS pos FROM fused)"""


def questions(s, d) -> DataFrame:
    """Every benchmark item asks, with its whole text and the vector that has its id."""
    vec = V.vectors(s, d).select(F.col("ordinal").alias("query_id"), F.col("vector").alias("qvec"), F.col("label").alias("wanted"))
    q = V.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vec, "query_id", "left")
    return q.select("query_id", "qvec", "wanted", F.filter(retrieval.query_terms("text"), lambda t: F.length(t) > 1).alias("terms"))


def corpus(s, d) -> DataFrame:
    c = V.with_vectors(s, d)
    return c.withColumns({"tokens": retrieval.document_tokens("text"), "content_hash": X.content_hash(F.trim("text")), "source_url": F.concat(F.lit("http://x/"), "chunk_id")})


query("r1_cosine", f"WITH {_SCORED} SELECT query_id, count(*) AS n, round(sum(d), 6) AS total, round(min(d), 6) + 0.0 AS least FROM scored GROUP BY 1", "corpus", "questions")(
    lambda s, d: retrieval.distances(V.with_vectors(s, d), questions(s, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("total"), (F.round(F.min("d"), 6) + 0.0).alias("least"))
)
query("r2_semantic", f"WITH {_SCORED}, {_NEAR} SELECT query_id, chunk_id, rank, round(greatest(0, 1 - d), 6) AS score FROM near WHERE rank <= 50", "corpus", "questions")(lambda s, d: retrieval.semantic_search(corpus(s, d), questions(s, d), 50).select("query_id", "chunk_id", "rank", "score"))


def approximate(s, d) -> DataFrame:
    """Every question's ten nearest chunks among those of its nearest cells, as many as the index was tuned for."""
    path = fresh_folder(s, "cells")
    cells.build(V.with_vectors(s, d), path)
    return cells.search(s, path, questions(s, d), 10).select("query_id", "chunk_id", "rank", "score")


query("r3_approximate")(approximate)
query("r4_query_terms", f"WITH {_TERMS} SELECT query_id, array_to_string(list_sort(terms), ' ') AS terms FROM terms", "questions")(lambda s, d: questions(s, d).select("query_id", F.array_join(F.array_sort("terms"), " ").alias("terms")))
query("r5_document_tokens", f"WITH {_WORDS} SELECT chunk_id, md5(array_to_string(list_sort(tokens), ' ')) AS tokens FROM tokens", "chunks")(lambda s, d: corpus(s, d).select("chunk_id", F.md5(F.array_join(F.array_sort("tokens"), " ").cast("binary")).alias("tokens")))
query("r7_keyword", f"WITH {_TERMS}, {_WORDS}, {_KEYS} SELECT query_id, chunk_id, rank, score FROM words WHERE rank <= 50", "corpus", "questions")(lambda s, d: retrieval.keyword_search(corpus(s, d), questions(s, d), 50).select("query_id", "chunk_id", "rank", "score"))
query("r10_fusion", f"WITH {_SCORED}, {_NEAR}, {_TERMS}, {_WORDS}, {_KEYS}, {_FUSED} SELECT query_id, chunk_id, pos, round(hybrid_score, 9) AS hybrid_score FROM ordered", "corpus", "questions")(
    lambda s, d: retrieval.fuse(retrieval.semantic_search(corpus(s, d), questions(s, d), 50), retrieval.keyword_search(corpus(s, d), questions(s, d), 50), questions(s, d)).select("query_id", "chunk_id", "pos", F.round("hybrid_score", 9).alias("hybrid_score"))
)
query("r13_retrieve")(lambda s, d: retrieval.retrieve(corpus(s, d), questions(s, d), 5).select("query_id", "chunk_id", "pos", "hybrid_score", "duplicate_source_urls"))
query("r12_diversify", """WITH b AS (SELECT *, ordinal % 10 AS query_id, row_number() OVER (PARTITION BY ordinal % 10 ORDER BY ordinal) AS pos FROM chunks),
    l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, document_id, section_index ORDER BY pos) = 1 THEN 0 ELSE 1 END AS later FROM b),
    o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY later, pos) AS pos FROM l) SELECT * FROM o WHERE pos <= 40""", "chunks")(
    lambda s, d: retrieval.diversify(V.chunks(s, d).withColumn("query_id", F.col("ordinal") % 10).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal"))), 40).select("query_id", "chunk_id", "pos")
)
query("r14_pack_context", """WITH b AS (SELECT session_id AS query_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS pos, role, content FROM messages),
    t AS (SELECT query_id, pos, sum(length('[' || pos || '] ' || role || chr(10) || content)) OVER (PARTITION BY query_id ORDER BY pos) AS total FROM b) SELECT query_id, pos FROM t WHERE total <= 900 OR pos = 1""", "messages")(
    lambda s, d: retrieval.pack_context(V.messages(s, d).select(F.col("session_id").alias("query_id"), F.row_number().over(Window.partitionBy("session_id").orderBy("id")).alias("pos"), F.col("role").alias("label"), F.col("content").alias("text")), 900).select("query_id", "pos")
)

# --- E: evaluation -------------------------------------------------------------------------------


def judged(s, d) -> tuple[DataFrame, DataFrame]:
    """Vectors with the question's label are relevant."""
    c = V.with_vectors(s, d)
    asked = questions(s, d)
    q = asked.where("qvec IS NOT NULL").select(F.col("query_id").alias("question_id"), "wanted")
    rows = retrieval.semantic_search(c, asked, 10).withColumnRenamed("query_id", "question_id").join(q, "question_id").join(V.vectors(s, d).select("ordinal", "label"), "ordinal")
    rel = (F.col("label") == F.col("wanted")).cast("int")
    n = V.vectors(s, d).groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("n_relevant"))
    return rows.select("question_id", "rank", rel.alias("rel"), rel.cast("double").alias("gain")), q.join(n, "wanted").select("question_id", "n_relevant")


_EVAL = f"""WITH {_SCORED}, {_NEAR}, t AS (SELECT query_id AS question_id, rank, CAST(label = wanted AS INT) AS rel, wanted FROM near WHERE rank <= 10),
    i AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rel DESC, rank) AS ir FROM t), r AS (SELECT label AS wanted, count(*) AS n_relevant FROM embeddings GROUP BY 1)
    SELECT question_id, coalesce(1.0 / min(CASE WHEN rel > 0 THEN rank END), 0) AS mrr, """ + ", ".join(
    f"CAST(max(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS DOUBLE) AS hit_rate_{k}, sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / {k}.0::DOUBLE AS precision_{k}, least(1, sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / any_value(n_relevant)::DOUBLE) AS recall_{k}, "
    f"round(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END), 9) AS dcg_{k}, round(coalesce(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ir <= {k} THEN rel / log2(ir + 1) ELSE 0 END), 0), 0), 9) AS ndcg_{k}"
    for k in (1, 3, 5, 10)
) + " FROM i JOIN r USING (wanted) GROUP BY 1"


@query("e1_e6_ranking_metrics", _EVAL, "corpus", "questions")
def ranking(s, d) -> DataFrame:
    out = evaluation.ranking_metrics(*judged(s, d))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if "dcg" in c})


query("a7_metric_means", f"SELECT round(avg(mrr), 4) AS mrr, round(avg(hit_rate_5), 4) AS hit_rate_5, round(avg(ndcg_10), 4) AS ndcg_10 FROM ({V.with_views(_EVAL, 'corpus', 'questions')})")(lambda s, d: evaluation.means(evaluation.ranking_metrics(*judged(s, d)), "mrr", "hit_rate_5", "ndcg_10"))
_ANS = r"WITH w AS (SELECT session_id, id, content, lag(content) OVER (PARTITION BY session_id ORDER BY id) AS before FROM messages), k AS (SELECT *, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(before, '')), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS b FROM w) "


def turns(s, d) -> DataFrame:
    m = V.messages(s, d)
    return m.withColumn("before", F.lag("content").over(Window.partitionBy("session_id").orderBy("id")))


query("e13_groundedness", _ANS + "SELECT session_id, id, CASE WHEN len(a) = 0 THEN NULL WHEN len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(a), 4) END AS grounded FROM k", "messages")(lambda s, d: turns(s, d).select("session_id", "id", evaluation.groundedness(F.col("content"), F.array(F.coalesce("before", F.lit("")))).alias("grounded")))
query("e14_token_f1", _ANS + "SELECT session_id, id, CASE WHEN before IS NULL OR before = '' THEN NULL WHEN len(list_intersect(a, b)) = 0 THEN 0 ELSE round(2 * (len(list_intersect(a, b)) / len(a)) * (len(list_intersect(a, b)) / len(b)) / (len(list_intersect(a, b)) / len(a) + len(list_intersect(a, b)) / len(b)), 4) END AS f1 FROM k", "messages")(lambda s, d: turns(s, d).select("session_id", "id", evaluation.token_f1(F.col("content"), F.col("before")).alias("f1")))
query("e12_citation_completeness", r"WITH s AS (SELECT session_id, id, list_filter(string_split_regex(regexp_replace(content || ' [' || (id % 3) || '].', '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '' AND regexp_matches(x, '(?i)\d|%|EGP|GB|MB')) AS f FROM messages) SELECT session_id, id, CASE WHEN len(f) > 0 THEN round(len(list_filter(f, lambda x: regexp_matches(x, '\[\d{1,2}\]'))) / len(f), 4) END AS complete FROM s", "messages")(
    lambda s, d: V.messages(s, d).select("session_id", "id", evaluation.citation_completeness(F.concat("content", F.lit(" ["), (F.col("id") % 3).cast("string"), F.lit("]."))).alias("complete"))
)
query("e10_citation_validity", "SELECT session_id, id, CASE id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS valid FROM messages", "messages")(
    lambda s, d: V.messages(s, d).select("session_id", "id", evaluation.citation_validity(F.concat("content", F.when(F.col("id") % 3 == 0, " a [1] b [2][1]").when(F.col("id") % 3 == 1, "[2] and [9]").otherwise(" none")), F.lit(2)).alias("valid"))
)
query("a15_agentic_summary", "SELECT avg(CASE WHEN user_id % 4 >= 1 THEN user_id % 4 END) AS mean_attempts, count(*) FILTER (user_id % 4 > 1) AS rewritten, count(*) FILTER (user_id % 4 >= 1 AND value <= 50) AS gave_up FROM events")(lambda s, d: evaluation.agentic_summary(V.table(s, d, "events").select((F.col("user_id") % 4).alias("attempts"), (F.col("value") > 50).alias("sufficient"))))

# --- X: text -------------------------------------------------------------------------------------

query("x3_normalised", r"SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.md5(X.normalised(X.nfkc("text")).cast("binary")).alias("h"))
)
#: Latin letters to Arabic ones: all of them in a third of the texts, half of them in another.
_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنهو"
_SCRIPTS = f"CASE doc_id % 3 WHEN 0 THEN translate(lower(text), '{_LATIN}', '{_ARABIC[:26]}') WHEN 1 THEN translate(text, '{_LATIN[:13]}', '{_ARABIC[:13]}') ELSE text END"


def scripts() -> Column:
    half = F.translate("text", _LATIN[:13], _ARABIC[:13])
    return F.when(F.col("doc_id") % 3 == 0, F.translate(F.lower("text"), _LATIN, _ARABIC[:26])).when(F.col("doc_id") % 3 == 1, half).otherwise(F.col("text"))


_RATIO = r"CASE WHEN len(regexp_extract_all(t, '\p{L}')) > 0 THEN len(regexp_extract_all(t, '\p{Arabic}'))::DOUBLE / len(regexp_extract_all(t, '\p{L}')) ELSE 0.0::DOUBLE END"
_BY_SCRIPT = f"WITH t AS (SELECT doc_id, {_SCRIPTS} AS t FROM documents), r AS (SELECT doc_id, t, {_RATIO} AS ratio FROM t)"
query("x4_x5_language", _BY_SCRIPT + r" SELECT doc_id, round(ratio, 9) AS ratio, CASE WHEN trim(t) = '' THEN 'unknown' WHEN ratio >= 0.65 THEN 'ar' WHEN ratio > 0.10 THEN 'mixed' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM r")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", scripts().alias("t")).select("doc_id", F.round(X.arabic_ratio("t"), 9).alias("ratio"), X.language("t").alias("language"))
)
query("u13_token_factor", _BY_SCRIPT + " SELECT doc_id, round(5.36 / (5.36 * (1 - ratio) + 1.44 * ratio), 9)::DOUBLE AS factor FROM r")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", scripts().alias("t")).select("doc_id", F.round(chunking.token_factor(X.arabic_ratio("t")), 9).alias("factor"))
)
query("x7_content_hash", "SELECT doc_id, sha256(source || chr(31) || text || chr(31)) AS h, left(sha256(source || chr(31) || text || chr(31)), 12) AS short FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", X.content_hash("source", "text").alias("h"), X.short_hash("source", "text", n=12).alias("short")))
query("x9_ids", "SELECT doc_id, '3:' || lang || ':' || doc_id || ':' || left(sha256('3' || chr(31) || text || chr(31)), 12) AS chunk_id, left(sha256('3' || chr(31) || source || chr(31) || sha256(text || chr(31)) || chr(31)), 20) AS document_id FROM documents")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", X.chunk_key(F.lit(3), "lang", "doc_id", "text").alias("chunk_id"), X.document_key(F.lit(3), "source", "text").alias("document_id"))
)
query("x11_reverse_lines", "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: reverse(x)), chr(10))) AS h FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", F.md5(X.reversed_lines("text").cast("binary")).alias("h")))
query("x14_quality")(lambda s, d: V.table(s, d, "documents").select("doc_id", X.quality("text", F.lit(1), F.when(F.length(F.trim("text")) >= 80, 1).otherwise(0), F.lit(0)).alias("q")).select("doc_id", "q.ok", "q.needs_ocr", "q.chars", "q.problems"))
query("x16_phone", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '20' || c_custkey END AS phone FROM customer")(lambda s, d: V.table(s, d, "customer").select("c_custkey", X.phone(F.concat(F.when(F.col("c_custkey") % 2 == 0, "+(20)-").otherwise("x"), F.col("c_custkey").cast("string"))).alias("phone")))
_GONE = "***REDACTED***"
query("x17_redaction", rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_\-]{{8,}}', '{_GONE}', 'g'), 'ck-[A-Za-z0-9_\-]{{8,}}', '{_GONE}', 'g'), '(?i)(bearer\s+)\S{{4,}}', '\1{_GONE}', 'g'),
    '(?i)((?:x-)?(?:chroma|anthropic|openai|cohere)?[_-]?(?:api[_-]?key|token|secret)"?\s*[:=]\s*"?)[A-Za-z0-9_\-.]{{4,}}', '\1{_GONE}', 'g'), '(?i)(authorization"?\s*[:=]\s*"?)\S{{4,}}', '\1{_GONE}', 'g')) AS h FROM documents""")(
    lambda s, d: V.table(s, d, "documents").select("doc_id", F.md5(X.redacted("text").cast("binary")).alias("h"))
)
query("x18_cited", "SELECT id, session_id, (id % 10) || ',12' AS marks FROM messages", "messages")(lambda s, d: V.messages(s, d).select("id", "session_id", F.array_join(X.cited(F.concat("content", F.lit(" a ["), (F.col("id") % 10).cast("string"), F.lit("] b [12] c [12] ["), (F.col("id") % 10).cast("string"), F.lit("]"))), ",").alias("marks")))
query("x22_follow_up", r"SELECT session_id, id, len(regexp_extract_all(content, '[\p{L}\p{M}\p{N}\p{Pc}]+')) <= 3 OR regexp_matches(content, '(?i)(^|[^\p{L}\p{M}\p{N}\p{Pc}])(it|its|that|this|they|them|those|these|he|she|there)($|[^\p{L}\p{M}\p{N}\p{Pc}])') AS follow_up FROM messages", "messages")(lambda s, d: V.messages(s, d).select("session_id", "id", X.is_follow_up("content").alias("follow_up")))
query("x23_contextual_query")(lambda s, d: turns(s, d).select("session_id", "id", X.contextual_query(F.col("content"), F.col("before")).alias("query")))
query("x25_url_key", "SELECT page_id, lower(regexp_replace(trim(url), '/+$', '')) AS key FROM pages")(lambda s, d: V.table(s, d, "pages").select("page_id", X.url_key("url").alias("key")))
query("x29_one_space", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", F.md5(X.one_space("text").cast("binary")).alias("h")))

# --- U, A9, E19, E20: documents ------------------------------------------------------------------

query("u11_windows", """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS u FROM documents),
    k AS (SELECT doc_id, u, unnest(range(0, CASE WHEN len(u) = 0 THEN 0 WHEN len(u) <= 150 THEN 1 ELSE 1 + CAST(ceil((len(u) - 150) / 130) AS BIGINT) END)) AS k FROM w)
    SELECT doc_id, CAST(k + 1 AS INT) AS part, CAST(len(u[k * 130 + 1 : k * 130 + 150]) AS INT) AS unit_count, md5(array_to_string(u[k * 130 + 1 : k * 130 + 150], ' ')) AS h FROM k""")(
    lambda s, d: chunking.fixed_parts(V.table(s, d, "documents").select("doc_id", "text"), 150, 20).select("doc_id", "part", "unit_count", F.md5(F.col("text").cast("binary")).alias("h"))
)
query("u7_html_sections")(lambda s, d: html_sections.page_sections(V.table(s, d, "pages")))
query("u8_text_sections")(lambda s, d: html_sections.page_sections(V.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("html"), F.col("text").alias("fallback"))))
_ABBR = ", ".join(f"'{a}'" for a in chunking.ABBREVIATIONS)
_TOKENS = r"""k AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS ks FROM documents),
    e AS (SELECT doc_id, list_transform(ks, lambda k, i: CASE WHEN NOT contains(k, chr(10)) AND regexp_matches(rtrim(k), '[.!?؟۔⁉‽]$')
        AND NOT regexp_matches(rtrim(k), '(?i)(https?://|www\.)[^<>"'']+$') AND NOT regexp_matches(rtrim(k), '[\w.+-]+@[\w-]+\.[\w.]+$') AND NOT regexp_matches(rtrim(k), '\.{2,}$')
        AND NOT (regexp_matches(rtrim(k), '\b\d+\.$') AND regexp_matches(coalesce(ks[i + 1], ''), '^[a-z؀-ۿ]'))
        AND lower(trim(regexp_extract(rtrim(k), '([A-Za-z؀-ۿ.]+)\.$', 1), '.')) NOT IN (""" + _ABBR + r""") THEN k || chr(10) ELSE k END) AS ks FROM k),
    p AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(ks, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM e),
    j AS (SELECT doc_id, string_split(array_to_string(list_transform(ps, lambda x, i: CASE WHEN i = 1 THEN x WHEN length(x) < 2 THEN ' ' || x ELSE chr(10) || x END), ''), chr(10)) AS s FROM p WHERE len(ps) > 0)"""
query("u10_sentences", f"WITH {_TOKENS} SELECT doc_id AS document_id, CAST(n - 1 AS INT) AS n, s[n] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM j)")(lambda s, d: chunking.sentences(V.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")))
query("a9_greedy_dedup")(lambda s, d: greedy.dedupe_similar(V.with_vectors(s, d).where("vector IS NOT NULL").select("document_id", "chunk_id", F.col("ordinal").cast("int").alias("part"), "vector"), 0.5).select("document_id", "chunk_id", "part"))
query("e20_lexical_embedding")(lambda s, d: embedding.embedded(V.messages(s, d).select("session_id", "id", F.col("content").alias("text"))).select("session_id", "id", "vector"))
query("a11_running_lines", """WITH l AS (SELECT DISTINCT source, doc_id, trim(x) AS line FROM (SELECT source, doc_id, unnest(string_split(' Head of ' || source || chr(10) || text, chr(10))) AS x FROM documents)),
    n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1) SELECT source AS document_id, line FROM l JOIN n USING (source) WHERE line <> '' AND length(line) < 200 GROUP BY source, line, pages HAVING pages >= 3 AND count(*) >= greatest(2, floor(pages * 0.6))""")(lambda s, d: chunking.running_lines(V.table(s, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.concat(F.lit(" Head of "), "source", F.lit("\n"), "text").alias("text"))))

# --- T: events -----------------------------------------------------------------------------------


def known_calls(s, d) -> DataFrame:
    return V.call_events(s, d).groupBy("uuid").agg(F.min("ts").alias("started_at")).withColumns({"outcome": F.lit("resolved"), "ticket_id": F.col("uuid").cast("long") % 40, "company_id": F.lit(3)})


_MAP = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.STATUS.items()) + " END"
_FOLD = f"""WITH e AS (SELECT *, {_MAP} AS dst, min(ts) OVER (PARTITION BY uuid) AS started_at FROM call_events), {{keep}}
    g AS (SELECT uuid, arg_max(dst, {{o}}) AS status, CASE WHEN bool_or(dst IN ('busy', 'no_answer', 'failed')) THEN NULL ELSE 'resolved' END AS outcome, max({{o}}) FILTER (dst IN ('busy', 'no_answer', 'failed', 'completed')) AS last_end,
      coalesce(arg_max(CAST(trunc(try_cast(duration AS DOUBLE)) AS INT), {{o}}) FILTER (dst = 'completed' AND try_cast(duration AS DOUBLE) IS NOT NULL), arg_min(greatest(0, CAST(floor((epoch_us(ts) - epoch_us(started_at)) / 1000000) AS INT)), {{o}}) FILTER (dst = 'completed')) AS duration_seconds,
      CASE WHEN bool_or(dst IN ('busy', 'no_answer', 'failed')) THEN 'pending_follow_up' END AS ticket_status, count(*) AS events FROM {{src}} WHERE dst IS NOT NULL GROUP BY 1)
    SELECT uuid, status, outcome, duration_seconds, ticket_status, events FROM g"""
query("t1_lifecycle", _FOLD.format(keep="", o="seq", src="e"), "call_events")(lambda s, d: C.lifecycle(V.call_events(s, d), known_calls(s, d)).drop("ended_at"))
query("t2_lifecycle_strict", _FOLD.format(keep="r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ts, seq) AS o FROM e WHERE dst IS NOT NULL), k AS (SELECT *, min(o) FILTER (dst IN ('busy', 'no_answer', 'failed', 'completed')) OVER (PARTITION BY uuid) AS fin FROM r), z AS (SELECT * FROM k WHERE fin IS NULL OR o <= fin),", o="o", src="z"), "call_events")(
    lambda s, d: C.lifecycle(V.call_events(s, d), known_calls(s, d), strict=True).drop("ended_at")
)
query("t1b_ticket_updates", f"SELECT CAST(uuid AS BIGINT) % 40 AS ticket_id, 3 AS company_id, arg_max(ticket_status, last) AS status FROM (SELECT l.uuid, l.ticket_status, (e.ts, l.uuid) AS last FROM (SELECT uuid, ticket_status, last_end FROM ({V.with_views(_FOLD.format(keep='', o='seq', src='e').replace('duration_seconds, ticket_status, events FROM g', 'ticket_status, last_end FROM g'), 'call_events')}) z WHERE ticket_status IS NOT NULL) l JOIN (SELECT CAST(user_id AS VARCHAR) AS uuid, event_id AS seq, ts FROM events) e ON e.uuid = l.uuid AND e.seq = l.last_end) GROUP BY 1, 2")(lambda s, d: C.ticket_updates(C.lifecycle(V.call_events(s, d), known_calls(s, d)), known_calls(s, d)))
query("t4_speech_action", """SELECT event_id, CASE WHEN event_id % 7 = 0 OR value / 100 < 0.5 THEN CASE WHEN event_id % 2 + 1 < 2 THEN 'repeat' ELSE 'unclear' END
    WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 3 = 1 THEN 'not_resolved' WHEN event_id % 2 + 1 < 2 THEN 'redirect' ELSE 'unclear' END AS action FROM events""")(
    lambda s, d: V.table(s, d, "events").select(
        "event_id",
        C.speech_action((F.col("event_id") % 2 + 1), F.when(F.col("event_id") % 7 == 0, "").otherwise("yes"), F.col("value") / 100, F.when(F.col("event_id") % 3 == 0, "resolved").when(F.col("event_id") % 3 == 1, "not_resolved").otherwise("unclear")).alias("action"),
    )
)
query("t6_outcome_to_ticket", "SELECT ticket_id, CASE WHEN outcome = 'resolved' THEN 'resolved' WHEN outcome IN ('not_resolved', 'unclear') THEN 'needs_agent' END AS status FROM calls WHERE company_id = 3", "calls")(lambda s, d: scoped(V.calls(s, d), TENANT).select("ticket_id", C.ticket_of_outcome("outcome").alias("status")))
query("t9_memory", """WITH t AS (SELECT user_id, event_id, ts FROM events), l AS (SELECT user_id, max(ts) AS last FROM t GROUP BY 1), m AS (SELECT max(ts) AS now FROM t), a AS (SELECT user_id FROM l, m WHERE date_diff('second', last, now) <= 864000 QUALIFY row_number() OVER (ORDER BY last DESC, CAST(user_id AS VARCHAR)) <= 500)
    SELECT event_id AS seq FROM t JOIN a USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 6""")(
    lambda s, d: C.memory(V.table(s, d, "events").select(F.lit(3).alias("company_id"), F.col("user_id").cast("string").alias("conversation_id"), F.col("event_id").alias("seq"), "ts"), ttl=864_000, now=F.lit(V.table(s, d, "events").agg(F.max("ts")).first()[0])).select("seq")
)


def memory_stream(s, d) -> DataFrame:
    """The turns that conversations (users) hold when the stream has read all events: six each, if the last is six hours old at most as the watermark goes."""
    turns = V.streamed(s, d, "events").select(F.lit(3).alias("company_id"), F.col("user_id").cast("string").alias("conversation_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("question"), F.lit("").alias("answer"))
    rows = keyed.written(keyed.memory_stream(turns, ttl=21_600, late="10 minutes"), "update", fresh_folder(s, "memory"))
    last = rows.groupBy("company_id", "conversation_id").agg(F.max_by(F.struct("forgotten", "turns"), F.struct("batch", ~F.col("forgotten"))).alias("now"))
    return last.where("NOT now.forgotten").select("conversation_id", F.explode("now.turns.seq").alias("seq"))


query("t9_memory_stream", """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
    SELECT CAST(user_id AS VARCHAR) AS conversation_id, event_id AS seq FROM events JOIN l USING (user_id), m WHERE epoch_ms(last) + 21600000 > epoch_ms(now) - 600000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 6""")(memory_stream)


def ticket_stream(s, d) -> DataFrame:
    """The latest row of each ticket when the stream has read all events."""
    rows = keyed.written(keyed.ticket_stream(V.provider_events(V.streamed(s, d, "events")), known_calls(s, d)), "append", fresh_folder(s, "tickets"))
    return rows.groupBy("company_id", "ticket_id").agg(F.max_by("status", "batch").alias("status")).select(F.col("ticket_id"), F.col("company_id").cast("int").alias("company_id"), "status")


query("t1b_ticket_stream", SQL["t1b_ticket_updates"])(ticket_stream)
query("t_windowed_counts", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, {_MAP} AS status, count(*) AS events FROM call_events GROUP BY 1, 2", "call_events")(lambda s, d: C.windowed_counts(V.call_events(s, d)).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
