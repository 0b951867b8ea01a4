"""The support domain as views over the warehouse tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed moment that time windows are counted from.
AS_OF = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("company_id"), F.col("c_name").alias("full_name"), (F.col("c_acctbal") >= 0).alias("is_active"))


def users(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("company_id"), F.col("s_name").alias("full_name"), (F.col("s_suppkey") % 3).cast("int").alias("role_id"), (F.col("s_acctbal") >= 0).alias("is_active"))


def roles(spark, d) -> DataFrame:
    return spark.createDataFrame([(0, "super_admin"), (1, "admin"), (2, "agent")], "id int, name string")


def tickets(spark, d) -> DataFrame:
    owner = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "needs_agent").otherwise("pending_follow_up")
    return table(spark, d, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("company_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_orderkey") % 10).alias("assigned_agent_id"), F.col("o_orderpriority").alias("subject"), status.alias("status"), F.col("o_orderdate").alias("created_at")
    )


def calls(spark, d) -> DataFrame:
    kind = F.concat("l_returnflag", "l_linestatus")
    status = F.when(kind.isin("AF", "AO", "NF"), "completed").when(kind == "NO", "no_answer").when(kind == "RF", "failed").otherwise("busy")
    outcome = F.when(kind == "AF", "resolved").when(kind == "AO", "not_resolved").when(kind == "NF", "unclear")
    reason = F.when(F.col("l_linenumber") % 3 == 1, "  ").when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit(" reason "), F.col("l_linenumber").cast("string"), F.lit(" ")))
    own = tickets(spark, d).select(F.col("id").alias("ticket_id"), "company_id", "customer_id")
    return table(spark, d, "lineitem").join(own, F.col("l_orderkey") == F.col("ticket_id")).select(
        "company_id", "ticket_id", "customer_id", status.alias("status"), outcome.alias("outcome"), F.when(status == "completed", F.col("l_quantity").cast("int")).alias("duration_seconds"), reason.alias("reason"), F.col("l_shipdate").alias("created_at")
    )


def chunks(spark, d) -> DataFrame:
    """One chunk a document; twenty make what stands for a file, several of which share a section on purpose."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ordinal"), F.lit(3).alias("company_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20).cast("string")).alias("document_id"),
        (F.col("doc_id") % 7).cast("int").alias("section_index"), F.col("lang").alias("language"), "source", "text",
    )


def vectors(spark, d) -> DataFrame:
    """The vectors that chunks have."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"), "label")


def with_vectors(spark, d) -> DataFrame:
    """All chunks, with their vector and label where they have one."""
    return chunks(spark, d).join(vectors(spark, d), "ordinal", "left")


def messages(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


# Event types stand for provider statuses.
EVENT_STATUS = ("started", "ringing", "answered", "busy", "unanswered", "timeout", "failed", "rejected", "cancelled", "completed", "machine")


def call_events(spark, d) -> DataFrame:
    """Provider events: a call is a user, its statuses go round by event id."""
    return provider_events(table(spark, d, "events"))


def provider_events(events: DataFrame) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(s) for s in EVENT_STATUS]), (F.col("event_id") % len(EVENT_STATUS)).cast("int") + 1)
    duration = F.when(F.col("event_id") % 4 == 0, "n/a").when(F.col("event_id") % 4 != 1, F.col("value").cast("string"))
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("uuid"), pick.alias("status"), duration.alias("duration"), "ts")


def streamed(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


SQL = {
    "tickets": """tickets AS (SELECT o_orderkey AS id, c_nationkey AS company_id, o_custkey AS customer_id, o_orderkey % 10 AS assigned_agent_id,
        o_orderpriority AS subject, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'needs_agent' ELSE 'pending_follow_up' END AS status,
        o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "calls": """calls AS (SELECT t.company_id, t.id AS ticket_id, t.customer_id,
        CASE WHEN l_returnflag || l_linestatus IN ('AF','AO','NF') THEN 'completed' WHEN l_returnflag || l_linestatus = 'NO' THEN 'no_answer'
             WHEN l_returnflag || l_linestatus = 'RF' THEN 'failed' ELSE 'busy' END AS status,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'resolved' WHEN 'AO' THEN 'not_resolved' WHEN 'NF' THEN 'unclear' END AS outcome,
        CASE WHEN l_returnflag || l_linestatus IN ('AF','AO','NF') THEN CAST(trunc(l_quantity) AS INT) END AS duration_seconds,
        CASE l_linenumber % 3 WHEN 1 THEN '  ' WHEN 2 THEN ' reason ' || l_linenumber || ' ' END AS reason, l_shipdate AS created_at
        FROM lineitem JOIN tickets t ON l_orderkey = t.id)""",
    "customers": "customers AS (SELECT c_custkey AS id, c_nationkey AS company_id, c_name AS full_name, c_acctbal >= 0 AS is_active FROM customer)",
    "users": "users AS (SELECT s_suppkey AS id, s_nationkey AS company_id, s_name AS full_name, CAST(s_suppkey % 3 AS INT) AS role_id, s_acctbal >= 0 AS is_active FROM supplier)",
    "roles": "roles AS (SELECT * FROM (VALUES (0, 'super_admin'), (1, 'admin'), (2, 'agent')) v(id, name))",
    "chunks": """chunks AS (SELECT doc_id AS ordinal, 'c' || doc_id AS chunk_id, 'd' || (doc_id // 20) AS document_id, CAST(doc_id % 7 AS INT) AS section_index,
        lang AS language, source, text FROM documents)""",
    "corpus": "corpus AS (SELECT chunks.*, embedding AS vector, label FROM chunks LEFT JOIN embeddings ON ordinal = vec_id)",
    "questions": "questions AS (SELECT item_id AS query_id, text, embedding AS qvec, label AS wanted FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)",
    "messages": "messages AS (SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations)",
    "call_events": "call_events AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS uuid, (["
    + ", ".join(f"'{s}'" for s in EVENT_STATUS)
    + f"])[CAST(event_id % {len(EVENT_STATUS)} AS INT) + 1] AS status, CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(value AS VARCHAR) END AS duration, ts FROM events)",
}
_NEEDS = {"calls": ["tickets"], "corpus": ["chunks"]}


def with_views(body: str, *names: str) -> str:
    """body after the views it names and those they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    head = "WITH " + ",\n".join(SQL[n] for n in order)
    return f"{head}, {body[5:]}" if body.startswith("WITH ") else f"{head}\n{body}"
