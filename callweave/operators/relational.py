"""Look-ups, parent joins, listings and session memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tenancy import Tenant, scoped
from ..sources.staging import staged

ACTIVE = ("initiating", "ringing", "in_progress")


def get(df: DataFrame, key: int, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == key).limit(1)


def first_match(df: DataFrame, order: str = "id", **equals) -> DataFrame:
    """The row with the least `order` of those that equal all the values."""
    for name, value in equals.items():
        df = df.where(F.col(name) == value)
    return df.orderBy(order).limit(1)


def active_call(calls: DataFrame, ticket_id: int) -> DataFrame:
    return calls.where((F.col("ticket_id") == ticket_id) & F.col("status").isin(*ACTIVE)).orderBy("id").limit(1)


def agent_queue(tickets: DataFrame, customers: DataFrame, tenant: Tenant, agent: int) -> DataFrame:
    """An agent's pending tickets, oldest first, each with its customer as a struct."""
    own = scoped(tickets, tenant).where((F.col("assigned_agent_id") == agent) & (F.col("status") == "pending_follow_up"))
    return with_customer(own, customers).orderBy("created_at", "id")


def with_customer(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    parent = customers.select(F.col("id").alias("customer_id"), F.struct("id", "full_name", "is_active").alias("customer"))
    return tickets.join(parent, "customer_id", "left")


def visible_ticket(tickets: DataFrame, tenant: Tenant, role: str, user: int, ticket: int) -> DataFrame:
    """An admin sees the company's tickets, an agent their own; for others there is none."""
    own = scoped(tickets, tenant).where(F.col("id") == ticket)
    return own if role == "admin" else own.where(F.col("assigned_agent_id") == user) if role == "agent" else own.limit(0)


def by_role(users: DataFrame, roles: DataFrame, role: str, tenant: Tenant | None = None) -> DataFrame:
    """Users of a role; without a tenant, of all companies (for super admins only)."""
    own = scoped(users, tenant) if tenant else users
    wanted = roles.where(F.col("name") == role).select(F.col("id").alias("role_id"))
    return own.join(wanted, "role_id", "left_semi").orderBy("id")


def ticket_list(tickets: DataFrame, tenant: Tenant) -> DataFrame:
    return scoped(tickets, tenant).orderBy(F.desc("created_at"), F.desc("id"))


def owned_messages(messages: DataFrame, sessions: DataFrame, tenant: Tenant) -> DataFrame:
    """Messages of sessions that belong to the company."""
    own = scoped(sessions, tenant).select(F.col("id").alias("session_id"))
    return messages.join(own, "session_id", "left_semi")


def last_messages(messages: DataFrame, n: int = 8) -> DataFrame:
    late = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return messages.withColumn("back", F.row_number().over(late)).where(F.col("back") <= n).drop("back")


def session_summary(messages: DataFrame, keep: int = 8, most: int = 6000) -> DataFrame:
    """'Role: text' lines of all but the last `keep` messages, in order, their last `most` characters.

    A running length from the end leaves only the lines that the summary can show
    before any are gathered: what is held for a session is bounded by `most` and its longest line.
    """
    late = Window.partitionBy("session_id").orderBy(F.desc("id"))
    old = messages.withColumn("back", F.row_number().over(late)).where(F.col("back") > keep)
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    behind = F.coalesce(F.sum(F.length("line") + 1).over(late.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = old.select("session_id", "id", line.alias("line")).withColumn("behind", behind).where(F.col("behind") <= most)
    lines = shown.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", F.right("line", F.lit(most + 1)).alias("line")))).alias("lines"))
    return lines.select("session_id", F.right(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(most)).alias("summary"))


def titled(sessions: DataFrame, messages: DataFrame, most: int = 80) -> DataFrame:
    """Sessions (id) with a title: the first `most` characters of the first question, or New chat."""
    first = messages.where("role = 'user'").groupBy(F.col("session_id").alias("id")).agg(F.min_by(F.left("content", F.lit(most)), "id").alias("asked"))
    return sessions.join(first, "id", "left").withColumn("title", F.coalesce(F.nullif("asked", F.lit("")), F.lit("New chat"))).drop("asked")


def session_list(sessions: DataFrame, tenant: Tenant) -> DataFrame:
    """A company's sessions with their place, the last used first."""
    return placed(scoped(sessions, tenant), F.desc("updated_at"), F.asc("id"))


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `place`, from 1 in the given order, which tells all rows apart.

    Rows are sorted by ranges and a range's rows are counted, so that no task holds
    more than its range; one number a range is added up.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = staged(sorted_rows.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "placed")
    ranges = kept.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")
    starts = ranges.select("_range", (before - F.col("first") + 1).alias("move"))  # a row a range
    return kept.join(F.broadcast(starts), "_range").withColumn("place", F.col("_at") + F.col("move")).drop("_range", "_at", "move")


def ordered_messages(messages: DataFrame, *order: str) -> DataFrame:
    """Messages with their place in the session, by `order` (time, then id)."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))


def history(messages: DataFrame, n: int = 6) -> DataFrame:
    """'User: text' and 'Assistant: text' lines of the last n messages of each session."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("content", F.lit("")))
    lines = last_messages(messages, n).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"))
    return lines.select("session_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


def section_methods(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """chunks with the extraction_method of their section, no_section where there is none."""
    key = ["document_id", "section_index"]
    known = sections.select(*key, "extraction_method").dropDuplicates(key)
    return chunks.join(known, key, "left").withColumn("extraction_method", F.coalesce("extraction_method", F.lit("no_section")))


def id_union(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def document_listing(chunks: DataFrame) -> DataFrame:
    """Documents with what their first chunk says, and the number of chunks, by source."""
    own = chunks.where(F.col("document_id").isNotNull() & (F.col("document_id") != ""))
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    return own.groupBy("document_id").agg(first("source"), first("language"), F.count("*").alias("chunks")).orderBy("source", "document_id")


def can_start_call(tickets: DataFrame, customers: DataFrame, active: DataFrame, tenant: Tenant, agent: int) -> DataFrame:
    """Tickets that an agent may call about: pending, own, an active customer with a phone, no call under way."""
    own = scoped(tickets, tenant).where((F.col("status") == "pending_follow_up") & (F.col("assigned_agent_id") == agent))
    reachable = customers.where(F.col("is_active") & F.col("phone").isNotNull() & (F.trim("phone") != "")).select(F.col("id").alias("customer_id"))
    busy = active.where(F.col("status").isin(*ACTIVE)).select(F.col("ticket_id").alias("id"))
    return own.join(reachable, "customer_id", "left_semi").join(busy, "id", "left_anti")
