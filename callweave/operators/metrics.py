"""The 17 metrics, each a declarative plan over tickets and calls of one company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.intent import AnalyticsIntent
from ..plans.tenancy import Tenant, scoped

UNRESOLVED = ("needs_agent", "pending_follow_up")
_CALL_STATE = {
    "total_calls": None, "resolved_calls": ("outcome", "resolved"), "unresolved_calls": ("outcome", "not_resolved"), "unclear_calls": ("outcome", "unclear"),
    "no_answer_calls": ("status", "no_answer"), "failed_calls": ("status", "failed"),
}


def since(period: str, as_of: str) -> Column | None:
    """Inclusive lower bound of a period; there is no upper one."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return {"all_time": None, "this_month": F.date_trunc("MONTH", now).cast("timestamp_ntz"), "last_30_days": now - F.expr("INTERVAL 30 DAYS")}[period]


def windowed(df: DataFrame, tenant: Tenant, period: str, as_of: str) -> DataFrame:
    bound, own = since(period, as_of), scoped(df, tenant)
    return own if bound is None else own.where(F.col("created_at") >= bound)


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("value"))


def _top(df: DataFrame, keys: list[Column | str], order: list[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *order).limit(limit)


def metric(intent: AnalyticsIntent, tenant: Tenant, tickets: DataFrame, calls: DataFrame, as_of: str) -> DataFrame:
    """Rows of the metric.  Scalars are one row, also of nothing; every cut list has a total order."""
    name, n = intent.metric, intent.limit
    t = windowed(tickets, tenant, intent.time_period, as_of)
    c = windowed(calls, tenant, intent.time_period, as_of)
    if name in _CALL_STATE:
        want = _CALL_STATE[name]
        return _count(c.where(F.col(want[0]) == want[1]) if want else c)
    if name == "calls_by_outcome":
        return _top(c, [F.coalesce("outcome", "status").alias("outcome")], ["outcome"], n)
    if name == "common_call_reasons":
        subject = scoped(tickets, tenant).select(F.col("id").alias("ticket_id"), "subject")
        reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.col("subject"))
        return _top(c.select("ticket_id", "reason").join(subject, "ticket_id"), [reason.alias("reason")], ["reason"], n)
    if name == "average_call_duration":
        return c.agg(F.avg("duration_seconds").alias("value"))
    open_ones = F.col("status").isin(*UNRESOLVED)
    if name == "resolved_tickets":
        return _count(t.where("status = 'resolved'"))
    if name == "unresolved_tickets":
        return _count(t.where(open_ones))
    if name == "total_tickets":
        return _count(t)
    if name == "customers_with_unresolved_tickets":
        return t.where(open_ones).agg(F.count_distinct("customer_id").alias("value"))
    if name in ("resolved_ticket_list", "unresolved_ticket_list"):
        picked = t.where(F.col("status") == "resolved" if name.startswith("resolved") else open_ones)
        return _top(picked, ["subject", "status"], ["subject", "status"], n)
    if name == "tickets_needing_agent_call":
        waiting = t.where("status = 'pending_follow_up'")
        first = waiting.select("created_at", "id", "subject").orderBy("created_at", "id").limit(n)
        shown = first.agg(F.count("*").alias("returned"), F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "subject"))), lambda x: F.struct(x["id"].alias("id"), x["subject"].alias("subject"))).alias("tickets"))
        return waiting.agg(F.count("*").alias("total")).crossJoin(shown)  # one row each side
    return _top(t, ["subject"], ["subject"], n)
