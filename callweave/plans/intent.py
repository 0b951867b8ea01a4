"""The analytics plan record, and how questions become one."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as X

# The metric catalogue and the time windows.
METRICS = (
    "resolved_tickets", "unresolved_tickets", "total_tickets", "customers_with_unresolved_tickets", "resolved_ticket_list",
    "unresolved_ticket_list", "tickets_needing_agent_call", "top_issues", "total_calls", "resolved_calls", "unresolved_calls",
    "unclear_calls", "no_answer_calls", "failed_calls", "calls_by_outcome", "common_call_reasons", "average_call_duration",
)
PERIODS = ("all_time", "this_month", "last_30_days")

# Phrases of a follow-up question. They are compared as written with the folded question.
WHICH = ("ايه هما", "ايه هي", "ما هي", "ما هم", "اذكرهم", "هاتهم", "what are they", "what were they", "which ones", "list them", "show them")
ALL_OF_THEM = ("دول كلهم", "دول كلهم ولا لا", "دول كلهم ولا لأ", "دي كلهم", "كلهم دول", "are these all", "are those all", "is that all", "all of them")


@dataclass(frozen=True)
class AnalyticsIntent:
    metric: str
    time_period: str = "all_time"
    limit: int = 10

    def __post_init__(self) -> None:
        if self.metric not in METRICS or self.time_period not in PERIODS:
            raise ValueError(f"no such metric or period: {self.metric}, {self.time_period}")
        if not 1 <= self.limit <= 20:
            raise ValueError("limit is from 1 to 20")


def fold_phrase(text: str) -> str:
    """Lower case without marks and with alef and ya forms folded; ta marbuta stays."""
    out = re.sub("[ً-ٰٟـ]", "", unicodedata.normalize("NFKC", text).strip().lower())
    return out.translate(str.maketrans("أإآى", "اااي"))


#: What a follow-up asks for next, by the group of the metric before it and the kind of question.
NEXT = {
    ("open", "which"): "unresolved_ticket_list", ("open", "all"): "tickets_needing_agent_call",
    ("closed", "which"): "resolved_ticket_list", ("closed", "all"): "resolved_ticket_list",
    ("calls to make", "which"): "tickets_needing_agent_call", ("calls to make", "all"): "tickets_needing_agent_call",
}
GROUP = {
    "unresolved_tickets": "open", "unresolved_ticket_list": "open", "resolved_tickets": "closed", "resolved_ticket_list": "closed",
    "tickets_needing_agent_call": "calls to make",
}


def asked_kind(question: str) -> str | None:
    """Whether a question asks if that was all, or which ones they are; None for other questions."""
    said = fold_phrase(question)
    kinds = {"all": ALL_OF_THEM, "which": WHICH}
    return next((k for k, phrases in kinds.items() if any(p in said for p in phrases)), None)


def follow_up(question: str, metric: str | None, period: str | None) -> AnalyticsIntent | None:
    """The plan of a short question about the answer before it, if it is one."""
    after = NEXT.get((GROUP.get(metric), asked_kind(question)))
    return AnalyticsIntent(after, period or "all_time", 20) if after else None


def follow_ups(turns: DataFrame) -> DataFrame:
    """turns (question, metric: that of the answer before) with `next`, the metric asked for, by a join with the rules as tables.

    Questions are compared after `nfkc`; the tables are the constants above, so they are broadcast.
    """
    spark = turns.sparkSession
    said = X.fold_phrase(X.nfkc("question"))
    has = lambda phrases: reduce(or_, [F.col("_said").contains(p) for p in phrases])
    groups = spark.createDataFrame(list(GROUP.items()), "metric string, _group string")
    rules = spark.createDataFrame([(*k, v) for k, v in NEXT.items()], "_group string, _kind string, next string")
    kind = F.when(has(ALL_OF_THEM), "all").when(has(WHICH), "which")
    return turns.withColumn("_said", said).withColumn("_kind", kind).join(F.broadcast(groups), "metric", "left").join(F.broadcast(rules), ["_group", "_kind"], "left").select(*turns.columns, "next")


class IntentParser(Protocol):
    def parse(self, question: str, history: str = "") -> AnalyticsIntent: ...


class RuleParser:
    """Offline parser: key words, the most specific first."""

    RULES = (
        (r"reason", "common_call_reasons"), (r"outcome", "calls_by_outcome"), (r"average|duration", "average_call_duration"), (r"no.?answer", "no_answer_calls"),
        (r"failed", "failed_calls"), (r"unclear", "unclear_calls"), (r"unresolved.*call|call.*not resolved", "unresolved_calls"), (r"resolved.*calls?", "resolved_calls"),
        (r"agent call|need.*call", "tickets_needing_agent_call"), (r"calls?\b", "total_calls"), (r"customers.*unresolved", "customers_with_unresolved_tickets"),
        (r"list.*unresolved|unresolved.*list", "unresolved_ticket_list"), (r"list.*resolved|resolved.*list", "resolved_ticket_list"), (r"unresolved", "unresolved_tickets"),
        (r"resolved", "resolved_tickets"), (r"how many|total", "total_tickets"),
    )

    def parse(self, question: str, history: str = "") -> AnalyticsIntent:
        asked = fold_phrase(question)
        metric = next((m for rx, m in self.RULES if re.search(rx, asked)), "top_issues")
        period = "this_month" if "this month" in asked else "last_30_days" if re.search(r"30 days|last month", asked) else "all_time"
        n = re.search(r"top (\d+)", asked)
        return AnalyticsIntent(metric, period, min(20, max(1, int(n[1]))) if n else 10)


def parsed(turns: DataFrame, parser: IntentParser) -> DataFrame:
    """turns (question) with `intent`, a struct (metric, period, n); the parser is called in the tasks, batch by batch."""

    @pandas_udf("metric string, period string, n int")
    def run(questions: pd.Series) -> pd.DataFrame:
        plans = [parser.parse(q or "") for q in questions]
        return pd.DataFrame({"metric": [i.metric for i in plans], "period": [i.time_period for i in plans], "n": [i.limit for i in plans]})

    return turns.withColumn("intent", run("question"))


def verbalise(intent: AnalyticsIntent, rows: list[dict]) -> str:
    """Offline answer: a template over the rows."""
    name = intent.metric.replace("_", " ")
    if len(rows) == 1 and "value" in rows[0]:
        return f"{name}: {rows[0]['value']}"
    return f"{name}: " + ("; ".join(", ".join(f"{v}" for v in r.values()) for r in rows) or "nothing found")
