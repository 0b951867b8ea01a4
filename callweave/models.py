"""Interfaces of what a model answers, offline stand-ins, and the loop that rewrites questions."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .functions import text as X
from .sources.staging import staged

OUTCOMES = ("resolved", "not_resolved", "unclear")
INSUFFICIENT = "INSUFFICIENT_CONTEXT"


class ReplyClassifier(Protocol):
    def classify(self, text: str) -> str: ...


class LexiconClassifier:
    """Offline: words of denial before words of assent; the English ones end where ASCII words do, as in SQL."""

    NO = re.compile(r"(?a:\b)(no|not|still|isn't|doesn't|never)(?a:\b)|لا|لسه|مش", re.I)
    YES = re.compile(r"(?a:\b)(yes|yeah|solved|fixed|resolved|works|thanks)(?a:\b)|نعم|ايوه|تمام|اتحلت", re.I)

    def classify(self, text: str) -> str:
        return "not_resolved" if self.NO.search(text) else "resolved" if self.YES.search(text) else "unclear"


def outcome_of(text: Column, classifier: ReplyClassifier) -> Column:
    """A reply's outcome; blank ones and failures are unclear."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            try:
                said = classifier.classify(t) if t and t.strip() else "unclear"
            except Exception:
                return "unclear"
            return said if said in OUTCOMES else "unclear"

        return texts.map(one)

    return run(text)


class Generator(Protocol):
    def generate(self, question: str, context: str) -> str: ...


class EchoGenerator:
    """Offline: the first line of the first passage, cited."""

    def generate(self, question: str, context: str) -> str:
        body = context.split("\n")
        return f"{body[1][:200]} [1]" if len(body) > 1 else INSUFFICIENT


# The answers where nothing was found.
NOTHING = {"ar": "لا تتوفر معلومات كافية للإجابة.", "en": "There is not enough information to answer."}


def answers(packed: DataFrame, generator: Generator) -> DataFrame:
    """(query_id, answer, sufficient) for questions with their packed context (query_id, question, language, context)."""

    @pandas_udf("string")
    def run(question: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([generator.generate(q, c) if c else "" for q, c in zip(question, context, strict=True)])

    nothing = F.when(F.col("language") == "ar", NOTHING["ar"]).otherwise(NOTHING["en"])
    said = packed.withColumn("said", run("question", F.coalesce("context", F.lit(""))))
    enough = (F.coalesce("context", F.lit("")) != "") & ~F.contains("said", F.lit(INSUFFICIENT))
    return said.select("query_id", F.when(enough, F.col("said")).otherwise(nothing).alias("answer"), enough.alias("sufficient"))


def search_reply(body: Column) -> Column:
    """A search workflow's JSON reply as struct (answer, sources); NULL if it is neither object nor list.

    The answer is the first key present of answer, response, text, output; sources
    are those of sources, else results, as JSON objects (a bare value becomes a title).
    """
    is_list = body.rlike(r"^\s*\[")
    reply = F.from_json(body, "map<string,string>")
    answer, sources = F.lit(""), F.when(is_list, body)
    for k in ("output", "text", "response", "answer"):
        answer = F.when(F.map_contains_key(reply, k), reply[k]).otherwise(answer)
    for k in ("results", "sources"):
        sources = F.when(F.map_contains_key(reply, k), reply[k]).otherwise(sources)
    items = F.coalesce(F.from_json(sources, "array<string>"), F.array().cast("array<string>"))
    objects = F.transform(items, lambda i: F.when(i.startswith("{"), i).otherwise(F.to_json(F.struct(i.alias("title")))))
    good = is_list | body.rlike(r"^\s*\{")
    return F.when(good, F.struct(F.coalesce(answer, F.lit("")).alias("answer"), objects.alias("sources")))


@dataclass(frozen=True)
class Verdict:
    relevant: bool
    confidence: float = 1.0
    reason: str = ""


def parse_verdict(reply: str) -> Verdict:
    """The JSON object in a judge's reply.  Unreadable ones let the context pass; doubtful assent does not."""
    m = re.search(r"\{.*\}", reply or "", re.S)
    try:
        d = json.loads(m[0]) if m else None
        v = Verdict(bool(d["is_relevant"]), float(d.get("confidence", 1.0)), str(d.get("reason", "")))
    except (TypeError, KeyError, ValueError):
        return Verdict(True, 0.0, "unreadable")
    return Verdict(v.relevant and v.confidence >= 0.5, v.confidence, v.reason)


def kept_rewrite(previous: Column, proposed: Column) -> Column:
    """A rewriter's first line without quotes; the question before it where that failed, is shorter than 3 or in no known language."""
    line = F.trim(F.btrim(F.trim(F.regexp_extract(F.trim(F.coalesce(proposed, F.lit(""))), r"^([^\n]*)", 1)), F.lit('"')))
    return X.let(line, lambda x: F.when((F.length(x) >= 3) & (X.language(x) != "unknown"), x).otherwise(previous))


@dataclass
class Paced:
    """A callable to a service at most `per_minute` times a minute in each task; failures are tried again after 1, 2, 4, ... seconds.

    Partitions bound how many tasks call at once: the service's limit divided by
    their number is what one of these gets.
    """

    call: Callable
    per_minute: float = 0
    tries: int = 3
    first_wait: float = 1.0
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.monotonic
    last: float | None = None

    def __call__(self, *args):
        for n in range(self.tries):
            if self.per_minute and self.last is not None:
                self.sleep(max(0.0, self.last + 60 / self.per_minute - self.now()))
            self.last = self.now()
            try:
                return self.call(*args)
            except Exception:
                if n == self.tries - 1:
                    raise
                self.sleep(self.first_wait * 2**n)


def agentic(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """retrieve, judge, then answer, rewrite or give up, for all open questions of a table in each round.

    questions (id, question).  retrieve: (id, query) -> (id, passages); judge: (id,
    question, passages) -> (id, relevant, reason); rewrite: (id, query, reason) ->
    (id, proposed).  Returns the outcomes (id, attempts, sufficient, passages) and
    the trace (id, attempt, query, relevant, reason).  A round's rows are written
    once; no question passes the driver.
    """
    schema = questions.schema["id"].dataType
    asked = questions.select("id", "question", F.col("question").alias("query"))
    done, trace = [], []
    for n in range(1, attempts + 1):
        found = asked.join(retrieve(asked.select("id", "query")), "id", "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))
        some = found.where(F.size("passages") > 0)
        said = some.select("id").join(judge(some.select("id", "question", "passages")), "id", "left")
        judged = found.join(said, "id", "left").withColumns({"relevant": F.coalesce("relevant", F.size("passages") > 0), "reason": F.when(F.size("passages") == 0, "nothing found").otherwise(F.coalesce("reason", F.lit("")))})
        judged = staged(judged, "agentic-round")
        trace.append(judged.select("id", F.lit(n).alias("attempt"), "query", "relevant", "reason"))
        over = F.col("relevant") if n < attempts else F.lit(True)
        done.append(judged.where(over).select(F.col("id").cast(schema).alias("id"), F.lit(n).alias("attempts"), F.col("relevant").alias("sufficient"), F.when(F.col("relevant"), F.col("passages")).otherwise(F.array().cast("array<string>")).alias("passages")))
        if n < attempts:
            left = judged.where("NOT relevant").select("id", "question", "query", "reason")
            asked = left.join(rewrite(left.select("id", "query", "reason")), "id", "left").select("id", "question", kept_rewrite(F.col("query"), F.col("proposed")).alias("query"))
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, trace)
