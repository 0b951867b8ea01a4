"""Call lifecycles, spoken replies and conversation memory: as batch plans and as keyed streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a provider status makes of a call; the two sets say which clear the outcome and which end the call.
STATUS = {
    "started": "initiating", "ringing": "ringing", "answered": "in_progress", "busy": "busy", "unanswered": "no_answer", "timeout": "no_answer",
    "failed": "failed", "rejected": "failed", "cancelled": "failed", "completed": "completed",
}
CLEARS = ("busy", "no_answer", "failed")
ENDS = (*CLEARS, "completed")
#: Spoken replies: attempts a call, and the least confidence.
ATTEMPTS, CONFIDENCE = 2, 0.50


def call_status(status: str | Column) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), c)


def whole_seconds(duration: str | Column) -> Column:
    """int(float(x)), NULL for what is no number."""
    c = F.col(duration) if isinstance(duration, str) else duration
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 1e9), number.cast("int"))


def lifecycle(events: DataFrame, calls: DataFrame, strict: bool = False) -> DataFrame:
    """The state of each known call (uuid, started_at, outcome) after all its events (seq, uuid, status, duration, ts).

    Events are taken as they arrived (seq): a late one rewinds the state, as a
    handler without an ordering guard does.  strict: by event time, and nothing
    counts after the first event that ends the call.  Unknown statuses and calls
    are ignored.  It is one aggregate by call: every field depends on the last,
    or first, event of a kind, so no row is held.
    """
    order = F.struct("ts", "seq") if strict else F.struct("seq")
    e = events.withColumns({"to": call_status("status"), "at": order}).where("to IS NOT NULL").join(calls.select("uuid", "started_at", "outcome"), "uuid")
    ends = F.col("to").isin(*ENDS)
    if strict:
        first_end = F.min(F.when(ends, F.col("at"))).over(Window.partitionBy("uuid"))
        e = e.withColumn("end", first_end).where(F.col("end").isNull() | (F.col("at") <= F.col("end")))
    done = F.col("to") == "completed"
    told = F.when(done, whole_seconds("duration"))
    guess = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("started_at"), F.col("ts")).cast("int"))
    clears = F.col("to").isin(*CLEARS)
    return e.groupBy("uuid").agg(
        F.max_by("to", "at").alias("status"),
        F.when(F.max(clears), None).otherwise(F.first("outcome")).alias("outcome"),
        F.max_by("ts", F.when(ends, F.col("at"))).alias("ended_at"),
        F.coalesce(F.max_by(told, F.when(told.isNotNull(), F.col("at"))), F.min_by(guess, F.when(done & F.col("started_at").isNotNull(), F.col("at")))).alias("duration_seconds"),
        F.when(F.max(clears), "pending_follow_up").alias("ticket_status"),
        F.count("*").alias("events"),
    )


STATE = "status string, cleared boolean, ended_at timestamp, told int, guessed int, events long"
OUT = "uuid string, status string, cleared boolean, ended_at timestamp, duration_seconds int, events long"


def lifecycle_stream(events: DataFrame, calls: DataFrame | None = None, forget: str = "24 hours") -> DataFrame:
    """The same fold as a keyed stream: an updated row for each call and trigger.

    With `calls` (uuid, started_at) unknown calls are ignored, and a completed call
    without a told duration gets the time since it started.  Events count in the
    order they arrive; those that lag `forget` behind the latest event time are
    dropped, and the state of a call goes when its end, or six times `forget` after
    its last event, lags as far.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    number, unit = forget.split()
    open_for = 6 * int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", forget).withColumn("ms", F.unix_millis("ts"))
    known = calls.select("uuid", "started_at") if calls is not None else None
    joined = marked.join(known, "uuid") if known is not None else marked.withColumn("started_at", F.lit(None).cast("timestamp"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, cleared, ended, told, guessed, n = state.get if state.exists else (None, False, None, None, None, 0)
        own = pd.concat(list(batches)).sort_values("seq")
        latest = own["ms"].max()
        own["to"] = own["status"].map(STATUS)
        own = own[own["to"].notna()]
        for to, d, ts, began in zip(own["to"], pd.to_numeric(own["duration"], errors="coerce"), own["ts"], own["started_at"], strict=True):
            status, n, cleared = to, n + 1, cleared or to in CLEARS
            ended = ts.to_pydatetime() if to in ENDS else ended
            if to != "completed":
                continue
            if abs(d) < 1e9:
                told = int(d)
            if guessed is None and not pd.isna(began):
                guessed = max(0, int((ts - began).total_seconds()))
        state.update((status, cleared, ended, told, guessed, n))
        state.setTimeoutTimestamp(int(latest) + (1 if ended else open_for))
        if n:
            seconds = guessed if told is None else told
            yield pd.DataFrame([{"uuid": key[0], "status": status, "cleared": cleared, "ended_at": ended, "duration_seconds": seconds, "events": n}]).astype({"duration_seconds": "Int32", "ended_at": "datetime64[ns]"})

    return joined.groupBy("uuid").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def ticket_updates(states: DataFrame, calls: DataFrame) -> DataFrame:
    """Second key: a ticket takes what the last of its calls says (calls: uuid, ticket_id, company_id)."""
    said = states.where("ticket_status IS NOT NULL").join(calls.select("uuid", "ticket_id", "company_id"), "uuid")
    return said.groupBy("company_id", "ticket_id").agg(F.max_by("ticket_status", F.struct("ended_at", "uuid")).alias("status"))


def best_hypothesis(results: str | Column) -> Column:
    """The first result: stripped text, and its confidence or NULL."""
    first = F.get(F.col(results) if isinstance(results, str) else results, F.lit(0))
    return F.struct(F.coalesce(F.trim(first["text"]), F.lit("")).alias("text"), first["confidence"].try_cast("double").alias("confidence"))


def speech_action(attempt: str | Column, text: str | Column, confidence: str | Column, label: str | Column) -> Column:
    """What follows a reply: repeat, redirect, or a final outcome."""
    a, t, c, k = (F.col(x) if isinstance(x, str) else x for x in (attempt, text, confidence, label))
    unheard = (F.coalesce(t, F.lit("")) == "") | (c < CONFIDENCE)
    again = a < ATTEMPTS
    return F.when(unheard, F.when(again, "repeat").otherwise("unclear")).when(k.isin("resolved", "not_resolved"), k).otherwise(F.when(again, "redirect").otherwise("unclear"))


def ticket_of_outcome(outcome: str | Column) -> Column:
    c = F.col(outcome) if isinstance(outcome, str) else outcome
    return F.when(c == "resolved", "resolved").when(c.isin("not_resolved", "unclear"), "needs_agent")


# What a result set by hand makes of the call and its ticket: call status, outcome, ticket status.
BY_HAND = {
    "resolved": ("completed", "resolved", "resolved"), "not_resolved": ("completed", "not_resolved", "needs_agent"), "unclear": ("completed", "unclear", "needs_agent"),
    "no_answer": ("no_answer", None, "pending_follow_up"), "failed": ("failed", None, "pending_follow_up"),
}
FINAL = ("completed", "no_answer", "failed")


def set_by_hand(status: Column, result: Column, started_at: Column, now: Column) -> Column:
    """Struct of what a result set by hand leaves: rejected, status, outcome, ticket_status, duration_seconds.

    A call that is completed, no_answer or failed rejects it (a busy one does not),
    and so does an unknown result; the duration may be negative, as it is not clamped.
    """
    table = F.create_map(*[x for k, v in BY_HAND.items() for x in (F.lit(k), F.struct(*[F.lit(p).cast("string").alias(n) for p, n in zip(v, ("status", "outcome", "ticket_status"), strict=True)]))])
    made = F.try_element_at(table, result)
    rejected = F.coalesce(status.isin(*FINAL), F.lit(False)) | made.isNull()
    took = (F.timestamp_diff("MICROSECOND", started_at, now) / 1_000_000).cast("int")
    own = lambda c: F.when(~rejected, c)
    return F.struct(rejected.alias("rejected"), own(made["status"]).alias("status"), own(made["outcome"]).alias("outcome"), own(made["ticket_status"]).alias("ticket_status"), own(took).alias("duration_seconds"))


def transcript(turns: DataFrame) -> DataFrame:
    """'Attempt n: text' lines of each call by arrival (uuid, seq, attempt, text); empty texts are left out."""
    line = F.concat(F.lit("Attempt "), F.col("attempt").cast("string"), F.lit(": "), F.col("text"))
    return turns.where("text <> ''").groupBy("uuid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def memory(turns: DataFrame, keep: int = 6, ttl: int = 3600, now: Column | None = None, most: int = 500) -> DataFrame:
    """The last turns of each conversation (company_id, conversation_id, seq, ts, ...) that is not too old.

    A conversation whose last turn is older than ttl seconds is forgotten; of a
    company's others the `most` latest stay.  A turn that comes again, by its seq,
    counts once.  `keyed.memory_stream` is the stream form.
    """
    key = ["company_id", "conversation_id"]
    turns = turns.dropDuplicates([*key, "seq"])
    now = F.current_timestamp() if now is None else now
    last = turns.groupBy(*key).agg(F.max("ts").alias("last")).where(F.timestamp_diff("SECOND", F.col("last"), now) <= ttl)
    recent = last.withColumn("n", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("last"), "conversation_id"))).where(F.col("n") <= most)
    back = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))
    return turns.withColumn("back", back).where(F.col("back") <= keep).drop("back").join(recent.select(*key), key, "left_semi")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each status by window of event time, each event once; on a stream late ones are dropped by the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])
    else:
        e = e.dropDuplicates(["seq"])
    return e.groupBy(F.window("ts", width), call_status("status").alias("status")).agg(F.count("*").alias("events"))
