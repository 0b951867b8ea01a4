"""Keyed streams with their own state: conversation memory, and what live calls do to their tickets.

State lies in the session's state store, which must be one that keeps typed state by
key (`use_state_store`); timers of event time end it, so that it holds what is alive
and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .calls import CLEARS, ENDS, STATUS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams that the session starts from now on keep their state in RocksDB, as typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """`use_state_store` for what is started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    use_state_store(spark)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def written(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a keyed stream over what its source has now and give its rows, with the number of the batch that each came in.

    A batch's rows replace what was written under its number, so that a batch tried
    again counts once; run it again on the same folder to go on with new input.
    """
    spark = stream.sparkSession

    def each(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with state_store(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{folder}/rows")


def _millis(spark_time) -> int:
    return int(pd.Timestamp(spark_time).value // 1_000_000)


class _Alone(StatefulProcessor):
    """State of a key that goes when the watermark passes its end."""

    def renew(self, until: int, held: bool) -> None:
        """held: the key had state, and so a timer; asking the state store costs a call."""
        for old in list(self.handle.listTimers()) if held else ():
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(until)

    def close(self) -> None:
        pass


# --- conversation memory -------------------------------------------------------------------------

TURN = "seq long, ts timestamp, question string, answer string"
MEMORY = "company_id long, conversation_id string, last timestamp, forgotten boolean, turns array<struct<seq:long,ts:timestamp,question:string,answer:string>>"


class _Memory(_Alone):
    def __init__(self, keep: int, ttl: int):
        self.keep, self.ttl = keep, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", TURN)

    def _row(self, key: tuple, turns: list[tuple], last, forgotten: bool) -> pd.DataFrame:
        said = [dict(zip(("seq", "ts", "question", "answer"), t, strict=True)) for t in turns]
        out = pd.DataFrame({"company_id": [int(key[0])], "conversation_id": [key[1]], "last": pd.to_datetime([last]), "forgotten": [forgotten]})
        out["turns"] = [said]
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {t[0]: tuple(t) for t in self.turns.get()}
        timed = bool(held)
        over = held and _millis(max(t[1] for t in held.values())) + self.ttl * 1000 <= now  # its timer goes off behind these rows
        if over:
            yield self._row(key, [], max(t[1] for t in held.values()), True)
            held = {}
        known = len(held)
        for pdf in rows:
            for t in zip(pdf["seq"].tolist(), pdf["ts"].dt.to_pydatetime(), pdf["question"], pdf["answer"], strict=True):
                if _millis(t[1]) >= now:
                    held.setdefault(t[0], t)  # a turn that comes again changes nothing
        if len(held) == known:
            if over:
                self.turns.clear()
            return
        last = max(t[1] for t in held.values())
        kept = [held[k] for k in sorted(held)[-self.keep :]]
        self.turns.put(kept)
        self.renew(max(_millis(last) + self.ttl * 1000, now + 1), timed)
        yield self._row(key, kept, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()]
        self.turns.clear()
        if held:
            yield self._row(key, [], max(t[1] for t in held), True)


def memory_stream(turns: DataFrame, keep: int = 6, ttl: int = 3600, late: str = "10 minutes") -> DataFrame:
    """A row for each conversation that changes in a trigger, in update mode: its last `keep` turns by seq, in order.

    turns: company_id, conversation_id, seq, ts, question, answer.  A turn's place is its
    seq, so that turns may arrive in any order and again; turns without a key, seq or
    ts have no place, and those that lag `late` behind the latest turn of all are
    dropped.  A conversation's state is its kept turns; when the watermark passes its
    last turn by `ttl` seconds the state goes, and a row tells that it is forgotten.
    The number of conversations that a company may have is not cut here, as it
    concerns all keys: `calls.memory` cuts it on the rows written.
    """
    key = ["company_id", "conversation_id"]
    told = turns.where("company_id IS NOT NULL AND conversation_id <> '' AND seq IS NOT NULL AND ts IS NOT NULL")
    told = told.select(F.col("company_id").cast("long").alias("company_id"), "conversation_id", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "question", "answer")
    return told.withWatermark("ts", late).groupBy(*key).transformWithStateInPandas(_Memory(keep, ttl), StructType.fromDDL(MEMORY), "Update", "eventTime")


# --- calls and tickets ---------------------------------------------------------------------------

CALL = "seq long, ended_at timestamp, cleared boolean"
ENDED = "uuid string, seq long, ts timestamp, ended_at timestamp"
TICKET = "company_id long, ticket_id long, status string, ended_at timestamp, uuid string"


class _Ends(_Alone):
    """A call's last end, and whether any of its events put the ticket back."""

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", CALL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = sorted((e for pdf in rows for e in zip(pdf["seq"].tolist(), pdf["status"].tolist(), pdf["ts"].dt.to_pydatetime(), strict=True)), key=lambda e: e[0])
        known, latest = self.call.get(), max(e[2] for e in own)
        seq, ended, cleared = known or (-1, None, False)
        for n, told, ts in own:
            status = STATUS.get(told)
            cleared = bool(cleared or status in CLEARS)
            if status in ENDS and n > seq:
                seq, ended = n, ts
        self.call.update((seq, ended, cleared))
        self.renew(max(_millis(latest) + self.forget, timerValues.getCurrentWatermarkInMs() + 1), known is not None)
        if cleared:
            yield pd.DataFrame({"uuid": [key[0]], "seq": [seq], "ts": pd.to_datetime([latest]), "ended_at": pd.to_datetime([ended])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.call.clear()
        yield from ()


class _Tickets(_Alone):
    """What the ended calls of a ticket say of it: the last one counts."""

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "uuid string", "seq long, ended_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, held = 0, {k[0]: tuple(v) for k, v in self.calls.iterator()}
        timed = bool(held)
        for pdf in rows:
            for uuid, seq, ended, ts in zip(pdf["uuid"], pdf["seq"].tolist(), pdf["ended_at"].dt.to_pydatetime(), pdf["ts"], strict=True):
                latest = max(latest, _millis(ts))
                if uuid not in held or held[uuid][0] <= seq:
                    held[uuid] = (seq, ended)
                    self.calls.updateValue((uuid,), held[uuid])
        ended, uuid = max((v[1], k) for k, v in held.items())
        self.renew(max(latest + self.forget, timerValues.getCurrentWatermarkInMs() + 1), timed)
        yield pd.DataFrame({"company_id": [int(key[0])], "ticket_id": [int(key[1])], "status": ["pending_follow_up"], "ended_at": pd.to_datetime([ended]), "uuid": [uuid]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.calls.clear()
        yield from ()


def ticket_stream(events: DataFrame, calls: DataFrame, late: str = "10 minutes", forget: int = 86_400) -> DataFrame:
    """Ticket updates of live calls: (company_id, ticket_id, status, ended_at, uuid) whenever an ended call changes what its ticket is told.

    Two keyed stages in one query: a call's events (seq, uuid, status, ts) give its last
    end and whether it failed; by the call's ticket (calls: uuid, ticket_id,
    company_id) the last such call counts, as in `calls.ticket_updates`, whose row a
    ticket's latest row here equals.  Events of unknown calls are ignored, those that
    lag `late` are dropped; a call's and a ticket's state goes `forget` seconds after
    its last event.
    """
    told = events.where("uuid IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL").select("uuid", F.col("seq").cast("long").alias("seq"), "status", F.col("ts").cast("timestamp").alias("ts"))
    ended = told.withWatermark("ts", late).groupBy("uuid").transformWithStateInPandas(_Ends(forget * 1000), StructType.fromDDL(ENDED), "Append", "eventTime", eventTimeColumnName="ts")
    own = calls.select("uuid", F.col("ticket_id").cast("long").alias("ticket_id"), F.col("company_id").cast("long").alias("company_id"))
    of_ticket = ended.join(own, "uuid").select("company_id", "ticket_id", "uuid", "seq", "ts", "ended_at")
    return of_ticket.groupBy("company_id", "ticket_id").transformWithStateInPandas(_Tickets(forget * 1000), StructType.fromDDL(TICKET), "Append", "eventTime")
