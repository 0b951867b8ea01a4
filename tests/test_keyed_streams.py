"""Conversation memory and ticket updates as streams: in any order of arrival they end with the batch rows."""

import random
from datetime import datetime, timedelta

import pytest
from callweave.streaming import calls as C
from callweave.streaming import keyed
from pyspark.sql import functions as F

T0 = datetime(2001, 8, 1)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    keyed.use_state_store(spark)
    yield
    spark.conf.set(key, before)


def _files(spark, folder, batches, schema):
    """A file for each trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"{k:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def _run(stream, mode, tmp_path):
    rows = []

    def each(df, number):
        rows.extend((number, r) for r in df.collect())

    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(300)
    finally:
        q.stop()
    return rows


TURNS = "company_id long, conversation_id string, seq long, ts timestamp, question string, answer string"


@pytest.mark.parametrize("seed", [1, 2])
def test_memory_equals_the_batch(spark, tmp_path, store, seed):
    rng = random.Random(seed)
    turns = [(c % 2, f"k{c}", n, T0 + timedelta(seconds=100 * n + 7 * c), f"q{c}.{n}", f"a{n}") for c in range(5) for n in range(1 + 3 * c)]
    rows = turns + rng.sample(turns, 8) + [(None, "k1", 3, T0, "no company", ""), (1, "", 4, T0, "no id", ""), (1, "k9", None, T0, "no place", "")]
    rng.shuffle(rows)
    batches = [rows[k::4] for k in range(4)]
    got = _run(keyed.memory_stream(_files(spark, tmp_path / "in", batches, TURNS), ttl=7200, late="2 hours"), "update", tmp_path)
    latest = {}
    for _, r in got:
        latest[r["company_id"], r["conversation_id"]] = r
    batch = C.memory(spark.createDataFrame(turns + turns[:5], TURNS), ttl=10**9, now=F.lit(T0)).collect()
    want = {}
    for r in sorted(batch, key=lambda r: r["seq"]):
        want.setdefault((r["company_id"], r["conversation_id"]), []).append((r["seq"], r["question"]))
    assert {k: [(t["seq"], t["question"]) for t in r["turns"]] for k, r in latest.items()} == want
    assert not any(r["forgotten"] for r in latest.values())


def test_memory_goes_after_its_time(spark, tmp_path, store):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(1, "old", 1, at(0), "first", ""), (1, "old", 2, at(60), "second", "")],
        [(1, "new", 1, at(5000), "later", "")],  # the watermark passes old's hour
        [(1, "old", 3, at(10), "too late", ""), (1, "new", 2, at(5100), "more", "")],
        [(1, "old", 9, at(5200), "again", "")],
        [(1, "new", 3, at(5300), "end", "")],
    ]
    got = _run(keyed.memory_stream(_files(spark, tmp_path / "in", batches, TURNS), ttl=3600, late="1 minute"), "update", tmp_path)
    of = [[(t["question"]) for t in r["turns"]] if not r["forgotten"] else "gone" for _, r in got if r["conversation_id"] == "old"]
    assert of == [["first", "second"], "gone", ["again"]]
    assert [[t["question"] for t in r["turns"]] for _, r in got if r["conversation_id"] == "new"][-1] == ["later", "more", "end"]


EVENTS = "seq long, uuid string, status string, duration string, ts timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_tickets_equal_the_batch(spark, tmp_path, store, seed):
    rng = random.Random(seed)
    status = [*C.STATUS, "machine", None]
    events = [(n, f"u{rng.randrange(14)}", rng.choice(status), None, T0 + timedelta(seconds=rng.randrange(3000))) for n in range(160)]
    events += [(500, None, "failed", None, T0), (501, "stranger", "failed", None, T0)]
    calls = spark.createDataFrame([(f"u{k}", T0, None, k % 5, k % 2) for k in range(14)], "uuid string, started_at timestamp, outcome string, ticket_id long, company_id long")
    cut = sorted(rng.sample(range(160), 3))
    batches = [events[a:b] for a, b in zip([0, *cut], [*cut, len(events)], strict=True)]
    for b in batches:
        rng.shuffle(b)
    got = _run(keyed.ticket_stream(_files(spark, tmp_path / "in", batches, EVENTS), calls, late="2 hours"), "append", tmp_path)
    latest = {(r["company_id"], r["ticket_id"]): r["status"] for _, r in got}
    ends = {(r["company_id"], r["ticket_id"]): (r["ended_at"], r["uuid"]) for _, r in got}
    states = C.lifecycle(spark.createDataFrame(events, EVENTS), calls)
    batch = C.ticket_updates(states, calls).collect()
    assert latest == {(r["company_id"], r["ticket_id"]): r["status"] for r in batch} and batch
    last = {}
    for r in states.where("ticket_status IS NOT NULL").join(calls.select("uuid", "ticket_id", "company_id"), "uuid").collect():
        k = (r["company_id"], r["ticket_id"])
        last[k] = max(last.get(k, (r["ended_at"], r["uuid"])), (r["ended_at"], r["uuid"]))
    assert ends == last
