"""Importance resampling against a plain count of n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from callweave.llm import resample
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def _plain(rows, target, buckets=10_000, least=20, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in _features(t)[1])
    t = Counter(bucket(f) for x in target for f in _features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n, own = _features(text)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    best = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(best[: percent * len(best) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


ROWS = [(k, " ".join(f"W{(k * j) % 17} über_{j % 5}" for j in range(k % 60))) for k in range(120)] + [(None, "no id " * 20), (200, None), (201, ""), (202, "\x00.--;"), (203, "x" * 3000 + " " + "é" * 700), (204, "Same text " * 15), (204, "Same text " * 15), (-7, "a b c")]
TARGET = ["w1 über w2 w3", "same TEXT same text", None, ""]


@pytest.mark.parametrize("unit", [resample.UNIT, 2000])
def test_resample_equals_the_plain_count(spark, unit, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit("extra") for c in ("score", "row", "rank", "bucket", "n", "part", "by")})
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    if unit != resample.UNIT:
        monkeypatch.setattr(resample.units, "__defaults__", (unit,))
    got = resample.digest(resample.resample(docs, target, percent=30)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _plain(ROWS, TARGET, percent=30)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).collect() == []
    docs = spark.createDataFrame(ROWS[:30], "doc_id long, text string")
    got = resample.digest(resample.resample(docs, none.select("text"), percent=10)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _plain(ROWS[:30], [], percent=10)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "three")], "doc_id string, text string")
    got = {r["doc_id"]: r["n_features"] for r in resample.resample(docs, docs.select("text")).collect()}
    assert got == {"a": 3, None: 1}


def test_crc_of_joined_strings():
    rng = np.random.default_rng(5)
    parts = [(rng.bytes(int(rng.integers(0, 40))), rng.bytes(int(n))) for n in [0, 1, 2, 7, 8, 255, 256, 257, 5000, 70_000, *rng.integers(0, 300, 100)]]
    crc = np.array([zlib.crc32(a) for a, _ in parts], np.uint32)
    more = np.array([zlib.crc32(b) for _, b in parts], np.uint32)
    got = resample.appended(crc, more, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_packed_strings_come_back():
    texts = [b"A b c a b", b"", b"b c \xc3\xa9 a b", b"a"]
    _, word, each = resample.grams(texts, 3)
    strings, want = None, Counter(f for t in texts for f in _features(t.decode())[1])
    got = Counter()
    for own in each:
        strings = resample.spelled(own, word, strings)
        assert resample.crcs(strings).tolist() == [zlib.crc32(s) for s in strings.to_pylist()]
        rows = list(resample._dealt(strings, own.often, np.arange(len(strings)) % 3, 3, np.arange(len(strings))[::-1]))
        back = resample.merged(pa.Table.from_pylist(rows), step=1)
        got.update({g.decode(): n for g, n in zip(back["gram"].to_pylist(), back["n"].to_pylist(), strict=True)})
    assert got == want
