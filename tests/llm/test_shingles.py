import random

import corpus_pipeline
from callweave.llm import shingles


def _set(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def _least(rows, at_least=0.8):
    """The least id that links reach, from all pairs."""
    sets, up = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (not x and not y) or (x or y) and len(x & y) >= at_least * len(x | y):
                up[find(a)] = find(b)
    out = {}
    for k, (i, _) in enumerate(rows):
        out[find(k)] = min(out.get(find(k), i), i)
    return {i: out[find(k)] for k, (i, _) in enumerate(rows)}


def _edited(words, changes, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def _planted():
    rng, rows = random.Random(3), []
    for size, changes in [(200, 1), (200, 2), (200, 4), (1000, 20), (60, 1), (200, 8), (40, 3)] * 6:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows += [(0, " ".join(base)), (0, _edited(base, changes, rng))]
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows += [(0, _edited(base, rng.randrange(1, 6), rng)) for _ in range(60)]  # a cloud about one text
    rows += [(0, t) for t in ("", "  ", "one two", "ONE  two", "one two three")]
    rng.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows, 1)]


def test_near_copies_equal_all_pairs(spark):
    rows = _planted()
    got = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _least(rows)


def test_stage_drops_planted_near_copies(spark):
    rows = _planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.distinct_near(spark, docs, "").collect()}
    assert kept == {i for i, least in _least(rows).items() if i == least}


def test_large_groups_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(shingles, "ASKERS", 4)
    rows = _planted()
    got = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _least(rows)


def test_null_and_repeated_ids(spark):
    long = [f"w{k}" for k in range(100)]
    near, far = " ".join(long[:-1] + ["x"]), "another text by the same id"
    rows = [(None, "a b"), (None, "A b"), (7, far), (7, "c d"), (8, "c d"), (9, "e f"), (9, "e f"), (None, "e f"), (1, " ".join(long)), (2, near), (2, "g h"), (None, near), (None, "i j"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.distinct_texts(spark, docs, "")
    rest = [(7, far), (8, "c d"), (9, "e f"), (1, " ".join(long)), (2, near), (2, "g h"), (None, "i j"), (5, None)]
    key = lambda r: (r[0] or 0, r[1] or "")
    kept = sorted(map(tuple, got.collect()), key=key)
    assert [(i, t.lower() if t else t) for i, t in kept] == sorted([*rest, (None, "a b")], key=key)
    near_of_all = [(i, t.lower() if t else t) for i, t in corpus_pipeline.distinct_near(spark, docs, "").collect()]
    expected = [(None, "a b"), (7, far), (7, "c d"), (9, "e f"), (1, " ".join(long)), (2, "g h"), (None, "i j"), (5, None)]
    assert sorted(near_of_all, key=key) == sorted(expected, key=key)
