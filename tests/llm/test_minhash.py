"""SuperMinHash near-duplicates against all pairs; what large and templated groups cost."""

import random

import numpy as np
import pytest
from callweave.llm import minhash, setlinks, shingles, superminhash
from pyspark.sql import functions as F


def _set(text, n=4):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def _plain(rows):
    sets, up = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        ids = [x for x in (least.get(find(k)), i) if x is not None]
        least[find(k)] = min(ids) if ids else None
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)] if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def _edited(words, changes, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def _planted():
    rng, rows = random.Random(11), []
    for size, changes in [(200, 1), (200, 3), (200, 5), (1000, 22), (60, 1), (40, 2), (5, 1), (30, 1)] * 5:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows += [" ".join(base), _edited(base, changes, rng)]
    for size, changes in [(300, 6), (120, 3)]:  # clouds: many pairs over and under the bound
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows += [_edited(base, rng.randrange(1, changes + 1), rng) for _ in range(50)]
    rows += ["", "  ", None, "one two", "ONE  two", "one two three", "a b c d", "a b c d", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("askers", [1024, 4])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, askers):
    monkeypatch.setattr(setlinks, "ASKERS", askers)
    monkeypatch.setattr(shingles, "ASKERS", askers)
    rows = _planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("extra") for c in ("of", "sig", "size", "node", "bands", "row", "root")})
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == _plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(4000))
    rows = [(None, "a b c d e"), (3, "A b c d e"), (None, "only null"), (4, None), (4, ""), (5, long), (6, long + " x"), (5, long), (None, None), (2**62, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str) == _plain(rows)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def _templated(n, shared, own, seed=4):
    """Texts of one template: shared shingles and own ones, none similar enough."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(shared)]
    return [(k, " ".join(base + [f"o{rng.randrange(10**9)}" for _ in range(own)])) for k in range(n)]


def test_pairs_of_a_template_grow_with_its_texts(spark, monkeypatch):
    asked = []
    plain = setlinks.similar
    monkeypatch.setattr(setlinks, "similar", lambda pairs, sets, t: (asked.append(pairs.count()), plain(pairs, sets, t))[1])
    counts = []
    for n in (250, 1000):
        asked.clear()
        docs = spark.createDataFrame(_templated(n, 160, 40), "doc_id long, text string")  # similarity 0.67
        found = minhash.near_duplicates(docs).collect()
        assert all(r["kept"] for r in found)
        counts.append(sum(asked))
    print("pairs compared", counts)
    assert counts[1] <= 6 * counts[0] and counts[1] < 1000 * 999 / 2 / 20


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(8)
    sets = []
    for k in range(120):
        base = rng.sample(range(400), 40) if k % 3 == 0 else base
        own = set(base)
        for _ in range(rng.randrange(6)):
            own.discard(rng.choice(sorted(own)))
            own.add(rng.randrange(10**6))
        sets.append(sorted(own))
    table = spark.createDataFrame(list(enumerate(sets)), "node long, items array<long>")
    labels = spark.createDataFrame([(k, k) for k in range(len(sets))], "node long, label long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in setlinks.prefix_pairs(table, labels, 0.8).collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = set(sets[a]), set(sets[b])
            assert len(x & y) * 10 < 8 * len(x | y) or (a, b) in got


def test_signatures():
    rng = np.random.default_rng(1)
    plain, other = [], []
    for _ in range(60):
        both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (80, 20, 20))
        got = np.concatenate([both, one, both, two, np.zeros(0, np.uint64)])
        held = superminhash.signatures(got, np.array([0, 100, 200, 200]))
        assert (held == superminhash.signatures(got, np.array([0, 100, 200, 200]), block=37)).all()
        assert (held[2] == np.iinfo(np.uint64).max).all()
        plain.append(superminhash.estimate(held[0], held[1]))
        x = np.random.default_rng(int(both[0])).random((128, 120)).argmin(axis=1)
        other.append((x < 80).mean())
    assert abs(np.mean(plain) - 80 / 120) < 0.02
    assert np.std(plain) < np.std(other)  # correlated ranks spread less than independent minima
    one = superminhash.signatures(np.array([9], np.uint64), np.array([0, 1]))[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(128))  # one permutation of all positions


def test_union_find():
    groups = setlinks.UnionFind()
    for a, b in [(5, 3), (9, 8), (3, 9), (1, 7)]:
        groups.join(a, b)
    assert [groups.find(k) for k in (5, 9, 8, 3, 7, 4)] == [3, 3, 3, 3, 1, 4]
