"""The Merkle manifest against a plain fold over sorted rows, level by level."""

import hashlib
import zlib

import pytest
from callweave.llm import merkle, queries
from pyspark.sql import functions as F


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, n_chars):
    values = (row[0], row[1], row[2], n_chars, row[4])
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([_h(*last[k : k + arity]) for k in range(0, len(last), arity)])
    return out


def _siblings(levels, at, arity):
    found = []
    for level in levels[:-1]:
        begin = at - at % arity
        found.append((begin, at, level[begin : begin + arity]))
        at //= arity
    return found


def _plain(rows, arity=2):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees, own = {}, {}
    for lang in langs:
        own[lang] = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[3])))
        trees[lang] = _levels([_leaf(r, r[3]) for r in own[lang]], arity)
    top = _levels([trees[x][-1][0] for x in langs], arity) if langs else [[]]
    out = []
    for g, lang in enumerate(langs):
        for at, r in enumerate(own[lang]):
            path = _siblings(trees[lang], at, arity) + _siblings(top, g, arity)
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            leaf = _leaf(r, r[3])
            said = _leaf(r, r[3] + 1) if bad else leaf
            proof = "".join(x for begin, k, run in path for j, x in enumerate(run) if begin + j != k)
            for begin, k, run in path:
                said = _h(*[said if begin + j == k else x for j, x in enumerate(run)])
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], _h(proof), said, said == top[-1][0]))
    return sorted(out, key=str)


def _rows(n):
    rows = [(k, f"s{k % 3}", ("en", "de", None, "fr")[k % 4 if k % 3 else 0], k * 3, f"text {k} é") for k in range(n)]
    rows += [(None, None, None, None, None), (5, "s", "en", 1, "again"), (5, "s", "en", 1, "again"), (6, "", "", None, ""), (None, "x", "en", 2, "no id"), (-3, "x", "É", 7, "one of its own"), (2**63 - 1, "x", "de", 2**62, "w " * 5000)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _got(docs, **how):
    told = F.when(queries.remainder(7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.verified(merkle.manifest(docs, claimed={"n_chars": told}, **how), how.get("arity", 2))
    return sorted((tuple(r) for r in merkle.digest(found).collect()), key=str)


@pytest.mark.parametrize(("n", "height", "arity"), [(60, 12, 2), (60, 2, 2), (61, 1, 2), (90, 2, 3), (0, 3, 2)])
def test_manifest_equals_the_plain_fold(spark, n, height, arity):
    rows = _rows(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("extra") for c in ("grp", "at", "row", "digest", "path", "part", "root")})
    assert _got(docs, height=height, arity=arity) == _plain(rows, arity)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert _got(spark.createDataFrame([], SCHEMA)) == []
    one = [(7, "s", None, None, "only")]
    assert _got(spark.createDataFrame(one, SCHEMA)) == _plain(one)


def test_tampering_shows(spark):
    rows = _rows(40)
    found = {(r[0], r[1]): r[-1] for r in _got(spark.createDataFrame(rows, SCHEMA))}
    for (i, leaf), ok in found.items():
        row = next(r for r in rows if r[0] == i and _leaf(r, r[3]) == leaf)
        assert ok != (i is not None and row[3] is not None and zlib.crc32(str(i).encode()) % 7 == 0)


def test_ranks_of_a_hot_group_span_tasks(spark):
    from callweave.llm import common

    rows = common.as_table(spark.range(5000).select(F.lit("one").alias("grp"), (F.col("id") % 7).alias("k"), F.col("id").alias("row")), "test-rows")
    got = common.numbered(rows.repartition(4), "grp", ["grp", "k", "row"]).collect()
    want = {r: k for k, r in enumerate(sorted(range(5000), key=lambda x: (x % 7, x)))}
    assert {r["row"]: r["at"] for r in got} == want and {r["n"] for r in got} == {5000}
