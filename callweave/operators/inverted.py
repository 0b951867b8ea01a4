"""Keyword search over a stored inverted index: shards of documents, in each the posting lists of its terms.

A shard is at most SHARD chunks, so no posting list is longer, however frequent its
term.  The index is written once, clustered by term inside each shard; a search
reads the lists of its questions' terms alone and no text.  Inside a shard the
rarest terms go first, and once the n-th best chunk has more than all terms to
come can give, only chunks that can still reach it are looked up in the long lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Chunks in a shard, about; bytes of the questions' terms that go to every task; terms that a scan is filtered by.
SHARD, TERM_BYTES, FILTERED = 1 << 15, 16 << 20, 4096
#: What a number found adds to a score.
NUMBER = 0.75


#: The index: rows of posting lists, and behind each shard's those of its chunks' places.
LISTS = "shard int, term string, df int, places array<int>, place int, chunk_id string, ordinal long"


def posting_lists(shard: int, chunks: pa.Table) -> pa.Table:
    """Rows of LISTS for the chunks (chunk_id, ordinal, tokens) of a shard: a list for each term, by term, then a row for each chunk."""
    chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[("ordinal", "ascending"), ("chunk_id", "ascending")], null_placement="at_start"))
    tokens = chunks["tokens"].combine_chunks()
    terms, place = pc.list_flatten(tokens).dictionary_encode(), pc.list_parent_indices(tokens).to_numpy().astype(np.int32)
    if terms.null_count:
        some = pc.is_valid(terms)
        terms, place = terms.filter(some), place[some.to_numpy(zero_copy_only=False)]
    by_term = pc.sort_indices(terms.dictionary).to_numpy()
    number = np.empty(len(by_term), np.int32)
    number[by_term] = np.arange(len(by_term))
    of = number[terms.indices.to_numpy()]
    df, n, size = np.bincount(of, minlength=len(by_term)), len(by_term), chunks.num_rows
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(df)]), pa.int32()), pa.array(place[np.argsort(of, kind="stable")]))
    none = lambda kind, k: pa.nulls(k, kind)
    top = [pa.array(np.full(n, shard, np.int32)), terms.dictionary.take(pa.array(by_term)), pa.array(df, pa.int32()), lists, none(pa.int32(), n), none(pa.string(), n), none(pa.int64(), n)]
    end = [pa.array(np.full(size, shard, np.int32)), none(pa.string(), size), none(pa.int32(), size), none(lists.type, size), pa.array(np.arange(size), pa.int32()), chunks["chunk_id"].combine_chunks(), chunks["ordinal"].combine_chunks()]
    names = [f.split()[0] for f in LISTS.split(", ")]
    return pa.concat_tables([pa.table(top, names=names), pa.table(end, names=names)])


def build(chunks: DataFrame, path: str, shard: int = SHARD) -> None:
    """Write the index of chunks (chunk_id, ordinal, tokens) to path: `lists`, with rows (shard, term, df, places) and (shard, place, chunk_id, ordinal).

    Places count a shard's chunks by ordinal.  Chunks without tokens, null ones
    among them, are in no list; chunk_id tells chunks apart.  Tokens travel once, to
    their shard, and are sorted there as numbers.
    """
    spark = chunks.sparkSession
    chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ordinal").cast("long").alias("ordinal"), "tokens").write.mode("overwrite").parquet(f"{path}/tokens")
    stored = spark.read.parquet(f"{path}/tokens")
    count = stored.count()
    shards = max(1, min(spark.sparkContext.defaultParallelism, count), -(-count // shard))  # a shard is one task's work in a search
    dealt = stored.select(F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), "chunk_id", "ordinal", "tokens")

    def lists(key: tuple, own: pa.Table) -> pa.Table:
        return posting_lists(key[0].as_py(), own)

    dealt.groupBy("shard").applyInArrow(lists, LISTS).write.mode("overwrite").parquet(f"{path}/lists")


def _asked(queries: DataFrame) -> list[DataFrame]:
    """The questions (query_id, terms) in parts whose terms have about TERM_BYTES at most, by a measured size."""
    terms = queries.select("query_id", F.filter(F.array_distinct("terms"), lambda t: F.length(t) > 1).alias("terms")).where(F.size("terms") > 0)
    size = terms.agg(F.sum(F.octet_length(F.array_join("terms", " ")) + 32).alias("n")).first()["n"] or 0
    n = -(-size // TERM_BYTES)
    return [terms if n == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]


def best(lists: list[np.ndarray], worth: list[float], total: int, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the n best chunks of a shard for one question of `total` terms, ties to the smaller place.

    lists are sorted places; worth is what each adds besides its share of hits.
    """
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    hits, extra = np.zeros(size, np.int64), np.zeros(size)
    to_come = np.cumsum([0.0] + [1 / total + worth[k] for k in reversed(order)])[::-1]  # what the terms from each on can give
    some: np.ndarray | None = None
    for step, k in enumerate(order):
        own = lists[k]
        if some is None and step and len(own) > 4 * n:
            score = hits / total + NUMBER * extra
            reach = np.flatnonzero(score > 0)
            if len(reach) > n:
                least = np.partition(score[reach], len(reach) - n)[len(reach) - n]
                if least > to_come[step] + 1e-9:  # whoever has nothing yet cannot reach the n-th, not even by a tie
                    some = reach[score[reach] + to_come[step] >= least - 1e-9]
        if some is not None:
            at = np.minimum(np.searchsorted(own, some), len(own) - 1)
            own = some[own[at] == some]
        hits[own] += 1
        if worth[k]:
            extra[own] += 1
    found = np.flatnonzero(hits)
    score = hits[found] / total + NUMBER * extra[found]
    order = np.lexsort((found, -score))[:n]
    return found[order], score[order]


def _scorer(asked: list, n: int):
    """What finds the n best of a shard (its lists of the questions' terms) for each question (id, terms)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = {t: np.asarray(p, np.int64) for t, p in zip(pdf["term"], pdf["places"], strict=True)}
        size, parts = int(pdf["size"].iloc[0]), []
        for q, own in asked:
            there = [t for t in own if t in lists]
            if there:
                at, score = best([lists[t] for t in there], [NUMBER if t.isdecimal() else 0.0 for t in there], len(own), n, size)
                parts.append(pd.DataFrame({"query_id": [q] * len(at), "place": at.astype(np.int32), "score": score}))
        out = pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "place": [], "score": []})
        out["shard"] = np.int32(pdf["shard"].iloc[0])
        return out[["query_id", "shard", "place", "score"]]

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, chunk_id, ordinal, rank, score, distance): the n chunks with the best share of each question's terms and its numbers, ties by ordinal.

    Every chunk with a term is considered; a shard sends on its n best for each
    question.  Questions without terms have no rows.
    """
    whole = spark.read.parquet(f"{path}/lists")
    postings, places = whole.where("term IS NOT NULL").select("shard", "term", "places"), whole.where("place IS NOT NULL").select("shard", "place", "chunk_id", "ordinal")
    kind = dict(queries.dtypes)["query_id"]
    schema, found = f"query_id {kind}, shard int, place int, score double", None
    sizes = places.groupBy("shard").agg(F.count("*").cast("int").alias("size"))
    for block in _asked(queries):
        rows = block.collect()  # bounded above
        asked = [(r["query_id"], list(r["terms"])) for r in rows]
        terms = sorted({t for _, own in asked for t in own})
        if len(terms) <= FILTERED:
            wanted = postings.where(F.col("term").isin(terms))
        else:
            wanted = postings.join(F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")

        near = wanted.join(sizes, "shard").groupBy("shard").applyInPandas(_scorer(asked, n), schema)
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], schema)
    named = found.join(places, ["shard", "place"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    ranked = named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("query_id", "chunk_id", "ordinal", "rank", "score", (1 - F.col("score")).alias("distance"))
