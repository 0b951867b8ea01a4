"""Hybrid retrieval for many questions in one plan: two ranked lists, fused, de-duplicated, diversified, packed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import fresh_folder
from . import inverted

# Synonyms of a normalised term, and words that are no terms.
SYNONYMS = {
    "اقل": ["أقل", "الحد", "الأدنى", "ادنى", "اكثر", "أكثر", "minimum", "min"],
    "ليمت": ["حد", "الحد", "limit", "minimum"],
    "اوردر": ["طلب", "طلبية", "الطلبية", "الطلبات", "order", "orders"],
    "order": ["طلب", "طلبية", "الطلبية", "الطلبات", "اوردر"],
    "طلبية": ["الطلبيات", "طلبيات", "طلبات", "order", "orders"],
    "الطلبية": ["الطلبيات", "طلبيات", "طلبات", "order", "orders"],
}
STOP = ["هل", "ينفع", "ممكن", "في", "على", "من", "ايه", "هو", "هي", "ب", "ال"]
RRF = 60


def _without_article(terms: Column) -> Column:
    return F.transform(F.filter(terms, lambda t: t.startswith("ال") & (F.length(t) > 3)), lambda t: F.substring(t, 3, 1 << 20))


def document_tokens(text: str | Column) -> Column:
    """Distinct normalised tokens, with and without the article (text after NFKC)."""
    return X.let(F.regexp_extract_all(X.fold_term(text), F.lit(X.WORD), F.lit(1)), lambda t: F.array_distinct(F.concat(t, _without_article(t))))


def query_terms(question: str | Column) -> Column:
    """As document_tokens, with synonyms and without stop words."""
    folded = lambda words: F.array(*[X.fold_term(F.lit(w)) for w in words])
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), folded(v))])

    def grown(terms: Column) -> Column:
        more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))
        return F.array_except(F.array_distinct(F.concat(terms, _without_article(terms), more)), folded(STOP))

    words = F.regexp_extract_all(X._col(question), F.lit(X.WORD), F.lit(1))
    return X.let(F.array_distinct(F.transform(words, X.fold_term)), grown)


def lexical_score(terms: Column, tokens: Column) -> Column:
    """Share of the terms (longer than 1) found, and 0.75 for each number found."""
    own = F.filter(F.array_distinct(terms), lambda t: F.length(t) > 1)
    both = F.array_intersect(own, tokens)
    numbers = F.size(F.filter(both, lambda t: t.rlike(r"^\p{Nd}+$")))
    return F.when(F.size(own) > 0, F.size(both) / F.size(own) + 0.75 * numbers).otherwise(0.0)


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine in doubles; 1 for a zero vector; vectors of different sizes are an error."""
    a, b = X._col(a), X._col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("boolean"))
    return F.when(same & (norm > 0), 1 - dot(a, b) / norm).otherwise(1.0)


def unit(v: str | Column) -> Column:
    """The vector in doubles at length one; a zero vector stays."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))
    return X.let(X._col(v), lambda x: X.let(norm(x), lambda n: F.transform(x, lambda p: F.when(n > 0, p.cast("double") / n).otherwise(0.0))))


def fetch_width(k: int) -> int:
    return min(max(10 * k, 30), 100)


def _ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of each question; Spark keeps only n of each before the shuffle (group limit)."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: Bytes of question vectors that go to every task at once, and of the distances between them and the chunks that are worked on.
QUESTION_BYTES, PRODUCT_BYTES = 32 << 20, 32 << 20


def _question_blocks(queries: DataFrame) -> list[DataFrame]:
    """The questions with vectors in parts of at most about QUESTION_BYTES, by a measured size."""
    asked = queries.where("qvec IS NOT NULL").select("query_id", "qvec")
    size = asked.agg(F.sum(F.size("qvec") * 8 + 16).alias("n")).first()["n"] or 0
    n = -(-size // QUESTION_BYTES)
    return [asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]


def semantic_search(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Exact: every chunk with a vector is scored against each question (query_id, qvec); ties by ordinal.

    The questions are a stated set whose vectors, at most QUESTION_BYTES at a time, go
    to the chunks as a matrix of unit vectors.  A batch of chunks is one product with
    it and sends on only its n nearest for each question; the rest is a ranked merge.
    Distances are compared to twelve places, so that equal vectors tie.
    """
    types = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in queries.schema.fields)}
    schema = f"query_id {types['query_id']}, chunk_id string, ordinal long, d double"
    source = chunks.where("vector IS NOT NULL").select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "vector")
    found = None
    for block in _question_blocks(queries):
        rows = block.collect()  # bounded above
        ids = pd.Series([r["query_id"] for r in rows])
        asked = unit_rows(np.array([r["qvec"] for r in rows], float))

        def run(it: Iterator[pd.DataFrame], ids: pd.Series = ids, asked: np.ndarray = asked) -> Iterator[pd.DataFrame]:
            rows = max(1, min(1024, PRODUCT_BYTES // (8 * len(asked))))
            for whole in it:
                for at in range(0, len(whole), rows):
                    pdf = whole.iloc[at : at + rows]
                    if any(len(v) != asked.shape[1] for v in pdf["vector"]):
                        raise ValueError("vectors of different sizes")
                    d = np.round(1 - asked @ unit_rows(np.array(pdf["vector"].tolist(), float)).T, 12)
                    ordinal = pdf["ordinal"].to_numpy()
                    order = np.lexsort((np.broadcast_to(ordinal, d.shape), d), axis=1)[:, :n]
                    q = np.repeat(np.arange(len(ids)), order.shape[1])
                    yield pd.DataFrame({"query_id": ids.to_numpy()[q], "chunk_id": pdf["chunk_id"].to_numpy()[order.ravel()], "ordinal": ordinal[order.ravel()], "d": d[q, order.ravel()]})

        near = source.mapInPandas(run, schema)
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = chunks.sparkSession.createDataFrame([], schema)
    near = _ranked(found, [F.col("d"), F.col("ordinal")], n)
    return near.select("query_id", "chunk_id", "ordinal", "rank", F.round(F.greatest(F.lit(0.0), 1 - F.col("d")), 6).alias("score"), F.round("d", 6).alias("distance"))


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def distances(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, d) for every chunk and question: each side is normalised once, the questions are broadcast in bounded blocks.

    This is the definition that `semantic_search` is checked by; its result has a row
    for each pair, so that it suits a few questions or a few chunks.
    """
    right = chunks.where("vector IS NOT NULL").select("chunk_id", unit("vector").alias("u"))
    left = [b.select("query_id", unit("qvec").alias("q")) for b in _question_blocks(queries)]
    dot = F.aggregate(F.zip_with("u", "q", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    parts = [right.crossJoin(F.broadcast(b)).select("query_id", "chunk_id", (1 - dot).alias("d")) for b in left]
    return reduce(DataFrame.unionByName, parts) if parts else right.select(F.lit(0).alias("query_id"), "chunk_id", F.lit(0.0).alias("d")).limit(0)


def keyword_search(chunks: DataFrame, queries: DataFrame, n: int, index: str | None = None) -> DataFrame:
    """Chunks that share a term with a question (query_id, terms), best first: `inverted.search` in the index at that path.

    Without a path the chunks' index is written to the shared folder first; searches
    that follow one another build it once and name it.
    """
    if index is None:
        index = fresh_folder(chunks.sparkSession, "inverted")
        inverted.build(chunks, index)
    return inverted.search(chunks.sparkSession, index, queries, n)


def fuse(semantic: DataFrame, keyword: DataFrame, queries: DataFrame) -> DataFrame:
    """Weighted reciprocal ranks; a chunk keeps its semantic score if it has one; ties: semantic order, then keyword order."""
    digit = F.exists("terms", lambda t: t.rlike(r"^\p{Nd}+$"))
    weight = queries.select("query_id", F.when(digit, 2.0).otherwise(1.25).alias("kw"))
    both = semantic.select("query_id", "chunk_id", "rank", "score", F.lit(0).alias("list")).unionByName(keyword.select("query_id", "chunk_id", "rank", "score", F.lit(1).alias("list"))).join(weight, "query_id")
    part = F.when(F.col("list") == 0, 1.0).otherwise(F.col("kw")) / (RRF + F.col("rank"))
    place = F.struct("list", "rank")
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum(F.when(F.col("list") == 0, part).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("list") == 1, part).otherwise(0.0)).alias("k"), F.min(place).alias("place"), F.min_by("score", place).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "place")
    return fused.withColumn("hybrid_score", F.col("s") + F.col("k")).withColumn("pos", F.row_number().over(w)).select("query_id", "chunk_id", "score", "hybrid_score", "pos")


def dedupe_content(rows: DataFrame) -> DataFrame:
    """Of equal contents (content_hash) the best-scored row stays, earlier first, in the first one's place.

    duplicate_source_urls has the urls of the copy it replaced and of those it beat
    after that; those gathered before it took over are lost.
    """
    key = Window.partitionBy("query_id", "content_hash")
    best = F.max_by("pos", F.struct("score", -F.col("pos"))).over(key)
    held = rows.withColumns({"slot": F.min("pos").over(key), "best": best})
    before = F.max(F.when(F.col("pos") < F.col("best"), F.struct("score", -F.col("pos")))).over(key)  # who held the place until then
    held = held.withColumn("beaten", -before["col2"])
    url = F.when((F.col("source_url") != "") & ((F.col("pos") > F.col("best")) | (F.col("pos") == F.col("beaten"))), F.struct("pos", "source_url"))
    held = held.withColumn("urls", F.array_distinct(F.transform(F.array_sort(F.collect_list(url).over(key)), lambda x: x["source_url"])))
    kept = held.where("pos = best").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("slot")))
    return kept.drop("slot", "best", "beaten").withColumnRenamed("urls", "duplicate_source_urls")


def diversify(rows: DataFrame, k: int) -> DataFrame:
    """The first row of each section in order, then all others, cut to k."""
    valid = F.col("section_index").isNotNull() & (F.col("section_index") != -1)
    rn = F.row_number().over(Window.partitionBy("query_id", "document_id", "section_index").orderBy("pos"))
    marked = rows.withColumn("later", F.when(valid & (rn == 1), 0).otherwise(1))
    w = Window.partitionBy("query_id").orderBy("later", "pos")
    return marked.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).drop("later")


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = 5, dedupe: bool = True, index: str | None = None) -> DataFrame:
    """The whole chain for questions (query_id, qvec, terms) over one company's chunks, whose inverted index may be there already."""
    width = fetch_width(k)
    fused = fuse(semantic_search(chunks, queries, width), keyword_search(chunks, queries, width, index), queries)
    rows = fused.join(chunks.drop("vector", "tokens"), "chunk_id")
    return diversify(dedupe_content(rows) if dedupe else rows, k)


def pack_context(rows: DataFrame, budget: int = 8000) -> DataFrame:
    """Numbered blocks of (query_id, pos, label, text) until the first that passes the budget; one at least."""
    block = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.col("label"), F.lit("\n"), F.col("text"))
    w = Window.partitionBy("query_id").orderBy("pos")
    total = F.sum(F.length("block")).over(w)
    return rows.withColumn("block", block).withColumn("total", total).where((F.col("total") <= budget) | (F.col("pos") == 1)).drop("total")


def stratified(df: DataFrame, n: int, category: str = "category", order: str = "ordinal") -> DataFrame:
    """Round robin over the sorted categories, in their order, until n rows; no category sends on more than n."""
    rn = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return df.withColumn("cycle", rn).where(F.col("cycle") <= n).orderBy("cycle", category).limit(n)
