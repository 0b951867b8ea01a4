"""Retrieval and answer quality, chunk diagnostics, and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import staged


def graded(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Retrieved rows with rel (0/1) and gain: url, document or section matches; a graded url has its own gain."""
    q = questions.select(F.col("id").alias("question_id"), F.transform("relevant_source_urls", X.url_key).alias("urls"), "relevant_document_ids", F.transform("relevant_sections", F.lower).alias("sections"), "graded_relevance")
    j = rows.join(q, "question_id")
    url = X.url_key("source_url")
    section = F.lower(F.array_join("section_path", " > "))
    has = lambda arr, x: F.coalesce(F.array_contains(arr, x), F.lit(False))
    rel = (has("urls", url) | has("relevant_document_ids", F.col("document_id")) | has("sections", section)).cast("int")
    by_url = F.transform_keys(F.coalesce("graded_relevance", F.create_map().cast("map<string,double>")), lambda k, _: X.url_key(k))
    return j.select("question_id", "rank", rel.alias("rel"), F.coalesce(F.try_element_at(by_url, url), rel.cast("double")).alias("gain"))


def with_truth(questions: DataFrame) -> DataFrame:
    """Questions that have any ground truth; the others are skipped."""
    some = [F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0 for c in ("relevant_source_urls", "relevant_document_ids", "relevant_sections")]
    return questions.where(reduce(lambda a, b: a | b, some))


def ranking_metrics(rows: DataFrame, items: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per question of items (question_id, n_relevant): hit rate, precision, recall, reciprocal rank, DCG, nDCG at the cuts.

    rows: (question_id, rank from 1, rel, gain).  The ideal order is that of the
    retrieved gains.  One aggregate over one window: a question's rows are a page
    of results, not a corpus.
    """
    ideal = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("gain"), "rank"))
    r = rows.withColumn("ideal_rank", ideal)
    at = lambda k, x: F.sum(F.when(F.col("rank") <= k, x).otherwise(0.0))
    found: dict[str, Column] = {"first": F.min(F.when(F.col("rel") > 0, F.col("rank")))}
    for k in cuts:
        found[f"n{k}"] = at(k, F.col("rel").cast("double"))
        found[f"dcg_{k}"] = at(k, F.col("gain") / F.log2(F.col("rank") + 1))
        found[f"ideal_{k}"] = F.sum(F.when(F.col("ideal_rank") <= k, F.col("gain") / F.log2(F.col("ideal_rank") + 1)).otherwise(0.0))
    agg = r.groupBy("question_id").agg(*[c.alias(n) for n, c in found.items()])
    j = items.join(agg, "question_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = [F.col("question_id"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in cuts:
        out += [
            (z(f"n{k}") > 0).cast("double").alias(f"hit_rate_{k}"), (z(f"n{k}") / k).alias(f"precision_{k}"),
            F.when(F.col("n_relevant") > 0, F.least(F.lit(1.0), z(f"n{k}") / F.col("n_relevant"))).otherwise(0.0).alias(f"recall_{k}"),
            z(f"dcg_{k}").alias(f"dcg_{k}"), F.when(z(f"ideal_{k}") > 0, z(f"dcg_{k}") / z(f"ideal_{k}")).otherwise(0.0).alias(f"ndcg_{k}"),
        ]
    return j.select(*out)


def accuracy(rows: DataFrame, questions: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: share of questions with a hit among the first k, by section and by source.

    Each share is taken over the questions that have that ground truth; NULL if none has.
    rows: (question_id, rank, source_url, section_path).
    """
    strings = F.array().cast("array<string>")
    urls, sections = F.coalesce("relevant_source_urls", strings), F.coalesce("relevant_sections", strings)
    q = questions.select(F.col("id").alias("question_id"), F.transform(urls, X.url_key).alias("urls"), F.transform(sections, lambda x: F.lower(F.trim(x))).alias("sections"))
    j = q.join(rows.select("question_id", "rank", X.url_key("source_url").alias("url"), F.lower(F.array_join("section_path", " > ")).alias("section")), "question_id", "left")
    kinds = {"section": ("sections", "section"), "source": ("urls", "url")}
    hit = lambda k, truth, x: F.max(F.coalesce((F.col("rank") <= k) & F.array_contains(truth, F.col(x)), F.lit(False)).cast("double"))
    hits = [F.when(F.size(F.first(truth)) > 0, hit(k, truth, x)).alias(f"{kind}_top_{k}") for kind, (truth, x) in kinds.items() for k in cuts]
    return j.groupBy("question_id").agg(*hits).agg(*[F.round(F.avg(f"{kind}_top_{k}"), 4).alias(f"{kind}_top_{k}") for kind in kinds for k in cuts])


def compared(reports: dict[str, DataFrame], *fields: str) -> DataFrame:
    """The same fields of several one-row reports, side by side by configuration."""
    return reduce(DataFrame.unionByName, [r.select(F.lit(name).alias("config"), *fields) for name, r in reports.items()])


def means(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    """Mean of each metric over the rows that have it."""
    return df.agg(*[F.round(F.avg(n), places).alias(n) for n in names])


def quantiles(df: DataFrame, value: Column, **wanted: tuple[float, str]) -> DataFrame:
    """One row with exact quantiles (share, "disc" or "cont") of a numeric column; NULL without values.

    Values are counted, ranged over partitions and picked by their cumulative counts:
    no task holds more than a range's distinct values.
    """
    counts = df.select(value.cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    ranged = staged(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "value-counts")
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("n"), F.min("v").alias("low"))  # a row a partition
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    ordered = ranged.join(F.broadcast(placed), "range").withColumn("upto", F.col("before") + upto)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    out = []
    for name, (share, kind) in wanted.items():
        if kind == "disc":
            out.append(at(F.greatest(F.lit(0), F.ceil(F.lit(share) * F.col("total")) - 1)).alias(name))
        else:
            spot = F.lit(share) * (F.col("total") - 1)
            low, high = at(F.floor(spot)), at(F.ceil(spot))
            out.append((low + (high - low) * F.coalesce(F.max(spot - F.floor(spot)), F.lit(0.0))).alias(name))
    return ordered.agg(*out)


def latency_summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, median, nearest-rank p95 and p99, least and greatest, to 3 places."""
    r = lambda c, name: F.round(c, 3).alias(name)
    plain = df.agg(F.count(column).alias("count"), r(F.avg(column), "mean"), r(F.min(column), "min"), r(F.max(column), "max"))
    ranked = quantiles(df, F.col(column), median=(0.5, "cont"), p95=(0.95, "disc"), p99=(0.99, "disc"))
    return plain.crossJoin(ranked).select("count", "mean", r("median", "median"), r("p95", "p95"), r("p99", "p99"), "min", "max")  # one row each


def chunk_report(chunks: DataFrame, least: int, most: int) -> DataFrame:
    """Sizes, shares outside the bounds, empty and repeated chunks, chunks a document; one row."""
    n = F.length("text")
    body = X.stripped("text")
    per = chunks.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("chunks_per_document"), F.max("n").alias("most_per_document"))
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 2)
    sizes = chunks.agg(
        F.count("*").alias("total"), F.avg(n).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"),
        share(n < least).alias("below_min_pct"), share(n >= most).alias("at_max_pct"), F.count_if(n > most).alias("violations"), F.count_if(body == "").alias("empty"), (F.count("*") - F.count_distinct(F.xxhash64(body), F.crc32(body.cast("binary")))).alias("duplicates"),
    )
    ranked = quantiles(chunks, n, median=(0.5, "cont"), p25=(0.25, "disc"), p75=(0.75, "disc"), p95=(0.95, "disc"))
    return sizes.crossJoin(ranked).crossJoin(per)  # one row each


#: Metrics of the answers, which say nothing where an offline stand-in gave them.
ANSWER_METRICS = ("citation_validity", "citation_correctness_lexical", "citation_completeness", "lexical_groundedness", "answer_token_f1", "insufficient_context_handling")


def unavailable(questions: DataFrame, judged: bool, stand_in: bool = False) -> DataFrame:
    """(metric, reason) for what a run cannot measure: one aggregate over the questions, then a join with the list of reasons."""
    have = questions.agg(F.coalesce(F.max(F.coalesce("reference_answer", F.lit("")) != ""), F.lit(False)).alias("answers"), F.coalesce(F.max(F.col("expect_insufficient").isNotNull()), F.lit(False)).alias("flags"))
    rows = [("answer_correctness", 1, "answers", "no reference answers in the evaluation set"), ("answer_token_f1", 1, "answers", "no reference answers in the evaluation set"), ("insufficient_context_handling", 1, "flags", "no expect_insufficient flags in the evaluation set")]
    rows += [] if judged else [(m, 2, "never", "no judge is configured") for m in JUDGED]
    rows += [(m, 0, "never", "answers come from the offline stand-in") for m in ANSWER_METRICS] if stand_in else []
    listed = questions.sparkSession.createDataFrame(rows, "metric string, ord int, unless string, reason string")
    missing = listed.crossJoin(have).where(~(((F.col("unless") == "answers") & F.col("answers")) | ((F.col("unless") == "flags") & F.col("flags"))))  # a constant list and one row
    return missing.groupBy("metric").agg(F.min_by("reason", "ord").alias("reason"))


def histogram(chunks: DataFrame, width: int) -> DataFrame:
    return chunks.groupBy((F.floor(F.length("text") / width) * width).alias("bucket")).agg(F.count("*").alias("chunks"))


def agentic_summary(rows: DataFrame) -> DataFrame:
    """Mean attempts where there were any, how often a question was rewritten, how often it was given up."""
    tried = F.col("attempts") >= 1
    return rows.agg(F.avg(F.when(tried, F.col("attempts"))).alias("mean_attempts"), F.count_if(F.col("attempts") > 1).alias("rewritten"), F.count_if(tried & ~F.col("sufficient")).alias("gave_up"))


# --- answers: columns answer, texts (array of passage texts), cited_texts (of the citations) -------

FACTUAL = r"(?i)\d|[*#]\d|%|جنيه|EGP|GB|MB"


def citation_validity(answer: Column, passages: Column) -> Column:
    marks = X.cited(answer)
    return F.when(F.size(marks) > 0, F.size(F.filter(marks, lambda i: (i >= 1) & (i <= passages))) / F.size(marks))


def citation_correctness(answer: Column, cited_texts: Column, least: float = 0.12) -> Column:
    own = X.token_set(answer)
    good = F.filter(cited_texts, lambda t: F.coalesce(F.size(F.array_intersect(own, X.token_set(t))) / F.size(own) >= least, F.lit(False)))
    return F.when(F.size(cited_texts) == 0, None).when(F.size(own) == 0, 0.0).otherwise(F.round(F.size(good) / F.size(cited_texts), 4))


def citation_completeness(answer: Column) -> Column:
    facts = F.filter(F.split(F.coalesce(answer, F.lit("")), r"(?<=[.!?؟])(?U)\s+"), lambda s: (F.trim(s) != "") & s.rlike(FACTUAL))
    return F.when(F.size(facts) > 0, F.round(F.size(F.filter(facts, lambda s: s.rlike(r"\[\d{1,2}\]"))) / F.size(facts), 4))


def groundedness(answer: Column, texts: Column) -> Column:
    own = X.token_set(answer)
    context = F.array_distinct(F.flatten(F.transform(texts, X.token_set)))
    return F.when(F.size(own) == 0, None).when(F.size(context) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(own, context)) / F.size(own), 4))


def token_f1(answer: Column, reference: Column) -> Column:
    a, r = X.token_set(answer), X.token_set(reference)
    both = F.size(F.array_intersect(a, r))
    f1 = 2 * (both / F.size(a)) * (both / F.size(r)) / (both / F.size(a) + both / F.size(r))
    return F.when(reference.isNull() | (reference == ""), None).when(both == 0, 0.0).otherwise(F.round(f1, 4))


def refusal_score(sufficient: Column, expect_insufficient: Column) -> Column:
    return F.when(expect_insufficient.isNotNull(), (sufficient != expect_insufficient).cast("double"))


# What a judge scores.
JUDGED = ("faithfulness", "answer_relevance", "context_relevance", "context_precision", "context_recall", "answer_correctness", "unsupported_claim_rate")


def judge_scores(reply: Column) -> Column:
    """Scores of a judge's reply: the JSON object in it, each key clamped to [0, 1], NULL if not a number."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "map<string,string>")
    clamp = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed[k].try_cast("double")))
    return F.struct(*[F.when(parsed[k].try_cast("double").isNotNull(), clamp(k)).alias(k) for k in JUDGED])


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of (model, tokens_in, tokens_out): the first price row (by ord) whose prefix the model has; NULL if none.

    prices (ord, prefix, usd_in, usd_out per million) is a short list kept by hand.
    """
    table = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in prices.orderBy("ord").collect()])
    hit = F.get(F.filter(table, lambda p: F.startswith(F.col("model"), p["prefix"])), F.lit(0))
    return usage.withColumn("cost", F.round((F.col("tokens_in") * hit["usd_in"] + F.col("tokens_out") * hit["usd_out"]) / 1e6, 6))
