"""Files to chunks with vectors, as one plan: load, repair, gate, section, chunk, de-duplicate, embed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.embedding import embedder
from ..operators import chunking, greedy, mutations
from ..sources.staging import staged


def prepared(documents: DataFrame, company_id: int) -> DataFrame:
    """Loaded documents with repaired pages, their whole text, quality and id; reversed ones get their headings turned too."""
    pages = F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), p["text"].alias("text")))
    d = documents.withColumn("text", X.nfkc(F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n")))
    d = d.withColumn("_back", X.reversal("text")["is_reversed"])
    back = F.col("_back")
    turn = lambda c: F.when(back, F.reverse(c)).otherwise(c)
    turn_lines = F.when(back, X.reversed_lines("text")).otherwise(F.col("text"))
    fixed = F.transform("pages", lambda p: F.struct(p["page_number"].alias("page_number"), F.when(back, X.reversed_lines(p["text"])).otherwise(p["text"]).alias("text")))
    heads = F.transform("headings", lambda h: F.struct(turn(h["text"]).alias("text"), h["page_number"].alias("page_number"), h["level"].alias("level"), h["order"].alias("order"), h["reason"].alias("reason")))
    d = d.withColumns({"pages": fixed, "headings": heads, "title": turn(F.col("title")), "text": turn_lines, "name": F.element_at(F.split("path", "/"), -1), "company_id": F.lit(company_id)}).drop("_back")
    full = F.size(F.filter("pages", lambda p: F.length(F.trim(p["text"])) >= 80))
    return d.withColumns({"quality": X.quality("text", F.size("pages"), full, F.size("headings")), "document_id": X.document_key("company_id", "name", "text")})


def chunked(documents: DataFrame, size: int = 150, overlap: int = 20, unit: str = "words", least: int = 20, threshold: float | None = 0.92) -> DataFrame:
    """Chunks with ids and vectors of the prepared documents that pass the gate.

    Files are read and texts embedded once: the documents and the chunks are
    written as tables, so ordinals stay what they are in every later plan.
    """
    good = staged(documents.where(F.col("error").isNull() & F.col("quality.ok")), "ingest-documents")
    parts = chunking.chunk_documents(good.select("document_id", "text"), chunking.build_sections(good, least), size, overlap, unit)
    parts = chunking.dedupe_exact(parts).withColumn("vector", embedder()(F.col("text")))
    if threshold is not None:
        parts = greedy.dedupe_similar(parts, threshold)
    named = parts.join(good.select("document_id", "company_id", F.col("name").alias("source"), F.col("title").alias("document_title"), F.col("suffix").alias("source_type")), "document_id")
    chunks = named.withColumns({"chunk_id": X.chunk_key("company_id", "document_id", "part", "text"), "chunk_index": F.col("part") - 1, "language": X.language("text"), "content_hash": X.content_hash(F.trim("text")), "ordinal": F.monotonically_increasing_id()})
    return staged(chunks, "ingest-chunks")


def ingested(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """The store with the chunks: a document's old chunks go as its new ones come, in one snapshot."""
    kept = store.join(chunks.select("document_id").distinct(), "document_id", "left_anti")
    return kept.select(store.columns).unionByName(mutations.upsert(kept.limit(0), chunks).select(store.columns))


def ingest_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    failed, blocked = F.col("error").isNotNull(), F.col("error").isNull() & ~F.col("quality.ok")
    seen = documents.agg(F.count("*").alias("files_seen"), F.count_if(failed).alias("failed"), F.count_if(blocked).alias("skipped"), F.count_if(~failed & ~blocked).alias("ingested"))
    return seen.crossJoin(chunks.agg(F.count("*").alias("total_chunks")))  # one row each
