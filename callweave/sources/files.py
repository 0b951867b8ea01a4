"""Files of a landing folder to documents, evaluation sets, snapshots and reports."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("pdf", "txt", "md", "markdown", "docx")
LARGEST = 25 << 20
DOCUMENT = "path string, suffix string, title string, pages array<struct<page_number:int,text:string>>, headings array<struct<text:string,page_number:int,level:int,order:int,reason:string>>, error string"
_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def title_of(lines: list[str], stem: str) -> str:
    good = (x.strip() for x in lines)
    return next((x for x in good if 3 <= len(x) <= 120 and not x.endswith((".", "،"))), re.sub("[-_]", " ", stem))


def load_text(data: bytes) -> tuple[list, list]:
    text = data.decode("utf-8", "replace")
    marks = [(n, _HEADING.match(x)) for n, x in enumerate(text.splitlines())]
    return [(1, text)], [(m[2], 1, len(m[1]), n, "markdown") for n, m in marks if m]


def load_docx(data: bytes) -> tuple[list, list]:
    """Paragraphs with text; a style called 'heading N' makes a heading of level N, or 1."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    lines, heads = [], []
    for p in body.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        named = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
        if (named or "").lower().startswith("heading"):
            level = re.search(r"(\d+)", named)
            heads.append((text, 1, int(level[1]) if level else 1, len(lines), "docx_style"))
        lines.append(text)
    return [(1, "\n".join(lines))], heads


def load_pdf(data: bytes) -> tuple[list, list]:
    raise NotImplementedError("no PDF library here: span tables go to operators.chunking.headings_of_spans")


LOADERS = {"txt": load_text, "md": load_text, "markdown": load_text, "docx": load_docx, "pdf": load_pdf}


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the folder and those below it with a known suffix, without dot files, with their size check."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", name.alias("name"), suffix.alias("suffix"), "length", "content").where(suffix.isin(*SUFFIXES) & ~name.startswith("."))


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, suffix, length) of the files that `landed` gives, by path; contents are not read."""
    return landed(spark, folder).select("path", "name", "suffix", "length").orderBy("path")


def intake(spark: SparkSession, folder: str, most: int = LARGEST) -> DataFrame:
    """(path, name, suffix, length, company_id, status) of all uploads below `folder`, dot files aside.

    An upload belongs to the company of its folder `company_{id}`, NULL outside of
    one.  status: 415 for a suffix that is not taken, 413 for more than `most` bytes, else 201.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    company = F.regexp_extract("path", r"/company_(\d+)/[^/]+$", 1)
    status = F.when(~suffix.isin(*SUFFIXES), 415).when(F.col("length") > most, 413).otherwise(201)
    return files.where(~name.startswith(".")).select("path", name.alias("name"), suffix.alias("suffix"), "length", F.nullif(company, F.lit("")).cast("long").alias("company_id"), status.alias("status"))


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file, in no order; what cannot be read has its error and no pages."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, name, suffix, length, content in zip(pdf["path"], pdf["name"], pdf["suffix"], pdf["length"], pdf["content"], strict=True):
                pages, heads, error = [], [], None
                try:
                    if length > LARGEST:
                        raise ValueError("larger than 25 MB")
                    pages, heads = LOADERS[suffix](content)
                except Exception as e:  # one bad file does not stop the folder
                    error = f"{type(e).__name__}: {e}"
                lines = [h[0] for h in heads] or (pages[0][1].splitlines()[:20] if pages else [])
                rows.append((path, suffix, title_of(lines, name.rsplit(".", 1)[0]), [{"page_number": n, "text": t} for n, t in pages], [dict(zip(("text", "page_number", "level", "order", "reason"), h, strict=True)) for h in heads], error))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in re.split(r", (?=\w+ )", DOCUMENT)])

    return landed(spark, folder).mapInPandas(run, DOCUMENT)


QUESTION = (
    "id string, question string, category string, language string, reference_answer string, relevant_source_urls array<string>, relevant_document_ids array<string>, relevant_sections array<string>, "
    "expected_citations array<string>, graded_relevance map<string,double>, expect_insufficient boolean, notes string"
)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: a JSON list, or an object with the list in `questions`."""
    typed = re.sub(r"(\w+) (\w+(?:<[^>]*>)?)(, |$)", lambda m: f"{m[1]}:{m[2]}{m[3]}", QUESTION)
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    as_list = F.from_json("v", f"array<struct<{typed}>>")
    inside = F.from_json("v", f"struct<questions:array<struct<{typed}>>>")["questions"]
    return whole.select(F.inline(F.when(F.col("v").startswith("["), as_list).otherwise(inside)))


def snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A saved table, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def report(path: str) -> dict | None:
    """A stage's JSON report, None if it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def write_report(path: str, rows: DataFrame) -> None:
    """A small result as readable JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(recursive=True) for r in rows.collect()], f, ensure_ascii=False, indent=2, default=str)
