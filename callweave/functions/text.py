"""Text functions as column expressions; only NFKC and line-wise repairs run as Arrow batches.

Java's \\w, \\s and \\b are ASCII unless (?U) is given, so it is given everywhere.
Characters of a class are counted by what is left when all others go, in runs: a
match for each character costs many times as much.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

WORD = r"((?U)\w+)"
TOKEN = r"((?U)[\w؀-ۿ]+)"
MARKS = "[ً-ٰٟـ]"
ARABIC = r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"


#: What (?U)\\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text that are Python objects at a time.
AT_ONCE = 1 << 20


def runs_of(texts: pa.Array, most: int = AT_ONCE) -> Iterator[pa.Array]:
    """The array in slices of about `most` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, till - at)
        at = till


@arrow_udf(StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for texts in runs_of(batch):
            yield pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(x) with x bound to value once: however often body names x, the plan holds value a single time."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def bound(df: DataFrame, **cols: Column | str) -> DataFrame:
    """df with columns that are computed once: a generator of one row keeps the optimiser from copying them into their uses."""
    return df.select("*", F.inline(F.array(F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in cols.items()]))))


def stripped(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.trim(_col(c), F.lit(SPACES))


def left_of(c: str | Column, others: str) -> Column:
    """How many characters are left when the others, a class, go."""
    return F.length(F.regexp_replace(_col(c), f"{others}+", ""))


def squeezed(c: str | Column, others: str) -> Column:
    """Runs of characters but the others, a class, each behind one blank."""
    return F.rtrim(F.concat(F.lit(" "), F.ltrim(F.regexp_replace(_col(c), f"{others}+", " "))))


def _times(c: Column, part: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def fold_term(c: str | Column) -> Column:
    """After NFKC: lower case, marks gone, alef, ya and ta marbuta folded."""
    return F.translate(F.regexp_replace(F.lower(_col(c)), MARKS, ""), "أإآىة", "ااايه")


def fold_phrase(c: str | Column) -> Column:
    """After NFKC, for analytics questions: ta marbuta stays."""
    return F.translate(F.regexp_replace(F.lower(F.trim(_col(c))), MARKS, ""), "أإآى", "اااي")


def normalised(c: str | Column) -> Column:
    """After NFKC: marks gone, one line end, one blank, trimmed lines, at most one empty line."""
    x = F.regexp_replace(_col(c), "[ـً-ْٰۖ-ۭ]", "")
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "[\t\xa0\u200f\u200e]", " "), " {2,}", " ")
    x = F.array_join(F.transform(F.split(x, "\n"), stripped), "\n")
    return stripped(F.regexp_replace(x, "\n{3,}", "\n\n"))


def letters(c: str | Column) -> Column:
    return left_of(c, r"\P{L}")


def _high(c: Column) -> Column:
    """Without the characters before the Arabic ones: a class of several ranges then has little to look at, which Java is slow at."""
    return F.regexp_replace(c, "[\\x00-\u05ff]+", "")


def _arabic_letters(c: Column) -> Column:
    """All letters but those that are left when Arabic characters go, the frequent block first."""
    rest = lambda h: F.regexp_replace(F.regexp_replace(h, "[\u0600-\u06ff]+", ""), f"{ARABIC}+", "")
    return let(_high(c), lambda h: letters(h) - letters(rest(h)))


def arabic_ratio(c: str | Column) -> Column:
    """Arabic letters among all letters, 0 without any."""
    return let(letters(c), lambda n: F.when(n > 0, _arabic_letters(_col(c)) / n).otherwise(0.0))


def language(c: str | Column) -> Column:
    def of(x: Column) -> Column:
        latin = x.rlike("[A-Za-z]")
        blank = F.coalesce(x, F.lit("")).rlike(r"^(?U)\s*$")
        return let(arabic_ratio(x), lambda r: F.when(blank, "unknown").when(r >= 0.65, "ar").when(r <= 0.10, F.when(latin, "en").otherwise("unknown")).otherwise("mixed"))

    return let(_col(c), of)


def same_script(a: str | Column, b: str | Column) -> Column:
    return let(F.struct(language(a).alias("x"), language(b).alias("y")), lambda s: (s["x"] != "unknown") & (s["y"] != "unknown") & ((s["x"] == s["y"]) | (s["x"] == "mixed") | (s["y"] == "mixed")))


def content_hash(*parts: str | Column) -> Column:
    """SHA-256 over the parts, each followed by a unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(_col(p).cast("string"), F.lit("")), F.lit("\x1f"))]), 256)


def short_hash(*parts: str | Column, n: int = 16) -> Column:
    return F.substring(content_hash(*parts), 1, n)


def document_key(company: str | Column, name: str | Column, text: str | Column) -> Column:
    return short_hash(company, name, content_hash(text), n=20)


def chunk_key(company: str | Column, document: str | Column, part: str | Column, text: str | Column) -> Column:
    return F.concat_ws(":", _col(company).cast("string"), _col(document), _col(part).cast("string"), short_hash(company, text, n=12))


def one_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def reversed_lines(c: str | Column) -> Column:
    return F.array_join(F.transform(F.split(_col(c), "\n"), F.reverse), "\n")


# Frequent Arabic function words.
MARKERS = ("في", "من", "على", "إلى", "التي", "الذي", "هذا", "هذه", "عن", "مع", "أو", "كل")


def _arabic_score(c: Column) -> Column:
    own = F.regexp_count(squeezed(c, "[^؀-ۿ]"), F.lit(" ال[^ ]"))
    for m in MARKERS:
        own = own + _times(c, f" {m} ")
    return own


def reversal(c: str | Column, least: int = 8) -> Column:
    """Struct of the verdict whether lines were stored back to front."""

    def told(is_reversed: Column, there: Column, back: Column, n: Column, sure: Column) -> Column:
        return F.struct(is_reversed.alias("is_reversed"), there.alias("forward_score"), back.alias("reversed_score"), n.alias("arabic_words"), sure.alias("confidence"))

    def verdict(s: Column, n: Column) -> Column:
        there, back = s["there"], s["back"]
        sure = F.when(there + back > 0, F.abs(there - back) / (there + back)).otherwise(0.0)
        return told((back > there) & (sure >= 0.5), there, back, n, sure)

    def scores(x: Column) -> Column:
        both = lambda: F.struct(_arabic_score(x).alias("there"), let(reversed_lines(x), _arabic_score).alias("back"))
        few = lambda n: told(F.lit(False), F.lit(0), F.lit(0), n, F.lit(0.0))
        return let(_times(squeezed(x, "[^؀-ۿ]"), " "), lambda n: F.when(n < least, few(n)).otherwise(let(both(), lambda s: verdict(s, n))))

    return let(_col(c), scores)


def repaired(c: str | Column) -> Column:
    return let(_col(c), lambda x: F.when(reversal(x)["is_reversed"], reversed_lines(x)).otherwise(x))


def repair_report(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text normalised and turned where it was stored back to front, and `report`: whether NFKC changed it, and the verdict."""
    d = bound(df.withColumn("_plain", nfkc(text)), _verdict=reversal("_plain"))
    fixed = F.when(F.col("_verdict")["is_reversed"], reversed_lines("_plain")).otherwise(F.col("_plain"))
    report = F.struct((F.col("_plain") != F.col(text)).alias("nfkc_applied"), F.col("_verdict").alias("reversal"))
    return d.withColumn("report", report).withColumn(text, fixed).drop("_plain", "_verdict")


# Punctuation that ordinary prose has.
PROSE_MARKS = r".,;:!?()\[\]{}\-–—'\"/%&@#*+=<>|~`^$_\\،؛؟٪٫٬٭«»‘’“”…"


def _visible(c: Column) -> Column:
    return left_of(c, r"(?U)\s")


def non_text_ratio(c: str | Column) -> Column:
    c = _col(c)
    bad = left_of(F.regexp_replace(c, r"[\t-\r -~]+", ""), rf"(?U)[\s\p{{L}}\p{{N}}{PROSE_MARKS}]")
    return let(_visible(c), lambda n: F.when(n > 0, bad / n).otherwise(0.0))


def quality(text: str | Column, pages: str | Column, pages_with_text: str | Column, headings: str | Column, least: int = 80) -> Column:
    """Struct of the extraction-quality checks of a document's whole text."""

    def measures(c: Column) -> Column:
        return F.struct(
            F.length(c).alias("chars"), letters(c).alias("letters"), _visible(c).alias("visible"), left_of(c, r"[^\p{L}\p{N}]").alias("alnum"),
            left_of(_high(c), r"[^ﭐ-﷿ﹰ-﻿]").alias("forms"), left_of(_high(c), r"[^�-]").alias("broken"), arabic_ratio(c).alias("arabic"), non_text_ratio(c).alias("filler"),
            let(squeezed(c, r"(?U)[^\w؀-ۿ]"), lambda s: let(_times(s, " "), lambda n: F.struct(n.alias("n"), (F.length(s) - n).alias("chars")))).alias("words"), reversal(c)["is_reversed"].alias("reversed"),
        )

    def rates(m: Column) -> Column:
        one = F.lit(1)
        return F.struct(
            m["chars"].alias("chars"), m["arabic"].alias("arabic"), m["filler"].alias("filler"), m["reversed"].alias("reversed"), m["words"]["n"].alias("words"), (m["alnum"] / F.greatest(m["visible"], one)).alias("alpha"),
            (m["forms"] / F.greatest(m["letters"], one)).alias("forms"), (m["broken"] / F.greatest(m["chars"], one)).alias("broken"), (m["words"]["chars"] / F.greatest(m["words"]["n"], one)).alias("mean"),
        )

    def checks(m: Column) -> Column:
        chars = m["chars"]
        few, partly = chars < least, (chars >= least) & (_col(pages_with_text) / F.greatest(_col(pages), F.lit(1)) < 0.5)
        unreadable, filler = (chars >= least) & (m["alpha"] < 0.30), m["filler"] > 0.30
        detached = (m["words"] > 0) & (m["mean"] < 1.8) & (m["arabic"] > 0.3)
        said = [
            (few, "no_text"), (partly, "partially_scanned"), (unreadable, "unusable_encoding"), (filler, "filler_glyphs"), (m["forms"] > 0.15, "presentation_forms"),
            (m["broken"] > 0.02, "broken_glyphs"), (detached, "detached_letters"), (m["reversed"], "reversed"), (_col(headings) == 0, "no_headings"),
        ]
        return F.struct(
            (~(few | unreadable | filler | detached)).alias("ok"), (few | partly | unreadable).alias("needs_ocr"), chars.alias("chars"), m["arabic"].alias("arabic_ratio"), m["alpha"].alias("alpha_ratio"),
            m["filler"].alias("non_text_ratio"), m["mean"].alias("mean_word_length"), F.array_compact(F.array(*[F.when(x, name) for x, name in said])).alias("problems"),
        )

    return let(let(let(_col(text), measures), rates), checks)


def phone(c: str | Column) -> Column:
    """Digits of a phone number; NULL for what has anything else."""
    bare = F.translate(_col(c), "+ -()", "")
    return F.when(bare.rlike("^[0-9]+$"), bare)


def redacted(c: str | Column) -> Column:
    """Credentials scrubbed: key shapes, bearer tokens, named secrets, authorization headers, in this order."""
    # The patterns and the replacement.
    gone = "***REDACTED***"
    out = F.regexp_replace(_col(c), r"sk-[A-Za-z0-9_\-]{8,}", gone)
    out = F.regexp_replace(out, r"ck-[A-Za-z0-9_\-]{8,}", gone)
    out = F.regexp_replace(out, r"(?i)(bearer\s+)\S{4,}", "$1" + gone)
    out = F.regexp_replace(out, r"(?i)((?:x-)?(?:chroma|anthropic|openai|cohere)?[_-]?(?:api[_-]?key|token|secret)\"?\s*[:=]\s*\"?)[A-Za-z0-9_\-.]{4,}", "$1" + gone)
    return F.regexp_replace(out, r"(?i)(authorization\"?\s*[:=]\s*\"?)\S{4,}", "$1" + gone)


def cited(c: str | Column) -> Column:
    """Numbers of [n] marks, distinct, as they first appear."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(c), F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))


def strip_invalid(c: str | Column, valid: Column) -> Column:
    """Marks that name no passage go with the blanks before them.

    The text is cut behind each mark; a piece loses its own mark if that is not valid.
    """
    parts = F.regexp_extract_all(F.concat(_col(c), F.lit("\x00")), F.lit(r"(?s)(.*?(?:\[\d{1,2}\]|\x00))"), F.lit(1))
    number = lambda p: F.regexp_extract(p, r"\[(\d{1,2})\]$", 1)
    kept = F.transform(parts, lambda p: F.when((number(p) != "") & ~F.array_contains(valid, F.try_to_number(number(p), F.lit("99")).cast("int")), F.regexp_replace(p, r"(?U)\s*\[\d{1,2}\]$", "")).otherwise(p))
    return F.trim(F.regexp_replace(F.translate(F.array_join(kept, ""), "\x00", ""), "[ \t]{2,}", " "))


def resolve_citations(marks: Column, passages: Column, keep_all: bool) -> Column:
    """Passages that valid marks name, in that order; none cited: all of them or none."""
    good = F.filter(marks, lambda i: (i >= 1) & (i <= F.size(passages)))
    return F.when(F.size(good) > 0, F.transform(good, lambda i: F.get(passages, i - 1))).otherwise(passages if keep_all else F.slice(passages, 1, 0))


def citation_label(path: Column, title: Column, origin: Column, page: Column) -> Column:
    head = F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, F.concat_ws(" > ", path)).otherwise(title)
    return F.concat_ws(" | ", F.nullif(head, F.lit("")), F.nullif(origin, F.lit("")), F.when(page > 0, F.concat(F.lit("page "), page.cast("string"))))


# Words that lean on the turn before.
REFERENTIAL = r"(?iU)\b(it|its|that|this|they|them|those|these|he|she|there)\b|(?:^|\s)(?:و|ال)?(?:ده|دي|دول|هو|هي|هم|كده|بتاعها|بتاعه|بتاعهم|ليها|ليه|فيها|فيه|عنها|عنه)(?:\s|$|؟)"


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(1))


def is_follow_up(c: str | Column) -> Column:
    return (F.size(words(c)) <= 3) | _col(c).rlike(REFERENTIAL)


def contextual_query(question: Column, previous: Column) -> Column:
    """A follow-up with up to 12 words (longer than 2) of the question before that it lacks."""
    have = F.transform(words(question), lambda w: F.lower(w))
    carried = let(have, lambda h: F.filter(words(previous), lambda w: (F.length(w) > 2) & ~F.array_contains(h, F.lower(w))))
    follows = previous.isNotNull() & is_follow_up(question)
    return let(carried, lambda c: F.when(follows & (F.size(c) > 0), F.concat(question, F.lit(" "), F.array_join(F.slice(c, 1, 12), " "))).otherwise(question))


def url_key(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(_col(c)), "/+$", ""))


def token_set(c: str | Column) -> Column:
    """Distinct lower-case tokens of the normalised text (NFKC beforehand)."""
    return F.array_distinct(words(F.lower(normalised(F.coalesce(_col(c), F.lit(""))))))


def infer_title(first_lines: Column, stem: Column) -> Column:
    """The first line of 3 to 120 characters without a final stop, else the file's stem."""
    good = F.filter(F.transform(first_lines, lambda x: F.trim(x)), lambda x: F.length(x).between(3, 120) & ~x.rlike("[.،]$"))
    return F.coalesce(F.get(good, F.lit(0)), F.translate(stem, "-_", "  "))
