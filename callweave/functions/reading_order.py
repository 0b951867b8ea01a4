"""Right-to-left lines whose words were stored as they are drawn, put into reading order.

A line is a row of tokens.  Each has a rank by its class: words come first, then the
dash before an amount, then the amount; inside a rank what was drawn last is read
first.  Sorting by (rank, place from the end) is the whole rule; what differs between
lines, and between the cells of a table, is only which tokens get which rank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Words that Arabic questions begin with; stops that may stand before a word; what an amount, a share of a cell and a turned minus sign look like.
STARTERS = ("هل", "ازاي", "إزاي", "ايه", "إيه", "ليه", "كيف", "ماذا", "ما", "كل")
STOPS = ":،؛!?؟."
AMOUNT = r"^\d[\d,./+%]*$"
SHARE = r"^(\d[\d,./]*)(?:%(.*)|\s+(.+?)%)$"
MINUS = (r"(?U)(?<!\w)-(\d+)\b", "$1-")
DASHES = "[-–]"
# What makes a line Arabic, and a row of a table; when lines are held to be turned (words a line, lines, ends, ends for each start, share of ends).
ARABIC, ROW = 0.65, 0.45
LEAST_WORDS, LEAST_LINES, LEAST_ENDS, TIMES, LEAST_SHARE = 4, 8, 3, 3, 0.15

WORD, DASH, LAST = 0, 1, 2


def tokens_of(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lines_of(c: Column) -> Column:
    return F.split(c, "\r\n|\r|\n")


def mended(token: Column) -> Column:
    """Stops in front go behind; a bracket at an end that it cannot open or close goes to the other end."""
    stops = F.regexp_extract(token, f"^[{STOPS}]*", 0)

    def turned(t: Column) -> Column:
        bare = F.regexp_replace(t, r"^\)|\($", "")
        return F.concat(F.when(t.endswith("("), "(").otherwise(""), bare, F.when(t.startswith(")"), ")").otherwise(""))

    ends = token.rlike(rf"^[{STOPS})]|\($")  # most tokens have nothing at their ends
    return F.when(ends, X.let(F.concat(F.substr(token, F.length(stops) + 1), stops), turned)).otherwise(token)


def read(ranked: Column) -> Column:
    """Text of tokens (rank, text) in reading order."""
    placed = F.transform(ranked, lambda t, i: F.struct(t["rank"].alias("rank"), (-i).alias("back"), t["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(placed), lambda t: t["text"]), " ")


def _ranked(tokens: Column, rank: int, mend: bool = True) -> Column:
    return F.transform(tokens, lambda w: F.struct(F.lit(rank).alias("rank"), (mended(w) if mend else w).alias("text")))


def word_order_reversed(c: str | Column) -> Column:
    """Whether Arabic lines hold their words from the wrong side: question words stand at their ends, not at their starts.

    Lines of few words, of other scripts and of tables have no say.
    """
    asks = lambda w: F.regexp_replace(w, "^[^؀-ۿ]+|[^؀-ۿ]+$", "").isin(*STARTERS).cast("int")
    votes = F.transform(lines_of(X._col(c)), lambda x: X.let(tokens_of(x), lambda w: F.struct(
        ((F.size(w) >= LEAST_WORDS) & (X.arabic_ratio(x) >= ARABIC) & ~x.contains("|")).alias("counts"),
        asks(F.try_element_at(w, F.lit(1))).alias("starts"), asks(F.try_element_at(w, F.lit(-1))).alias("ends"),
    )))
    total = lambda v, f: F.aggregate(v, F.lit(0), lambda s, x: s + F.coalesce(x[f], F.lit(0)))

    def verdict(v: Column) -> Column:
        n, starts, ends = F.size(v), total(v, "starts"), total(v, "ends")
        return (n >= LEAST_LINES) & (ends >= F.greatest(F.lit(LEAST_ENDS), TIMES * starts)) & (ends >= LEAST_SHARE * n)

    return X.let(F.filter(votes, lambda v: v["counts"]), verdict)


def repaired_word_order(c: str | Column) -> Column:
    """Arabic lines with their words the other way round, an amount in front read last and behind a dash; rows of tables, other lines and those that begin with a percentage stay."""

    def row(x: Column, w: Column) -> Column:
        first, rest = F.get(w, F.lit(0)), F.slice(w, 2, F.size(w))
        body = F.filter(F.transform(rest, lambda t, i: F.when(i == 0, F.regexp_replace(t, f"^{DASHES}", "")).otherwise(t)), lambda t: t != "")
        amount = first.rlike(AMOUNT) & x.startswith(first) & (X.arabic_ratio(F.array_join(rest, " ")) >= ARABIC)
        one = lambda rank, t: F.array(F.struct(F.lit(rank).alias("rank"), t.alias("text")))
        return read(F.when(amount, F.concat(_ranked(body, WORD), one(DASH, F.lit("-")), one(LAST, first))).otherwise(_ranked(w, WORD)))

    def line(x: Column) -> Column:
        def of(w: Column) -> Column:
            share, lead = X.arabic_ratio(x), F.get(w, F.lit(0))
            stays = (F.size(w) < 2) | (share < ARABIC) | x.contains("|") | (lead.rlike(AMOUNT) & lead.contains("%") & x.startswith(lead))
            return F.when(stays, x).otherwise(X.let(row(x, w), lambda r: F.when(r.contains("-"), F.regexp_replace(r, *MINUS)).otherwise(r)))

        return X.let(tokens_of(x), of)

    return F.array_join(F.transform(lines_of(X._col(c)), line), "\n")


def repaired_cell(c: str | Column) -> Column:
    """A right-to-left cell in reading order: a share keeps its sign, with its words (those in brackets, where it leads) turned; letters stored back to front are turned; else the tokens are."""

    def cell(x: Column) -> Column:
        amount, behind, between = (F.regexp_extract(x, SHARE, k) for k in (1, 2, 3))
        inside = F.regexp_extract(behind, r"\((.*?)\)", 1)
        words = lambda t: read(_ranked(tokens_of(t), WORD, mend=False))
        leads = F.when(behind.rlike(r"\(.*?\)"), F.concat(amount, F.lit("% ("), words(inside), F.lit(")"))).otherwise(x)
        share = F.when(between != "", F.concat(words(between), F.lit(" "), amount, F.lit("%"))).otherwise(leads)
        return F.when(x.rlike(SHARE), share).when(X.reversal(x, 2)["is_reversed"], X.reversed_lines(x)).otherwise(read(_ranked(tokens_of(x), WORD)))

    return X.let(X._col(c), cell)
