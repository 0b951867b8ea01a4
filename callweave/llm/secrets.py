"""Secret scan: all rules in one byte pass of a combined deterministic automaton."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Scanner
from .common import arrow_map, id_in, id_out, text_bytes

SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """A match is head + tail; it counts if the tail has at least min_tail bytes.

    Where every match of the head leaves the tail's length to the rest of the
    expression alone, put the bound into the tail itself: the scan then does not
    stop at matches that fail.
    """

    kind: str
    head: str
    tail: str
    min_tail: int = 1
    ignore_case_head: bool = False


# The kinds every scan reports, in this order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", r"AKIA", r"[A-Z0-9]{16,}"),
    Rule("hex", r"", r"[0-9a-f]{24,}"),
)
#: Further well-known credential shapes.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", r""),
    Rule("forge", r"gh[opsu]_", r"[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _folded(head: str) -> str:
    """Letters of the head in either case, those of the tail as they stand."""
    out, depth, k = [], 0, 0
    while k < len(head):
        c = head[k]
        if c == "\\":
            n = 4 if head[k + 1] == "x" else 2
            out.append(head[k : k + n])
            k += n
            continue
        depth += (c == "[") - (c == "]")
        out.append(f"[{c.lower()}{c.upper()}]" if c.isalpha() and not depth else c)
        k += 1
    return "".join(out)


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Scanner, Scanner]:
    heads = [_folded(r.head) if r.ignore_case_head else r.head for r in rules]
    return Scanner([(h + r.tail, False) for h, r in zip(heads, rules, strict=True)]), Scanner([(h, False) for h in heads])


def scan_bytes(data: bytes, rules: tuple[Rule, ...], both: tuple[Scanner, Scanner]) -> list[dict]:
    """Spans of one text in code points."""
    scanner, heads = both
    spans, at, points = [], 0, 0
    for start, end, r in scanner.matches(data):
        tail = end - max(start, heads.longest(r, data, start)) if rules[r].min_tail > 1 else 1
        if tail >= rules[r].min_tail:
            points += len(data[at:start].decode("utf-8", "replace"))
            at = start
            spans.append({"kind": rules[r].kind, "start": points, "end": points + len(data[start:end].decode("utf-8", "replace"))})
    return spans


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, spans) for every row; spans are (kind, start, end) in code points, by start and then by rule.

    Per rule the leftmost-longest, non-overlapping matches; one that fails its
    bound is dropped but still covers its text.  Null and empty texts have no
    spans, a null id stays null, repeated rows are scanned each, other columns
    are ignored.  No shuffle: one pass, one row out for each row in.
    """
    both = compiled(rules)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "spans": [scan_bytes(t, rules, both) for t in pdf["text"]]})

    return id_out(arrow_map(df.select(id_in(id_col), text_bytes(text_col).alias("text")), run, f"doc_id long, spans {SPANS}"))


def digest(spans: DataFrame) -> DataFrame:
    """The per-kind counts and digests of scan_secrets' result."""
    base = F.array(*[F.lit(r.kind) for r in BASE_RULES])
    said = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = F.array_join(F.transform(F.filter("spans", lambda s: F.array_contains(base, s["kind"])), said), ",")
    return spans.select(
        "doc_id",
        *[of(r.kind) for r in BASE_RULES],
        F.sha2(joined, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )
