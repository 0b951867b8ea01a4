"""HTML pages to titled sections: a page's elements as a flat table, and rules over it as columns.

The parser of the standard library lists a page's elements in document order, each
with the number of its last descendant and the runs of text inside it; what an
element inherits from those that are open around it (noise, a list or table) is told
on the way, and the ids that attributes name are resolved at the end.  What is inside
an element is then a slice of the list, and main content, components, headings and
paths are array expressions on the page's row, computed in the JVM without a shuffle,
at a cost that grows with the page and no faster.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Tags that hold no content, with all below them.
DROP = ("script", "style", "noscript", "template", "svg", "iframe", "object", "embed", "canvas", "link", "meta", "form", "input", "select", "textarea", "nav", "footer", "header", "aside")
# Parts of classes and ids of page furniture.
CHROME = (
    "navigation", "nav-item", "nav-chevron", "navbar", "megamenu", "mega-menu", "footer", "cookie", "consent", "breadcrumb", "skip-link", "search-overlay", "language-switcher",
    "switcher-link", "social-links", "back-to-top", "portlet-topper", "control-menu", "banner-ad", "advertisement", "js-navigation", "site-header", "site-footer", "modal-backdrop",
    "cloned", "save-articles", "user-preferences", "newsletter-signup",
)
CHROME_ROLES = ("navigation", "banner", "contentinfo", "search", "menubar", "menu")
# What hints at a component, where its label is, and which attributes name its panel.
CONTENT_HINTS = ("accordion-title", "js-collapser", "card-collapsing", "accordion-item", "js-accordion-item", "faq", "collapsible")
NAV_HINTS = ("navigation", "nav-item", "menu", "switcher", "footer")
LABELS = ("accordion-title-heading", "card-title", "tab-label")
TARGETS = ("aria-controls", "data-target", "data-bs-target", "href")
# Tags without an end, headings, text blocks, and blocks that are rendered whole.
VOID = ("area", "base", "br", "col", "hr", "img", "wbr", "source", "track", "param", "input", "link", "meta", "embed")
HEADS = ("h1", "h2", "h3", "h4")
ALL_HEADS = (*HEADS, "h5", "h6")
CONTENT = ("p", "li", "td", "th", "dd", "dt", "figcaption", "blockquote", "pre")
BLOCKS = ("table", "ul", "ol", "dl")
#: Headings that are folded at a time.
BLOCK = 256
#: Elements that end where another of the second names begins, unless one of the third lies between.
IMPLIED = {
    "p": ({"p"}, {"div", "section", "article", "body", "td", "li", "main"}), "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
}

#: n .. till: an element and what is below it; words since .. upto: the text inside; gone: noise or inside it; held: inside a list or table; panel: the element that it names, or -1.
ELEMENT = "n:int,till:int,up:int,since:int,upto:int,tag:string,attrs:map<string,string>,gone:boolean,held:boolean,panel:int"
SCHEMA = "page_id long, section_index int, section_title string, section_path array<string>, heading_level int, text string, extraction_method string, component_type string, anchor_id string"


def _noise(tag: str, attrs: dict[str, str]) -> bool:
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return tag in DROP or attrs.get("role", "").lower() in CHROME_ROLES or attrs.get("aria-hidden") == "true" or any(part in named for part in CHROME)


class _Lister(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, 0, -1, 0, 0, "[document]", {}, False, False, -1]]
        self.words: list[str] = []
        self.open = [0]
        self.ids: dict[str, int] = {}

    def _shut(self, depth: int) -> None:
        for n in self.open[depth:]:
            self.rows[n][1], self.rows[n][4] = len(self.rows), len(self.words)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        ends, walls = IMPLIED.get(tag, ((), ()))
        depth = len(self.open)
        for at in range(depth - 1, 0, -1) if ends else ():
            name = self.rows[self.open[at]][5]
            if name in walls:
                break
            depth = at if name in ends else depth
        self._shut(depth)
        n, own, over = len(self.rows), {k: v or "" for k, v in attrs}, self.rows[self.open[-1]]
        gone = over[7] or _noise(tag, own)
        self.rows.append([n, n + 1, over[0], len(self.words), len(self.words), tag, own, gone, over[8] or over[5] in BLOCKS, -1])
        if own.get("id") and not gone:
            self.ids.setdefault(own["id"], n)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.rows[self.open[k]][5] == tag), None)
        if at is not None:
            self._shut(at)

    def handle_data(self, data):
        if not self.rows[self.open[-1]][7] and (said := unicodedata.normalize("NFKC", data).strip()):
            self.words.append(said)

    def finish(self) -> None:
        """Close what is open, and find for each element the first of its target attributes that names another one outside it."""
        self.close()
        self._shut(0)
        for row in self.rows:
            for name in TARGETS:
                value = row[6].get(name, "").strip(" ")
                aim = self.ids.get(value.lstrip("#")) if name != "href" or (value[:1] == "#" and value[1:]) else None
                if aim is not None and not row[0] <= aim < row[1]:
                    row[9] = aim
                    break


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, elements, words, ends): each page's elements in document order, number 0 the document; its runs of text that are no noise, and how many characters stand before each."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0] for f in ELEMENT.replace("map<string,string>", "map").split(",")]
        for pdf in it:
            for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
                lister = _Lister()
                lister.feed(html or "")
                lister.finish()
                ends = list(accumulate((len(w) + 1 for w in lister.words), initial=0))
                rows = [(page, [dict(zip(names, r, strict=True)) for r in lister.rows], lister.words, ends)]
                yield pd.DataFrame(rows, columns=["page_id", "elements", "words", "ends"])

    return pages.select("page_id", "html").mapInPandas(run, f"page_id long, elements array<struct<{ELEMENT}>>, words array<string>, ends array<int>")


# --- rules ---------------------------------------------------------------------------------------


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _attr(e: str, name: str) -> str:
    return f"coalesce({e}.attrs['{name}'], '')"


def _classes(e: str) -> str:
    return f"lower(concat({_attr(e, 'class')}, ' ', {_attr(e, 'id')}))"


def _has_class(e: str, name: str) -> str:
    return f"array_contains(split({_attr(e, 'class')}, '\\\\s+'), '{name}')"


def _hints(text: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in names) + ")"


def _below(e: str) -> str:
    """The elements inside an element."""
    return f"filter(slice(elements, {e}.n + 2, {e}.till - {e}.n - 1), x -> NOT x.gone)"


def _text(e: str, glue: str = " ") -> str:
    return f"array_join(slice(words, {e}.since + 1, {e}.upto - {e}.since), '{glue}')"


def _length(e: str) -> str:
    """Characters of an element's text."""
    return f"greatest(0, ends[{e}.upto] - ends[{e}.since] - 1)"


def _with_components(d: DataFrame) -> DataFrame:
    """`comps`: controls whose panel of real text scores 0.6 or more; a panel belongs to its first control."""
    control = f"(map_contains_key(c.attrs, '{TARGETS[0]}') OR map_contains_key(c.attrs, '{TARGETS[1]}') OR map_contains_key(c.attrs, '{TARGETS[2]}') OR ({_attr('c', 'role')} IN ('tab', 'button') AND map_contains_key(c.attrs, 'href')))"
    d = X.bound(d, controls=f"filter(live, c -> c.panel >= 0 AND {control} AND NOT {_hints(_classes('c'), NAV_HINTS)})")
    labels = ", ".join(f"try_element_at(filter(transform(filter({_below('c')}, e -> {_has_class('e', cls)}), e -> {_text('e')}), t -> t <> ''), 1)" for cls in LABELS)
    d = X.bound(d, tried=f"transform(controls, c -> struct(c.n, c.till, c.tag, c.attrs, coalesce({labels}, {_text('c')}) AS label, elements[c.panel] AS panel))")
    d = X.bound(d, paired=f"transform(filter(tried, c -> length(c.label) BETWEEN 3 AND 200), c -> struct(c.n, c.till, c.tag, c.attrs, c.label, c.panel, {_text('c.panel')} AS body, ({_attr('c.panel', 'role')} = 'tabpanel' OR {_attr('c', 'role')} = 'tab') AS tab))")
    score = f"""0.4D + if({_hints(f"lower({_attr('c', 'class')})", CONTENT_HINTS)}, 0.3D, 0) + if(c.tag IN ({_quoted(ALL_HEADS)}), 0.2D, 0) + if(map_contains_key(c.attrs, 'aria-controls'), 0.1D, 0) + if(map_contains_key(c.attrs, 'aria-expanded'), 0.05D, 0)
        + if({_attr('c.panel', 'aria-labelledby')} <> '' AND {_attr('c.panel', 'aria-labelledby')} = {_attr('c', 'id')}, 0.15D, 0) + if(c.tab, 0.05D, 0) + if(length(c.body) > 200, 0.05D, 0)"""
    real = "length(c.body) >= 60 AND NOT (contains(left(c.body, length(c.label) + 5), c.label) AND length(c.body) < 2 * length(c.label))"
    d = X.bound(d, good=f"filter(paired, c -> {real} AND round({score}, 6) >= 0.6D)")
    d = X.bound(d, panels="transform(good, c -> c.panel.n)")
    d = X.bound(d, comps=f"transform(filter(good, (c, i) -> array_position(panels, c.panel.n) = i + 1), c -> struct(c.n, c.till, c.label, c.panel, if(c.tab, 'tab', 'accordion') AS kind, {_attr('c.panel', 'id')} AS anchor))")
    # a heading belongs to the outermost control around it: those are disjoint, and their numbers are laid out by element
    d = X.bound(d, tops="aggregate(comps, slice(comps, 1, 0), (s, c) -> if(size(s) = 0 OR c.n >= element_at(s, -1).till, concat(s, array(c)), s))")
    laid = "transform(tops, (c, i) -> concat(array_repeat(-1, c.n - if(i = 0, 0, tops[i - 1].till)), array_repeat(i, c.till - c.n)))"
    return X.bound(d, top_at=f"if(size(tops) = 0, array(), flatten({laid}))")


def _with_root(d: DataFrame) -> DataFrame:
    """`root`, its number and its last descendant's: the body, or the first candidate of over 35 % of its text and 200 characters, then only longer ones."""
    tests = (
        "e.tag = 'main'", f"{_attr('e', 'role')} = 'main'", f"{_attr('e', 'id')} = 'main-content'", f"{_attr('e', 'id')} = 'content'",
        _has_class("e", "journal-content-article"), _has_class("e", "portlet-content-container"), "e.tag = 'article'",
    )
    d = X.bound(d, found="concat(" + ", ".join(f"filter(live, e -> {t})" for t in tests) + ")")
    d = X.bound(d, low="array_min(transform(found, f -> f.n))", high="array_max(transform(found, f -> f.till))")
    shared = "slice(reverse(filter(live, e -> e.n <= low AND e.till >= high)), 1, if(size(found) > 1, 1, 0))"
    d = X.bound(d, tried_roots=f"transform(concat(found, {shared}), e -> struct(e.n, e.till, {_length('e')} AS chars))", body="slice(concat(filter(live, e -> e.tag = 'body'), live), 1, 1)")
    start = f"struct(body[0].n AS n, body[0].till AS till, {_length('body[0]')} AS chars, false AS chosen)"
    better = "e.chars > 0.35D * s.chars AND e.chars > 200 AND (NOT s.chosen OR e.chars > s.chars)"
    return X.bound(d, root=f"aggregate(tried_roots, {start}, (s, e) -> if({better}, struct(e.n AS n, e.till AS till, e.chars AS chars, true AS chosen), s), s -> array(s.n, s.till))")


def _with_blocks(d: DataFrame) -> DataFrame:
    """`blocks`: headings and rendered text inside the root, in order; `level` is null for text."""
    d = X.bound(d, picked=f"filter(live, e -> e.tag IN ({_quoted(ALL_HEADS + CONTENT + BLOCKS)}) AND e.n > root[0] AND e.n < root[1])")
    d = X.bound(d, chosen=f"filter(picked, e -> e.tag NOT IN ({_quoted(CONTENT)}) OR NOT e.held)", small=f"NOT exists(picked, e -> e.tag IN ({_quoted(HEADS)}))")
    cells = f"filter(transform(filter({_below('r')}, c -> c.tag IN ('td', 'th')), c -> {_text('c')}), t -> t <> '')"
    table = f"array_join(filter(transform(filter({_below('e')}, r -> r.tag = 'tr'), r -> array_join({cells}, ' | ')), t -> t <> ''), '\\n')"
    items = f"array_join(transform(filter(transform(filter({_below('e')}, i -> i.tag = 'li' AND i.up = e.n), i -> {_text('i')}), t -> t <> ''), t -> concat('- ', t)), '\\n')"
    said = f"CASE WHEN e.tag = 'table' THEN {table} WHEN e.tag IN ('ul', 'ol') THEN {items} ELSE {_text('e')} END"
    head = f"e.tag IN ({_quoted(HEADS)}) OR (small AND e.tag IN ({_quoted(ALL_HEADS)}))"
    return X.bound(d, blocks=f"transform(chosen, e -> struct(e.n, if({head}, cast(right(e.tag, 1) AS int), NULL) AS level, {said} AS said))")


def _tidy(c: Column) -> Column:
    return X.normalised(c)


def _sections(d: DataFrame) -> DataFrame:
    """`sections` of each page: a heading's text reaches to the next heading, its path is the headings that reign there."""
    level = "struct(b.n, b.level, i AS at, b.said)"
    d = X.bound(d, marks=f"filter(transform(blocks, (b, i) -> {level}), b -> b.level IS NOT NULL)")
    titled = F.transform("marks", lambda m: F.struct(m["n"].alias("n"), m["level"].alias("level"), m["at"].alias("at"), _tidy(m["said"]).alias("title")))
    d = X.bound(d, titled=titled)
    d = X.bound(d, spans="transform(titled, (m, i) -> struct(m.n, m.level, m.title, m.title <> '' AND length(m.title) <= 250 AS valid, slice(blocks, m.at + 2, coalesce(try_element_at(titled, i + 2).at, size(blocks)) - m.at - 1) AS below))")
    d = X.bound(d, valid="filter(spans, m -> m.valid)")
    # the headings above each one: a stack whose levels grow, folded over blocks of headings so that no long array is copied for each
    none, stack = "cast(array() AS array<array<string>>)", "concat(filter(t.stack, h -> h.level < m.level), array(struct(m.level AS level, m.title AS title)))"
    push = f"transform(array({stack}), s -> struct(s AS stack, concat(t.paths, array(transform(s, h -> h.title))) AS paths))[0]"
    block = f"aggregate(b, struct(s.stack AS stack, {none} AS paths), (t, m) -> {push})"
    fold = f"transform(array({block}), r -> struct(r.stack AS stack, concat(s.paths, array(r.paths)) AS paths))[0]"
    blocks = f"transform(sequence(0, (size(valid) - 1) div {BLOCK}), k -> slice(valid, k * {BLOCK} + 1, {BLOCK}))"
    start = "struct(cast(array() AS array<struct<level:int,title:string>>) AS stack, cast(array() AS array<array<array<string>>>) AS paths)"
    d = X.bound(d, paths=f"if(size(valid) = 0, {none}, flatten(aggregate({blocks}, {start}, (s, b) -> {fold}, s -> s.paths)))")
    join = lambda below: _tidy(F.array_join(F.filter(F.transform(below, lambda b: b["said"]), lambda t: t != ""), "\n"))
    null = lambda t: F.lit(None).cast(t)

    def row(title, path, depth, text, method, kind, anchor) -> Column:
        return F.struct(title.alias("section_title"), path.alias("section_path"), depth.cast("int").alias("heading_level"), text.alias("text"), method.alias("extraction_method"), kind.alias("component_type"), anchor.alias("anchor_id"))

    def of_heading(m: Column, k: Column) -> Column:
        comp = F.get("tops", F.get("top_at", m["n"]))
        return X.let(comp, lambda c: row(m["title"], F.get("paths", k), m["level"], join(m["below"]), F.when(c.isNotNull(), "html_component").otherwise("html_structure"), c["kind"], c["anchor"]))

    long = lambda least: lambda s: F.length(s["text"]) >= least
    d = X.bound(d, own=F.filter(F.transform("valid", of_heading), long(F.col("least"))))
    # text under no heading: before the first one, and under those that are no titles
    loose = F.concat(F.slice("blocks", F.lit(1), F.coalesce(F.get("titled", F.lit(0))["at"], F.size("blocks"))), F.flatten(F.transform(F.filter("spans", lambda m: ~m["valid"]), lambda m: m["below"])))
    rest = row(null("string"), null("array<string>"), null("int"), join(loose), F.lit("no_section"), null("string"), null("string"))
    apart = F.filter("comps", lambda c: ~((c["panel"]["n"] >= F.get("root", F.lit(0))) & (c["panel"]["n"] < F.get("root", F.lit(1)))))
    panel = lambda c: F.array_join(F.slice("words", c["panel"]["since"] + 1, c["panel"]["upto"] - c["panel"]["since"]), "\n")
    outside = F.transform(apart, lambda c: X.let(_tidy(c["label"]), lambda label: row(label, F.array(label), null("int"), _tidy(panel(c)), F.lit("html_component"), c["kind"], c["anchor"])))
    everything = F.concat(F.col("own"), F.when(F.size("own") == 0, F.array(rest)).otherwise(F.slice(F.array(rest), 1, 0)), outside)
    return d.select("page_id", F.filter(everything, long(F.col("least"))).alias("sections"))


def _fallback(c: Column, least: int) -> Column:
    """Titled sections of plain, tidied text; a title is a short line without a stop before a long one."""

    def of(lines: Column) -> Column:
        def is_title(line: Column, i: Column) -> Column:
            following = F.get(lines, i + 1)
            return F.length(line).between(3, 80) & ~line.rlike(r"^[-•*0-9]") & ~line.rlike(r"[.!؟?،,;]$") & (F.size(F.split(line, r"(?U)\s+")) <= 10) & (F.coalesce(F.length(following), F.lit(0)) >= 40)

        def cut(marked: Column) -> Column:
            titles = F.filter(marked, lambda m: m["title"])
            end = lambda k: F.coalesce(F.get(titles, k + 1)["at"], F.size(marked))
            text = lambda m, k: _tidy(F.array_join(F.filter(F.transform(F.slice(marked, m["at"] + 2, end(k) - m["at"] - 1), lambda b: b["line"]), lambda t: t != ""), "\n"))
            return F.filter(F.transform(titles, lambda m, k: F.struct(X.stripped(F.regexp_replace(m["line"], "[:：]+$", "")).alias("title"), text(m, k).alias("text"))), lambda s: (F.length(s["text"]) >= least) & (s["title"] != ""))

        return X.let(F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("at"), is_title(line, i).alias("title"))), cut)

    return X.let(F.filter(F.split(c, "\n"), lambda line: line != ""), of)


def page_sections(pages: DataFrame, least: int = 40) -> DataFrame:
    """One row for each section of each page (page_id, html, and `fallback` text for pages without any, if there is such a column).

    Null and empty pages have no sections.  A page's whole row is one task's work, at
    a cost in proportion to its elements (times the depth to which tables, lists or
    labelled controls are nested).
    """
    rich = pages if "fallback" in pages.columns else pages.withColumn("fallback", F.lit(None).cast("string"))
    bare = F.coalesce(F.col("html"), F.lit("")) == "" if least > 0 else F.lit(False)  # a page without html has no element to look at
    d = elements(rich.where(~bare)).withColumn("least", F.lit(least))
    found = _sections(_with_blocks(_with_root(_with_components(X.bound(d, live="filter(elements, e -> NOT e.gone)")))))
    shape = F.lit(None).cast("string")
    said = rich.select("page_id", bare.alias("bare"), "fallback").where(F.col("fallback").rlike(r"(?U)\S")).withColumn("fallback", X.nfkc("fallback"))
    plain = X.bound(X.bound(said, tidy=_tidy(F.col("fallback"))), cut=_fallback(F.col("tidy"), least))
    row = lambda title, text, method: F.struct(title.alias("section_title"), F.when(title.isNotNull(), F.array(title)).alias("section_path"), F.when(title.isNotNull(), 1).alias("heading_level"), text.alias("text"), F.lit(method).alias("extraction_method"), shape.alias("component_type"), shape.alias("anchor_id"))
    whole = F.array(row(shape, F.col("tidy"), "no_section"))
    plain = plain.select("page_id", "bare", F.when(F.size("cut") > 0, F.transform("cut", lambda s: row(s["title"], s["text"], "text_fallback"))).otherwise(whole).alias("plain"))
    sections = F.col("sections")
    if "fallback" in pages.columns:
        beside = found.join(plain.where("NOT bare").drop("bare"), "page_id", "left")
        found = beside.select("page_id", F.when(F.size("sections") > 0, sections).otherwise(F.col("plain")).alias("sections")).unionByName(plain.where("bare").select("page_id", F.col("plain").alias("sections")))
    return found.select("page_id", F.posexplode(sections).alias("section_index", "s")).select("page_id", "section_index", "s.*")
