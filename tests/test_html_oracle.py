"""HTML sections against a plain walk over a tree, on random pages with nested noise, tabs, tables and fallback texts."""

import random
import time
import unicodedata
from html.parser import HTMLParser

import pytest
from callweave.operators import html_sections as H
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa ﬁne".split()


class Node:
    def __init__(self, tag, attrs, over):
        self.tag, self.attrs, self.over, self.kids = tag, attrs, over, []

    def walk(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def runs(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.runs()
            elif said := unicodedata.normalize("NFKC", k).strip():
                yield said

    def text(self, glue=" "):
        return glue.join(self.runs())

    def around(self):
        k = self.over
        while k:
            yield k
            k = k.over


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("[document]", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        ends, walls = H.IMPLIED.get(tag, ((), ()))
        k, shut = self.at, None
        while k.over and k.tag not in walls:
            shut = k if k.tag in ends else shut
            k = k.over
        self.at = shut.over if shut else self.at
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(new)
        self.at = self.at if tag in H.VOID else new

    def handle_endtag(self, tag):
        k = self.at
        while k.over and k.tag != tag:
            k = k.over
        self.at = k.over or self.at

    def handle_data(self, data):
        self.at.kids.append(data)


def strip(node):
    def noise(k):
        named = (k.attrs.get("class", "") + " " + k.attrs.get("id", "")).lower()
        return k.tag in H.DROP or k.attrs.get("role", "").lower() in H.CHROME_ROLES or k.attrs.get("aria-hidden") == "true" or any(c in named for c in H.CHROME)

    node.kids = [k for k in node.kids if not (isinstance(k, Node) and noise(k))]
    for k in node.kids:
        if isinstance(k, Node):
            strip(k)


def tidy(text):
    lines = [" ".join(x for x in line.replace("\t", " ").split(" ") if x).strip() for line in text.replace("\r\n", "\n").split("\n")]
    out = "\n".join(lines)
    while "\n\n\n" in out:
        out = out.replace("\n\n\n", "\n\n")
    return out.strip()


def components(top):
    ids, found, taken = {}, [], set()
    for k in top.walk():
        ids.setdefault(k.attrs.get("id", ""), k)
    ids.pop("", None)
    for c in top.walk():
        a = c.attrs
        if not (any(t in a for t in H.TARGETS[:3]) or (a.get("role") in ("tab", "button") and "href" in a)):
            continue
        if any(h in f"{a.get('class', '')} {a.get('id', '')}".lower() for h in H.NAV_HINTS):
            continue
        panel = None
        for t in H.TARGETS:
            value = a.get(t, "").strip(" ")
            if t == "href" and not (value.startswith("#") and len(value) > 1):
                continue
            p = ids.get(value.lstrip("#"))
            if p is not None and p is not c and c not in p.around():
                panel = p
                break
        if panel is None:
            continue
        own = [k.text() for name in H.LABELS for k in c.walk() if name in k.attrs.get("class", "").split() and k.text()]
        label, body = own[0] if own else c.text(), panel.text()
        if not 3 <= len(label) <= 200 or len(body) < 60 or (label in body[: len(label) + 5] and len(body) < 2 * len(label)):
            continue
        tab = panel.attrs.get("role") == "tabpanel" or a.get("role") == "tab"
        by = panel.attrs.get("aria-labelledby", "")
        score = 0.4 + 0.3 * any(h in a.get("class", "").lower() for h in H.CONTENT_HINTS) + 0.2 * (c.tag in H.ALL_HEADS) + 0.1 * ("aria-controls" in a) + 0.05 * ("aria-expanded" in a)
        score += 0.15 * (by != "" and by == a.get("id", "")) + 0.05 * tab + 0.05 * (len(body) > 200)
        if round(score, 6) >= 0.6 and panel not in taken:
            taken.add(panel)
            found.append((c, panel, label, "tab" if tab else "accordion"))
    return found


def root_of(top):
    every = [top, *top.walk()]
    has = lambda name: lambda k: name in k.attrs.get("class", "").split()
    tests = [lambda k: k.tag == "main", lambda k: k.attrs.get("role") == "main", lambda k: k.attrs.get("id") == "main-content", lambda k: k.attrs.get("id") == "content", has("journal-content-article"), has("portlet-content-container"), lambda k: k.tag == "article"]
    found = [k for t in tests for k in every if t(k)]
    if len(found) > 1:
        line = [found[0], *found[0].around()]
        found.append(next(k for k in line if all(f is k or k in f.around() for f in found)))
    best, chosen = next((k for k in every if k.tag == "body"), top), False
    for k in found:
        if len(k.text()) > 0.35 * len(best.text()) and len(k.text()) > 200 and (not chosen or len(k.text()) > len(best.text())):
            best, chosen = k, True
    return best


def said(e):
    if e.tag == "table":
        rows = (" | ".join(c.text() for c in r.walk() if c.tag in ("td", "th") and c.text()) for r in e.walk() if r.tag == "tr")
        return "\n".join(r for r in rows if r)
    if e.tag in ("ul", "ol"):
        return "\n".join(f"- {i.text()}" for i in e.kids if isinstance(i, Node) and i.tag == "li" and i.text())
    return e.text()


def fallback(text, least):
    lines = tidy(unicodedata.normalize("NFKC", text)).split("\n")
    full = [x for x in lines if x]
    title = lambda k: 3 <= len(full[k]) <= 80 and full[k][0] not in "-•*0123456789" and full[k][-1] not in ".!؟?،,;" and len(full[k].split()) <= 10 and k + 1 < len(full) and len(full[k + 1]) >= 40
    at = [k for k in range(len(full)) if title(k)]
    cut = [(full[a].rstrip(":：").strip(), tidy("\n".join(full[a + 1 : b]))) for a, b in zip(at, [*at[1:], len(full)], strict=False)]
    return [(t, x) for t, x in cut if t and len(x) >= least]


def sections(html, other, least=40):
    top = Tree(html or "").top
    strip(top)
    comps, root = components(top), root_of(top)
    picked = [k for k in root.walk() if k.tag in (*H.ALL_HEADS, *H.CONTENT, *H.BLOCKS)]
    heads = H.HEADS if any(k.tag in H.HEADS for k in picked) else H.ALL_HEADS
    picked = [k for k in picked if k.tag not in H.CONTENT or not any(u.tag in H.BLOCKS for u in k.around())]
    out, stack, loose, now = [], [], [], None
    for k in picked:
        if k.tag in heads:
            title, level = tidy(k.text()), int(k.tag[1])
            if not title or len(title) > 250:
                now = loose
                continue
            stack = [*[x for x in stack if x[0] < level], (level, title)]
            inside = next((c for c in comps if c[0] is k or c[0] in k.around()), None)
            now = []
            out.append((title, [t for _, t in stack], level, now, "html_component" if inside else "html_structure", inside and inside[3], inside and inside[1].attrs.get("id", "")))
        else:
            (loose if now is None else now).append(said(k))
    glue = lambda parts: tidy("\n".join(p for p in parts if p))
    rows = [(t, p, lv, glue(b), m, k, a) for t, p, lv, b, m, k, a in out if len(glue(b)) >= least]
    if not rows:
        rows = [(None, None, None, glue(loose), "no_section", None, None)]
    for _, panel, label, kind in comps:
        if panel is not root and root not in panel.around():
            rows.append((tidy(label), [tidy(label)], None, tidy(panel.text("\n")), "html_component", kind, panel.attrs.get("id", "")))
    rows = [r for r in rows if len(r[3]) >= least]
    if not rows and other and other.strip():
        cut = fallback(other, least)
        rows = [(t, [t], 1, x, "text_fallback", None, None) for t, x in cut] or [(None, None, None, tidy(unicodedata.normalize("NFKC", other)), "no_section", None, None)]
    return [(k, *r) for k, r in enumerate(rows)]


def _pages(seed, n):
    rng = random.Random(seed)
    t = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))

    def node(d):
        k = rng.randrange(15)
        if d == 0 or k < 3:
            return f"<p>{t(rng.randrange(1, 15))}</p>"
        some = lambda m: "".join(node(d - 1) for _ in range(m))
        if k == 3:
            level = rng.randrange(1, 7)
            return f"<h{level}>{t(rng.choice([0, 1, 3, 3, 70]))}</h{level}>{some(2)}"
        if k == 4:
            return "<ul>" + "".join(f"<li>{t(3)}{node(d - 1) if rng.random() < 0.2 else ''}" for _ in range(3)) + "</ul>"
        if k == 5:
            return f"<table><tr><th>{t(1)}</th><td>{node(d - 1)}</td></tr><tr><td>{t(2)}<td>{t(1)}</table>"
        if k == 6:
            return f"<nav>{some(1)}<div class='footer x'>{some(1)}</div></nav>"
        if k == 7:
            return f"<div class='cookie-bar'>{some(1)}<p aria-hidden=true>{t(3)}</p></div>{t(2)}"
        if k == 8:
            i = rng.randrange(6)
            role = rng.choice(["tab", "button", ""])
            return f"<button id=b{i} aria-controls='p{i}' class='accordion-title' role='{role}'><span class='card-title'>{t(2)}</span></button><div id='p{i}' aria-labelledby=b{i} role='{rng.choice(['tabpanel', ''])}'>{t(20)}{some(1)}</div>"
        if k == 9:
            return f"<h3 class='faq' aria-controls='p{rng.randrange(6)}'>{t(3)}</h3>{some(1)}"
        if k == 10:
            return f"<a role=tab href='#p{rng.randrange(6)}'>{t(2)}</a><div data-target='#p{rng.randrange(6)}' class=faq>{some(1)}</div>"
        if k == 11:
            return f"<main>{some(4)}</main>"
        if k == 12:
            return f"<article id='{rng.choice(['content', 'x', ''])}'>{some(2)}</article>"
        if k == 13:
            return f"<dl><dt>{t(1)}<dd>{t(12)}</dl><br><img alt=x></p></b>"
        return f"<div>{some(2)}{t(2)}</div>"

    texts = [None, "", "  ", lambda: f"Head line\n\n{t(30)}\n- b\nNext: \n\n{t(20)}\n\n\n{t(9)}", lambda: t(5)]
    html = [None, "", "plain text only", *("<html><body>" + "".join(node(4) for _ in range(rng.randrange(1, 12))) + "</body></html>" for _ in range(n - 3))]
    html += [f"<nav>{t(50)}</nav><p>{t(2)}</p>"] * 12
    return [(k, h, x() if callable(x := rng.choice(texts)) else x) for k, h in enumerate(html)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sections_equal_a_plain_walk(spark, seed):
    pages = _pages(seed, 150)
    rows = H.page_sections(spark.createDataFrame(pages, "page_id long, html string, fallback string")).orderBy("page_id", "section_index").collect()
    got = {k: [] for k, _, _ in pages}
    for r in rows:
        got[r["page_id"]].append(tuple(r)[1:])
    kinds = set()
    for k, html, other in pages:
        want = sections(html, other)
        assert got[k] == want, html
        kinds |= {(r[5], r[6]) for r in want}
    assert kinds == {("html_structure", None), ("html_component", "tab"), ("html_component", "accordion"), ("no_section", None), ("text_fallback", None)}


def test_registered_query_equals_a_plain_walk(spark):
    from callweave import registry

    sf = "/root/testdata/sf0.001"
    rows = registry.queries()["u7_html_sections"](spark, sf).collect()
    got = sorted(tuple(r) for r in rows)
    want = sorted((p["page_id"], *r) for p in spark.read.parquet(f"{sf}/pages.parquet").collect() for r in sections(p["html"], None))
    assert sorted(got, key=str) == sorted(want, key=str) and got


def test_registered_text_sections_equal_a_plain_walk(spark):
    from callweave import registry

    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in registry.queries()["u8_text_sections"](spark, sf).collect()), key=str)
    want = sorted(((d["doc_id"], *r) for d in spark.read.parquet(f"{sf}/documents.parquet").collect() for r in sections(None, d["text"])), key=str)
    assert got == want and {r[6] for r in got} == {"text_fallback", "no_section"}


def _large(n, rng):
    t = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    parts, count = [], 0
    while count < n:
        k = rng.randrange(6)
        level = rng.randrange(1, 5)
        parts.append([f"<h{level}>{t(3)}</h{level}>", f"<ul class='{rng.choice(['', 'nav-item'])}'><li>{t(3)}<li>{t(3)}</ul>", f"<table><tr><td>{t(2)}<td>{t(2)}</table>", f"<div class=cookie><p>{t(4)}</p></div>", f"<button aria-controls=q{count} class=faq aria-expanded=x>{t(3)}</button><div id=q{count}>{t(15)}</div>", f"<p>{t(10)}</p>"][k])
        count += (1, 3, 4, 2, 2, 1)[k]
    return "<body><main>" + "".join(parts) + "</main></body>"


def test_cost_grows_with_the_page(spark):
    took = {}
    for n in (1000, 3000, 30_000):  # the first one warms up
        page = spark.createDataFrame([(1, _large(n, random.Random(n)))], "page_id long, html string").coalesce(1)
        began = time.perf_counter()
        assert H.page_sections(page).select(F.sum(F.length("text"))).first()[0] > n
        took[n] = time.perf_counter() - began
    print("seconds by elements", took)
    assert took[30_000] < 20 * took[3000]
