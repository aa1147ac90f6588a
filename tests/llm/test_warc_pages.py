import random
import time
from datetime import datetime, timedelta
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pages_text as pt
from ledgerloom.llm import warc


@pytest.mark.parametrize("url, want", [
    ("HTTP://User@WWW.Example.com:80/a/index.html?b=2&utm_source=x&a=1#top", "example.com/a?a=1&b=2"),
    ("https://example.com", "example.com/"), ("https://example.com/?", "example.com/"), (" mailto:x ", "mailto:x"), ("", ""), (None, None),
    ("https://example.com:443/x/?REF=1&q=%20", "example.com/x?q=%20"),
])
def test_canonical_url(spark, url, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(F.col("u"))).first()[0] == want


SCHEMA = "record_id long, url string, ts timestamp, kind string, headers map<string,string>, digest string, slice int, verdict string"
T0 = datetime(2024, 1, 1)


def resolved(rows):
    """Brute force over lists; URLs here differ by their path only."""
    out = {}
    for i, url, ts, kind, headers, *_ in rows:
        if kind != "revisit":
            continue
        low = {k.lower(): v for k, v in (headers or {}).items()}
        past = [r for r in rows if r[3] == "response" and url is not None and ts is not None and r[1] == url and r[2] is not None and r[2] < ts]
        if not past:
            out.setdefault(i, []).append((None, "unresolved", None, low))
            continue
        res = max(past, key=lambda r: (r[2], r[0]))
        theirs = {k.lower(): v for k, v in (res[4] or {}).items()}
        tag = lambda h: h["etag"].removeprefix("W/") if h.get("etag") else None
        if tag(low) and tag(theirs):
            verdict = "resolved" if tag(low) == tag(theirs) else "etag-mismatch"
        elif low.get("last-modified") and theirs.get("last-modified"):
            verdict = "resolved" if low["last-modified"] == theirs["last-modified"] else "date-mismatch"
        else:
            verdict = "unverified"
        good = verdict in ("resolved", "unverified")
        merged = theirs | {k: v for k, v in low.items() if k not in warc.FORBIDDEN and v is not None} if good else low
        out.setdefault(i, []).append((res[0], verdict, res[5] if good else None, merged))
    return out


@pytest.mark.parametrize("slices", [1, 7, 128])
def test_as_of_equals_brute_force(spark, slices):
    r = random.Random(slices)
    rows = []
    for i in range(300):
        kind = r.choice(["response", "response", "revisit", "revisit", "request"])
        h = {}
        if r.random() < 0.6:
            h["ETag"] = r.choice(["", "W/"]) + f'"{r.randint(1, 2)}"'
        if r.random() < 0.5:
            h["Last-Modified"] = f"d{r.randint(1, 2)}"
        h |= {"Content-Length": str(i), "X-A": str(i)} if r.random() < 0.7 else {"Vary": "a"}
        url = None if r.random() < 0.05 else "http://h/hot" if r.random() < 0.6 else f"http://h/{r.randint(1, 9)}"
        ts = None if r.random() < 0.05 else T0 + timedelta(seconds=r.randint(0, 80))
        rows.append((i, url, ts, kind, None if r.random() < 0.05 else h, f"g{i}", 1, "x"))
    rows.append(rows[5])
    got = {}
    for x in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), slices).collect():
        got.setdefault(x["record_id"], []).append((x["refers_to"], x["verdict"], x["digest"], x["headers"]))
    assert got == resolved(rows)


def test_no_captures(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>One<p>Two <b>bo<i>ld</b> x</i><div>in</div>out", "One\n\nTwo bold x\n\nin\nout"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=7>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  7. d\n- e"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td rowspan=2>x<td>y<tr><td>z</table>", "Name       Qty\napple pie  3\nx          y\n           z"),
    ("<table>stray<tr><td>a<td>b</table>", "stray\n\na  b"),
    ("<table><tr><td>a<td><table><tr><td>in<td>ner</table></table>", "a  in  ner"),
    ("<div hidden>no</div><p style='display: none'>no</p><span style='visibility:hidden'>no<i style='visibility:visible'>yes</i></span>", "yes"),
    ("<style>.x, p.y{display:none} /*.z{display:none}*/</style><i class='a x'>no</i><p class=y>no</p><b class=y>b</b><u class=z>z</u>", "bz"),
    ("<head><title>t</title><body>b<script>if(a<b)'</p>'</script><!-- c --><noscript>n</noscript>", "bn"),
    ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"), ("a<br>b<hr>c", "a\nb\n\nc"), ("&lt;p&gt; &amp;amp; &nbsp;x", "<p> &amp; \xa0x"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("</p></li></table><td>x</td><b", "x<b"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"), ("<p title='a>b'>x</p>", "x"), ("<select><option>a<option>b</select>", "a\nb"),
])
def test_rendering(html, want):
    assert pt.render(html) == want


def test_deep_nesting_and_long_pages():
    assert pt.render("<div>" * 30000 + "x") == "x"
    assert pt.render("<p>" + "word " * 100000).count("word") == 100000


PIECES = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<ol>", "<pre>", "</pre>", "<br>", "word", " ", "<!-- x", "-->", "<style>", "</style>", "<h1>", "</h2>", "<", "&", "<option>", "<select>", "<dd>", "<caption>", "<head>", "</body>", "<td colspan=x rowspan=0>", "<a href='"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_any_markup_renders(pieces):
    pt.render("".join(pieces))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<div>", "</div>"]), max_size=20))
def test_no_visible_word_is_lost(tags):
    html = "".join(f"{t}w{i} " for i, t in enumerate(tags))
    assert sorted(pt.render(html).replace("- ", " ").split()) == sorted(f"w{i}" for i in range(len(tags)))


def test_table_of_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a<p>b", "t"), (2, "u", None, "t"), (1, "u", "<p>a<p>b", "t")], "page_id long, url string, html string, text string")
    got = sorted(tuple(r) for r in pt.html_to_text(df).collect())
    assert got == [(1, "a\n\nb", 4, 3, 2)] * 2 + [(2, "", 0, 0, 0)]
    assert pt.html_to_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("sheet, want", [
    ("<style>@media print { .n { display:none } }</style>", "text"),
    ("<style media=print>.n{display:none}</style>", "text"),
    ("<style media='screen and (min-width: 40em)'>.n{display:none}</style>", ""),
    ("<style>@media (max-width:600px){.n{display:none}} @media only screen and (width <= 500px){p{display:none}}</style>", "text"),
    ("<style>@media print, screen{.n{display:none}}</style>", ""),
    ("<style>@media not print{.n{display:none}}</style>", ""),
    ("<style>@media not screen{.n{display:none}}</style>", "text"),
    ("<style>@media (unheard-of){.n{display:none}}</style>", "text"),
    ("<style>@media screen{@media print{.n{display:none}} p{color:red}}</style>", "text"),
    ("<style>@media screen{.n{display:none}} .n{display:block}</style>", "text"),
    ("<style>@import 'x';.n{display:none}</style>", ""),
    ("<style>.n{display:none} .n{display:block}</style>", "text"),
    ("<style>p.n{display:none} .n{display:block}</style>", ""),
    ("<style>#i{display:block} p.n{display:none}</style>", "text"),
    ("<style>.n{display:none !important} #i{display:block}</style>", ""),
    ("<style>.n{display:none;display:block}</style>", "text"),
    ("<style>.n{display:none;display:nonsense}</style>", ""),
    ("<style>.n{content:'}';display:none}</style>", ""),
    ("<style>.n{visibility:hidden} p{visibility:visible}</style>", ""),
    ("<style>p{visibility:hidden} .n{visibility:visible}</style>", "text"),
    ("<style>@layer a{#i{display:none}} p{display:block}</style>", "text"),
    ("<style>div:not(.a, p, .b){display:none}</style>", "text"),
    ("<style>@font-face{src:url(a;b)} @keyframes k{from{display:none}} .n{display:none", ""),
])
def test_style_rules_on_a_screen(sheet, want):
    page = sheet + ("</style>" if sheet.count("<style") > sheet.count("</style") else "")
    assert pt.render(page + "<p class=n id=i>text</p>") == want


def test_inline_style_and_attribute_in_the_cascade():
    assert pt.render("<style>.n{display:none}</style><p class=n style='display:block'>a</p>") == "a"
    assert pt.render("<style>.n{display:none!important}</style><p class=n style='display:block'>a</p>") == ""
    assert pt.render("<style>.n{display:block}</style><p class=n hidden>a</p><p hidden>b</p>") == "a"


class Plain(HTMLParser):
    """Brute force for a few tags, well-formed: Python's own parser, one list of (blank line before, indent, mark, words)."""

    SPACED, BROKEN = {"p", "h1", "blockquote"}, {"div", "section", "li"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.words, self.blank, self.stack, self.hidden, self.mark = [], "", False, [], 0, ""

    def cut(self, spaced):
        if self.words.split():
            indent = sum(2 if t == "li" else 4 for t in self.stack if t in ("li", "blockquote"))
            self.rows.append((self.blank and bool(self.rows), indent - len(self.mark), self.mark, " ".join(self.words.split())))
            self.blank, self.mark = False, ""
        self.words, self.blank = "", self.blank or spaced

    def edge(self, tag):
        if tag in self.SPACED or tag in self.BROKEN or tag == "ul":
            self.cut(tag in self.SPACED or (tag == "ul" and "ul" not in self.stack))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            return None if self.hidden else self.cut(False)
        if not self.hidden and "hidden" not in dict(attrs):
            self.edge(tag)
            self.mark = "- " if tag == "li" else self.mark
        else:
            self.hidden += 1
        return self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            self.stack.pop()
            self.hidden -= 1
            return
        if tag in ("li", "blockquote"):
            self.cut(False)
            self.stack.pop()
            self.edge(tag)
            self.mark = "" if tag == "li" else self.mark
            return
        if tag == "ul":
            self.stack.pop()
        self.edge(tag)
        if tag != "ul":
            self.stack.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words += data

    def text(self):
        self.cut(False)
        return "\n".join("\n" * blank + " " * indent + mark + words for blank, indent, mark, words in self.rows)


def made_page(r, depth=0, inline=False):
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if kind < 0.4 or depth > 4:
            out.append(r.choice(["word ", " two words", "a &amp; b", "é\n x", " ", "&lt;p&gt;", "<!-- no <p> -->", "<br>"]))
        elif kind < 0.6 or inline:
            tag = r.choice(["b", "i", "span"])
            out.append(f"<{tag}{r.choice(['', ' hidden', ' title="a > b"'])}>{made_page(r, depth + 1, True)}</{tag}>")
        elif kind < 0.7:
            out.append(f"<{'p'}>{made_page(r, depth + 1, True)}</p>")
        elif kind < 0.85:
            out.append("<ul>" + "".join(f"<li>{made_page(r, depth + 1)}</li>" for _ in range(r.randint(1, 3))) + "</ul>")
        else:
            tag = r.choice(["div", "section", "h1", "blockquote"])
            out.append(f"<{tag}>{made_page(r, depth + 1, tag == 'h1')}</{tag}>")
    return "".join(out)


def test_layout_equals_brute_force():
    r = random.Random(6)
    for _ in range(3000):
        page = made_page(r)
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert pt.render(page) == plain.text(), page


def test_hostile_pages_take_seconds():
    pages = {
        "divs": "<div>" * 200_000, "quotes": '<a "' * 250_000, "hidden ends": '<a ">"' * 160_000, "lists": "<ul><li>x" * 20_000, "crossed": "<b><div>" * 10_000 + "</b>" * 10_000,
        "cells": "<table>" + "<tr><td colspan=1000 rowspan=1000>x" * 5_000, "columns": "<table><tr>" + "<td colspan=1000>x" * 20_000, "buttons": "<p><button>" + "<div>" * 60_000,
        "rules": "<style>" + "".join(f".c{i}{{display:none}}" for i in range(20_000)) + "</style>" + "".join(f"<i class=c{i}>x</i>" for i in range(20_000)),
    }
    for name, page in pages.items():
        began = time.time()
        pt.render(page)
        assert time.time() - began < 10, name


@pytest.mark.parametrize("css, want", [
    (".nav a{display:none}", "b - c d"), ("ul>li.x{display:none}", "a b d"), ("[x]{display:none}", "a b - c"), ("nav > a{display:none}", "a b - c d"), ("nav > b > a{display:none}", "b - c d"), ("nav + b ~ p{display:none}", "a b - c"),
])
def test_selectors_with_combinators_and_attributes(css, want):
    assert pt.render(f"<style>{css}</style><nav class=nav><b><a>a</a></b></nav><b>b</b><ul><li class=x>c</ul><p x>d</p>").split() == want.split()


def plainly(node, parts, up):
    """Whether the parts of a selector lead to node, by trying every way up; up: node -> (parent, earlier siblings)."""
    *rest, (sign, compound) = parts
    if not compound.meets(node):
        return False
    parent, before = up[id(node)]
    if not rest:
        return True
    around = []
    x = parent
    while x is not None:
        around.append(x)
        x = up[id(x)][0]
    where = {" ": around, ">": around[:1], "+": before[-1:], "~": before}[sign]
    return any(plainly(x, rest, up) for x in where)


def test_selectors_equal_trying_every_way_up():
    r = random.Random(12)
    simple = ["i", "b", "u", "*", ".p", ".q", "#k", "[t]", "[t=v]", "[t~=w]", "[t^=v]", "[t$=x]", "[t*='w']", "[t|=v]", "[t=V i]", ":first-child", ":last-child", ":only-child", ":nth-child(2n+1)", ":nth-child(odd)", ":nth-child(-n+2)", ":nth-last-child(2)",
              ":first-of-type", ":last-of-type", ":nth-of-type(2)", ":only-of-type", ":not(.p)", ":not(i, .q)", ":is(b, .p)", ":where(#k)", ":empty", ":hover", ":root"]

    def compound():
        tag = r.choice(["", "", "i", "b", "u", "*"])
        more = "".join(r.sample(simple[4:], r.randrange(1 if not tag else 0, 3)))
        return tag + more

    def tree(depth):
        out = ""
        for _ in range(r.randrange(1, 4)):
            tag = r.choice("ibu")
            attrs = "".join(x for x in (" class=p", " class='q p'", " id=k", " t=v", " t='v-w x'", " t='w v'") if r.random() < 0.2)
            out += f"<{tag}{attrs}>" + f"w{r.randrange(10**6)} " + (tree(depth - 1) if depth and r.random() < 0.7 else "") + f"</{tag}>"
        return out

    for _ in range(150):
        selectors = [r.choice([" ", ">", "+", "~", " "]).join(compound() for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))]
        page = "<style>" + ", ".join(selectors) + "{display:none}</style><div>" + tree(3) + "</div>"
        root = pt.parse(page).root
        up, words = {id(root): (None, [])}, []
        todo = [root]
        while todo:
            n = todo.pop()
            n.enter()
            for i, k in enumerate(n.elements):
                up[id(k)] = (n, n.elements[:i])
            todo += n.elements
        parsed = [pt.selector_parts(s) for s in selectors]

        def walk(n):
            if n.tag in pt.HIDDEN or any(plainly(n, p, up) for p in parsed):
                return
            for k in n.kids:
                words.extend(k.split()) if isinstance(k, str) else walk(k)

        walk(root)
        assert pt.render(page).split() == words, page


@pytest.mark.parametrize("css", ["p:unheard{display:none}", "p, :unheard(x){display:none}", "p[{display:none}", "p:not({display:none}", "> p{display:none}", "p > {display:none}", "p::before{display:none}", ":hover p{display:none}", "p:nth-child(x){display:none}"])
def test_selectors_that_hide_nothing(css):
    assert pt.render(f"<style>{css}</style><p>text</p>") == "text"


def test_selectors_weigh_by_their_parts():
    assert pt.render("<style>div p.n{display:none} p.n{display:block}</style><div><p class=n>a</p></div>") == ""
    assert pt.render("<style>div p.n{display:none} :is(#x, div) p{display:block}</style><div><p class=n>a</p></div>") == "a"
    assert pt.render("<style>div p.n{display:none} :where(#x, div) p{display:block}</style><div><p class=n>a</p></div>") == ""
