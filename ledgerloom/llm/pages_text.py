"""Operator 8: layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags make an element tree; rules of
visibility (elements, attributes, and the cascade of inline styles and simple
style-sheet rules on a screen) decide what is shown; a renderer lays blocks, lists and tables out as text.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
HEAD = frozenset("base link meta title style script noscript template".split())
HIDDEN = frozenset("head title script style template iframe noembed noframes object embed video audio canvas datalist meta link base area map param source track rp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
BLOCK = CLOSES_P | frozenset("html body tr caption legend option optgroup select textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir hr".split())
SCOPE = frozenset("html table td th caption button template".split())
#: A start tag closes these open elements, up to one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | SCOPE),
    "dd": ({"dt", "dd"}, {"dl"} | SCOPE),
    "option": ({"option"}, {"select", "datalist", "optgroup"} | SCOPE),
    "optgroup": ({"option", "optgroup"}, {"select"} | SCOPE),
    "rt": ({"rt", "rp"}, {"ruby"} | SCOPE),
    "rp": ({"rt", "rp"}, {"ruby"} | SCOPE),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table", "html"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table", "html"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "html"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "html"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "html"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table", "html"}),
    "caption": ({"caption", "colgroup"}, {"table", "html"}),
    "colgroup": ({"caption", "colgroup"}, {"table", "html"}),
}
SECTIONS = frozenset({"tbody", "thead", "tfoot"})
TABLE_PARTS = SECTIONS | {"table", "tr", "td", "th", "caption"}
INLINE_CLOSE = frozenset("a b big code em font i nobr s small strike strong tt u span".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_COMMENT_END = re.compile(r"--!?>")
_SIGN = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_CSS = re.compile(r""""(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|url\(\s*[^"')\s][^)]*\)?|[{};]""", re.S | re.I)
_COMMA = re.compile(r",(?![^(\[]*[)\]])")
_LENGTH = re.compile(r"^([\d.]+)(px|em|rem|in|cm|mm|pt)?$")
_RANGE = re.compile(r"^(?:([\d.]+\w*)\s*(<=?|>=?|=)\s*)?(width|height)(?:\s*(<=?|>=?|=)\s*([\d.]+\w*))?$")
#: The screen that pages are read on, for media queries: pixels of a length's unit, and what it answers to features.
UNITS = {"": 1, "px": 1, "em": 16, "rem": 16, "in": 96, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "pt": 4 / 3}
SCREEN = {"width": 1280, "height": 800}
FEATURES = {
    "orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference",
    "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled", "update": "fast", "grid": "0",
}
DISPLAYS = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column "
    "table-column-group table-caption list-item contents flow flow-root run-in ruby math inherit initial unset revert revert-layer -webkit-box -webkit-flex -webkit-inline-box -ms-flexbox".split()
)
VISIBILITIES = frozenset("visible hidden collapse inherit initial unset revert revert-layer".split())
NO_PARTS: frozenset[int] = frozenset()
_SIMPLE = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>(?:[\w-]|[^\x00-\x7F])+)|\.(?P<cls>(?:[\w-]|[^\x00-\x7F])+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*(?P<flag>[isIS])?\s*)?\]|(?P<pseudo>::?)(?P<name>[\w-]+)(?P<open>\()?"""
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"^\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*$")
#: Pseudo-classes that nothing on a page which is only read has, and what a few others ask of an element.
NEVER = frozenset("hover active focus focus-visible focus-within visited target indeterminate fullscreen modal popover-open playing paused autofill user-valid user-invalid current past future".split())
LEGACY_ELEMENTS = frozenset("before after first-line first-letter".split())
STATES = {
    "root": lambda n: n.parent is None, "empty": lambda n: not any(k if isinstance(k, str) else True for k in n.kids), "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs, "any-link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
    "checked": lambda n: "checked" in n.attrs or "selected" in n.attrs, "disabled": lambda n: "disabled" in n.attrs, "enabled": lambda n: n.tag in FIELDS and "disabled" not in n.attrs, "required": lambda n: "required" in n.attrs,
    "optional": lambda n: n.tag in FIELDS and "required" not in n.attrs, "open": lambda n: "open" in n.attrs, "defined": lambda n: True,
}
FIELDS = frozenset("button input select textarea option optgroup fieldset".split())


class _Invalid(Exception):
    """A selector that is not understood."""


def _attribute_test(m: re.Match):
    name, op, value, fold = m["attr"].lower(), m["op"], m["val"] or "", (m["flag"] or "").lower() == "i"
    value = value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value
    value = value.lower() if fold else value
    holds = {
        "=": lambda v: v == value, "~=": lambda v: value in v.split() and " " not in value, "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: bool(value) and v.startswith(value), "$=": lambda v: bool(value) and v.endswith(value), "*=": lambda v: bool(value) and value in v,
    }.get(op, lambda v: True)
    return lambda n: name in n.attrs and holds(n.attrs[name].lower() if fold else n.attrs[name])


def _place_test(name: str, arg: str | None):
    """Tests of an element's place among its siblings, or among those of its tag; None for other names."""
    kind = name.removesuffix("-of-type") if name.endswith("-of-type") else name.removesuffix("-child") if name.endswith("-child") else None
    if kind not in ("first", "last", "only", "nth", "nth-last") or (arg is not None) != kind.startswith("nth"):
        return None
    a, b = 0, 1
    if arg is not None:
        m = _NTH.match(arg.lower())
        if not m:
            raise _Invalid
        a = 2 if m["word"] else 0 if m["only"] else int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
        b = (1 if m["word"] == "odd" else 0) if m["word"] else int(m["only"]) if m["only"] else int((m["sign"] or "+") + (m["b"] or "0"))

    def among(n: Node) -> tuple[int, int]:
        """(1-based place, number) of the siblings that count."""
        if name.endswith("-of-type"):
            return n.typed[0], n.typed[1][0]
        return n.place + 1, len(n.parent.elements) if n.parent else 1

    def test(n: Node) -> bool:
        at, of = among(n)
        if kind == "only":
            return of == 1
        at = of - at + 1 if "last" in kind else at
        return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0

    return test


class Compound:
    """Simple selectors that one element must meet: tag, classes, ids, and tests of attributes, place and state."""

    __slots__ = ("tag", "classes", "ids", "tests", "weight", "never")

    def __init__(self, s: str) -> None:
        self.tag, self.classes, self.ids, self.tests, self.never = "*", set(), set(), [], False
        ids = classes = tags = at = 0
        while at < len(s):
            m = _SIMPLE.match(s, at)
            if not m or (m["tag"] and at):
                raise _Invalid
            at = m.end()
            if m["tag"]:
                self.tag, tags = m["tag"].lower(), int(m["tag"] != "*")
            elif m["id"]:
                self.ids.add(m["id"])
                ids += 1
            elif m["cls"]:
                self.classes.add(m["cls"])
                classes += 1
            elif m["attr"]:
                self.tests.append(_attribute_test(m))
                classes += 1
            else:
                name, arg = m["name"].lower(), None
                if m["open"]:
                    depth, end = 1, at
                    while end < len(s) and depth:
                        depth += {"(": 1, ")": -1}.get(s[end], 0)
                        end += 1
                    if depth:
                        raise _Invalid
                    arg, at = s[at : end - 1], end
                if m["pseudo"] == "::" or name in LEGACY_ELEMENTS:
                    self.never, tags = True, tags + 1  # a part of an element, not the element
                    continue
                more = (0, 1, 0)
                if name in ("not", "is", "where", "matches") and arg is not None:
                    inner = [Compound(x.strip()) for x in _COMMA.split(arg) if x.strip()]
                    if not inner:
                        raise _Invalid
                    wanted = name != "not"
                    self.tests.append(lambda n, inner=inner, wanted=wanted: any(c.meets(n) for c in inner) == wanted)
                    more = (0, 0, 0) if name == "where" else max(c.weight for c in inner)
                elif test := _place_test(name, arg):
                    self.tests.append(test)
                elif name in NEVER and arg is None:
                    self.never = True
                elif name in STATES and arg is None:
                    self.tests.append(STATES[name])
                else:
                    raise _Invalid
                ids, classes, tags = ids + more[0], classes + more[1], tags + more[2]
        if not s:
            raise _Invalid
        self.weight = (ids, classes, tags)

    def meets(self, n: Node) -> bool:
        return (
            not self.never and self.tag in ("*", n.tag) and (not self.classes or self.classes <= set(n.attrs.get("class", "").split())) and (not self.ids or self.ids <= {n.attrs.get("id", "")})
            and all(t(n) for t in self.tests)
        )


def selector_parts(s: str) -> list[tuple[str, Compound]]:
    """The compounds of a selector from left to right, each with the combinator before it ('' for the first, ' ' for descendants)."""
    out, start, at, depth, sign, quote = [], 0, 0, 0, "", ""
    while at < len(s):
        c = s[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and (m := _COMBINATOR.match(s, at)):
            out.append((sign, Compound(s[start:at])))
            sign, start = m[1] or " ", m.end()
            at = start
            continue
        at += 1
    return [*out, (sign, Compound(s[start:]))]


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "place", "typed", "elements", "matched", "above", "sofar")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []
        # What selectors ask for, set on the way down: place among the parent's elements and among those of its tag (with their number), the
        # parts of selectors that end here, those that end in an element around this one, and those that end in an element in it so far.
        self.parent: Node | None = None
        self.place, self.typed, self.elements = 0, (1, [1]), [self]
        self.matched = self.above = NO_PARTS
        self.sofar: set[int] = set()

    def enter(self) -> None:
        """Tell the elements in this one where they are."""
        self.elements = [k for k in self.kids if isinstance(k, Node)]
        above = self.above if self.matched <= self.above else self.above | self.matched
        tags: dict[str, list[int]] = {}
        for i, k in enumerate(self.elements):
            count = tags.setdefault(k.tag, [0])
            count[0] += 1
            k.parent, k.place, k.typed, k.above = self, i, (count[0], count), above


def _attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(s):
        v = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        out.setdefault(m[1].lower(), entities.unescape(v) if v and "&" in v else v or "")
    return out


class Builder:
    """The tree of a page; `styles` gathers its style sheets.

    Open elements have rising numbers; for each name, the numbers of those that
    are open are kept, so that no step walks the stack.
    """

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.number = [0]
        self.count = 0
        self.named: dict[str, list[int]] = {"html": [0]}
        self.blocks: list[int] = []
        self.styles: list[str] = []

    def last(self, tags: Iterable[str]) -> int:
        """Number of the innermost open element of these names, 0 if there is none."""
        return max((self.named[t][-1] for t in tags if self.named.get(t)), default=0)

    def in_scope(self, tag: str, stops: frozenset | set = SCOPE) -> int:
        """Number of the innermost open element of that name, 0 if a stop comes first."""
        own = self.last((tag,))
        return own if own and own >= self.last(stops) else 0

    def opened(self, node: Node) -> None:
        self.count += 1
        self.open.append(node)
        self.number.append(self.count)
        self.named.setdefault(node.tag, []).append(self.count)
        if node.tag in BLOCK:
            self.blocks.append(self.count)

    def pop(self) -> None:
        tag, _ = self.open.pop().tag, self.number.pop()
        self.named[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()

    def close_to(self, number: int) -> None:
        """Close the element of that number and all inside it; 0 closes nothing."""
        while number and self.number[-1] >= number:
            self.pop()

    def forget(self, number: int) -> None:
        """Take one element off the stack, which stays open for those inside it."""
        i = bisect.bisect_left(self.number, number)
        self.named[self.open[i].tag].remove(number)
        del self.open[i], self.number[i]

    def text(self, s: str) -> None:
        here = self.open[-1]
        if here.tag in ("table", "tr") or here.tag in SECTIONS:
            if s.strip():
                self.before_table(s)
        else:
            if here.tag == "head" and s.strip():
                self.pop()
                here = self.open[-1]
            here.kids.append(s)

    def before_table(self, item: str | Node) -> None:
        """Put what may not stand in a table in front of it."""
        table = self.last(("table",))
        if not table:
            self.open[-1].kids.append(item)
            return
        kids = self.open[bisect.bisect_left(self.number, table) - 1].kids
        kids.insert(len(kids) - 1, item)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body" and self.open[-1].tag == "head":
                self.pop()
            (self.root.attrs if tag == "html" else self._body().attrs).update({k: v for k, v in attrs.items()})
            return
        if tag == "head":
            if len(self.open) == 1 and not self.root.kids:
                self._push(Node("head", attrs))
            return
        if self.open[-1].tag == "head" and tag not in HEAD:
            self.pop()
        if tag in CLOSES_P:
            self.close_to(self.in_scope("p"))
        if tag in IMPLIED:
            names, stops = IMPLIED[tag]
            own = self.last(names)
            if own > self.last(stops - names):
                i = bisect.bisect_left(self.number, own)
                while i > 1 and self.open[i - 1].tag in names:
                    i -= 1
                self.close_to(self.number[i])
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:] in {"1", "2", "3", "4", "5", "6"}:
            self.pop()
        if tag in ("a", "button", "nobr"):
            self.close_to(self.in_scope(tag))
        if tag in ("td", "th", "tr", "caption", "colgroup", "col") or tag in SECTIONS:
            # What stands in front of the table is over: back to the table's own elements.
            at = self.last(TABLE_PARTS)
            cell = self.last(("td", "th", "caption"))
            if at and at != cell:
                i = bisect.bisect_left(self.number, at) + 1
                self.close_to(self.number[i] if i < len(self.number) else 0)
        elif tag == "table" and (self.open[-1].tag in ("table", "tr") or self.open[-1].tag in SECTIONS):
            self.close_to(self.in_scope("table", {"html"}))  # a table can't stand between cells: the open one ends
        here = self.open[-1].tag
        inside = here == "table" or here in SECTIONS or here == "tr"
        if tag in ("td", "th"):
            if not self.last(("table",)):
                return
            if here == "table":
                self._push(Node("tbody", {}))
            if self.open[-1].tag != "tr":
                self._push(Node("tr", {}))
        elif tag == "tr":
            if not self.last(("table",)):
                return
            if here == "table":
                self._push(Node("tbody", {}))
        elif tag in SECTIONS or tag in ("caption", "colgroup", "col"):
            if not self.last(("table",)):
                return
        elif inside and tag not in ("script", "style", "template", "form"):
            node = Node(tag, attrs)
            self.before_table(node)
            if tag not in VOID:
                self.opened(node)
            return
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].kids.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].kids.append(node)
        self.opened(node)

    def _body(self) -> Node:
        return self.root

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", {})
            return
        if tag == "p" and not self.in_scope("p"):
            self.start("p", {})
            self.pop()
            return
        if tag == "table":
            self.close_to(self.in_scope("table", {"html"}))
        elif tag in ("tr", "td", "th", "caption") or tag in SECTIONS:
            self.close_to(self.in_scope(tag, {"table", "html"}))
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            at = [self.in_scope(f"h{k}") for k in range(1, 7)]
            self.close_to(max(at))
        elif tag in INLINE_CLOSE:
            i = self.in_scope(tag)
            if i and (not self.blocks or self.blocks[-1] < i):
                self.close_to(i)
            elif i:
                self.forget(i)  # formatting that blocks were opened in: the blocks stay open
        else:
            self.close_to(self.in_scope(tag))


class Tokens:
    """Finds where markup ends, in one pass over the source whatever is left open."""

    def __init__(self, source: str) -> None:
        self.source, self.n = source, len(source)
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.failed: set[int] = set()  # places outside quotes from which no > outside quotes follows

    def after(self, pos: int) -> int:
        """Behind the next >, or the end."""
        return self.source.find(">", pos) + 1 if pos <= self.last[">"] else self.n

    def tag_end(self, pos: int) -> int:
        """The place of the > that ends a start tag, quoted values skipped; if a quote stays open, of the next >; -1 if there is none."""
        if pos > self.last[">"]:
            return -1
        near = self.source.find(">", pos)
        at, walked = pos, []
        while at not in self.failed:
            walked.append(at)
            m = _SIGN.search(self.source, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            if m.start() >= self.last[m[0]]:
                break
            at = self.source.find(m[0], m.end()) + 1
        self.failed.update(walked)
        return near


def parse(source: str) -> Builder:
    b, t, pos, look, n = Builder(), Tokens(source), 0, 0, len(source)
    while pos < n:
        stop = source.find("<", look)
        stop = n if stop < 0 else stop
        m, end = _NAME.match(source, stop), -1
        if source.startswith("<!--", stop):
            if source.startswith((">", "->"), stop + 4):
                end = t.after(stop)
            else:
                close = _COMMENT_END.search(source, stop + 4)
                end = close.end() if close else n
        elif source.startswith(("<!", "<?"), stop):
            end = t.after(stop)
        elif m:
            end = t.after(m.end()) if source[stop + 1] == "/" else t.tag_end(m.end()) + 1
        if stop < n and end <= stop:  # a < that begins no markup is text
            look = stop + 1
            continue
        if stop > pos:
            s = source[pos:stop]
            b.text(entities.unescape(s) if "&" in s else s)
        if stop == n:
            break
        pos = look = end
        if not m:
            continue
        tag = m[1].lower()
        if source[stop + 1] == "/":
            b.end(tag)
            continue
        attrs = _attributes(source[m.end() : end - 1])
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, pos) if tag != "plaintext" else None
            end, after = (close.start(), close.end()) if close else (n, n)
            raw = source[pos:end]
            if tag == "style":
                if on_screen(attrs.get("media", "")):
                    b.styles.append(raw)
            elif tag in ("textarea", "plaintext", "xmp"):
                b.start(tag, attrs)
                b.open[-1].kids.append(entities.unescape(raw) if tag == "textarea" else raw)
                b.pop()
            pos = look = after
            continue
        b.start(tag, attrs)
    return b


def _compare(x: float, sign: str, y: float) -> bool:
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y}[sign]


def _pixels(s: str) -> float | None:
    m = _LENGTH.match(s)
    try:
        return float(m[1]) * UNITS[m[2] or ""] if m else None
    except ValueError:
        return None


def _feature(s: str) -> bool | None:
    """Whether the screen has a media feature; None if that is not known."""
    name, colon, value = (x.strip() for x in s.partition(":"))
    if not colon:
        m = _RANGE.match(name)
        if not m:
            return FEATURES[name] not in ("no-preference", "0") if name in FEATURES else None
        at, ok = SCREEN[m[3]], True
        for length, sign, left in ((m[1], m[2], True), (m[5], m[4], False)):
            if length:
                px = _pixels(length)
                if px is None:
                    return None
                ok = ok and (_compare(px, sign, at) if left else _compare(at, sign, px))
        return ok
    side, _, base = name.partition("-")
    if name in SCREEN or (side in ("min", "max") and base in SCREEN):
        px = _pixels(value)
        return None if px is None else _compare(SCREEN[base or name], {"min": ">=", "max": "<="}.get(side, "="), px)
    return FEATURES[name] == value if name in FEATURES else None


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on SCREEN; a query that isn't understood doesn't."""
    media = media.strip().lower()
    if not media:
        return True
    for query in media.split(","):
        query = _SPACE.sub(" ", query).strip()
        negated = query.startswith("not ")
        query = query[4:] if negated else query.removeprefix("only ")
        answer: bool | None = False
        for choice in re.split(r"(?<=\)) or (?=\()", query):
            held: bool | None = True
            for i, part in enumerate(choice.split(" and ")):
                part = part.strip()
                if part.startswith("(") and part.endswith(")") and "(" not in part[1:]:
                    one = _feature(part[1:-1].strip())
                else:
                    one = part in ("all", "screen") if not i and re.fullmatch(r"[a-z-]+", part) else None
                held = False if held is False or one is False else None if held is None or one is None else True
            answer = True if answer or held else None if answer is None or held is None else False
        if answer is not None and answer != negated:
            return True
    return False


def _declared(body: str) -> dict[str, tuple[str, bool]]:
    """The valid display and visibility of a list of declarations, each with whether it is important; the last one of the most important counts."""
    out: dict[str, tuple[str, bool]] = {}
    low, start = body.lower(), 0
    if "display" not in low and "visibility" not in low:
        return out
    for end in [m.start() for m in _CSS.finditer(low) if m[0] == ";"] + [len(low)]:
        name, _, value = low[start:end].partition(":")
        name, start = name.strip(), end + 1
        if name not in ("display", "visibility"):
            continue
        value, bang, word = value.partition("!")
        words = value.split()
        important = bool(bang) and word.strip() == "important"
        known = DISPLAYS if name == "display" else VISIBILITIES
        if not words or (bang and not important) or not set(words) <= known or (len(words) > 1 and name == "visibility"):
            continue
        if important or not out.get(name, ("", False))[1]:
            out[name] = (words[0], important)
    return out


class Styles:
    """Display and visibility by the rules of style sheets.

    Of the rules that apply to a screen the cascade decides: importance, layers,
    specificity, then order.  At-rules whose condition doesn't hold or isn't
    understood are skipped with all they hold, and so are rules with a selector that isn't.
    Selectors are met from left to right on the way down the tree: an element keeps which of their parts end in it,
    and hands down those that end in it or around it, so no selector walks up.
    """

    def __init__(self, sheets: list[str]) -> None:
        #: Parts of selectors, one selector after the other: (combinator, compound, the rule it ends or None).
        self.parts: list[tuple[str, Compound, tuple | None]] = []
        self.by_key: dict[str, list[int]] = {}  # places of parts by an id, a class, or the tag that they ask for
        self.rules = 0
        for sheet in sheets:
            self._read(_COMMENT.sub(" ", sheet).replace("<!--", " ").replace("-->", " "))

    def _read(self, sheet: str) -> None:
        work = [(sheet, False)]  # the rest of a block, whether it lies in a layer
        while work:
            css, layered = work.pop()
            start = depth = body = 0
            for m in _CSS.finditer(css):
                sign = m[0]
                if sign == "{":
                    depth += 1
                    body = m.end() if depth == 1 else body
                elif sign == "}" and depth:
                    depth -= 1
                    if not depth:
                        inner = self._rule(css[start : body - 1].strip(), css[body : m.start()], layered)
                        start = m.end()
                        if inner:  # its rules come before those that follow
                            work += [(css[start:], layered), inner]
                            break
                elif not depth and (sign == "}" or (sign == ";" and css[start : m.start()].lstrip().startswith("@"))):
                    start = m.end()
            else:
                if depth and (inner := self._rule(css[start : body - 1].strip(), css[body:] + "}" * (depth - 1), layered)):
                    work.append(inner)

    def _rule(self, head: str, body: str, layered: bool) -> tuple[str, bool] | None:
        """Take a rule; of an at-rule that applies, return what is to be read."""
        if head.startswith("@"):
            name, _, rest = head[1:].replace("(", " (", 1).partition(" ")
            name, rest = name.lower(), rest.strip()
            if (name == "media" and on_screen(rest)) or (name == "supports" and not rest.lower().startswith("not")):
                return body, layered
            return (body, True) if name == "layer" else None
        if "{" in body:  # nested rules are not read, the declarations around them are
            parts, depth, start = [], 0, 0
            for m in _CSS.finditer(body):
                if m[0] == ";" and not depth:
                    parts.append(body[start : m.end()])
                    start = m.end()
                elif m[0] in "{}":
                    depth = max(depth + (1 if m[0] == "{" else -1), 0)
                    start = m.end() if not depth else start
            body = "".join(parts) + (body[start:] if not depth else "")
        found = _declared(body)
        if not found:
            return None
        try:
            selectors = [selector_parts(x.strip()) for x in _COMMA.split(head)]
        except _Invalid:  # one selector that is not understood takes its whole rule with it
            return None
        for own in selectors:
            weight = tuple(map(sum, zip(*(c.weight for _, c in own))))
            for k, (sign, c) in enumerate(own):
                key = "#" + min(c.ids) if c.ids else "." + min(c.classes) if c.classes else c.tag
                self.by_key.setdefault(key, []).append(len(self.parts))
                self.parts.append((sign, c, (weight, self.rules, layered, found) if k == len(own) - 1 else None))
            self.rules += 1
        return None

    def of(self, node: Node) -> dict[str, str]:
        """The display and visibility that style sheets and the style attribute give an element; those around and before it come first."""
        inline = _declared(node.attrs["style"]) if node.attrs.get("style") else {}
        if not self.rules:
            return {k: v for k, (v, _) in inline.items()}
        best: dict[str, tuple] = {}
        parent, matched = node.parent, []
        keys = {"*", node.tag, *(f".{c}" for c in node.attrs.get("class", "").split()), "#" + node.attrs.get("id", "")}
        for number in (i for k in keys for i in self.by_key.get(k, ())):
            sign, compound, rule = self.parts[number]
            if sign and parent is None:
                continue
            if sign == " " and number - 1 not in node.above or sign == ">" and number - 1 not in parent.matched or sign == "~" and number - 1 not in parent.sofar:
                continue
            if sign == "+" and not (node.place and number - 1 in parent.elements[node.place - 1].matched):
                continue
            if not compound.meets(node):
                continue
            if rule is None:
                matched.append(number)
                continue
            weight, order, layered, found = rule
            for k, (v, important) in found.items():
                key = (important, False, layered == important, weight, order, v)
                best[k] = max(best.get(k, key), key)
        if matched:
            node.matched = frozenset(matched)
            if parent is not None:
                parent.sofar.update(matched)
        for k, (v, important) in inline.items():
            key = (important, True, True, (0, 0, 0), 0, v)
            best[k] = max(best.get(k, key), key)
        return {k: key[-1] for k, key in best.items()}


def visibility(node: Node, styles: Styles, parent_seen: bool) -> tuple[bool, bool]:
    """(rendered at all, its own text seen)."""
    a = node.attrs
    style = styles.of(node)  # of hidden ones too: they stand before others
    if node.tag in HIDDEN or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, False
    # A rule of the page goes before the browser's own for the attribute and for closed dialogs.
    display = style.get("display", "")
    if display in ("", "revert", "revert-layer"):
        display = "none" if "hidden" in a or (node.tag == "dialog" and "open" not in a) else ""
    if display == "none":
        return False, False
    seen = style.get("visibility", "")
    return True, True if seen in ("visible", "initial") else False if seen in ("hidden", "collapse") else parent_seen


#: Columns that nested lists and quotes indent at most; what is nested deeper stands below one another.
INDENT = 240


class Lines:
    """Text being laid out: collapses white space, keeps at most one blank line between blocks."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent = ""
        self.mark = ""

    def write(self, s: str) -> None:
        parts = _SPACE.split(s)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        words = [p for p in parts if p]
        if not words:
            return
        if self.line and self.space:
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = len(parts) > 1 and not parts[-1]

    def raw(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for x in rest:
            self.flush(keep=True)
            self.line.append(x)

    def flush(self, keep: bool = False) -> None:
        """End the line if it holds anything."""
        s = "".join(self.line)
        s = s if keep else s.rstrip()
        if s or (keep and self.line):
            if self.blank and self.out:
                self.out.append("")
            self.blank = False
            pre = self.indent
            if self.mark:
                pre, self.mark = pre[: -len(self.mark)] + self.mark if pre.endswith(" " * len(self.mark)) else pre + self.mark, ""
            self.out.append((pre + s).rstrip())
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.flush()
        self.blank = self.blank or spaced

    def text(self) -> str:
        self.flush()
        return "\n".join(self.out)


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table: cells (text, colspan, rowspan) padded to common column widths."""
    place: list[dict[int, tuple[list[str], int]]] = []
    spanned: list[tuple[int, int, int]] = []  # (first column, column behind, last row) of cells that reach further down
    for r, row in enumerate(rows):
        spanned = sorted(x for x in spanned if x[2] >= r)
        c, k, here, more = 0, 0, {}, []
        for text, across, down in row:
            while k < len(spanned) and spanned[k][0] <= c:
                c, k = max(c, spanned[k][1]), k + 1
            here[c] = (text.split("\n"), across)
            if down > 1:
                more.append((c, c + across, r + down - 1))
            c += across
        spanned += more
        place.append(here)
    width: dict[int, int] = {}
    for here in place:
        for c, (lines, across) in here.items():
            if across == 1:
                width[c] = max(width.get(c, 0), *map(len, lines))
    for here in place:
        for c, (lines, across) in here.items():
            if across > 1:
                have = sum(width.get(c + j, 0) for j in range(across)) + 2 * (across - 1)
                width[c + across - 1] = width.get(c + across - 1, 0) + max(0, max(map(len, lines)) - have)
    filled = [c for c in sorted(width) if width[c]]
    ends = [0, *itertools.accumulate(width[c] + 2 for c in filled)]
    at = {c: ends[bisect.bisect_left(filled, c)] for c in {c for here in place for c in here}}
    out = []
    for here in place:
        for i in range(max((len(lines) for lines, _ in here.values()), default=0)):
            line = ""
            for c in sorted(here):
                lines = here[c][0]
                if i < len(lines) and lines[i]:
                    line = line.ljust(at[c]) + lines[i]
            out.append(line.rstrip())
    return out


def _span(node: Node, name: str) -> int:
    try:
        return min(max(int(node.attrs.get(name, "1")), 1), 1000)
    except ValueError:
        return 1


def render(source: str | None) -> str:
    """The visible text of a page."""
    b = parse(source or "")
    styles = Styles(b.styles)
    lines = Lines()
    tables: list[dict] = []
    lists: list[list] = []
    # (node or text or closing function, seen, preformatted)
    stack: list[tuple] = [(b.root, True, False)]
    while stack:
        item, seen, pre = stack.pop()
        if isinstance(item, str):
            if seen:
                lines.raw(item) if pre else lines.write(item)
            continue
        if callable(item):
            item()
            continue
        shown, seen = visibility(item, styles, seen)
        if not shown:
            continue
        if styles.rules:
            item.enter()
        tag = item.tag
        if tag == "br":
            lines.flush()
            continue
        if tag == "hr":
            lines.block(True)
            continue
        kids = item.kids
        if tag == "details" and "open" not in item.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        done = None
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists)
        if tag in ("ul", "ol", "menu", "dir"):
            lines.block(spaced)
            start = item.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])

            def done(spaced=spaced):
                lists.pop()
                lines.block(spaced)
        elif tag == "li":
            lines.block(False)
            ordered, number = lists[-1] if lists else (False, 1)
            if lists:
                value = item.attrs.get("value", "")
                number = lists[-1][1] = int(value) if ordered and re.fullmatch(r"-?\d{1,9}", value) else number
                lists[-1][1] += 1
            mark = f"{number}. " if ordered else "- "
            before = lines.indent
            lines.indent, lines.mark = before + " " * len(mark) * (len(before) < INDENT), mark

            def done(before=before):
                lines.block(False)
                lines.indent, lines.mark = before, ""
        elif tag == "dd" or tag == "blockquote":
            lines.block(spaced)
            before = lines.indent
            lines.indent = before + "    " * (len(before) < INDENT)

            def done(before=before, spaced=spaced):
                lines.block(spaced)
                lines.indent = before
        elif tag == "table":
            lines.block(True)
            tables.append({"rows": [], "outer": None, "lists": lists})
            lists = []

            def done():
                nonlocal lists
                t = tables.pop()
                lists = t["lists"]
                for line in _grid(t["rows"]):
                    lines.line = [line]
                    lines.flush(keep=True)
                lines.block(True)
        elif tag == "tr" and tables:
            tables[-1]["rows"].append([])
        elif tag in ("td", "th") and tables:
            outer, lines, outer_lists, lists = lines, Lines(), lists, []

            def done(outer=outer, node=item, outer_lists=outer_lists):
                nonlocal lines, lists
                text = lines.text()
                lines, lists = outer, outer_lists
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                tables[-1]["rows"][-1].append((text, _span(node, "colspan"), _span(node, "rowspan")))
        elif tag in BLOCK:
            lines.block(spaced)

            def done(spaced=spaced):
                lines.block(spaced)
        if done:
            stack.append((done, seen, pre))
        pre = pre or tag in ("pre", "textarea", "xmp", "plaintext")
        if tag == "pre" and kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
            kids = [kids[0][1:], *kids[1:]]
        stack.extend((k, seen, pre) for k in reversed(kids))
    return lines.text()


def html_to_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_chars, n_lines, n_blocks) of every row of pages, by layout-aware rendering.

    Null and empty pages have an empty text; so has a page that shows nothing.
    Blocks are runs of lines between blank lines.  Malformed markup never fails:
    unclosed elements end with the page, stray end tags are ignored.  Time grows
    in proportion to a page whatever is nested or left open in it; lists and
    quotes indent up to INDENT columns.  Extra columns are not read; repeated
    rows stay.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [render(h) for h in pdf["html"]]
            yield pd.DataFrame({
                "id": pdf["id"].array, "text": texts, "n_chars": [len(t) for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts],
                "n_blocks": [len([x for x in re.split(r"\n{2,}", t) if x.strip()]) for t in texts],
            })

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, text string, n_chars long, n_lines long, n_blocks long")


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return html_to_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


QUERIES = {"op8_html_layout": op8_html_layout}
ORACLE_SQL: dict[str, str] = {}
