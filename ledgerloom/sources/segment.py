"""Documents to hierarchical sections, and long sections to parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The heading ladder as (kind, pattern), level by kind, and the limits of parts.
HEADINGS = [
    ("page", r"^(?i:PAGE)\s+\d+$"),
    ("division", r"^(?:#{1,6}\s*)?(?i:DIVISION)\s+\d{1,2}\b"),
    ("spec-section", r"^(?:#{1,6}\s*)?(?:(?i:SECTION)\s+)?\d{2}[\s.\-]*\d{2}[\s.\-]*\d{2}\b"),
    ("markdown", r"^#{1,6}\s+\S"),
    ("part", r"^(?i:PART)\s+[A-Z0-9]"),
    ("article", r"^(?i:ARTICLE|APPENDIX|CHAPTER)\s+[A-Za-z0-9]"),
    ("paragraph", r"^\d+(?:\.\d+){1,5}[.)]?\s+[A-Z]"),
    ("title", r"^[A-Z][A-Za-z0-9/&'\-]*(?:\s+[A-Z][A-Za-z0-9/&'\-]*){1,7}$"),
    ("capitals", r"^[A-Z][A-Z0-9 /&(),'.\-–—]{4,99}$"),
]
LONG, PART = 7000, 6500
_COMPILED = [(k, re.compile(p)) for k, p in HEADINGS]


def line_kind(line: Column | str) -> Column:
    """The kind of a line: a heading's, `page`, `blank` or `text`."""
    s = T.squeezed(line)
    out = F.when(s == "", "blank").when(F.length(s) > 180, "text")
    for kind, p in HEADINGS:
        hit = s.rlike(p)
        if kind == "title":
            hit = hit & (F.length(s) <= 80)
        if kind == "capitals":
            hit = hit & s.rlike("[A-Z]{3}")
        out = out.when(hit, kind)
    return out.otherwise("text")


def _kind(s: str) -> str:
    if not s or len(s) > 180:
        return "text" if s else "blank"
    for kind, p in _COMPILED:
        if p.search(s) and not (kind == "title" and len(s) > 80) and not (kind == "capitals" and not re.search("[A-Z]{3}", s)):
            return kind
    return "text"


def _level(kind: str, s: str) -> int:
    if kind == "markdown":
        return min(6, len(re.match("#+", s)[0]) + 2)
    if kind == "paragraph":
        return min(6, len(re.match(r"[\d.]+", s)[0].strip(".").split(".")) + 2)
    return {"division": 1, "spec-section": 2, "part": 3, "article": 3}.get(kind, 4)


def segment(text: str | None) -> list[dict]:
    """The sections of a document in order: a heading, what stands below it, its place in the hierarchy and its pages."""
    nodes: list[dict] = []
    open_: list[dict] = []
    page = seen = None
    for i, line in enumerate((text or "").replace("\r", "").split("\n"), 1):
        s = " ".join(line.split())
        kind = _kind(s)
        if kind == "page":
            page = int(s.split()[1])
            continue
        if kind in ("blank", "text"):
            if not nodes and kind == "text":
                nodes.append({"heading": "Document beginning", "kind": "heading", "level": 4, "path": ["Document beginning"], "parent": None, "number": "", "division": "", "page_start": page, "start_line": i, "lines": [], "at": 0})
                open_, seen = [nodes[-1]], page
            if nodes:
                nodes[-1]["lines"].append(line)
                if kind == "text":
                    seen = page or seen
                    nodes[-1]["page_end"] = seen
            continue
        level, title = _level(kind, s), re.sub(r"^#{1,6}\s*", "", s)
        open_ = [n for n in open_ if n["level"] < level]
        number, division = "", ""
        if kind == "spec-section":
            d = re.sub(r"\D", "", re.match(r"(?:SECTION\s+)?([\d\s.\-]+)", title, re.I)[1])[:6]
            number, division = f"{d[:2]} {d[2:4]} {d[4:6]}", d[:2]
        elif kind == "division":
            division = re.search(r"\d{1,2}", title)[0].zfill(2)
        above = next((n for n in reversed(open_) if n["number"]), None)
        over = next((n for n in reversed(open_) if n["division"]), None)
        node = {"heading": title, "kind": kind, "level": level, "path": [n["heading"] for n in open_] + [title], "parent": open_[-1]["at"] if open_ else None, "number": number or (above["number"] if above else ""),
                "division": division or (over["division"] if over else ""), "page_start": page, "start_line": i, "lines": []}
        seen = page
        nodes.append(node)
        open_.append(node)
        node["at"] = len(nodes) - 1
    for n in nodes:
        n["text"] = "\n".join(n.pop("lines")).strip()
    return nodes


def parts(text: str, long: int = LONG, part: int = PART) -> list[str]:
    """A long text cut at blank lines into parts of at most `part` characters (a longer paragraph stays whole)."""
    if len(text) <= long:
        return [text]
    out: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        if out and len(out[-1]) + 2 + len(p) <= part:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


SCHEMA = (
    "document_id string, section_id string, parent_id string, heading string, kind string, level int, path array<string>, section_number string, division string, "
    "page_start int, page_end int, start_line int, part int, ord int, text string"
)


def sections(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per section or part of every document; documents are independent, so nothing is shuffled.

    The order of headings decides about parents: that is sequential inside a
    document, and done in Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                nodes, n = segment(text), 0
                for i, x in enumerate(nodes):
                    own = f"{doc}#{i}"
                    up = None if x["parent"] is None else f"{doc}#{x['parent']}"
                    cut = parts(x["text"])
                    for k, t in enumerate(cut, 1):
                        head = x["heading"] if len(cut) == 1 else f"{x['heading']} — Part {k}"
                        rows.append((str(doc), own if k == 1 else f"{own}-part-{k}", up if k == 1 else own, head, x["kind"], x["level"], x["path"], x["number"], x["division"], x["page_start"], x.get("page_end") or x["page_start"], x["start_line"], k, n, t))
                        n += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for c in ("page_start", "page_end"):
                out[c] = out[c].astype("Int32")
            yield out

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, SCHEMA)
