"""File readers: each gives one row per file, record or positioned text, and an error column instead of a failure."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_KINDS = ("txt", "md", "csv", "json", "log", "xml", "html", "htm")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, text): whole text files."""
    name = F.element_at(F.split("path", "/"), -1)
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "text")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Records of delimited files: quotes are honoured, all columns are strings; `_corrupt` has the line of a row with too few or too many fields, else null."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    head = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).schema(schema).csv(path)
    return head.toDF(*(c if c and not c.startswith("_c") else f"Column {i + 1}" for i, c in enumerate(names)), "_corrupt")


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processing file."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "" for t in p.iter()) for p in root.iter(_W + "p"))


def xlsx_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook."""
    z = zipfile.ZipFile(io.BytesIO(data))
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")]
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
        target = rels[sheet.get(_R + "id")].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for n, row in enumerate(root.iter(_S + "row"), 1):
            cells: list[str] = []
            for c in row.iter(_S + "c"):
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v, kind = c.find(_S + "v"), c.get("t")
                raw = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(_S + "t"))
                cells.append(strings[int(raw)] if kind == "s" and raw else raw)
            out.append((sheet.get("name"), int(row.get("r", n)), cells))
    return out


HEADER_WORDS = frozenset("no number id title name status date section description type activity start finish party location discipline".split())


def header_row(rows: list[list[str]], look: int = 20) -> int:
    """Index of the row that looks most like a header among the first ones: known words, then filled cells."""
    score = lambda r: (sum(bool(HEADER_WORDS & set(re.findall("[a-z]+", c.lower()))) for c in r), sum(bool(c) for c in r))
    return max(range(min(look, len(rows))), key=lambda i: (score(rows[i]), -i)) if rows else 0


def workbook_records(data: bytes) -> list[dict]:
    """Records of all sheets below their header rows."""
    by: dict[str, list[tuple[int, list[str]]]] = {}
    for sheet, n, cells in xlsx_rows(data):
        by.setdefault(sheet, []).append((n, cells))
    out = []
    for sheet, rows in by.items():
        h = header_row([c for _, c in rows])
        names = [c.strip() or f"Column {i + 1}" for i, c in enumerate(rows[h][1])] if rows else []
        for n, cells in rows[h + 1 :]:
            rec = {k: v for k, v in zip(names, cells, strict=False) if v != ""}
            if rec:
                out.append({"sheet": sheet, "row": n, "fields": rec})
    return out


_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|')|\[(?:\((?:\\.|[^\\()])*\)|[^\]()])*\]\s*TJ|(-?[\d.]+)\s+(-?[\d.]+)\s+(T[dD])|(?:-?[\d.]+\s+){4}(-?[\d.]+)\s+(-?[\d.]+)\s+(Tm)|BT|(-?[\d.]+)\s+TL|T\*", re.S)
_LIT = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)


def _literal(b: bytes) -> str:
    b = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), b)
    return re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(m[1], m[1]), b, flags=re.S).decode("latin-1")


def pdf_items(data: bytes) -> list[tuple[int, int, str, float, float]]:
    """(page, order, text, x, y) of the strings that a PDF's content streams show; fonts with their own encodings are not decoded."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    out, page = [], 0
    for m in _STREAM.finditer(data):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        page += 1
        x = y = lead = 0.0
        for s in _SHOW.finditer(body):
            t = s[0]
            if t == b"BT":
                x = y = 0.0
            elif s[3]:
                x, y = x + float(s[1]), y + float(s[2])
            elif s[6]:
                x, y = float(s[4]), float(s[5])
            elif s[7]:
                lead = float(s[7])
            elif t == b"T*":
                y -= lead
            else:
                text = "".join(_literal(v) for v in _LIT.findall(t))
                if text.strip():
                    out.append((page, len(out), text, x, y))
    return out


def _per_file(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """rows(bytes) -> list of tuples; a file that fails gives one row with the error."""
    width = len(schema.split(", "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(p, *r, None) for r in rows(bytes(content))]
                except Exception as e:  # noqa: BLE001  the error is the result for this file
                    out.append((p, *[None] * width, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", *(c.split()[0] for c in schema.split(", ")), "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, {schema}, error string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, "text string", lambda b: [(docx_text(b),)])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, fields map, error): records below the detected header rows."""
    out = _per_file(spark, path, "sheet string, row_number long, fields_json string", lambda b: [(r["sheet"], r["row"], pd.Series(r["fields"]).to_json()) for r in workbook_records(b)])
    return out.select("path", "sheet", "row_number", F.from_json("fields_json", "map<string,string>").alias("fields"), "error")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, item, text, x, y, error): positioned texts."""
    return _per_file(spark, path, "page long, item long, text string, x double, y double", pdf_items)


def lines_of(items: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Positioned texts joined to lines: a new line starts where y steps by more than the tolerance (a session by gap)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "item")
    s = items.withColumn("_new", F.coalesce((F.lag("y").over(w) - F.col("y") > tolerance).cast("int"), F.lit(0)))
    s = s.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "item", "text"))), lambda e: e["text"]), " ")
    return s.groupBy(*keys, "line").agg(joined.alias("text"), F.max("y").alias("y"))


def html_text(c: str):
    """Mark-up to plain text by expressions: hidden elements go, block ends become line ends, five entities are resolved."""
    s = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?is)<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>|<![^>]*>", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table|nav|footer)\s*>", "\n")
    s = F.regexp_replace(s, r"<[^>]*>", "")
    for e, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(e), F.lit(ch))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t\f\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """One row per sheet of drawing catalogs in JSON: building and set with every field of the sheet."""
    c = spark.read.option("multiLine", True).json(path)
    return c.select("drawingSetId", "buildingId", F.explode("sheets").alias("s")).select("drawingSetId", "buildingId", "s.*")
