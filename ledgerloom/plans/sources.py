"""Queries of readers, segmentation, ingest and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as E
from ..operators.graph import shared_folder
from ..sources import files as R
from ..sources import segment as G
from ..sources import store as St
from . import sqltext as S
from .corpus import Rows, frame, values

SPEC = """PAGE 10
DIVISION 01 – GENERAL REQUIREMENTS
SECTION 01-45-00: Quality Control
PART 1 - GENERAL
1.1 Owner QC
Owner shall inspect the Work and document deficiencies. See 01 91 00.
1.2 Contractor QC
Contractor shall perform testing before acceptance.
PAGE 11
019100 General Commissioning Requirements
Commissioning records are required. Per Section 01.45.00.
"""
NAMES = Rows([("1", "A-101 floor plan.pdf", "", ""), ("2", "033000 spec.docx", None, None), ("3", "x.xlsx", "Shop drawings", ""), ("4", "notes.txt", "", "minutes"), ("5", "readme", "", None)], """
SELECT 'p' || CAST(p_partkey AS STRING), p_name || CASE p_size % 4 WHEN 0 THEN ' floor plan.pdf' WHEN 1 THEN ' spec.docx' WHEN 2 THEN ' schedule.xlsx' ELSE '.txt' END, CASE WHEN p_partkey % 3 = 0 THEN 'Shop drawings' ELSE p_type END,
CASE WHEN p_partkey % 7 = 0 THEN 'minutes' END FROM {part}
""")
NAME_SCHEMA = "id string, name string, category string, explicit string"
ITEMS = Rows([(1, 0, "Sheet", 10.0, 700.0), (1, 1, "A-101", 60.0, 699.5), (1, 2, "Scale", 10.0, 650.0), (1, 3, "1:50", 60.0, 650.0), (2, 4, "Alone", 5.0, 20.0)], """
SELECT CAST(l_orderkey + 10 AS INT), l_linenumber, l_returnflag || CAST(l_partkey AS STRING), l_quantity, l_discount * 30 + 500 FROM {lineitem}
""")
ITEM_SCHEMA = "page int, item int, text string, x double, y double"


def shared(spark) -> str:
    shared_folder(spark.range(0))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def plain_pages(s, f):
    return s.read.parquet(f"{f}/pages.parquet").select("page_id", R.html_text("html").alias("text"))


def _plain_sql() -> str:
    x = "regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<title\\b.*?</title\\s*>|<![^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>|</(p|div|li|tr|h[1-6]|section|article|ul|ol|table|nav|footer)\\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for e, ch in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{e}', {ch})"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t\\f\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"SELECT page_id, trim(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')) AS text FROM pages"


def line_kinds(s, f):
    d = s.read.parquet(f"{f}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("doc_id", G.line_kind("line").alias("kind")).agg(F.count("*").alias("n"))


def _line_sql() -> str:
    w = ["WHEN s = '' THEN 'blank'", "WHEN len(s) > 180 THEN 'text'"]
    for k, p in G.HEADINGS:
        more = {"title": " AND len(s) <= 80", "capitals": " AND regexp_matches(s, '[A-Z]{3}')"}.get(k, "")
        w.append(f"WHEN regexp_matches(s, {S.q(p)}){more} THEN '{k}'")
    return f"WITH l AS (SELECT doc_id, {S.squeezed('line')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT doc_id, CASE {' '.join(w)} ELSE 'text' END AS kind, count(*) AS n FROM l GROUP BY ALL"


def spec_sections(s, f):
    x = G.sections(frame(s, [("spec", SPEC)], "id string, text string"))
    return x.select("section_id", "parent_id", "heading", "kind", "level", F.array_join("path", " > ").alias("path"), "section_number", "division", "page_start", "page_end", "text")


def document_sections(s, f):
    x = G.sections(s.read.parquet(f"{f}/documents.parquet"), "doc_id")
    return x.groupBy("document_id").agg(F.count("*").alias("sections"), F.max("part").cast("int").alias("parts"), F.sum(F.length("text")).alias("characters"))


def ingest(s, f):
    d = s.read.parquet(f"{f}/documents.parquet").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("name"), F.sha2("text", 256).alias("fingerprint")).withColumnRenamed("doc_id", "id")
    b = s.read.parquet(f"{f}/benchmark.parquet").select(F.col("item_id").alias("id"), F.lit("src1/en").alias("name"), F.sha2("text", 256).alias("fingerprint"))
    return St.ingest_actions(d, b)


_INGEST = """WITH d AS (SELECT doc_id AS id, source || '/' || lang AS name, sha256(text) AS fingerprint FROM documents), k AS (SELECT item_id AS id, 'src1/en' AS name, sha256(text) AS fingerprint FROM benchmark),
  j AS (SELECT d.*, (SELECT min(id) FROM k WHERE k.fingerprint = d.fingerprint) AS same, min(id) OVER (PARTITION BY fingerprint) AS first, (SELECT min(id) FROM k WHERE k.name = d.name) AS named FROM d)
  SELECT id, name, fingerprint, CASE WHEN same IS NOT NULL OR first <> id THEN 'skip' WHEN named IS NOT NULL THEN 'replace' ELSE 'import' END AS action, coalesce(same, CASE WHEN first <> id THEN first END, named) AS existing_id FROM j"""


def events(s, f):
    return s.read.schema(E.SCHEMA).parquet(f"{f}/events.parquet")


def stream(s, f):
    return E.read_events(s, f"{f}/events.parquet")


def rounded(df, c):
    return df.withColumn(c, F.round(c, 4))


def event_payload(s, f):
    """The number in the JSON payload, by type."""
    e = events(s, f).select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


ACTIVITY = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SESSIONS = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM r GROUP BY user_id, k"""
LATEST = "WITH w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since, count(*) FILTER (was <> event_type) AS changes FROM w GROUP BY 1"

QUERIES = {
    "html_plain_text": (plain_pages, _plain_sql()),
    "line_kinds": (line_kinds, _line_sql()),
    "specification_sections": (spec_sections, None),
    "document_sections": (document_sections, None),
    "ingest_actions": (ingest, _INGEST),
    "document_roles": (lambda s, f: frame(s, NAMES, NAME_SCHEMA).select("id", St.document_role(F.col("name"), F.col("category"), F.col("explicit")).alias("role")),
                       f"SELECT id, coalesce(CASE WHEN explicit <> '' THEN explicit END, {S.ladder('category', St.DOCUMENT_ROLES, 'X').replace(chr(39) + 'X' + chr(39), 'NULL')}, {S.ladder('name', St.DOCUMENT_ROLES, 'document')}) AS role FROM {values(NAMES, NAME_SCHEMA)}"),
    "positioned_lines": (lambda s, f: R.lines_of(frame(s, ITEMS, ITEM_SCHEMA), ["page"], 1.0), f"""WITH n AS (SELECT *, CASE WHEN lag(y) OVER w - y > 1.0 THEN 1 ELSE 0 END AS n FROM {values(ITEMS, ITEM_SCHEMA)} WINDOW w AS (PARTITION BY page ORDER BY y DESC, x, item)), l AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY y DESC, x, item)::INTEGER AS line FROM n)
      SELECT page, line, string_agg(text, ' ' ORDER BY x, item, text) AS text, max(y) AS y FROM l GROUP BY page, line"""),
    "event_activity": (lambda s, f: rounded(E.activity(events(s, f)), "total"), ACTIVITY),
    "event_sessions": (lambda s, f: E.sessions(events(s, f)), SESSIONS),
    "event_latest_states": (lambda s, f: E.latest_states(events(s, f)), LATEST),
    "event_payload": (event_payload, "SELECT event_type, count(json_extract(props, '$.k')) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS largest FROM events GROUP BY 1"),
    "event_distinct": (lambda s, f: E.distinct_events(events(s, f)).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1"),
    "stream_activity": (lambda s, f: rounded(E.run_once(E.activity(stream(s, f)), shared(s), "complete"), "total"), ACTIVITY),
    "stream_latest_states": (lambda s, f: E.run_once(E.latest_on_stream(stream(s, f)), shared(s), "complete"), "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since FROM events GROUP BY 1"),
    "stream_distinct_events": (lambda s, f: E.run_once(E.distinct_events(stream(s, f), "60 days"), shared(s)).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1"),
}
