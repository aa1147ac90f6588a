"""Queries of drawing operators over literal sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drawings as D
from . import sqltext as S
from .corpus import Rows, frame, values

SH_SCHEMA = "sheet_id string, document_id string, page int, number string, title string, discipline string, types array<string>"
SHEETS = Rows([("h1", "d", 1, "A-101", "First floor plan", "Architectural", ["Plan"]), ("h2", "d", 2, "M-201", "Equipment schedule", "Mechanical", ["Schedule"]), ("h3", "d", 3, "E-301", "Riser details", "Electrical", ["Riser", "Detail"]), ("h4", "d", 4, "A-102", "Roof plan", "Architectural", ["Plan"]), ("h5", "d", 5, "A102", "List of drawings", "General", ["Index"])], """
SELECT 'pt' || CAST(p_partkey AS STRING), 'd' || CAST(p_partkey % 10 AS STRING), CAST(p_partkey AS INT) + 10, CASE p_partkey % 4 WHEN 0 THEN 'A-' WHEN
1 THEN 'M-' WHEN 2 THEN 'E-' ELSE 'P-' END || CAST(100 + p_partkey AS STRING), CASE p_partkey % 5 WHEN 0 THEN 'Floor plan' WHEN 1 THEN 'Roof plan'
WHEN 2 THEN 'Equipment schedule' WHEN 3 THEN 'Riser diagram' ELSE 'Section' END || ' ' || CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN
'Architectural' WHEN 1 THEN 'Mechanical' WHEN 2 THEN 'Electrical' ELSE 'Plumbing' END, CASE p_partkey % 5 WHEN 2 THEN LIST['Schedule'] WHEN 3 THEN
LIST['Riser', 'Diagram'] WHEN 4 THEN LIST['Section'] ELSE LIST['Plan'] END FROM {part}
""")
IT_SCHEMA = "sheet_id string, page int, item int, text string, x double, y double, w double, h double"
ITEMS = Rows([
    ("h1", 1, 1, "ROOM 101", 0.1, 0.1, 0.1, 0.02), ("h1", 1, 2, "102", 0.3, 0.1, 0.05, 0.02), ("h1", 1, 3, "AHU-1", 0.5, 0.5, 0.1, 0.02), ("h1", 1, 4, "3/A-501", 0.6, 0.6, 0.1, 0.02), ("h1", 1, 5, "ROOM 101", 0.1, 0.9, 0.1, 0.02),
    ("h2", 2, 6, "AHU 1 supply fan", 0.2, 0.2, 0.2, 0.02), ("h2", 2, 7, "VAV-12", 0.2, 0.3, 0.1, 0.02), ("h3", 3, 8, "SHEET TITLE:", 0.7, 0.9, 0.1, 0.02), ("h3", 3, 9, "Riser details", 0.7, 0.92, 0.2, 0.02), ("h3", 3, 10, "DRAWING NUMBER", 0.7, 0.95, 0.1, 0.02), ("h3", 3, 11, "E-301", 0.71, 0.97, 0.1, 0.02),
    ("h4", 4, 12, "ROOM 101", 0.2, 0.2, 0.1, 0.02), ("h4", 4, 13, "no ids here 1234567", 0.2, 0.4, 0.1, 0.02),
], """
SELECT 'pt' || CAST(p_partkey AS STRING), CAST(p_partkey AS INT) + 10, CAST(p_partkey AS INT) + 1000, CASE p_partkey % 5 WHEN 0 THEN 'ROOM ' ||
CAST(100 + p_partkey % 300 AS STRING) WHEN 1 THEN CAST(200 + p_partkey % 70 AS STRING) WHEN 2 THEN 'AHU-' || CAST(p_partkey AS STRING) WHEN 3 THEN
'2/A-' || CAST(500 + p_partkey % 40 AS STRING) ELSE p_name END, (p_partkey % 10) / 10.0, (p_partkey % 7) / 10.0, 0.1, 0.02 FROM {part}
""")
TITLES = Rows([("1A-101", "First floor plan"), ("M201", "Mechanical SCHEDULES"), ("QX", "Penthouse riser"), (None, None), ("FA-01", "Section and detail"), ("T100", "List of drawings")], """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'A-' WHEN 1 THEN 'M' WHEN 2 THEN 'E-' WHEN 3 THEN 'FP-' WHEN 4 THEN 'C' ELSE 'X' END || CAST(100 + p_partkey AS
STRING), CASE p_partkey % 5 WHEN 0 THEN 'First floor plan' WHEN 1 THEN 'Equipment schedule' WHEN 2 THEN 'Riser' WHEN 3 THEN 'Details' ELSE 'Roof' END
|| ' ' || p_name FROM {part}
""")
_LETTERS = "regexp_extract(upper(coalesce(number, '')), '^[0-9]*([A-Z]{1,3})[-.]?[0-9]', 1)"
_BY_TITLE = S.ladder("title", D.TITLE_DISCIPLINES, "Unknown")
_KINDS = "list_filter([" + ", ".join(f"CASE WHEN {S.has('title', p)} THEN '{n}' END" for n, p in D.TYPES) + "], lambda x: x IS NOT NULL)"
SHEET_CLASSES = f"""WITH t AS (SELECT number, title, {S.ladder(_LETTERS, D.DISCIPLINES, '?')} AS d, {_KINDS} AS k FROM {values(TITLES, 'number string, title string')})
  SELECT number, title, CASE WHEN d <> '?' THEN d ELSE {_BY_TITLE} END AS discipline, CASE WHEN len(k) > 0 THEN k ELSE ['Unknown'] END AS kinds, CASE {" ".join(f"WHEN list_contains(k, '{n}') THEN '{n}'" for n in D.PRIMARY)} ELSE 'Unknown' END AS kind, {S.ladder('title', D.FLOORS, '')} AS floor FROM t"""
ASKS = Rows([("q1", "where is room 102"), ("q2", "open the schedule on M-201"), ("q3", "show Room 101"), ("q4", "find VAV 12"), ("q5", "coordinate risers"), ("q6", "A-102 please"), ("q7", "hello")], """
SELECT 't' || CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING), text FROM {conversations}
""")
ROWS = Rows([("k1", 1, "Tag", "AHU-1"), ("k1", 1, "Serves", "Room 101"), ("k1", 2, "Tag", "VAV-12"), ("k2", 1, "Mark", "EF-3"), ("k2", 2, "Mark", "VAV 12")], """
SELECT 'order' || CAST(l_orderkey AS STRING), CAST(l_linenumber AS INT), CASE l_linenumber % 2 WHEN 0 THEN 'Tag' ELSE 'Mark' END, 'AHU-' ||
CAST(l_partkey AS STRING) FROM {lineitem}
""")
TAGS = [("AHU 1",), ("VAV12",), ("UPS-9",)]
PT = "array<struct<x:double,y:double>>"
LEGEND = [("duplex", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), ("switch", [(0.0, 0.0), (0.0, 2.0)])]
SYMBOLS = [("s1", [(5.0, 5.0), (7.0, 5.0), (7.0, 7.0)]), ("s2", [(3.0, 1.0), (3.0, 9.0)]), ("s3", [(0.0, 0.0), (1.0, 2.0)])]
INDEX = Rows([("e1", "A-101", "x"), ("e2", "A102", ""), ("e3", "Z-1", "Equipment Schedule"), ("e4", "Z-2", "none")], """
SELECT 'x' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 3 > 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'E' ELSE 'P'
END || CAST(100 + p_partkey AS STRING) ELSE 'none' END, CASE p_partkey % 5 WHEN 0 THEN 'Floor plan' WHEN 1 THEN 'Roof plan' WHEN 2 THEN
'Equipment schedule' WHEN 3 THEN 'Riser diagram' ELSE 'Section' END || ' ' || CAST(p_partkey AS STRING) FROM {part}
""")
PAGES = Rows([(1, "See 01 45 00 and 99 99 99.", "Mechanical"), (2, "pump and valve", "Mechanical"), (3, "nothing", "Electrical"), (4, None, "Civil")], """
SELECT CAST(p_partkey AS INT) + 10, CASE p_partkey % 4 WHEN 0 THEN 'See 01 45 00 for ' || p_name WHEN 1 THEN 'pump for ' || p_name WHEN 2 THEN p_name
END, CASE p_partkey % 3 WHEN 0 THEN 'Mechanical' WHEN 1 THEN 'Electrical' ELSE 'Civil' END FROM {part}
""")
SPECS = [("01 45 00",), ("23 21 23",), ("26 05 00",), ("23 05 00",)]
VOCAB = [("pump", "23 21 23"), ("valve", "23 05 00"), ("pump", "23 21 23")]
DIVS = [("Mechanical", "23"), ("Electrical", "26")]
FIX = [("h1", "room-number-text", "102", "Corrected", "102A"), ("h1", "callout-text", "3/A-501", "Rejected", None)]
SHS, ITS = values(SHEETS, SH_SCHEMA), values(ITEMS, IT_SCHEMA)
RX = lambda p: S.q(p)
OBS = f"""(SELECT sheet_id, item, kind, value, confidence FROM (SELECT sheet_id, item, unnest(['room-number-text', 'equipment-tag-text', 'callout-text']) AS kind,
  unnest([CASE WHEN regexp_matches(text, '(?i)\\bROOM\\b') OR regexp_matches(text, '^\\d{{2,5}}[A-Z]?$') THEN regexp_extract(text, {RX(D.ROOM)}, 1) END, CASE WHEN regexp_matches(text, {RX(D.TAG)}) THEN upper(regexp_extract(text, {RX(D.TAG)}, 1)) END,
    CASE WHEN regexp_matches(text, {RX(D.CALLOUT)}) THEN regexp_extract(text, {RX(D.CALLOUT)}, 1) || '/' || upper(regexp_extract(text, {RX(D.CALLOUT)}, 2)) END]) AS value,
  unnest([CASE WHEN regexp_matches(text, '(?i)\\bROOM\\b') THEN 0.95 ELSE 0.7 END, 0.9, 0.9])::DOUBLE AS confidence FROM {ITS}) WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY sheet_id, kind, value ORDER BY confidence DESC, item) = 1)"""


def sheets(s):
    return frame(s, SHEETS, SH_SCHEMA)


def items(s):
    return frame(s, ITEMS, IT_SCHEMA)


def obs(s):
    return D.observations(items(s))


def points(s, rows, name):
    return s.createDataFrame(rows, f"{name} string, points {PT}")


#: Corners of a supplier's zone around its balance in two hundreds and two for each nation: a dented hexagon.
ZONE = [(-9.0, 0.0), (-4.0, 7.0), (5.0, 7.0), (2.0, 0.5), (5.0, -7.0), (-4.0, -7.0)]


def polygons_at_a_point(s, f):
    """Whether one point lies in a few shapes and in every supplier's zone."""
    z = s.read.parquet(f"{f}/supplier.parquet")
    corners = F.array(*(F.struct((F.col("s_acctbal") / 200 + x).alias("x"), (F.col("s_nationkey") * 2.0 + y).alias("y")) for x, y in ZONE))
    shapes = points(s, [*LEGEND, ("square", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "name").unionByName(z.select(F.col("s_name").alias("name"), corners.cast(PT).alias("points")))
    return shapes.select("name", D.contains_point(F.col("points"), 0.9, 0.3).alias("inside"))


def links(s):
    return D.specification_links(frame(s, PAGES, "page int, text string, discipline string"), frame(s, SPECS, "number string"), frame(s, VOCAB, "term string, number string"), frame(s, DIVS, "discipline string, division string"))


LINKS = f"""(WITH p AS {values(PAGES, 'page int, text string, discipline string')}, s AS {values(SPECS, 'number string')}, a AS (SELECT DISTINCT page, number, 'explicit' AS tier, 0.95::DOUBLE AS confidence FROM (SELECT page, unnest(regexp_extract_all(text, '\\b\\d{{2}} \\d{{2}} \\d{{2}}\\b')) AS number FROM p) WHERE number IN (SELECT number FROM s)),
  b AS (SELECT DISTINCT page, v.number, 'vocabulary' AS tier, 0.7::DOUBLE AS confidence FROM (SELECT page, unnest(string_split(lower(text), ' ')) AS term FROM p) w JOIN {values(VOCAB, 'term string, number string')} v USING (term) WHERE page NOT IN (SELECT page FROM a)),
  c AS (SELECT page, number, 'discipline' AS tier, 0.5::DOUBLE AS confidence FROM p JOIN {values(DIVS, 'discipline string, division string')} USING (discipline) JOIN s ON number[1:2] = division WHERE page NOT IN (SELECT page FROM a UNION SELECT page FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"""


def _search_sql(n: str) -> str:
    return f"""WITH r AS (SELECT h.sheet_id, page, CASE WHEN lower(number) = '{n}' THEN 0 WHEN contains(lower(number), '{n}') THEN 1 WHEN contains(lower(title), '{n}') THEN 2 WHEN contains(lower(discipline), '{n}') THEN 3 WHEN contains(lower(array_to_string(types, '|')), '{n}') THEN 4
      WHEN o.r IS NOT NULL THEN o.r WHEN h.sheet_id IN (SELECT sheet_id FROM {ITS} WHERE contains(lower(text), '{n}')) THEN 8 END AS rank FROM {SHS} h LEFT JOIN (SELECT sheet_id, min(CASE WHEN kind LIKE 'room%' THEN 5 WHEN kind = 'equipment-tag-text' THEN 6 ELSE 7 END) AS r FROM {OBS} WHERE contains(lower(value), '{n}') GROUP BY 1) o USING (sheet_id))
      SELECT sheet_id, page, rank, ['exact number', 'partial number', 'title', 'discipline', 'type', 'room', 'tag', 'observation', 'text'][rank + 1] AS reason FROM r WHERE rank IS NOT NULL"""


QUERIES = {
    "sheet_classes": (lambda s, f: frame(s, TITLES, "number string, title string").select("number", "title", D.discipline("number", "title").alias("discipline"), D.sheet_types("title").alias("kinds"), D.sheet_type("title").alias("kind"), D.floor("title").alias("floor")), SHEET_CLASSES),
    "construction_intents": (lambda s, f: frame(s, ASKS, "question_id string, question string").select("question_id", D.construction_intent("question").alias("intent"), F.array_join(D.intent_sources(D.construction_intent("question")), ">").alias("sources")),
                             f"WITH a AS (SELECT question_id, {S.ladder('question', D.INTENTS, 'general')} AS intent FROM {values(ASKS, 'question_id string, question string')}) SELECT question_id, intent, CASE intent " + " ".join(f"WHEN '{k}' THEN '{'>'.join(v)}'" for k, v in D.SOURCES.items()) + " ELSE '' END AS sources FROM a"),
    "drawing_observations": (lambda s, f: obs(s), f"SELECT * FROM {OBS}"),
    "corrected_observations": (lambda s, f: D.corrected(obs(s), frame(s, FIX, "sheet_id string, kind string, value string, status string, corrected_value string")), f"SELECT o.sheet_id, o.kind, CASE WHEN status = 'Corrected' THEN corrected_value ELSE o.value END AS value, coalesce(status, 'Unverified') AS status FROM {OBS} o LEFT JOIN {values(FIX, 'sheet_id string, kind string, value string, status string, corrected_value string')} c ON c.sheet_id = o.sheet_id AND c.kind = o.kind AND c.value = o.value"),
    "sheet_search": (lambda s, f: D.search_sheets(sheets(s), obs(s), items(s), "10"), _search_sql("10")),
    "sheet_search_words": (lambda s, f: D.search_sheets(sheets(s), obs(s), items(s), "Riser"), _search_sql("riser")),
    "plan_constraints": (lambda s, f: D.constrained(sheets(s), obs(s), discipline="Architectural", room="101", kind="Plan").select("sheet_id"), f"SELECT sheet_id FROM {SHS} WHERE discipline = 'Architectural' AND list_contains(types, 'Plan') AND sheet_id IN (SELECT sheet_id FROM {OBS} WHERE value = '101')"),
    "visible_overlays": (lambda s, f: D.visible(items(s), 0.15, 0.05, 0.55, 0.55).select("item"), f"SELECT item FROM {ITS} WHERE x < 0.55 AND x + w > 0.15 AND y < 0.55 AND y + h > 0.05"),
    "points_in_polygons": (polygons_at_a_point, "SELECT * FROM (VALUES ('duplex', true), ('switch', false), ('square', true)) t(name, inside) UNION ALL SELECT name, len(list_filter(range(1, 7), lambda i: ((c[i].y > 0.3) <> (c[i % 6 + 1].y > 0.3) AND 0.9 < (c[i % 6 + 1].x - c[i].x) * (0.3 - c[i].y) / (c[i % 6 + 1].y - c[i].y) + c[i].x))) % 2 = 1 FROM (SELECT s_name AS name, ["
        + ", ".join(f"{{'x': s_acctbal / 200 + ({x}), 'y': s_nationkey * 2.0::DOUBLE + ({y})}}" for x, y in ZONE) + "] AS c FROM supplier)"),
    "title_block": (lambda s, f: D.title_block(items(s), ["SHEET TITLE", "DRAWING NUMBER"]), f"WITH i AS (SELECT *, upper(regexp_replace(trim(text), ':$', '')) AS k FROM {ITS}), p AS (SELECT l.sheet_id, l.k AS label, v.text AS value, row_number() OVER (PARTITION BY l.sheet_id, l.item ORDER BY 4 * abs(v.x - l.x) + abs(v.y - l.y), v.item) AS n FROM i l JOIN i v ON v.sheet_id = l.sheet_id AND v.x >= l.x - 0.02 AND v.y >= l.y - 0.01 WHERE l.k IN ('SHEET TITLE', 'DRAWING NUMBER') AND v.k NOT IN ('SHEET TITLE', 'DRAWING NUMBER')) SELECT sheet_id, label, value FROM p WHERE n = 1"),
    "schedule_tag_column": (lambda s, f: D.tag_column(frame(s, ROWS, "schedule_id string, row int, field string, value string")), f"WITH g AS (SELECT schedule_id, field, count(*) AS n FROM {values(ROWS, 'schedule_id string, r int, field string, value string')} WHERE regexp_matches(value, {RX(D.TAG)}) GROUP BY ALL) SELECT schedule_id, arg_max(field, (n, field)) AS tag_column FROM g GROUP BY 1"),
    "schedule_rows_by_tag": (lambda s, f: D.schedule_rows_by_tag(frame(s, ROWS, "schedule_id string, row int, field string, value string"), frame(s, TAGS, "tag string")), f"WITH g AS (SELECT upper(regexp_replace(value, '[- ]', '', 'g')) AS k, count(DISTINCT (schedule_id, r)) AS n, min(schedule_id) AS schedule_id, min(r) AS r FROM {values(ROWS, 'schedule_id string, r int, c string, value string')} GROUP BY 1) SELECT tag, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'unavailable' END AS state, CASE WHEN n = 1 THEN schedule_id END AS schedule_id, CASE WHEN n = 1 THEN r END AS row FROM {values(TAGS, 'tag string')} t LEFT JOIN g ON g.k = upper(regexp_replace(tag, '[- ]', '', 'g'))"),
    "legend_matches": (lambda s, f: D.legend_matches(points(s, LEGEND, "name"), points(s, SYMBOLS, "symbol_id")), "SELECT * FROM (VALUES ('s1', 'duplex'), ('s2', 'switch')) t(symbol_id, name)"),
    "drawing_index": (lambda s, f: D.reconcile_index(frame(s, INDEX, "entry string, number string, title string"), sheets(s)), f"WITH k AS (SELECT sheet_id, regexp_replace(upper(number), '[^A-Z0-9]', '', 'g') AS n, regexp_replace(upper(title), '[^A-Z0-9]', '', 'g') AS t FROM {SHS}), a AS (SELECT n, count(*) AS c, min(sheet_id) AS id FROM k GROUP BY 1), b AS (SELECT t, count(*) AS c, min(sheet_id) AS id FROM k GROUP BY 1) SELECT entry, CASE WHEN a.c = 1 THEN a.id WHEN a.c IS NULL AND b.c = 1 THEN b.id END AS sheet_id, CASE WHEN a.c = 1 THEN 'number' WHEN a.c > 1 THEN 'ambiguous' WHEN b.c = 1 THEN 'title' WHEN b.c > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM {values(INDEX, 'entry string, number string, title string')} i LEFT JOIN a ON a.n = regexp_replace(upper(i.number), '[^A-Z0-9]', '', 'g') LEFT JOIN b ON b.t = regexp_replace(upper(i.title), '[^A-Z0-9]', '', 'g')"),
    "sheet_coverage": (lambda s, f: D.coverage(sheets(s), obs(s)), f"SELECT discipline, count(*) AS sheets, count(o.sheet_id) AS covered, floor(100.0 * count(o.sheet_id) / count(*) + 0.5) AS percent FROM {SHS} h LEFT JOIN (SELECT DISTINCT sheet_id FROM {OBS}) o ON o.sheet_id = h.sheet_id GROUP BY 1"),
    "engineering_locations": (lambda s, f: D.resolve_locations(frame(s, ASKS, "question_id string, question string"), sheets(s), obs(s)), f"""WITH q AS (SELECT question_id, regexp_replace(regexp_extract(upper(question), {RX('(' + D.SHEET_NUMBER + ')')}, 1), '[-. ]', '', 'g') AS qs, upper(regexp_extract(question, '(?i)\\bROOM\\s*(\\d{{2,5}}[A-Z]?)\\b', 1)) AS qr, regexp_replace(upper(regexp_extract(question, {RX(D.TAG)}, 1)), '[- ]', '', 'g') AS qt FROM {values(ASKS, 'question_id string, question string')}),
      s AS (SELECT regexp_replace(upper(number), '[-. ]', '', 'g') AS k, count(*) AS n, min(sheet_id) AS id FROM {SHS} GROUP BY 1), r AS (SELECT upper(value) AS k, count(DISTINCT sheet_id) AS n, min(sheet_id) AS id FROM {OBS} WHERE kind = 'room-number-text' GROUP BY 1), t AS (SELECT regexp_replace(upper(value), '[- ]', '', 'g') AS k, count(DISTINCT sheet_id) AS n, min(sheet_id) AS id FROM {OBS} WHERE kind = 'equipment-tag-text' GROUP BY 1),
      j AS (SELECT question_id, coalesce(s.n, r.n, t.n) AS n, CASE WHEN s.n IS NOT NULL THEN 'sheet' WHEN r.n IS NOT NULL THEN 'room' WHEN t.n IS NOT NULL THEN 'equipment' ELSE 'none' END AS kind, coalesce(s.id, r.id, t.id) AS id FROM q LEFT JOIN s ON s.k = qs LEFT JOIN r ON r.k = qr LEFT JOIN t ON t.k = qt)
      SELECT question_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS state, kind, CASE WHEN n = 1 THEN id END AS target FROM j"""),
    "specification_links": (lambda s, f: links(s), f"SELECT * FROM {LINKS}"),
    "specification_reverse_index": (lambda s, f: D.reverse_index(links(s), frame(s, PAGES, "page int, text string, discipline string")), f"SELECT number, count(DISTINCT page) AS pages, count(DISTINCT discipline) AS disciplines, max(confidence) AS best FROM {LINKS} JOIN {values(PAGES, 'page int, text string, discipline string')} USING (page) GROUP BY 1"),
}
