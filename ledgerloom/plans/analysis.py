"""Queries of dependencies, timelines, evidence links and specification search over literal records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import extraction as X
from ..operators import retrieval as R
from . import sqltext as S
from .corpus import Rows, SECTIONS_SQL, frame, sections, values
from .extraction import NK, REQ, SENT, reqs
from .graph import ESQL, E_SCHEMA, EDGES

CLAUSE_SCHEMA = "clause_id string, own string, clause string"
CLAUSES = Rows([("c1", "s1#0", "before acceptance testing of site work"), ("c2", "s3#1", "after the commissioning report is approved by the engineer"), ("c3", "s2#0", "1.2 contractor qc"), ("c4", "s2#0", "")], """
SELECT 'cn' || CAST(n_nationkey AS STRING), 'n' || CAST(n_nationkey AS STRING) || '#0', CASE n_nationkey % 3 WHEN 0 THEN
'before the owner accepts the schedule of ' || n_name WHEN 1 THEN '1.' || CAST(n_nationkey AS STRING) || ' ' || n_name || ' after testing' ELSE
'upon delivery of the test report' END FROM {nation}
""")
EV_SCHEMA = "id string, text string, day date, days double, priority int"
EVENTS = Rows([("e1", "final acceptance testing of pumps", "2026-03-01", 10.0, 50), ("e2", "final acceptance testing pumps", "2026-04-15", 12.0, 60), ("e3", "delivery of steel", None, None, 10), ("e4", "notice to proceed", None, 3.0, 90), ("e5", "pumps testing", "2026-03-05", None, 20)], """
SELECT 'ev' || CAST(s_suppkey AS STRING), CASE s_suppkey % 3 WHEN 0 THEN 'final acceptance' WHEN 1 THEN 'delivery of goods' ELSE 'testing' END ||
' for ' || n_name, CASE WHEN s_suppkey % 4 > 0 THEN DATE '2026-02-01' + CAST(s_suppkey % 60 AS INT) END, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey %
20 + 0.0 END, CAST(s_suppkey % 100 AS INT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
""")
DUR_SCHEMA = "id string, anchor string, relation string, days double"
DURS = Rows([("d1", "ntp", "after", 14.0), ("d2", "ntp", "before", 2.5), ("d3", "unknown", "after", 1.0)], """
SELECT 'l' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING), 'o' || CAST(l_orderkey AS STRING), CASE l_linenumber % 2 WHEN 0 THEN
'before' ELSE 'after' END, (l_orderkey % 60) / 4.0 FROM {lineitem}
""")
ANCHORS = Rows([("ntp", "2026-01-31")], """
SELECT 'o' || CAST(o_orderkey AS STRING), CAST(o_orderdate AS DATE) FROM {orders} WHERE o_orderkey % 5 > 0
""")
RQ_SCHEMA = "requirement_id string, document_id string, section string, party string, needs_type string, statement string"
RQS = Rows([("r1", "d1", "01 45 00", "contractor", "report", "Contractor shall submit the test report"), ("r2", "d2", "02 10 00", None, None, "Owner inspects the roof"), ("r3", "d3", None, "owner", "photo", "Take photographs")], """
SELECT 'rs' || CAST(s_suppkey AS STRING), 'doc' || CAST(n_regionkey AS STRING), CASE s_suppkey % 3 WHEN 0 THEN '01 45 00' WHEN 1 THEN '02 10 00' ELSE
'03 30 00' END, CASE s_suppkey % 2 WHEN 0 THEN 'contractor' ELSE 'owner' END, CASE s_suppkey % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'photo' END,
'Contractor shall submit the report of ' || n_name || ' goods' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
""")
EE_SCHEMA = "evidence_id string, document_id string, section string, party string, type string, links_to string, text string, result string"
EES = Rows([("v1", "d1", "01 45 00", "contractor", "report", None, "Pump test report", "pass"), ("v2", "d9", "02 10 00", "owner", "photo", "r3", "Roof photographs", "fail"), ("v3", "d8", "01 45 00", None, "report", None, "Pump test report.", "fail"), ("v4", "d8", "01 45 00", None, "report", None, "Pump test report", "fail")], """
SELECT 'vs' || CAST(s_suppkey AS STRING), 'doc' || CAST(s_suppkey % 9 AS STRING), CASE s_suppkey % 4 WHEN 0 THEN '01 45 00' WHEN 1 THEN '02 10 00'
WHEN 2 THEN '03 30 00' ELSE '09 99 00' END, CASE s_suppkey % 3 WHEN 0 THEN 'contractor' WHEN 1 THEN 'owner' ELSE 'engineer' END, CASE s_suppkey % 3
WHEN 0 THEN 'report' WHEN 1 THEN 'photo' ELSE 'log' END, CASE WHEN s_suppkey % 10 = 0 THEN 'rs' || CAST(s_suppkey AS STRING) END, n_name || ' goods '
|| CASE s_suppkey % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'photographs' ELSE 'delivered' END, CASE s_suppkey % 2 WHEN 0 THEN 'pass' ELSE 'fail' END FROM
{supplier} JOIN {nation} ON s_nationkey = n_nationkey
""")
LN_SCHEMA = "page int, line int, text string"
LINES = [(1, 1, "SECTION 01 10 00 SUMMARY .......... 3"), (1, 2, "SECTION 01 20 00 PRICE 5"), (3, 1, "SECTION 01 10 00 - SUMMARY"), (5, 1, "SECTION 012000"), (5, 2, "PRICE AND PAYMENT"), (7, 1, "SECTION 03 30 00: CONCRETE"), (8, 1, "section 03 30 00 CONCRETE"), (9, 1, "End")]
SP_SCHEMA = "number string, title string, body string"
SPECS = Rows([("01 32 16", "Construction schedule", "Milestone and completion dates"), ("03 30 00", "Concrete", "Schedule of mixes and curing duration"), ("01 45 00", "Quality control", "Inspection"), ("23 21 23", "Hydronic pumps", None)], """
SELECT '0' || CAST(p_partkey % 9 AS STRING) || ' ' || CAST(10 + p_partkey % 80 AS STRING) || ' 00', p_name || ' schedule', p_type FROM {part}
""")
VO_SCHEMA = "term string, scope string"
VOCAB = Rows([("Work", ""), ("Punch List", "closeout"), ("final acceptance", None), ("Owner QC", "inspection")], """
SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'schedule' ELSE '' END FROM {nation}
""")
HIT_SCHEMA = "source_number int, id string, document_id string, heading string, text string"
HITS = Rows([(2, "s2", "d1", "Owner QC", "Owner shall inspect. It may test."), (1, "s1", "d1", "Quality", "Contractor shall test. Then report. Then test and report again. Nothing else."), (3, "s5", "d2", "Records", None)], """
SELECT CAST(doc_id + 100 AS INT), 'doc' || CAST(doc_id AS STRING), source, lang, text FROM {documents}
""")
TEXTS = [("t1", "Room 101a has AHU-1; see 01 45 00 by 2026-01-05. The Owner and contractor agree."), ("t2", None), ("t3", "room 7 ahu-1 AHU-1")]
FI = [("a",), ("f",), ("e",), ("zz",)]
OVER = lambda a, b: f"(len(list_intersect({a}, {b})) / greatest(1, len({a}), len({b}))::DOUBLE)"
LONG = lambda c: f"list_distinct(list_filter(string_split({NK(c)}, ' '), lambda w: len(w) >= 4))"
PRANK = "CASE phase " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in A.PHASE_RANK.items()) + " ELSE 99 END"


def clauses(s):
    return frame(s, CLAUSES, CLAUSE_SCHEMA)


def events(s):
    return frame(s, EVENTS, EV_SCHEMA)


def evid(s):
    return frame(s, EES, EE_SCHEMA)


def hits(s):
    return frame(s, HITS, HIT_SCHEMA)


_PHASE = f"""WITH r AS (SELECT requirement_id, document_id, {NK('heading')} AS h, {PRANK} AS k, {LONG('st')} AS w FROM {REQ} WHERE phase <> 'general'),
  p AS (SELECT a.requirement_id AS src, b.requirement_id AS dst, {OVER('a.w', 'b.w')} AS o, a.h = b.h AND a.h <> '' AS head, a.document_id = b.document_id AS doc FROM r a JOIN r b ON b.k = a.k + 1)
  SELECT src, dst, least(100, floor(100 * (0.45 + o + 0.2 * head::INTEGER + 0.1 * doc::INTEGER) + 0.5))::INTEGER AS confidence FROM p WHERE head OR (doc AND o >= 0.12) OR o >= 0.28"""
_CLAUSE = f"""WITH c AS (SELECT clause_id, own, {NK('clause')} AS c, {LONG('clause')} AS w, {S.ladder(NK('clause'), X.PHASES, 'general')} AS p FROM {values(CLAUSES, CLAUSE_SCHEMA)}), r AS (SELECT requirement_id, phase, {NK('heading')} AS h, {LONG('st')} AS rw FROM {REQ}),
  p AS (SELECT clause_id, requirement_id, {OVER('w', 'rw')} + CASE WHEN p = phase AND p <> 'general' THEN 0.25 ELSE 0 END + CASE WHEN h <> '' AND contains(c, h) THEN 0.25 ELSE 0 END AS score FROM c, r WHERE own <> requirement_id)
  SELECT clause_id, requirement_id, round(score, 6) AS score, row_number() OVER w::INTEGER AS place FROM p WHERE score >= 0.28 WINDOW w AS (PARTITION BY clause_id ORDER BY score DESC, requirement_id) QUALIFY row_number() OVER w <= 5"""
_TIME = f"""WITH e AS (SELECT *, {LONG('text')} AS w FROM {values(EVENTS, EV_SCHEMA)}), p AS (SELECT x.id AS a, y.id AS b, abs(x.day - y.day)::DOUBLE AS g, abs(x.days - y.days) AS d FROM e x JOIN e y ON x.id < y.id WHERE {OVER('x.w', 'y.w')} >= 0.35)
  SELECT a, b, 'date-discrepancy' AS kind, g AS gap, CASE WHEN g > 30 THEN 'high' WHEN g > 7 THEN 'medium' ELSE 'low' END AS severity FROM p WHERE g >= 1 UNION ALL SELECT a, b, 'duration-discrepancy', d, CASE WHEN d > 30 THEN 'high' ELSE 'medium' END FROM p WHERE d >= 1"""
_MILE = "CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN {i}" for i, m in enumerate(A.MILESTONE_ORDER)) + f" ELSE {len(A.MILESTONE_ORDER)} END"
_LINKS = f"""WITH r AS (SELECT *, {S.stem_set('statement')} AS w FROM {values(RQS, RQ_SCHEMA)}), e AS (SELECT *, {S.stem_set('text')} AS ew FROM {values(EES, EE_SCHEMA)}),
  p AS (SELECT requirement_id, evidence_id, least(1.0, 0.45 * {S.jaccard('w', 'ew')} + CASE WHEN r.document_id = e.document_id THEN 0.18 ELSE 0 END + CASE WHEN r.section = e.section THEN 0.17 ELSE 0 END + CASE WHEN links_to = requirement_id THEN 0.5 ELSE 0 END + CASE WHEN needs_type = type THEN 0.25 ELSE 0 END + CASE WHEN r.party = e.party THEN 0.08 ELSE 0 END) AS score FROM r, e)
  SELECT requirement_id, evidence_id, round(score, 6) AS score FROM p WHERE score >= 0.32"""
_INDEX = f"""WITH l AS (SELECT *, lead(text) OVER (ORDER BY page, line) AS nxt FROM {values(LINES, LN_SCHEMA)}), h AS (SELECT * FROM l WHERE regexp_matches(text, '(?i)^\\s*SECTION\\s+\\d{{2}}[ .-]?\\d{{2}}[ .-]?\\d{{2}}') AND (NOT regexp_matches(text, '\\.{{3,}}|\\s\\d{{1,4}}$') OR regexp_matches(text, '(?i)^\\s*SECTION\\s+\\d{{2}}[ .-]?\\d{{2}}[ .-]?\\d{{2}}\\s*$'))),
  c AS (SELECT *, count(*) OVER (PARTITION BY page) AS n, regexp_replace(regexp_extract(text, '(?i)SECTION\\s+([0-9 .-]{{6,8}})', 1), '[^0-9]', '', 'g') AS d, trim(regexp_extract(text, '(?i)^\\s*SECTION\\s+\\d{{2}}[ .-]?\\d{{2}}[ .-]?\\d{{2}}\\s*(?:[-–—:]\\s*)?(.*)$', 1)) AS t FROM h),
  s AS (SELECT page, line, d[1:2] || ' ' || d[3:4] || ' ' || d[5:6] AS number, CASE WHEN t <> '' THEN t ELSE trim(nxt) END AS title FROM c WHERE n <= 3 QUALIFY row_number() OVER (PARTITION BY d ORDER BY page, line) = 1)
  SELECT number, title, page AS start_page, CASE WHEN lead(page) OVER w IS NULL THEN 9 ELSE greatest(page, lead(page) OVER w - 1) END AS end_page FROM s WINDOW w AS (ORDER BY page, line)"""


def _rank_sql(question: str) -> str:
    terms = list(dict.fromkeys(R._tokens(question)))
    f = lambda c, t: f"contains(lower(coalesce({c}, '')), '{t}')"
    pts = " + ".join(f"CASE WHEN {f('number', t)} THEN 10 ELSE 0 END + CASE WHEN {f('title', t)} THEN 5 ELSE 0 END + CASE WHEN {f('body', t)} THEN 2 ELSE 0 END" for t in terms)
    hit = " + ".join(f"({f('number', t)} OR {f('title', t)} OR {f('body', t)})::INTEGER" for t in terms)
    return f"WITH s AS (SELECT number, {pts} + CASE WHEN number LIKE '01%' THEN 12 ELSE -4 END AS points, {hit} AS matched FROM {values(SPECS, SP_SCHEMA)}), k AS (SELECT * FROM s WHERE matched >= {2 if len(terms) > 3 else 1}) SELECT number, points::INTEGER AS points, matched::INTEGER AS matched FROM k WHERE number LIKE '01%' OR NOT EXISTS (SELECT 1 FROM k WHERE number LIKE '01%') ORDER BY points DESC, matched DESC, number LIMIT 5"


_Q = "when is the completion milestone in the schedule"
_WORDS = ["test", "report"]

QUERIES = {
    "phase_dependencies": (lambda s, f: A.phase_edges(reqs(s)), _PHASE),
    "clause_matches": (lambda s, f: A.clause_matches(clauses(s), reqs(s)).withColumn("score", F.round("score", 6)), _CLAUSE),
    "workflow_by_phase": (lambda s, f: A.workflow_by_phase(reqs(s)), f"SELECT phase, row_number() OVER (PARTITION BY phase ORDER BY strength DESC, requirement_id)::INTEGER AS place, requirement_id, {PRANK} AS rank FROM {REQ}"),
    "timeline_conflicts": (lambda s, f: A.timeline_conflicts(events(s)), _TIME),
    "chronological_order": (lambda s, f: A.chronological(events(s)), f"SELECT id, row_number() OVER (ORDER BY coalesce(day, (SELECT min(day) FROM {values(EVENTS, EV_SCHEMA)}) + {_MILE} * 365), priority DESC, id)::INTEGER AS place FROM {values(EVENTS, EV_SCHEMA)}"),
    "anchored_durations": (lambda s, f: A.anchored(frame(s, DURS, DUR_SCHEMA), frame(s, ANCHORS, "anchor string, day date")), f"SELECT id, CASE WHEN relation = 'before' THEN day - ceil(days)::INTEGER ELSE day + ceil(days)::INTEGER END AS due FROM {values(DURS, DUR_SCHEMA)} LEFT JOIN {values(ANCHORS, 'anchor string, day date')} USING (anchor)"),
    "evidence_links": (lambda s, f: A.evidence_links(frame(s, RQS, RQ_SCHEMA), evid(s)).withColumn("score", F.round("score", 6)), _LINKS),
    "evidence_pairs": (lambda s, f: A.evidence_pairs(evid(s)), f"WITH e AS (SELECT *, {S.stem_set('text')} AS w FROM {values(EES, EE_SCHEMA)}) SELECT x.evidence_id AS a, y.evidence_id AS b, CASE WHEN list_sort([x.result, y.result]) = ['fail', 'pass'] THEN 'conflicting' ELSE 'duplicate' END AS kind FROM e x JOIN e y ON x.type = y.type AND x.section = y.section AND x.evidence_id < y.evidence_id WHERE list_sort([x.result, y.result]) = ['fail', 'pass'] OR {S.jaccard('x.w', 'y.w')} >= 0.9"),
    "answer_context": (lambda s, f: A.context(hits(s)), f"SELECT string_agg('[S' || source_number || '] ' || heading || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY source_number) AS context, count(*) AS sources FROM {values(HITS, HIT_SCHEMA)} WHERE source_number <= 12"),
    "best_sentences": (lambda s, f: A.best_sentences(hits(s), _WORDS, 2), f"WITH x AS (SELECT id, unnest(s) AS sentence, unnest(range(len(s)))::INTEGER AS pos FROM (SELECT id, {S.sentences('text')} AS s FROM {values(HITS, HIT_SCHEMA)})), y AS (SELECT *, len(list_intersect({S.stem_set('sentence')}, ['test', 'report'])) AS k FROM x) SELECT id, pos, sentence FROM y WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, pos) <= 2"),
    "assisted_retrieval": (lambda s, f: A.expanded_retrieval(sections(s), ["owner inspection", "commissioning records"]).withColumn("score", F.round("score", 6)), None),
    "retrieval_session": (lambda s, f: A.session_audit(hits(s), frame(s, [(1,), (1,), (3,)], "source_number int")), f"SELECT count(*) AS found, count(*) FILTER (source_number IN (1, 3)) AS used, count(*) FILTER (source_number NOT IN (1, 3)) AS unused, count(DISTINCT document_id) AS documents, floor(100.0 * count(*) FILTER (source_number IN (1, 3)) / count(*) + 0.5) AS percent FROM {values(HITS, HIT_SCHEMA)}"),
    "specification_page_index": (lambda s, f: A.page_index(frame(s, LINES, LN_SCHEMA), 9), _INDEX),
    "document_search": (lambda s, f: A.search_pages(s.read.parquet(f"{f}/documents.parquet").select(F.col("doc_id").alias("page"), "text"), "licensed under", 20), "WITH p AS (SELECT doc_id AS page, text, instr(lower(text), 'licensed under') AS k FROM documents) SELECT page, trim(substr(text, greatest(k - 20, 1), k - greatest(k - 20, 1) + 14 + 20)) AS excerpt, len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9])licensed  under($|[^a-z0-9])'))::INTEGER AS n FROM p WHERE k > 0"),
    "specification_ranking": (lambda s, f: A.rank_specifications(frame(s, SPECS, SP_SCHEMA), _Q), _rank_sql(_Q)),
    "vocabulary_matches": (lambda s, f: A.vocabulary_matches(sections(s), frame(s, VOCAB, VO_SCHEMA)), f"WITH t AS (SELECT id, ' ' || {NK('text')} || ' ' AS k FROM {SECTIONS_SQL}), v AS (SELECT term, {NK('term')} AS tk, {NK('scope')} AS sk FROM {values(VOCAB, VO_SCHEMA)}) SELECT id, term, sk = '' OR contains(k, ' ' || sk || ' ') AS applies FROM t, v WHERE contains(k, ' ' || tk || ' ')"),
    "relevant_records": (lambda s, f: A.relevant_records(s.read.parquet(f"{f}/part.parquet").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("body")), "economy brass part 7"), f"WITH p AS (SELECT p_partkey AS id, list_distinct({S.tokens(chr(40) + 'p_name || chr(32) || p_type || chr(32) || p_brand' + chr(41))}) AS w FROM part), m AS (SELECT id, len(list_intersect(w, ['economy', 'brass', 'part']))::INTEGER AS matched FROM p) SELECT id, matched FROM m WHERE matched > 0 ORDER BY matched DESC, id LIMIT 10"),
    "entities": (lambda s, f: A.entities(frame(s, TEXTS, "id string, text string")), "SELECT * FROM (VALUES ('t1', 'section', '01 45 00'), ('t1', 'room', '101A'), ('t1', 'equipment', 'AHU-1'), ('t1', 'date', '2026-01-05'), ('t1', 'party', 'contractor'), ('t1', 'party', 'owner'), ('t3', 'equipment', 'AHU-1')) t(id, kind, value)"),
    "root_causes": (lambda s, f: A.root_causes(frame(s, FI, "node_a string"), frame(s, EDGES, E_SCHEMA)), f"WITH RECURSIVE r AS (SELECT dst AS seed, src AS node, 1 AS d FROM {ESQL} WHERE dst IN ('a', 'f', 'e') UNION SELECT r.seed, e.src, r.d + 1 FROM r JOIN {ESQL} e ON e.dst = r.node) SELECT seed AS finding_node, node AS cause, min(d)::INTEGER AS distance FROM r WHERE node IN ('a', 'f', 'e') AND node <> seed GROUP BY ALL"),
}
