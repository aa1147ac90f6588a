"""Queries of services over literal records and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import services as V
from . import sqltext as S
from .corpus import Rows, SECTIONS_SQL, frame, sections, values
from .extraction import REQ, reqs
from .project import DEFICIENCIES, DEF_SCHEMA

FILE_SCHEMA = "id string, name string, kind string, project string, confidence double, error string"
FILES = Rows([("f1", "a.pdf", "drawing", "p", 0.9, None), ("f2", "b", None, "p", 0.1, None), ("f3", "c", "report", "p", 0.5, None), ("f4", "d", "x", "p", 1.0, "bad file"), ("f5", "e", None, None, 0.9, None), ("f6", "f", "spec", "p", 0.3, None)], """
SELECT 'o' || CAST(o_orderkey AS STRING), 'order ' || CAST(o_orderkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN 'drawing' WHEN 1 THEN 'report' WHEN
2 THEN 'spec' END, CASE WHEN o_orderkey % 5 > 0 THEN 'p' || CAST(o_custkey % 7 AS STRING) END, (o_orderkey % 11) / 10.0, CASE WHEN o_orderkey % 13 = 0
THEN 'bad file' END FROM {orders}
""")
FIX = [("f2", "spec", None), ("f6", None, "q")]
LINK_SCHEMA = "src string, dst string, confidence double"
LINKS = Rows([("a", "1", 0.5), ("a", "2", 0.7), ("b", "1", 0.9)], """
SELECT n_name, s_name, (1 + s_suppkey % 9) / 10.0 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
""")
DEC_SCHEMA = "src string, dst string, decision string, seq int"
DECISIONS = Rows([("a", "1", "confirm", 1), ("a", "2", "confirm", 1), ("a", "2", "reject", 2), ("c", "9", "add", 1), ("z", "9", "confirm", 1)], """
SELECT n_name, s_name, CASE s_suppkey % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' ELSE 'add' END, 1 FROM {supplier} JOIN {nation} ON s_nationkey =
n_nationkey WHERE s_suppkey % 2 = 0
""")
ASKS = Rows([("q1", "What blocks the pump?"), ("q2", "Is building 61 ready?"), ("q3", "why is it late"), ("q4", "Which records prove it"), ("q5", "hello"), ("q6", None)], """
SELECT 't' || CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING), text FROM {conversations}
""")
NODE_SCHEMA = "node string, type string, state string, source string"
NODES = Rows([("n1", "room", "verified", None), ("n2", "thing", "suggested", None), ("n3", "room", "verified", "s")], """
SELECT s_name, CASE s_suppkey % 3 WHEN 0 THEN 'room' WHEN 1 THEN 'room' ELSE 'thing' END, CASE s_suppkey % 2 WHEN 0 THEN 'verified' ELSE 'suggested'
END, CASE WHEN s_suppkey % 5 > 0 THEN 's' END FROM {supplier} UNION ALL SELECT n_name, 'room', 'suggested', 's' FROM {nation} WHERE n_nationkey < 20
""")
EDGE_SCHEMA = "src string, dst string, kind string"
EDGES = Rows([("n1", "n2", "contains"), ("n1", "nx", "contains"), ("n2", "n3", "odd")], """
SELECT n_name, s_name, CASE s_suppkey % 4 WHEN 0 THEN 'contains' WHEN 1 THEN 'contains' WHEN 2 THEN 'contains' ELSE 'odd' END FROM {supplier} JOIN
{nation} ON s_nationkey = n_nationkey
""")
INS = Rows([("pump", "passed"), ("fan", "open"), ("valve", None)], """
SELECT s_name, CASE s_suppkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'open' END FROM {supplier}
""")
REPORT = Rows([("Building 1", 1.0), ("B-61", 0.5), ("Total", 9.0), (None, 1.0), ("B-62", None), ("Notes: x", 1.0)], """
SELECT CASE WHEN c_custkey % 20 = 0 THEN 'Total of ' || c_name ELSE c_name END, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END FROM {customer}
""")
HITS = Rows([("d1", 0.9), ("d1", 0.4), ("d2", 0.2)], """
SELECT 'doc' || CAST(doc_id AS STRING), (doc_id % 10) / 10.0 FROM {documents}
""")
SHEETS = Rows([("Plan", "Mechanical"), ("Index", "General"), ("Detail", "Architectural"), ("Schedule", "Electrical")], """
SELECT CASE p_partkey % 5 WHEN 0 THEN 'Plan' WHEN 1 THEN 'Index' WHEN 2 THEN 'Cover' WHEN 3 THEN 'Detail' ELSE 'Schedule' END, CASE p_partkey % 4 WHEN
0 THEN 'Architectural' WHEN 1 THEN 'Mechanical' WHEN 2 THEN 'Civil' ELSE 'Electrical' END FROM {part}
""")


def t(s, f, name):
    return s.read.parquet(f"{f}/{name}.parquet")


QUERIES = {
    "orders_by_criteria": (lambda s, f: V.by_criteria(t(s, f, "orders"), {"o_orderstatus": ["O", "P"], "o_totalprice": {"min": 100000, "max": 300000}, "o_orderpriority": {"contains": "urgent"}}).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 100000 AND 300000 AND contains(lower(o_orderpriority), 'urgent')"),
    "turns_holding_terms": (lambda s, f: t(s, f, "conversations").where(V.holds_query("text", ["the", "la "])).groupBy("role").agg(F.count("*").alias("n")), "SELECT role, count(*) AS n FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'la ') GROUP BY 1"),
    "observation_eligibility": (lambda s, f: frame(s, SHEETS, "kind string, discipline string").select("kind", "discipline", V.eligible(F.col("kind"), F.col("discipline")).alias("e")).select("kind", "discipline", "e.*"), f"SELECT kind, discipline, kind NOT IN ('Index', 'Cover', 'Detail', 'Schedule') AS rooms, kind NOT IN ('Index', 'Cover') AND discipline NOT IN ('Architectural', 'Civil') AS equipment, kind NOT IN ('Index', 'Cover') AS callouts FROM {values(SHEETS, 'kind string, discipline string')}"),
    "real_report_rows": (lambda s, f: V.real_rows(frame(s, REPORT, "name string, score double"), "name", ["score"]), f"SELECT * FROM {values(REPORT, 'name string, score double')} WHERE name IS NOT NULL AND score IS NOT NULL AND NOT regexp_matches(lower(name), '^(total|average|building|name|grand total|notes?)\\b')"),
    "import_review": (lambda s, f: V.review_batch(frame(s, FILES, FILE_SCHEMA), frame(s, FIX, "id string, kind string, project string")), f"WITH j AS (SELECT f.id, coalesce(c.kind, f.kind) AS kind, coalesce(c.project, f.project) AS project, error, confidence, c.kind IS NOT NULL OR c.project IS NOT NULL AS fixed FROM {values(FILES, FILE_SCHEMA)} f LEFT JOIN {values(FIX, 'id string, kind string, project string')} c ON c.id = f.id) SELECT id, kind, project, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN kind IS NULL OR project IS NULL THEN 'needs-review' WHEN fixed OR confidence >= 0.8 THEN 'ready' ELSE 'needs-review' END AS state FROM j"),
    "link_decisions": (lambda s, f: V.decided_links(frame(s, LINKS, LINK_SCHEMA), frame(s, DECISIONS, DEC_SCHEMA)), f"WITH d AS (SELECT * FROM {values(DECISIONS, DEC_SCHEMA)} QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC) = 1) SELECT coalesce(l.src, d.src) AS src, coalesce(l.dst, d.dst) AS dst, CASE WHEN decision IS NULL THEN confidence ELSE 1.0 END AS confidence, coalesce(decision, 'suggested') AS state FROM {values(LINKS, LINK_SCHEMA)} l FULL JOIN d ON l.src = d.src AND l.dst = d.dst WHERE coalesce(decision, '') <> 'reject' AND (confidence IS NOT NULL OR decision = 'add')"),
    "answer_confidence": (lambda s, f: V.answer_confidence(frame(s, HITS, "document_id string, coverage double")), f"SELECT count(*) AS sources, count(DISTINCT document_id) AS documents, max(coverage) AS coverage, CASE WHEN max(coverage) >= 0.8 AND count(*) >= 3 THEN 'high' WHEN max(coverage) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM {values(HITS, 'document_id string, coverage double')}"),
    "top_customers": (lambda s, f: V.top_values(t(s, f, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")), "o_custkey", "cents", 10), "SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10"),
    "question_routes": (lambda s, f: frame(s, ASKS, "id string, question string").select("id", V.route("question").alias("route")), f"SELECT id, {S.ladder('question', V.ROUTES, 'general')} AS route FROM {values(ASKS, 'id string, question string')}"),
    "graph_issues": (lambda s, f: V.graph_issues(frame(s, NODES, NODE_SCHEMA), frame(s, EDGES, EDGE_SCHEMA), ["room"], ["contains"]), f"WITH n AS {values(NODES, NODE_SCHEMA)}, e AS {values(EDGES, EDGE_SCHEMA)} SELECT node AS id, 'unknown-node-type' AS issue FROM n WHERE type <> 'room' UNION ALL SELECT src || '>' || dst, 'unknown-edge-type' FROM e WHERE kind <> 'contains' UNION ALL SELECT src || '>' || dst, 'missing-end' FROM e WHERE src NOT IN (SELECT node FROM n) OR dst NOT IN (SELECT node FROM n) UNION ALL SELECT node, 'verified-without-source' FROM n WHERE state = 'verified' AND source IS NULL"),
    "section_graph_edges": (lambda s, f: V.section_graph(sections(s))[1], f"SELECT CASE WHEN parent_id IS NULL THEN 'document:' || document_id ELSE 'section:' || parent_id END AS src, 'section:' || id AS dst, 'contains' AS kind FROM {SECTIONS_SQL} UNION ALL SELECT 'section:' || id, 'number:' || regexp_replace(lower(unnest(cross_references)), '[^a-z0-9]', '', 'g'), 'cites' FROM {SECTIONS_SQL}"),
    "section_graph_nodes": (lambda s, f: V.section_graph(sections(s))[0].groupBy("type").agg(F.count("*").alias("n")), f"SELECT 'document' AS type, count(DISTINCT document_id) AS n FROM {SECTIONS_SQL} UNION ALL SELECT 'section', count(*) FROM {SECTIONS_SQL} UNION ALL SELECT 'number', count(DISTINCT regexp_replace(lower(r), '[^a-z0-9]', '', 'g')) FROM (SELECT unnest(cross_references) AS r FROM {SECTIONS_SQL})"),
    "turnover_plan": (lambda s, f: V.plan_total(V.turnover_plan(frame(s, DEFICIENCIES, DEF_SCHEMA), frame(s, INS, "object string, status string"))), f"SELECT 'resolve-deficiency' AS step, count(*) AS n, 30 * count(*) AS minutes FROM {values(DEFICIENCIES, DEF_SCHEMA)} WHERE status = 'open' UNION ALL SELECT 'complete-inspection', count(*), 15 * count(*) FROM {values(INS, 'object string, status string')} WHERE coalesce(status, '') <> 'passed' UNION ALL SELECT * FROM (VALUES ('assemble-records', 1, 60), ('walk-through', 1, 45), ('sign-off', 1, 15))"),
    "requirement_report": (lambda s, f: V.report_lines(reqs(s)), f"SELECT row_number() OVER w::INTEGER AS place, (row_number() OVER w) || '. [' || upper(type) || '] ' || CASE WHEN len(st) > 120 THEN rtrim(substr(st, 1, 119)) || '…' ELSE st END || ' (' || document_id || ', ' || heading || ')' AS line FROM {REQ} WINDOW w AS (ORDER BY strength DESC, requirement_id)"),
    "specification_index": (lambda s, f: V.specification_index(sections(s), "QC"), f"SELECT section_number, arg_min(heading, (level, ord)) AS title, count(*) AS sections, min(page_start) AS first_page, max(page_end) AS last_page FROM {SECTIONS_SQL} WHERE section_number IN (SELECT section_number FROM {SECTIONS_SQL} WHERE contains(lower(heading), 'qc')) GROUP BY 1"),
}
