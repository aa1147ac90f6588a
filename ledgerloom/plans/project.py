"""Queries of project operators: literal logs, and roll-ups of the driver's whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import project as P
from .corpus import Rows, frame, values

FACT_SCHEMA = "fact_id string, subject string, predicate string, object string, state string, moment timestamp, source string"
FACTS = Rows([
    ("f1", "pump", "located-in", "room 1", "suggested", "2026-01-01 00:00:00", "a"), ("f1", "pump", "located-in", "room 1", "verified", "2026-01-03 00:00:00", "a"), ("f2", "pump", "located-in", "room 2", "suggested", "2026-01-02 00:00:00", "b"),
    ("f3", "fan", "served-by", "panel", "suggested", "2026-01-01 00:00:00", "a"), ("f4", "fan", "served-by", "panel", "suggested", "2026-01-02 00:00:00", "c"), ("f5", "fan", "served-by", "ups", "rejected", "2026-01-04 00:00:00", "d"),
], """
SELECT 'f' || CAST(user_id AS STRING) || event_type, 'user' || CAST(user_id AS STRING), event_type, 'thing ' || CAST(event_id % 3 AS STRING), CASE
event_id % 3 WHEN 0 THEN 'suggested' WHEN 1 THEN 'verified' ELSE 'rejected' END, ts, 'src' || CAST(event_id % 4 AS STRING) FROM {events}
""")
LOG_SCHEMA = "category string, scope string, state string, moment timestamp, seq int"
LOG = Rows([("Building Readiness", "B-61", "open", "2026-01-01 00:00:00", 1), ("Building Readiness", "B-61", "open", "2026-01-02 00:00:00", 2), ("Building Readiness", "B-61", "ready", "2026-01-03 12:00:00", 3), ("safety", None, "watch", "2026-01-01 00:00:00", 1), ("safety", None, "clear", "2026-01-01 00:00:00", 2)], """
SELECT event_type, 'user ' || CAST(user_id % 50 AS STRING), CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'ready' ELSE 'watch' END, ts, event_id
FROM {events}
""")
REL_SCHEMA = "src string, dst string, kind string"
RELS = Rows([("pump", "A-101", "appears-on"), ("fan", "A-101", "appears-on"), ("pump", "23 21 23", "governed-by"), ("fan", "23 34 00", "governed-by"), ("valve", "A-102", "appears-on"), ("pump", "S-1", "submitted-as"), ("room 1", "B-61", "part-of")], """
SELECT DISTINCT 'part' || CAST(l_partkey AS STRING), 'supp' || CAST(l_suppkey AS STRING), CASE l_suppkey % 3 WHEN 0 THEN 'submitted-as' WHEN 1 THEN
'governed-by' ELSE 'supplied-by' END FROM {lineitem}
""")
PARENTS = Rows([("motor", "pump"), ("seal", "pump")], """
SELECT 'kit' || CAST(p_partkey AS STRING), 'part' || CAST(p_partkey AS STRING) FROM {part} WHERE p_partkey % 4 = 0
""")
OBJECTS = [("pump", True), ("fan", False), ("valve", True), ("motor", False)]
#: Work items: the objects, and every order.
WORK = Rows(OBJECTS, "SELECT 'order' || CAST(o_orderkey AS STRING), o_orderkey % 2 = 0 FROM {orders}")
NEED_SCHEMA = "id string, need_type string, status string"
NEEDS = Rows([("pump", "submittal review", "approved"), ("pump", "inspection final", "open"), ("fan", "submittal review", "blocked"), ("fan", "test report", None), ("valve", "inspection", "passed")], """
SELECT 'order' || CAST(l_orderkey AS STRING), CASE l_linenumber % 3 WHEN 0 THEN 'submittal review' WHEN 1 THEN 'inspection final' ELSE 'test report'
END, CASE l_returnflag WHEN 'R' THEN 'blocked' WHEN 'A' THEN 'approved' ELSE 'open' END FROM {lineitem}
""")
DEF_SCHEMA = "object string, status string"
DEFICIENCIES = Rows([("pump", "open")] * 6 + [("fan", "open"), ("fan", "closed"), ("valve", "resolved")], """
SELECT 'part' || CAST(l_partkey AS STRING), CASE l_returnflag WHEN 'R' THEN 'open' WHEN 'A' THEN 'closed' ELSE 'resolved' END FROM {lineitem}
""")
INSPECTIONS = [("pump", "i1", "2026-01-01"), ("valve", "i2", "2026-01-09"), ("fan", "i3", "2025-12-01")]
NAMES = Rows([("AHU-01",), ("AHU 1",), ("ahu1",), ("Panel 7",), ("",), ("RM-100",)], """
SELECT c_name FROM {customer} UNION ALL SELECT s_name FROM {supplier} UNION ALL SELECT upper(s_name) FROM {supplier}
""")
PAIRS = Rows([("AHU 1", "ahu-1"), ("Main panel", "panel"), ("abc", "cab"), ("", "x"), ("xyz", "abcd")], """
SELECT c_name || ' ' || c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN n_name || ' ' || c_name ELSE n_name END FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
""")
_PK = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
_PAIRSQL = f"""WITH k AS (SELECT a, b, {_PK('a')} AS x, {_PK('b')} AS y FROM {values(PAIRS, 'a string, b string')}), l AS (SELECT *, CASE WHEN length(x) >= length(y) THEN x ELSE y END AS l, CASE WHEN length(x) >= length(y) THEN y ELSE x END AS s FROM k)
SELECT a, b, round(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 WHEN contains(l, s) THEN 0.8 ELSE len(list_filter(string_split(s, ''), lambda c: c <> '' AND contains(l, c))) / greatest(length(l), 1)::DOUBLE END, 6)::DOUBLE AS similarity FROM l"""
TEXTS = Rows([("t1", "85 %"), ("t2", "0.85"), ("t3", "120"), ("t4", "n/a"), ("t5", None), ("t6", "1,000")], """
SELECT 'o' || CAST(o_orderkey AS STRING), CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 150 AS STRING) || ' %' WHEN 1 THEN '0.' || CAST(o_orderkey
% 100 + 1 AS STRING) ELSE o_orderstatus END FROM {orders}
""")
PRIO = Rows([("a", "Safety", 0.5), ("b", "schedule", 3.0), ("c", "other", 2.0)], """
SELECT 'o' || CAST(o_orderkey AS STRING), CASE o_orderkey % 3 WHEN 0 THEN 'Safety' WHEN 1 THEN 'Schedule' ELSE 'Cost' END, (o_orderkey % 40) / 10.0
FROM {orders}
""")
MODEL_A, MODEL_B = Rows([("room", "1"), ("room", "2"), ("tag", "x")], """
SELECT 'part', CAST(p_partkey AS STRING) FROM {part} WHERE p_partkey % 3 > 0 UNION ALL SELECT 'customer', CAST(c_custkey AS STRING) FROM {customer}
"""), Rows([("room", "2"), ("room", "3"), ("spec", "s")], """
SELECT 'part', CAST(p_partkey AS STRING) FROM {part} WHERE p_partkey % 2 > 0 UNION ALL SELECT 'supplier', CAST(s_suppkey AS STRING) FROM {supplier}
""")
FSQL, LSQL, RSQL = values(FACTS, FACT_SCHEMA), values(LOG, LOG_SCHEMA), values(RELS, REL_SCHEMA)
DONE = "('complete', 'completed', 'passed', 'approved', 'accepted', 'closed', 'resolved')"
LATEST = f"(SELECT * FROM {FSQL} QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY moment DESC, state DESC) = 1)"
HIST = f"(SELECT state_id, moment, seq, was, state FROM (SELECT *, lag(state) OVER (PARTITION BY state_id ORDER BY moment, seq) AS was FROM (SELECT *, 'STATE:' || regexp_replace(lower(category), '[^a-z]', '', 'g') || ':' || regexp_replace(lower(coalesce(scope, '')), '[^a-z0-9]', '', 'g') AS state_id FROM {LSQL})) WHERE was IS NULL OR was <> state)"


def t(s, f, name):
    return s.read.parquet(f"{f}/{name}.parquet")


def buildings(s, f):
    """Nations as buildings: readiness from finished orders, risks from large open ones, questions from urgent open ones."""
    o = t(s, f, "orders").join(t(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, f, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    open_ = F.col("o_orderstatus") == "O"
    return o.groupBy(F.col("n_name").alias("id")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("readiness"), F.count_if(open_ & (F.col("o_totalprice") > 150000)).alias("risks"), F.count_if(open_ & F.col("o_orderpriority").startswith("1")).alias("questions"))


BUILD = "(SELECT n_name AS id, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS readiness, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 150000) AS risks, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority LIKE '1%') AS questions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"


def facts(s):
    return frame(s, FACTS, FACT_SCHEMA)


def log(s):
    return frame(s, LOG, LOG_SCHEMA)


def rels(s):
    return frame(s, RELS, REL_SCHEMA)


def objects(s):
    return frame(s, OBJECTS, "id string, has_spec boolean")


def defs(s):
    return frame(s, DEFICIENCIES, DEF_SCHEMA)


def inspections(s):
    return frame(s, INSPECTIONS, "object string, inspection string, moment date")


def line_facets(s, f):
    x = t(s, f, "lineitem")
    return P.facets(x, {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "discounted": F.col("l_discount") > 0.05, "large": F.col("l_quantity") >= 40})


def status_rollup(s, f):
    """Lines by return flag and line status with subtotals, in one pass."""
    x = t(s, f, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return x.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


def top_by_group(s, f):
    """The three largest orders of every customer segment."""
    from pyspark.sql import Window

    o = t(s, f, "orders").join(t(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).where("place <= 3").select(F.col("c_mktsegment").alias("segment"), "place", "o_orderkey", "o_totalprice")


def label_evaluation(s, f):
    """Labels against a simple rule on their documents, with median lengths: the shape of an evaluation run."""
    d = t(s, f, "documents").join(t(s, f, "labels"), "doc_id")
    return d.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.median(F.col("n_chars")).alias("median_chars"), F.percentile("n_chars", 0.9).alias("p90_chars"), F.count_if(F.length("text") == F.col("n_chars")).alias("agree"))


def last_notes(s, f):
    """Nations with the last order of any of their customers (the last one wins), only of nations that have suppliers."""
    o = t(s, f, "orders").join(t(s, f, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    last = P.last_wins(o.withColumn("k", F.struct("o_orderdate", "o_orderkey")), "c_nationkey", "k")
    n = t(s, f, "nation").join(last, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t(s, f, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return n.select("n_name", F.col("o_orderkey").alias("last_order"))


QUERIES = {
    "latest_facts": (lambda s, f: P.latest_facts(facts(s)), f"SELECT * FROM {LATEST}"),
    "fact_conflicts": (lambda s, f: P.fact_conflicts(P.latest_facts(facts(s))), f"SELECT subject, predicate, count(DISTINCT object) AS objects, min(object) AS first, max(object) AS last FROM {LATEST} WHERE state IN ('suggested', 'verified') GROUP BY ALL HAVING count(DISTINCT object) > 1"),
    "evidence_confidence": (lambda s, f: P.evidence_confidence(facts(s)), f"SELECT subject, predicate, object, count(DISTINCT source) AS sources, least(1.0, count(DISTINCT source) * 0.25)::DOUBLE AS confidence FROM {FSQL} GROUP BY ALL"),
    "identities": (lambda s, f: P.identities(frame(s, NAMES, "name string")), f"SELECT regexp_replace(regexp_replace(upper(name), '[^A-Z0-9]', '', 'g'), '([A-Z])0+(\\d)', '\\1\\2', 'g') AS canonical, count(*) AS n, min(name) AS best FROM {values(NAMES, 'name string')} WHERE name <> '' GROUP BY 1"),
    "name_similarity": (lambda s, f: frame(s, PAIRS, "a string, b string").select("a", "b", F.round(P.name_similarity(F.col("a"), F.col("b")), 6).alias("similarity")), _PAIRSQL),
    "state_history": (lambda s, f: P.state_history(log(s)), f"SELECT state_id, moment, was, state FROM {HIST}"),
    "current_states": (lambda s, f: P.current_states(log(s), F.lit("2026-01-04 00:00:00")), f"SELECT state_id, arg_max(state, (moment, seq)) AS state, max(moment) AS since, count(*) - 1 AS changes, TIMESTAMP '2026-01-04' - max(moment) > INTERVAL 24 HOUR AS stale FROM {HIST} GROUP BY 1"),
    "event_state_log": (lambda s, f: P.kept_history(t(s, f, "events").select("user_id", F.col("ts").alias("moment"), F.col("event_id").alias("seq"), "event_type"), "user_id", 3), "SELECT user_id, ts AS moment, event_id AS seq, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3"),
    "missing_submittals": (lambda s, f: P.missing_relation(frame(s, WORK, "id string, has_spec boolean"), rels(s), "submitted-as"), f"SELECT * FROM {values(WORK, 'id string, has_spec boolean')} WHERE id NOT IN (SELECT src FROM {RSQL} WHERE kind = 'submitted-as')"),
    "inherited_relations": (lambda s, f: P.inherited_relations(rels(s), frame(s, PARENTS, "child string, parent string"), ["governed-by", "appears-on"]), f"SELECT *, 'stated' AS origin FROM {RSQL} UNION ALL SELECT DISTINCT child, dst, kind, 'inherited' FROM {RSQL} JOIN {values(PARENTS, 'child string, parent string')} ON parent = src WHERE kind IN ('governed-by', 'appears-on')"),
    "readiness": (lambda s, f: P.readiness(frame(s, NEEDS, NEED_SCHEMA), ["submittal", "inspection", "test-reports"], frame(s, [("fan", "inspection", "waived")], "id string, dimension string, state string")),
                  f"WITH n AS {values(NEEDS, NEED_SCHEMA)}, d AS (SELECT * FROM (VALUES ('submittal', 'submittal'), ('inspection', 'inspection'), ('test-reports', 'test')) t(dimension, word)), r AS (SELECT i.id, d.dimension, max(CASE WHEN status = 'blocked' THEN 3 WHEN status IN {DONE} THEN 1 ELSE 2 END) FILTER (n.id IS NOT NULL) AS r FROM (SELECT DISTINCT id FROM n) i CROSS JOIN d LEFT JOIN n ON n.id = i.id AND contains(need_type, word) GROUP BY ALL) SELECT id, dimension, CASE WHEN id = 'fan' AND dimension = 'inspection' THEN 'waived' WHEN r = 3 THEN 'blocked' WHEN r = 2 THEN 'incomplete' WHEN r = 1 THEN 'ready' ELSE 'unknown' END AS state FROM r"),
    "change_impacts": (lambda s, f: P.impacts(rels(s).select("src", "dst"), "room 1"), "SELECT 'B-61' AS node, 1 AS depth"),
    "blocked_work": (lambda s, f: P.blocked(frame(s, WORK, "id string, has_spec boolean"), frame(s, NEEDS, NEED_SCHEMA)), f"SELECT id, count(*) AS open_needs FROM {values(NEEDS, NEED_SCHEMA)} WHERE coalesce(status, '') NOT IN {DONE} AND id IN (SELECT id FROM {values(WORK, 'id string, has_spec boolean')}) GROUP BY 1"),
    "schedule_impact": (lambda s, f: P.schedule_impact(defs(s)), f"SELECT object, count(*) AS open FROM {values(DEFICIENCIES, DEF_SCHEMA)} WHERE status NOT IN {DONE} GROUP BY 1 HAVING count(*) > 5"),
    "priorities": (lambda s, f: P.priorities(frame(s, PRIO, "id string, category string, value double")), f"SELECT id, least(1.0, CASE lower(category) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.PRIORITY_WEIGHTS.items())} ELSE 1.0 END * value / 10)::DOUBLE AS priority FROM {values(PRIO, 'id string, category string, value double')}"),
    "project_health": (lambda s, f: P.health(buildings(s, f).agg(F.avg("readiness").alias("a"), F.max("readiness").alias("b"), F.lit(None).cast("double").alias("c")), ["a", "b", "c"]), f"SELECT 2::BIGINT AS n, floor(1000 * (avg(readiness) + max(readiness)) / 2 + 0.5) / 10 AS health FROM {BUILD}"),
    "inspection_plan": (lambda s, f: P.inspection_plan(objects(s), defs(s), inspections(s), F.lit("2026-01-10").cast("date"), 90), f"WITH o AS {values(OBJECTS, 'id string, has_spec boolean')}, p AS (SELECT id AS object, CASE WHEN id IN ('pump', 'fan') THEN 'open-deficiency' ELSE 'not-inspected' END AS reason, CASE WHEN id IN ('pump', 'fan') THEN 30 ELSE 15 END AS minutes, CASE WHEN has_spec THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence FROM o WHERE id <> 'valve'), w AS (SELECT row_number() OVER (ORDER BY minutes DESC, object)::INTEGER AS step, *, sum(minutes) OVER (ORDER BY minutes DESC, object) AS total FROM p) SELECT step, object, reason, minutes, confidence FROM w WHERE total <= 90"),
    "percent_parsing": (lambda s, f: frame(s, TEXTS, "id string, t string").select("id", P.percent("t").alias("share")), f"WITH v AS (SELECT id, try_cast(regexp_replace(t, '[%,\\s]', '', 'g') AS DOUBLE) AS v FROM {values(TEXTS, 'id string, t string')}) SELECT id, CASE WHEN v > 1.5 THEN v / 100 ELSE v END AS share FROM v"),
    "building_dashboard": (lambda s, f: P.dashboard(buildings(s, f)), f"SELECT count(*) AS total, round(avg(readiness), 6) AS average, count(*) FILTER (readiness >= 0.9) AS ready, sum(risks)::BIGINT AS risks, CASE WHEN avg(readiness) >= 0.8 THEN 'Mission Ready' WHEN avg(readiness) >= 0.55 THEN 'Watch' ELSE 'Critical' END AS posture FROM {BUILD}"),
    "building_attention": (lambda s, f: P.attention(buildings(s, f)), f"SELECT id, (3 * risks + 2 * questions + 100 - floor(100 * readiness + 0.5))::DOUBLE AS points, CASE WHEN risks >= 8 OR readiness < 0.55 THEN 'High' WHEN risks >= 4 OR questions >= 6 OR readiness < 0.8 THEN 'Elevated' WHEN risks > 0 OR questions > 0 THEN 'Monitor' ELSE 'Controlled' END AS posture FROM {BUILD} ORDER BY points DESC, id LIMIT 5"),
    "dashboard_lookups": (last_notes, "WITH l AS (SELECT c_nationkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT n_name, last_order FROM nation LEFT JOIN l ON k = n_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "line_facets": (line_facets, "SELECT count(*) AS all_rows, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_quantity >= 40) AS large FROM lineitem"),
    "status_rollup": (status_rollup, "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "top_orders_by_segment": (top_by_group, "SELECT c_mktsegment AS segment, row_number() OVER w::INTEGER AS place, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3"),
    "label_evaluation": (label_evaluation, "SELECT quality, toxic, count(*) AS n, median(n_chars)::DOUBLE AS median_chars, quantile_cont(n_chars, 0.9)::DOUBLE AS p90_chars, count(*) FILTER (len(text) = n_chars) AS agree FROM documents JOIN labels USING (doc_id) GROUP BY ALL"),
    "source_counts": (lambda s, f: P.source_counts(t(s, f, "documents").select(F.array("lang", "source").alias("tags")), {"english": r"\ben\b", "first source": r"\bsrc0\b", "tenth on": r"\bsrc1\d\b"}), "SELECT category, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN source = 'src0' THEN 'first source' END, CASE WHEN regexp_matches(source, '^src1\\d$') THEN 'tenth on' END], lambda x: x IS NOT NULL)) AS category FROM documents) GROUP BY 1"),
    "recent_activity": (lambda s, f: P.recent_activity(t(s, f, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("moment"), "event_type")), "SELECT event_id AS id, ts AS moment, event_type FROM events ORDER BY ts DESC, event_id LIMIT 8"),
    "next_line_numbers": (lambda s, f: P.next_numbers(t(s, f, "lineitem"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, (max(l_linenumber) + 1)::INTEGER AS next FROM lineitem GROUP BY 1"),
    "record_search": (lambda s, f: P.search_records({"customer": t(s, f, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body")), "part": t(s, f, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("body")), "supplier": t(s, f, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("").alias("body"))}, "1", 60),
                      "WITH u AS (SELECT 'customer' AS source, c_custkey::VARCHAR AS id, c_name AS title, c_mktsegment AS body FROM customer UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name, p_type FROM part UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name, '' FROM supplier), k AS (SELECT * FROM u WHERE contains(lower(title || ' ' || body), '1') QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY source, id) = 1) SELECT source, id, title FROM k ORDER BY CASE WHEN contains(lower(title), '1') THEN 0 ELSE 1 END, source, id LIMIT 60"),
    "work_package": (lambda s, f: P.work_package("A-101", rels(s), inspections(s), frame(s, [("23 21 23",)], "id string")), "SELECT * FROM (VALUES ('objects', 2::BIGINT, 'fan,pump'), ('inspections', 2, 'i1,i3'), ('documents', 1, '23 21 23')) t(kind, n, items)"),
    "model_comparison": (lambda s, f: P.compare_models(frame(s, MODEL_A, "dimension string, value string"), frame(s, MODEL_B, "dimension string, value string")), f"SELECT coalesce(a.dimension, b.dimension) AS dimension, count(*) FILTER (b.value IS NULL) AS only_a, count(*) FILTER (a.value IS NULL) AS only_b, count(*) FILTER (a.value = b.value) AS common FROM {values(MODEL_A, 'dimension string, value string')} a FULL JOIN {values(MODEL_B, 'dimension string, value string')} b ON a.dimension = b.dimension AND a.value = b.value GROUP BY 1"),
}
