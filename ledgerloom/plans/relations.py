"""Queries of matching and reconciliation: literal revisions and the driver's whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relations as R
from .corpus import Rows, SECTION_SCHEMA, SECTIONS, SECTIONS_SQL, frame, sections, values

SECTION_NAMES = ", ".join(c.split()[0] for c in SECTION_SCHEMA.split(", "))
NEW = Rows([
    ("s1", *SECTIONS[0][1:10], "The Contractor shall maintain quality control.", ["01 91 00", "02 10 00"]),
    ("n2", "d1", "s1", "1.1 Owner QC", ["Quality Control", "Owner QC"], "01 45 01", 2, 2, 10, 10, SECTIONS[1][10], ["01 91 00"]),
    ("n3", "d1", "s1", "moved", ["Quality Control", "Moved"], "01 45 02", 2, 9, 10, 11, SECTIONS[2][10], []),
    ("n5", "d2", None, "Other title", ["Other title"], "01 91 00", 1, 1, 11, 13, "New words.", []),
    ("n6", "d2", "n5", "x", ["x"], "", 2, 2, 12, 12, "Same.", []), ("n7", "d2", "n5", "y", ["y"], "", 2, 3, 12, 12, "Same.", []),
], f"""SELECT CASE WHEN ord % 5 = 1 THEN 'x' || id ELSE id END, document_id, parent_id, heading, path, section_number, level, ord, page_start, page_end, CASE WHEN ord % 4 = 0 THEN text || ' Revised.' ELSE text END, cross_references
FROM ({SECTIONS.more}) AS old({SECTION_NAMES}) WHERE ord % 10 <> 3""")
OLD = Rows([*SECTIONS[:5], ("o8", "d2", "s5", "z", ["z"], "", 2, 8, 12, 12, "Same.", []), ("o9", "d2", "s5", "gone", ["gone"], "77 00 00", 2, 9, 1, 1, "Gone.", [])], SECTIONS.more)


def rules():
    return [("id", F.col("id")), ("number", F.when(F.col("level") == 1, T.section_number_key("section_number"))), ("path", F.lower(F.array_join("path", "/"))), ("fingerprint", F.md5(T.squeezed("text")))]


def matched(spark):
    return R.waterfall_match(frame(spark, OLD, SECTION_SCHEMA), frame(spark, NEW, SECTION_SCHEMA), rules())


def _waterfall_sql() -> str:
    o, n = values(OLD, SECTION_SCHEMA), values(NEW, SECTION_SCHEMA)
    keys = ["id", "CASE WHEN level = 1 THEN regexp_replace(lower(section_number), '[^a-z0-9]', '', 'g') END", "lower(array_to_string(path, '/'))", "md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"]
    ctes, out = [f"o0 AS (SELECT * FROM {o})", f"n0 AS (SELECT * FROM {n})"], []
    for i, (k, name) in enumerate(zip(keys, ["id", "number", "path", "fingerprint"], strict=True)):
        ctes += [
            f"k{i} AS (SELECT * FROM (SELECT {k} AS k, count(*) AS no, list(id) AS os FROM o{i} GROUP BY 1) JOIN (SELECT {k} AS k, count(*) AS nn, list(id) AS ns FROM n{i} GROUP BY 1) USING (k) WHERE k <> '')",
            f"o{i + 1} AS (SELECT * FROM o{i} WHERE id NOT IN (SELECT unnest(os) FROM k{i}))", f"n{i + 1} AS (SELECT * FROM n{i} WHERE id NOT IN (SELECT unnest(ns) FROM k{i}))"]
        out += [f"SELECT os[1] AS old_id, ns[1] AS new_id, '{name}' AS rule FROM k{i} WHERE no = 1 AND nn = 1", f"SELECT unnest(os), NULL, 'ambiguous' FROM k{i} WHERE no > 1 OR nn > 1", f"SELECT NULL, unnest(ns), 'ambiguous' FROM k{i} WHERE no > 1 OR nn > 1"]
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join([*out, "SELECT id, NULL, 'removed' FROM o4", "SELECT NULL, id, 'added' FROM n4"])


def parties(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.round("c_acctbal", 0).alias("balance"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal", 0).alias("balance"))
    return c, s


def reconcile_parties(spark, sf):
    r = R.reconcile(*parties(spark, sf), "k", ["nation", "balance"])
    return r.select("k", "status", F.array_join("changed_fields", ",").alias("changed"))


def latest_order(spark, sf):
    """Upsert of lineitem ship dates over orders' dates by order key: the later one stays."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("moment"), F.lit("order").alias("event"))
    x = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("moment")).withColumn("event", F.lit("shipment"))
    return R.upsert(o, x, "k", "moment")


LINEAGE = Rows([("a1", "A", 1), ("a2", "A", 2), ("a3", "A", 2), ("b1", "B", 1)], """
SELECT 'o' || CAST(o_orderkey AS STRING), 'cust' || CAST(o_custkey AS STRING), CAST(o_orderkey % 3 AS INT) FROM {orders}
""")
SHEETS_A = Rows([("1", "A-101", "Plan"), ("2", "A-102", "Roof"), ("3", "A-103", None)], """
SELECT CAST(1000000 + p_partkey AS STRING), 'P-' || CAST(p_partkey AS STRING), p_name FROM {part}
""")
SHEETS_B = Rows([("1", "A-101", "Plan"), ("2", "A-102", "Roof plan"), ("3", "A-103", "Section"), ("4", "A-104", "Detail")], """
SELECT CAST(1000000 + p_partkey AS STRING), 'P-' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_name END FROM {part}
WHERE p_partkey % 50 > 0
""")
SHEET_SCHEMA = "pos string, number string, title string"
STARTS = Rows([("s1", "d1", 3), ("s2", "d1", 3), ("s3", "d1", 7), ("s4", "d2", 1)], """
SELECT s_name, n_name, CAST(s_suppkey % 30 AS INT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
""")
RECORDS = Rows([("r1", "due", "2026-01-01", None), ("r2", "due", "2026-01-02", "2026-02-02"), ("r3", "status", "open", None)], """
SELECT 'o' || CAST(o_orderkey AS STRING), 'status', o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN 'checked' END FROM {orders}
""")


def effective(spark, sf):
    r = frame(spark, RECORDS, "id string, field string, value string, override string")
    m = r.select("id", F.create_map("field", "value").alias("normalized"), F.when(F.col("override").isNotNull(), F.create_map("field", "override")).alias("overrides"))
    return R.effective_values(m).select("id", F.explode("effective").alias("field", "value"))


XREF_SQL = f"""WITH s AS {SECTIONS_SQL}, r AS (SELECT DISTINCT id AS source, unnest(cross_references) AS reference FROM s), n AS (SELECT regexp_replace(lower(section_number), '[^a-z0-9]', '', 'g') AS k, count(DISTINCT id) AS n, min(id) AS id FROM s WHERE level = 1 GROUP BY 1),
  j AS (SELECT source, reference, coalesce(s.id, CASE WHEN n.n = 1 THEN n.id END) AS target, CASE WHEN s.id IS NOT NULL OR n.n = 1 THEN 'resolved' WHEN n.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state
    FROM r LEFT JOIN s ON s.id = r.reference LEFT JOIN n ON n.k = regexp_replace(lower(reference), '[^a-z0-9]', '', 'g'))
  SELECT source, reference, target, CASE WHEN target = source THEN 'self' ELSE state END AS state FROM j"""

CHANGES_SQL = f"""WITH m AS ({_waterfall_sql()}), j AS (SELECT m.*, o.text AS ot, n.text AS nt, o.path AS op, n.path AS np, o.ord AS oo, n.ord AS no_, o.cross_references AS oc, n.cross_references AS nc
      FROM m JOIN {values(OLD, SECTION_SCHEMA)} o ON o.id = old_id JOIN {values(NEW, SECTION_SCHEMA)} n ON n.id = new_id),
      f AS (SELECT old_id, new_id, rule, trim(coalesce(ot, '')) IS DISTINCT FROM trim(coalesce(nt, '')) AS content, op IS DISTINCT FROM np OR oo IS DISTINCT FROM no_ AS structure, len(list_filter(nc, lambda x: NOT list_contains(oc, x)))::INTEGER AS refs_added, len(list_filter(oc, lambda x: NOT list_contains(nc, x)))::INTEGER AS refs_removed FROM j)
      SELECT old_id, new_id, rule, content, structure, refs_added + refs_removed > 0 AS refs, refs_added, refs_removed, CASE WHEN content OR structure OR refs_added + refs_removed > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM f"""

QUERIES = {
    "cross_reference_resolution": (lambda s, f: R.cross_references(sections(s)), XREF_SQL),
    "related_nations": (lambda s, f: R.related_documents(s.read.parquet(f"{f}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")), ["region"]),
                        "SELECT x.n_nationkey AS a, y.n_nationkey AS b, 'region' AS shared FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey"),
    "revision_waterfall": (lambda s, f: matched(s), _waterfall_sql()),
    "revision_changes": (lambda s, f: R.revision_changes(frame(s, OLD, SECTION_SCHEMA), frame(s, NEW, SECTION_SCHEMA), matched(s)), CHANGES_SQL),
    "revision_metrics": (lambda s, f: R.revision_metrics(matched(s), R.revision_changes(frame(s, OLD, SECTION_SCHEMA), frame(s, NEW, SECTION_SCHEMA), matched(s))),
                         f"""SELECT (SELECT count(*) FROM ({_waterfall_sql()}) WHERE rule = 'added') AS added, (SELECT count(*) FROM ({_waterfall_sql()}) WHERE rule = 'removed') AS removed, (SELECT count(*) FROM ({_waterfall_sql()}) WHERE rule = 'ambiguous') AS ambiguous,
      count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged FROM ({CHANGES_SQL})"""),
    "record_reconciliation": (reconcile_parties, """SELECT coalesce(c_custkey, s_suppkey) AS k, CASE WHEN c_custkey IS NULL THEN 'new' WHEN s_suppkey IS NULL THEN 'possibly-removed' WHEN c_nationkey = s_nationkey AND round(c_acctbal, 0) = round(s_acctbal, 0) THEN 'unchanged' ELSE 'changed' END AS status,
      CASE WHEN c_custkey IS NULL OR s_suppkey IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN c_nationkey <> s_nationkey THEN 'nation' END, CASE WHEN round(c_acctbal, 0) <> round(s_acctbal, 0) THEN 'balance' END], lambda x: x IS NOT NULL), ',') END AS changed
      FROM customer FULL JOIN supplier ON c_custkey = s_suppkey"""),
    "record_upsert": (latest_order, """WITH u AS (SELECT o_orderkey AS k, o_orderdate AS moment, 'order' AS event, 0 AS u FROM orders UNION ALL SELECT l_orderkey, max(l_shipdate), 'shipment', 1 FROM lineitem GROUP BY 1)
      SELECT k, moment, event FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY moment DESC, u DESC) = 1"""),
    "record_overrides": (effective, f"SELECT id, field, coalesce(override, value) AS value FROM {values(RECORDS, 'id string, field string, value string, override string')}"),
    "duplicate_documents": (lambda s, f: R.duplicates(s.read.parquet(f"{f}/documents.parquet"), F.sha2("text", 256), "doc_id"), "SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "lineage_families": (lambda s, f: R.lineage_families(frame(s, LINEAGE, "id string, lineage_id string, revision int")), f"WITH d AS {values(LINEAGE, 'id string, lineage_id string, revision int')}, t AS (SELECT *, max(revision) OVER (PARTITION BY lineage_id) AS top FROM d) SELECT lineage_id, count(*) AS versions, max(revision) AS newest, count(*) FILTER (revision = top) AS candidates, max(id) FILTER (revision = top) AS current FROM t GROUP BY 1"),
    "catalog_diff": (lambda s, f: R.catalog_diff(frame(s, SHEETS_A, SHEET_SCHEMA), frame(s, SHEETS_B, SHEET_SCHEMA), ["pos"], ["number", "title"]), f"""WITH a AS (SELECT row_number() OVER (ORDER BY pos)::INTEGER AS row, * FROM {values(SHEETS_A, SHEET_SCHEMA)}), b AS (SELECT row_number() OVER (ORDER BY pos)::INTEGER AS row, * FROM {values(SHEETS_B, SHEET_SCHEMA)}),
      j AS (SELECT coalesce(a.row, b.row) AS row, a.number AS an, b.number AS bn, a.title AS ta, b.title AS tb FROM a FULL JOIN b ON a.row = b.row), c AS (SELECT row, 'number' AS field, an AS left_value, bn AS right_value FROM j UNION ALL SELECT row, 'title', ta, tb FROM j)
      SELECT * FROM c WHERE left_value IS DISTINCT FROM right_value"""),
    "union_by_priority": (lambda s, f: R.union_by_priority([frame(s, SHEETS_A, SHEET_SCHEMA), frame(s, SHEETS_B, SHEET_SCHEMA)], "number"), f"SELECT * FROM {values(SHEETS_A, SHEET_SCHEMA)} UNION ALL SELECT * FROM {values(SHEETS_B, SHEET_SCHEMA)} WHERE number NOT IN (SELECT number FROM {values(SHEETS_A, SHEET_SCHEMA)})"),
    "page_ranges": (lambda s, f: R.page_ranges(frame(s, STARTS, "id string, document_id string, start_page int"), 12), f"SELECT *, CASE WHEN lead(start_page) OVER w IS NULL THEN 12 ELSE greatest(start_page, lead(start_page) OVER w - 1) END AS end_page FROM {values(STARTS, 'id string, document_id string, start_page int')} WINDOW w AS (PARTITION BY document_id ORDER BY start_page, id)"),
    "extraction_quality": (lambda s, f: R.quality_report(sections(s)), f"""WITH s AS {SECTIONS_SQL} SELECT document_id, count(*) AS sections, count(*) FILTER (coalesce(trim(text), '') = '') AS empty_text, count(*) FILTER (coalesce(trim(heading), '') = '') AS no_heading, 0::BIGINT AS duplicate_ids,
      count(*) FILTER (parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM s)) AS orphans, count(*) FILTER (page_start > page_end) AS bad_pages, count(*) FILTER (page_start IS NULL) AS no_pages FROM s GROUP BY 1"""),
}
