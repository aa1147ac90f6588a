"""Queries over a literal graph, the hierarchy of places, and the graph of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .corpus import Rows, frame, values

# Regions, nations and suppliers as a tree; each supplier also follows on the region, which makes ways of two lengths.
TREE = """(SELECT r_name AS src, n_name AS dst, 1.0 + n_nationkey % 4 AS weight, CASE WHEN n_nationkey % 5 > 0 THEN (5 + n_nationkey % 5) / 10.0 END AS confidence FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, s_name, 1.0 + s_suppkey % 7, (1 + s_suppkey % 9) / 10.0 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
  UNION ALL SELECT r_name, s_name, 3.0 + s_suppkey % 5, 0.5 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) AS tree"""
E_SCHEMA = "src string, dst string, weight double, confidence double"
EDGES = Rows([("a", "b", 2.0, 0.9), ("a", "c", 4.0, 0.8), ("b", "c", 1.0, 0.5), ("b", "d", 7.0, 1.0), ("c", "e", 3.0, 0.7), ("d", "f", 1.0, 0.9), ("e", "d", 2.0, 0.6), ("e", "f", 5.0, None), ("g", "h", 1.0, 1.0)], f"SELECT src, dst, weight, confidence FROM {TREE}")
CYCLIC = Rows([*EDGES, ("f", "b", 1.0, 0.4), ("h", "g", 1.0, 0.2), ("h", "h", 1.0, 1.0)], f"SELECT src, dst, weight, confidence FROM {TREE} UNION ALL SELECT s_name, r_name, 2.0, 0.5 FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE s_suppkey % 3 = 0")
N_SCHEMA = "node string, duration double, status string, type string, has_timing boolean, n_deliverables int, n_references int"
NODES = Rows([("a", 2.0, "complete", "mandatory", True, 1, 0), ("b", 3.0, "open", "prohibited", False, 0, 2), ("c", 1.0, None, "mandatory", True, 2, 9), ("d", 4.0, "approved", "permitted", False, 0, 0), ("e", 2.0, "closed", "advisory", False, 1, 1),
         ("f", 1.0, "open", "mandatory", False, 0, 0), ("g", 5.0, "open", "mandatory", True, 0, 1), ("h", 1.0, "complete", "permitted", False, 0, 0), ("i", 1.0, None, "mandatory", False, 0, 0)], """SELECT r_name, 1.0 + r_regionkey, 'complete', 'mandatory', r_regionkey % 2 = 0, r_regionkey % 3, r_regionkey FROM {region}
  UNION ALL SELECT n_name, 2.0 + n_nationkey % 6, CASE n_nationkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'approved' WHEN 2 THEN 'closed' END, CASE n_nationkey % 3 WHEN 0 THEN 'prohibited' WHEN 1 THEN 'mandatory' ELSE 'advisory' END, n_nationkey % 2 = 0, n_nationkey % 3, n_nationkey FROM {nation}
  UNION ALL SELECT s_name, 1.0 + s_suppkey % 9, CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'complete' END, CASE s_suppkey % 4 WHEN 0 THEN 'prohibited' WHEN 1 THEN 'mandatory' WHEN 2 THEN 'permitted' ELSE 'advisory' END, s_suppkey % 5 = 0, s_suppkey % 2, s_suppkey % 11 FROM {supplier}""")
ESQL, CSQL, NSQL = values(EDGES, E_SCHEMA), values(CYCLIC, E_SCHEMA), values(NODES, N_SCHEMA)
DONE = ["supported", "controlled", "complete", "approved", "accepted", "closed"]


SEEDS = Rows([("a",), ("g",)], "SELECT r_name FROM {region}")
SEEDSQL = values(SEEDS, "node string")
LEAVES = Rows([("f",)], "SELECT s_name FROM {supplier}")


def edges(s):
    return frame(s, EDGES, E_SCHEMA)


def cyclic(s):
    return frame(s, CYCLIC, E_SCHEMA)


def nodes(s):
    return frame(s, NODES, N_SCHEMA)


def seeds(s):
    return frame(s, SEEDS, "node string")


def places(s, f):
    """region -> nation -> supplier as one edge table of names."""
    r, n, x = (s.read.parquet(f"{f}/{t}.parquet") for t in ("region", "nation", "supplier"))
    a = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return a.unionByName(x.join(n, x["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("src"), F.col("s_name").alias("dst")))


PLACES = "(SELECT r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def supply(s, f):
    """Parts and suppliers that lineitem ties together; weight: number of lines."""
    x = s.read.parquet(f"{f}/lineitem.parquet").select("l_partkey", "l_suppkey")
    x = x.repartition(G.tasks_for(x, x.count()), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    return x.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "weight", F.lit(1.0).alias("confidence"))


def lines(s, f):
    return s.read.parquet(f"{f}/lineitem.parquet").count()


SUPPLY = "(SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL)"


def ends(e):
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()


REACH = "WITH RECURSIVE r AS (SELECT DISTINCT src AS seed, dst AS node, 1 AS depth FROM {e} WHERE src IN {s} UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN {e} e ON e.src = r.node WHERE r.depth < 12) SELECT seed, node, min(depth)::INTEGER AS depth FROM r GROUP BY ALL"
PATHS = "WITH RECURSIVE p AS (SELECT 'a' AS node, ['a'] AS path, 0 AS length, 0.0::DOUBLE AS cost UNION ALL SELECT e.dst, list_append(p.path, e.dst), p.length + 1, p.cost + e.weight FROM p JOIN {e} e ON e.src = p.node WHERE p.length < 12 AND NOT list_contains(p.path, e.dst)) SELECT array_to_string(path, '>') AS path, length, cost FROM p WHERE node = 'f'"
MUTUAL = "c AS (SELECT n.node, least(n.node, coalesce(min(x.node), n.node)) AS component FROM {n} n LEFT JOIN (SELECT a.seed, a.node FROM r a JOIN r b ON a.seed = b.node AND a.node = b.seed) x ON x.seed = n.node GROUP BY n.node)"
SCC = f"WITH RECURSIVE r AS (SELECT DISTINCT src AS seed, dst AS node FROM {CSQL} UNION SELECT r.seed, e.dst FROM r JOIN {CSQL} e ON e.src = r.node), " + MUTUAL.format(n=NSQL)
LEVELS = "WITH RECURSIVE l AS (SELECT node, 0 AS level FROM {n} WHERE node NOT IN (SELECT dst FROM {e}) UNION SELECT e.dst, l.level + 1 FROM l JOIN {e} e ON e.src = l.node) SELECT node, max(level)::INTEGER AS level FROM l GROUP BY node"
ENDS = "(SELECT src AS node FROM {e} UNION SELECT dst FROM {e})"


def _rank_sql(e: str, rounds: int) -> str:
    n = ENDS.format(e=e)
    out = [f"e AS (SELECT src, dst, sum(weight) / any_value(t) AS p FROM {e} JOIN (SELECT src, sum(weight) AS t FROM {e} GROUP BY 1) USING (src) GROUP BY src, dst)", f"n AS (SELECT node, (SELECT count(*) FROM {n}) AS n, node IN (SELECT src FROM e) AS has FROM {n})", "r0 AS (SELECT node, n, has, 1.0 / n AS score FROM n)"]
    for i in range(rounds):
        out.append(f"r{i + 1} AS (SELECT node, n, has, 0.15 / n + 0.85 * (SELECT coalesce(sum(score) FILTER (NOT has), 0) FROM r{i}) / n + 0.85 * coalesce(s, 0) AS score FROM r{i} LEFT JOIN (SELECT dst AS node, sum(score * p) AS s FROM e JOIN r{i} ON node = src GROUP BY 1) g USING (node))")
    return "WITH " + ", ".join(out) + f" SELECT node, round(score, 9) AS score FROM r{rounds}"


def _settled_rank_sql(e: str) -> str:
    """Rounds over all nodes until one moves less than 1e-13 of all score; own edges without weight carry nodes that no edge leads to, and what they had."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, sum(weight) / any_value(t) AS p FROM {e} JOIN (SELECT src, sum(weight) AS t FROM {e} GROUP BY 1) USING (src) GROUP BY src, dst),
  n AS MATERIALIZED (SELECT node, count(*) OVER () AS n FROM {ENDS.format(e=e)}), a AS MATERIALIZED (SELECT src, dst, p, false AS own FROM e UNION ALL SELECT node, node, 0.0, true FROM n),
  r AS (SELECT node, 0 AS k, 1.0::DOUBLE / n AS score, 1.0::DOUBLE AS moved FROM n
    UNION ALL SELECT node, k + 1, score, sum(abs(score - was)) OVER () FROM (SELECT node, k, was, 0.85 * s + (1 - 0.85 * sum(s) OVER ()) / count(*) OVER () AS score
      FROM (SELECT dst AS node, k, sum(score * p) AS s, sum(score) FILTER (own) AS was FROM r JOIN a ON r.node = a.src WHERE moved >= 1e-13 GROUP BY dst, k)))
  SELECT node, round(score, 9) AS score FROM r WHERE k = (SELECT max(k) FROM r)"""


CPM = f"""WITH RECURSIVE f AS (SELECT node, duration, 0.0::DOUBLE AS start, duration AS finish FROM {NSQL} WHERE node NOT IN (SELECT dst FROM {ESQL}) UNION SELECT n.node, n.duration, f.finish, f.finish + n.duration FROM f JOIN {ESQL} e ON e.src = f.node JOIN {NSQL} n ON n.node = e.dst),
  m AS (SELECT node, any_value(duration) AS duration, max(start) AS start, max(finish) AS finish FROM f GROUP BY node), t AS (SELECT max(finish) AS total FROM m),
  b AS (SELECT node, duration, total AS due FROM m, t WHERE node NOT IN (SELECT src FROM {ESQL}) UNION SELECT n.node, n.duration, b.due - b.duration FROM b JOIN {ESQL} e ON e.dst = b.node JOIN {NSQL} n ON n.node = e.src)
  SELECT m.node, m.start, m.finish, min(b.due) - any_value(m.finish) AS slack, abs(min(b.due) - any_value(m.finish)) < 1e-9 AS critical FROM m JOIN b USING (node) GROUP BY m.node, m.start, m.finish"""

QUERIES = {
    "graph_descendants": (lambda s, f: G.reachable(edges(s), seeds(s)), REACH.format(e=ESQL, s=SEEDSQL)),
    "graph_ancestors": (lambda s, f: G.reachable(G.reversed_edges(edges(s)), frame(s, LEAVES, "node string")), REACH.format(e=f"(SELECT dst AS src, src AS dst FROM {ESQL})", s=values(LEAVES, "node string"))),
    "graph_reach_with_cycles": (lambda s, f: G.reachable(cyclic(s), seeds(s)), REACH.format(e=CSQL, s=SEEDSQL)),
    "place_hierarchy": (lambda s, f: G.reachable(places(s, f), s.read.parquet(f"{f}/region.parquet").select(F.col("r_name").alias("node"))), REACH.format(e=PLACES, s="(SELECT r_name FROM region)")),
    "graph_shortest_path": (lambda s, f: G.shortest_path(edges(s), "a", "f"), f"SELECT path, length FROM ({PATHS.format(e=ESQL)}) ORDER BY length, path LIMIT 1"),
    "graph_simple_paths": (lambda s, f: G.simple_paths(edges(s), "a", "f"), PATHS.format(e=ESQL)),
    "graph_weighted_distances": (lambda s, f: G.weighted_distances(edges(s), "a"), f"WITH RECURSIVE p AS (SELECT 'a' AS node, 0.0::DOUBLE AS distance UNION SELECT e.dst, p.distance + e.weight FROM p JOIN {ESQL} e ON e.src = p.node) SELECT node, min(distance) AS distance FROM p GROUP BY node"),
    "graph_doubt_distances": (lambda s, f: G.weighted_distances(edges(s), "a", G.edge_cost("weighted-doubt")).withColumn("distance", F.round("distance", 6)), f"WITH RECURSIVE p AS (SELECT 'a' AS node, 0.0::DOUBLE AS distance UNION SELECT e.dst, p.distance + e.weight * (1 - coalesce(e.confidence, 0)) FROM p JOIN {ESQL} e ON e.src = p.node) SELECT node, round(min(distance), 6) AS distance FROM p GROUP BY node"),
    "graph_cycles": (lambda s, f: G.directed_cycles(cyclic(s)), f"WITH RECURSIVE p AS (SELECT src AS first, dst AS node, [src] AS path, 1 AS length FROM {CSQL} UNION ALL SELECT p.first, e.dst, list_append(p.path, p.node), p.length + 1 FROM p JOIN {CSQL} e ON e.src = p.node WHERE p.length < 12 AND p.node > p.first AND NOT list_contains(p.path, p.node)) SELECT DISTINCT array_to_string(path, '>') AS cycle, length FROM p WHERE node = first"),
    "graph_topological_levels": (lambda s, f: G.topological_levels(edges(s), nodes(s)), LEVELS.format(e=ESQL, n=NSQL)),
    "place_levels": (lambda s, f: G.topological_levels(places(s, f), ends(places(s, f))), LEVELS.format(e=PLACES, n=ENDS.format(e=PLACES))),
    "graph_components": (lambda s, f: G.components(edges(s), nodes(s)), f"WITH RECURSIVE b AS (SELECT src, dst FROM {ESQL} UNION SELECT dst, src FROM {ESQL}), r AS (SELECT node, node AS other FROM {NSQL} UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.other) SELECT node, min(other) AS component FROM r GROUP BY node"),
    "supply_components": (lambda s, f: G.components(supply(s, f), ends(supply(s, f))).groupBy("component").agg(F.count("*").alias("n")), None),
    "graph_strong_components": (lambda s, f: G.strong_components(cyclic(s), nodes(s)), SCC + " SELECT * FROM c"),
    "graph_condensation": (lambda s, f: G.condensation(cyclic(s), G.strong_components(cyclic(s), nodes(s))), SCC + f" SELECT x.component AS src, y.component AS dst, count(*) AS n FROM {CSQL} e JOIN c x ON x.node = e.src JOIN c y ON y.node = e.dst WHERE x.component <> y.component GROUP BY ALL"),
    "graph_influence": (lambda s, f: G.influence(edges(s), ends(edges(s)), rounds=8, tolerance=0.0).withColumn("score", F.round("score", 9)), _rank_sql(ESQL, 8)),
    "supply_influence": (lambda s, f: G.influence(supply(s, f), ends(supply(s, f))).withColumn("score", F.round("score", 9)), _settled_rank_sql(SUPPLY)),
    "graph_critical_path": (lambda s, f: G.critical_path(edges(s), nodes(s).select("node", "duration")), CPM),
    "graph_degrees": (lambda s, f: G.degrees(edges(s), nodes(s)).withColumn("strength", F.round("strength", 6)), f"SELECT node, count(*) FILTER (e.dst = n.node) AS in_degree, count(*) FILTER (e.src = n.node) AS out_degree, round(coalesce(sum(weight * coalesce(confidence, 1)), 0), 6) AS strength FROM {NSQL} n LEFT JOIN {ESQL} e ON e.src = n.node OR e.dst = n.node GROUP BY node"),
    "supply_degrees": (lambda s, f: G.degrees(supply(s, f), ends(supply(s, f)), lines(s, f)), f"SELECT node, count(*) FILTER (NOT o) AS in_degree, count(*) FILTER (o) AS out_degree, sum(weight) AS strength FROM (SELECT src AS node, true AS o, weight FROM {SUPPLY} UNION ALL SELECT dst, false, weight FROM {SUPPLY}) GROUP BY node"),
    "graph_subgraph": (lambda s, f: G.subgraph(edges(s), nodes(s).where("type = 'mandatory'")).select("src", "dst"), f"SELECT src, dst FROM {ESQL} WHERE src IN (SELECT node FROM {NSQL} WHERE type = 'mandatory') AND dst IN (SELECT node FROM {NSQL} WHERE type = 'mandatory')"),
    "graph_integrity": (lambda s, f: G.integrity(cyclic(s).unionByName(frame(s, [("a", "b", 1.0, 1.0), ("a", "zz", 1.0, 1.0)], E_SCHEMA)), nodes(s)), "SELECT * FROM (VALUES ('missing-node', 1::BIGINT), ('loop', 1), ('repeated-edge', 1), ('repeated-node', 0), ('isolated', 1)) t(issue, n)"),
    "graph_merge": (lambda s, f: G.merge(edges(s), cyclic(s).withColumn("weight", F.lit(9.0)), ["src", "dst"]).select("src", "dst", "weight"), f"SELECT src, dst, weight FROM {ESQL} UNION ALL SELECT src, dst, 9.0 FROM {CSQL} c WHERE NOT EXISTS (SELECT 1 FROM {ESQL} e WHERE e.src = c.src AND e.dst = c.dst)"),
    "graph_blocked": (lambda s, f: G.paths_to_blockers(edges(s), nodes(s), DONE), f"SELECT e.dst AS node, count(DISTINCT e.src) AS blockers FROM {ESQL} e JOIN {NSQL} n ON n.node = e.src WHERE coalesce(status, 'not-assessed') NOT IN {tuple(DONE)} GROUP BY 1"),
    "graph_criticality": (lambda s, f: G.criticality(edges(s), nodes(s)), f"SELECT node, (12 * (SELECT count(*) FROM {ESQL} WHERE src = node) + 5 * (SELECT count(*) FROM {ESQL} WHERE dst = node) + CASE type WHEN 'prohibited' THEN 25 WHEN 'mandatory' THEN 20 ELSE 0 END + CASE WHEN has_timing THEN 25 ELSE 0 END + CASE WHEN n_deliverables > 0 THEN 10 ELSE 0 END + least(12, 3 * n_references))::BIGINT AS score FROM {NSQL}"),
}
