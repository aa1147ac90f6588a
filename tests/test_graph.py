"""Graph operators against plain versions, on random graphs, chains and rings; and how many jobs they take."""

import os
import random

import numpy as np
import pytest

from ledgerloom import plans
from ledgerloom.operators import graph as G


def closure(edges):
    reach = {}
    for a, _ in edges:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for s, d in edges:
                if s == x and d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[a] = seen
    return reach


def strong(edges, nodes):
    reach = closure(edges)
    return {n: min([n, *(m for m in nodes if m in reach.get(n, ()) and n in reach.get(m, ()))]) for n in nodes}


def frames(spark, edges, nodes):
    return spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node string")


def name(i):
    return f"n{i:03d}"


def ring(a, n):
    return [(name(a + i), name(a + (i + 1) % n)) for i in range(n)]


GRAPHS = {
    "random": [(name(r.randrange(30)), name(r.randrange(30))) for r in [random.Random(1)] for _ in range(45)],
    "chain": [(name(i), name(i + 1)) for i in range(12)],
    "rings in a row": [*ring(0, 3), *ring(3, 4), *ring(7, 2), (name(1), name(3)), (name(5), name(7)), (name(8), name(20)), (name(30), name(0))],
    "ring": ring(0, 9),
    "loop and pair": [(name(0), name(0)), (name(1), name(2)), (name(2), name(1)), (name(1), name(2))],
}


@pytest.mark.parametrize("kind", GRAPHS)
def test_strong_components(spark, kind):
    edges = GRAPHS[kind]
    nodes = sorted({n for e in edges for n in e} | {name(99)})
    got = {r["node"]: r["component"] for r in G.strong_components(*frames(spark, [*edges, ("outside", nodes[0])], nodes)).collect()}
    assert got == strong(edges, nodes)


def test_strong_components_of_nothing(spark):
    assert G.strong_components(*frames(spark, [], [])).count() == 0


def jobs(spark, run):
    """Spark jobs that a call takes."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup("counted"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_grow_with_the_chain_at_most(spark):
    took = [jobs(spark, lambda n=n: G.strong_components(*frames(spark, [(name(i), name(i + 1)) for i in range(n)], [name(i) for i in range(n + 1)])).count()) for n in (8, 16, 32)]
    assert took[2] <= 2.5 * took[1] and all(t <= 12 * n for t, n in zip(took, (8, 16, 32))), took  # a job is a stage here; before, ten nodes took 264


def test_levels_and_critical_path_of_a_chain(spark):
    n = 10
    edges = [(name(i), name(i + 1)) for i in range(n)] + [(name(0), name(n)), (name(3), name(9)), ("x", "y"), ("y", "x"), ("y", "z")]
    nodes = sorted({v for e in edges for v in e})
    e, v = frames(spark, edges, nodes)
    level = {r["node"]: r["level"] for r in G.topological_levels(e, v).collect()}
    assert level == {**{name(i): i for i in range(n + 1)}, "x": None, "y": None, "z": None}
    plain = [(a, b) for a, b in edges if a.startswith("n")]
    e, _ = frames(spark, plain, nodes)
    d = spark.createDataFrame([(name(i), float(1 + i % 3)) for i in range(n + 1)], "node string, duration double")
    got = {r["node"]: (r["start"], r["slack"]) for r in G.critical_path(e, d).collect()}
    start = 0.0
    for i in range(n + 1):
        assert got[name(i)] == (start, 0.0)
        start += 1 + i % 3


@pytest.mark.parametrize("seed", [1, 2])
def test_weighted_paths_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    edges = [(name(r.randrange(14)), name(r.randrange(14)), float(r.randrange(1, 6))) for _ in range(40)]
    best = {name(0): 0.0}
    for _ in range(14):
        for a, b, c in edges:
            if a in best and best[a] + c < best.get(b, 1e9):
                best[b] = best[a] + c
    got = {x["node"]: x["distance"] for x in G.weighted_paths(spark.createDataFrame(edges, "src string, dst string, weight double"), name(0)).collect()}
    assert got == best


def test_large_tables_go_to_more_tasks(spark, monkeypatch):
    """What one task holds does not grow with the table, and results are as before."""
    e = spark.createDataFrame([(f"a{i % 7}", f"b{i % 5}", 1.0, 1.0) for i in range(35)], "src string, dst string, weight double, confidence double")
    n = e.selectExpr("src as node").union(e.selectExpr("dst")).distinct().union(spark.createDataFrame([("alone",)], "node string"))
    run = lambda: [sorted((r[0], *(round(x, 9) if isinstance(x, float) else x for x in r[1:])) for r in f.collect()) for f in (G.degrees(e, n, 35), G.components(e, n), G.influence(e, n, rounds=3, tolerance=0.0))]
    few, told, real = run(), [], G.tasks_for
    monkeypatch.setattr(G, "TASK_ROWS", 3)
    monkeypatch.setattr(G, "tasks_for", lambda df, rows: (told.append(real(df, rows)), told[-1])[1])
    assert run() == few and min(told) >= 35 / 3
    assert G.degrees(e, n, 35).rdd.getNumPartitions() >= 70 / 3
    assert ("alone", 0, 0, 0.0) in few[0] and ("a0", 0, 5, 5.0) in few[0] and ("b0", "a0") in few[1]


def _fixed_scores(edges, nodes, damping=0.85):
    """Scores that solve the equations of weighted PageRank, by numpy."""
    at = {n: i for i, n in enumerate(nodes)}
    move = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        move[at[b], at[a]] += w
    out = move.sum(0)
    move = np.where(out > 0, move / np.where(out > 0, out, 1), 1 / len(nodes))
    return dict(zip(nodes, np.linalg.solve(np.eye(len(nodes)) - damping * move, np.full(len(nodes), (1 - damping) / len(nodes))), strict=True))


def test_influence_goes_on_until_nothing_changes(spark):
    rng = random.Random(5)
    two_sides = [(f"p{rng.randrange(40)}", f"s{rng.randrange(3)}", float(rng.randrange(1, 5))) for _ in range(120)]
    cyclic = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", float(rng.randrange(1, 5))) for _ in range(25)]
    for edges, more, tolerance in ((two_sides, [], 1e-8), (cyclic, ["alone"], 1e-4)):
        nodes = sorted({x for a, b, _ in edges for x in (a, b)} | set(more))
        want = _fixed_scores(edges, nodes)
        got = G.influence(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(n,) for n in nodes], "node string"), tolerance=tolerance).collect()
        assert len(got) == len(nodes) and sum(abs(r["score"] - want[r["node"]]) for r in got) < (1e-11 if edges is two_sides else 2 * tolerance)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_supply_influence_is_settled(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    edges = [(f"p{a}", f"s{b}", 1.0) for a, b in lines]
    want = _fixed_scores(edges, sorted({x for a, b, _ in edges for x in (a, b)}))
    got = plans.queries()["supply_influence"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want) and max(abs(r["score"] - want[r["node"]]) for r in got) < 1.1e-9
