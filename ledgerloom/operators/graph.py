"""Property graphs as edge tables: traversal, paths, cycles, order, components, influence and critical path.

edges has src and dst, and where asked weight and confidence.  Iterative
operators write each round to the shared checkpoint folder and go on until
nothing changes; a bound on steps holds only where the caller gives one.
"""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Rounds after which the pieces that rounds have added to a table are written as one.
COMPACT = 16
#: Nodes without a way in or out are taken away round by round while a round takes one in so many.
TRIM = 16
#: Rows that one task of a large table takes at most, about.
TASK_ROWS = 500_000


def shared_folder(df: DataFrame) -> None:
    """Make sure of a checkpoint folder that all executors share; one of our own only in local mode."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loom-graph-"))


def task_count(df: DataFrame) -> int:
    """Tasks for rows that a stage makes many of, whatever they come from: adaptive execution would put few small ones into one task."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for so many rows that are dealt by a key: what one task holds does not grow with the table."""
    return max(task_count(df), -(-rows // TASK_ROWS))


def _settled(df: DataFrame) -> DataFrame:
    """df read back from the checkpoint folder that all executors share."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def _counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """df settled, and how many of its rows there are, or for how many `what` holds; counted while it is written."""
    seen = Observation()
    out = _settled(df.observe(seen, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")))
    return out, seen.get["n"]


class _Pieces:
    """A table that rounds add to; what they add is written as one every COMPACT pieces, so that nothing is rewritten each round."""

    def __init__(self) -> None:
        self.table: DataFrame | None = None
        self.loose = 0

    def add(self, piece: DataFrame) -> None:
        self.table = piece if self.table is None else self.table.unionByName(piece)
        self.loose += 1
        if self.loose == COMPACT:
            self.table, self.loose = _settled(self.table), 0


def _steps(most: int | None):
    return count(1) if most is None else range(1, most + 1)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes that each seed (a column `node`) reaches, within `depth` steps if given, the seed not among them unless on a cycle.

    Breadth first: a round extends the frontier by one join and drops what is
    known, so cycles end it.
    """
    e = _settled(edges.select("src", "dst").distinct())
    frontier = seeds.select(F.col("node").alias("seed"), F.col("node")).distinct()
    known = frontier.withColumn("depth", F.lit(0)).limit(0)
    for d in _steps(depth):
        step = frontier.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        if d > 1:
            step = step.join(known.select("seed", "node"), ["seed", "node"], "left_anti")
        step = _settled(step.withColumn("depth", F.lit(d)))
        if step.isEmpty():
            break
        known = step if d == 1 else known.unionByName(step)
        known = _settled(known) if d % COMPACT == 0 else known
        frontier = step.select("seed", "node")
    return known


def _costed(edges: DataFrame, cost: Column | None = None) -> DataFrame:
    """(src, dst, c): the cheapest of parallel edges; 1 each without a weight."""
    c = cost if cost is not None else F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = _settled(edges.select("src", "dst", c.cast("double").alias("c")).groupBy("src", "dst").agg(F.min("c").alias("c")))
    if not e.where("c < 0 or c is null or isnan(c)").isEmpty():
        raise ValueError("costs must be numbers and not negative")
    return e


def simple_paths(edges: DataFrame, start: str, end: str | None = None, depth: int | None = None, most: int | None = None) -> DataFrame:
    """(path, length, cost): all paths without a repeated node from start (to end), of at most `depth` steps if given; shortest first, the first `most` if given.

    There can be exponentially many; each round extends all open ones by a step.
    """
    e = _costed(edges)
    open_paths = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("nodes"), F.lit(0.0).alias("cost"))
    out = open_paths.limit(0)
    for _ in _steps(depth):
        more = open_paths.join(e, F.col("node") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
        open_paths = _settled(more.select(F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), (F.col("cost") + F.col("c")).alias("cost")))
        if open_paths.isEmpty():
            break
        out = out.unionByName(open_paths)
        if end is not None:
            open_paths = open_paths.where(F.col("node") != end)
    out = out if end is None else out.where(F.col("node") == end)
    out = out.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("length"), "cost").orderBy("length", "path")
    return out if most is None else out.limit(most)


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(path, length): the path of fewest steps, of equal ones the first by the names of its nodes in turn; no row if there is none.

    Breadth first without a bound: every node is reached once, by the least of
    the paths to it of that many steps.
    """
    e = _settled(edges.select("src", "dst").distinct())
    frontier = _settled(edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("nodes")))
    known = frontier.select("node")
    for d in count(1):
        found = frontier.where(F.col("node") == end)
        if not found.isEmpty():
            return found.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("length"))
        step = frontier.join(e, F.col("node") == F.col("src")).join(known.select(F.col("node").alias("dst")), "dst", "left_anti")
        frontier = _settled(step.groupBy("dst").agg(F.min("nodes").alias("nodes")).select(F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes")))
        if frontier.isEmpty():
            return frontier.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("length"))
        known = known.unionByName(frontier.select("node"))
        known = _settled(known) if d % COMPACT == 0 else known
    raise AssertionError


def weighted_paths(edges: DataFrame, start: str, cost: Column | None = None) -> DataFrame:
    """(node, distance, path): the cheapest way from start to every node it reaches, of equal ones that of fewest steps, then the first by names.

    Rounds of relaxation from the nodes that the last one improved, until none is.
    """
    e = _costed(edges, cost)
    first = F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("steps"), F.array(F.lit(start)).alias("nodes"))
    moved, n = _settled(edges.sparkSession.range(1).select(F.lit(start).alias("node"), first.alias("b"))), 1
    found = _Pieces()
    while n:
        found.add(moved)
        way = F.struct((F.col("b.distance") + F.col("c")).alias("distance"), (F.col("b.steps") + 1).alias("steps"), F.array_append("b.nodes", F.col("dst")).alias("nodes"))
        more = moved.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), way.alias("w")).groupBy("node").agg(F.min("w").alias("w"))
        best = found.table.groupBy("node").agg(F.min("b").alias("b"))
        better = more.join(best, "node", "left").where(F.col("b").isNull() | (F.col("w") < F.col("b")))
        moved, n = _counted(better.select("node", F.col("w").alias("b")))
    best = found.table.groupBy("node").agg(F.min("b").alias("b"))
    return best.select("node", "b.distance", F.array_join("b.nodes", ">").alias("path"))


def weighted_distances(edges: DataFrame, start: str, cost: Column | None = None) -> DataFrame:
    """(node, distance) of weighted_paths."""
    return weighted_paths(edges, start, cost).select("node", "distance")


def edge_cost(kind: str) -> Column:
    doubt = 1 - F.coalesce(F.col("confidence"), F.lit(0.0))
    return {"weight": F.coalesce(F.col("weight"), F.lit(1.0)), "doubt": doubt, "weighted-doubt": F.coalesce(F.col("weight"), F.lit(1.0)) * doubt}[kind]


def directed_cycles(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(cycle, length): every simple cycle once, written from its least node; of at most `depth` steps if given.

    Nodes that no cycle passes are taken away first; a path goes on through nodes
    above its first one only, so that the rounds end.
    """
    e = _settled(edges.select("src", "dst").distinct())
    while True:  # an edge on a cycle has one before it and one behind it
        inner = _settled(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if inner.count() == e.count():
            break
        e = inner
    paths = e.where("dst >= src").select(F.col("src").alias("first"), F.col("dst").alias("node"), F.array("src").alias("nodes"))
    out = None
    for _ in _steps(depth):
        paths = _settled(paths)
        if paths.isEmpty():
            break
        closed = paths.where("node = first").select("nodes")
        out = closed if out is None else out.unionByName(closed)
        more = paths.where("node > first").join(e, F.col("node") == F.col("src")).where(F.col("dst") >= F.col("first"))
        paths = more.where(~F.array_contains("nodes", F.col("node"))).select("first", F.col("dst").alias("node"), F.array_append("nodes", F.col("node")).alias("nodes"))
    out = paths.limit(0).select("nodes") if out is None else out
    return out.select(F.array_join("nodes", ">").alias("cycle"), F.size("nodes").alias("length"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the highest predecessor; nodes on or behind a cycle have null.

    Each round takes the nodes whose predecessors all have gone in earlier ones, so
    that a node's level is its round; edges that are done with leave the table.
    """
    e = _settled(edges.select("src", "dst").distinct())
    left = _settled(nodes.select("node").distinct())
    done = _Pieces()
    for level in count(0):
        ready, n = _counted(left.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        done.add(ready.withColumn("level", F.lit(level)))
        if not n:
            return done.table.unionByName(left.withColumn("level", F.lit(None).cast("int")))
        left = _settled(left.join(ready, "node", "left_anti"))
        e = _settled(e.join(ready.select(F.col("node").alias("src")), "src", "left_anti"))
    raise AssertionError


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): weakly connected, named by the least node.

    Labels take the least label of a neighbour, then the label of their label,
    so that long chains halve each round.
    """
    both, m = _counted(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    lab, n = _counted(nodes.select("node", F.col("node").alias("component")).distinct())
    dealt = lambda x, *on: x.repartition(tasks_for(x, max(m, n)), *on)
    both = _settled(dealt(both, "dst"))
    while True:
        near = dealt(both, "dst").join(dealt(lab.select(F.col("node").alias("dst"), "component"), "dst"), "dst")
        near = dealt(near.select(F.col("src").alias("node"), "component"), "node").groupBy("node").agg(F.min("component").alias("m"))
        step = dealt(lab, "node").join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = _settled(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "was"))
        lab = new.drop("was")
        if new.where("component <> was").isEmpty():
            break
    return lab


def _least_reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, c): for nodes (node, c: a struct that ends in node) the least c among those that lead to it, its own included.

    A node also takes what the node behind its c has found, so that long ways halve each round.
    """
    colour = nodes
    while True:
        near = colour.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
        step = colour.join(near, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was"))
        jump = step.select(F.col("node").alias("to"), F.col("c").alias("further"))
        new, moved = _counted(step.join(jump, F.col("c.node") == F.col("to")).select("node", F.least("c", "further").alias("c"), "was"), F.col("c") != F.col("was"))
        colour = new.drop("was")
        if not moved:
            return colour


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): nodes that reach one another, named by the least of them.

    Nodes that no edge enters or leaves are alone and go, as long as that takes many.  Then every
    node takes the first of those that reach it, in an order by hash; those that also reach
    that one are its component and go, with all edges between different firsts.  By the random order
    a chain falls into pieces of like size, so rounds grow with the logarithm of its length.
    Tables stay as large as the graph, whatever reaches what.
    """
    left, n = _counted(nodes.select("node").distinct())
    within = lambda e, keep: e.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    e, m = _counted(within(edges.select("src", "dst").where("src <> dst").distinct(), left))
    out = _Pieces()
    for turn in count(0):
        while m:
            inner = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            kept, k = _counted(inner)
            out.add(left.join(kept, "node", "left_anti").select("node", F.col("node").alias("root")))
            gone, left, n = n - k, kept, k
            e, m = _counted(within(e, left))
            if gone * TRIM < n:
                break
        if not m:
            out.add(left.select("node", F.col("node").alias("root")))
            break
        order = _settled(left.select("node", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node")).alias("c")))
        colour = _least_reaching(e, order)
        src, dst = (colour.select(F.col("node").alias(k), F.col("c").alias(f"c_{k}")) for k in ("src", "dst"))
        e = _settled(e.join(src, "src").join(dst, "dst").where("c_src = c_dst").select("src", "dst"))
        back = _least_reaching(reversed_edges(e), order)
        found = _settled(colour.join(back.select("node", F.col("c").alias("b")), "node").where("c = b").select("node", F.col("c.node").alias("root")))
        out.add(found)
        left, n = _counted(left.join(found, "node", "left_anti"))
        e, m = _counted(within(e, left))
    named = out.table.groupBy("root").agg(F.min("node").alias("component"))
    return _settled(out.table.join(named, "root").select("node", "component"))


def condensation(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Edges between strong components, with how many edges each stands for."""
    c = comp.select("node", "component")
    e = edges.join(c.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    return e.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"))


def influence(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-8) -> DataFrame:
    """(node, score): weighted PageRank with the rank of nodes without edges spread over all.

    Without `rounds` the scores are those that further rounds would not change.
    Where nodes without edges spread as the damping does, these are in proportion
    to what walks from every node bring when each step keeps a share `damping`.
    So only what still walks goes into a round: none is left after as many rounds
    as an acyclic graph is deep; in others, rounds end when the rest of all walks
    is below `tolerance` of the whole.  With `rounds`, the scores after so many
    rounds from equal ones, fewer if one changes them by less than `tolerance`.
    """
    nodes, n = _counted(nodes.select("node").distinct())
    w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e, m = _counted(edges.select("src", "dst", w.cast("double").alias("w")).where("w > 0"))
    dealt = lambda x, *on: x.repartition(tasks_for(x, max(m, n)), *on)
    e = dealt(e, "src")
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    # An edge lies in the task of its src, so what follows groups by src and dst there.
    e = _settled(e.join(total, "src").groupBy("src", "dst").agg((F.sum("w") / F.first("t")).alias("p")))

    def passed(rank: DataFrame, what: str) -> DataFrame:
        """(node, s): what the edges bring to each node."""
        got = dealt(e, "src").join(dealt(rank.select(F.col("node").alias("src"), F.col(what).alias("score")), "src"), "src").select(F.col("dst").alias("node"), "score", "p")
        return dealt(got, "node").groupBy("node").agg(F.sum(F.col("score") * F.col("p")).alias("s"))

    if rounds is None:
        rank, walks, whole = _settled(nodes.select("node", F.lit(1.0).alias("score"), F.lit(1.0).alias("walks"))), float(n), float(n)
        while walks * damping > tolerance * (1 - damping) * whole:
            came = damping * F.coalesce("s", F.lit(0.0))
            rank = _settled(dealt(rank, "node").join(passed(rank.where("walks > 0"), "walks"), "node", "left").select("node", (F.col("score") + came).alias("score"), came.alias("walks")))
            walks, whole = rank.agg(F.sum("walks"), F.sum("score")).first()
        return rank.select("node", (F.col("score") / F.lit(whole)).alias("score"))

    out = e.select(F.col("src").alias("node")).distinct().withColumn("has", F.lit(True))
    rank = _settled(nodes.join(out, "node", "left").select("node", "has", F.lit(1.0 / max(n, 1)).alias("score")))
    for _ in range(rounds):
        dangling = rank.where("has is null").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        base = (1 - damping) / n + damping * dangling / n
        new = _settled(dealt(rank, "node").join(passed(rank, "score"), "node", "left").select("node", "has", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("score"), F.col("score").alias("was")))
        rank = new.drop("was")
        if new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] < tolerance:
            break
    return rank.select("node", "score")


def critical_path(edges: DataFrame, durations: DataFrame) -> DataFrame:
    """(node, start, finish, slack) of an acyclic graph: earliest times and how much a node may slip; critical ones have none.

    durations: (node, duration).  Levels give the order, one round each.
    """
    lev = topological_levels(edges, durations)
    e = _settled(edges.select("src", "dst").distinct())
    top = lev.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    base = _settled(lev.where("level is not null").join(durations, "node"))
    times = _Pieces()
    times.add(base.where("level = 0").select("node", F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("finish")))
    for k in range(1, top + 1):
        here = base.where(F.col("level") == k)
        s = here.join(e, here["node"] == e["dst"]).join(times.table.select(F.col("node").alias("src"), "finish"), "src").groupBy("node", "duration").agg(F.max("finish").alias("start"))
        times.add(_settled(s.select("node", "start", (F.col("start") + F.col("duration")).alias("finish"))))
    end = times.table.agg(F.max("finish")).first()[0]
    late = _Pieces()
    for k in range(top, -1, -1):
        here = base.where(F.col("level") == k).select("node", "duration")
        if late.table is None:
            step = here.select("node", F.lit(end).cast("double").alias("by"), "duration")
        else:
            nxt = here.join(e, here["node"] == e["src"], "left").join(late.table.select(F.col("node").alias("dst"), (F.col("by") - F.col("duration")).alias("ls")), "dst", "left")
            step = nxt.groupBy("node", "duration").agg(F.coalesce(F.min("ls"), F.lit(end)).alias("by")).select("node", "by", "duration")
        late.add(_settled(step))
    j = times.table.join(late.table.select("node", "by"), "node")
    return j.select("node", "start", "finish", (F.col("by") - F.col("finish")).alias("slack"), (F.abs(F.col("by") - F.col("finish")) < 1e-9).alias("critical"))


def degrees(edges: DataFrame, nodes: DataFrame, rows: int = 0) -> DataFrame:
    """(node, in_degree, out_degree, strength): strength is the sum of weight times confidence.

    rows: about how many edges there are, if known, from which the number of tasks follows.
    """
    s = F.coalesce(F.col("weight"), F.lit(1.0)) * F.coalesce(F.col("confidence"), F.lit(1.0))
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), s.alias("s")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), s.alias("s")))
    ends = ends.where("node is not null").withColumn("known", F.lit(False)).unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("s"), F.lit(True).alias("known")))
    ends = ends.repartition(tasks_for(ends, 2 * rows), "node") if rows else ends
    g = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("s").alias("s"), F.max("known").alias("known")).where("known")
    return g.select("node", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("s", F.lit(0.0)).alias("strength"))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi")


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(issue, n): edges to unknown nodes, loops, repeated edges, repeated nodes, nodes without edges."""
    n = nodes.select("node").distinct()
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    return (
        one("missing-node", ends.join(n, "node", "left_anti")).unionByName(one("loop", edges.where("src = dst"))).unionByName(one("repeated-edge", edges.groupBy("src", "dst").count().where("count > 1")))
        .unionByName(one("repeated-node", nodes.groupBy("node").count().where("count > 1"))).unionByName(one("isolated", n.join(ends, "node", "left_anti")))
    )


def merge(a: DataFrame, b: DataFrame, key: list[str], overwrite: bool = False) -> DataFrame:
    """Rows of both tables; of a common key that of a, or of b if overwrite."""
    first, second = (b, a) if overwrite else (a, b)
    return first.unionByName(second.join(first.select(*key), key, "left_anti"))


def paths_to_blockers(edges: DataFrame, nodes: DataFrame, done: list[str]) -> DataFrame:
    """(node, blockers): nodes with a direct predecessor whose status isn't among the done ones."""
    p = edges.join(nodes.select(F.col("node").alias("src"), "status"), "src")
    return p.where(~F.coalesce(F.col("status"), F.lit("not-assessed")).isin(done)).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("blockers"))


def criticality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, score): 12 per successor, 5 per predecessor, 20 or 25 by type, 25 each for party and deliverables' absence, up to 12 for references."""
    d = degrees(edges.withColumns({"weight": F.lit(1.0), "confidence": F.lit(1.0)}), nodes)
    j = nodes.join(d, "node")
    kind = F.when(F.col("type") == "prohibited", 25).when(F.col("type") == "mandatory", 20).otherwise(0)
    score = 12 * F.col("out_degree") + 5 * F.col("in_degree") + kind + F.when(F.col("has_timing"), 25).otherwise(0) + F.when(F.col("n_deliverables") > 0, 10).otherwise(0) + F.least(F.lit(12), 3 * F.col("n_references"))
    return j.select("node", score.cast("long").alias("score"))
