"""Spatial joins, symbols and checked life cycles against plain versions."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import spatial as S


def inside(corners, x, y):
    n, odd = len(corners), False
    for i in range(n):
        (ax, ay), (bx, by) = corners[i], corners[(i + 1) % n]
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return n >= 3 and odd


@pytest.mark.parametrize("size", [0.7, 3.0])
@pytest.mark.parametrize("meet", [4096, 8])
def test_points_in_polygons_equal_all_pairs(spark, monkeypatch, size, meet):
    monkeypatch.setattr(S, "MEET", meet)
    r = random.Random(int(size * 10))
    points = [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(120)] + [(500 + i, 1.1, 1.1) for i in range(40)] + [(900, None, 1.0), (901, 0.0, 0.0)]
    shapes = []
    for i in range(12):
        cx, cy, n = r.uniform(-4, 4), r.uniform(-4, 4), r.randrange(3, 8)
        shapes.append((i, [(cx + r.uniform(0.2, 2) * math.cos(2 * math.pi * k / n), cy + r.uniform(0.2, 2) * math.sin(2 * math.pi * k / n)) for k in range(n)]))
    shapes += [(50, []), (51, [(0.0, 0.0), (1.0, 1.0)]), (52, None), (53, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    got = {tuple(x) for x in S.points_in_polygons(spark.createDataFrame(points, "point int, x double, y double"), spark.createDataFrame(shapes, f"polygon int, corners array<{S.POINT}>"), size).collect()}
    assert got == {(p, s) for p, x, y in points for s, c in shapes if x is not None and c and inside(c, x, y)}


def test_nearest_equals_all_pairs(spark):
    r = random.Random(5)
    points, others = ([(i, r.uniform(0, 9), r.uniform(0, 9)) for i in range(n)] for n in (60, 40))
    others += [(100, others[0][1], others[0][2]), (101, None, 1.0)]
    got = {x["point"]: (x["other"], round(x["distance"], 9)) for x in S.nearest(spark.createDataFrame(points, "point int, x double, y double"), spark.createDataFrame(others, "other int, x double, y double"), 1.0).collect()}
    want = {}
    for p, x, y in points:
        near = sorted((math.hypot(x - ox, y - oy), o) for o, ox, oy in others if ox is not None and math.hypot(x - ox, y - oy) <= 1.0)
        if near:
            want[p] = (near[0][1], round(near[0][0], 9))
    assert got == want and len(want) > 30


def test_symbols_at_any_place_size_and_turn(spark):
    r = random.Random(6)
    legend = [(f"e{i}", [(r.random(), r.random()) for _ in range(14)]) for i in range(6)] + [("none", []), ("null", None)]
    turn = [lambda x, y: (x, y), lambda x, y: (-y, x), lambda x, y: (-x, -y), lambda x, y: (y, -x)]
    symbols = []
    for i, (name, pts) in enumerate(legend[:6]):
        for q in range(4):
            # The symbol is the entry turned by q quarters, so the entry matches in that turn.
            symbols.append((f"{name}-{q}", [(3 + 7 * turn[q](x, y)[0], 7 * turn[q](x, y)[1] - 40) for x, y in pts]))
    symbols += [("noise", [(r.random(), r.random()) for _ in range(14)]), ("empty", [])]
    schema = f"array<{S.POINT}>"
    args = spark.createDataFrame(legend, f"entry string, points {schema}"), spark.createDataFrame(symbols, f"symbol string, points {schema}")
    got = {x["symbol"]: (x["entry"], x["rivals"]) for x in S.symbol_matches(*args, least=0.7).collect()}
    assert got == {f"e{i}-{q}": (f"e{i}", 0) for i in range(6) for q in range(4)}
    # One of fourteen points moved: still found at a lower threshold, not at 1.
    moved = [(f"{n}-m", [*p[:-1], (0.5, 0.5)]) for n, p in legend[:6]]
    near = {x["symbol"]: x["score"] for x in S.symbol_matches(args[0], spark.createDataFrame(moved, f"symbol string, points {schema}"), least=0.6).collect()}
    assert len(near) >= 5 and all(0.6 <= s <= 1 for s in near.values())


def events(r, things, n):
    t0 = datetime(2026, 1, 1)
    actions = [*L.FACT_MOVES, "unknown", None]
    return [(r.choice(things), t0 + timedelta(minutes=i), i, r.choice(actions)) for i in range(n)]


def plain(log):
    state, out = {}, Counter()
    for thing, moment, seq, action in sorted(log, key=lambda e: (e[1], e[2])):
        was = state.get(thing, L.FACT_START)
        to = L.FACT_MOVES.get(action, {}).get(was)
        state[thing] = to or was
        out[thing, seq, action, was, to or was, to is not None] += 1
    return out


@pytest.mark.parametrize("things", [["a"], ["a", "b"], list("abcdefgh") + [None]])
def test_checked_moves_equal_a_loop(spark, things):
    """One thing over many partitions too."""
    log = events(random.Random(len(things)), things, 400)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small partitions stay apart
    try:
        df = spark.createDataFrame([(*e, "k") for e in log], "thing string, moment timestamp, seq long, action string, accepted string")
        got = Counter((x["thing"], x["seq"], x["action"], x["from_state"], x["to_state"], x["accepted"]) for x in L.checked_moves(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert got == plain(log)


def test_checked_moves_of_nothing(spark):
    assert L.checked_moves(spark.createDataFrame([], "thing long, moment timestamp, seq long, action string")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    log = events(random.Random(9), list("abc"), 60)
    schema = "thing string, moment timestamp, seq long, action string"
    for k in range(3):  # a file a batch, in order
        spark.createDataFrame(log[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("moment", "1 hour")
    q = L.checked_on_stream(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = Counter((x["thing"], x["seq"], x["action"], x["from_state"], x["to_state"], x["accepted"]) for x in spark.table("moves").collect())
    assert got == plain(log)


def test_copies_of_points_and_polygons_count_as_often_as_they_are(spark):
    """Equal polygons each have a row, equal places count each time; of equally near places the first one stands for all."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shapes = spark.createDataFrame([(i, square) for i in range(50)] + [(99, [(9.0, 9.0), (12.0, 9.0), (9.0, 12.0)]), (100, [(9.0, 9.0)])], f"polygon int, corners array<{S.POINT}>")
    points = spark.createDataFrame([(i, 1.0 + i % 2, 1.5) for i in range(100, 140)] + [(7, 9.5, 9.5), (8, None, 1.0), (9, 7.0, 7.0)], "point int, x double, y double")
    assert Counter(map(tuple, S.counted_in_polygons(points, shapes, 1.5).collect())) == Counter([(i, 40, 100) for i in range(50)] + [(99, 1, 7)])
    others = spark.createDataFrame([(i, 1.0, 1.5) for i in range(30, 3, -1)] + [(1, None, 0.0)], "other int, x double, y double")
    got = {r["point"]: (r["other"], r["distance"]) for r in S.nearest(points, others, 1.25).collect()}
    assert got == {i: (4, float(i % 2)) for i in range(100, 140)}


def _random_places(r):
    points = [(i, round(r.uniform(-5, 15), 2), float(r.randrange(-3, 12)) if i % 2 else round(r.uniform(-3, 12), 2)) for i in range(400)]
    shapes = [(i, [(r.uniform(-4, 14), r.choice([r.uniform(-3, 12), float(r.randrange(-3, 12))])) for _ in range(r.randrange(2, 8))]) for i in range(60)]
    return points, shapes


def _plain_count(points, shapes):
    want = {}
    for k, c in shapes:
        for i, x, y in points:
            turns = [((ay > y) != (by > y)) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(c, c[1:] + c[:1], strict=True) if ay != by]
            if len(c) >= 3 and sum(turns) % 2:
                n, first = want.get(k, (0, i))
                want[k] = (n + 1, min(first, i))
    return {(k, n, first) for k, (n, first) in want.items()}


@pytest.mark.parametrize("held", [200_000, 9])
def test_counted_in_polygons_equals_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(S, "HELD", held)
    points, shapes = _random_places(random.Random(held))
    p = spark.createDataFrame(points, "point int, x double, y double")
    z = spark.createDataFrame(shapes, "polygon int, corners array<struct<x:double,y:double>>")
    got = list(map(tuple, S.counted_in_polygons(p, z, 3.0).collect()))
    assert len(got) == len(set(got)) and set(got) == _plain_count(points, shapes)


def test_polygons_of_a_cell_are_looked_at_in_turn_and_by_heights(monkeypatch):
    """Points of one height cost a polygon one search, however many they are."""
    points, shapes = _random_places(random.Random(3))
    places = pa.table({"point": [i for i, _, _ in points], "x": [x for _, x, _ in points], "y": [y for _, _, y in points], "n": [1] * len(points)})
    zones = [s for s in shapes if len(s[1]) >= 3]
    zones = pa.table({"polygon": [k for k, _ in zones], "corners": pa.array([[{"x": x, "y": y} for x, y in c] for _, c in zones])})
    monkeypatch.setattr(S, "TOGETHER", 7)
    assert {(r["polygon"], r["n"], r["point"]) for r in S._counted(places, zones).to_pylist()} == _plain_count(points, shapes)
    sought, real = [], np.searchsorted
    monkeypatch.setattr(S.np, "searchsorted", lambda a, v, side: (sought.append(v.size), real(a, v, side))[1])
    many = pa.table({"point": list(range(50_000)), "x": [i / 5_000 for i in range(50_000)], "y": [float(i % 10) for i in range(50_000)], "n": [1] * 50_000})
    S._counted(many, zones)
    assert sum(sought) <= zones.num_rows * 10 * 7
