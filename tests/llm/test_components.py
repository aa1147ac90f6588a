import random

import pytest

from ledgerloom.llm.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


@pytest.mark.parametrize("seed", range(3))
def test_equals_union_find(spark, seed):
    r = random.Random(seed)
    chain = list(range(1000, 1040))
    r.shuffle(chain)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + list(zip(chain, chain[1:])) + [(500, i) for i in range(501, 560)]
    edges += edges[:5]
    want = brute([e for e in edges if e[0] != e[1]])
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "a int, b int"))
    assert {r["node"]: r["label"] for r in got.collect()} == want and got.count() == len(want)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
