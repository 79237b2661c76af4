import random

import pytest

from asofia.llm.components import connected_components
from asofia.llm.scratch import Scratch


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


GRAPHS = {
    "chain": [(i, i + 1) for i in range(200)], "zigzag": [(i, 400 - i) for i in range(200)] + [(400 - i, i + 1) for i in range(199)], "star": [(500, i) for i in range(300)],
    "dense": [(a, b) for a in range(40) for b in range(a)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)], "none": [], "negative": [(-5, 3), (3, -(1 << 63)), ((1 << 63) - 1, 7)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_same_as_union_find(spark, name):
    edges = GRAPHS[name]
    random.Random(1).shuffle(edges)
    table = spark.createDataFrame([*edges, (None, 5), (6, None)], "a long, b long")
    assert {r.node: r.component for r in connected_components(table, Scratch(spark, "test")).collect()} == brute(edges)


def test_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)]
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()} == brute(edges)
