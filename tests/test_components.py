from __future__ import annotations

import random

from lectern.operators.components import components


def _brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in root}


def test_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3), (7, None)] + [(2000, 2001)] * 3
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == _brute(edges)


def test_nothing(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
