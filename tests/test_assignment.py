from __future__ import annotations

import random

from lectern.operators.assignment import greedy_assign


def test_against_the_walk(spark):
    rnd = random.Random(1)
    rows = [(c, 100 - c, t, round(rnd.random(), 1)) for c in range(25) for t in rnd.sample(range(18), 4)]
    free, want = set(range(18)), {}
    for c in sorted(range(25), key=lambda c: 100 - c):
        mine = sorted((d, t) for x, _, t, d in rows if x == c and t in free)
        if mine:
            want[c] = mine[0][1]
            free.discard(mine[0][1])
    df = spark.createDataFrame([*rows, (None, 1, 2, 0.0), (3, 97, None, 0.1)], "c long, o long, t long, d double")
    assert {r.c: r.t for r in greedy_assign(df, "c", "o", "t", "d").collect()} == want
    assert greedy_assign(df.limit(0), "c", "o", "t", "d").count() == 0
