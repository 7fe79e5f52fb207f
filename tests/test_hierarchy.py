from __future__ import annotations

import random

from lectern.operators.hierarchy import descendants, latest_links, resolve


def _brute(parent):
    out = {}
    for x in parent:
        seen = [x]
        while parent.get(seen[-1]) in parent and parent[seen[-1]] not in seen:
            seen.append(parent[seen[-1]])
        up = parent.get(seen[-1])
        if up in parent:
            cycle = seen[seen.index(up) :]
            if x in cycle:
                out[x] = (min(cycle), 0, "cycle")
            else:
                out[x] = (min(cycle), seen.index(up), "below_cycle")
        else:
            out[x] = (seen[-1], len(seen) - 1, "tree")
    return out


def test_against_walking(spark):
    rnd = random.Random(3)
    parent = {k: rnd.choice([None, 999, rnd.randrange(80), rnd.randrange(80)]) for k in range(80)}
    parent |= {k: k - 1 for k in range(101, 160)} | {100: 5}  # a chain
    parent |= {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 210: 210, 211: 210}
    rows = [(k, p, "n", 1) for k, p in parent.items()] + [(3, 999, "old", 0), (None, 3, "x", 5), (200, 201, "n", 1)]
    links = latest_links(spark.createDataFrame(rows, "id long, up long, name string, at int"), "id", "up", "at", "name")
    done = resolve(links)
    assert {r.node: (r.root, r.depth, r.state) for r in done.collect()} == _brute(parent)
    got = {(r.node, r.descendant, r.steps) for r in descendants(done).collect()}
    for r in done.where("state = 'tree'").collect():
        assert r.path_ids[0] == r.root and r.path_ids[-1] == r.node and len(r.path_ids) == r.depth + 1
        assert all((x, r.node, r.depth - i) in got for i, x in enumerate(r.path_ids[:-1]))


def test_nothing(spark):
    links = latest_links(spark.createDataFrame([], "id long, up long, name string, at int"), "id", "up", "at", "name")
    assert resolve(links).count() == 0
