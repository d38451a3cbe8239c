"""Distances in a tree: a pair is made once, at its lowest common ancestor."""

import itertools

from tessella.operators import partitions as P


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_lineage_pairs_are_not_exchanged(spark):
    parent = {0: -1, 1: 0, 2: 0, 3: 1, 4: 1, 5: 3, 6: -1, 7: 6, 8: 2}
    d = P.lineage_distance(spark.createDataFrame(list(parent.items()), "clone long, parent long"))
    up = {c: {c: 0} for c in parent}
    for c in parent:
        a, k = parent[c], 1
        while a >= 0:
            up[c][a], a, k = k, parent[a], k + 1
    want = {(a, b): min(up[a][x] + up[b][x] for x in up[a].keys() & up[b].keys()) for a, b in itertools.combinations(sorted(parent), 2) if up[a].keys() & up[b].keys()}
    rows = d.collect()
    assert {(r.a, r.b): r.distance for r in rows} == want and len(rows) == len(want)
    assert "HashAggregate" not in plan(d)
    two = spark.createDataFrame([(0, -1), (1, 0), (2, 1), (2, 0)], "clone long, parent long")  # no tree
    assert {(r.a, r.b): r.distance for r in P.lineage_distance(two).collect()} == {(0, 1): 1, (0, 2): 1, (1, 2): 1}
