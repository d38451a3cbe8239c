"""Path counts of many sources: what a hop writes."""

from tessella.model import Graph
from tessella.operators import traversal as T


def test_a_hop_writes_its_state_once(spark, monkeypatch):
    written, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda d: written.append(d.columns) or cut(d))
    path = [(i, i + 1) for i in range(4)] + [(0, 5), (5, 2)]
    g = Graph(spark.createDataFrame([(x, y, 1.0) for a, b in path for x, y in ((a, b), (b, a))], "src long, dst long, w double"), spark.range(6))
    got = {r.id: r.c for r in T.dependencies(g).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 13.0, 3: 8.0, 4: 0.0, 5: 3.0}
    # Four hops and the first state forward, the hop that finds nothing, four hops back.
    assert len([c for c in written if "batch" in c and "lane" not in c]) == 10
