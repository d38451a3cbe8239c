"""Bit-parallel traversal against plain breadth-first searches."""

import collections

import numpy as np
import pytest


def graph(n, m, seed, directed=False):
    rng = np.random.default_rng(seed)
    e = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))}
    return e if directed else e | {(b, a) for a, b in e}


def spark_graph(spark, edges, n):
    from tessella.model import Graph

    return Graph(spark.createDataFrame([(a, b, 1.0) for a, b in sorted(edges)], "src long, dst long, w double"), spark.range(n))


def plain(edges, n, sources):
    """(hops by source, dependencies of the sources) by Brandes' algorithm."""
    out = collections.defaultdict(list)
    for a, b in edges:
        if a != b:
            out[a].append(b)
    hops, total = {}, np.zeros(n)
    for s in sources:
        dist, sigma, order, into = {s: 0}, collections.Counter({s: 1}), [s], collections.defaultdict(list)
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    into[w].append(v)
        delta = np.zeros(n)
        for w in reversed(order):
            for v in into[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
        hops[s] = dist
    return hops, total


@pytest.mark.parametrize(("n", "m", "directed", "rows"), [(90, 200, True, 90)])
def test_hops_and_dependencies(spark, n, m, directed, rows):
    from tessella.operators.traversal import dependencies, hop_counts

    edges = graph(n, m, 1, directed)
    g = spark_graph(spark, edges, n)
    hops, total = plain(edges, n, range(n))
    want = {(s, h): c for s in hops for h, c in collections.Counter(hops[s].values()).items() if h}
    assert {(r.source, r.hop): r.n for r in hop_counts(g, rows=rows).collect()} == want
    # With few rows of state, sources are taken group by group.
    few = spark.createDataFrame([(i,) for i in range(0, n, 2)], "id long")
    got = {r.id: r.c for r in dependencies(g, few, rows=rows).collect()}
    want = plain(edges, n, range(0, n, 2))[1]
    assert len(got) == n and all(abs(got[i] - want[i]) < 1e-9 for i in range(n))


def test_exact_betweenness_of_500_nodes(spark):
    from tessella.operators.traversal import betweenness, betweenness_sampled, sampled_nodes

    edges = graph(500, 900, 2)
    g = spark_graph(spark, edges, 500)
    total = plain(edges, 500, range(500))[1]
    got = {r.id: r.centrality for r in betweenness(g).collect()}
    assert all(abs(got[i] - total[i] / (499 * 498)) < 1e-12 for i in range(500))
    some = [r.id for r in sampled_nodes(g, 40, 3).collect()]
    part = plain(edges, 500, some)[1]
    got = {r.id: r.centrality for r in betweenness_sampled(g, 40, False, 3).collect()}
    assert all(abs(got[i] - part[i] * 500 / 40 / 2) < 1e-9 for i in range(500))


def test_no_edges(spark):
    from tessella.operators.graphs import average_path_length, graph_diameter
    from tessella.operators.traversal import betweenness

    g = spark_graph(spark, {(0, 0)}, 4)
    assert [r.centrality for r in betweenness(g).collect()] == [0.0] * 4
    assert graph_diameter(g).first().diameter == 0 and average_path_length(g).first().length == 0
