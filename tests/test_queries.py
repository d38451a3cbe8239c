"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of every family and those that changed last; ALL_SQL=1 compares every query that has SQL.
CHOSEN = [
    "flagship", "spmv", "gram", "group_stats", "softmax", "fused_qc", "pearson", "ttest_welch", "mwu_test", "kruskal_wallis", "oneway_anova",
    "mmd_rbf", "benjamini_hochberg", "holm_bonferroni", "empirical_fdr", "feature_mi", "adjusted_rand_index", "clonal_diversity", "lineage_distance",
    "scrublet_scores", "classify_doublet_types_knn", "knn_manhattan", "knn_cosine", "column_medians", "correlation_matrix_bicor", "ssgsea", "leading_edge_genes", "closeness_centrality",
    "topological_sort", "inverse_permutation", "indptr", "filter_secondary", "velocity_weighted_pseudotime", "latent_time", "ttest_compat", "kruskal_wallis_compat",
    "mnn_pairs", "local_outlier_factor", "count_triangles", "connected_components", "bfs", "graph_convolution", "global_morans_i", "getis_ord_g_star", "morans_i",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL) if os.environ.get("ALL_SQL") else CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(cell(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and abs(u - v) <= 2e-5 * max(1, abs(v))), (x, y)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def whole_graph(spark):
    """Nodes and weighted neighbours of the whole graph, and the hops between its nodes."""
    from tessella.plans.inputs import Inputs

    g = Inputs(spark, SF).graph
    nodes = [r.id for r in g.nodes.collect()]
    out = {i: {} for i in nodes}
    for r in g.edges.collect():
        out[r.src][r.dst] = r.w
    hops = {}
    for i in nodes:
        front, h = {i}, 0
        hops[i] = {i: 0}
        while front:
            h += 1
            front = {k for j in front for k in out[j] if k not in hops[i]}
            hops[i].update(dict.fromkeys(front, h))
    return nodes, out, hops


def test_centralities_of_the_whole_graph(spark, whole_graph):
    nodes, _, hops = whole_graph
    far = {i: [h for h in hops[i].values() if h] for i in nodes}
    every = [h for i in nodes for h in far[i]]
    assert QUERIES["graph_diameter"](spark, SF).first()[0] == max(every)
    assert QUERIES["average_path_length"](spark, SF).first()[0] == pytest.approx(sum(every) / len(every), abs=2e-6)
    n = len(nodes) - 1
    got = {r.id: r.centrality for r in QUERIES["harmonic_centrality"](spark, SF).collect()}
    assert got == pytest.approx({i: sum(1 / h for h in far[i]) / n for i in nodes}, abs=2e-6)
    got = {r.id: r.centrality for r in QUERIES["closeness_centrality"](spark, SF).collect()}
    assert got == pytest.approx({i: len(far[i]) ** 2 / sum(far[i]) / n if far[i] else 0 for i in nodes}, abs=2e-6)


def test_paths_of_the_whole_graph(spark, whole_graph):
    import heapq

    nodes, out, _ = whole_graph

    def paths(source, weight):
        best, heap = {}, [(0.0, source)]
        while heap:
            d, i = heapq.heappop(heap)
            if i not in best:
                best[i] = d
                for k, w in out[i].items():
                    heapq.heappush(heap, (d + weight(w), k))
        return best

    want = {(s, i): d for s in (0, 1) for i, d in paths(s, lambda w: w).items()}
    got = {(r.source, r.id): r.x for r in QUERIES["dijkstra"](spark, SF).collect()}
    assert len(got) == 2 * len(nodes)
    assert {k: x for k, x in got.items() if x < 1e30} == pytest.approx(want, abs=2e-6)
    for name, weight in (("graph_pseudotime", lambda w: w), ("latent_time", lambda w: max(-math.log(w), 1e-12))):
        d = paths(0, weight)
        got = {r.id: r.t for r in QUERIES[name](spark, SF).collect()}
        assert got == pytest.approx({i: d[i] / max(d.values()) if i in d else 1.0 for i in nodes}, abs=2e-6)


def test_steps_of_the_whole_graph(spark, whole_graph):
    import numpy as np

    nodes, out, _ = whole_graph
    at = {i: k for k, i in enumerate(nodes)}
    t = np.zeros((len(nodes), len(nodes)))
    for i in nodes:
        for k, w in out[i].items():
            t[at[i], at[k]] = w / sum(out[i].values())
    t = t @ t
    got = {(r.id, r.col): r.x for r in QUERIES["predict_future_state"](spark, SF).collect()}
    assert got == pytest.approx({(nodes[a], nodes[b]): t[a, b] for a, b in zip(*np.nonzero(t))}, abs=2e-6)
    got = {(r.a, r.b): r.dist for r in QUERIES["diffusion_distance"](spark, SF).collect()}
    ids = sorted(nodes)
    want = {(a, b): float(np.linalg.norm(t[at[a]] - t[at[b]])) for x, a in enumerate(ids) for b in ids[x + 1 :]}
    assert got == pytest.approx(want, abs=2e-6)


def test_betweenness_of_the_whole_graph(spark, whole_graph):
    nodes, out, hops = whole_graph
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order = sorted(hops[s], key=hops[s].get)
        count, part = dict.fromkeys(order, 0), dict.fromkeys(order, 0.0)
        count[s] = 1
        for i in order:
            for k in out[i]:
                if hops[s][k] == hops[s][i] + 1:
                    count[k] += count[i]
        for i in reversed(order):
            for k in out[i]:
                if hops[s][k] == hops[s][i] + 1:
                    part[i] += count[i] / count[k] * (1 + part[k])
            if i != s:
                total[i] += part[i]
    n = len(nodes)
    got = {r.id: r.centrality for r in QUERIES["betweenness_centrality"](spark, SF).collect()}
    assert got == pytest.approx({i: c / ((n - 1) * (n - 2)) for i, c in total.items()}, abs=2e-6)
