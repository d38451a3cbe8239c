"""Pairs of columns in blocks, and triangles by colours, against numpy."""

import itertools

import numpy as np
import pytest

from tessella.model import Graph, Matrix
from tessella.operators import graphs as G
from tessella.operators import matrix as M
from tessella.operators import signatures as S


@pytest.fixture()
def dense():
    x = np.random.default_rng(3).poisson(0.4, (40, 23)).astype(float)
    x[:, 5] = 0
    return x


def matrix(spark, x):
    e = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, col long, v double")
    return Matrix(e, spark.range(x.shape[0]).withColumnRenamed("id", "row"), spark.range(x.shape[1]).withColumnRenamed("id", "col"))


def expected(x):
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.corrcoef(x.T))


def test_pairs_of_many_blocks(spark, dense, monkeypatch):
    monkeypatch.setattr(M, "PAIR_BLOCK", 4)
    r = expected(dense)
    pairs = list(itertools.combinations(range(23), 2))
    got = {(p.row, p.other): p.r for p in M.pearson(matrix(spark, dense).T).collect()}
    assert sorted(got) == pairs and all(abs(got[p] - r[p]) < 1e-12 for p in pairs)
    assert {(p.a, p.b) for p in S.correlation_network(matrix(spark, dense), 0.1).collect()} == {p for p in pairs if abs(r[p]) >= 0.1}
    chosen = spark.createDataFrame([(2,), (7,)], "col long")
    some = {(p.tf, p.target): p.score for p in S.tf_target_scores(matrix(spark, dense), chosen).collect()}
    assert set(some) == {(t, o) for t in (2, 7) for o in range(23) if o != t} and all(abs(v - r[p]) < 1e-12 for p, v in some.items())


def test_pairs_are_not_exchanged(spark, dense):
    """No exchange or join above the blocks carries a row for every pair."""
    for d in (M.pearson(matrix(spark, dense).T), S.correlation_matrix(matrix(spark, dense)), S.tf_target_scores(matrix(spark, dense), matrix(spark, dense).cols)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        above = plan.split("FlatMapCoGroupsInArrow")[0]
        assert "FlatMapCoGroupsInArrow" in plan and "Exchange hash" not in above and "SortMergeJoin" not in above


@pytest.mark.parametrize("edges", [1_500_000, 40])
def test_triangles_of_colours(spark, monkeypatch, edges):
    monkeypatch.setattr(G, "TRIANGLE_EDGES", edges)
    monkeypatch.setattr(G, "TRIANGLE_WEDGES", 16)
    a = np.triu(np.random.default_rng(5).random((30, 30)) < 0.3, 1)
    g = Graph.of(spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))], "src long, dst long, w double"))
    s = (a | a.T).astype(int)
    t = np.diag(s @ s @ s) // 2
    assert {r.id: r.t for r in G.triangle_counts(g).collect()} == {i: v for i, v in enumerate(t) if v}


def test_equal_connectivity_ranks_by_id(spark):
    """Sums that differ in their last bits only are a tie."""
    adj = spark.createDataFrame([(1, 2, 0.1), (3, 4, 0.1 + 2e-17), (5, 6, 0.1 + 1e-15)], "a long, b long, w double")
    mods = spark.createDataFrame([(i, 0) for i in range(1, 7)], "id long, module int")
    assert [r.id for r in S.hub_genes(adj, mods, 4).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_diffusion_distances_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIR_BLOCK", 4)
    t = np.random.default_rng(8).random((15, 15)) * (np.random.default_rng(9).random((15, 15)) < 0.3)
    np.fill_diagonal(t, 0.1)
    g = Graph.of(spark.createDataFrame([(int(i), int(j), float(t[i, j])) for i, j in zip(*np.nonzero(t))], "src long, dst long, w double"))
    d = G.diffusion_distance(g, 2)
    assert "FlatMapCoGroupsInArrow" in d._jdf.queryExecution().executedPlan().toString()
    two = t @ t
    got = {(r.a, r.b): r.dist for r in d.collect()}
    assert sorted(got) == list(itertools.combinations(range(15), 2)) and all(abs(v - np.linalg.norm(two[a] - two[b])) < 1e-9 for (a, b), v in got.items())
