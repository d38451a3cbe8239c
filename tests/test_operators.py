"""Operators on tiny inputs with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import special
from tessella.model import Graph, Matrix
from tessella.operators import communities, graphs, matrix, neighbors, optimise, partitions, randomized, spatial, testing

TINY = [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (2, 0, 4.0), (2, 1, 5.0), (2, 2, 6.0)]


@pytest.fixture(scope="module")
def tiny(spark):
    return Matrix(spark.createDataFrame(TINY, "row long, col long, v double"), spark.range(3).withColumnRenamed("id", "row"), spark.range(3).withColumnRenamed("id", "col"))


def graph(spark, pairs, n):
    e = [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]
    return Graph(spark.createDataFrame(e, "src long, dst long, w double"), spark.range(n))


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_products(spark, tiny):
    x = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "col long, x double")
    assert values(matrix.spmv(tiny, x), "row", "y") == {0: 7.0, 1: 6.0, 2: 32.0}
    assert values(matrix.diagonal(tiny), "row", "d") == {0: 1.0, 1: 3.0, 2: 6.0}
    assert {(r.row, r.other): r.dot for r in matrix.gram(tiny).collect()} == {(0, 0): 5.0, (1, 1): 9.0, (2, 2): 77.0, (0, 2): 16.0, (1, 2): 15.0}


def test_moments_with_implicit_zeros(tiny):
    d = np.zeros((3, 3))
    for i, j, v in TINY:
        d[i, j] = v
    got = {r.col: (r.mean, r["var"]) for r in matrix.col_moments(tiny).collect()}
    for j in range(3):
        assert got[j] == pytest.approx((d[:, j].mean(), d[:, j].var(ddof=1)))


def test_special_functions(spark):
    xs = [-2.5, -0.3, 0.0, 0.7, 1.9]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in d.select("x", special.erfc(F.col("x")).alias("e"), special.normal_cdf(F.col("x")).alias("c"), special.lgamma(F.abs("x") + 1).alias("g")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), abs=2e-7)
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=2e-7)
        assert r.g == pytest.approx(math.lgamma(abs(r.x) + 1), abs=1e-9)
    h = spark.range(1).select(special.hypergeom_sf(F.lit(3), F.lit(5), F.lit(6), F.lit(20)).alias("p")).first().p
    want = sum(math.comb(6, i) * math.comb(14, 5 - i) for i in range(3, 6)) / math.comb(20, 5)
    assert h == pytest.approx(want, rel=1e-9)


def test_corrections_with_ties(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.5, 0.5, 1.0, 0.0]
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    got = values(testing.benjamini_hochberg(df), "id", "q")
    assert [got[i] for i in order] == pytest.approx(np.minimum(q, 1).tolist())
    assert testing.benjamini_hochberg(df.limit(0)).count() == 0


def test_graph_traversal(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (5, 6, 2.0), (0, 2, 5.0)], 8)
    assert values(graphs.connected_components(g), "id", "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    assert values(graphs.bfs(g, [0]), "id", "hops") == {0: 0, 1: 1, 2: 1, 3: 2, 4: -1, 5: -1, 6: -1, 7: -1}
    d = values(graphs.shortest_paths(g, [0]), "id", "x")
    assert (d[2], d[3], d[4]) == (2.0, 3.0, 1e30)
    assert graphs.count_triangles(g).first().n == 1
    assert values(graphs.kcore(g), "id", "core") == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0}


def test_betweenness_of_a_path(spark):
    g = graph(spark, [(i, i + 1, 1.0) for i in range(4)], 5)
    assert values(graphs.betweenness_centrality(g, normalize=False), "id", "centrality") == {0: 0.0, 1: 3.0, 2: 4.0, 3: 3.0, 4: 0.0}


def test_pagerank_sums_to_one(spark):
    g = Graph(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (0, 3, 2.0)], "src long, dst long, w double"), spark.range(4))
    x = values(graphs.pagerank(g, tol=1e-8), "id", "x")
    assert sum(x.values()) == pytest.approx(1)
    m = np.zeros((4, 4))
    for a, b, w in [(0, 1, 1 / 3), (1, 2, 1), (2, 0, 1), (0, 3, 2 / 3)]:
        m[b, a] = w
    m[:, 3] = 0.25
    v = np.full(4, 0.25)
    for _ in range(200):
        v = 0.15 / 4 + 0.85 * m @ v
    assert [x[i] for i in range(4)] == pytest.approx(v.tolist(), abs=1e-6)


def test_knn_without_shared_columns(spark):
    rng = random.Random(1)
    e = [(i, j, float(rng.randint(1, 5))) for i in range(30) for j in range(12) if rng.random() < 0.15]
    a = Matrix(spark.createDataFrame(e, "row long, col long, v double"), spark.range(30).withColumnRenamed("id", "row"), spark.range(12).withColumnRenamed("id", "col"))
    d = np.zeros((30, 12))
    for i, j, v in e:
        d[i, j] = v
    got = {}
    for r in neighbors.knn(a, 4).collect():
        got.setdefault(r.row, {})[r["rank"]] = r.dist
    for i in range(30):
        want = sorted(np.linalg.norm(d[i] - d[k]) for k in range(30) if k != i)[:4]
        assert [got[i][k] for k in range(1, 5)] == pytest.approx(want)


def test_spatial_knn(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(size=(60, 2)), 20 + rng.normal(size=(5, 2))]))]
    got = {}
    for r in spatial.knn_weights(spark.createDataFrame(pts, "id long, x double, y double"), 6).collect():
        got.setdefault(r.src, []).append(r.dist)
    xy = np.array([p[1:] for p in pts])
    for i in range(len(pts)):
        d = np.sort(np.linalg.norm(xy - xy[i], axis=1))[1:7]
        assert sorted(got[i]) == pytest.approx(d.tolist())


def test_louvain_splits_cliques(spark):
    pairs = [(a + 5 * k, b + 5 * k, 1.0) for k in range(2) for a in range(5) for b in range(a)] + [(0, 5, 0.1)]
    g = graph(spark, pairs, 10)
    lab = values(communities.louvain(g, max_levels=2), "id", "label")
    assert len({lab[i] for i in range(5)}) == 1 and len({lab[i] for i in range(5, 10)}) == 1 and lab[0] != lab[5]
    q = partitions.modularity(g, spark.createDataFrame(list(lab.items()), "id long, label long")).first().q
    assert q > 0.4


def test_lasso_reaches_the_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    y = x @ np.array([2.0, 0.0, -1.0, 0.0]) + 0.01 * rng.normal(size=40)
    a = Matrix.of(spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(4)], "row long, col long, v double"))
    b = values(optimise.fista(a, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row long, y double"), 2.0, max_iter=60, tol=1e-7), "col", "b")
    w = np.zeros(4)
    for _ in range(500):
        for j in range(4):
            r = y - x @ w + x[:, j] * w[j]
            c = x[:, j] @ r
            w[j] = np.sign(c) * max(0, abs(c) - 2.0) / (x[:, j] @ x[:, j])
    assert [b[j] for j in range(4)] == pytest.approx(w.tolist(), abs=1e-4)


def test_samples(spark):
    ids = spark.range(1000)
    a = {r.id for r in randomized.uniform_sample(ids, 50, 1).collect()}
    assert len(a) == 50 and a == {r.id for r in randomized.uniform_sample(ids.repartition(7), 50, 1).collect()}
    w = ids.withColumn("w", F.when(F.col("id") < 10, 50.0).otherwise(0.1))
    hits = [r.id for r in randomized.importance_sample(w, 300, 3).collect()]
    assert len(hits) == 300 and sum(i < 10 for i in hits) > 200
