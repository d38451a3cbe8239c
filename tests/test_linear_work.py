"""Steps whose work must not grow with the square of a column or a group."""

import numpy as np

from tessella.model import Graph, Matrix
from tessella.operators import stats, testing, traversal


def test_backward_extrema_take_one_pass(spark):
    """A frame up to the last row is made anew for every row of a block."""
    p = np.random.default_rng(1).random(300) ** 3
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id long, p double")
    n, order = len(p), np.argsort(p)
    for f, factor in ((testing.hochberg, n - np.arange(n)), (testing.benjamini_hochberg, n / (np.arange(n) + 1))):
        d = f(df)
        assert "currentrow$(), unboundedfollowing$()" not in d._jdf.queryExecution().analyzed().toString()
        want = np.empty(n)
        want[order] = np.minimum(1, np.minimum.accumulate((p[order] * factor)[::-1])[::-1])
        got = {r.id: r.q for r in d.collect()}
        assert all(abs(got[i] - want[i]) < 1e-12 for i in range(n))


def test_kernel_means_by_cells(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 300, (200, 2)), rng.normal(40, 200, (200, 2))
    x[:20, 0] = 0
    make = lambda a: Matrix(spark.createDataFrame([(i, j, float(a[i, j])) for i in range(200) for j in range(2) if a[i, j]], "row long, col long, v double"), spark.range(200).withColumnRenamed("id", "row"), spark.range(2).withColumnRenamed("id", "col"))
    for gamma in (1e-4, 0.7):
        k = lambda a, b: np.exp(-gamma * (a[:, None] - b[None, :]) ** 2).mean()
        d = stats.mmd_rbf(make(x), make(y), gamma)
        assert "MapInArrow" in d._jdf.queryExecution().analyzed().toString() and "wa" not in d.columns
        for r in d.collect():
            a, b = x[:, r.col], y[:, r.col]
            assert abs(r.mmd - (k(a, a) + k(b, b) - 2 * k(a, b))) < 1e-13


def test_hops_of_all_nodes_by_wide_masks(spark, monkeypatch):
    """A row of state stands for 16 masks of targets; directed, over several groups."""
    a = np.random.default_rng(4).random((70, 70)) < 0.03
    np.fill_diagonal(a, False)
    g = Graph(spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))], "src long, dst long, w double"), spark.range(70))
    want = {}
    for s in range(70):
        seen, front, hop = {s}, {s}, 0
        while front:
            hop, front = hop + 1, {int(j) for i in front for j in np.flatnonzero(a[i])} - seen
            seen |= front
            if front:
                want[s, hop] = len(front)
    assert traversal.BITS * traversal.WORDS >= 1024
    for words, rows in ((16, 50_000_000), (1, 70)):
        monkeypatch.setattr(traversal, "WORDS", words)
        assert {(r.source, r.hop): r.n for r in traversal.hop_counts(g, rows=rows).collect()} == want


def test_poisson_draws_by_inversion(spark):
    """Draws are made in batches, not by a fold of 100 structs a cell; cells above a mean of 30 are rounded normals."""
    from tessella.operators.randomized import poisson_resample, uniform

    df = spark.createDataFrame([(i, j, float(1 + 9 * j)) for i in range(60) for j in range(4)], "row long, col long, v double")
    a = poisson_resample(Matrix.of(df), 1.5, 3).entries
    assert "MapInArrow" in a._jdf.queryExecution().analyzed().toString()
    got = {(r.row, r.col): r.v for r in a.collect()}
    for r in df.withColumn("u", uniform("row", "col", seed=3)).where("col < 3").collect():
        m = r.v * 1.5
        p, k = np.exp(-m), 0
        c = p
        while r.u >= c:
            k, p = k + 1, p * m / (k + 1)
            c += p
        assert got.get((r.row, r.col), 0.0) == k


def test_set_scores_are_not_exchanged(spark, monkeypatch):
    """Every row and every set has a score, which no shuffle follows (F6)."""
    from tessella.operators import signatures

    rng = np.random.default_rng(8)
    x, w = (rng.random((40, 12)) < 0.3) * rng.integers(1, 9, (40, 12)), (rng.random((7, 12)) < 0.4) * rng.random((7, 12))
    w[:, 0] += 0.5
    x[3] = 0
    a = Matrix(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, col long, v double"), spark.range(40).withColumnRenamed("id", "row"), spark.range(12).withColumnRenamed("id", "col"))
    sets = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "set_id long, col long, weight double")
    for block in (1 << 19, 9):
        monkeypatch.setattr(signatures, "_BLOCK", block)
        monkeypatch.setattr(signatures, "_PRODUCTS", 4 * block)
        d = signatures.weighted_score(a, sets)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("MapInArrow")[0] and "hashpartitioning" not in plan
        got = {(r.set_id, r.row): r.score for r in d.collect()}
        want = x @ w.T / w.sum(1)
        assert len(got) == 280 and all(abs(got[s, r] - want[r, s]) < 1e-12 for r in range(40) for s in range(7))


def test_steps_cut_as_often_as_they_read_the_state(spark, monkeypatch):
    """A step that reads its state again is cut each time, one that reads it once every few (F28 to F45)."""
    from pyspark.sql import functions as F

    from tessella.operators import graphs

    e = [(i, j, 1.0 + (i * j) % 3) for i in range(12) for j in ((i + 1) % 12, (i + 5) % 12)]
    g = Graph(spark.createDataFrame(e + [(j, i, w) for i, j, w in e], "src long, dst long, w double"), spark.range(12))
    calls = []

    def once(state, step, *a, every=None, **k):
        calls.append(every)
        return step(state)

    half = lambda c: g.nodes.select("id", (F.col("id") / 12).alias(c))
    monkeypatch.setattr(graphs, "iterate", once)
    plan = graphs.hits(g)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    calls.clear()
    graphs.katz_centrality(g)
    graphs.pagerank(g)
    graphs.label_spreading(g, g.nodes.where("id < 2").select("id", F.col("id").alias("label")))
    assert calls == [4, 4, 4]
    calls.clear()
    graphs.velocity_weighted_pseudotime(g, half("t"), half("v"))
    graphs.smooth_pseudotime(g, half("t"))
    graphs.dpt(g, 0)
    assert calls == [1, 1, 1]


def test_edges_of_the_queries_are_written_once(spark):
    from tessella.plans.inputs import Inputs

    for _ in range(2):
        g = Inputs(spark, "/root/testdata/sf0.001").graph
        plan = g.edges._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Relation") == 1
