"""Block-wise neighbours and spectral operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("size", [16, 4096])
def test_block_knn_is_exact(spark, size):
    from tessella.operators.blocks import block_knn, rows_of_vectors

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 5)), np.zeros((2, 5)), rng.normal(size=(40, 5)) * 10])
    x = np.concatenate([x, x[:7]])  # copies: ties are broken by id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), np.round(d[i], 12)))[:4])}
    got = block_knn(rows_of_vectors(df), None, 4, size=size).collect()
    assert {(r.row, r.nbr, r["rank"]) for r in got} == want
    assert all(abs(r.dist - d[r.row, r.nbr]) < 1e-9 for r in got)
    assert block_knn(rows_of_vectors(df.limit(0)), None, 4, size=size).count() == 0


@pytest.mark.parametrize("size", [8, 4096])
def test_sparse_cross_neighbours(spark, size):
    from tessella.model import Matrix
    from tessella.operators.blocks import block_knn, rows_of

    rng = np.random.default_rng(2)
    a, b = ((rng.random((n, 30)) < 0.1) * rng.integers(1, 5, (n, 30)) for n in (25, 40))

    def matrix(m):
        e = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
        return Matrix(spark.createDataFrame(e, "row long, col long, v double"), spark.range(len(m)).withColumnRenamed("id", "row"), spark.range(30).withColumnRenamed("id", "col"))

    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    groups = spark.range(40).select(F.col("id").alias("row"), (F.col("id") % 3).alias("grp"))
    got = {(r.row, r.nbr, r["rank"], r.grp) for r in block_knn(rows_of(matrix(a)), rows_of(matrix(b), groups), 2, grouped=True, size=size).collect()}
    want = set()
    for i in range(25):
        for g in range(3):
            mine = np.arange(g, 40, 3)
            want |= {(i, int(j), r + 1, g) for r, j in enumerate(mine[np.lexsort((mine, d[i, mine]))][:2])}
    assert got == want


@pytest.mark.parametrize("metric", ["manhattan", "cosine", "correlation", "euclidean"])
@pytest.mark.parametrize("size", [16, 4096])
def test_metrics_and_both_sides(spark, metric, size):
    """Observed rows against simulated ones and each other, as sparse rows with implicit zeros."""
    from tessella.model import Matrix
    from tessella.operators.blocks import block_knn, rows_of

    rng = np.random.default_rng(4)
    x = (rng.random((70, 20)) < 0.3) * rng.integers(1, 6, (70, 20)).astype(float)
    x[3], x[4], x[60] = 0, 2.0, 0  # without a direction: zero, and constant for the correlation
    x[5] = x[6]
    y = x - x.mean(1, keepdims=True) if metric == "correlation" else x
    if metric == "euclidean":
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    elif metric == "manhattan":
        d = np.abs(x[:, None] - x[None]).sum(2)
    else:
        norm = np.sqrt((y * y).sum(1))
        u = np.divide(y, norm[:, None], out=np.zeros_like(y), where=norm[:, None] > 1e-9)
        d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)

    def rows(lo, hi):
        e = [(int(i) + lo, int(j), float(x[i + lo, j])) for i, j in zip(*np.nonzero(x[lo:hi]))]
        m = Matrix(spark.createDataFrame(e, "row long, col long, v double"), spark.range(lo, hi).withColumnRenamed("id", "row"), spark.range(20).withColumnRenamed("id", "col"))
        return rows_of(m)

    got = block_knn(rows(0, 50), rows(50, 70), 5, size=size, metric=metric, both=True, n_cols=20).collect()
    want = {(i, int(j), r + 1) for i in range(50) for r, j in enumerate(np.lexsort((np.arange(70), np.round(d[i], 10)))[:5])}
    assert {(r.row, r.nbr, r["rank"]) for r in got} == want
    assert all(abs(r.dist - d[r.row, r.nbr]) < 1e-9 for r in got)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_far_blocks_are_not_searched(spark, metric):
    from tessella.operators.blocks import block_knn, block_pairs, row_blocks, rows_of_vectors

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6)) * 10
    x = np.concatenate([c + rng.normal(size=(50, 6)) * 0.2 for c in centres])
    df = rows_of_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(2))
    blocks = row_blocks(df, None, 3, size=10, metric=metric)
    n = blocks.count()
    assert block_pairs(blocks).count() < n * n / 2
    whole = block_knn(df, None, 3, size=4096, metric=metric).select("row", "nbr", "rank")
    assert whole.exceptAll(block_knn(df, None, 3, size=10, metric=metric).select("row", "nbr", "rank")).isEmpty()


def test_orthogonal_iteration_finds_eigenvectors(spark):
    from tessella.model import Graph
    from tessella.operators.spectral import low_rank_impute, orthogonal_iteration
    from tessella.model import Matrix

    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    m = u @ np.diag([9, 5, 3, *np.linspace(0.5, 0, 9)]) @ u.T
    e = [(i, j, float(m[i, j])) for i in range(12) for j in range(12)]
    g = Graph(spark.createDataFrame(e, "src long, dst long, w double"), spark.range(12))
    x, values = orthogonal_iteration(g, 3, 12)
    assert np.allclose(values, [9, 5, 3], atol=1e-4)
    got = np.array([r[1:] for r in x.orderBy("id").collect()])
    assert np.allclose(np.abs((got * u[:, :3]).sum(0)), 1, atol=1e-3)
    low = np.abs(rng.normal(size=(10, 2)) @ rng.normal(size=(2, 6)))
    low[rng.random((10, 6)) < 0.2] = 0
    a = Matrix(spark.createDataFrame([(i, j, float(low[i, j])) for i, j in zip(*map(lambda z: z.tolist(), np.nonzero(low)))], "row long, col long, v double"), spark.range(10).withColumnRenamed("id", "row"), spark.range(6).withColumnRenamed("id", "col"))
    s, d, vt = np.linalg.svd(low, full_matrices=False)
    fit = np.where(low != 0, low, np.maximum(0, s[:, :2] * d[:2] @ vt[:2]))
    got = {(r.row, r.col): r.v for r in low_rank_impute(a, 2, 25).collect()}
    assert all(abs(got.get((i, j), 0.0) - fit[i, j]) < 1e-3 for i in range(10) for j in range(6))


def test_only_the_nearest_leave_a_task(spark):
    """With many blocks and a large k no pair of blocks sends its own k nearest on (F9)."""
    from tessella.operators.blocks import _search, block_knn, meetings, row_blocks, rows_of_vectors

    x = np.random.default_rng(6).normal(size=(300, 4))
    df = rows_of_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3))
    blocks = row_blocks(df, None, 40, size=20)
    left = meetings(blocks, 40).mapInArrow(_search(40, True, "euclidean"), "row long, nbr long, dist double, rank int, grp long")
    assert left.count() == 300 * 40
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = block_knn(df, None, 40, size=20).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr"))).alias("n")).collect()
    assert all([n["nbr"] for n in r["n"]] == np.argsort(d[r["row"]])[:40].tolist() for r in got) and len(got) == 300


def test_manhattan_filter_never_drops_a_near_row():
    """Products of filled cells stay on the near side of the distance, and most far pairs beyond it (F27)."""
    from tessella.operators.blocks import _Block, _Pair

    rng = np.random.default_rng(7)
    x, z = (np.where(rng.random((200, 64)) < 0.5, 0, rng.standard_normal((200, 64)) * s) for s in (1.0, 1.5))
    x[0], z[0], x[1] = 0, 0, 1e3
    block = lambda v: _Block(np.arange(len(v)), np.full(len(v), 64, np.int32), np.tile(np.arange(64), len(v)), v.ravel(), np.zeros(len(v), np.int64), np.zeros(len(v)))
    pair, rows = _Pair(block(x), block(z), "manhattan"), np.arange(200)
    pair.filter(rows)
    d = np.abs(x[:, None] - z[None]).sum(2)
    near = pair.left @ pair.right
    for q in (0, 1, 10, 100):
        bound = np.partition(d, q, axis=1)[:, q]
        passed = near >= pair.least(rows, bound)[:, None].astype(near.dtype)
        assert passed[d <= bound[:, None]].all()
    assert pair.left.dtype == np.float32


def test_manhattan_steps_pass_few_far_rows():
    """Counted steps keep every near pair, on either side of the other block's range, and nearly none beyond (F27)."""
    from tessella.operators.blocks import _Best, _Block, _Pair, nearest

    rng = np.random.default_rng(8)
    x, z = rng.standard_normal((300, 64)), rng.standard_normal((300, 64)) * 1.2
    z[0], z[1], z[2], z[3, 5] = 0, 1e12, x[7], np.nan
    block = lambda v, at: _Block(np.arange(at, at + len(v)), np.full(len(v), 64, np.int32), np.tile(np.arange(64), len(v)), v.ravel(), np.zeros(len(v), np.int64), np.zeros(len(v)))
    pair, rows = _Pair(block(x, 0), block(z, 1000), "manhattan"), np.arange(300)
    assert pair.count(rows)
    d = np.abs(x[:, None] - z[None]).sum(2)
    far = np.nan_to_num(d, nan=np.inf)
    for q in (0, 1, 10, 100):
        bound = np.partition(far, q, axis=1)[:, q]
        passed = pair.within(pair.steps(rows), bound, 5)
        assert passed[far <= bound[:, None]].all() and not passed[:, 1].any()
        assert (passed & (far > bound[:, None] * 1.05)).mean() < 0.01
    open_ = pair.within(pair.steps(rows), np.full(300, np.inf), 5)
    assert open_[far <= np.partition(far, 4, axis=1)[:, 4, None]].all() and open_.mean() < 0.2
    # Blocks that meet themselves, and columns that the asking rows do not have.
    for a, b in ((block(x, 0), block(x, 0)), (block(x[:, :64] * (np.arange(64) < 9), 0), block(z[4:], 1000))):
        best: dict[int, _Best] = {}
        nearest(a, b, 5, True, "manhattan", best)
        own = np.abs(a.dense(np.arange(64))[:, None] - b.dense(np.arange(64))[None]).sum(2)
        own[a.ids[:, None] == b.ids] = np.inf
        r, ids, dist, _ = best[0].settle()
        assert np.array_equal(ids.reshape(-1, 5), b.ids[np.argsort(own, axis=1)[:, :5]]) and np.allclose(dist, np.sort(own, axis=1)[:, :5].ravel())


def test_single_values_travel_as_such():
    """Values that are exact in single precision take four bytes, others eight; both come back as they were (F31, F43)."""
    import pyarrow as pa

    from tessella.operators.blocks import _KINDS, _Block

    for v, width in ((np.array([0.5, -3.25, 1e-3, 7], np.float32).astype(float), 4), (np.array([0.1, 2, 3, 4]), 8), (np.array([1e150, 2, 3, 4]), 8)):
        n = len(v) // 2
        b = _Block(np.arange(n), np.full(n, 2, np.int32), np.array([0, 300] * n, np.int64), v, np.zeros(n, np.int64), np.zeros(n), far=np.zeros((n, 3)))
        got = _Block.read(pa.RecordBatch.from_arrays([pa.array([b.cell(c)], pa.binary()) for c in _KINDS], names=list(_KINDS)), 0)
        assert len(b.cell("vals")) == width * len(v)
        assert got.vals.dtype == np.float64 and np.array_equal(got.vals, v) and np.array_equal(got.cols, b.cols) and np.array_equal(got.sizes, b.sizes)
