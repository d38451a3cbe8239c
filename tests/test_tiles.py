"""Kernel sums by tiles against numpy: no product of two points' entries is exchanged."""

import numpy as np
import pytest

from tessella.model import Matrix
from tessella.operators import spatial as S


@pytest.mark.parametrize("tile", [2048, 3])
def test_kernel_sums_of_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(6)
    n = 60
    p, x = rng.uniform(-1, 1, (n, 2)), rng.normal(0, 1, (n, 5)) * (rng.random((n, 5)) < 0.4)
    points = spark.createDataFrame([(i, float(p[i, 0]), float(p[i, 1])) for i in range(n)], "id long, x double, y double")
    a = Matrix(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, col long, v double"), spark.range(n).withColumnRenamed("id", "row"), spark.range(5).withColumnRenamed("id", "col"))
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    w = np.where((d2 <= 0.16) & ~np.eye(n, dtype=bool), np.exp(-d2 / 0.02), 0)
    z = x - x.mean(0)
    d = S.spatial_autocorrelation(points, a, 0.1)
    for r in d.collect():
        c = z[:, r.col]
        assert abs(r.i - n * (w * np.outer(c, c)).sum() / (w.sum() * (c @ c))) < 1e-9
        assert abs(r.c - (n - 1) * (w * (c[:, None] - c[None]) ** 2).sum() / (2 * w.sum() * (c @ c))) < 1e-9
    got = {(r.row, r.col): r.v for r in S.spatial_smoothing(points, a, 0.1).collect()}
    want = {(i, j): (w @ x)[i, j] / w[i].sum() for i in range(n) for j in range(5) if (w[i] * (x[:, j] != 0)).any()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
