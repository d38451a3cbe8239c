"""Doublet scores against numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def drawn(d, seed):
    return int(hashlib.md5(f"{d}|{seed}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def pairs(n, m, seed):
    out = []
    for d in range(n):
        p, q = math.floor(drawn(d, seed + 1) * m), math.floor(drawn(d, seed + 2) * (m - 1))
        out.append((p, q + (q >= p)))
    return out


def matrix(spark, x, ids):
    from tessella.model import Matrix

    e = [(int(ids[i]), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return Matrix(spark.createDataFrame(e, "row long, col long, v double"), spark.createDataFrame([(int(i),) for i in ids], "row long"), spark.range(x.shape[1]).withColumnRenamed("id", "col"))


@pytest.mark.parametrize("n", [None, 17])
def test_scrublet_scores(spark, n):
    from tessella.operators.doublets import scrublet_scores, simulate_doublets

    rng = np.random.default_rng(1)
    x = (rng.random((40, 12)) < 0.4) * rng.integers(1, 7, (40, 12)).astype(float)
    ids = np.sort(rng.choice(1000, 40, replace=False))
    x[5] = 0  # a row without entries
    a = matrix(spark, x, ids)
    sim = np.array([(x[p] + x[q]) / 2 for p, q in pairs(n or 80, 40, 3)])
    got = {(r.row, r.col): r.v for r in simulate_doublets(a, len(sim), 3).collect()}
    assert got == {(-1 - i, j): sim[i, j] for i, j in zip(*map(np.ndarray.tolist, np.nonzero(sim)))}
    every = np.concatenate([x, sim])
    d = np.sqrt(((x[:, None] - every[None]) ** 2).sum(2))
    d[np.arange(40), np.arange(40)] = np.inf
    order = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :6]
    want = {int(ids[i]): (order[i] >= 40).mean() for i in range(40)}
    out = {r.row: r.score for r in scrublet_scores(a, n, 6, 3).collect()}
    assert out.keys() == want.keys() and all(abs(out[i] - want[i]) < 1e-12 for i in want)


def test_pann_uses_the_share_of_all_rows(spark):
    from tessella.operators.doublets import pann_scores, simulate_vectors

    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    sim = simulate_vectors(v, 20, 1)
    s = np.array([(x[p] + x[q]) / 2 for p, q in pairs(20, 30, 1)])
    assert np.allclose([r.x for r in sim.orderBy(F.desc("id")).collect()], s)
    d = np.sqrt(((x[:, None] - np.concatenate([x, s])[None]) ** 2).sum(2))
    d[np.arange(30), np.arange(30)] = np.inf
    k = math.ceil(0.1 * 50)
    want = (np.argsort(d, axis=1)[:, :k] >= 30).mean(1)
    assert np.allclose([r.score for r in pann_scores(v, sim, 0.1).orderBy("row").collect()], want)
