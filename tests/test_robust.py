"""Medians of all columns, biweight midcorrelation, and linkage, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def matrix(spark, x):
    from tessella.model import Matrix

    e = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return Matrix(spark.createDataFrame(e, "row long, col long, v double").repartition(3), spark.range(len(x)).withColumnRenamed("id", "row"), spark.range(x.shape[1]).withColumnRenamed("id", "col"))


def data(n=41, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 7)) * (rng.random((n, 7)) < 0.8)
    x[:, 1] = np.round(rng.normal(size=n) * 2)  # ties
    x[:, 2] *= 10.0 ** rng.integers(-200, 200, n)  # values far apart
    x[:, 3] = 0
    x[:, 4] = (rng.random(n) < 0.2) * 3.0  # the median is an implicit zero, and so is the deviation
    return x


@pytest.mark.parametrize(("n", "parts", "few"), [(41, 4, 3), (40, 256, 2048), (40, 2, 1)])
def test_column_medians(spark, n, parts, few):
    from tessella.operators.robust import column_medians

    x = data(n)
    med = np.median(x, axis=0)
    mad = 1.4826 * np.median(np.abs(x - med), axis=0)
    got = np.array([(r.median, r.mad) for r in column_medians(matrix(spark, x), parts, few).orderBy("col").collect()])
    assert np.allclose(got, np.stack([med, mad], 1), rtol=1e-12)


def plain_bicor(x, y):
    def terms(v):
        d = v - np.median(v)
        mad = 1.4826 * np.median(np.abs(d))
        u = d / (9 * mad) if mad >= 1e-15 else d
        return mad, np.where(np.abs(u) < 1, d * (1 - u * u) ** 2, 0)

    (m1, a), (m2, b) = terms(x), terms(y)
    if m1 < 1e-15 or m2 < 1e-15:
        return np.corrcoef(x, y)[0, 1] if x.std() and y.std() else 0.0
    return (a @ b) / np.sqrt((a @ a) * (b @ b))


def test_bicor(spark):
    from tessella.operators.signatures import correlation_matrix

    x = data()
    x[:, 2] = np.sign(x[:, 2])
    got = {(r.a, r.b): r.r for r in correlation_matrix(matrix(spark, x), "bicor").collect()}
    assert got.keys() == {(i, j) for i in range(7) for j in range(i + 1, 7)}
    for (i, j), r in got.items():
        assert abs(r - plain_bicor(x[:, i], x[:, j])) < 1e-9, (i, j)


def one_at_a_time(d):
    d, size, out = d.copy(), np.ones(len(d)), []
    np.fill_diagonal(d, np.inf)
    while np.isfinite(d).any():
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        out.append((i, j, d[i, j]))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        size[i] += size[j]
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
    return out


def pairs(spark, d):
    return spark.createDataFrame([(int(i), int(j), float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d)) if np.isfinite(d[i, j])], "a long, b long, d double").repartition(3)


@pytest.mark.parametrize(("n", "tail", "holes"), [(60, 2, False), (60, 2, True), (500, 120, False), (60, 1000, True)])
def test_linkage_equals_one_at_a_time(spark, n, tail, holes):
    from tessella.operators.linkage import hierarchical

    rng = np.random.default_rng(n + holes)
    x = rng.normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if holes:
        d[np.triu(rng.random((n, n)) < 0.1)] = np.inf
        d = np.maximum(d, d.T)
    want = sorted(one_at_a_time(d), key=lambda m: m[2])
    got = [(r.a, r.b, r.height) for r in hierarchical(pairs(spark, d), tail).orderBy("step").collect()]
    assert [m[:2] for m in got] == [m[:2] for m in want]
    assert np.allclose([m[2] for m in got], [m[2] for m in want])


def test_blockwise_modules(spark):
    from tessella.operators.linkage import blockwise_modules

    rng = np.random.default_rng(7)
    base = rng.normal(size=(80, 4))
    x = np.concatenate([base[:, [k]] + 0.2 * rng.normal(size=(80, 4)) for k in range(4)] + [rng.normal(size=(80, 2))], 1)
    got = {r.id: r.module for r in blockwise_modules(matrix(spark, x), 9, 2.0, 0.6, 3, tail=2).collect()}
    # Columns 0-3 and 4-7 are alike, and in the second block 9-11 (8 stands alone in the first) and 12-15.
    assert [got[i] for i in range(18)] == [1] * 4 + [2] * 4 + [0] + [3] * 3 + [4] * 4 + [0, 0]
    whole = {r.id: r.module for r in blockwise_modules(matrix(spark, x), 100, 2.0, 0.6, 3).collect()}
    assert [whole[i] for i in range(18)] == [1] * 4 + [2] * 4 + [3] * 4 + [4] * 4 + [0, 0]
    assert blockwise_modules(matrix(spark, np.zeros((3, 2))), 5).where(F.col("module") > 0).isEmpty()
