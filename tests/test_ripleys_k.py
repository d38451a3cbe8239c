"""Pairs of points are counted where chunks meet, against all pairs."""

import itertools

import numpy as np
import pytest

from tessella.operators import spatial


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_ripleys_k_makes_no_row_for_a_pair(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_CHUNK", 8)
    x = np.random.default_rng(1).normal(size=(90, 2))
    x[:5] = x[5]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(99, float("nan"), 0.0)], "id long, x double, y double")
    d = spatial.ripleys_k(points, [0.2, 0.7, 1.5], 10.0)
    apart = [float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for i, j in itertools.combinations(range(90), 2)]
    assert {r.radius: r.k for r in d.collect()} == pytest.approx({t: 2 * sum(a <= t for a in apart) * 10.0 / 91**2 for t in (0.2, 0.7, 1.5)})
    assert "MapInArrow" in plan(d)
