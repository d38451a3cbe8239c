"""Enrichment by rows without a row for every cell, against the running sum."""

import numpy as np
import pytest

from tessella.model import Matrix
from tessella.operators import signatures as S


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def small(spark, x):
    e = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, col long, v double")
    return Matrix(e, spark.range(x.shape[0]).withColumnRenamed("id", "row"), spark.range(x.shape[1]).withColumnRenamed("id", "col"))


@pytest.mark.parametrize("exponent", [0.0, 0.25])
def test_ssgsea_ranks_no_cell(spark, exponent):
    x = np.random.default_rng(4).poisson(0.5, (12, 20)).astype(float) - (np.random.default_rng(5).random((12, 20)) < 0.1)
    x[3] = 0
    sets = {s: [c for c in range(20) if c % 4 == s] for s in range(4)} | {4: list(range(20)), 5: [7]}
    d = S.ssgsea(small(spark, x), spark.createDataFrame([(s, c) for s in sets for c in sets[s]], "set_id long, col long"), exponent)
    got = {(r.row, r.set_id): r.es for r in d.collect()}
    assert len(got) == 12 * 6 and "Window" not in plan(d) and "row_number" not in plan(d)
    for i in range(12):
        order = sorted(range(20), key=lambda c: (-x[i, c], c))
        for s, members in sets.items():
            h = {c: (20 - k) ** exponent for k, c in enumerate(order)}
            t, miss, run, best = sum(h[c] for c in members), 20 - len(members), 0.0, 0.0
            for c in order:
                run += h[c] / t if c in members else -1 / miss
                best = run if round(abs(run), 9) > round(abs(best), 9) else best
            assert abs(got[i, s] - best) < 1e-9, (i, s)
