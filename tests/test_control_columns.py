"""Control columns by counting places, against the bins."""

import numpy as np

from tessella.model import Matrix
from tessella.operators import signatures as S


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def small(spark, x):
    e = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, col long, v double")
    return Matrix(e, spark.range(x.shape[0]).withColumnRenamed("id", "row"), spark.range(x.shape[1]).withColumnRenamed("id", "col"))


def test_control_columns_are_drawn_without_listing_candidates(spark):
    x = np.random.default_rng(2).poisson(0.8, (30, 24)).astype(float)
    sets = [(s, c) for s in range(3) for c in range(24) if c % 3 == s or c in (1, 2)]
    a, d = small(spark, x), spark.createDataFrame(sets, "set_id long, col long")
    bins = {r.col: r.bin for r in S.equal_width_bins(a, 3).collect()}
    got = [(r.set_id, r.col) for r in S.control_columns(a, d, 2, 3).collect()]
    for s in range(3):
        members = {c for t, c in sets if t == s}
        want = [b for c in members for b in [bins[c]] for _ in range(min(2, sum(bins[o] == b for o in bins if o not in members)))]
        mine = [c for t, c in got if t == s]
        assert not members & set(mine) and sorted(bins[c] for c in mine) == sorted(want)
    assert "LeftAnti" not in plan(S.control_columns(a, d, 2, 3))  # candidates are not listed and dropped
    ctl = {s: [c for t, c in ((r.set_id, r.col) for r in S.control_columns(a, d, 1, 3).collect()) if t == s] for s in range(3)}
    for r in S.module_score(a, d, 1, 3).collect():
        own = [c for t, c in sets if t == r.set_id]
        assert abs(r.score - (x[r.row, own].mean() - (x[r.row, ctl[r.set_id]].mean() if ctl[r.set_id] else 0.0))) < 1e-12
