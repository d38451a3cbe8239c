"""Keyed permutations, tests with any statistic, set scores on members only."""

import itertools

import numpy as np
import pytest


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutations_are_bijections(n):
    from tessella.operators.permute import permuted

    seen = {tuple(permuted(np.arange(n), n, k).tolist()) for k in range(20)}
    assert all(sorted(p) == list(range(n)) for p in seen)
    assert len(seen) == 20 or n < 5


def test_permutations_are_even():
    from tessella.operators.permute import permuted

    where = np.bincount([int(permuted(np.array([3]), 10, k)[0]) for k in range(4000)], minlength=10)
    assert np.abs(where - 400).max() < 5 * np.sqrt(400)


@pytest.mark.parametrize("side", ["two_sided", "greater", "less"])
def test_any_statistic(spark, side):
    from tessella.model import Matrix
    from tessella.operators.permute import _key, ks_statistic, median_difference, permutation_test, permuted

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5)) * (rng.random((40, 5)) < 0.7)
    x[:, 4] = 0
    x[20:, 1] += 2
    grp = np.where(np.arange(40) % 3 == 0, 1, 0)
    e = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    a = Matrix(spark.createDataFrame(e, "row long, col long, v double").repartition(3), spark.range(40).withColumnRenamed("id", "row"), spark.range(5).withColumnRenamed("id", "col"))
    groups = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grp)], "row long, grp long")
    order = np.concatenate([np.flatnonzero(grp == 0), np.flatnonzero(grp == 1)])  # the rows' places
    n0 = int((grp == 0).sum())

    def split(v, label):
        return [s for g in (0, 1) for s in (v[(label == g) & (v != 0)], int(((label == g) & (v == 0)).sum()))]

    for f, plain in ((median_difference, lambda p, q: np.median(q) - np.median(p)), (ks_statistic, lambda p, q: max(abs((p <= t).mean() - (q <= t).mean()) for t in [*p, *q]))):
        got = {r.col: r for r in permutation_test(a, groups, f, 100, 9, side).collect()}
        assert got.keys() == set(range(5))
        for j in range(5):
            v = x[order, j]
            label = (np.arange(40) >= n0).astype(int)
            seen = plain(v[label == 0], v[label == 1])
            assert abs(f(*split(v, label)) - seen) < 1e-12 and abs(got[j].stat - seen) < 1e-12
            drawn = []
            for k in range(100):
                to = permuted(np.arange(40), 40, _key(9, k)) >= n0
                drawn.append(plain(v[~to], v[to]))
            d = np.array(drawn)
            hits = {"two_sided": np.abs(d) >= abs(seen) - 1e-12, "greater": d >= seen - 1e-12, "less": d <= seen + 1e-12}[side].sum()
            assert abs(got[j].p - (hits + 1) / 101) < 1e-12


def test_peaks_equal_the_running_sum(spark):
    """Every set of up to seven ranks, against the sum over all ranks; ties take the first."""
    from tessella.operators.signatures import enrichment_score

    score = [4.0, 3.0, 2.0, 0.0, -1.0, -2.0, -2.5]
    sets = [s for k in range(1, 8) for s in itertools.combinations(range(7), k)]
    ranked = spark.createDataFrame([(i, i + 1, v) for i, v in enumerate(score)], "col long, rank long, score double")
    members = spark.createDataFrame([(i, c) for i, s in enumerate(sets) for c in s], "set_id long, col long")
    for weighted in (False, True):
        got = {r.set_id: (r.es, r.peak) for r in enrichment_score(ranked, members, weighted).collect()}
        for i, s in enumerate(sets):
            w = [abs(score[c]) if weighted else 1.0 for c in s]
            total, run, best = sum(w), 0.0, (-1.0, 0, 0.0)
            for c in range(7):
                run += (w[s.index(c)] / total if total else 0.0) if c in s else -1 / (7 - len(s))
                if round(abs(run), 9) > best[0]:
                    best = (round(abs(run), 9), c + 1, run)
            assert abs(got[i][0] - best[2]) < 1e-9 and (got[i][1] == best[1] or best[0] == 0), (s, weighted)
