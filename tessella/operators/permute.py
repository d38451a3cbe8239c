"""Keyed permutations of places, computed where they are needed, and tests with any statistic.

A permutation of 0 .. n-1 is a small Feistel network on the places' bits, repeated while
it leaves the range. It is a bijection, so permuted labels keep their sizes and drawn
places are distinct, and each place is found by itself: labels are never dealt by sorting
all rows once a permutation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Matrix
from .testing import positions

_ROUNDS = 6
#: Permutations of a column that one task does.
SLICE = 64
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A scramble of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def permuted(place: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a permutation of 0 .. n-1, named by ``key``, takes the places."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = _mixed(_mixed(np.array([key & ((1 << 64) - 1)], _U)) ^ np.arange(1, _ROUNDS + 1, dtype=_U))
    out, live = np.asarray(place).astype(_U), np.arange(len(place))
    while len(live):
        x = out[live]
        left, right = x >> _U(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[live] = (left << _U(half)) | right
        live = live[out[live] >= n]
    return out.astype(np.int64)


def _key(seed: int, perm: int) -> int:
    return (seed << 32) ^ (perm + 1)


def drawn_places(sizes: DataFrame, n: int, n_perm: int, seed: int = 0) -> DataFrame:
    """``set_id, perm, place``: for each set (``set_id, m``) and permutation m distinct places of n."""

    def run(batches):
        for pdf in batches:
            for s, p, m in zip(pdf.set_id, pdf.perm, pdf.m, strict=True):
                yield pd.DataFrame({"set_id": s, "perm": p, "place": permuted(np.arange(min(m, n)), n, _key(seed + int(s) * 7919, int(p)))})

    perms = sizes.select("set_id", "m", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    return perms.mapInPandas(run, f"set_id {sizes.schema['set_id'].dataType.simpleString()}, perm long, place long")


#: A statistic of two samples, each as its stored values and the number of zeros beside them.
Statistic = Callable[[np.ndarray, int, np.ndarray, int], float]


def _sorted_cdf(v: np.ndarray, zeros: int, at: np.ndarray) -> np.ndarray:
    v = np.sort(v)
    return (np.searchsorted(v, at, "right") + zeros * (at >= 0)) / max(len(v) + zeros, 1)


def ks_statistic(x: np.ndarray, zx: int, y: np.ndarray, zy: int) -> float:
    """The largest distance of the two distribution functions."""
    at = np.unique(np.concatenate([x, y, [0.0]]))
    return float(np.abs(_sorted_cdf(x, zx, at) - _sorted_cdf(y, zy, at)).max())


def _median(v: np.ndarray, zeros: int) -> float:
    v, n = np.sort(v), len(v) + zeros
    below = int((v < 0).sum())
    at = lambda r: v[r] if r < below else 0.0 if r < below + zeros else v[r - zeros]
    return float((at((n - 1) // 2) + at(n // 2)) / 2) if n else 0.0


def median_difference(x: np.ndarray, zx: int, y: np.ndarray, zy: int) -> float:
    return _median(y, zy) - _median(x, zx)


def permutation_test(a: Matrix, groups: DataFrame, statistic: Statistic, n_perm: int = 100, seed: int = 0, side: str = "two_sided") -> DataFrame:
    """``col, stat, p`` of any ``statistic`` of a column's values in group 0 and group 1 of ``row, grp``.

    A task has the stored entries of one column and a slice of the permutations; rows are known by
    their place, of which a permutation says the group, so no label travels. Group 0 has the first
    places. p counts permuted statistics as large (``greater``), as small (``less``) or as far from 0."""
    if side not in ("two_sided", "greater", "less"):
        raise ValueError("side must be two_sided, greater or less")
    rows = groups.where(F.col("grp").isin(0, 1)).select("row", "grp")
    key = rows.select(F.struct(F.col("grp"), F.col("row")).alias("k"), "row", "grp")
    n0, n1 = (key.where(F.col("grp") == g).count() for g in (0, 1))
    # Places in the order of (group, row): of each group by range, group 1 behind group 0.
    place = positions(rows.where("grp = 0").select(F.col("row").alias("id"))).unionByName(positions(rows.where("grp = 1").select(F.col("row").alias("id"))).withColumn("pos", F.col("pos") + n0))
    e = a.entries.join(place.select(F.col("id").alias("row"), "pos"), "row").select("col", "pos", F.col("v").cast("double").alias("v"))
    sizes = a.over_cols(e.groupBy("col").agg(F.count(F.lit(1)).alias("k"))).select("col", F.coalesce("k", F.lit(0)).alias("k"))
    slices = F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_perm - 1) // SLICE)))).alias("slice")
    every = sizes.where("k = 0").select("col", F.lit(-1).cast("long").alias("pos"), F.lit(0.0).alias("v")).unionByName(e)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.pos >= 0]
        pos, v, first = own.pos.to_numpy(), own.v.to_numpy(), int(pdf.slice.iloc[0]) * SLICE

        def value(at: np.ndarray) -> float:
            one = at >= n0
            return float(statistic(v[~one], n0 - int((~one).sum()), v[one], n1 - int(one.sum())))

        seen = value(pos)
        found = [value(permuted(pos, n0 + n1, _key(seed, p))) for p in range(first, min(first + SLICE, n_perm))]
        x, tol = np.array(found), 1e-12
        hits = {"two_sided": np.abs(x) >= abs(seen) - tol, "greater": x >= seen - tol, "less": x <= seen + tol}[side]
        return pd.DataFrame({"col": [pdf.col.iloc[0]], "stat": [seen], "x": [int(hits.sum())]})

    part = every.select("*", slices).groupBy("col", "slice").applyInPandas(run, f"col {a.cols.schema['col'].dataType.simpleString()}, stat double, x long")
    return part.groupBy("col").agg(F.max("stat").alias("stat"), ((F.sum("x") + 1) / (n_perm + 1)).alias("p"))
