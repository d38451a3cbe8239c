"""Tests and effect sizes of matrix columns between groups of rows.

Groups are ``row, grp`` with dense integers. Rank statistics never densify:
distinct values are ranked with their counts, and the implicit zeros of a group
(its size less its stored entries) join the value 0 as one weighted row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chisq_sf, f_sf, log2_fold_change, t_two_sided, two_sided
from ..loops import cut
from ..model import Matrix
from .matrix import group_stats


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def two_group_stats(a: Matrix, groups: DataFrame, compat: bool = False) -> DataFrame:
    """``col, n0, n1, mean0, mean1, var0, var1`` for groups 0 and 1; ``compat`` as in ``group_stats``."""
    g = group_stats(a, groups.where("grp in (0, 1)"), compat=compat)
    pick = lambda c, k: F.max(F.when(F.col("grp") == k, F.col(c)))
    return g.groupBy("col").agg(*(F.coalesce(pick(c, k), F.lit(0)).alias(f"{c}{k}") for c in ("n", "mean", "var") for k in (0, 1)))


# --- expressions -------------------------------------------------------------


def se_welch(v0, n0, v1, n1) -> Column:
    return F.sqrt(v0 / n0 + v1 / n1)


def se_pooled(v0, n0, v1, n1) -> Column:
    return F.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1))


def df_welch(v0, n0, v1, n1) -> Column:
    a, b = v0 / n0, v1 / n1
    return (a + b) * (a + b) / F.nullif(a * a / (n0 - 1) + b * b / (n1 - 1), F.lit(0.0))


def cohens_d(m0, v0, n0, m1, v1, n1) -> Column:
    """(mean1 - mean0) / pooled deviation; 0 for groups under two rows or without variance."""
    pooled = F.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / F.nullif(n0 + n1 - 2, F.lit(0)))
    return F.when((n0 < 2) | (n1 < 2), F.lit(0.0)).otherwise(F.coalesce((m1 - m0) / F.nullif(pooled, F.lit(0.0)), F.lit(0.0)))


def hedges_g(m0, v0, n0, m1, v1, n1) -> Column:
    return cohens_d(m0, v0, n0, m1, v1, n1) * (1 - 3 / (4 * (n0 + n1 - 2) - 1))


def glass_delta(m0, v0, n0, m1, v1, n1) -> Column:
    return F.coalesce((m1 - m0) / F.nullif(F.sqrt(v0), F.lit(0.0)), F.lit(0.0))


EFFECTS = {"cohens_d": cohens_d, "hedges_g": hedges_g, "glass_delta": glass_delta, "cles": lambda *_: F.lit(0.5)}


def effect(kind: str) -> Column:
    c = [F.col(x) for x in ("mean0", "var0", "n0", "mean1", "var1", "n1")]
    return EFFECTS[kind](*c)


# --- parametric tests --------------------------------------------------------


def ttest(a: Matrix, groups: DataFrame, welch: bool = True, effect_type: str = "cohens_d", compat: bool = False) -> DataFrame:
    """``col, t, p, log2_fc, effect`` of group 1 against 0; p by the normal distribution; ``compat`` takes
    the variances of ``group_stats`` with it."""
    s = two_group_stats(a, groups, compat)
    c = [F.col(x) for x in ("var0", "n0", "var1", "n1")]
    se = (se_welch if welch else se_pooled)(*c)
    t = F.coalesce((F.col("mean1") - F.col("mean0")) / F.nullif(se, F.lit(0.0)), F.lit(0.0))
    return s.select("col", t.alias("t"), log2_fold_change(F.col("mean0"), F.col("mean1")).alias("log2_fc"), effect(effect_type).alias("effect")).withColumn("p", t_two_sided(F.col("t")))


def effect_size(a: Matrix, groups: DataFrame, kind: str = "cohens_d", compat: bool = False) -> DataFrame:
    return two_group_stats(a, groups, compat).select("col", effect(kind).alias("effect"))


def oneway_anova(a: Matrix, groups: DataFrame) -> DataFrame:
    """``col, f, p``."""
    g = group_stats(a, groups)
    n, k = F.sum("n").cast("double"), F.count(F.lit(1)).cast("double")
    within = F.sum(F.when(F.col("n") > 1, F.col("var") * (F.col("n") - 1)).otherwise(0.0))
    total = F.sum(F.col("n") * F.col("mean"))
    s = g.groupBy("col").agg(n.alias("n"), k.alias("k"), within.alias("ssw"), (F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * total / n).alias("ssb"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.coalesce((F.col("ssb") / d1) / F.nullif(F.col("ssw") / d2, F.lit(0.0)), F.lit(0.0))
    return s.select("col", f.alias("f"), f_sf(f, d1, d2).alias("p"))


# --- rank tests --------------------------------------------------------------


def value_counts(a: Matrix, groups: DataFrame) -> DataFrame:
    """``col, grp, v, c``: how often a group has a value, implicit zeros included."""
    g = group_stats(a, groups)
    zeros = g.where("n > nnz").select("col", "grp", F.lit(0.0).alias("v"), (F.col("n") - F.col("nnz")).alias("c"))
    stored = a.entries.join(groups, "row").groupBy("col", "grp", "v").agg(F.count(F.lit(1)).alias("c"))
    return stored.unionByName(zeros).groupBy("col", "grp", "v").agg(F.sum("c").alias("c"))


def ranks(counts: DataFrame) -> DataFrame:
    """``col, v, t, rank``: average ranks of distinct values with their multiplicity t."""
    v = counts.groupBy("col", "v").agg(F.sum("c").alias("t"))
    before = Window.partitionBy("col").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return v.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)


def mwu(a: Matrix, groups: DataFrame) -> DataFrame:
    """``col, u, p, auroc, log2_fc``: Mann-Whitney U of group 0, normal p with tie and continuity
    correction, and the area U / (n0 n1)."""
    c = value_counts(a, groups.where("grp in (0, 1)"))
    r = ranks(c)
    ties = r.groupBy("col").agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = c.where("grp = 0").join(r, ["col", "v"]).groupBy("col").agg(F.sum(F.col("rank") * F.col("c")).alias("r0"))
    s = two_group_stats(a, groups).join(ties, "col").join(sums, "col")
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    u = F.col("r0") - n0 * (n0 + 1) / 2
    n = n0 + n1
    sigma = F.sqrt(n0 * n1 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    dev = F.abs(u - n0 * n1 / 2) - 0.5
    z = F.when(sigma > 1e-12, F.greatest(dev, F.lit(0.0)) / sigma).otherwise(F.lit(0.0))
    return s.select("col", u.alias("u"), (u / (n0 * n1)).alias("auroc"), log2_fold_change(F.col("mean0"), F.col("mean1")).alias("log2_fc"), two_sided(z).alias("p"))


def auroc(a: Matrix, groups: DataFrame) -> DataFrame:
    return mwu(a, groups).select("col", "auroc", "p")


def kruskal_wallis(a: Matrix, groups: DataFrame, compat: bool = False) -> DataFrame:
    """``col, h, p``, tie-corrected; implicit zeros are ranked. With ``compat`` zeros count in sizes and ties
    but add nothing to a group's rank sum, for comparison with results computed so."""
    c = value_counts(a, groups)
    r = ranks(c)
    total = r.groupBy("col").agg(F.sum("t").cast("double").alias("n"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    rank = F.when(F.col("v") == 0, 0.0).otherwise(F.col("rank")) if compat else F.col("rank")
    per = c.join(r, ["col", "v"]).groupBy("col", "grp").agg(F.sum(rank * F.col("c")).alias("r"), F.sum("c").alias("m"))
    s = per.groupBy("col").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.count(F.lit(1)).alias("k")).join(total, "col")
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    h = F.greatest(F.lit(0.0), F.coalesce(h, F.lit(0.0)))
    return s.select("col", h.alias("h"), chisq_sf(h, F.col("k") - 1.0).alias("p"))


def ks(a: Matrix, groups: DataFrame) -> DataFrame:
    """``col, d, p``: two-sample Kolmogorov-Smirnov distance and asymptotic p."""
    c = value_counts(a, groups.where("grp in (0, 1)"))
    at = c.groupBy("col", "v").agg(*(F.sum(F.when(F.col("grp") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in (0, 1)))
    to = Window.partitionBy("col").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("col")
    gap = F.abs(F.sum("c0").over(to) / F.sum("c0").over(every) - F.sum("c1").over(to) / F.sum("c1").over(every))
    s = at.select("col", gap.alias("gap"), F.sum("c0").over(every).alias("n0"), F.sum("c1").over(every).alias("n1"))
    s = s.groupBy("col").agg(F.max("gap").alias("d"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    root = F.sqrt(F.col("n0") * F.col("n1") / (F.col("n0") + F.col("n1")))
    lam = (root + 0.12 + 0.11 / root) * F.col("d")
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + 2 * F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam))
    return s.select("col", "d", F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("p"))


# --- two samples of columns --------------------------------------------------


#: Width and reach of the cells of the kernel at unit scale, and terms of its series.
_CELL, _REACH, _TERMS = 0.5, 15, 20


def _kernel_of_cells(batches):
    """``col, k``: sum of exp(-(u - v)^2) over two cells ``off`` apart, from their moments."""
    import pyarrow as pa

    facts = np.cumprod(np.r_[1.0, np.arange(1, _TERMS)])
    table = {}
    for off in range(-_REACH, _REACH + 1):
        t = -off * _CELL  # centre of the first cell less that of the second
        h = [np.exp(-t * t), 2 * t * np.exp(-t * t)]
        for i in range(1, 2 * _TERMS):
            h.append(2 * t * h[i] - 2 * i * h[i - 1])
        i = np.arange(_TERMS)
        table[off] = np.array(h)[i[:, None] + i[None, :]] * ((-1.0) ** i / facts)[:, None] / facts[None, :]
    table = np.stack([table[o] for o in range(-_REACH, _REACH + 1)])
    for b in batches:
        m1, m2 = (np.asarray(b.column(b.schema.get_field_index(c)).flatten()).reshape(-1, _TERMS) for c in ("m1", "m2"))
        off = np.asarray(b.column(b.schema.get_field_index("off")))
        k = np.zeros(len(off))
        for o in np.unique(off):
            at = off == o
            k[at] = np.einsum("ni,ij,nj->n", m1[at], table[o + _REACH], m2[at], optimize=True)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("col")), pa.array(k)], names=["col", "k"])


def mmd_rbf(x: Matrix, y: Matrix, gamma: float = 1.0) -> DataFrame:
    """``col, mmd``: biased squared maximum mean discrepancy of a column between two matrices,
    floored at 0. Equal values are counted once, and values enter by the moments of their cell: cells
    are half as wide as the kernel (at unit scale), and the kernel of two cells is its series in both
    moments (20 terms; rest under 1e-15). Cells over 7 apart add under 1e-18. So work grows with
    the values, not with their pairs."""

    def values(m: Matrix, n: str) -> DataFrame:
        stored = m.entries.groupBy("col", "v").agg(F.count(F.lit(1)).alias("c"))
        zeros = m.over_cols(m.entries.groupBy("col").agg(F.count(F.lit(1)).alias("k"))).select("col", F.lit(0.0).alias("v"), (F.lit(m.n_rows) - F.coalesce("k", F.lit(0))).alias("c"))
        both = stored.unionByName(zeros).groupBy("col", "v").agg(F.sum("c").alias("c")).where("c > 0")
        return both.select("col", F.col("v").alias(n), (F.col("c") / F.lit(float(m.n_rows))).alias("w" + n))

    def cells(a: DataFrame) -> DataFrame:
        u = F.col("a") * float(np.sqrt(gamma))
        d = a.withColumn("cell", F.floor(u / _CELL)).withColumn("b", u - (F.col("cell") + 0.5) * _CELL)
        powers = F.array(*[F.sum(F.col("wa") * (F.lit(1.0) if i == 0 else F.pow("b", F.lit(float(i))))) for i in range(_TERMS)])
        return d.groupBy("col", "cell").agg(powers.alias("m"))

    def mean(a: DataFrame, b: DataFrame) -> DataFrame:
        far = a.withColumn("off", F.explode(F.sequence(F.lit(-_REACH), F.lit(_REACH)))).select("col", (F.col("cell") + F.col("off")).alias("cell"), "off", F.col("m").alias("m1"))
        near = far.join(b, ["col", "cell"]).select("col", "off", "m1", F.col("m").alias("m2"))
        return near.mapInArrow(_kernel_of_cells, near.select("col").withColumn("k", F.lit(0.0)).schema).groupBy("col").agg(F.sum("k").alias("k"))

    cx, cy = cut(cells(values(x, "a"))), cut(cells(values(y, "a")))
    xx, yy, xy = (mean(a, b).withColumnRenamed("k", n) for a, b, n in ((cx, cx, "xx"), (cy, cy, "yy"), (cx, cy, "xy")))
    d = xx.join(yy, "col").join(xy, "col", "left")
    return d.select("col", F.greatest(F.lit(0.0), F.col("xx") + F.col("yy") - 2 * F.coalesce("xy", F.lit(0.0))).alias("mmd"))


# --- composition and response ------------------------------------------------


def composition(labels: DataFrame) -> DataFrame:
    """``type, cond, proportion, p`` from ``id, type, cond``: share of a type in a condition and a
    chi-squared p of the type's split over conditions."""
    c = labels.groupBy("type", "cond").agg(F.count(F.lit(1)).alias("c"))
    conds = labels.groupBy("cond").agg(F.count(F.lit(1)).alias("nc"))
    types = labels.groupBy("type").agg(F.count(F.lit(1)).alias("nt"))
    n = labels.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cond").alias("k"))
    g = types.crossJoin(F.broadcast(conds)).crossJoin(F.broadcast(n)).join(c, ["type", "cond"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    exp = F.col("nt") * F.col("nc") / F.col("n")
    rest = F.col("nc") - exp
    term = (F.col("c") - exp) * (F.col("c") - exp) * (1 / exp + F.when(rest > 0, 1 / rest).otherwise(0.0))
    chi = g.groupBy("type").agg(F.sum(term).alias("chi"), F.max("k").alias("k"))
    return g.join(chi.select("type", chisq_sf(F.col("chi"), F.col("k") - 1.0).alias("p")), "type").select("type", "cond", (F.col("c") / F.col("nc")).alias("proportion"), "p")


def abundance(labels: DataFrame) -> DataFrame:
    """``cluster, fold_change, p`` between conditions 0 and 1 from ``id, cluster, cond``."""
    c = labels.groupBy("cluster").agg(*(F.sum((F.col("cond") == k).cast("double")).alias(f"c{k}") for k in (0, 1)))
    n = labels.agg(*(F.sum((F.col("cond") == k).cast("double")).alias(f"n{k}") for k in (0, 1)))
    s = c.crossJoin(F.broadcast(n))
    x = [F.col("c0"), F.col("n0") - F.col("c0"), F.col("c1"), F.col("n1") - F.col("c1")]
    det = x[0] * x[3] - x[1] * x[2]
    chi = (F.col("n0") + F.col("n1")) * det * det / F.nullif((x[0] + x[1]) * (x[2] + x[3]) * (x[0] + x[2]) * (x[1] + x[3]), F.lit(0.0))
    p0, p1 = F.col("c0") / F.col("n0"), F.col("c1") / F.col("n1")
    return s.select("cluster", F.coalesce(p1 / F.nullif(p0, F.lit(0.0)), F.lit(0.0)).alias("fold_change"), chisq_sf(F.coalesce(chi, F.lit(0.0)), 1).alias("p"))


def bounded_log_ratio(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """log2(a / b) with +-10 where one of them is (nearly) zero, 0 where both are."""
    return F.when((a > eps) & (b > eps), F.log2(F.greatest(a, F.lit(1e-300)) / F.greatest(b, F.lit(1e-300)))).when(a > eps, F.lit(10.0)).when(b > eps, F.lit(-10.0)).otherwise(F.lit(0.0))


def differential_abundance(labels: DataFrame) -> DataFrame:
    """``cluster, score, p`` from ``id, cluster, sample, cond``: log2 ratio of mean sample proportions
    of condition 1 over 0 and the rank-sum p of the samples' proportions."""
    sizes = labels.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.max("cond").alias("grp"))
    c = labels.groupBy("cluster", "sample").agg(F.count(F.lit(1)).alias("c")).join(sizes, "sample")
    m = Matrix(c.select(F.col("sample").alias("row"), F.col("cluster").alias("col"), (F.col("c") / F.col("n")).alias("v")), sizes.select(F.col("sample").alias("row")), labels.select(F.col("cluster").alias("col")).distinct())
    return _response(m, sizes.select(F.col("sample").alias("row"), "grp")).withColumnRenamed("col", "cluster")


def _response(m: Matrix, groups: DataFrame) -> DataFrame:
    s = two_group_stats(m, groups).select("col", bounded_log_ratio(F.col("mean1"), F.col("mean0")).alias("score"))
    return s.join(mwu(m, groups).select("col", "p"), "col")


def condition_response(a: Matrix, conditions: DataFrame) -> DataFrame:
    """``col, score, p``: bounded log2 ratio of condition means and rank-sum p."""
    return _response(a, conditions)


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
