"""Order statistics of all columns at once, and correlations made from them.

A rank is found by refining a range of values: every round counts, for each column,
the values in equal parts of its range, keeps the part that holds the rank, and goes
on with the smallest and largest value in it. What remains of a column is ranked only
when it is a few values. Equal values, implicit zeros among them, are one row with a
weight, so no column is ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Matrix
from .matrix import gram, pearson

#: Parts of a range in a round, and rows of a range that are ranked at last.
_PARTS, _FEW = 256, 2048
_EPS = 1e-15


def weighted(a: Matrix) -> DataFrame:
    """``col, v, w``: the distinct values of every column of the domain and how many rows have them."""
    e = a.entries.groupBy("col", F.col("v").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    k = a.entries.groupBy("col").agg(F.count(F.lit(1)).alias("k"))
    zeros = a.over_cols(k).select("col", F.lit(0.0).alias("v"), (F.lit(a.n_rows) - F.coalesce("k", F.lit(0))).alias("w")).where("w > 0")
    return e.unionByName(zeros).groupBy("col", "v").agg(F.sum("w").alias("w"))


def select_ranks(x: DataFrame, ranks: DataFrame, parts: int = _PARTS, few: int = _FEW) -> DataFrame:
    """``col, t, v``: for each ``col, t, rank`` the value of that rank (from 0) in ``col, v, w``."""
    x = cut(x)
    state = cut(ranks.join(x.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("m")), "col"))
    found: list[DataFrame] = []
    while True:
        found.append(state.where("lo = hi").select("col", "t", F.col("lo").alias("v")))
        held = x.join(state.where("lo < hi"), "col").where("v >= lo and v <= hi")
        last = Window.partitionBy("col", "t").orderBy("v")
        run = held.where(F.col("m") <= few).withColumn("_c", F.sum("w").over(last))
        found.append(run.where((F.col("_c") > F.col("rank")) & (F.col("_c") - F.col("w") <= F.col("rank"))).select("col", "t", "v"))
        if state.where((F.col("lo") < F.col("hi")) & (F.col("m") > few)).isEmpty():
            break
        part = F.least(F.lit(parts - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts))
        h = held.where(F.col("m") > few).groupBy("col", "t", "rank", part.alias("b")).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("col", "t").orderBy("b")) - F.col("n")
        h = h.withColumn("_b", before).where((F.col("_b") <= F.col("rank")) & (F.col("rank") < F.col("_b") + F.col("n")))
        state = cut(h.select("col", "t", (F.col("rank") - F.col("_b")).alias("rank"), "lo", "hi", "m"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return cut(out)


def _medians(x: DataFrame, cols: DataFrame, n: int, parts: int, few: int) -> DataFrame:
    t = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(r).cast("long").alias("rank")) for i, r in enumerate(((n - 1) // 2, n // 2))))).alias("e")
    return select_ranks(x, cols.select("col", t).select("col", "e.t", "e.rank"), parts, few).groupBy("col").agg((F.sum("v") / 2).alias("m"))


def column_medians(a: Matrix, parts: int = _PARTS, few: int = _FEW) -> DataFrame:
    """``col, median, mad``: of all rows, implicit zeros included; ``mad`` is 1.4826 times the median of the
    absolute deviations from the median."""
    x = cut(weighted(a))
    med = cut(_medians(x, a.cols, a.n_rows, parts, few).withColumnRenamed("m", "median"))
    away = x.join(med, "col").groupBy("col", F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("w").alias("w"))
    return med.join(_medians(away, a.cols, a.n_rows, parts, few).select("col", (1.4826 * F.col("m")).alias("mad")), "col")


def bicor(a: Matrix, parts: int = _PARTS, few: int = _FEW) -> DataFrame:
    """``a, b, r`` (a < b) of all column pairs: the biweight midcorrelation; Pearson's where one of the
    columns has no absolute deviation (or there are under three rows).

    A row without an entry adds the same term for a column, so products are taken over entries
    only, as differences from that term."""
    if a.n_rows < 3:
        return pearson(a.T).select(F.col("row").alias("a"), F.col("other").alias("b"), "r")
    n = float(a.n_rows)
    s = cut(column_medians(a, parts, few))
    good = s.where(F.col("mad") >= _EPS)

    def term(v: Column) -> Column:
        d = v - F.col("median")
        u = d / (9 * F.col("mad"))
        return F.when(F.abs(u) < 1, d * F.pow(1 - u * u, F.lit(2))).otherwise(0.0)

    zero = term(F.lit(0.0))
    e = cut(a.entries.join(good, "col").select("row", "col", (term(F.col("v").cast("double")) - zero).alias("v")))
    sums = good.select("col", zero.alias("z")).join(e.groupBy("col").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")), "col", "left").fillna(0.0)
    sums = cut(sums.select("col", "z", "s", (n * F.col("z") * F.col("z") + 2 * F.col("z") * F.col("s") + F.col("q")).alias("q")))
    x, y = (sums.select(F.col("col").alias(k), *(F.col(c).alias(c + i) for c in "zsq")) for k, i in (("a", "1"), ("b", "2")))
    dots = gram(Matrix(e, a.rows, a.cols).T).where("row < other").select(F.col("row").alias("a"), F.col("other").alias("b"), "dot")
    p = x.join(y, F.col("a") < F.col("b")).join(dots, ["a", "b"], "left")  # the output itself is all pairs
    ab = n * F.col("z1") * F.col("z2") + F.col("z1") * F.col("s2") + F.col("z2") * F.col("s1") + F.coalesce("dot", F.lit(0.0))
    size = F.sqrt(F.col("q1") * F.col("q2"))
    out = p.select("a", "b", F.when(size > _EPS, ab / size).otherwise(0.0).alias("r"))
    flat = s.where(F.col("mad") < _EPS).select("col")
    if flat.isEmpty():
        return out
    rest = pearson(a.T).select(F.col("row").alias("a"), F.col("other").alias("b"), "r")
    marked = rest.join(flat.select(F.col("col").alias("a"), F.lit(True).alias("fa")), "a", "left").join(flat.select(F.col("col").alias("b"), F.lit(True).alias("fb")), "b", "left")
    return out.unionByName(marked.where("fa or fb").select("a", "b", "r"))
