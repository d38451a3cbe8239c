"""Average linkage by rounds of reciprocal nearest neighbours, and modules cut from its tree.

All pairs of clusters that are each other's nearest merge at once; distances to the
merged ones are means over item pairs, updated by joins. Average linkage is reducible
(a merge brings nothing nearer), so this gives the merges of the one-at-a-time
algorithm; sorted by height they are its order. What is left below ``TAIL`` clusters
is finished in one task of that bounded size.

A pair without a row is infinitely far, and so is a merged cluster from one that is
infinitely far from a part of it; such clusters never merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Graph, Matrix
from .matrix import col_moments
from .testing import ordered, positions

#: Clusters that one task may finish.
TAIL = 1000
_MERGES = "a long, b long, height double"


def _finish(pdf):
    """Merges of ``a, b, d, na, nb`` one at a time, nearest first (ties: smallest ids)."""
    import numpy as np
    import pandas as pd

    ids = np.unique(np.concatenate([pdf.a, pdf.b]))
    at = {i: k for k, i in enumerate(ids.tolist())}
    d, size = np.full((len(ids), len(ids)), np.inf), np.ones(len(ids))
    i, j = pdf.a.map(at).to_numpy(), pdf.b.map(at).to_numpy()
    d[i, j] = d[j, i] = pdf.d
    size[i], size[j] = pdf.na, pdf.nb
    out = []
    near = d.argmin(1)
    least = d[np.arange(len(ids)), near]
    while len(ids):
        x = int(least.argmin())
        if not np.isfinite(least[x]):
            break
        x, y = sorted((x, int(near[x])))
        out.append((int(ids[x]), int(ids[y]), float(d[x, y])))
        d[x] = (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])
        d[y] = np.inf
        d[x, x] = d[x, y] = np.inf
        d[:, x], d[:, y] = d[x], d[y]
        size[x] += size[y]
        for k in np.flatnonzero((near == x) | (near == y) | (d[:, x] <= least)).tolist():
            near[k] = d[k].argmin()
            least[k] = d[k, near[k]]
    return pd.DataFrame(out, columns=["a", "b", "height"])


def hierarchical(dissim: DataFrame, tail: int = TAIL) -> DataFrame:
    """``step, a, b, height``: average-linkage merges of ``a, b, d`` (each pair once); the merged cluster
    goes on as ``a``, the smaller id."""
    pairs = cut(dissim.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("d").cast("double").alias("d"), F.lit(1.0).alias("na"), F.lit(1.0).alias("nb")))
    merged: list[DataFrame] = []
    while True:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.struct("d", "a", "b").alias("p"))
        near = ends.groupBy("id").agg(F.min("p").alias("p"))
        n = ends.select("id").distinct().limit(tail + 1).count()
        if n <= tail:
            break
        both = cut(near.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("p.a", "p.b", "p.d"))
        merged.append(both.select("a", "b", F.col("d").alias("height")))
        to = both.select(F.col("b").alias("id"), F.col("a").alias("to")).unionByName(both.select(F.col("a").alias("id"), F.col("a").alias("to")))
        x = pairs.join(to.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a", "left").join(to.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b", "left")
        x = x.select(F.coalesce("ta", "a").alias("p"), F.coalesce("tb", "b").alias("q"), "a", "b", "d", "na", "nb", ((F.lit(1) + F.col("ta").isNotNull().cast("int")) * (F.lit(1) + F.col("tb").isNotNull().cast("int"))).alias("parts")).where("p <> q")
        # Ends in order, so that a pair of clusters meets in one group whichever id is smaller now.
        swap = F.col("p") > F.col("q")
        pick = lambda u, v: F.when(swap, F.col(v)).otherwise(F.col(u))
        x = x.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), pick("a", "b").alias("a"), pick("b", "a").alias("b"), "d", pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"), "parts")
        w = F.col("na") * F.col("nb")
        size = lambda own, n, other: F.sum(F.col(n)) / F.countDistinct(other)
        g = x.groupBy("p", "q").agg((F.sum(F.col("d") * w) / F.sum(w)).alias("d"), size("a", "na", "b").alias("na"), size("b", "nb", "a").alias("nb"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
        pairs = cut(g.where("n = parts").select(F.col("p").alias("a"), F.col("q").alias("b"), "d", "na", "nb"))
    merged.append(pairs.groupBy(F.lit(0).alias("one")).applyInPandas(_finish, _MERGES))
    every = merged[0]
    for m in merged[1:]:
        every = every.unionByName(m)
    return ordered(cut(every).withColumn("id", F.struct("a", "b")), "height").select((F.col("rank") - 1).cast("int").alias("step"), "a", "b", "height")


def cut_tree(merges: DataFrame, items: DataFrame, height: float) -> DataFrame:
    """``id, component``: merges up to the height, united."""
    from .graphs import connected_components

    e = merges.where(F.col("height") <= height).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
    return connected_components(Graph(e, items))


def numbered(parts: DataFrame, min_size: int) -> DataFrame:
    """``id, module`` of ``id, component``: components of ``min_size`` items or more are numbered from 1
    in the order of their ids, the others are 0."""
    c = cut(parts)
    n = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    num = positions(n.select(F.col("component").alias("id"))).select(F.col("id").alias("component"), (F.col("pos") + 1).alias("module"))
    return c.join(num, "component", "left").select("id", F.coalesce("module", F.lit(0)).cast("long").alias("module"))


def detect_modules(dissim: DataFrame, items: DataFrame, height: float = 0.25, min_size: int = 30, tail: int = TAIL) -> DataFrame:
    """``id, module``: components of the tree below the height, 0 if small, numbered from 1."""
    return numbered(cut_tree(hierarchical(dissim, tail), items, height), min_size)


def _within(a: Matrix, block_size: int) -> DataFrame:
    """``a, b, r``: Pearson correlations of the columns of each block of ``block_size`` columns in order."""
    n = float(a.n_rows)
    blocks = cut(positions(a.cols.select(F.col("col").alias("id"))).select(F.col("id").alias("col"), F.floor(F.col("pos") / block_size).alias("block")))
    s = cut(col_moments(a, ddof=0).select("col", "mean", F.sqrt("var").alias("sd")).join(blocks, "col"))
    e = a.entries.join(blocks, "col")
    dots = e.select("row", "block", F.col("col").alias("a"), "v").join(e.select("row", "block", F.col("col").alias("b"), F.col("v").alias("u")), ["row", "block"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("v") * F.col("u")).alias("dot"))
    x = s.select("block", F.col("col").alias("a"), F.col("mean").alias("m1"), F.col("sd").alias("s1"))
    y = s.select("block", F.col("col").alias("b"), F.col("mean").alias("m2"), F.col("sd").alias("s2"))
    p = x.join(y, "block").where("a < b").join(dots, ["a", "b"], "left")  # a block's own pairs
    r = (F.coalesce("dot", F.lit(0.0)) / n - F.col("m1") * F.col("m2")) / F.nullif(F.col("s1") * F.col("s2"), F.lit(0.0))
    return p.select("a", "b", F.coalesce(r, F.lit(0.0)).alias("r"))


def blockwise_modules(a: Matrix, block_size: int = 5000, power: float = 6.0, height: float = 0.25, min_size: int = 30, tail: int = TAIL) -> DataFrame:
    """``id, module`` of every column: modules of each block of columns by topological overlap of
    |r| ** power. All blocks are one set of pairs that never merge across, so they run together."""
    from .signatures import topological_overlap

    adj = cut(_within(a, block_size).select("a", "b", F.pow(F.abs("r"), F.lit(float(power))).alias("w")))
    return detect_modules(topological_overlap(adj).select("a", "b", (1 - F.col("tom")).alias("d")), a.cols.select(F.col("col").alias("id")), height, min_size, tail)
