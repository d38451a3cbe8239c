"""The number of subclusters: k-means of every k at once, and silhouettes from summaries.

Centres of all k are one small array (their number is bounded by ``max_k``); each round
assigns every row under every k in one scan, and a vector mean by (k, cluster) gives the
next centres. The silhouette of a row needs only counts, sums and squared norms of the
clusters, because distances are squared Euclidean; no pair of rows is made.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..loops import cut
from .doublets import draw

#: Rows that a subcluster should have; with fewer rows there is one cluster.
MIN_SIZE = 10


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, d: s + d)


def _away(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def _seeds(x: DataFrame, n: int, seed: int) -> list[list[float]]:
    """Rows drawn one after the other with odds of their squared distance to those drawn."""
    first = x.orderBy(draw("id", seed=seed), "id").select("x").first()
    got = [list(first["x"])]
    near = None
    for i in range(1, n):
        d = _away(F.col("x"), F.lit(got[-1]))
        near = cut(x.withColumn("d", d) if near is None else near.withColumn("d", F.least("d", d)))
        last = near.where("d > 0").orderBy(-F.log(1 - draw("id", seed=seed + i)) / F.col("d"), "id").select("x").first()
        if last is None:
            break
        got.append(list(last["x"]))
    return got


def _assigned(x: DataFrame, centres: dict[int, dict[int, list[float]]]) -> DataFrame:
    """``id, x, k, label``: the nearest centre of every k; ties to the smaller label."""
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*(F.struct(F.lit(c).alias("c"), F.lit(m).alias("m")) for c, m in sorted(own.items()))).alias("own")) for k, own in sorted(centres.items())))
    near = F.transform("own", lambda c: F.struct(_away(F.col("x"), c["m"]).alias("d"), c["c"].alias("c")))
    return x.withColumn("e", F.explode(table)).select("id", "x", "e.k", "e.own").select("id", "x", "k", F.array_min(near)["c"].alias("label"))


def kmeans_all(x: DataFrame, ks: list[int], max_iter: int = 20, seed: int = 0) -> DataFrame:
    """``id, x, k, label`` of ``id, x`` (arrays of one length) for every k that is not above the
    number of different rows: Lloyd's rounds from nested seeds until no centre of any k moves."""
    x = cut(x.select("id", F.transform("x", lambda v: v.cast("double")).alias("x")))
    seeds = _seeds(x, max(ks), seed) if not x.isEmpty() else []
    centres = {k: dict(enumerate(seeds[:k])) for k in ks if k <= len(seeds)}
    if not centres:  # fewer different rows than clusters
        return x.select("id", "x", F.lit(0).alias("k"), F.lit(0).alias("label")).where("false")
    for _ in range(max_iter):
        mean = _assigned(x, centres).groupBy("k", "label").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("m"))
        new = {k: dict(own) for k, own in centres.items()}
        for r in mean.collect():  # at most a row for each k and cluster
            new[r["k"]][r["label"]] = list(r["m"])
        moved = max((abs(p - q) for k in new for c in new[k] for p, q in zip(new[k][c], centres[k][c], strict=True)), default=0.0)
        centres = new
        if moved < 1e-12:
            break
    return cut(_assigned(x, centres))


def silhouettes(labelled: DataFrame) -> DataFrame:
    """``k, score`` of ``id, x, k, label``: the mean of (b - a) / max(a, b) over rows, a and b being mean
    squared distances to the other rows of the own and of the nearest other cluster."""
    x = labelled.withColumn("q", _dot(F.col("x"), F.col("x")))
    s = x.groupBy("k", "label").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("q").alias("q"), vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("y"))
    clusters = s.groupBy("k").agg(F.collect_list(F.struct("label", "n", "q", "y")).alias("all"))  # k of them
    j = x.select("k", "label", "x", F.col("q").alias("own")).join(clusters, "k")
    mean = lambda c: F.greatest(F.lit(0.0), F.col("own") + c["q"] / c["n"] - 2 * _dot(F.col("x"), c["y"]) / c["n"])
    a = F.aggregate(F.filter("all", lambda c: c["label"] == F.col("label")), F.lit(0.0), lambda s, c: F.when(c["n"] > 1, mean(c) * c["n"] / (c["n"] - 1)).otherwise(F.lit(0.0)))
    b = F.array_min(F.transform(F.filter("all", lambda c: c["label"] != F.col("label")), mean))
    d = j.select("k", a.alias("a"), b.alias("b")).where("b is not null and greatest(a, b) > 1e-15")
    return d.groupBy("k").agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("score"))


def subcluster_scores(x: DataFrame, max_k: int, seed: int = 0, min_size: int = MIN_SIZE) -> DataFrame:
    """``k, score`` for k from 2 to ``max_k``, or as many as leave ``min_size`` rows a cluster."""
    top = min(max_k, x.count() // min_size)
    return silhouettes(kmeans_all(x, list(range(2, max(top, 1) + 1)) or [2], seed=seed)).where(F.col("k") <= top)


def find_optimal_subclusters(x: DataFrame, max_k: int = 10, seed: int = 0, min_size: int = MIN_SIZE) -> DataFrame:
    """``k``: the number of clusters with the best silhouette (ties: the smallest), 1 for few rows."""
    best = subcluster_scores(x, max_k, seed, min_size).agg(F.max_by("k", F.struct(F.round("score", 12), -F.col("k"))).alias("k"))
    return best.select(F.coalesce("k", F.lit(1)).cast("long").alias("k"))
