"""Entropies, divergences, mutual information and feature selection by them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Matrix

_EPS = 1e-15


def _log(x: Column, base2: bool) -> Column:
    return F.log2(x) if base2 else F.log(x)


def entropy_agg(p: Column, base2: bool = False) -> Column:
    """Aggregate -sum p log p over positive probabilities."""
    return F.coalesce(F.sum(F.when(p > _EPS, -p * _log(p, base2))), F.lit(0.0))


def count_entropy_agg(c: Column, base2: bool = False) -> Column:
    """Aggregate entropy of counts: log n - sum c log c / n."""
    n = F.sum(c)
    h = _log(F.nullif(n, F.lit(0)), base2) - F.sum(F.when(c > 0, c * _log(c.cast("double"), base2))) / n
    return F.greatest(F.lit(0.0), F.coalesce(h, F.lit(0.0)))


def discrete_entropy(p: DataFrame, base2: bool = False) -> DataFrame:
    return p.agg(entropy_agg(F.col("p"), base2).alias("h"))


def count_entropy(c: DataFrame, base2: bool = False) -> DataFrame:
    return c.agg(count_entropy_agg(F.col("c"), base2).alias("h"))


def row_entropy(a: Matrix, normalize: bool = False, base2: bool = False) -> DataFrame:
    """``row, h``: entropy of a row's positive values; normalised by the log of their number."""
    e = a.entries.where("v > 0").groupBy("row").agg(count_entropy_agg(F.col("v"), base2).alias("h"), F.count(F.lit(1)).alias("k"))
    h = F.when(F.col("k") > 1, F.col("h") / _log(F.col("k").cast("double"), base2)).otherwise(F.lit(0.0)) if normalize else F.col("h")
    return a.over_rows(e).select("row", F.coalesce(h, F.lit(0.0)).alias("h"))


def _aligned(p: DataFrame, q: DataFrame) -> DataFrame:
    return p.join(q, "id", "full").select("id", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def _kl_term(p: Column, q: Column, base2: bool, missing: float) -> Column:
    return F.when(p > _EPS, F.when(q > _EPS, p * _log(p / F.greatest(q, F.lit(_EPS)), base2)).otherwise(F.lit(missing))).otherwise(F.lit(0.0))


def kl_divergence(p: DataFrame, q: DataFrame, base2: bool = False) -> DataFrame:
    """``d``; an outcome that only p has adds 1e10."""
    return _aligned(p, q).agg(F.sum(_kl_term(F.col("p"), F.col("q"), base2, 1e10)).alias("d"))


def js_divergence(p: DataFrame, q: DataFrame, base2: bool = False) -> DataFrame:
    m = (F.col("p") + F.col("q")) / 2
    return _aligned(p, q).agg((0.5 * F.sum(_kl_term(F.col("p"), m, base2, 0.0) + _kl_term(F.col("q"), m, base2, 0.0))).alias("d"))


def symmetric_kl(p: DataFrame, q: DataFrame, base2: bool = False) -> DataFrame:
    """Mean of both directions over outcomes that both have."""
    return _aligned(p, q).agg((0.5 * F.sum(_kl_term(F.col("p"), F.col("q"), base2, 0.0) + _kl_term(F.col("q"), F.col("p"), base2, 0.0))).alias("d"))


def cross_entropy(p: DataFrame, q: DataFrame) -> DataFrame:
    return _aligned(p, q).agg((-F.sum(F.col("p") * F.log(F.greatest("q", F.lit(_EPS))))).alias("h"))


def perplexity(p: DataFrame, q: DataFrame) -> DataFrame:
    return cross_entropy(p, q).select(F.exp("h").alias("perplexity"))


def gini_impurity(p: DataFrame) -> DataFrame:
    return p.agg((1 - F.sum(F.col("p") * F.col("p"))).alias("gini"))


# --- discretisation ----------------------------------------------------------


def equal_width(x: DataFrame, n_bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``bin`` of ``x``: equal intervals between the extremes (of each key)."""
    r = x.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    d = x.join(r, list(keys)) if keys else x.crossJoin(F.broadcast(r))
    width = F.nullif((F.col("_hi") - F.col("_lo")) / n_bins, F.lit(0.0))
    b = F.coalesce(F.least(F.lit(n_bins - 1), F.floor((F.col("x") - F.col("_lo")) / width).cast("int")), F.lit(0))
    return d.withColumn("bin", b).drop("_lo", "_hi")


def equal_frequency(x: DataFrame, n_bins: int) -> DataFrame:
    """``bin`` = rank / ceil(n / bins), ranks from 0 with ties by id."""
    from .testing import ordered

    o = ordered(x, "x")
    return o.select("id", "x", F.least(F.lit(n_bins - 1), F.floor((F.col("rank") - 1) / F.ceil(F.col("n") / n_bins)).cast("int")).alias("bin"))


def histogram2d(b: DataFrame) -> DataFrame:
    return b.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))


def _entropies(b: DataFrame, keys: tuple[str, ...] = (), base2: bool = False) -> DataFrame:
    """``keys, hx, hy, hxy`` of binned ``x, y`` pairs, from one histogram."""
    h = b.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    one = lambda c, n: h.groupBy(*keys, c).agg(F.sum("c").alias("c")).groupBy(*keys).agg(count_entropy_agg(F.col("c"), base2).alias(n))
    both = h.groupBy(*keys).agg(count_entropy_agg(F.col("c"), base2).alias("hxy"))
    x, y = one("x", "hx"), one("y", "hy")
    return both.join(x, list(keys)).join(y, list(keys)) if keys else both.crossJoin(x).crossJoin(y)


def joint_entropy(b: DataFrame, base2: bool = False) -> DataFrame:
    return _entropies(b, base2=base2).select(F.col("hxy").alias("h"))


def marginal_entropy(b: DataFrame, base2: bool = False) -> DataFrame:
    return _entropies(b, base2=base2).select(F.col("hx").alias("h"))


def conditional_entropy(b: DataFrame, base2: bool = False) -> DataFrame:
    """H(Y given X)."""
    return _entropies(b, base2=base2).select((F.col("hxy") - F.col("hx")).alias("h"))


def mutual_information(b: DataFrame, base2: bool = False) -> DataFrame:
    return _entropies(b, base2=base2).select(F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"))


def information_gain(b: DataFrame) -> DataFrame:
    return mutual_information(b, base2=True).select(F.col("mi").alias("gain"))


def normalized_mi(b: DataFrame) -> DataFrame:
    e = _entropies(b)
    mi = F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy"))
    return e.select(F.when((F.col("hx") > 0) & (F.col("hy") > 0), 2 * mi / (F.col("hx") + F.col("hy"))).otherwise(F.lit(0.0)).alias("nmi"))


def adjusted_mi(b: DataFrame) -> DataFrame:
    """(MI - E) / (max H - E) with E = sum of e ln e over normalised products of margins."""
    h = b.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    n = h.agg(F.sum("c").alias("n"))
    x, y = (h.groupBy(c).agg(F.sum("c").alias("m" + c)) for c in ("x", "y"))
    e = F.col("mx") * F.col("my") / (F.col("n") * F.col("n"))
    exp = x.crossJoin(F.broadcast(y)).crossJoin(F.broadcast(n)).agg(F.sum(F.when(e > 0, e * F.log(e))).alias("e"))
    r = _entropies(b).crossJoin(F.broadcast(exp))
    mi, top = F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")), F.greatest("hx", "hy")
    return r.select(F.coalesce((mi - F.col("e")) / F.nullif(top - F.col("e"), F.lit(0.0)), F.lit(0.0)).alias("ami"))


# --- feature selection -------------------------------------------------------


def _binned(a: Matrix, n_bins: int) -> DataFrame:
    """``row, col, bin`` of every cell whose bin differs from that of 0 in its column, and the bin of 0."""
    s = a.entries.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("k"))
    sparse = F.col("k") < a.n_rows
    s = s.select("col", F.when(sparse, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(sparse, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    bin_of = lambda v: F.coalesce(F.least(F.lit(n_bins - 1), F.floor((v - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / n_bins, F.lit(0.0))).cast("int")), F.lit(0))
    return a.entries.join(s, "col").select("row", "col", bin_of(F.col("v")).alias("bin"), bin_of(F.lit(0.0)).alias("zero_bin"))


def feature_mi(a: Matrix, target: DataFrame, n_bins: int = 10) -> DataFrame:
    """``col, mi``: mutual information of binned columns with ``row, y``; implicit zeros by difference."""
    b = _binned(a, n_bins)
    stored = b.join(target, "row").groupBy("col", "bin", "y").agg(F.count(F.lit(1)).alias("c"))
    sizes = target.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    have = stored.groupBy("col", "y").agg(F.sum("c").alias("k"))
    zero_bin = b.groupBy("col").agg(F.max("zero_bin").alias("bin"))
    zeros = a.cols.crossJoin(F.broadcast(sizes)).join(have, ["col", "y"], "left").join(zero_bin, "col", "left")
    zeros = zeros.select("col", F.coalesce("bin", F.lit(0)).alias("bin"), "y", (F.col("n") - F.coalesce("k", F.lit(0))).alias("c"))
    h = stored.unionByName(zeros).groupBy("col", "bin", "y").agg(F.sum("c").alias("c")).where("c > 0")
    part = lambda k, n: h.groupBy("col", k).agg(F.sum("c").alias("c")).groupBy("col").agg(count_entropy_agg(F.col("c")).alias(n))
    both = h.groupBy("col").agg(count_entropy_agg(F.col("c")).alias("hxy"))
    e = both.join(part("bin", "hx"), "col").join(part("y", "hy"), "col")
    return e.select("col", F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"))


def select_features_mi(a: Matrix, target: DataFrame, k: int, n_bins: int = 10) -> DataFrame:
    return feature_mi(a, target, n_bins).orderBy(F.desc("mi"), "col").limit(k)


def mrmr_selection(a: Matrix, target: DataFrame, k: int, n_bins: int = 10) -> DataFrame:
    """``col, step, score``: greedy choice by relevance less the mean redundancy with those chosen.

    k rounds; a round is one aggregate over the columns, and only the chosen ids reach the driver."""
    from ..loops import cut

    relevance = cut(feature_mi(a, target, n_bins))
    b = cut(_binned(a, n_bins))
    chosen: list[tuple[int, float]] = []
    redundancy = relevance.select("col", F.lit(0.0).alias("r"))
    for step in range(k):
        taken = [c for c, _ in chosen]
        s = relevance.where(~F.col("col").isin(taken)) if taken else relevance
        score = F.col("mi") - (F.coalesce("r", F.lit(0.0)) / max(step, 1))
        best = s.join(redundancy, "col", "left").select("col", score.alias("score")).orderBy(F.desc("score"), "col").first()
        if best is None:
            break
        chosen.append((best["col"], best["score"]))
        if step + 1 == k:
            break
        last = b.where(F.col("col") == best["col"])
        zero = last.agg(F.coalesce(F.max("zero_bin"), F.lit(0))).first()[0]
        y = a.rows.join(last.select("row", F.col("bin").alias("y")), "row", "left").select("row", F.coalesce("y", F.lit(zero)).alias("y"))
        more = feature_mi(a, y, n_bins).select("col", F.col("mi").alias("m"))
        redundancy = cut(redundancy.join(more, "col", "left").select("col", (F.col("r") + F.coalesce("m", F.lit(0.0))).alias("r")))
    rows = [(int(c), i + 1, float(s)) for i, (c, s) in enumerate(chosen)]
    return a.entries.sparkSession.createDataFrame(rows, "col long, step int, score double")


def specificity_entropy(means: DataFrame) -> DataFrame:
    """``col, h``: entropy of group means over the log of the number of groups, from ``col, grp, mean``."""
    total = Window.partitionBy("col")
    p = F.col("mean") / F.nullif(F.sum("mean").over(total), F.lit(0.0))
    d = means.select("col", p.alias("p"))
    g = d.groupBy("col").agg(entropy_agg(F.col("p")).alias("h"), F.count(F.lit(1)).alias("g"))
    return g.select("col", F.when(F.col("g") > 1, F.col("h") / F.log(F.col("g").cast("double"))).otherwise(F.lit(0.0)).alias("h"))


LN2 = math.log(2)
