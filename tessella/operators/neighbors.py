"""Exact nearest neighbours, batch-aware neighbours, alignment, kernels, imputation, outliers, doublets.

Nearest neighbours are found by ``blocks``: matrix products over pairs of row blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..loops import iterate
from ..model import Matrix
from .blocks import block_knn, rows_of, rows_of_vectors
from .matrix import col_moments, row_moments

# --- nearest neighbours ------------------------------------------------------


def _nearest(pairs: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy("row", *keys).orderBy("dist", "nbr")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cross_knn(a: Matrix, b: Matrix, k: int, same: bool = False, groups: DataFrame | None = None, metric: str = "euclidean") -> DataFrame:
    """``row, nbr, dist, rank``: the k nearest rows of b for every row of a (per group of b's rows, if given)."""
    keys = ["grp"] if groups is not None else []
    n_cols = a.n_cols if metric == "correlation" else None
    out = block_knn(rows_of(a, groups if same else None), None if same else rows_of(b, groups), k, grouped=bool(keys), metric=metric, n_cols=n_cols)
    return out.select("row", "nbr", "dist", "rank", *keys)


def knn(a: Matrix, k: int, metric: str = "euclidean") -> DataFrame:
    return cross_knn(a, a, k, same=True, metric=metric)


def bbknn(a: Matrix, batches: DataFrame, k: int) -> DataFrame:
    """``row, nbr, dist, rank, grp``: k nearest rows in every batch (``row, grp``)."""
    return cross_knn(a, a, k, same=True, groups=batches)


def distance(x: Column, y: Column) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0).cast("double"), lambda s, d: s + d))


def dense_knn(vectors: DataFrame, k: int) -> DataFrame:
    """``row, nbr, dist, rank`` of dense ``id, x`` arrays of one length."""
    return block_knn(rows_of_vectors(vectors), None, k)


def multimodal_neighbors(d1: DataFrame, d2: DataFrame, w1: float, w2: float, k: int) -> DataFrame:
    """kNN on a weighted sum of two distance tables (``row, nbr, dist``)."""
    t = w1 + w2
    d = d1.join(d2.withColumnRenamed("dist", "other"), ["row", "nbr"]).select("row", "nbr", (w1 / t * F.col("dist") + w2 / t * F.col("other")).alias("dist"))
    return _nearest(d, k)


# --- alignment ---------------------------------------------------------------


def mnn_pairs(a: Matrix, b: Matrix, k: int) -> DataFrame:
    """``cell1, cell2``: rows that are among each other's k nearest."""
    x = cross_knn(a, b, k).select(F.col("row").alias("cell1"), F.col("nbr").alias("cell2"))
    y = cross_knn(b, a, k).select(F.col("nbr").alias("cell1"), F.col("row").alias("cell2"))
    return x.join(y, ["cell1", "cell2"])


def find_anchors(a: Matrix, b: Matrix, k: int, threshold: float = 0.5) -> DataFrame:
    """``cell1, cell2, score``: the neighbours of rows of which shared / (2k - shared) reaches the threshold;
    shared counts neighbours that have the row among their own."""
    x = cross_knn(a, b, k).select(F.col("row").alias("cell1"), F.col("nbr").alias("cell2"))
    shared = mnn_pairs(a, b, k).groupBy("cell1").agg(F.count(F.lit(1)).alias("s"))
    score = F.col("s") / (2 * k - F.col("s"))
    return x.join(shared, "cell1").where(score >= threshold).select("cell1", "cell2", score.alias("score"))


def weighted_vote(votes: DataFrame) -> DataFrame:
    """``id, label, confidence`` from ``id, label, w``: best total and its share, ties to the lower label."""
    t = votes.groupBy("id", "label").agg(F.sum("w").alias("w"))
    best = Window.partitionBy("id").orderBy(F.desc("w"), "label")
    r = t.withColumn("_r", F.row_number().over(best)).withColumn("_t", F.sum("w").over(Window.partitionBy("id"))).where("_r = 1")
    return r.select("id", "label", F.coalesce(F.col("w") / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0)).alias("confidence"))


def transfer_labels(anchors: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """Vote of anchors (``cell1, cell2, score``) with labels (``id, label``) of cell1; without anchors label 0, confidence 0."""
    v = anchors.join(labels.select(F.col("id").alias("cell1"), "label"), "cell1").select(F.col("cell2").alias("id"), "label", F.col("score").alias("w"))
    return targets.join(weighted_vote(v), "id", "left").select("id", F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _neighbor_labels(nbrs: DataFrame, labels: DataFrame, own: bool) -> DataFrame:
    """``row, label`` of every neighbour (and of the row itself)."""
    lab = labels.select(F.col("id").alias("nbr"), "label")
    e = nbrs.select("row", "nbr")
    if own:
        e = e.unionByName(labels.select(F.col("id").alias("row"), F.col("id").alias("nbr")))
    return e.join(lab, "nbr").select("row", "label")


def batch_mixing(nbrs: DataFrame, batches: DataFrame) -> DataFrame:
    """``row, mixing``: share of neighbours in another batch."""
    mine = batches.select(F.col("id").alias("row"), F.col("label").alias("own"))
    m = _neighbor_labels(nbrs, batches, False).join(mine, "row").groupBy("row").agg(F.avg((F.col("label") != F.col("own")).cast("double")).alias("mixing"))
    return mine.join(m, "row", "left").select("row", F.coalesce("mixing", F.lit(0.0)).alias("mixing"))


def batch_entropy(nbrs: DataFrame, batches: DataFrame) -> DataFrame:
    """``row, h``: entropy of batches among the neighbours and the row, over the log of the number of batches."""
    n = batches.agg(F.countDistinct("label").cast("double").alias("b"))
    c = _neighbor_labels(nbrs, batches, True).groupBy("row", "label").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("row"))
    h = c.withColumn("p", p).groupBy("row").agg((-F.sum(F.col("p") * F.log(F.col("p")))).alias("h")).crossJoin(F.broadcast(n))
    return h.select("row", F.when(F.col("b") > 1, F.col("h") / F.log("b")).otherwise(F.lit(0.0)).alias("h"))


def integration_score(nbrs: DataFrame, batches: DataFrame) -> DataFrame:
    return batch_entropy(nbrs, batches).agg(F.avg("h").alias("score"))


def lisi(nbrs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, lisi``: inverse Simpson index of the neighbours' labels."""
    c = _neighbor_labels(nbrs, labels, False).groupBy("row", "label").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("row").agg((F.pow(F.sum("c").cast("double"), F.lit(2.0)) / F.sum(F.col("c") * F.col("c"))).alias("lisi"))


def kbet(nbrs: DataFrame, batches: DataFrame) -> DataFrame:
    """``score``: share of rows whose neighbours' batches fit the overall shares (chi-squared up to df + 2 sqrt(2 df))."""
    total = batches.agg(F.count(F.lit(1)).alias("n"))
    share = batches.groupBy("label").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(total)).select("label", (F.col("c") / F.col("n")).alias("p"))
    k = _neighbor_labels(nbrs, batches, False).groupBy("row").agg(F.count(F.lit(1)).alias("k"))
    obs = _neighbor_labels(nbrs, batches, False).groupBy("row", "label").agg(F.count(F.lit(1)).alias("o"))
    g = k.crossJoin(F.broadcast(share)).join(obs, ["row", "label"], "left").withColumn("e", F.col("k") * F.col("p"))
    d = F.coalesce("o", F.lit(0)) - F.col("e")
    chi = g.groupBy("row").agg(F.sum(d * d / F.col("e")).alias("chi"), (F.count(F.lit(1)) - 1).alias("df"))
    return chi.agg((1 - F.avg((F.col("chi") > F.col("df") + 2 * F.sqrt(2 * F.col("df"))).cast("double"))).alias("score"))


def correction_vectors(a: Matrix, b: Matrix, pairs: DataFrame) -> DataFrame:
    """``cell2, col, v``: mean of x1 - x2 over a cell's mutual pairs."""
    n = pairs.groupBy("cell2").agg(F.count(F.lit(1)).alias("n"))
    x1 = pairs.join(a.entries.withColumnRenamed("row", "cell1"), "cell1").select("cell2", "col", "v")
    x2 = pairs.join(b.entries.withColumnRenamed("row", "cell2"), "cell2").select("cell2", "col", (-F.col("v")).alias("v"))
    s = x1.unionByName(x2).groupBy("cell2", "col").agg(F.sum("v").alias("s"))
    return s.join(n, "cell2").select("cell2", "col", (F.col("s") / F.col("n")).alias("v"))


def smooth_vectors(distances: DataFrame, vectors: DataFrame, sigma: float) -> DataFrame:
    """``row, col, v``: Gaussian mean of vectors (``row, col, v``) over a distance table with the row itself."""
    w = distances.select("row", "nbr", F.exp(-F.col("dist") * F.col("dist") / (2 * sigma * sigma)).alias("w"))
    w = w.unionByName(vectors.select("row").distinct().select("row", F.col("row").alias("nbr"), F.lit(1.0).alias("w")))
    total = w.groupBy("row").agg(F.sum("w").alias("t"))
    s = w.join(vectors.select(F.col("row").alias("nbr"), "col", "v"), "nbr").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    return s.join(total, "row").select("row", "col", (F.col("s") / F.col("t")).alias("v"))


# --- kernels over stored distances (``row, nbr, dist``) ----------------------

KERNELS = {
    "gaussian": lambda u: F.exp(-u * u / 2),
    "epanechnikov": lambda u: F.when(u < 1, 0.75 * (1 - u * u)).otherwise(0.0),
    "cosine": lambda u: F.when(u < 1, math.pi / 4 * F.cos(math.pi / 2 * u)).otherwise(0.0),
    "laplacian": lambda u: F.exp(-u),
    "cauchy": lambda u: 1 / (1 + u * u),
    "uniform": lambda u: F.when(u < 1, 0.5).otherwise(0.0),
    "triangular": lambda u: F.when(u < 1, 1 - u).otherwise(0.0),
}


def evaluate_kernel(d: Column, h: Column | float, kind: str = "gaussian") -> Column:
    h = h if isinstance(h, Column) else F.lit(float(h))
    return KERNELS.get(kind, KERNELS["gaussian"])(d / F.greatest(h, F.lit(1e-10)))


def kernel_normalization(kind: str, dimension: Column) -> Column:
    """The factor that makes a kernel's integral one: of the Gaussian in its dimensions, of the others on the line."""
    return {"gaussian": F.pow(F.lit(2 * math.pi), -dimension / 2), "epanechnikov": F.lit(0.75), "uniform": F.lit(0.5)}.get(kind, F.lit(1.0))


def kernel_matrix(d: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    return d.select("row", "nbr", evaluate_kernel(F.col("dist"), h, kind).alias("k"))


def kernel_row_sums(d: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    return kernel_matrix(d, h, kind).groupBy("row").agg(F.sum("k").alias("total"))


def kde(d: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    """``row, density`` = (K(0) + sum K(d)) / (stored + 1)."""
    k0 = evaluate_kernel(F.lit(0.0), h, kind)
    return kernel_matrix(d, h, kind).groupBy("row").agg(((F.sum("k") + F.first(k0)) / (F.count(F.lit(1)) + 1)).alias("density"))


def local_bandwidth(d: DataFrame, k: int = 0) -> DataFrame:
    """``row, h``: the largest of the first k distances (all, for 0)."""
    w = Window.partitionBy("row").orderBy("dist", "nbr")
    e = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k) if k else d
    return e.groupBy("row").agg(F.max("dist").alias("h"))


def _with_bandwidths(d: DataFrame, bw: DataFrame) -> DataFrame:
    return d.join(bw.select("row", F.col("h").alias("h1")), "row").join(bw.select(F.col("row").alias("nbr"), F.col("h").alias("h2")), "nbr")


def adaptive_kde(d: DataFrame, bw: DataFrame, kind: str = "gaussian") -> DataFrame:
    k = evaluate_kernel(F.col("dist"), F.sqrt(F.col("h1") * F.col("h2")), kind)
    k0 = KERNELS[kind](F.lit(0.0))
    return _with_bandwidths(d, bw).withColumn("k", k).groupBy("row").agg(((F.sum("k") + F.first(k0)) / (F.count(F.lit(1)) + 1)).alias("density"))


def rbf(d: DataFrame, h: float) -> DataFrame:
    return d.select("row", "nbr", F.exp(-F.col("dist") * F.col("dist") / (2 * h * h)).alias("k"))


def adaptive_rbf(d: DataFrame, bw: DataFrame) -> DataFrame:
    return _with_bandwidths(d, bw).select("row", "nbr", F.exp(-F.col("dist") * F.col("dist") / (2 * F.col("h1") * F.col("h2"))).alias("k"))


def silverman_bandwidth(x: DataFrame) -> DataFrame:
    return x.agg((1.06 * F.stddev_samp("x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"))


def scott_bandwidth(x: DataFrame) -> DataFrame:
    return x.agg((F.stddev_samp("x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h"))


def nadaraya_watson(d: DataFrame, y: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    """``row, y``: kernel mean of y over neighbours and the row itself."""
    k0 = evaluate_kernel(F.lit(0.0), h, kind)
    own = y.select("row", F.col("row").alias("nbr"), k0.alias("k"))
    k = kernel_matrix(d, h, kind).unionByName(own)
    return k.join(y.select(F.col("row").alias("nbr"), "y"), "nbr").groupBy("row").agg((F.sum(F.col("k") * F.col("y")) / F.sum("k")).alias("y"))


def kernel_smooth(weights: DataFrame, y: DataFrame) -> DataFrame:
    """(sum w y_j + y_i) / (sum w + 1) from ``row, nbr, w`` and ``row, y``."""
    s = weights.join(y.select(F.col("row").alias("nbr"), F.col("y").alias("o")), "nbr").groupBy("row").agg(F.sum(F.col("w") * F.col("o")).alias("s"), F.sum("w").alias("t"))
    return y.join(s, "row", "left").select("row", ((F.coalesce("s", F.lit(0.0)) + F.col("y")) / (F.coalesce("t", F.lit(0.0)) + 1)).alias("y"))


def local_linear(d: DataFrame, xy: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    """``row, y``: intercept at the row of a kernel-weighted line, from ``row, x, y``."""
    own = xy.select("row", F.col("row").alias("nbr"), evaluate_kernel(F.lit(0.0), h, kind).alias("k"))
    k = kernel_matrix(d, h, kind).unionByName(own)
    j = k.join(xy.select(F.col("row").alias("nbr"), F.col("x").alias("xj"), "y"), "nbr").join(xy.select("row", "x"), "row").withColumn("dx", F.col("xj") - F.col("x"))
    s = j.groupBy("row").agg(*(F.sum(e).alias(n) for n, e in (("s0", F.col("k")), ("s1", F.col("k") * F.col("dx")), ("s2", F.col("k") * F.col("dx") * F.col("dx")), ("t0", F.col("k") * F.col("y")), ("t1", F.col("k") * F.col("dx") * F.col("y")))))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    return s.select("row", F.when(F.abs(det) > 1e-12, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).otherwise(F.col("t0") / F.col("s0")).alias("y"))


def mean_shift_step(d: DataFrame, positions: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    """``row, dim, x``: kernel mean of neighbours' positions (``row, dim, x``) and the own one."""
    own = positions.select("row", F.col("row").alias("nbr"), evaluate_kernel(F.lit(0.0), h, kind).alias("k")).distinct()
    k = kernel_matrix(d, h, kind).unionByName(own)
    return k.join(positions.select(F.col("row").alias("nbr"), "dim", "x"), "nbr").groupBy("row", "dim").agg((F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("x"))


def kernel_entropy(d: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    """``row, h``: entropy of a row's normalised kernel with the row itself."""
    own = d.select("row").distinct().select("row", F.col("row").alias("nbr"), evaluate_kernel(F.lit(0.0), h, kind).alias("k"))
    k = kernel_matrix(d, h, kind).unionByName(own)
    p = F.col("k") / F.sum("k").over(Window.partitionBy("row"))
    return k.withColumn("p", p).groupBy("row").agg(F.coalesce(F.sum(F.when(F.col("p") > 1e-300, -F.col("p") * F.log("p"))), F.lit(0.0)).alias("h"))


def bandwidth_for_perplexity(d: DataFrame, perplexity: float, max_iter: int = 50) -> DataFrame:
    """``row, h``: the Gaussian bandwidth at which a row's kernel has the perplexity; bisection inside
    an array expression, on a row's stored distances."""
    g = d.groupBy("row").agg(F.collect_list("dist").alias("ds"))  # a row's neighbours: bounded by k

    def entropy(ds: Column, beta: Column) -> Column:
        e = F.transform(ds, lambda x: F.exp(-x * x * beta))
        z = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
        s = F.aggregate(F.zip_with(ds, e, lambda x, v: x * x * v), F.lit(0.0), lambda s, v: s + v)
        return F.log(F.greatest(z, F.lit(1e-300))) + beta * s / F.greatest(z, F.lit(1e-300))

    goal = math.log(perplexity)
    start = F.struct(F.lit(1e-8).alias("lo"), F.lit(1e8).alias("hi"))

    def halve(s, _):
        mid = F.sqrt(s["lo"] * s["hi"])
        high = entropy(F.col("ds"), mid) > goal
        return F.struct(F.when(high, mid).otherwise(s["lo"]).alias("lo"), F.when(high, s["hi"]).otherwise(mid).alias("hi"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), start, halve)
    return g.select("row", (1 / F.sqrt(2 * F.sqrt(end["lo"] * end["hi"]))).alias("h"))


def kernel_mmd(d: DataFrame, groups: DataFrame, h: float = 1.0, kind: str = "gaussian") -> DataFrame:
    """``mmd`` = sqrt(max(0, AA + BB - 2 AB)) of mean kernels over stored distances between groups 0 and 1."""
    g = groups.select("row", "grp")
    k = kernel_matrix(d, h, kind).join(g, "row").join(g.select(F.col("row").alias("nbr"), F.col("grp").alias("other")), "nbr")
    pick = lambda c: F.coalesce(F.avg(F.when(c, F.col("k"))), F.lit(0.0))
    aa, bb, ab = pick((F.col("grp") == 0) & (F.col("other") == 0)), pick((F.col("grp") == 1) & (F.col("other") == 1)), pick(F.col("grp") != F.col("other"))
    return k.agg(F.sqrt(F.greatest(F.lit(0.0), aa + bb - 2 * ab)).alias("mmd"))


# --- imputation --------------------------------------------------------------


def knn_impute(a: Matrix, nbrs: DataFrame, h: float = 1.0, threshold: float = 0.0, cols: DataFrame | None = None) -> DataFrame:
    """``row, col, v``: cells at or below the threshold filled by the exp(-(d/h)^2)-weighted mean of
    neighbours that have the column; stored cells above it stay."""
    w = nbrs.select("row", "nbr", F.exp(-F.pow(F.col("dist") / h, F.lit(2.0))).alias("w"))
    return knn_impute_weighted(a, w, threshold, cols)


def knn_impute_weighted(a: Matrix, weights: DataFrame, threshold: float = 0.0, cols: DataFrame | None = None) -> DataFrame:
    e = a.entries if cols is None else a.entries.join(cols, "col", "left_semi")
    have = e.where(F.col("v") > threshold)
    fill = weights.join(have.select(F.col("row").alias("nbr"), "col", "v"), "nbr").groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("f"))
    return have.join(fill, ["row", "col"], "full").select("row", "col", F.coalesce("v", "f").alias("v"))


def smooth_expression(a: Matrix, weights: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) x + alpha * weighted neighbour mean (``row, nbr, w``)."""
    total = weights.groupBy("row").agg(F.sum("w").alias("t"))
    m = weights.join(a.entries.select(F.col("row").alias("nbr"), "col", "v"), "nbr").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("s")).join(total, "row").select("row", "col", (alpha * F.col("s") / F.col("t")).alias("v"))
    return a.entries.select("row", "col", ((1 - alpha) * F.col("v")).alias("v")).unionByName(m).groupBy("row", "col").agg(F.sum("v").alias("v"))


def diffuse(a: Matrix, t: DataFrame, steps: int) -> DataFrame:
    """T^steps X from ``row, nbr, w``; one join and aggregate a step."""

    def step(x: DataFrame) -> DataFrame:
        return t.join(x.select(F.col("row").alias("nbr"), "col", "v"), "nbr").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("v"))

    return iterate(a.entries.select("row", "col", F.col("v").cast("double")), step, steps)


def magic_impute(a: Matrix, affinity: DataFrame, t: int) -> DataFrame:
    """Row-normalised affinity (``row, nbr, w``) to the power t times X; rows without weight stay."""
    total = Window.partitionBy("row")
    p = affinity.withColumn("_t", F.sum("w").over(total)).where("_t <> 0").select("row", "nbr", (F.col("w") / F.col("_t")).alias("w"))
    alone = a.rows.join(p.select("row").distinct(), "row", "left_anti").select("row", F.col("row").alias("nbr"), F.lit(1.0).alias("w"))
    return diffuse(a, p.unionByName(alone), t)


def detect_dropouts(a: Matrix, mean_threshold: float) -> DataFrame:
    """``col, p``: share of zeros, halved where the mean of stored values is not above the threshold."""
    m = a.entries.groupBy("col").agg(F.count(F.lit(1)).alias("k"), F.avg("v").alias("m"))
    z = 1 - F.coalesce("k", F.lit(0)) / F.lit(float(a.n_rows))
    return a.over_cols(m).select("col", F.when(F.coalesce("m", F.lit(0.0)) > mean_threshold, z).otherwise(z / 2).alias("p"))


def imputation_quality(original: DataFrame, imputed: DataFrame) -> DataFrame:
    """``r``: correlation over the originally stored non-zero cells."""
    j = original.where("v <> 0").join(imputed.withColumnRenamed("v", "u"), ["row", "col"], "left")
    return j.agg(F.coalesce(F.corr(F.col("v"), F.coalesce("u", F.lit(0.0))), F.lit(0.0)).alias("r"))


# --- outliers ----------------------------------------------------------------


def isolation_score(a: Matrix) -> DataFrame:
    """``row, score``: mean of the deviations of a row's mean and variance from all rows'."""
    m = row_moments(a, ddof=0)
    g = m.agg(F.avg("mean").alias("gm"), F.stddev_pop("mean").alias("gs"), F.avg("var").alias("gv"))
    s = (F.abs(F.col("mean") - F.col("gm")) / F.greatest("gs", F.lit(1e-10)) + F.abs(F.col("var") - F.col("gv")) / F.greatest("gv", F.lit(1e-10))) / 2
    return m.crossJoin(F.broadcast(g)).select("row", s.alias("score"))


def local_outlier_factor(nbrs: DataFrame) -> DataFrame:
    """``row, lof`` from a kNN table ``row, nbr, dist``."""
    kd = nbrs.groupBy("row").agg(F.max("dist").alias("kd"))
    reach = nbrs.join(kd.select(F.col("row").alias("nbr"), "kd"), "nbr").select("row", "nbr", F.greatest("dist", "kd").alias("r"))
    lrd = reach.groupBy("row").agg((F.count(F.lit(1)) / F.greatest(F.sum("r"), F.lit(1e-10))).alias("lrd"))
    j = reach.join(lrd.select(F.col("row").alias("nbr"), F.col("lrd").alias("o")), "nbr").groupBy("row").agg(F.avg("o").alias("o"))
    return j.join(lrd, "row").select("row", (F.col("o") / F.col("lrd")).alias("lof"))


def rarity(nbrs: DataFrame) -> DataFrame:
    """``row, rarity``: mean neighbour distance over the neighbours' mean of it."""
    m = nbrs.groupBy("row").agg(F.avg("dist").alias("m"))
    o = nbrs.join(m.select(F.col("row").alias("nbr"), F.col("m").alias("o")), "nbr").groupBy("row").agg(F.avg("o").alias("o"))
    return m.join(o, "row").select("row", (F.col("m") / F.greatest("o", F.lit(1e-10))).alias("rarity"))


def ambient_score(a: Matrix, share: float = 0.1) -> DataFrame:
    """``row, score``: cosine to the summed profile of the rows of lowest total (that share of rows)."""
    t = a.over_rows(a.entries.groupBy("row").agg(F.sum("v").alias("t"))).select("row", F.coalesce("t", F.lit(0.0)).alias("t"))
    n = max(1, int(a.n_rows * share))
    low = t.orderBy("t", "row").limit(n).select("row")
    prof = a.entries.join(low, "row", "left_semi").groupBy("col").agg(F.sum("v").alias("p"))
    norm = prof.agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("pn"))
    s = a.entries.join(prof, "col", "left").groupBy("row").agg(F.sum(F.col("v") * F.coalesce("p", F.lit(0.0))).alias("d"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("vn")).crossJoin(F.broadcast(norm))
    return a.over_rows(s).select("row", F.coalesce(F.col("d") / F.nullif(F.col("vn") * F.col("pn"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def outlier_genes(a: Matrix, threshold: float) -> DataFrame:
    """``col, z``: columns whose log squared variation coefficient is above ``threshold`` median deviations."""
    m = col_moments(a, ddof=0).where("mean > 1e-10 and var > 0").select("col", F.log(F.col("var") / (F.col("mean") * F.col("mean"))).alias("l"))
    med = m.agg(F.percentile("l", 0.5).alias("med"))
    d = m.crossJoin(F.broadcast(med))
    mad = d.agg(F.percentile(F.abs(F.col("l") - F.col("med")), 0.5).alias("mad"))
    z = (F.col("l") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), F.lit(1e-10))
    return d.crossJoin(F.broadcast(mad)).select("col", z.alias("z")).where(F.col("z") > threshold)


def neighbor_zscore(a: Matrix, nbrs: DataFrame) -> DataFrame:
    """``row, score``: mean |z| of a row's values against its neighbours' mean and deviation."""
    k = nbrs.groupBy("row").agg(F.count(F.lit(1)).alias("k"))
    s = nbrs.join(a.entries.select(F.col("row").alias("nbr"), "col", "v"), "nbr").groupBy("row", "col").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    j = a.entries.join(s, ["row", "col"], "left").join(k, "row")
    m = F.coalesce("s", F.lit(0.0)) / F.col("k")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0.0)) / F.col("k") - m * m))
    z = F.when(sd > 1e-10, F.abs(F.col("v") - m) / sd).otherwise(F.lit(0.0))
    return a.over_rows(j.groupBy("row").agg(F.avg(z).alias("score"))).select("row", F.coalesce("score", F.lit(0.0)).alias("score"))


def empty_drops(a: Matrix, fdr: float = 0.01, min_umi: float = 100, max_ambient: float = 10) -> DataFrame:
    """``row, empty``: rows whose counts do not differ from the ambient profile of the smallest rows
    (deviance against chi-squared, BH), and all rows under ``min_umi``."""
    from ..functions.special import chisq_sf
    from .testing import benjamini_hochberg

    t = a.over_rows(a.entries.groupBy("row").agg(F.sum("v").alias("t"), F.count(F.lit(1)).alias("k"))).select("row", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("k", F.lit(0)).alias("k"))
    amb = a.entries.join(t.where(F.col("t") <= max_ambient), "row", "left_semi").groupBy("col").agg(F.sum("v").alias("p"))
    prof = a.over_cols(amb).select("col", (F.coalesce("p", F.lit(0.0)) + 1).alias("p"))
    prof = prof.crossJoin(F.broadcast(prof.agg(F.sum("p").alias("pt")))).select("col", (F.col("p") / F.col("pt")).alias("p"))
    dev = a.entries.join(prof, "col").join(t, "row").groupBy("row").agg(F.max("t").alias("t"), F.max("k").alias("k"), (2 * F.sum(F.when(F.col("v") > 0, F.col("v") * F.log(F.col("v") / (F.col("t") * F.col("p")))))).alias("d"))
    p = dev.where(F.col("t") >= min_umi).select(F.col("row").alias("id"), chisq_sf(F.col("d"), F.greatest(F.col("k") - 1, F.lit(1)).cast("double")).alias("p"))
    q = benjamini_hochberg(p).select(F.col("id").alias("row"), "q")
    return t.join(q, "row", "left").select("row", F.coalesce(F.col("q") > fdr, F.lit(True)).alias("empty"))


# --- doublets ----------------------------------------------------------------


def knn_doublet_score(nbrs: DataFrame, synthetic: DataFrame) -> DataFrame:
    """``row, score``: share of synthetic rows (``row``) among the neighbours."""
    s = synthetic.select(F.col("row").alias("nbr"), F.lit(1.0).alias("s"))
    return nbrs.join(s, "nbr", "left").groupBy("row").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("score"))


def estimate_threshold(scores: DataFrame, rate: float) -> DataFrame:
    """``threshold``: the sorted score at index floor((1 - rate)(n - 1))."""
    from .testing import ordered

    o = ordered(scores.withColumn("p", F.col("score")))
    return o.where(F.col("rank") == F.floor((1 - rate) * (F.col("n") - 1)) + 1).select(F.col("score").alias("threshold"))


def call_doublets(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("id", (F.col("score") > threshold).alias("doublet"))


def bimodal_threshold(scores: DataFrame, n_bins: int = 50) -> DataFrame:
    """``threshold``: centre of the lowest histogram bin between the first peak and the next rise."""
    r = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    b = scores.crossJoin(F.broadcast(r)).withColumn("w", (F.col("hi") - F.col("lo")) / n_bins)
    bin_ = F.coalesce(F.least(F.lit(n_bins - 1), F.floor((F.col("score") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0))).cast("int")), F.lit(0))
    h = b.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("lo").alias("lo"), F.first("w").alias("w"))
    every = scores.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("b")).join(h.select("b", "c"), "b", "left").fillna(0, ["c"])
    w = Window.orderBy("b")
    peak = every.withColumn("up", F.col("c") >= F.coalesce(F.lead("c").over(w), F.lit(-1))).where("up and c > 0").agg(F.min("b").alias("peak"))
    after = every.crossJoin(F.broadcast(peak)).where("b > peak").withColumn("rise", F.coalesce(F.lead("c").over(w), F.lit(-1)) > F.col("c")).where("rise").agg(F.min("b").alias("valley"))
    edges = h.agg(F.first("lo").alias("lo"), F.first("w").alias("w"))
    return after.crossJoin(edges).select((F.col("lo") + (F.coalesce("valley", F.lit(n_bins // 2)) + 0.5) * F.col("w")).alias("threshold"))


def expected_doublets(n: int, rate: float = 0.06) -> int:
    return round(n * rate)


def doublet_rate(n_loaded: int, per_droplet: float = 0.05) -> float:
    return 2 * (n_loaded / 10000) * per_droplet


def multiplet_rate(n_recovered: int) -> float:
    return 0.008 * n_recovered / 1000


def doublet_types(nbrs: DataFrame, clusters: DataFrame, doublets: DataFrame) -> DataFrame:
    """``id, type``: 0 singlet; of doublets 1 (heterotypic) if a second cluster holds over 0.2 of the neighbours, else 2."""
    c = _neighbor_labels(nbrs, clusters, False).groupBy("row", "label").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("row")
    second = c.withColumn("_r", F.row_number().over(w.orderBy(F.desc("c"), "label"))).withColumn("_t", F.sum("c").over(w)).where("_r = 2").select(F.col("row").alias("id"), (F.col("c") / F.col("_t")).alias("s"))
    return doublets.join(second, "id", "left").select("id", F.when(~F.col("doublet"), 0).when(F.coalesce("s", F.lit(0.0)) > 0.2, 1).otherwise(2).alias("type"))


def density_score(nbrs: DataFrame) -> DataFrame:
    return nbrs.groupBy("row").agg((1 / F.greatest(F.avg("dist"), F.lit(1e-10))).alias("score"))


def variance_score(a: Matrix) -> DataFrame:
    """``row, score``: mean squared deviation of stored values from the column means."""
    m = col_moments(a).select("col", "mean")
    d = F.col("v") - F.col("mean")
    return a.over_rows(a.entries.join(m, "col").groupBy("row").agg(F.avg(d * d).alias("score"))).select("row", F.coalesce("score", F.lit(0.0)).alias("score"))


def combined_score(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``id, score``: weighted sum of columns scaled by their maxima."""
    top = scores.agg(*(F.max(c).alias("_" + c) for c in weights))
    s = sum((w * F.coalesce(F.col(c) / F.nullif(F.col("_" + c), F.lit(0.0)), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return scores.crossJoin(F.broadcast(top)).select("id", s.alias("score"))


def score_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.percentile("score", 0.5).alias("median"))


def cluster_doublets(scores: DataFrame) -> DataFrame:
    """``cluster, mean_score, share``: mean score and share above the overall mean, from ``id, score, cluster``."""
    g = scores.agg(F.avg("score").alias("g"))
    return scores.crossJoin(F.broadcast(g)).groupBy("cluster").agg(F.avg("score").alias("mean_score"), F.avg((F.col("score") > F.col("g")).cast("double")).alias("share"))
