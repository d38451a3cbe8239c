"""Seeded randomness by hashes: projections, sampling, resampling, permutation tests.

A random number is a hash of ids and a seed, so results do not depend on the
partitioning and a retried task draws the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Matrix


def uniform(*cols, seed: int = 0) -> Column:
    """A number in (0, 1)."""
    return (F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*cols, seed: int = 0) -> Column:
    """Box and Muller's normal deviate from two hashes."""
    return F.sqrt(-2 * F.log(uniform(*cols, seed=seed))) * F.cos(2 * math.pi * uniform(*cols, seed=seed + 7919))


# --- projections -------------------------------------------------------------


def projection_matrix(cols: DataFrame, k: int, kind: str = "gaussian", density: float | None = None, seed: int = 0) -> DataFrame:
    """``col, k, r``: Gaussian, Achlioptas or sparse signs, scaled to keep norms in expectation."""
    d = cols.select("col", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    u = uniform("col", "k", seed=seed)
    if kind == "gaussian":
        return d.select("col", "k", (normal("col", "k", seed=seed) / math.sqrt(k)).alias("r"))
    s = 1 / 3 if kind == "achlioptas" else density
    sign = F.when(u < s / 2, 1.0).when(u < s, -1.0).otherwise(0.0) * math.sqrt(1 / (s * k))
    return d.select("col", "k", sign.alias("r")).where("r <> 0")


def project(a: Matrix, k: int, kind: str = "sparse", seed: int = 0) -> DataFrame:
    """``row, k, y`` = X R; R is made from hashes beside the entries, so it is never shuffled."""
    if kind == "countsketch":
        return countsketch(a, k, seed)
    if kind == "feature_hash":
        return feature_hash(a, k, seed=seed)
    density = min(0.5, max(0.01, 1 / math.sqrt(max(a.n_cols, 1))))
    u = uniform("col", "k", seed=seed)
    e = a.entries.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    if kind == "gaussian":
        r = normal("col", "k", seed=seed) / math.sqrt(k)
    else:
        s = 1 / 3 if kind == "achlioptas" else density
        r = F.when(u < s / 2, 1.0).when(u < s, -1.0).otherwise(0.0) * math.sqrt(1 / (s * k))
    return e.groupBy("row", "k").agg(F.sum(F.col("v") * r).alias("y"))


def project_with(a: Matrix, r: DataFrame) -> DataFrame:
    return a.entries.join(r, "col").groupBy("row", "k").agg(F.sum(F.col("v") * F.col("r")).alias("y"))


def countsketch(a: Matrix, k: int, seed: int = 0) -> DataFrame:
    bucket = F.pmod(F.xxhash64("col", F.lit(seed)), F.lit(k)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("col", F.lit(seed + 1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return a.entries.groupBy("row", bucket.alias("k")).agg(F.sum(F.col("v") * sign).alias("y"))


def feature_hash(a: Matrix, k: int, n_hashes: int = 3, seed: int = 0) -> DataFrame:
    e = a.entries.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(n_hashes - 1))))
    bucket = F.pmod(F.xxhash64("col", "h", F.lit(seed)), F.lit(k)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("col", "h", F.lit(seed + 1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return e.groupBy("row", bucket.alias("k")).agg((F.sum(F.col("v") * sign) / math.sqrt(n_hashes)).alias("y"))


def project_auto(a: Matrix, k: int, seed: int = 0) -> DataFrame:
    return project(a, k, recommend_projection(a.n_cols, k), seed)


def recommend_projection(n_cols: int, k: int) -> str:
    if k <= 64:
        return "countsketch"
    return "sparse" if n_cols > 100_000 or k < 512 else "achlioptas"


def jl_dimension(n: int, eps: float = 0.1) -> int:
    return math.ceil(4 * math.log(n) / (eps * eps / 2 - eps**3 / 3))


# --- samples -----------------------------------------------------------------


def uniform_sample(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n ids without replacement: the smallest hashes (a distributed top-n)."""
    return ids.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def weighted_sample(weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n ids without replacement with odds by weight: the smallest -log(u) / w."""
    return weights.where("w > 0").orderBy(-F.log(uniform("id", seed=seed)) / F.col("w"), "id").limit(n).select("id")


def importance_sample(weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``draw, id``: n draws with replacement by weight. Draws find their interval of the cumulated
    weight within blocks of ids, so no task holds all."""
    return _systematic(weights, n, lambda i: uniform(i, seed=seed))


def systematic_sample(weights: DataFrame, n: int) -> DataFrame:
    """``draw, id``: draws at even steps of the cumulated weight; no randomness."""
    return _systematic(weights, n, lambda i: (i + 0.5) / n)


def _systematic(weights: DataFrame, n: int, at) -> DataFrame:
    b = weights.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(64, -(-weights.count() // 1_000_000)))))
    blocks = b.groupBy("_b").agg(F.sum("w").alias("t"))
    off = blocks.select("_b", "t", F.coalesce(F.sum("t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("o"), F.sum("t").over(Window.partitionBy()).alias("all"))
    d = weights.sparkSession.range(n).select(F.col("id").alias("draw"), at(F.col("id")).alias("u"))
    d = d.crossJoin(F.broadcast(off)).withColumn("x", F.col("u") * F.col("all")).where("x >= o and x < o + t").select("draw", "_b", (F.col("x") - F.col("o")).alias("x"))
    start = F.coalesce(F.sum("w").over(Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # Starts of intervals and draws in one order: a draw belongs to the last start before it.
    c = b.where("w > 0").select("_b", start.alias("x"), F.lit(0).alias("k"), "id", F.lit(None).cast("long").alias("draw"))
    both = c.unionByName(d.select("_b", "x", F.lit(1).alias("k"), F.lit(None).cast(c.schema["id"].dataType).alias("id"), "draw"))
    last = F.last("id", ignorenulls=True).over(Window.partitionBy("_b").orderBy("x", "k", "id").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("id", last).where("k = 1").select("draw", "id")


def balanced_sample(labels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``id, label``: equal numbers of every label (the first by hash)."""
    k = max(1, n // max(1, labels.select("label").distinct().count()))
    w = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return labels.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("id", "label")


def stratified_sample(values: DataFrame, n_strata: int, n: int, seed: int = 0) -> DataFrame:
    from .information import equal_width

    s = equal_width(values.select("id", F.col("value").alias("x")), n_strata).select("id", F.col("bin").alias("label"))
    return balanced_sample(s, n, seed)


def geometric_sketch(points: DataFrame, n: int, bins: int = 64, seed: int = 0) -> DataFrame:
    """``id``: equal draws of occupied grid cells of ``id, dim, x``."""
    b = points.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    c = points.join(F.broadcast(b), "dim").select("id", "dim", F.coalesce(F.floor((F.col("x") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(0)).alias("c"))
    cell = c.groupBy("id").agg(F.hash(F.array_sort(F.collect_list(F.struct("dim", "c")))).alias("label"))
    w = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return cell.withColumn("_r", F.row_number().over(w)).orderBy("_r", F.xxhash64("id", F.lit(seed)), "id").limit(n).select("id")


def density_preserving(degrees: DataFrame, n: int) -> DataFrame:
    """Systematic sample with weights 1 / (degree + 1)."""
    return systematic_sample(degrees.select("id", (1 / (F.col("degree") + 1.0)).alias("w")), n)


def landmarks(x: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``id``: k-means++ seeding of ``id, dim, x``: rows drawn with odds of their squared distance to those drawn."""
    from ..loops import cut

    x = cut(x)
    got = cut(x.select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1))
    near = None
    last = got
    for i in range(1, n):
        c = x.join(F.broadcast(last), "id").select("dim", F.col("x").alias("m"))
        d = F.col("x") - F.col("m")
        new = x.join(F.broadcast(c), "dim").groupBy("id").agg(F.sum(d * d).alias("d"))
        near = cut(new if near is None else near.join(new.withColumnRenamed("d", "e"), "id").select("id", F.least("d", "e").alias("d")))
        last = cut(near.where("d > 0").orderBy(-F.log(uniform("id", seed=seed + i)) / F.col("d"), "id").limit(1).select("id"))
        got = got.unionByName(last)
    return got


def reservoir_sample(stream: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of a stream read so far: the n smallest hashes, which merge over batches."""
    return uniform_sample(stream, n, seed)


# --- resampling --------------------------------------------------------------


def binomial_resample(a: Matrix, p: Column | float, seed: int = 0) -> Matrix:
    """Binomial(v, p) of integer entries: one hash a unit up to 64 units, a rounded normal beyond."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    n = F.round("v").cast("int")
    few = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + ((i <= n) & (uniform("row", "col", i, seed=seed) < p)).cast("int"))
    many = F.greatest(F.lit(0), F.least(n, F.round(n * p + F.sqrt(n * p * (1 - p)) * normal("row", "col", seed=seed)).cast("int")))
    return a.with_entries(a.entries.withColumn("v", F.when(n <= 64, few).otherwise(many).cast("double")).where("v > 0").select("row", "col", "v"))


def poisson_resample(a: Matrix, lam: float, seed: int = 0) -> Matrix:
    """Poisson(lam v): by inversion up to a mean of 30, a rounded normal beyond."""
    m = F.col("v") * lam
    many = F.greatest(F.lit(0), F.round(m + F.sqrt(m) * normal("row", "col", seed=seed)).cast("int")).cast("double")
    d = a.entries.select("row", "col", F.when(m > 30, many).alias("v"), m.cast("double").alias("_m"), uniform("row", "col", seed=seed).alias("_u"), F.exp(-m).alias("_p"))
    kinds = ", ".join(f"{c} {a.entries.schema[c].dataType.simpleString()}" for c in ("row", "col"))
    return a.with_entries(d.mapInArrow(_inverted, f"{kinds}, v double").where("v > 0"))


def _inverted(batches):
    """Fills ``v`` where it is null: the first k whose cumulated probability is above ``_u`` (100 at most)."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        v, m, u, p = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("v", "_m", "_u", "_p"))
        at = np.flatnonzero(np.isnan(v) & ~np.isnan(m))
        v[at] = 0.0
        m, u, p = m[at], u[at], p[at]
        c = p.copy()
        for k in range(1, 101):
            go = ~(u < c)
            at, m, u, p, c = at[go], m[go], u[go], p[go], c[go]
            if not len(at):
                break
            p = p * m / k
            c = c + p
            v[at] = k
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, from_pandas=True)], names=["row", "col", "v"])


def downsample(a: Matrix, target: float | DataFrame, seed: int = 0) -> Matrix:
    """Rows thinned to a total (or ``row, target``): binomial with p = target / total, 1 at most."""
    t = a.entries.groupBy("row").agg(F.sum("v").alias("_t"))
    e = a.entries.join(t, "row")
    e = e.withColumn("_g", F.lit(float(target))) if not isinstance(target, DataFrame) else e.join(target.select("row", F.col("target").alias("_g")), "row")
    p = F.least(F.lit(1.0), F.col("_g") / F.col("_t"))
    return a.with_entries(binomial_resample(Matrix(e, a.rows, a.cols), p, seed).entries)


def rarefaction(clones: DataFrame, size: int, n_iter: int, seed: int = 0) -> DataFrame:
    """``mean, std`` of the Shannon diversity of subsamples of ``size`` rows. A row is in a subsample if a
    keyed permutation takes its place below ``size``, so batches count by themselves and no order is made."""
    import pandas as pd

    from .information import count_entropy_agg
    from .permute import permuted
    from .testing import positions

    rows = clones.where("clone >= 0").select("id", "clone")
    at = positions(rows.select("id"))
    n = rows.count()

    def run(batches):
        for pdf in batches:
            for it in range(n_iter):
                c = pdf.clone[permuted(pdf.pos.to_numpy(), n, (seed << 32) ^ (it + 1)) < size].value_counts()
                yield pd.DataFrame({"it": it, "clone": c.index.astype("int64"), "c": c.to_numpy()})

    some = rows.join(at, "id").select("pos", F.col("clone").cast("long").alias("clone")).mapInPandas(run, "it int, clone long, c long")
    h = some.groupBy("it", "clone").agg(F.sum("c").alias("c")).groupBy("it").agg(count_entropy_agg(F.col("c")).alias("h"))
    return h.agg(F.avg("h").alias("mean"), F.stddev_pop("h").alias("std"))


# --- permutation tests -------------------------------------------------------


def permuted_groups(groups: DataFrame, n_perm: int, seed: int = 0) -> DataFrame:
    """``perm, row, grp``: the groups' labels dealt anew, sizes kept: a row takes the label at the place to
    which a keyed permutation sends its own."""
    import pandas as pd

    from ..loops import cut
    from .permute import permuted
    from .testing import positions

    at = cut(groups.join(positions(groups.select(F.col("row").alias("id"))).withColumnRenamed("id", "row"), "row").select("row", "grp", F.col("pos").cast("long").alias("pos")))
    n, kind = at.count(), groups.schema["row"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for k in range(n_perm):
                yield pd.DataFrame({"perm": k, "row": pdf.row, "pos": permuted(pdf.pos.to_numpy(), n, (seed << 32) ^ (k + 1))})

    to = at.select("row", "pos").mapInPandas(run, f"perm long, row {kind}, pos long")
    return to.join(at.select("pos", "grp"), "pos").select("perm", "row", "grp")


def permutation_test(a: Matrix, groups: DataFrame, n_perm: int = 100, seed: int = 0) -> DataFrame:
    """``col, diff, p``: |difference of group means| (1 less 0) against permuted labels."""

    def diff(e: DataFrame, keys: list[str]) -> DataFrame:
        return e.groupBy(*keys).agg((F.sum(F.when(F.col("grp") == 1, F.col("v") / F.col("n1")).otherwise(-F.col("v") / F.col("n0")))).alias("d"))

    n = groups.agg(*(F.sum((F.col("grp") == k).cast("double")).alias(f"n{k}") for k in (0, 1)))
    e = a.entries.crossJoin(F.broadcast(n))
    obs = a.over_cols(diff(e.join(groups, "row"), ["col"])).select("col", F.coalesce("d", F.lit(0.0)).alias("diff"))
    null = diff(e.join(permuted_groups(groups, n_perm, seed), "row"), ["col", "perm"])
    x = obs.join(null, "col").groupBy("col").agg(F.sum((F.abs("d") >= F.abs("diff") - 1e-12).cast("int")).alias("x"))
    return obs.join(x, "col", "left").select("col", "diff", ((F.coalesce("x", F.lit(0)) + 1) / (n_perm + 1)).alias("p"))


def permutation_correlation(xy: DataFrame, n_perm: int = 100, seed: int = 0) -> DataFrame:
    """``r, p`` of ``id, x, y``: |r| against y dealt anew."""
    obs = xy.agg(F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("r"))
    g = permuted_groups(xy.select(F.col("id").alias("row"), F.col("y").alias("grp")), n_perm, seed)
    null = g.join(xy.select(F.col("id").alias("row"), "x"), "row").groupBy("perm").agg(F.coalesce(F.corr("x", "grp"), F.lit(0.0)).alias("nr"))
    return obs.crossJoin(null).groupBy("r").agg(((F.sum((F.abs("nr") >= F.abs("r")).cast("int")) + 1) / (n_perm + 1)).alias("p"))


def random_walks(edges: DataFrame, starts: DataFrame, n_steps: int, seed: int = 0) -> DataFrame:
    """``walk, step, id``: walks from ``walk, id``, next nodes drawn by weight with seeded hashes."""
    from ..loops import cut

    now = cut(starts.select("walk", "id"))
    out = now.withColumn("step", F.lit(0))
    for s in range(1, n_steps + 1):
        key = -F.log(uniform("walk", "dst", F.lit(s), seed=seed)) / F.col("w")
        w = Window.partitionBy("walk").orderBy(key, "dst")
        nxt = now.join(edges.select(F.col("src").alias("id"), "dst", "w"), "id").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("walk", F.col("dst").alias("id"))
        now = cut(nxt)
        out = out.unionByName(now.withColumn("step", F.lit(s)))
    return out


def visit_frequency(edges: DataFrame, nodes: DataFrame, n_walks: int, length: int, seed: int = 0) -> DataFrame:
    """``id, frequency`` of visits by uniform walks (a stand-in for current-flow betweenness)."""
    starts = uniform_sample(nodes, n_walks, seed).withColumn("walk", F.col("id"))
    v = random_walks(edges.withColumn("w", F.lit(1.0)), starts, length, seed)
    t = v.agg(F.count(F.lit(1)).alias("t"))
    c = v.groupBy("id").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(t)).select("id", (F.col("c") / F.col("t")).alias("frequency"))
    return nodes.join(c, "id", "left").select("id", F.coalesce("frequency", F.lit(0.0)).alias("frequency"))
