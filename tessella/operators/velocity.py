"""Kinetics of two matrices (spliced s, unspliced u) and flow on a neighbour table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Graph, Matrix
from .matrix import col_moments


def fit_kinetics(s: Matrix, u: Matrix) -> DataFrame:
    """``col, gamma, r2``: least squares of u on s with an intercept, over all rows."""
    n = float(s.n_rows)
    a = col_moments(s, ddof=0).select("col", F.col("mean").alias("ms"), F.col("var").alias("vs"))
    b = col_moments(u, ddof=0).select("col", F.col("mean").alias("mu"), F.col("var").alias("vu"))
    d = s.entries.join(u.entries.withColumnRenamed("v", "w"), ["row", "col"]).groupBy("col").agg(F.sum(F.col("v") * F.col("w")).alias("xy"))
    j = a.join(b, "col").join(d, "col", "left")
    cov = F.coalesce("xy", F.lit(0.0)) / n - F.col("ms") * F.col("mu")
    slope = F.coalesce(cov / F.nullif(F.col("vs"), F.lit(0.0)), F.lit(0.0))
    r2 = F.coalesce(cov * cov / F.nullif(F.col("vs") * F.col("vu"), F.lit(0.0)), F.lit(0.0))
    return j.select("col", F.greatest(slope, F.lit(1e-10)).alias("gamma"), r2.alias("r2"))


def compute_velocity(s: Matrix, u: Matrix, gamma: DataFrame) -> DataFrame:
    """``row, col, v`` = u - gamma s where either is stored."""
    neg = s.entries.join(gamma.select("col", "gamma"), "col").select("row", "col", (-F.col("gamma") * F.col("v")).alias("v"))
    return u.entries.select("row", "col", "v").unionByName(neg).groupBy("row", "col").agg(F.sum("v").alias("v"))


def splice_ratio(s: Matrix, u: Matrix) -> DataFrame:
    """``row, col, ratio`` = u / (s + 1e-10) at unspliced entries."""
    return u.entries.join(s.entries.withColumnRenamed("v", "w"), ["row", "col"], "left").select("row", "col", (F.col("v") / (F.coalesce("w", F.lit(0.0)) + 1e-10)).alias("ratio"))


def select_velocity_genes(velocity: DataFrame, fit: DataFrame, n_rows: int, min_r2: float = 0.01, min_var: float = 0.0) -> DataFrame:
    m = velocity.groupBy("col").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    var = F.col("q") / n_rows - F.pow(F.col("s") / n_rows, F.lit(2.0))
    return m.join(fit, "col").where((F.col("r2") >= min_r2) & (var >= min_var)).select("col")


def _norms(v: DataFrame, name: str) -> DataFrame:
    return v.groupBy("row").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(name))


def velocity_graph(velocity: DataFrame, expression: DataFrame, nbrs: DataFrame) -> DataFrame:
    """``src, dst, w``: softmax over neighbours of max(0, cos(v_i, x_j - x_i))."""
    vn = _norms(velocity, "vn")
    vx = lambda key, name: nbrs.select("row", "nbr").join(velocity, "row").join(expression.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias("x")), (F.col("_r") == F.col(key)) & (F.col("col") == F.col("_c"))).groupBy("row", "nbr").agg(F.sum(F.col("v") * F.col("x")).alias(name))
    xx = expression.groupBy("row").agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    dot = nbrs.select("row", "nbr").join(expression, "row").join(expression.select(F.col("row").alias("nbr"), "col", F.col("v").alias("u")), ["nbr", "col"]).groupBy("row", "nbr").agg(F.sum(F.col("v") * F.col("u")).alias("xy"))
    j = nbrs.select("row", "nbr").join(vx("nbr", "a"), ["row", "nbr"], "left").join(vx("row", "b"), ["row", "nbr"], "left").join(vn, "row", "left").join(xx, "row", "left").join(xx.select(F.col("row").alias("nbr"), F.col("q").alias("q2")), "nbr", "left").join(dot, ["row", "nbr"], "left").fillna(0.0)
    dn = F.sqrt(F.greatest(F.lit(0.0), F.col("q") + F.col("q2") - 2 * F.col("xy")))
    c = F.greatest(F.lit(0.0), F.coalesce((F.col("a") - F.col("b")) / F.nullif(F.col("vn") * dn, F.lit(0.0)), F.lit(0.0)))
    w = Window.partitionBy("row")
    e = j.withColumn("c", c).withColumn("e", F.exp(F.col("c") - F.max("c").over(w)))
    return e.select(F.col("row").alias("src"), F.col("nbr").alias("dst"), (F.col("e") / F.sum("e").over(w)).alias("w"))


def _cosines(velocity: DataFrame, nbrs: DataFrame) -> DataFrame:
    n = _norms(velocity, "n1")
    d = nbrs.select("row", "nbr").join(velocity, "row").join(velocity.select(F.col("row").alias("nbr"), "col", F.col("v").alias("u")), ["nbr", "col"]).groupBy("row", "nbr").agg(F.sum(F.col("v") * F.col("u")).alias("d"))
    j = nbrs.select("row", "nbr").join(d, ["row", "nbr"], "left").join(n, "row", "left").join(n.select(F.col("row").alias("nbr"), F.col("n1").alias("n2")), "nbr", "left")
    return j.select("row", "nbr", F.coalesce(F.col("d") / F.nullif(F.col("n1") * F.col("n2"), F.lit(0.0)), F.lit(0.0)).alias("c"))


def velocity_graph_cosine(velocity: DataFrame, nbrs: DataFrame) -> DataFrame:
    c = _cosines(velocity, nbrs).withColumn("c", (F.col("c") + 1) / 2)
    return c.select(F.col("row").alias("src"), F.col("nbr").alias("dst"), (F.col("c") / F.sum("c").over(Window.partitionBy("row"))).alias("w"))


def velocity_confidence(velocity: DataFrame, nbrs: DataFrame) -> DataFrame:
    return _cosines(velocity, nbrs).groupBy("row").agg(F.avg("c").alias("confidence"))


def velocity_embedding(embedding: DataFrame, nbrs: DataFrame) -> DataFrame:
    """``row, dim, x``: mean displacement to the neighbours (``row, dim, x``)."""
    j = nbrs.select("row", "nbr").join(embedding, "row").join(embedding.select(F.col("row").alias("nbr"), "dim", F.col("x").alias("o")), ["nbr", "dim"])
    return j.groupBy("row", "dim").agg(F.avg(F.col("o") - F.col("x")).alias("x"))


def velocity_grid(points: DataFrame, flow: DataFrame, size: int) -> DataFrame:
    """``gx, gy, vx, vy, n``: mean flow (``id, vx, vy``) in the cells of a grid."""
    b = points.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    cell = lambda c: F.coalesce(F.least(F.lit(size - 1), F.floor((F.col(c) - F.col("lo" + c)) / F.nullif((F.col("hi" + c) - F.col("lo" + c)) / size, F.lit(0.0))).cast("int")), F.lit(0))
    return points.crossJoin(F.broadcast(b)).join(flow, "id").groupBy(cell("x").alias("gx"), cell("y").alias("gy")).agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), F.count(F.lit(1)).alias("n"))


def velocity_divergence(points: DataFrame, flow: DataFrame, nbrs: DataFrame) -> DataFrame:
    """``row, divergence``: mean over neighbours of the velocity change along the direction, by distance."""
    p = points.join(flow, "id")
    j = nbrs.select("row", "nbr").join(p.select(F.col("id").alias("row"), "x", "y", "vx", "vy"), "row").join(p.select(F.col("id").alias("nbr"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("vx").alias("vx2"), F.col("vy").alias("vy2")), "nbr")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    d = ((F.col("vx2") - F.col("vx")) * dx + (F.col("vy2") - F.col("vy")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return j.groupBy("row").agg(F.coalesce(F.avg(d), F.lit(0.0)).alias("divergence"))


def select_root_by_velocity(g: Graph) -> DataFrame:
    i = g.over_nodes(g.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("s"))).select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
    return i.orderBy("s", "id").limit(1).select("id")


def latent_time(g: Graph, root: int) -> DataFrame:
    """``id, t``: least -log p from the root, over the largest; 1 out of reach."""
    from .graphs import graph_pseudotime

    e = g.edges.where("w > 0").select("src", "dst", F.greatest(-F.log("w"), F.lit(1e-12)).alias("w"))
    return graph_pseudotime(Graph(e, g.nodes), root)


def fate_probability(g: Graph, terminals: list[int], max_iter: int = 100) -> DataFrame:
    from .graphs import absorption_probability

    return absorption_probability(g, terminals, max_iter)


def predict_future(g: Graph, n_steps: int) -> DataFrame:
    """``id, col, x``: rows of T^n."""
    from ..loops import iterate

    start = g.nodes.select("id", F.col("id").alias("col"), F.lit(1.0).alias("x"))
    return iterate(start, lambda s: g.edges.select(F.col("src").alias("id"), F.col("dst").alias("mid"), "w").join(s.select(F.col("id").alias("mid"), "col", "x"), "mid").groupBy("id", "col").agg(F.sum(F.col("w") * F.col("x")).alias("x")), n_steps)


def velocity_pseudotime(g: Graph, root: int, n_iter: int = 10) -> DataFrame:
    """Latent time smoothed over neighbours, scaled to 0..1."""
    from .graphs import smooth_pseudotime

    s = smooth_pseudotime(g, latent_time(g, root), n_iter)
    b = s.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return s.crossJoin(F.broadcast(b)).select("id", F.coalesce((F.col("t") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)).alias("t"))


def velocity_terminals(g: Graph, magnitude: DataFrame, low: float = 0.2, outgoing: float = 0.5) -> DataFrame:
    """``id`` of nodes whose magnitude is in the low share and whose outgoing mass to others is under ``outgoing``."""
    out = g.edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("o"))
    top = magnitude.agg(F.max("value").alias("m"))
    return magnitude.join(out, "id", "left").crossJoin(F.broadcast(top)).where((F.col("value") <= low * F.col("m")) & (F.coalesce("o", F.lit(0.0)) < outgoing)).select("id")


def lineage_drivers(a: Matrix, fate: DataFrame) -> DataFrame:
    """``col, r``: correlation of columns with a fate probability (``row, y``)."""
    from .matrix import pearson_with

    return pearson_with(a, fate)


def velocity_stream(points: DataFrame, flow: DataFrame, start: int, max_steps: int, step: float) -> DataFrame:
    """``step, x, y``: a streamline from a point, each step along the velocity of the nearest point;
    a step is one aggregate over all points, and only its position reaches the driver."""
    p = cut(points.join(flow, "id"))
    row = p.where(F.col("id") == start).select("x", "y").first()
    trace = [(0, row["x"], row["y"])] if row else []
    for i in range(max_steps if row else 0):
        x, y = trace[-1][1:]
        d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
        v = p.agg(F.min(F.struct(d.alias("d"), "id", "vx", "vy")).alias("b")).first()["b"]
        if v["vx"] * v["vx"] + v["vy"] * v["vy"] < 1e-24:
            break
        trace.append((i + 1, x + step * v["vx"], y + step * v["vy"]))
    return points.sparkSession.createDataFrame(trace, "step int, x double, y double")
