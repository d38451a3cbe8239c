"""Spatial statistics on weighted graphs (``src, dst, w``) and on coordinates (``id, x, y``)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import two_sided
from ..loops import cut
from ..model import Graph, Matrix

# --- weights -----------------------------------------------------------------


def row_standardize(g: Graph) -> DataFrame:
    t = F.sum("w").over(Window.partitionBy("src"))
    return g.edges.select("src", "dst", F.coalesce(F.col("w") / F.nullif(t, F.lit(0.0)), F.lit(0.0)).alias("w"))


def distance_band(points: DataFrame, d: float) -> DataFrame:
    """``src, dst, w = 1`` of points within d: an equi-join on grid cells of side d."""
    cell = lambda c: F.floor(F.col(c) / d)
    a = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = a.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), near.alias("c")).select("dst", "x2", "y2", "c.cx", "c.cy")
    dist2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    return a.join(b, ["cx", "cy"]).where("id <> dst").where(dist2 <= d * d).select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("w"), F.sqrt(dist2).alias("dist"))


def knn_weights(points: DataFrame, k: int, cells: int = 16) -> DataFrame:
    """``src, dst, w = 1, dist`` of the k nearest points, exact.

    Points look in grid cells of growing radius; one is done when its k-th distance is covered by
    the cells it has seen. Each round joins only those not done, on the cell."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    n = box["n"] or 0
    if n < 2:
        return points.sparkSession.createDataFrame([], "src long, dst long, w double, dist double")
    span = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-12)
    side = span / max(1, min(cells * 64, int(math.sqrt(n / (2 * k + 1)))))
    cell = lambda c, o: F.floor((F.col(c) - o) / side).cast("long")
    a = points.select("id", "x", "y", cell("x", box["x0"]).alias("cx"), cell("y", box["y0"]).alias("cy"))
    b = a.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
    open_, out, reach, want = a, None, 1, min(k, n - 1)
    most = int(span / side) + 2
    while True:
        r = min(reach, most)
        look = open_.withColumn("ax", F.explode(F.sequence(F.col("cx") - r, F.col("cx") + r))).withColumn("ay", F.explode(F.sequence(F.col("cy") - r, F.col("cy") + r)))
        look = look.select("id", "x", "y", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("ax").alias("cx"), F.col("ay").alias("cy"))
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        j = look.join(b, ["cx", "cy"]).where("id <> dst").withColumn("dist", F.sqrt(dx * dx + dy * dy))
        j = j.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "dst"))).where(F.col("rank") <= want)
        edge = F.least(F.col("x") - (box["x0"] + (F.col("ox") - r) * side), box["x0"] + (F.col("ox") + r + 1) * side - F.col("x"), F.col("y") - (box["y0"] + (F.col("oy") - r) * side), box["y0"] + (F.col("oy") + r + 1) * side - F.col("y"))
        j = j.withColumn("safe", (F.max("rank").over(Window.partitionBy("id")) == want) & (F.max("dist").over(Window.partitionBy("id")) <= edge))
        j = cut(j if r < most else j.withColumn("safe", F.lit(True)))
        done = j.where("safe").select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("w"), "dist")
        out = done if out is None else out.unionByName(done)
        open_ = cut(open_.join(j.where("safe").select("id").distinct(), "id", "left_anti"))
        if r >= most or open_.isEmpty():
            return out
        reach *= 2


# --- autocorrelation ---------------------------------------------------------


def _centered(values: DataFrame) -> DataFrame:
    """``id, z, m2``: centred values and their mean square."""
    m = values.agg(F.avg("value").alias("mu"), F.var_pop("value").alias("m2"), F.count(F.lit(1)).alias("n"))
    return values.crossJoin(F.broadcast(m)).select("id", (F.col("value") - F.col("mu")).alias("z"), "m2", "n")


def _with_ends(g: Graph, z: DataFrame) -> DataFrame:
    return g.edges.join(z.select(F.col("id").alias("src"), F.col("z").alias("zi"), "m2", "n"), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("zj")), "dst")


def spatial_lag(g: Graph, values: DataFrame) -> DataFrame:
    """``id, lag``: weighted neighbour mean, 0 for isolated nodes."""
    s = g.edges.join(values.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("lag"))
    return g.over_nodes(s).select("id", F.coalesce("lag", F.lit(0.0)).alias("lag"))


def global_morans_i(g: Graph, values: DataFrame, textbook: bool = True) -> DataFrame:
    """``i, z, p`` under randomisation without the kurtosis term (normality variance)."""
    e = _with_ends(g, _centered(values))
    s = e.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("s0"), F.max("m2").alias("m2"), F.max("n").cast("double").alias("n"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    if textbook:
        both = g.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("t"))
        s1 = both.agg(F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("t") * F.col("t")).otherwise(F.col("t") * F.col("t"))).alias("s1"))
        ends = g.edges.select(F.col("src").alias("id"), "w").unionByName(g.edges.select(F.col("dst").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("t"))
    else:
        s1 = g.edges.agg(F.sum(F.col("w") * F.col("w")).alias("s1"))
        ends = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("t"))
    s2 = ends.agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    r = s.crossJoin(s1).crossJoin(s2)
    i = F.coalesce(F.col("num") / F.nullif(F.col("s0") * F.col("m2"), F.lit(0.0)), F.lit(0.0))
    ex, n, s0 = -1 / (F.col("n") - 1), F.col("n"), F.col("s0")
    var = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - ex * ex
    z = F.when(var > 0, (i - ex) / F.sqrt(var)).otherwise(F.lit(0.0))
    return r.select(i.alias("i"), z.alias("z")).withColumn("p", two_sided(F.col("z")))


def global_gearys_c(g: Graph, values: DataFrame) -> DataFrame:
    """``c, z, p``; variance 1 / (2 (n + 1)) ((2 S1 + S2)(n - 1) - 4 S0^2) / S0^2 with S1 = 2 sum w^2."""
    e = _with_ends(g, _centered(values))
    d = F.col("zi") - F.col("zj")
    s = e.agg(F.sum(F.col("w") * d * d).alias("num"), F.sum("w").alias("s0"), F.max("m2").alias("m2"), F.max("n").cast("double").alias("n"), (2 * F.sum(F.col("w") * F.col("w"))).alias("s1"))
    ends = g.edges.select(F.col("src").alias("id"), "w").unionByName(g.edges.select(F.col("dst").alias("id"), "w")).groupBy("id").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    n, s0 = F.col("n"), F.col("s0")
    c = F.coalesce((n - 1) * F.col("num") / F.nullif(2 * s0 * n * F.col("m2"), F.lit(0.0)), F.lit(0.0))
    var = ((2 * F.col("s1") + F.col("s2")) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)
    z = F.when(var > 0, (1 - c) / F.sqrt(var)).otherwise(F.lit(0.0))
    return s.crossJoin(ends).select(c.alias("c"), z.alias("z")).withColumn("p", two_sided(F.col("z")))


def autocorrelation_summary(g: Graph, values: DataFrame) -> DataFrame:
    m = global_morans_i(g, values).select(F.col("i").alias("moran_i"), F.col("p").alias("moran_p"))
    return m.crossJoin(global_gearys_c(g, values).select(F.col("c").alias("geary_c"), F.col("p").alias("geary_p")))


def local_morans_i(g: Graph, values: DataFrame) -> DataFrame:
    """``id, i, z, p``: z_i / m2 * sum w z_j with the variance under randomisation of the row's weights."""
    c = _centered(values)
    s = _with_ends(g, c).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("zj")).alias("lag"), F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    d = c.join(s, "id", "left").fillna(0.0, ["lag", "w1", "w2"])
    i = F.coalesce(F.col("z") * F.col("lag") / F.nullif(F.col("m2"), F.lit(0.0)), F.lit(0.0))
    n = F.col("n").cast("double")
    ex = -F.col("w1") / (n - 1)
    zi = F.col("z") * F.col("z") / F.nullif(F.col("m2"), F.lit(0.0))
    var = zi * n / ((n - 1) * (n - 1)) * (F.col("w2") - F.col("w1") * F.col("w1") / (n - 1))
    zz = F.when(var > 1e-15, (i + zi * F.col("w1") / (n - 1)) / F.sqrt(var)).otherwise(F.lit(0.0))
    del ex
    return d.select("id", i.alias("i"), zz.alias("z")).withColumn("p", two_sided(F.col("z")))


def local_morans_by_column(g: Graph, x: DataFrame) -> DataFrame:
    """``id, dim, i``: the local statistic of every column of ``id, dim, x``."""
    m = x.groupBy("dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("m2"))
    z = x.join(F.broadcast(m), "dim").select("id", "dim", (F.col("x") - F.col("m")).alias("z"), "m2")
    j = g.edges.join(z.select(F.col("id").alias("dst"), "dim", F.col("z").alias("zj")), "dst").groupBy(F.col("src").alias("id"), "dim").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    return j.join(z, ["id", "dim"]).select("id", "dim", F.coalesce(F.col("z") * F.col("lag") / F.nullif(F.col("m2"), F.lit(0.0)), F.lit(0.0)).alias("i"))


def most_variable(x: DataFrame, n: int) -> DataFrame:
    """``id, dim, x`` of the n columns of largest variance."""
    top = x.groupBy("dim").agg(F.var_pop("x").alias("_v")).orderBy(F.desc("_v"), "dim").limit(n).select("dim")
    return x.join(F.broadcast(top), "dim").select("id", "dim", "x")


def local_gearys_c(g: Graph, values: DataFrame) -> DataFrame:
    """``id, c``: sum w (x_i - x_j)^2 / m2."""
    d = F.col("zi") - F.col("zj")
    s = _with_ends(g, _centered(values)).groupBy(F.col("src").alias("id")).agg((F.sum(F.col("w") * d * d) / F.nullif(F.max("m2"), F.lit(0.0))).alias("c"))
    return g.over_nodes(s).select("id", F.coalesce("c", F.lit(0.0)).alias("c"))


def moran_scatter(g: Graph, values: DataFrame) -> DataFrame:
    """``id, x, lag``: standardised value and the weighted mean of the neighbours'."""
    std = _centered(values).select("id", F.coalesce(F.col("z") / F.nullif(F.sqrt("m2"), F.lit(0.0)), F.lit(0.0)).alias("value"))
    return std.select("id", F.col("value").alias("x")).join(spatial_lag(g, std), "id")


def lisa_patterns(g: Graph, values: DataFrame, p_values: DataFrame, level: float = 0.05) -> DataFrame:
    """``id, pattern``: 0 not significant, 1 high-high, 2 low-low, 3 high-low, 4 low-high."""
    d = moran_scatter(g, values).join(p_values, "id")
    hx, hl = F.col("x") > 0, F.col("lag") > 0
    return d.select("id", F.when(F.col("p") >= level, 0).when(hx & hl, 1).when(~hx & ~hl, 2).when(hx, 3).otherwise(4).alias("pattern"))


def getis_ord(g: Graph, values: DataFrame, include_self: bool = True) -> DataFrame:
    """``id, g, z, p``: G* (weighted mean of neighbours and self) with its z score."""
    e = g.edges.select("src", "dst", "w")
    if include_self:
        e = e.unionByName(g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    m = values.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("t"))
    s = e.join(values.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("wx"), F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    d = g.over_nodes(s).fillna(0.0).crossJoin(F.broadcast(m))
    den = F.col("sd") * F.sqrt(F.greatest(F.lit(0.0), (F.col("n") * F.col("w2") - F.col("w1") * F.col("w1")) / (F.col("n") - 1)))
    z = F.coalesce((F.col("wx") - F.col("mu") * F.col("w1")) / F.nullif(den, F.lit(0.0)), F.lit(0.0))
    return d.select("id", F.coalesce(F.col("wx") / F.nullif(F.col("w1"), F.lit(0.0)), F.lit(0.0)).alias("g"), z.alias("z")).withColumn("p", two_sided(F.col("z")))


def confidence_level(z: Column) -> Column:
    """Signed level 0 to 3 by the critical values 1.96, 2.576 and 3.291."""
    a = F.abs(z)
    level = (a >= 1.96).cast("int") + (a >= 2.576).cast("int") + (a >= 3.291).cast("int")
    return F.when(z < 0, -level).otherwise(level)


def hotspots(z: DataFrame, level: float = 0.05) -> DataFrame:
    """``id, kind``: 1 hot, -1 cold, 0 neither."""
    crit = 3.291 if level <= 0.001 else 2.576 if level <= 0.01 else 1.96
    return z.select("id", F.when(F.col("z") >= crit, 1).when(F.col("z") <= -crit, -1).otherwise(0).alias("kind"))


def confidence_bins(z: DataFrame) -> DataFrame:
    return z.select("id", confidence_level(F.col("z")).alias("bin"))


def count_kinds(d: DataFrame, name: str) -> DataFrame:
    return d.groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def bivariate_local_i(g: Graph, x: DataFrame, y: DataFrame) -> DataFrame:
    """``id, i``: standardised x times the weighted sum of standardised y of the neighbours."""
    std = lambda v: _centered(v).select("id", F.coalesce(F.col("z") / F.nullif(F.sqrt("m2"), F.lit(0.0)), F.lit(0.0)).alias("s"))
    lag = g.edges.join(std(y).withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("s")).alias("l"))
    return std(x).join(lag, "id", "left").select("id", (F.col("s") * F.coalesce("l", F.lit(0.0))).alias("i"))


def weight_sum(g: Graph) -> DataFrame:
    return g.edges.agg(F.sum("w").alias("total"))


def morans_i(g: Graph, a: Matrix) -> DataFrame:
    """``col, i`` of every matrix column (rows are nodes), implicit zeros included, without densifying:
    sum w (x_i - m)(x_j - m) = sum w x_i x_j - m sum (w_out + w_in) x + m^2 S0."""
    return _morans(_by_column(g, a))


def _morans(d: DataFrame, *more: Column) -> DataFrame:
    return d.select("col", F.coalesce(F.col("n") * (F.col("xx") - F.col("mean") * F.col("kx") + F.col("mean") * F.col("mean") * F.col("s0")) / F.nullif(F.col("s0") * F.col("ss"), F.lit(0.0)), F.lit(0.0)).alias("i"), *more)


def _gearys() -> Column:
    return F.coalesce((F.col("n") - 1) * (F.col("kxx") - 2 * F.col("xx")) / F.nullif(2 * F.col("s0") * F.col("ss"), F.lit(0.0)), F.lit(0.0)).alias("c")


def gearys_c(g: Graph, a: Matrix) -> DataFrame:
    """``col, c``: (n - 1) sum w (x_i - x_j)^2 / (2 S0 sum (x - m)^2)."""
    return _by_column(g, a).select("col", _gearys())


def _by_column(g: Graph, a: Matrix) -> DataFrame:
    xi = a.entries.select(F.col("row").alias("src"), "col", F.col("v").alias("xi"))
    xj = a.entries.select(F.col("row").alias("dst"), "col", F.col("v").alias("xj"))
    cross = g.edges.join(xi, "src").join(xj, ["dst", "col"]).groupBy("col").agg(F.sum(F.col("w") * F.col("xi") * F.col("xj")).alias("xx"))
    k = g.edges.select(F.col("src").alias("row"), "w").unionByName(g.edges.select(F.col("dst").alias("row"), "w")).groupBy("row").agg(F.sum("w").alias("k"))
    return _terms(a, cross, k, g.edges.agg(F.sum("w").alias("s0")))


def _terms(a: Matrix, cross: DataFrame, k: DataFrame, s0: DataFrame) -> DataFrame:
    """Sums of a column from ``col, xx``, the weights of the rows (``row, k``, both directions) and all (``s0``)."""
    n = float(a.n_rows)
    s = a.entries.join(k, "row", "left").groupBy("col").agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("q"), F.sum(F.coalesce("k", F.lit(0.0)) * F.col("v")).alias("kx"), F.sum(F.coalesce("k", F.lit(0.0)) * F.col("v") * F.col("v")).alias("kxx"))
    d = a.over_cols(s.join(cross, "col", "left")).fillna(0.0).crossJoin(F.broadcast(s0))
    return d.withColumn("n", F.lit(n)).withColumn("mean", F.col("t") / n).withColumn("ss", F.col("q") - F.col("t") * F.col("t") / n)


# --- neighbourhoods of types (``id, type``) ----------------------------------


def _typed(g: Graph, types: DataFrame) -> DataFrame:
    return g.edges.join(types.select(F.col("id").alias("src"), F.col("type").alias("a")), "src").join(types.select(F.col("id").alias("dst"), F.col("type").alias("b")), "dst")


def neighborhood_composition(g: Graph, types: DataFrame) -> DataFrame:
    """``id, type, share`` of a node's neighbours."""
    c = _typed(g, types).groupBy(F.col("src").alias("id"), F.col("b").alias("type")).agg(F.count(F.lit(1)).alias("c"))
    return c.select("id", "type", (F.col("c") / F.sum("c").over(Window.partitionBy("id"))).alias("share"))


def niche_diversity(g: Graph, types: DataFrame) -> DataFrame:
    h = neighborhood_composition(g, types).groupBy("id").agg((-F.sum(F.col("share") * F.log("share"))).alias("h"))
    return g.over_nodes(h).select("id", F.coalesce("h", F.lit(0.0)).alias("h"))


def boundary_score(g: Graph, types: DataFrame) -> DataFrame:
    """``id, score`` = 1 - share of neighbours of the own type; isolated nodes 0."""
    s = _typed(g, types).groupBy(F.col("src").alias("id")).agg((1 - F.avg((F.col("a") == F.col("b")).cast("double"))).alias("score"))
    return g.over_nodes(s).select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def spatial_coherence(g: Graph, types: DataFrame) -> DataFrame:
    return boundary_score(g, types).select("id", (1 - F.col("score")).alias("coherence"))


def boundary_cells(g: Graph, types: DataFrame) -> DataFrame:
    return boundary_score(g, types).select("id", (F.col("score") > 0).alias("boundary"))


def contact_matrix(g: Graph, types: DataFrame) -> DataFrame:
    """``a, b, share`` of all contacts."""
    c = _typed(g, types).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("c").alias("t")))).select("a", "b", (F.col("c") / F.col("t")).alias("share"))


def _type_frequencies(types: DataFrame) -> DataFrame:
    n = types.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return types.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("k")).crossJoin(F.broadcast(n)).select("type", "k", (F.col("k") / F.col("n")).alias("f"))


def neighborhood_enrichment(g: Graph, types: DataFrame) -> DataFrame:
    """``a, b, z, p``: share of b among the neighbours of a against b's frequency, deviation sqrt(f (1 - f) / n_a)."""
    fr = _type_frequencies(types)
    c = _typed(g, types).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = fr.select(F.col("type").alias("a"), F.col("k").alias("na")).crossJoin(F.broadcast(fr.select(F.col("type").alias("b"), "f")))
    t = c.groupBy("a").agg(F.sum("c").alias("t"))
    d = pairs.join(c, ["a", "b"], "left").join(t, "a", "left")
    obs = F.coalesce(F.col("c") / F.col("t"), F.lit(0.0))
    sd = F.sqrt(F.col("f") * (1 - F.col("f")) / F.col("na"))
    z = F.when(sd > 1e-12, (obs - F.col("f")) / sd).otherwise(F.lit(0.0))
    return d.select("a", "b", z.alias("z")).withColumn("p", F.least(F.lit(1.0), 2 * two_sided(F.col("z"))))


def colocalization(g: Graph, types: DataFrame) -> DataFrame:
    """``a, b, score``: log2 of observed over expected contacts, +-10 where one is 0."""
    from .stats import bounded_log_ratio

    fr = _type_frequencies(types)
    c = _typed(g, types).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = fr.select(F.col("type").alias("a"), F.col("f").alias("fa")).crossJoin(F.broadcast(fr.select(F.col("type").alias("b"), F.col("f").alias("fb"))))
    d = pairs.crossJoin(F.broadcast(c.agg(F.sum("c").alias("t")))).join(c, ["a", "b"], "left")
    return d.select("a", "b", bounded_log_ratio(F.coalesce("c", F.lit(0.0)), F.col("fa") * F.col("fb") * F.col("t")).alias("score"))


def niche_similarity(g: Graph, types: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, id, similarity`` = 1 - sqrt of the Jensen-Shannon divergence (log2) of compositions."""
    c = neighborhood_composition(g, types)
    k = types.select("type").distinct()
    full = g.nodes.crossJoin(F.broadcast(k)).join(c, ["id", "type"], "left").fillna(0.0, ["share"])
    q = full.join(queries, "id", "left_semi").select(F.col("id").alias("query"), "type", F.col("share").alias("p"))
    j = full.join(q, "type")
    m = (F.col("p") + F.col("share")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / F.greatest(m, F.lit(1e-300)))).otherwise(0.0)
    jsd = j.groupBy("query", "id").agg((0.5 * F.sum(term(F.col("p")) + term(F.col("share")))).alias("d"))
    return jsd.select("query", "id", (1 - F.sqrt(F.greatest(F.lit(0.0), F.col("d")))).alias("similarity"))


def cell_type_interaction(points: DataFrame, types: DataFrame, radius: float) -> DataFrame:
    """Colocalisation of types within a radius."""
    return colocalization(Graph(distance_band(points, radius), points.select("id")), types)


# --- patterns on coordinates -------------------------------------------------


def spatial_gradient(points: DataFrame, values: DataFrame) -> DataFrame:
    """``strength, dx, dy``: regression slopes of the value on x and on y, and their direction."""
    d = points.join(values, "id")
    s = d.agg(*(F.coalesce(F.covar_pop("value", c) / F.nullif(F.var_pop(c), F.lit(0.0)), F.lit(0.0)).alias("s" + c) for c in ("x", "y")))
    m = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    return s.select(m.alias("strength"), *(F.coalesce(F.col("s" + c) / F.nullif(m, F.lit(0.0)), F.lit(0.0)).alias("d" + c) for c in ("x", "y")))


def periodic_pattern(points: DataFrame, values: DataFrame, wavelengths: list[float]) -> DataFrame:
    """``wavelength, score`` of the best: largest r(cos)^2 + r(sin)^2 along x."""
    waves = F.explode(F.array(*[F.lit(float(w)) for w in wavelengths])).alias("wavelength")
    d = points.join(values, "id").select("x", "value", waves).withColumn("a", 2 * math.pi * F.col("x") / F.col("wavelength"))
    r = d.groupBy("wavelength").agg(F.coalesce(F.corr("value", F.cos("a")), F.lit(0.0)).alias("c"), F.coalesce(F.corr("value", F.sin("a")), F.lit(0.0)).alias("s"))
    return r.select("wavelength", (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("score")).orderBy(F.desc("score"), "wavelength").limit(1)


#: Points of a chunk; all pairs of two chunks are counted at once.
_CHUNK = 1024


def _chunks():
    """Chunks of neighbouring points in the order they come, with the box around each."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            strip = batch.column("strip").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(strip)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(strip)]):
                for at in range(lo, hi, _CHUNK):
                    ids, x, y = (batch.column(c).slice(at, min(_CHUNK, hi - at)) for c in ("id", "x", "y"))
                    box = {n + c: [float(f(v.to_numpy()))] for c, v in (("x", x), ("y", y)) for n, f in (("lo", np.min), ("hi", np.max))}
                    yield pa.RecordBatch.from_pydict({c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in (("id", ids), ("x", x), ("y", y))} | box)

    return run


def _pairs_within(radii: list[float]):
    """How many ordered pairs of different points of two chunks lie within each radius; a chunk and
    itself have each pair in both orders, others in one."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        found = np.zeros(len(radii), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, x, y), (ids2, x2, y2) = ([batch.column(c + k)[i].values.to_numpy(zero_copy_only=False) for c in ("id", "x", "y")] for k in ("", "2"))
                twice = 1 if batch.column("c")[i].as_py() == batch.column("c2")[i].as_py() else 2
                for at in range(0, len(x), 128):
                    dx, dy = x[at : at + 128, None] - x2, y[at : at + 128, None] - y2
                    dist = np.sqrt(dx * dx + dy * dy)
                    other = ids[at : at + 128, None] != ids2
                    found += [twice * int(((dist <= r) & other).sum()) for r in radii]
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(radii), dtype=np.int32), "n": found})

    return run


def ripleys_k(points: DataFrame, radii: list[float], area: float) -> DataFrame:
    """``radius, k`` = 2 * pairs within r / (n * intensity), no edge correction.

    Pairs are counted where two chunks of neighbouring points meet (boxes at most the largest radius
    apart), and only counts leave: no pair is a row, however dense the points are."""
    far = float(max(radii))
    n = points.agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = p.where("id is not null and abs(x) < double('inf') and abs(y) < double('inf') and not isnan(x) and not isnan(y)")
    p = p.withColumn("strip", F.floor(F.col("x") / (far or 1.0)).cast("double")).repartitionByRange("strip", "y", "id").sortWithinPartitions("strip", "y")
    kind = points.schema["id"].dataType.simpleString()
    boxes = ", ".join(f"{b}{c} double" for c in ("x", "y") for b in ("lo", "hi"))
    c = p.mapInArrow(_chunks(), f"id array<{kind}>, x array<double>, y array<double>, {boxes}")
    c = cut(c.withColumn("c", F.monotonically_increasing_id()))
    near = far * (1 + 1e-9)
    meet = (F.col("c") <= F.col("c2")) & reduce(lambda a, b: a & b, [(F.col(f"lo{k}2") - F.col(f"hi{k}") <= near) & (F.col(f"lo{k}") - F.col(f"hi{k}2") <= near) for k in ("x", "y")])
    tasks = max(1, min(c.count(), 4 * c.sparkSession.sparkContext.defaultParallelism))
    met = c.repartition(tasks).join(c.toDF(*(f"{x}2" for x in c.columns)), meet).select(*(f"{x}{k}" for x in ("c", "id", "x", "y") for k in ("", "2")))
    counts = met.mapInArrow(_pairs_within([float(r) for r in radii]), "at int, n long").groupBy("at").agg(F.sum("n").alias("n2"))
    r = points.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(radii)], "at int, radius double")
    return r.join(counts, "at", "left").crossJoin(F.broadcast(n)).select("radius", (F.coalesce("n2", F.lit(0)) * F.lit(float(area)) / F.nullif(F.col("n") * F.col("n"), F.lit(0.0))).alias("k"))


def kernel_weights(points: DataFrame, bandwidth: float, reach: float = 4.0, own: bool = False) -> DataFrame:
    """``src, dst, w`` Gaussian in the distance, up to ``reach`` bandwidths (weights below 4e-4 are left out)."""
    e = distance_band(points, reach * bandwidth).select("src", "dst", F.exp(-F.col("dist") * F.col("dist") / (2 * bandwidth * bandwidth)).alias("w"))
    return e.unionByName(points.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))) if own else e


def hotspot_analysis(points: DataFrame, values: DataFrame, bandwidth: float) -> DataFrame:
    """``id, g, z``: G* with Gaussian weights, the point itself included."""
    g = Graph(kernel_weights(points, bandwidth, own=True), points.select("id"))
    return getis_ord(g, values, include_self=False).select("id", "g", "z")


#: Points of a tile; a task holds two tiles.
TILE = 2048


def _tile_sums(bandwidth: float, reach: float, smooth: bool):
    """Kernel sums of one tile over another: by row of the weights (kind 0), by column of the products of
    both sides (1) or, smoothed, by row and column (2)."""
    import numpy as np
    import pyarrow as pa

    def entries(t: pa.Table):
        c = t["e"].combine_chunks()
        n = np.diff(np.asarray(c.offsets)) if len(c) else np.zeros(0, np.int64)
        flat = c.flatten()
        return np.repeat(np.arange(len(n)), n), flat.field("col").to_numpy().astype(np.int64), flat.field("v").to_numpy()

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        rows, cols, sums, kinds = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float64, np.int32))
        ids, x, y = (own[c].to_numpy() for c in ("id", "x", "y"))
        others, x2, y2 = (near[c].to_numpy() for c in ("id2", "x2", "y2"))
        if len(ids) and len(others):
            at2, col2, v2 = entries(near)
            at1, col1, v1 = (None, None, None) if smooth else entries(own)
            names = np.unique(col2)
            for lo in range(0, len(ids), 512):
                d2 = (x[lo : lo + 512, None] - x2) ** 2 + (y[lo : lo + 512, None] - y2) ** 2
                w = np.where((d2 <= (reach * bandwidth) ** 2) & (ids[lo : lo + 512, None] != others), np.exp(-d2 / (2 * bandwidth * bandwidth)), 0.0)
                some = w.any(axis=1)
                rows.append(ids[lo : lo + 512][some])
                cols.append(np.full(some.sum(), -1))
                sums.append(w.sum(axis=1)[some])
                kinds.append(np.full(some.sum(), 0, np.int32))
                for c in range(0, len(names), 512):
                    part = names[c : c + 512]
                    pick = (col2 >= part[0]) & (col2 <= part[-1])
                    place = at2[pick], np.searchsorted(part, col2[pick])
                    m = np.zeros((len(others), len(part)))
                    m[place] = v2[pick]
                    s = w @ m
                    if smooth:
                        there = s != 0
                        if not there.all():  # a sum of 0 counts where something is stored
                            m[place] = 1.0
                            there = (w @ m) > 0
                        i, j = np.nonzero(there)
                        rows.append(ids[lo + i])
                        cols.append(part[j])
                        sums.append(s[i, j])
                        kinds.append(np.full(len(i), 2, np.int32))
                    else:
                        mine = (at1 >= lo) & (at1 < lo + 512) & np.isin(col1, part)
                        j = np.searchsorted(part, col1[mine])
                        xx = np.bincount(j, v1[mine] * s[at1[mine] - lo, j], minlength=len(part))
                        rows.append(np.full(len(part), -1))
                        cols.append(part)
                        sums.append(xx)
                        kinds.append(np.full(len(part), 1, np.int32))
        row, col, s = (np.concatenate(c) for c in (rows, cols, sums))
        return pa.table({"row": row, "col": col, "s": s, "kind": np.concatenate(kinds)})

    return run


def _kernel_sums(points: DataFrame, a: Matrix, bandwidth: float, smooth: bool, reach: float = 4.0) -> DataFrame:
    """Sums over Gaussian weights, made where two tiles of points meet: no weight and no product of two
    points' entries is exchanged. A tile is a grid cell, or a part of one with many points."""
    side = reach * bandwidth
    e = a.entries.groupBy(F.col("row").alias("id")).agg(F.collect_list(F.struct(F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))).alias("e"))
    none = F.expr("CAST(array() AS array<struct<col: bigint, v: double>>)")
    p = points.select(F.col("id").cast("long").alias("id"), "x", "y").join(e, "id", "left").withColumn("e", F.coalesce("e", none))
    p = p.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    cells = points.groupBy(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    there = cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("parts").alias("nparts"))
    p = cut(p.join(cells, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts"))
    near = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("nx"), (F.col("cy") + j).alias("ny")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("n")
    all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nparts") - 1))
    d = p.select("*", near).select("id", "x", "y", "e", "cx", "cy", "part", "n.nx", "n.ny").join(there, ["nx", "ny"]).withColumn("npart", all_parts)
    key = ["cx", "cy", "part", "nx", "ny", "npart"]
    own = d.select(*key, "id", "x", "y", *([] if smooth else ["e"]))
    other = d.select(F.col("nx").alias("cx"), F.col("ny").alias("cy"), F.col("npart").alias("part"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("part").alias("npart"), F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("e").alias("e"))
    return cut(own.groupBy(*key).cogroup(other.groupBy(*key)).applyInArrow(_tile_sums(bandwidth, reach, smooth), "row long, col long, s double, kind int"))


def spatial_autocorrelation(points: DataFrame, a: Matrix, bandwidth: float) -> DataFrame:
    d = _kernel_sums(points, a, bandwidth, False)
    k = d.where("kind = 0").groupBy("row").agg((2 * F.sum("s")).alias("k"))  # weights are symmetric
    cross = d.where("kind = 1").groupBy("col").agg(F.sum("s").alias("xx"))
    return _morans(_terms(a, cross, k, d.where("kind = 0").agg(F.sum("s").alias("s0"))), _gearys())


def spatial_smoothing(points: DataFrame, a: Matrix, bandwidth: float) -> DataFrame:
    """``row, col, v``: row-normalised kernel mean without the own value."""
    d = _kernel_sums(points, a, bandwidth, True)
    t = d.where("kind = 0").groupBy("row").agg(F.sum("s").alias("t"))
    s = d.where("kind = 2").groupBy("row", "col").agg(F.sum("s").alias("s"))
    return s.join(t, "row").select("row", "col", (F.col("s") / F.col("t")).alias("v"))


def spatial_entropy(points: DataFrame, types: DataFrame, bandwidth: float) -> DataFrame:
    """``id, h``: entropy of kernel-weighted types around a point (itself included) over the log of the number of types."""
    k = types.agg(F.countDistinct("type").cast("double").alias("k"))
    w = kernel_weights(points, bandwidth, own=True).join(types.select(F.col("id").alias("dst"), "type"), "dst").groupBy("src", "type").agg(F.sum("w").alias("w"))
    p = w.select("src", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("p"))
    h = p.groupBy(F.col("src").alias("id")).agg((-F.sum(F.col("p") * F.log("p"))).alias("h")).crossJoin(F.broadcast(k))
    return h.select("id", F.when(F.col("k") > 1, F.col("h") / F.log("k")).otherwise(F.lit(0.0)).alias("h"))


def boundary_detection(nbrs: DataFrame, a: Matrix) -> DataFrame:
    """``row, score``: mean expression distance to the spatial neighbours (``row, nbr``) over the largest."""
    e = a.entries
    sq = e.groupBy("row").agg(F.sum(F.col("v") * F.col("v")).alias("q"))
    dot = nbrs.select("row", "nbr").join(e, "row").join(e.select(F.col("row").alias("nbr"), "col", F.col("v").alias("u")), ["nbr", "col"]).groupBy("row", "nbr").agg(F.sum(F.col("v") * F.col("u")).alias("dot"))
    d = nbrs.select("row", "nbr").join(sq, "row", "left").join(sq.select(F.col("row").alias("nbr"), F.col("q").alias("o")), "nbr", "left").join(dot, ["row", "nbr"], "left").fillna(0.0)
    m = d.groupBy("row").agg(F.avg(F.sqrt(F.greatest(F.lit(0.0), F.col("q") + F.col("o") - 2 * F.col("dot")))).alias("m"))
    return m.crossJoin(F.broadcast(m.agg(F.max("m").alias("top")))).select("row", F.coalesce(F.col("m") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def spatial_coexpression(g: Graph, x: DataFrame, y: DataFrame) -> DataFrame:
    """``score``: bivariate Moran coefficient of two values over all weights."""
    i = bivariate_local_i(g, x, y).agg(F.sum("i").alias("s"))
    return i.crossJoin(weight_sum(g)).select(F.coalesce(F.col("s") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)).alias("score"))


# --- tissue ------------------------------------------------------------------


def layer_assignment(points: DataFrame, n_layers: int, axis: str = "x") -> DataFrame:
    """``id, layer``: equal widths on one axis."""
    return _layers(points.select("id", F.col(axis).alias("r")), n_layers)


def radial_layers(points: DataFrame, cx: float, cy: float, n_layers: int) -> DataFrame:
    r = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
    return _layers(points.select("id", r.alias("r")), n_layers, from_zero=True)


def _layers(d: DataFrame, n: int, from_zero: bool = False) -> DataFrame:
    b = d.agg((F.lit(0.0) if from_zero else F.min("r")).alias("lo"), F.max("r").alias("hi"))
    layer = F.floor((F.col("r") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / n, F.lit(0.0))).cast("int")
    return d.crossJoin(F.broadcast(b)).select("id", F.coalesce(F.least(F.lit(n - 1), layer), F.lit(0)).alias("layer"))


def zonation(points: DataFrame, totals: DataFrame, x0: float, y0: float) -> DataFrame:
    """``id, score``: distance to a point over the largest, times |r| of the value (``id, value``) with it."""
    d = points.join(totals, "id").withColumn("d", F.sqrt((F.col("x") - x0) * (F.col("x") - x0) + (F.col("y") - y0) * (F.col("y") - y0)))
    s = d.agg(F.max("d").alias("top"), F.abs(F.coalesce(F.corr("d", "value"), F.lit(0.0))).alias("r"))
    return d.crossJoin(F.broadcast(s)).select("id", (F.coalesce(F.col("d") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)) * F.col("r")).alias("score"))


def tissue_architecture(g: Graph, types: DataFrame, dists: DataFrame) -> DataFrame:
    """``id, density, heterogeneity``: 1 / mean neighbour distance (``src, dist``) and type diversity."""
    d = dists.groupBy(F.col("src").alias("id")).agg((1 / F.greatest(F.avg("dist"), F.lit(1e-10))).alias("density"))
    return niche_diversity(g, types).withColumnRenamed("h", "heterogeneity").join(d, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"), "heterogeneity")


def region_statistics(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``region, n, cx, cy, spread``: centroid and root mean squared distance to it."""
    d = points.join(regions, "id")
    return d.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"))


def morphology(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, area, perimeter, circularity, eccentricity`` of groups of three points and more.

    The hull is built from each group's extreme points in 64 directions (a bounded summary that map
    sides combine), the moments from all points."""
    d = points.join(labels, "id")
    angles = [2 * math.pi * i / 64 for i in range(64)]
    ext = [F.max_by(F.struct("x", "y"), F.col("x") * math.cos(t) + F.col("y") * math.sin(t)).alias(f"p{i}") for i, t in enumerate(angles)]
    g = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cv"), *ext).where("n >= 3")
    cross = sum(((F.col(f"p{i}.x") * F.col(f"p{(i + 1) % 64}.y") - F.col(f"p{(i + 1) % 64}.x") * F.col(f"p{i}.y")) for i in range(64)), F.lit(0.0))
    r = F.greatest(*(F.sqrt(F.pow(F.col(f"p{i}.x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col(f"p{i}.y") - F.col("cy"), F.lit(2.0))) for i in range(64)))
    area, per = F.abs(cross) / 2, 2 * math.pi * r
    tr, det = F.col("vx") + F.col("vy"), F.col("vx") * F.col("vy") - F.col("cv") * F.col("cv")
    root = F.sqrt(F.greatest(F.lit(0.0), tr * tr / 4 - det))
    ecc = F.sqrt(F.greatest(F.lit(0.0), 1 - (tr / 2 - root) / F.nullif(tr / 2 + root, F.lit(0.0))))
    return g.select("label", area.alias("area"), per.alias("perimeter"), F.coalesce(4 * math.pi * area / F.nullif(per * per, F.lit(0.0)), F.lit(0.0)).alias("circularity"), F.coalesce(ecc, F.lit(0.0)).alias("eccentricity"))


def hotspot_clusters(g: Graph, kinds: DataFrame, kind: int = 1) -> DataFrame:
    """``id, component`` of the hot (or cold) nodes."""
    from .graphs import connected_components

    nodes = kinds.where(F.col("kind") == kind).select("id")
    e = g.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return connected_components(Graph(e, nodes))
