"""Louvain and Leiden communities and k-means, as distributed rounds.

Local moving runs for all nodes at once: every node scores its neighbours'
communities from aggregates, and half of the nodes (by a hash that changes each
round) move, which avoids swapping back and forth. Communities contract to nodes
for the next level. Nothing is collected but scalars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Graph
from .partitions import modularity


def _move(edges: DataFrame, labels: DataFrame, resolution: float, seed: int, inside: DataFrame | None = None) -> DataFrame:
    """One round: ``id, label`` after the best moves of half of the nodes. ``inside`` are the edges
    along which nodes may move (those within communities, for refinement)."""
    m2 = edges.agg(F.sum("w")).first()[0] or 1.0
    k = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    lab = labels.join(k, "id", "left").fillna(0.0, ["k"])
    tot = lab.groupBy("label").agg(F.sum("k").alias("tot"))
    e = (edges if inside is None else inside).where("src <> dst")
    to = e.join(lab.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("wc"))
    own = lab.select("id", "label", F.lit(0.0).alias("wc"))
    cand = to.unionByName(own).groupBy("id", "label").agg(F.sum("wc").alias("wc"))
    cand = cand.join(lab.select("id", F.col("label").alias("own"), "k"), "id").join(tot, "label")
    others = F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.col("wc") - resolution * F.col("k") * others / m2
    best = cand.withColumn("gain", gain).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("gain"), "label")))
    best = best.withColumn("stay", F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).over(Window.partitionBy("id")))
    b = best.where("_r = 1").select("id", F.col("label").alias("new"), "gain", "own", "stay")
    turn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0
    moved = F.when(turn & (F.col("gain") > F.col("stay") + 1e-10), F.col("new")).otherwise(F.col("own"))
    return labels.select("id").join(b.select("id", moved.alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _local_moving(edges: DataFrame, labels: DataFrame, resolution: float, max_rounds: int, seed: int, inside=None) -> DataFrame:
    still = 0
    for r in range(max_rounds):
        new = cut(_move(edges, labels, resolution, seed + r, inside))
        changed = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").count()
        labels = new
        still = still + 1 if changed == 0 else 0
        if still == 2:  # both halves had their turn
            break
    return labels


def _contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def louvain(g: Graph, resolution: float = 1.0, max_levels: int = 5, max_rounds: int = 8, seed: int = 0) -> DataFrame:
    """``id, label`` (a member's id) on a symmetric graph."""
    edges, flat, q = cut(g.edges.select("src", "dst", "w")), cut(g.nodes.select("id", F.col("id").alias("label"))), None
    nodes = g.nodes
    for level in range(max_levels):
        own = nodes.select("id", F.col("id").alias("label"))
        part = _local_moving(edges, own, resolution, max_rounds, seed + 100 * level)
        new = cut(flat.join(part.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")))
        now = modularity(g, new, resolution).first()[0]
        if q is not None and now <= q + 1e-8:
            break
        flat, q = new, now
        edges = cut(_contract(edges, part))
        nodes = part.select(F.col("label").alias("id")).distinct()
    return flat


def leiden(g: Graph, resolution: float = 1.0, max_levels: int = 5, max_rounds: int = 8, seed: int = 0) -> DataFrame:
    """As ``louvain``, with communities refined from single nodes inside each before they contract: the next
    level moves refined parts. The last level has none after it and ends with its own moves."""
    edges, flat, q = cut(g.edges.select("src", "dst", "w")), cut(g.nodes.select("id", F.col("id").alias("label"))), None
    nodes = g.nodes
    start = None
    for level in range(max_levels):
        own = nodes.select("id", F.col("id").alias("label")) if start is None else start
        part = _local_moving(edges, own, resolution, max_rounds, seed + 100 * level)
        new = cut(flat.join(part.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")))
        now = modularity(g, new, resolution).first()[0]
        if q is not None and now <= q + 1e-8:
            break
        best, q = new, now
        if level + 1 == max_levels:
            break
        single = nodes.select("id", F.col("id").alias("label"))
        within = edges.join(part.select(F.col("id").alias("src"), F.col("label").alias("c")), "src").join(part.select(F.col("id").alias("dst"), F.col("label").alias("c")), ["dst", "c"])
        fine = _local_moving(edges, single, resolution, max_rounds, seed + 100 * level + 50, cut(within.select("src", "dst", "w")))
        flat = cut(flat.join(fine.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")))
        start = cut(fine.join(part.withColumnRenamed("label", "c"), "id").groupBy(F.col("label").alias("id")).agg(F.min("c").alias("label")))
        start = cut(start.join(start.groupBy("label").agg(F.min("id").alias("rep")), "label").select("id", F.col("rep").alias("label")))
        edges = cut(_contract(edges, fine))
        nodes = start.select("id")
    return best


def kmeans(x: DataFrame, k: int, max_iter: int = 20, seed: int = 0) -> DataFrame:
    """``id, label`` of ``id, dim, x``; centres start at rows far apart by seeded hash (k-means++ draws)
    and are k vectors, so they travel to the rows."""
    x = cut(x)
    ids = x.select("id").distinct()
    first = ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1)
    centres = cut(x.join(F.broadcast(first), "id").select(F.lit(0).alias("c"), "dim", F.col("x").alias("m")))
    for c in range(1, k):
        d = _sq_distances(x, centres).groupBy("id").agg(F.min("d").alias("d"))
        u = (F.pmod(F.xxhash64("id", F.lit(seed + c)), F.lit(1 << 40)) + 1) / float(1 << 40)
        pick = d.where("d > 0").orderBy((-F.log(u)) / F.col("d"), "id").limit(1).select("id")  # a draw with odds d
        centres = cut(centres.unionByName(x.join(F.broadcast(pick), "id").select(F.lit(c).alias("c"), "dim", F.col("x").alias("m"))))
    labels = None
    for _ in range(max_iter):
        w = Window.partitionBy("id").orderBy("d", "c")
        new = cut(_sq_distances(x, centres).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", F.col("c").alias("label")))
        if labels is not None and new.join(labels.withColumnRenamed("label", "o"), "id").where("label <> o").isEmpty():
            break
        labels = new
        centres = cut(x.join(labels, "id").groupBy(F.col("label").alias("c"), "dim").agg(F.avg("x").alias("m")))
    return new


def _sq_distances(x: DataFrame, centres: DataFrame) -> DataFrame:
    d = F.col("x") - F.col("m")
    return x.join(F.broadcast(centres), "dim").groupBy("id", "c").agg(F.sum(d * d).alias("d"))


def subcluster(x: DataFrame, parents: DataFrame, parent: int, k: int, min_size: int = 10, seed: int = 0) -> DataFrame:
    """``id, label``: k-means inside one parent cluster; 0 for all if it has under ``min_size`` rows."""
    inside = parents.where(F.col("label") == parent).select("id")
    if inside.count() < min_size:
        return inside.select("id", F.lit(0).alias("label"))
    return kmeans(x.join(inside, "id", "left_semi"), k, seed=seed)


def spatial_domains(points: DataFrame, features: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k-means on min-max scaled coordinates with standardised features (``id, dim, x``)."""
    b = points.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    p = points.crossJoin(F.broadcast(b))
    scaled = lambda c: F.coalesce((F.col(c) - F.col("lo" + c)) / F.nullif(F.col("hi" + c) - F.col("lo" + c), F.lit(0.0)), F.lit(0.0))
    xy = p.select("id", F.explode(F.array(F.struct(F.lit(-2).alias("dim"), scaled("x").alias("x")), F.struct(F.lit(-1).alias("dim"), scaled("y").alias("x")))).alias("e")).select("id", "e.dim", "e.x")
    return kmeans(xy.unionByName(features.select("id", F.col("dim").cast("int").alias("dim"), "x")), k, seed=seed)
