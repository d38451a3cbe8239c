"""Comparing labelings, clone and lineage tables, community quality. Inputs are ``id`` with labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Graph, Matrix
from .information import count_entropy_agg
from .testing import ordered

# --- agreement of two labelings (``id, a, b``) -------------------------------


def contingency(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))


def _pairs2(c: Column) -> Column:
    return c * (c - 1) / 2


def _pair_counts(labels: DataFrame) -> DataFrame:
    """``both, pa, pb, n``: pairs together in both, in a, in b, and all rows."""
    t = contingency(labels)
    s = t.agg(F.sum(_pairs2(F.col("c"))).alias("both"), F.sum("c").alias("n"))
    side = lambda k, name: t.groupBy(k).agg(F.sum("c").alias("c")).agg(F.sum(_pairs2(F.col("c"))).alias(name))
    return s.crossJoin(side("a", "pa")).crossJoin(side("b", "pb"))


def adjusted_rand_index(labels: DataFrame) -> DataFrame:
    exp = F.col("pa") * F.col("pb") / F.nullif(_pairs2(F.col("n").cast("double")), F.lit(0.0))
    top = (F.col("pa") + F.col("pb")) / 2
    return _pair_counts(labels).select(F.coalesce((F.col("both") - exp) / F.nullif(top - exp, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def fowlkes_mallows(labels: DataFrame) -> DataFrame:
    return _pair_counts(labels).select(F.coalesce(F.col("both") / F.nullif(F.sqrt(F.col("pa") * F.col("pb")), F.lit(0.0)), F.lit(0.0)).alias("fmi"))


def _label_entropies(labels: DataFrame) -> DataFrame:
    t = contingency(labels)
    h = lambda k, n: t.groupBy(k).agg(F.sum("c").alias("c")).agg(count_entropy_agg(F.col("c")).alias(n))
    return t.agg(count_entropy_agg(F.col("c")).alias("hab")).crossJoin(h("a", "ha")).crossJoin(h("b", "hb")).withColumn("mi", F.greatest(F.lit(0.0), F.col("ha") + F.col("hb") - F.col("hab")))


def normalized_mutual_information(labels: DataFrame) -> DataFrame:
    """MI over the mean entropy; 1 if both entropies are 0."""
    return _label_entropies(labels).select(F.coalesce(F.col("mi") / F.nullif((F.col("ha") + F.col("hb")) / 2, F.lit(0.0)), F.lit(1.0)).alias("nmi"))


def v_measure(labels: DataFrame, beta: float = 1.0) -> DataFrame:
    """``homogeneity, completeness, v`` with a the truth and b the prediction."""
    e = _label_entropies(labels)
    hom = F.coalesce(F.col("mi") / F.nullif(F.col("ha"), F.lit(0.0)), F.lit(1.0))
    com = F.coalesce(F.col("mi") / F.nullif(F.col("hb"), F.lit(0.0)), F.lit(1.0))
    v = F.coalesce((1 + beta) * hom * com / F.nullif(beta * hom + com, F.lit(0.0)), F.lit(0.0))
    return e.select(hom.alias("homogeneity"), com.alias("completeness"), v.alias("v"))


def purity(labels: DataFrame) -> DataFrame:
    t = contingency(labels).groupBy("b").agg(F.max("c").alias("m"), F.sum("c").alias("n"))
    return t.agg((F.sum("m") / F.sum("n")).alias("purity"))


def cluster_purity(labels: DataFrame) -> DataFrame:
    """``b, purity``: share of the most common truth in every cluster."""
    return contingency(labels).groupBy("b").agg((F.max("c") / F.sum("c")).alias("purity"))


def confusion(labels: DataFrame) -> DataFrame:
    return contingency(labels)


def classification_quality(labels: DataFrame) -> DataFrame:
    """``accuracy, macro_f1`` with a the truth and b the prediction; F1 over classes that occur."""
    per = class_f1(labels)
    acc = labels.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("accuracy"))
    return acc.crossJoin(per.agg(F.avg("f1").alias("macro_f1")))


def class_f1(labels: DataFrame) -> DataFrame:
    t = contingency(labels)
    both = t.select(F.col("a").alias("class"), "c", F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("a") == F.col("b")).cast("int").alias("h"))
    both = both.unionByName(t.select(F.col("b").alias("class"), "c", F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))
    s = both.groupBy("class").agg(*(F.sum(F.col("c") * F.col(k)).alias(k) for k in ("t", "p", "h")))
    return s.select("class", (2 * F.col("h") / (F.col("t") + F.col("p"))).alias("f1"))


def label_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def relabel_by_size(labels: DataFrame, label: str = "label") -> DataFrame:
    """``id, label`` renumbered from 0 in order of size, largest first."""
    sizes = label_sizes(labels, label).select(F.col(label).alias("id"), F.col("n").alias("size"))
    m = ordered(sizes, by="size", descending=True).select(F.col("id").alias(label), (F.col("rank") - 1).cast("long").alias("new"))
    return labels.join(m, label).select("id", F.col("new").alias("label"))


def shares(labels: DataFrame, of: str, within: str) -> DataFrame:
    """``within, of, share``: composition of every group of ``within``."""
    t = labels.groupBy(within, of).agg(F.count(F.lit(1)).alias("c"))
    return t.select(within, of, (F.col("c") / F.sum("c").over(Window.partitionBy(within))).alias("share"))


# --- clones ------------------------------------------------------------------


def clone_sizes(clones: DataFrame) -> DataFrame:
    """``clone, n`` of ``id, clone``; negative or null clones mean none."""
    return clones.where("clone >= 0").groupBy("clone").agg(F.count(F.lit(1)).alias("n"))


def clonal_diversity(clones: DataFrame) -> DataFrame:
    """``shannon, simpson, gini``; the Gini index from sizes in order with average ranks of ties."""
    s = clone_sizes(clones)
    sizes = s.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct size
    r = sizes.withColumn("rank", F.coalesce(F.sum("m").over(before), F.lit(0)) + (F.col("m") + 1) / 2)
    g = r.agg(F.sum(F.col("rank") * F.col("n") * F.col("m")).alias("w"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum("m").alias("k"))
    gini = F.coalesce(2 * F.col("w") / (F.col("k") * F.nullif(F.col("t"), F.lit(0))) - (F.col("k") + 1) / F.col("k"), F.lit(0.0))
    d = s.agg(count_entropy_agg(F.col("n")).alias("shannon"), (1 - F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("simpson"))
    return d.crossJoin(g.select(gini.alias("gini")))


def diversity_per_cluster(labels: DataFrame) -> DataFrame:
    """``cluster, shannon, simpson`` from ``id, clone, cluster``."""
    t = labels.where("clone >= 0").groupBy("cluster", "clone").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("cluster").agg(count_entropy_agg(F.col("n")).alias("shannon"), (1 - F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0))).alias("simpson"))


def clonality(labels: DataFrame) -> DataFrame:
    """``cluster, clonality``: 1 - H / log k with shares of the whole cluster; 1 for at most one clone."""
    size = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    t = labels.where("clone >= 0").groupBy("cluster", "clone").agg(F.count(F.lit(1)).alias("n")).join(size, "cluster")
    p = F.col("n") / F.col("size")
    h = t.groupBy("cluster").agg((-F.sum(p * F.log(p))).alias("h"), F.count(F.lit(1)).alias("k"))
    return size.join(h, "cluster", "left").select("cluster", F.when(F.col("k") > 1, 1 - F.col("h") / F.log(F.col("k").cast("double"))).otherwise(F.lit(1.0)).alias("clonality"))


def clone_dynamics(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """``clone, rate`` = log2((n2 + 1) / (n1 + 1))."""
    j = clone_sizes(t1).withColumnRenamed("n", "n1").join(clone_sizes(t2).withColumnRenamed("n", "n2"), "clone", "full")
    return j.select("clone", F.log2((F.coalesce("n2", F.lit(0)) + 1) / (F.coalesce("n1", F.lit(0)) + 1)).alias("rate"))


def shared_clones(a: DataFrame, b: DataFrame) -> DataFrame:
    return clone_sizes(a).select("clone").join(clone_sizes(b).select("clone"), "clone")


def clone_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    x = clone_sizes(a).select("clone", F.lit(1).alias("x")).join(clone_sizes(b).select("clone", F.lit(1).alias("y")), "clone", "full")
    return x.agg(F.coalesce(F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("double")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("jaccard"))


def morisita_horn(a: DataFrame, b: DataFrame) -> DataFrame:
    share = lambda d, n: clone_sizes(d).crossJoin(F.broadcast(d.where("clone >= 0").agg(F.count(F.lit(1)).alias("t")))).select("clone", (F.col("n") / F.col("t")).alias(n))
    j = share(a, "p").join(share(b, "q"), "clone", "full").fillna(0.0)
    return j.agg(F.coalesce(2 * F.sum(F.col("p") * F.col("q")) / F.nullif(F.sum(F.col("p") * F.col("p") + F.col("q") * F.col("q")), F.lit(0.0)), F.lit(0.0)).alias("overlap"))


def expanded_clones(clones: DataFrame, threshold: int) -> DataFrame:
    return clone_sizes(clones).where(F.col("n") >= threshold)


def clone_size_statistics(clones: DataFrame) -> DataFrame:
    s = clone_sizes(clones)
    return s.agg(F.avg("n").alias("mean_size"), F.percentile("n", 0.5).alias("median_size"), F.max("n").alias("max_size"), F.sum((F.col("n") == 1).cast("long")).alias("n_singletons"), F.count(F.lit(1)).alias("n_clones"))


def clone_transitions(labels: DataFrame, min_size: int = 2) -> DataFrame:
    """``src, dst, p``: over clones of at least min_size, sum of p(src) p(dst), rows normalised."""
    t = labels.where("clone >= 0").groupBy("clone", "cluster").agg(F.count(F.lit(1)).alias("c"))
    p = t.withColumn("n", F.sum("c").over(Window.partitionBy("clone"))).where(F.col("n") >= min_size).select("clone", "cluster", (F.col("c") / F.col("n")).alias("p"))
    j = p.join(p.select("clone", F.col("cluster").alias("dst"), F.col("p").alias("q")), "clone").groupBy(F.col("cluster").alias("src"), "dst").agg(F.sum(F.col("p") * F.col("q")).alias("w"))
    return j.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("p"))


def clone_profiles(a: Matrix, clones: DataFrame) -> DataFrame:
    """``clone, col, mean`` over a clone's rows, implicit zeros included; only cells that are not 0."""
    sizes = clone_sizes(clones)
    s = a.entries.join(clones.select(F.col("id").alias("row"), "clone").where("clone >= 0"), "row").groupBy("clone", "col").agg(F.sum("v").alias("s"))
    return s.join(sizes, "clone").select("clone", "col", (F.col("s") / F.col("n")).alias("mean"))


# --- lineage -----------------------------------------------------------------


def fate_probability(labels: DataFrame) -> DataFrame:
    """``clone, type, p`` = P(type given clone) from ``id, clone, type``."""
    return shares(labels.where("clone >= 0"), "type", "clone").withColumnRenamed("share", "p")


def _bias(p: DataFrame, key: str, n: DataFrame) -> DataFrame:
    h = p.groupBy(key).agg((-F.sum(F.col("share") * F.log("share"))).alias("h")).crossJoin(F.broadcast(n))
    return h.select(key, F.when(F.col("k") > 1, 1 - F.col("h") / F.log(F.col("k").cast("double"))).otherwise(F.lit(1.0)).alias("bias"))


def fate_bias(labels: DataFrame) -> DataFrame:
    """``clone, bias`` = 1 - H(type given clone) / log(types)."""
    d = labels.where("clone >= 0")
    return _bias(shares(d, "type", "clone"), "clone", labels.agg(F.countDistinct("type").alias("k")))


def fate_bias_per_type(labels: DataFrame) -> DataFrame:
    d = labels.where("clone >= 0")
    return _bias(shares(d, "clone", "type"), "type", d.agg(F.countDistinct("clone").alias("k")))


def lineage_commitment(labels: DataFrame) -> DataFrame:
    return labels.join(fate_bias(labels), "clone", "left").select("id", F.coalesce("bias", F.lit(0.0)).alias("commitment"))


def lineage_sharing(labels: DataFrame) -> DataFrame:
    """``a, b, jaccard`` of the clone sets of type pairs (a < b) that share a clone."""
    s = labels.where("clone >= 0").select("clone", "type").distinct()
    n = s.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    both = s.join(s.select("clone", F.col("type").alias("b")), "clone").where("type < b").groupBy(F.col("type").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))
    j = both.join(n.select(F.col("type").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("type").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def lineage_tree(labels: DataFrame) -> DataFrame:
    """``clone, parent``: the clone with the latest earlier mean time (ties: smaller id); none: -1."""
    m = labels.where("clone >= 0").groupBy("clone").agg(F.avg("t").alias("t"))
    at = m.groupBy("t").agg(F.min("clone").alias("first"))
    prev = at.withColumn("parent", F.lag("first").over(Window.orderBy("t")))  # one row a distinct time
    return m.join(prev.select("t", "parent"), "t").select("clone", F.coalesce("parent", F.lit(-1)).alias("parent"))


def clone_generation(tree: DataFrame, max_depth: int = 64) -> DataFrame:
    """``clone, generation``: steps to the root, by pointer jumping (log depth rounds)."""
    state = cut(tree.select("clone", F.col("parent").alias("up"), F.when(F.col("parent") >= 0, 1).otherwise(0).alias("d")))
    depth = 1
    while depth < max_depth:
        nxt = state.select(F.col("clone").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        state = cut(state.join(nxt, "up", "left").select("clone", F.coalesce("up2", F.lit(-1)).alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
        if state.where("up >= 0").isEmpty():
            break
        depth *= 2
    return state.select("clone", F.col("d").alias("generation"))


def lineage_distance(tree: DataFrame, max_depth: int = 64) -> DataFrame:
    """``a, b, distance`` over the lowest common ancestor for clone pairs (a < b) of one tree.

    Ancestor lists are built by a loop over depth; the output itself has all pairs of a tree. A pair meets
    at its lowest common ancestor alone, which it reaches by two different children, so pairs are put out
    where they are made. (Of what is no tree, with clones that have two parents or are their own ancestors,
    the shortest way counts.)"""
    tree = tree.select("clone", "parent").distinct()
    up = cut(tree.select("clone", F.col("clone").alias("anc"), F.lit(0).alias("d"), F.lit(None).cast(tree.schema["clone"].dataType).alias("child")))
    every, front, ended = up, up, False
    for _ in range(max_depth):
        front = cut(front.join(tree.select(F.col("clone").alias("anc"), "parent"), "anc").where("parent >= 0").select("clone", F.col("parent").alias("anc"), (F.col("d") + 1).alias("d"), F.col("anc").alias("child")))
        if front.isEmpty():
            ended = True
            break
        every = every.unionByName(front)
    parts = max(1, math.isqrt(every.count() // 256))  # shares of an ancestor's clones
    one = every.withColumn("s", F.pmod(F.xxhash64("clone"), F.lit(parts)).cast("int")).repartition(8 * parts, "anc", "s")
    two = every.select(F.col("clone").alias("b"), "anc", F.col("d").alias("db"), F.col("child").alias("child2"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("s"))
    j = one.join(two, ["anc", "s"]).where("clone < b").select(F.col("clone").alias("a"), "b", (F.col("d") + F.col("db")).alias("distance"), "child", "child2")
    if not ended or not tree.groupBy("clone").count().where("count > 1").isEmpty():
        return j.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return j.where("not (child <=> child2)").select("a", "b", "distance")


def barcode_clones(barcodes: DataFrame) -> DataFrame:
    """``id, clone``: dense ids in the order of barcodes, from ``id, barcode``."""
    from .testing import positions

    ids = positions(barcodes.select(F.col("barcode").alias("id")).distinct()).select(F.col("id").alias("barcode"), F.col("pos").cast("long").alias("clone"))
    return barcodes.join(ids, "barcode").select("id", "clone")


def progenitor_score(labels: DataFrame) -> DataFrame:
    """``id, score`` = exp(-(t - earliest t of the clone)) in clones of more than one row, else 0."""
    c = labels.where("clone >= 0").groupBy("clone").agg(F.min("t").alias("t0"), F.count(F.lit(1)).alias("n"))
    return labels.join(c, "clone", "left").select("id", F.when(F.col("n") > 1, F.exp(-(F.col("t") - F.col("t0")))).otherwise(F.lit(0.0)).alias("score"))


def lineage_transitions(labels: DataFrame) -> DataFrame:
    """``src, dst, p``: types of consecutive rows in time within a clone, rows normalised."""
    w = Window.partitionBy("clone").orderBy("t", "id")
    s = labels.where("clone >= 0").select(F.col("type").alias("src"), F.lead("type").over(w).alias("dst")).where("dst is not null")
    return shares(s, "dst", "src").withColumnRenamed("share", "p")


# --- communities -------------------------------------------------------------


def modularity(g: Graph, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``q`` of ``id, label`` on a symmetric graph (both directions stored)."""
    m2 = g.edges.agg(F.sum("w").alias("m2"))
    k = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).join(labels, "id")
    tot = k.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    inside = g.edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("l1")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("l2")), "dst").where("l1 = l2").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("i"))
    return inside.crossJoin(tot).crossJoin(m2).select(F.coalesce(F.col("i") / F.nullif(F.col("m2"), F.lit(0.0)) - resolution * F.col("tt") / F.nullif(F.col("m2") * F.col("m2"), F.lit(0.0)), F.lit(0.0)).alias("q"))


def community_members(labels: DataFrame, community: int) -> DataFrame:
    return labels.where(F.col("label") == community).select("id")


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
