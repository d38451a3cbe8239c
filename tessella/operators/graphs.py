"""Graph traversal, centrality, diffusion, Markov chains, propagation, pseudotime, message passing.

Loops run over small state tables that are cut to the shared checkpoint folder;
every step is a join with the edges and an aggregate with map-side partials.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut, iterate
from ..model import Graph, Matrix
from .matrix import row_distances
from .neighbors import weighted_vote

INF = 1e30

# --- structure ---------------------------------------------------------------


def undirected(g: Graph) -> DataFrame:
    """``a, b`` with a < b, once each."""
    return g.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def connected_components(g: Graph) -> DataFrame:
    """``id, component`` (its smallest id): minimum labels with pointer jumping."""
    e = cut(undirected(g))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lab = cut(g.nodes.select("id", F.col("id").alias("c")))
    while True:
        low = both.join(lab.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        hook = lab.join(low, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("m", F.col("c"))).alias("c"))
        jump = cut(hook.join(hook.select(F.col("id").alias("c"), F.col("c").alias("up")), "c").select("id", "old", F.least("c", "up").alias("c")))
        lab = jump.select("id", "c")
        if jump.where("c <> old").isEmpty():
            return lab.withColumnRenamed("c", "component")


def component_sizes(g: Graph) -> DataFrame:
    return connected_components(g).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def is_connected(g: Graph) -> DataFrame:
    return connected_components(g).agg((F.countDistinct("component") <= 1).alias("connected"))


def largest_component(g: Graph) -> DataFrame:
    c = connected_components(g)
    best = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(best.select("component")), "component", "left_semi").select("id")


def bfs(g: Graph, sources: list[int], max_hops: int = 1000) -> DataFrame:
    """``id, hops, pred``: distance to the nearest source and the smallest predecessor; -1 out of reach.

    Only the frontier is expanded; a hop is one join."""
    seen = cut(g.nodes.where(F.col("id").isin(sources)).select("id", F.lit(0).alias("hops"), F.lit(-1).cast("long").alias("pred")))
    front, hop = seen, 0
    while hop < max_hops:
        hop += 1
        nxt = front.select(F.col("id").alias("src")).join(g.edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("pred"))
        front = cut(nxt.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hops"), "pred"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if hop % 4 == 0 else seen.unionByName(front)
    return g.over_nodes(seen).select("id", F.coalesce("hops", F.lit(-1)).alias("hops"), F.coalesce("pred", F.lit(-1)).alias("pred"))


def all_hops(g: Graph, sources: DataFrame | None = None, max_hops: int = 1000) -> DataFrame:
    """``source, id, hops`` for every reachable pair from all (or the given) sources: BFS of all sources at once."""
    s = g.nodes if sources is None else sources
    seen = cut(s.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops")))
    e = cut(g.edges.select("src", "dst").distinct())
    front, hop = seen, 0
    while hop < max_hops:
        hop += 1
        nxt = front.select("source", F.col("id").alias("src")).join(e, "src").select("source", F.col("dst").alias("id")).distinct()
        front = cut(nxt.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    return seen


def graph_diameter(g: Graph) -> DataFrame:
    from .traversal import hop_counts

    return hop_counts(g).agg(F.coalesce(F.max("hop"), F.lit(0)).alias("diameter"))


def average_path_length(g: Graph) -> DataFrame:
    from .traversal import hop_counts

    return hop_counts(g).agg(F.coalesce(F.sum(F.col("hop") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("length"))


def topological_sort(g: Graph) -> DataFrame:
    """``id, level`` in topological order of levels (Kahn); nodes on or behind a cycle have level -1."""
    left, level, out = cut(g.nodes), 0, None
    e = g.edges.select("src", "dst").distinct()
    while True:
        live = e.join(left.select(F.col("id").alias("src")), "src", "left_semi")
        free = cut(left.join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            rest = left.withColumn("level", F.lit(-1))
            return rest if out is None else out.unionByName(rest)
        out = free if out is None else out.unionByName(free)
        left, level = cut(left.join(free, "id", "left_anti")), level + 1


def _oriented(g: Graph) -> DataFrame:
    """Each undirected edge from its end of lower degree: out-degrees stay below sqrt(2 m)."""
    e = undirected(g)
    deg = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    j = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return j.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))


def triangles(g: Graph) -> DataFrame:
    """``x, y, z`` once each; wedges start at the end of lowest degree, so hubs make few."""
    o = cut(_oriented(g))
    w = o.join(o.select("u", F.col("v").alias("t")), "u").where("v < t")
    close = undirected(g).select(F.col("a").alias("v"), F.col("b").alias("t"))
    return w.join(close, ["v", "t"]).select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("t").alias("z"))


def count_triangles(g: Graph) -> DataFrame:
    return triangles(g).agg(F.count(F.lit(1)).alias("n"))


def _degrees(g: Graph) -> DataFrame:
    return undirected(g).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))


#: Edges of a task that counts triangles, and wedges it holds at once.
TRIANGLE_EDGES, TRIANGLE_WEDGES = 1_500_000, 2_000_000


def _count_colours(key, edges):
    """Triangles by node among nodes x < y < z of three colours (ordered by colour, then id)."""
    import numpy as np
    import pyarrow as pa

    i, j, k = (v.as_py() for v in key)
    u, v, cu, cv = (edges[c].to_numpy() for c in ("u", "v", "cu", "cv"))
    pick = lambda p, q: (u[(cu == p) & (cv == q)], v[(cu == p) & (cv == q)])
    (x1, y1), (y2, z2), (x3, z3) = pick(i, j), pick(j, k), pick(i, k)
    xs, ys, zs = np.unique(x3), np.unique(y2), np.unique(z3)
    total = {"id": [], "t": []}
    if len(xs) and len(ys) and len(zs):
        place = lambda a, b: np.minimum(np.searchsorted(a, b), len(a) - 1)
        has = np.isin(x1, xs) & np.isin(y1, ys)
        x, y = place(xs, x1[has]), place(ys, y1[has])
        has = np.isin(z2, zs)
        y2, z2 = place(ys, y2[has]), place(zs, z2[has])
        order = np.argsort(y2, kind="stable")
        z2, start = z2[order], np.searchsorted(y2[order], np.arange(len(ys) + 1))
        closing = place(xs, x3) * len(zs) + place(zs, z3)
        dense = len(xs) * len(zs) <= 1 << 26
        if dense:
            there = np.zeros(len(xs) * len(zs), dtype=bool)
            there[closing] = True
        else:
            closing = np.sort(closing)
        n = start[y + 1] - start[y]
        ends = np.cumsum(n)
        counts = [np.zeros(len(a), dtype=np.int64) for a in (xs, ys, zs)]
        at = 0
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TRIANGLE_WEDGES, side="right")))
            m = n[at:stop]
            first = np.repeat(np.arange(at, stop), m)
            z = z2[np.arange(len(first)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[y[at:stop]], m)]
            w = x[first] * len(zs) + z
            hit = there[w] if dense else closing[np.minimum(np.searchsorted(closing, w), len(closing) - 1)] == w
            first, z = first[hit], z[hit]
            for c, ids in zip(counts, (x[first], y[first], z)):
                c += np.bincount(ids, minlength=len(c))
            at = stop
        for ids, c in zip((xs, ys, zs), counts):
            total["id"].append(ids[c > 0])
            total["t"].append(c[c > 0])
    return pa.table({c: np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64) for c, a in total.items()})


def triangle_counts(g: Graph) -> DataFrame:
    """``id, t``: triangles by node (nodes in none are left out). Nodes are coloured, and a task gets the
    edges of three colours, so an edge travels once a colour and no wedge does."""
    e = cut(undirected(g))
    colours = max(1, math.ceil(math.sqrt(6 * e.count() / TRIANGLE_EDGES)))
    colour = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(colours)).cast("int")
    e = e.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), colour("a").alias("ca"), colour("b").alias("cb"))
    swap = F.col("ca") > F.col("cb")
    e = e.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for x, y, n in (("a", "b", "u"), ("b", "a", "v"), ("ca", "cb", "cu"), ("cb", "ca", "cv"))])
    e = e.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(colours - 1))))
    three = F.array_sort(F.array("cu", "cv", "c"))
    parts = max(1, colours * (colours + 1) * (colours + 2) // 6)
    e = e.select("u", "v", "cu", "cv", *[three[i].alias(n) for i, n in enumerate("ijk")]).repartition(parts, "i", "j", "k")
    return e.groupBy("i", "j", "k").applyInArrow(_count_colours, "id long, t long").groupBy("id").agg(F.sum("t").alias("t"))


def clustering_coefficient(g: Graph) -> DataFrame:
    t = triangle_counts(g)
    d = g.over_nodes(_degrees(g)).join(t, "id", "left").fillna(0)
    return d.select("id", F.when(F.col("d") > 1, 2 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(F.lit(0.0)).alias("coefficient"))


def global_clustering(g: Graph) -> DataFrame:
    w = _degrees(g).agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("w"))
    return count_triangles(g).crossJoin(w).select(F.coalesce(3 * F.col("n") / F.nullif(F.col("w"), F.lit(0.0)), F.lit(0.0)).alias("coefficient"))


def degree_sequence(g: Graph) -> DataFrame:
    d = g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return g.over_nodes(d).select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_statistics(g: Graph) -> DataFrame:
    return degree_sequence(g).agg(F.avg("degree").alias("mean"), F.max("degree").alias("max"), F.min("degree").alias("min"), F.stddev_pop("degree").alias("std"))


def degree_distribution(g: Graph, max_degree: int) -> DataFrame:
    return degree_sequence(g).where(F.col("degree") <= max_degree).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def graph_density(g: Graph) -> DataFrame:
    n = float(g.n)
    return g.edges.agg((F.count(F.lit(1)) / 2 / max(n * (n - 1) / 2, 1.0)).alias("density"))


def kcore(g: Graph) -> DataFrame:
    """``id, core``: h-index iteration on neighbours' values, which ends at the core numbers."""
    e = undirected(g)
    both = cut(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.select(F.col("b").alias("src"), F.col("a").alias("dst"))))

    def step(s: DataFrame) -> DataFrame:
        v = both.join(s.select(F.col("id").alias("dst"), F.col("x").alias("o")), "dst").groupBy("src", "o").agg(F.count(F.lit(1)).alias("c"))
        down = Window.partitionBy("src").orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
        h = v.withColumn("at", F.least(F.sum("c").over(down), F.col("o"))).groupBy(F.col("src").alias("id")).agg(F.max("at").alias("h"))
        return s.join(h, "id", "left").select("id", F.least("x", F.coalesce("h", F.lit(0))).alias("x"))

    start = cut(g.over_nodes(_degrees(g)).select("id", F.coalesce("d", F.lit(0)).alias("x")))
    return iterate(start, step, 10_000, tol=0.5).select("id", F.col("x").alias("core"))


# --- centrality --------------------------------------------------------------


def degree_centrality(g: Graph, normalize: bool = True) -> DataFrame:
    k = max(g.n - 1, 1) if normalize else 1
    return degree_sequence(g).select("id", (F.col("degree") / F.lit(float(k))).alias("centrality"))


def weighted_degree_centrality(g: Graph, normalize: bool = True) -> DataFrame:
    d = g.over_nodes(g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("s"))).select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
    top = d.agg(F.max("s").alias("m"))
    return d.crossJoin(F.broadcast(top)).select("id", (F.coalesce(F.col("s") / F.nullif(F.col("m"), F.lit(0.0)), F.lit(0.0)) if normalize else F.col("s")).alias("centrality"))


def pagerank(g: Graph, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, seeds: DataFrame | None = None) -> DataFrame:
    """``id, x``; dangling mass and teleports go to all nodes, or to the seeds (``id``)."""
    out = g.edges.groupBy("src").agg(F.sum("w").alias("t"))
    p = cut(g.edges.join(out, "src").where("t > 0").select("src", "dst", (F.col("w") / F.col("t")).alias("p")))
    if seeds is None:
        base = g.nodes.select("id", F.lit(1.0 / max(g.n, 1)).alias("b"))
    else:
        base = g.over_nodes(seeds.distinct().withColumn("b", F.lit(1.0 / max(seeds.distinct().count(), 1)))).select("id", F.coalesce("b", F.lit(0.0)).alias("b"))
    base = cut(base.join(p.select(F.col("src").alias("id")).distinct().withColumn("o", F.lit(1)), "id", "left").select("id", "b", F.col("o").isNull().alias("dangling")))

    none_lost = base.where("dangling").isEmpty()

    def step(s: DataFrame) -> DataFrame:
        inflow = p.join(s.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("x")).alias("f"))
        if none_lost:
            return base.join(inflow, "id", "left").select("id", ((1 - damping) * F.col("b") + damping * F.coalesce("f", F.lit(0.0))).alias("x"))
        lost = s.join(base.where("dangling"), "id").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
        return base.join(inflow, "id", "left").crossJoin(F.broadcast(lost)).select("id", ((1 - damping) * F.col("b") + damping * (F.coalesce("f", F.lit(0.0)) + F.col("lost") * F.col("b"))).alias("x"))

    return iterate(base.select("id", F.col("b").alias("x")), step, max_iter, tol, every=4 if none_lost else 1)


def personalized_pagerank(g: Graph, seeds: DataFrame, **kw) -> DataFrame:
    return pagerank(g, seeds=seeds, **kw)


def _normalized(d: DataFrame, name: str) -> DataFrame:
    d = cut(d)  # read for its length and for its values
    n = d.agg(F.sqrt(F.sum(F.col(name) * F.col(name)))).first()[0]
    return d.withColumn(name, F.col(name) / F.lit(n) if n else F.lit(0.0))


def _push(g: Graph, s: DataFrame, name: str = "x", transpose: bool = False) -> DataFrame:
    """``id, f``: A s, or A' s."""
    a, b = ("dst", "src") if not transpose else ("src", "dst")
    return g.edges.join(s.select(F.col("id").alias(a), F.col(name).alias("_s")), a).groupBy(F.col(b).alias("id")).agg(F.sum(F.col("w") * F.col("_s")).alias("f"))


def hits(g: Graph, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """``id, x`` (hub) and ``auth``."""

    def step(s: DataFrame) -> DataFrame:
        auth = _normalized(g.over_nodes(_push(g, s, transpose=True)).select("id", F.coalesce("f", F.lit(0.0)).alias("auth")), "auth")
        hub = _normalized(g.over_nodes(_push(g, auth, "auth")).select("id", F.coalesce("f", F.lit(0.0)).alias("x")), "x")
        return hub.join(auth, "id")

    start = cut(g.nodes.select("id", F.lit(1.0 / math.sqrt(max(g.n, 1))).alias("x"), F.lit(0.0).alias("auth")))
    return iterate(start, step, max_iter, tol)


def eigenvector_centrality(g: Graph, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    start = cut(g.nodes.select("id", F.lit(1.0 / math.sqrt(max(g.n, 1))).alias("x")))
    return iterate(start, lambda s: _normalized(g.over_nodes(_push(g, s)).select("id", F.coalesce("f", F.lit(0.0)).alias("x")), "x"), max_iter, tol)


def katz_centrality(g: Graph, alpha: float = 0.1, beta: float = 1.0, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    start = cut(g.nodes.select("id", F.lit(0.0).alias("x")))
    return iterate(start, lambda s: g.over_nodes(_push(g, s)).select("id", (alpha * F.coalesce("f", F.lit(0.0)) + beta).alias("x")), max_iter, tol, every=4)


def closeness_centrality(g: Graph, normalize: bool = True) -> DataFrame:
    from .traversal import closeness

    return closeness(g, normalize)


def harmonic_centrality(g: Graph, normalize: bool = True) -> DataFrame:
    from .traversal import harmonic

    return harmonic(g, normalize)


def betweenness_centrality(g: Graph, normalize: bool = True, sources: DataFrame | None = None) -> DataFrame:
    from .traversal import betweenness

    return betweenness(g, normalize, sources)


# --- transitions and diffusion -----------------------------------------------


def row_stochastic(g: Graph, positive: bool = False) -> DataFrame:
    """``src, dst, w`` with rows summing to 1; nodes without weight loop on themselves."""
    e = g.edges.where("w > 0") if positive else g.edges
    p = e.withColumn("_t", F.sum("w").over(Window.partitionBy("src"))).where("_t <> 0").select("src", "dst", (F.col("w") / F.col("_t")).alias("w"))
    alone = g.nodes.join(p.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    return p.unionByName(alone)


def symmetric_normalized(g: Graph) -> DataFrame:
    """D^-1/2 A D^-1/2."""
    d = g.edges.groupBy("src").agg(F.sum("w").alias("d"))
    j = g.edges.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    return j.where("d > 0 and d2 > 0").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))


def symmetrize_transition(g: Graph) -> DataFrame:
    both = g.edges.select("src", "dst", F.col("w") / 2).toDF("src", "dst", "w").unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / 2).alias("w")))
    return row_stochastic(Graph(both.groupBy("src", "dst").agg(F.sum("w").alias("w")), g.nodes))


def diffuse_vector(g: Graph, x: DataFrame, steps: int, laziness: float = 0.0) -> DataFrame:
    """x <- laziness x + (1 - laziness) T x."""

    def step(s: DataFrame) -> DataFrame:
        j = s.join(_push(g, s), "id", "left")
        return j.select("id", (laziness * F.col("x") + (1 - laziness) * F.coalesce("f", F.lit(0.0))).alias("x"))

    return iterate(x, step, steps, every=1)


def heat_kernel_signature(g: Graph, t: float = 1.0, n_steps: int = 10) -> DataFrame:
    dt = t / n_steps
    return diffuse_vector(g, g.nodes.select("id", F.lit(1.0).alias("x")), n_steps, 1 - dt)


def random_walk_with_restart(g: Graph, seeds: list[int], alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """x = alpha T x + (1 - alpha) restart."""
    g = Graph(cut(g.edges.select("src", "dst", "w")), g.nodes)
    r = cut(g.nodes.select("id", F.when(F.col("id").isin(seeds), 1.0 / len(seeds)).otherwise(0.0).alias("r")))

    def step(s: DataFrame) -> DataFrame:
        return r.join(_push(g, s), "id", "left").select("id", (alpha * F.coalesce("f", F.lit(0.0)) + (1 - alpha) * F.col("r")).alias("x"))

    return iterate(r.select("id", F.col("r").alias("x")), step, max_iter, tol, every=4)


def dpt(g: Graph, root: int, max_iter: int = 100) -> DataFrame:
    """``id, t``: expected first-visit time of a walk from the root (mass not yet arrived moves on),
    over the largest; nodes visited with a probability up to 0.5 have 1."""
    start = g.nodes.select("id", (F.col("id") == root).cast("double").alias("x"), (F.col("id") == root).cast("double").alias("v"), F.lit(0.0).alias("t"), F.lit(0).alias("k"))

    def step(s: DataFrame) -> DataFrame:
        j = s.join(_push(g, s, transpose=True), "id", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
        new = F.greatest(F.lit(0.0), F.least(F.col("f"), 1 - F.col("v")))
        return j.select("id", F.col("f").alias("x"), (F.col("v") + new).alias("v"), (F.col("t") + (F.col("k") + 1) * new).alias("t"), (F.col("k") + 1).alias("k"))

    s = cut(iterate(start, step, max_iter, every=1))
    s = s.select("id", F.when(F.col("v") > 0.5, F.col("t") / F.col("v")).alias("t"))
    return s.crossJoin(F.broadcast(s.agg(F.max("t").alias("m")))).select("id", F.coalesce(F.col("t") / F.nullif(F.col("m"), F.lit(0.0)), F.when(F.col("id") == root, 0.0).otherwise(1.0)).alias("t"))


def dpt_multi_root(g: Graph, roots: list[int], max_iter: int = 100) -> DataFrame:
    out = None
    for r in roots:
        d = dpt(g, r, max_iter)
        out = d if out is None else out.unionByName(d)
    return out.groupBy("id").agg(F.avg("t").alias("t"))


def diffusion_distance(g: Graph, n_steps: int = 3) -> DataFrame:
    """``a, b, dist`` (a < b): L2 of rows of T^n that share a column; others differ by both norms."""
    rows = iterate(g.edges.select(F.col("src").alias("id"), F.col("dst").alias("col"), F.col("w").alias("x")), lambda s: g.edges.select(F.col("src").alias("id"), F.col("dst").alias("mid"), "w").join(s.select(F.col("id").alias("mid"), "col", "x"), "mid").groupBy("id", "col").agg(F.sum(F.col("w") * F.col("x")).alias("x")), n_steps - 1)
    rows = cut(rows)
    m = Matrix(rows.select(F.col("id").alias("row"), "col", F.col("x").alias("v")), g.nodes.select(F.col("id").alias("row")), g.nodes.select(F.col("id").alias("col")))
    return row_distances(m).select(F.col("row").alias("a"), F.col("other").alias("b"), F.col("r").alias("dist"))


def stationary_distribution(g: Graph, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    t = Graph(cut(row_stochastic(g)), g.nodes)
    start = cut(g.nodes.select("id", F.lit(1.0 / max(g.n, 1)).alias("x")))
    return iterate(start, lambda s: g.over_nodes(_push(t, s, transpose=True)).select("id", F.coalesce("f", F.lit(0.0)).alias("x")), max_iter, tol, every=8)


def terminal_states(g: Graph, threshold: float = 0.8) -> DataFrame:
    """``id, terminal``: a self-loop of at least that share of the row, or at most one entry."""
    s = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("t"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("l"), F.count(F.lit(1)).alias("k"))
    return g.over_nodes(s).select("id", F.coalesce((F.col("l") >= threshold * F.col("t")) | (F.col("k") <= 1), F.lit(True)).alias("terminal"))


def _fixed(g: Graph, fixed: DataFrame, add: float, max_iter: int, tol: float, start: float = 0.0) -> DataFrame:
    """Solution of x = add + P x off the fixed nodes (``id, f``), Jacobi to the fixed point."""
    base = cut(g.over_nodes(fixed.withColumnRenamed("f", "fix")))
    t = Graph(cut(row_stochastic(g)), g.nodes)

    def step(s: DataFrame) -> DataFrame:
        return base.join(_push(t, s), "id", "left").select("id", F.coalesce("fix", add + F.coalesce("f", F.lit(0.0))).alias("x"))

    return iterate(base.select("id", F.coalesce("fix", F.lit(start)).alias("x")), step, max_iter, tol, norm="max", every=8)


def absorption_probability(g: Graph, terminals: list[int], max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """``id, terminal, p`` for every terminal state."""
    out = None
    for t in terminals:
        fixed = g.nodes.where(F.col("id").isin(terminals)).select("id", (F.col("id") == t).cast("double").alias("f"))
        p = _fixed(g, fixed, 0.0, max_iter, tol).select("id", F.lit(t).alias("terminal"), F.col("x").alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def hitting_time(g: Graph, targets: list[int], max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """``id, t``: expected steps to a target; 1e30 where none is reached."""
    back = Graph(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), g.nodes)
    reach = bfs(back, targets).where("hops >= 0").select("id")
    fixed = g.nodes.where(F.col("id").isin(targets)).select("id", F.lit(0.0).alias("f"))
    x = _fixed(g, fixed, 1.0, max_iter, tol)
    return x.join(reach.withColumn("ok", F.lit(True)), "id", "left").select("id", F.when(F.col("ok"), F.col("x")).otherwise(F.lit(INF)).alias("t"))


def time_to_absorption(g: Graph, absorbing: list[int], max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    return hitting_time(g, absorbing, max_iter, tol)


def forward_committor(g: Graph, sources: list[int], targets: list[int], max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """``id, q``: probability to reach a target before a source."""
    fixed = g.nodes.where(F.col("id").isin(sources + targets)).select("id", F.col("id").isin(targets).cast("double").alias("f"))
    return _fixed(g, fixed, 0.0, max_iter, tol).withColumnRenamed("x", "q")


def harmonic_function(g: Graph, known: DataFrame, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """``id, x``: unknown nodes are the weighted mean of their neighbours."""
    return _fixed(g, known.select("id", F.col("value").alias("f")), 0.0, max_iter, tol)


def coarse_grain(g: Graph, labels: DataFrame) -> DataFrame:
    """``a, b, p``: weights summed by state pair, rows normalised."""
    s = g.edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return s.select("a", "b", F.coalesce(F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy("a")), F.lit(0.0)), F.lit(0.0)).alias("p"))


def fate_entropy(p: DataFrame) -> DataFrame:
    return p.groupBy("id").agg(F.coalesce(F.sum(F.when(F.col("p") > 1e-15, -F.col("p") * F.log("p"))), F.lit(0.0)).alias("h"))


def directional_score(g: Graph, pseudotime: DataFrame) -> DataFrame:
    """``id, score`` = (forward - backward) / (forward + backward) mass."""
    j = g.edges.join(pseudotime.select(F.col("id").alias("src"), F.col("t").alias("t1")), "src").join(pseudotime.select(F.col("id").alias("dst"), F.col("t").alias("t2")), "dst")
    fwd, bwd = F.sum(F.when(F.col("t2") > F.col("t1"), F.col("w")).otherwise(0.0)), F.sum(F.when(F.col("t2") < F.col("t1"), F.col("w")).otherwise(0.0))
    s = j.groupBy(F.col("src").alias("id")).agg(F.coalesce((fwd - bwd) / F.nullif(fwd + bwd, F.lit(0.0)), F.lit(0.0)).alias("score"))
    return g.over_nodes(s).select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


# --- propagation -------------------------------------------------------------


def label_propagation(g: Graph, labels: DataFrame, max_iter: int = 100) -> DataFrame:
    """``id, label``: unlabelled nodes (label -1) take their labelled neighbours' weighted vote, in rounds, until none changes."""

    def step(s: DataFrame) -> DataFrame:
        votes = g.edges.join(s.where("label >= 0").select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w")
        v = weighted_vote(votes).select("id", F.col("label").alias("new"))
        return s.join(v, "id", "left").select("id", F.when(F.col("label") < 0, F.coalesce("new", F.col("label"))).otherwise(F.col("label")).alias("label"))

    return iterate(cut(labels.select("id", "label")), step, max_iter, tol=0.5, value="label")


def label_spreading(g: Graph, seeds: DataFrame, alpha: float = 0.99, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """``id, label, x``: Y <- alpha S Y, plus (1 - alpha) Y0 for labelled nodes, rows normalised."""
    s = cut(symmetric_normalized(g))
    y0 = cut(seeds.select("id", "label", F.lit(1.0).alias("y0")))
    start = y0.select("id", "label", F.col("y0").alias("x"), F.concat_ws(":", "id", "label").alias("k"))

    def step(y: DataFrame) -> DataFrame:
        f = s.join(y.select(F.col("id").alias("dst"), "label", "x"), "dst").groupBy(F.col("src").alias("id"), "label").agg((alpha * F.sum(F.col("w") * F.col("x"))).alias("f"))
        z = f.join(y0, ["id", "label"], "full").select("id", "label", (F.coalesce("f", F.lit(0.0)) + (1 - alpha) * F.coalesce("y0", F.lit(0.0))).alias("z"))
        t = F.sum("z").over(Window.partitionBy("id"))
        return z.select("id", "label", F.coalesce(F.col("z") / F.nullif(t, F.lit(0.0)), F.lit(0.0)).alias("x"), F.concat_ws(":", "id", "label").alias("k"))

    return iterate(start, step, max_iter, tol, key="k", every=4).drop("k")


def hard_labels(probs: DataFrame) -> DataFrame:
    """``id, label, p``: the most probable label, ties to the lower."""
    w = Window.partitionBy("id").orderBy(F.desc("x"), "label")
    return probs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("id", "label", F.col("x").alias("p"))


def soft_labels(labels: DataFrame, n_classes: int, confidence: float = 1.0) -> DataFrame:
    """``id, label, x``: smoothed one-hot rows; uniform for label -1."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))
    rest = (1 - confidence) / max(n_classes - 1, 1)
    d = labels.select("id", F.col("label").alias("own"), k.alias("label"))
    return d.select("id", "label", F.when(F.col("own") < 0, F.lit(1.0 / n_classes)).when(F.col("own") == F.col("label"), F.lit(confidence)).otherwise(F.lit(rest)).alias("x"))


def inductive_transfer(edges: DataFrame, labels: DataFrame, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``id, label``: weighted vote of references (``query, ref, w``), -1 under the confidence."""
    v = weighted_vote(edges.join(labels.select(F.col("id").alias("ref"), "label"), "ref").select(F.col("query").alias("id"), "label", "w"))
    return queries.join(v, "id", "left").select("id", F.when(F.col("confidence") >= threshold, F.col("label")).otherwise(F.lit(-1)).alias("label"))


def confidence_propagation(g: Graph, labels: DataFrame, alpha: float = 0.99, max_iter: int = 100) -> DataFrame:
    """``id, label, confidence``: votes sum w * confidence plus alpha times the own, until labels are stable."""

    def step(s: DataFrame) -> DataFrame:
        v = g.edges.join(s.where("label >= 0").select(F.col("id").alias("dst"), "label", "confidence"), "dst").select(F.col("src").alias("id"), "label", (F.col("w") * F.col("confidence")).alias("w"))
        v = v.unionByName(s.where("label >= 0").select("id", "label", (alpha * F.col("confidence")).alias("w")))
        b = weighted_vote(v).select("id", F.col("label").alias("l"), F.col("confidence").alias("c"))
        return s.join(b, "id", "left").select("id", F.coalesce("l", F.col("label")).alias("label"), F.coalesce("c", F.col("confidence")).alias("confidence"))

    return iterate(cut(labels), step, max_iter, tol=0.5, value="label")


# --- pseudotime --------------------------------------------------------------


def shortest_paths(g: Graph, sources: list[int], max_iter: int = 1000) -> DataFrame:
    """``source, id, x``: distances over positive weights (others count 1); 1e30 out of reach.

    Bellman-Ford on the rows that improved, so a round costs its frontier."""
    e = cut(g.edges.select("src", "dst", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("w")))
    best = cut(g.nodes.where(F.col("id").isin(sources)).select(F.col("id").alias("source"), "id", F.lit(0.0).alias("x")))
    front = best
    for _ in range(max_iter):
        cand = front.select("source", F.col("id").alias("src"), "x").join(e, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("x") + F.col("w")).alias("n"))
        j = cut(best.join(cand, ["source", "id"], "full").select("source", "id", "x", "n"))
        front = cut(j.where("n is not null and (x is null or n < x - 1e-12)").select("source", "id", F.col("n").alias("x")))
        best = j.select("source", "id", F.least(F.coalesce("x", F.lit(INF)), F.coalesce("n", F.lit(INF))).alias("x"))
        if front.isEmpty():
            break
    every = g.nodes.crossJoin(F.broadcast(best.select("source").distinct()))
    return every.join(best, ["source", "id"], "left").select("source", "id", F.coalesce("x", F.lit(INF)).alias("x"))


def graph_pseudotime(g: Graph, root: int) -> DataFrame:
    """``id, t``: distance from the root over the largest; 1 out of reach."""
    d = shortest_paths(g, [root]).select("id", F.when(F.col("x") < INF, F.col("x")).alias("x"))
    return d.crossJoin(F.broadcast(d.agg(F.max("x").alias("m")))).select("id", F.coalesce(F.col("x") / F.nullif(F.col("m"), F.lit(0.0)), F.when(F.col("id") == root, 0.0).otherwise(1.0)).alias("t"))


def compute_pseudotime(g: Graph, root: int, method: str = "shortest_path", k: int = 4) -> DataFrame:
    """``id, t`` by ``diffusion`` components, ``shortest_path`` or ``graph_distance`` (the same)."""
    if method == "diffusion":
        from .spectral import diffusion_pseudotime

        return diffusion_pseudotime(Graph(row_stochastic(g), g.nodes), root, k)
    if method not in ("shortest_path", "graph_distance"):
        raise ValueError("method must be diffusion, shortest_path or graph_distance")
    return graph_pseudotime(g, root)


def scaled_time(t: DataFrame) -> DataFrame:
    """``id, t`` from 0 to 1; as it is where all are equal."""
    r = t.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return t.crossJoin(r).select("id", F.when(F.col("hi") - F.col("lo") > 1e-15, (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("t")).alias("t"))  # one row


def velocity_weighted_pseudotime(g: Graph, pseudotime: DataFrame, velocity: DataFrame, n_iter: int = 20) -> DataFrame:
    """``id, t``: times drawn half way to their neighbours' mean, in which neighbours that are not
    earlier weigh 1 + v and earlier ones 1 / (1 + v) by the node's own velocity (``id, v``)."""
    e = cut(g.edges.select("src", "dst", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0).alias("w")).join(velocity.select(F.col("id").alias("src"), "v"), "src"))

    def step(s: DataFrame) -> DataFrame:
        j = e.join(s.select(F.col("id").alias("dst"), F.col("x").alias("y")), "dst").join(s.select(F.col("id").alias("src"), "x"), "src")
        w = F.col("w") * F.when(F.col("y") < F.col("x"), 1 / (1 + F.col("v"))).otherwise(1 + F.col("v"))
        m = j.groupBy(F.col("src").alias("id")).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("m"))
        return s.join(m, "id", "left").select("id", (0.5 * F.col("x") + 0.5 * F.coalesce("m", "x")).alias("x"))

    # The state is read three times a step.
    return scaled_time(iterate(cut(pseudotime.select("id", F.col("t").alias("x"))), step, n_iter, every=1).withColumnRenamed("x", "t"))


def select_root(markers: DataFrame) -> DataFrame:
    return markers.orderBy("value", "id").limit(1).select("id")


def select_root_peripheral(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.avg("w").alias("m")).orderBy(F.desc("m"), "id").limit(1).select("id")


def branch_points(g: Graph, pseudotime: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``id`` of nodes of degree 3 and more with one earlier and two later neighbours (or the reverse)."""
    j = g.edges.join(pseudotime.select(F.col("id").alias("src"), F.col("t").alias("t1")), "src").join(pseudotime.select(F.col("id").alias("dst"), F.col("t").alias("t2")), "dst")
    s = j.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"), F.sum((F.col("t2") < F.col("t1") - threshold).cast("int")).alias("e"), F.sum((F.col("t2") > F.col("t1") + threshold).cast("int")).alias("l"))
    return s.where("d >= 3 and ((e >= 1 and l >= 2) or (e >= 2 and l >= 1))").select("id")


def segment_trajectory(pseudotime: DataFrame, branches: DataFrame) -> DataFrame:
    """``id, segment``: branch times up to the own."""
    b = pseudotime.join(branches, "id", "left_semi").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return pseudotime.crossJoin(F.broadcast(b)).select("id", F.size(F.filter("ts", lambda x: x <= F.col("t"))).alias("segment"))


def smooth_pseudotime(g: Graph, pseudotime: DataFrame, n_iter: int = 10, alpha: float = 0.5) -> DataFrame:
    def step(s: DataFrame) -> DataFrame:
        m = g.edges.join(s.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
        return s.join(m, "id", "left").select("id", F.coalesce((1 - alpha) * F.col("x") + alpha * F.col("m"), F.col("x")).alias("x"))

    return iterate(cut(pseudotime.select("id", F.col("t").alias("x"))), step, n_iter, every=1).withColumnRenamed("x", "t")


def late_states(pseudotime: DataFrame, percentile: float = 0.95) -> DataFrame:
    """``id`` with t at or above the sorted value at index floor(p (n - 1))."""
    from .neighbors import estimate_threshold

    cutoff = estimate_threshold(pseudotime.select("id", F.col("t").alias("score")), 1 - percentile)
    return pseudotime.crossJoin(F.broadcast(cutoff)).where("t >= threshold").select("id")


def backbone(pseudotime: DataFrame, n: int) -> DataFrame:
    """``pos, id``: nodes evenly spaced in the order of time."""
    from .testing import ordered

    o = ordered(pseudotime.withColumn("p", F.col("t")))
    pos = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    want = o.agg(F.count(F.lit(1)).alias("c")).select("c", pos.alias("pos")).select("pos", (F.floor(F.col("pos") * (F.col("c") - 1) / max(n - 1, 1)) + 1).alias("rank"))
    return o.join(F.broadcast(want), "rank").select("pos", "id")


# --- message passing (``id, dim, x``) ----------------------------------------

AGGREGATIONS = {
    "sum": lambda w, x: F.sum(w * x), "mean": lambda w, x: F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0)),
    "max": lambda w, x: F.max(x), "min": lambda w, x: F.min(x),
}
ACTIVATIONS = {
    "none": lambda x: x, "relu": lambda x: F.greatest(x, F.lit(0.0)), "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.2 * x), "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh, "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)), "gelu": lambda x: 0.5 * x * (1 + F.tanh(0.7978845608 * (x + 0.044715 * x * x * x))),
}


def message_passing(g: Graph, x: DataFrame, kind: str = "mean") -> DataFrame:
    """Neighbours' vectors aggregated; isolated nodes keep their own."""
    m = g.edges.join(x.select(F.col("id").alias("dst"), "dim", "x"), "dst").groupBy(F.col("src").alias("id"), "dim").agg(AGGREGATIONS[kind](F.col("w"), F.col("x")).alias("m"))
    return x.join(m, ["id", "dim"], "left").select("id", "dim", F.coalesce("m", "x").alias("x"))


def sage_aggregate(g: Graph, x: DataFrame, kind: str = "mean", max_neighbors: int = 25) -> DataFrame:
    first = g.edges.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_r") <= max_neighbors)
    return message_passing(Graph(first.select("src", "dst", F.lit(1.0).alias("w")), g.nodes), x, kind)


def graph_convolution(g: Graph, x: DataFrame, weight: DataFrame, activation: str = "relu") -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 X W, then the activation; W is ``dim, out, w``."""
    loops = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    s = symmetric_normalized(Graph(g.edges.select("src", "dst", "w").unionByName(loops).groupBy("src", "dst").agg(F.sum("w").alias("w")), g.nodes))
    h = s.join(x.select(F.col("id").alias("dst"), "dim", "x"), "dst").groupBy(F.col("src").alias("id"), "dim").agg(F.sum(F.col("w") * F.col("x")).alias("h"))
    y = h.join(F.broadcast(weight.select("dim", "out", F.col("w").alias("wt"))), "dim").groupBy("id", F.col("out").alias("dim")).agg(F.sum(F.col("h") * F.col("wt")).alias("y"))
    return y.select("id", "dim", ACTIVATIONS[activation](F.col("y")).alias("x"))


def graph_attention(g: Graph, x: DataFrame, att: DataFrame, head: int = 0) -> DataFrame:
    """``id, dim, head, x``: softmax over neighbours (and self) of LeakyReLU(a1 . h_i + a2 . h_j);
    ``att`` is ``dim, a1, a2`` (weights of the two halves of the attention vector)."""
    e = g.edges.select("src", "dst").unionByName(g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    s = x.join(F.broadcast(att), "dim").groupBy("id").agg(F.sum(F.col("a1") * F.col("x")).alias("s1"), F.sum(F.col("a2") * F.col("x")).alias("s2"))
    j = e.join(s.select(F.col("id").alias("src"), "s1"), "src").join(s.select(F.col("id").alias("dst"), "s2"), "dst").withColumn("l", ACTIVATIONS["leaky_relu"](F.col("s1") + F.col("s2")))
    j = j.withColumn("e", F.exp(F.col("l") - F.max("l").over(Window.partitionBy("src"))))
    j = j.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("src")))
    return j.join(x.select(F.col("id").alias("dst"), "dim", "x"), "dst").groupBy(F.col("src").alias("id"), "dim").agg(F.sum(F.col("p") * F.col("x")).alias("x")).withColumn("head", F.lit(head))


def multi_head_attention(g: Graph, x: DataFrame, atts: list[DataFrame]) -> DataFrame:
    out = graph_attention(g, x, atts[0], 0)
    for h, a in enumerate(atts[1:], 1):
        out = out.unionByName(graph_attention(g, x, a, h))
    return out


def feature_smoothing(g: Graph, x: DataFrame, alpha: float = 0.5, n_iter: int = 1) -> DataFrame:
    """(1 - alpha) x + alpha^2 * weighted neighbour mean, n times (alpha enters twice by definition)."""
    out = x
    for _ in range(n_iter):
        m = message_passing(g, out).withColumnRenamed("x", "m")
        out = cut(out.join(m, ["id", "dim"]).select("id", "dim", ((1 - alpha) * F.col("x") + alpha * alpha * F.col("m")).alias("x")))
    return out


def global_pool(x: DataFrame, kind: str = "mean") -> DataFrame:
    return x.groupBy("dim").agg(AGGREGATIONS[kind](F.lit(1.0), F.col("x")).alias("x"))


def hierarchical_pool(x: DataFrame, clusters: DataFrame, kind: str = "mean") -> DataFrame:
    return x.join(clusters, "id").groupBy("cluster", "dim").agg(AGGREGATIONS[kind](F.lit(1.0), F.col("x")).alias("x"))


def edge_features(g: Graph, x: DataFrame, concat: bool = True) -> DataFrame:
    """``src, dst, dim, x``: both ends' vectors one after the other, or dst - src."""
    a = g.edges.select("src", "dst").join(x.select(F.col("id").alias("src"), "dim", F.col("x").alias("xi")), "src")
    if not concat:
        return a.join(x.select(F.col("id").alias("dst"), "dim", F.col("x").alias("xj")), ["dst", "dim"]).select("src", "dst", "dim", (F.col("xj") - F.col("xi")).alias("x"))
    d = x.agg((F.max("dim") + 1).alias("d"))
    b = g.edges.select("src", "dst").join(x.select(F.col("id").alias("dst"), "dim", F.col("x").alias("xj")), "dst").crossJoin(F.broadcast(d))
    return a.select("src", "dst", "dim", F.col("xi").alias("x")).unionByName(b.select("src", "dst", (F.col("dim") + F.col("d")).alias("dim"), F.col("xj").alias("x")))


def skip_connection(x: DataFrame, r: DataFrame, alpha: float = 1.0) -> DataFrame:
    return x.join(r.withColumnRenamed("x", "r"), ["id", "dim"], "left").select("id", "dim", (F.col("x") + alpha * F.coalesce("r", F.lit(0.0))).alias("x"))


def layer_norm(x: DataFrame, eps: float = 1e-5) -> DataFrame:
    w = Window.partitionBy("id")
    return x.select("id", "dim", ((F.col("x") - F.avg("x").over(w)) / F.sqrt(F.var_pop("x").over(w) + eps)).alias("x"))


def batch_norm(x: DataFrame, gamma: float = 1.0, beta: float = 0.0, eps: float = 1e-5) -> DataFrame:
    s = x.groupBy("dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return x.join(F.broadcast(s), "dim").select("id", "dim", (gamma * (F.col("x") - F.col("m")) / F.sqrt(F.col("v") + eps) + beta).alias("x"))


def dropout(x: DataFrame, rate: float, seed: int = 0, training: bool = True) -> DataFrame:
    """Zeroes cells with the rate by a hash of id and dim, and scales the rest."""
    if not training or rate <= 0:
        return x
    u = F.pmod(F.xxhash64("id", "dim", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return x.select("id", "dim", F.when(u < rate, F.lit(0.0)).otherwise(F.col("x") / (1 - rate)).alias("x"))


def pool_graph_connectivity(g: Graph, labels: DataFrame) -> DataFrame:
    """``share`` of labels whose nodes form one component."""
    l1, l2 = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    inner = g.edges.join(l1, "src").join(l2, "dst").where("a = b").select("src", "dst", "w")
    c = connected_components(Graph(inner, labels.select("id"))).join(labels, "id").groupBy("label").agg(F.countDistinct("component").alias("k"))
    return c.agg(F.avg((F.col("k") == 1).cast("double")).alias("share"))
