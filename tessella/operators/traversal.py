"""Traversal from many sources at once: a bit (or a column) for each source.

Hops: 64 sources share a row, whose ``seen`` and ``new`` are bit masks; a hop is one join
with the edges and one OR by node, for all of them. Path counts need numbers, so there a
row has a column for each of ``LANES`` sources. Sources are taken in groups
of which the state keeps below ``ROWS`` rows, and only sums stay between groups: nothing
is ever as large as all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Graph
from .doublets import draw
from .testing import positions

#: Sources in a mask, and in a row of path counts; rows of state that a group may have.
BITS, LANES, ROWS = 64, 16, 50_000_000
#: Masks of a row when all nodes are sources.
WORDS = 16


def _numbered(g: Graph, sources: DataFrame | None, width: int) -> DataFrame:
    """``source, batch, lane`` of the sources (all nodes, if not told)."""
    s = positions((g.nodes if sources is None else sources).select("id").distinct())
    return cut(s.select(F.col("id").alias("source"), F.floor(F.col("pos") / width).alias("batch"), F.pmod("pos", F.lit(width)).cast("int").alias("lane")))


def _groups(g: Graph, numbered: DataFrame, rows: int) -> list[DataFrame]:
    """The batches in groups of bounded state."""
    last = numbered.agg(F.max("batch")).first()[0]
    size = max(1, rows // max(1, g.n))
    return [] if last is None else [numbered.where((F.col("batch") >= b) & (F.col("batch") < b + size)) for b in range(0, last + 1, size)]


def _all_hop_counts(g: Graph, rows: int) -> DataFrame:
    """``source, hop, n`` of all nodes. Marks of targets travel against the edges, ``WORDS`` masks a row, so
    that a node's own row says how many targets are newly in reach: a count of bits, no sum a lane."""
    edges = cut(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst").distinct())
    words = range(WORDS)
    numbered, out = _numbered(g, None, BITS * WORDS), []
    for batch in _groups(g, numbered, max(1, rows // WORDS)):
        own = [F.expr(f"bit_or(CASE WHEN lane DIV {BITS} = {w} THEN shiftleft(1L, lane % {BITS}) ELSE 0L END)").alias(f"n{w}") for w in words]
        one = batch.groupBy("batch", F.col("source").alias("id")).agg(*own)
        state, hop = cut(one.select("*", *[F.col(f"n{w}").alias(f"s{w}") for w in words], F.lit(True).alias("fresh"))), 0
        while True:
            hop += 1
            front = state.where("fresh").select("batch", F.col("id").alias("src"), *[f"n{w}" for w in words])
            reach = front.join(edges, "src").groupBy("batch", F.col("dst").alias("id")).agg(*[F.expr(f"bit_or(n{w})").alias(f"r{w}") for w in words])
            both = state.select("batch", "id", *[f"s{w}" for w in words]).join(reach, ["batch", "id"], "full").fillna(0)
            both = both.select("batch", "id", *[F.expr(f"r{w} & ~s{w}").alias(f"n{w}") for w in words], *[F.expr(f"s{w} | r{w}").alias(f"s{w}") for w in words])
            state = cut(both.withColumn("fresh", F.expr(" OR ".join(f"n{w} <> 0" for w in words))))
            n = state.where("fresh").groupBy(F.col("id").alias("source")).agg(F.expr("sum(" + " + ".join(f"bit_count(n{w})" for w in words) + ")").alias("n"))
            level = cut(n.select("source", F.lit(hop).alias("hop"), "n"))
            if level.isEmpty():
                break
            out.append(level)
    every = g.nodes.sparkSession.createDataFrame([], f"source {g.nodes.schema['id'].dataType.simpleString()}, hop int, n long")
    for o in out:
        every = every.unionByName(o)
    return every.groupBy("source", "hop").agg(F.sum("n").alias("n")) if out else every


def hop_counts(g: Graph, sources: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """``source, hop, n``: how many nodes are so many hops away (1, 2, ...) from each source, along edges."""
    if sources is None:
        return _all_hop_counts(g, rows)
    edges = cut(g.edges.select("src", "dst").where("src <> dst").distinct())
    numbered, out = _numbered(g, sources, BITS), []
    bits = F.array(*(F.expr(f"sum(shiftright(new, {b}) & 1)") for b in range(BITS)))
    for batch in _groups(g, numbered, rows):
        one = batch.groupBy("batch", F.col("source").alias("id")).agg(F.expr("bit_or(shiftleft(1L, lane))").alias("new"))
        state, hop = cut(one.withColumn("seen", F.col("new"))), 0
        while True:
            hop += 1
            front = state.where("new <> 0").select("batch", F.col("id").alias("src"), "new")
            reach = front.join(edges, "src").groupBy("batch", F.col("dst").alias("id")).agg(F.expr("bit_or(new)").alias("r"))
            seen, r = F.coalesce("seen", F.lit(0).cast("long")), F.coalesce("r", F.lit(0).cast("long"))
            state = cut(state.drop("new").join(reach, ["batch", "id"], "full").select("batch", "id", r.bitwiseAND(F.bitwise_not(seen)).alias("new"), seen.bitwiseOR(r).alias("seen")))
            if state.where("new <> 0").isEmpty():
                break
            n = state.where("new <> 0").groupBy("batch").agg(bits.alias("n")).select("batch", F.posexplode("n").alias("lane", "n")).where("n > 0")
            out.append(cut(n.join(batch, ["batch", "lane"]).select("source", F.lit(hop).alias("hop"), "n")))
    every = g.nodes.sparkSession.createDataFrame([], f"source {g.nodes.schema['id'].dataType.simpleString()}, hop int, n long")
    for o in out:
        every = every.unionByName(o)
    return every


def dependencies(g: Graph, sources: DataFrame | None = None, rows: int = ROWS, width: int = LANES) -> DataFrame:
    """``id, c``: Brandes' dependency of the given sources (all nodes, if not told) on each node: the
    share of shortest paths from a source that pass it, summed. Path counts go forward by hop, shares back.
    A lane is a column, and those that have come are bits of one number: a hop writes its state once."""
    edges = cut(g.edges.select("src", "dst").where("src <> dst").distinct())
    total: DataFrame | None = None
    lanes = range(width)
    each = lambda form, name: [F.expr(form.format(i=i, bit=1 << i)).alias(f"{name}{i}") for i in lanes]
    s, d = [f"s{i}" for i in lanes], [f"d{i}" for i in lanes]
    for batch in _groups(g, _numbered(g, sources, width), rows // width):
        state = cut(batch.groupBy("batch", F.col("source").alias("id")).agg(F.expr("bit_or(shiftleft(1L, lane))").alias("seen"), *each("max(CASE WHEN lane = {i} THEN 1.0D ELSE 0.0D END)", "s")))
        levels = [state.drop("seen")]
        while True:
            reach = levels[-1].withColumnRenamed("id", "src").join(edges, "src").groupBy("batch", F.col("dst").alias("id")).agg(*each("sum(s{i})", "r"))
            both = state.select("batch", "id", "seen").join(reach, ["batch", "id"], "full").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
            both = both.select("batch", "id", "seen", *each("CASE WHEN seen & {bit}L = 0 THEN coalesce(r{i}, 0.0D) ELSE 0.0D END", "s"))
            new = F.expr(" | ".join(f"CASE WHEN s{i} > 0 THEN {1 << i}L ELSE 0L END" for i in lanes))
            state = cut(both.withColumn("new", new).select("batch", "id", (F.col("seen").bitwiseOR(F.col("new"))).alias("seen"), (F.col("new") != 0).alias("fresh"), *s))
            level = state.where("fresh").select("batch", "id", *s)
            if level.isEmpty():
                break
            levels.append(level)
        back = levels[-1].select("*", *(F.lit(0.0).alias(x) for x in d))
        for h in range(len(levels) - 1, 0, -1):
            part = back.groupBy("id").agg(F.sum(F.expr(" + ".join(d))).alias("c"))
            total = part if total is None else total.unionByName(part)
            share = back.select("batch", F.col("id").alias("dst"), *each("CASE WHEN s{i} > 0 THEN (1 + d{i}) / s{i} ELSE 0.0D END", "x"))
            into = share.join(edges, "dst").groupBy("batch", F.col("src").alias("id")).agg(*each("sum(x{i})", "x"))
            back = cut(levels[h - 1].join(into, ["batch", "id"], "left").select("batch", "id", *s, *each("coalesce(s{i} * x{i}, 0.0D)", "d")))
        if total is not None:
            total = cut(total.groupBy("id").agg(F.sum("c").alias("c")))
    return g.over_nodes(total).select("id", F.coalesce("c", F.lit(0.0)).alias("c")) if total is not None else g.nodes.select("id", F.lit(0.0).alias("c"))


def closeness(g: Graph, normalize: bool = True, sources: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """``id, centrality``: reached / sum of hops, times reached / (n - 1) if normalised."""
    s = hop_counts(g, sources, rows).groupBy(F.col("source").alias("id")).agg(F.sum(F.col("hop") * F.col("n")).alias("d"), F.sum("n").alias("r"))
    c = F.col("r") / F.col("d")
    c = c * F.col("r") / max(g.n - 1, 1) if normalize else c
    return (g.nodes if sources is None else sources.select("id")).join(s, "id", "left").select("id", F.coalesce(c, F.lit(0.0)).alias("centrality"))


def harmonic(g: Graph, normalize: bool = True, sources: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """``id, centrality``: sum of 1 / hops, over n - 1 if normalised."""
    s = hop_counts(g, sources, rows).groupBy(F.col("source").alias("id")).agg(F.sum(F.col("n") / F.col("hop")).alias("h"))
    h = F.coalesce("h", F.lit(0.0)) / (max(g.n - 1, 1) if normalize else 1)
    return (g.nodes if sources is None else sources.select("id")).join(s, "id", "left").select("id", h.alias("centrality"))


def betweenness(g: Graph, normalize: bool = True, sources: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """``id, centrality``; with ``sources``, of these alone, scaled up to all nodes."""
    n = g.n
    share = n / max(sources.distinct().count(), 1) if sources is not None else 1.0
    scale = share / 2 * (2 / ((n - 1) * (n - 2)) if normalize and n > 2 else 1)
    return dependencies(g, sources, rows).select("id", (F.col("c") * scale).alias("centrality"))


def sampled_nodes(g: Graph, n: int, seed: int = 0) -> DataFrame:
    """``id``: n nodes, those with the smallest draws."""
    return g.nodes.select("id").orderBy(draw("id", seed=seed), "id").limit(n)


def betweenness_sampled(g: Graph, n_samples: int, normalize: bool = True, seed: int = 0, rows: int = ROWS) -> DataFrame:
    return betweenness(g, normalize, cut(sampled_nodes(g, min(n_samples, g.n), seed)), rows)
