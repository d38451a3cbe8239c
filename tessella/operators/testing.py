"""Multiple-testing corrections over ``id, p``: windows over the p order, no driver loops.

The running extrema need one global order. p-values are ranked by a range
partition: blocks of the order are summarised, and every block takes the running
value of those before (after) it, so no task holds all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of an order at least, and rows that one should hold on average.
_BLOCKS, _PER_BLOCK = 64, 1_000_000


def ordered(p: DataFrame, by: str = "p", descending: bool = False) -> DataFrame:
    """Adds ``rank`` (1..n, ties by id) and ``n``: blocks by value, offsets from block counts."""
    lo_hi = p.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"), F.count(F.lit(1)).alias("n"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    parts = F.greatest(F.lit(_BLOCKS), F.ceil(F.col("n") / _PER_BLOCK))
    block = F.coalesce(F.least(parts - 1, F.floor((F.col(by) - F.col("_lo")) / width * parts)), F.lit(0))
    b = p.crossJoin(F.broadcast(lo_hi)).withColumn("_block", -block if descending else block)
    sizes = b.groupBy("_block").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sizes = sizes.select("_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_block").orderBy(F.desc(by) if descending else F.asc(by), "id")
    out = b.join(F.broadcast(sizes), "_block").withColumn("rank", F.col("_off") + F.row_number().over(inside))
    return out.drop("_lo", "_hi", "_off")


def positions(ids: DataFrame) -> DataFrame:
    """``id, pos``: places 0, 1, ... in the order of ``id``, ranked by ranges (of strings: of their first bytes)."""
    start = F.conv(F.rpad(F.hex(F.substring(F.col("id").cast("binary"), 1, 6)), 12, "0"), 16, 10)
    p = start if ids.schema["id"].dataType.simpleString() in ("string", "binary") else F.col("id")
    return ordered(ids.select("id", p.cast("double").alias("p"))).select("id", (F.col("rank") - 1).alias("pos"))


def sums_before(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before in the order of ``by``: sums of blocks, then inside each."""
    d = ordered(df.withColumn("id", F.col(by)), by)
    blocks = d.groupBy("_block").agg(F.sum(value).alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    out = d.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(blocks), "_block")
    return out.withColumn(name, F.col("_s") + F.col("_i")).drop("_s", "_i", "_block", "id", "rank", "n")


def running(df: DataFrame, value: Column, name: str, best: str = "min", backward: bool = True) -> DataFrame:
    """Running minimum (maximum) of ``value`` along rank, from the end or from the start."""
    f = F.min if best == "min" else F.max
    d = df.withColumn("_v", value)
    blocks = d.groupBy("_block").agg(f("_v").alias("_b"))
    side = (Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)) if backward else (Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_block", f("_b").over(side).alias("_o"))
    # a frame that ends at the last row is made anew for every row; the reversed order needs one pass
    inside = Window.partitionBy("_block").orderBy(F.desc("rank") if backward else F.asc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    here = f("_v").over(inside)
    pick = F.least if best == "min" else F.greatest
    return d.join(F.broadcast(blocks), "_block").withColumn(name, pick(here, F.coalesce("_o", here))).drop("_v", "_o")


def _capped(df: DataFrame, name: str) -> DataFrame:
    return df.select("id", "p", F.least(F.lit(1.0), F.col(name)).alias(name))


def benjamini_hochberg(p: DataFrame, factor: Column | None = None) -> DataFrame:
    d = ordered(p)
    v = F.col("p") * F.col("n") / F.col("rank") * (factor if factor is not None else F.lit(1.0))
    return _capped(running(d, v, "q"), "q")


def benjamini_yekutieli(p: DataFrame) -> DataFrame:
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    n = p.agg(F.count(F.lit(1)).alias("n")).select(harmonic.alias("h"))
    d = ordered(p).crossJoin(F.broadcast(n))
    return _capped(running(d, F.col("p") * F.col("n") / F.col("rank") * F.col("h"), "q"), "q")


def bonferroni(p: DataFrame) -> DataFrame:
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return p.crossJoin(F.broadcast(n)).select("id", "p", F.least(F.lit(1.0), F.col("p") * F.col("n")).alias("q"))


def holm(p: DataFrame) -> DataFrame:
    d = ordered(p)
    return _capped(running(d, F.col("p") * (F.col("n") - F.col("rank") + 1), "q", "max", backward=False), "q")


def hochberg(p: DataFrame) -> DataFrame:
    d = ordered(p)
    return _capped(running(d, F.col("p") * (F.col("n") - F.col("rank") + 1), "q"), "q")


def storey_pi0(p: DataFrame, lam: float = 0.5, grid_from: int = 100) -> DataFrame:
    """``pi0``: the smallest estimate over a grid of lambdas, or that of one lambda for few tests."""
    grid = [round(0.05 * i, 2) for i in range(1, 20)]
    n = F.count(F.lit(1))
    share = lambda x: F.sum((F.col("p") > x).cast("double")) / F.greatest(n * (1 - x), F.lit(1e-12))
    many = F.least(*(share(x) for x in grid))
    return p.agg(F.least(F.lit(1.0), F.when(n >= grid_from, many).otherwise(share(lam))).alias("pi0"))


def storey_qvalue(p: DataFrame, lam: float = 0.5) -> DataFrame:
    d = ordered(p).crossJoin(F.broadcast(storey_pi0(p, lam)))
    return _capped(running(d, F.col("pi0") * F.col("p") * F.col("n") / F.col("rank"), "q"), "q")


def local_fdr(p: DataFrame, grid: int = 200) -> DataFrame:
    """pi0 over the kernel density of the p-values, from a grid of ``grid`` points; capped at 1."""
    n = p.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("p").alias("sd")).select("n", F.greatest(1.06 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(1e-3)).alias("h"))
    cell = F.least(F.lit(grid - 1), F.floor(F.col("p") * grid).cast("int"))
    counts = p.groupBy(cell.alias("g")).agg(F.count(F.lit(1)).alias("c"), F.avg("p").alias("m"))
    points = p.sparkSession.range(grid).select(F.col("id").cast("int").alias("x"))
    z = ((F.col("x") + 0.5) / grid - F.col("m")) / F.col("h")
    dens = points.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(n)).groupBy("x").agg((F.sum(F.col("c") * F.exp(-z * z / 2)) / (F.max("n") * F.max("h") * math.sqrt(2 * math.pi))).alias("f"))
    d = p.withColumn("x", cell).join(F.broadcast(dens), "x").crossJoin(F.broadcast(storey_pi0(p)))
    return d.select("id", "p", F.least(F.lit(1.0), F.col("pi0") / F.greatest("f", F.lit(1e-12))).alias("q"))


def empirical_fdr(observed: DataFrame, permuted: DataFrame) -> DataFrame:
    """From ``id, score`` and ``perm, score``: expected null scores at least as high over the rank,
    running minimum from the lowest score. Counts come from one merged order."""
    perms = permuted.agg(F.countDistinct("perm").cast("double").alias("b"))
    o = ordered(observed.withColumn("p", F.col("score")), "p", descending=True)
    both = observed.select("id", "score", F.lit(0).alias("fake")).unionByName(permuted.select(F.lit(None).cast("long").alias("id"), "score", F.lit(1).alias("fake")))
    m = ordered(both.withColumn("p", F.col("score")).withColumn("id", F.coalesce("id", F.lit(-1))), "p", descending=True)
    blocks = m.groupBy("_block").agg(F.sum("fake").alias("_c"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    at_least = Window.partitionBy("_block").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    nulls = m.withColumn("_n", F.sum("fake").over(at_least)).join(F.broadcast(blocks), "_block").where("fake = 0").select("id", (F.col("_n") + F.col("_o")).alias("above"))
    d = o.join(nulls, "id").crossJoin(F.broadcast(perms))
    out = running(d, F.col("above") / F.col("b") / F.col("rank"), "q")
    return out.select("id", "score", F.least(F.lit(1.0), F.col("q")).alias("q"))


def significant(p: DataFrame, threshold: float = 0.05, strict: bool = False) -> DataFrame:
    return p.where(F.col("p") < threshold if strict else F.col("p") <= threshold).select("id")


def count_significant(p: DataFrame, threshold: float = 0.05, strict: bool = False) -> DataFrame:
    return significant(p, threshold, strict).agg(F.count(F.lit(1)).alias("n"))


def neglog10(p: DataFrame) -> DataFrame:
    return p.select("id", (-F.log10(F.greatest("p", F.lit(1e-300)))).alias("neglog10"))


def fisher_combine(p: DataFrame) -> DataFrame:
    """The statistic -2 sum ln p."""
    return p.agg((-2 * F.sum(F.log(F.greatest("p", F.lit(1e-300))))).alias("statistic"))


# Abramowitz and Stegun 26.2.23 for the inverse of the normal distribution.
QUANTILE_C = (2.515517, 0.802853, 0.010328)
QUANTILE_D = (1.432788, 0.189269, 0.001308)


def normal_quantile(p: Column) -> Column:
    """z with upper tail p, by a rational approximation."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(F.greatest(q, F.lit(1e-300))))
    num = QUANTILE_C[0] + t * (QUANTILE_C[1] + t * QUANTILE_C[2])
    den = 1 + t * (QUANTILE_D[0] + t * (QUANTILE_D[1] + t * QUANTILE_D[2]))
    z = t - num / den
    return F.when(p <= 0.5, z).otherwise(-z)


def stouffer_combine(p: DataFrame) -> DataFrame:
    """The statistic sum w z / sqrt(sum w^2) from ``id, p, weight``."""
    z = normal_quantile(F.col("p"))
    return p.agg((F.sum(F.col("weight") * z) / F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("statistic"))


def sort_by_pvalue(p: DataFrame) -> DataFrame:
    return p.orderBy("p", "id")
