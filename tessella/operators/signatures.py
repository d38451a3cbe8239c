"""Column-set scores, enrichment, markers, annotation, communication, networks of columns.

Sets are ``set_id, col`` (and a weight). All scores of many sets come from one
join of the entries with the sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import hypergeom_sf, two_sided
from ..loops import cut
from ..model import Matrix, zero
from .matrix import col_moments, group_stats, pearson, pearson_with, row_moments
from .neighbors import weighted_vote
from .stats import cohens_d, two_group_stats

# --- scores of column sets per row -------------------------------------------


#: Entries, links or ids of a block, scores of a batch, and products made at once.
_BLOCK, _BATCH, _PRODUCTS = 1 << 19, 1 << 18, 1 << 21


def _cell_sums(counted: bool):
    """Scores of all pairs of a block of rows and a block of sets, in batches of whole rows."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                flat = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                get = lambda c: np.zeros(0) if flat(c) is None else flat(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                place = lambda ids, x: (at := np.minimum(np.searchsorted(ids, x), len(ids) - 1), ids[at] == x)
                rows, sets, per = np.sort(get("rows")), get("sets"), get("per")
                order = np.argsort(sets)
                sets, per = sets[order], per[order]
                r, there = place(rows, get("e_row"))
                e_col, v = get("e_col")[there], get("e_v")[there]
                order = np.argsort(r[there], kind="stable")
                r, e_col, v = r[there][order], e_col[order], v[order]
                s, _ = place(sets, get("l_set"))
                order = np.argsort(get("l_col"), kind="stable")
                s, l_col, w = s[order], get("l_col")[order], get("l_w")[order]
                start = np.searchsorted(l_col, e_col)
                n = np.searchsorted(l_col, e_col, side="right") - start
                ends = np.cumsum(n)
                step = max(1, _BATCH // len(sets))
                for lo in range(0, len(rows), step):
                    hi = min(lo + step, len(rows))
                    total, k = np.zeros((hi - lo) * len(sets)), np.zeros((hi - lo) * len(sets) if counted else 0, np.int64)
                    x, last = np.searchsorted(r, lo), np.searchsorted(r, hi)
                    while x < last:
                        y = min(last, max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + _PRODUCTS, side="right"))))
                        m = n[x:y]
                        e = np.repeat(np.arange(x, y), m)
                        at = np.arange(len(e)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[x:y], m)
                        cell = (r[e] - lo) * len(sets) + s[at]
                        total += np.bincount(cell, w[at] * v[e], minlength=len(total))
                        if counted:
                            k += np.bincount(cell, minlength=len(total))
                        x = y
                    out = {"set_id": np.tile(sets, hi - lo), "row": np.repeat(rows[lo:hi], len(sets)), "s": total / np.tile(per, hi - lo)}
                    yield pa.RecordBatch.from_pydict(out | ({"k": k} if counted else {}))

    return run


def _all_sums(a: Matrix, sets: DataFrame, per: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """``set_id, row, s``: sum of weight * value (0 without any) of every row of the domain and every set,
    by ``per`` (``set_id, t``), with ``k``, how many it sums, if ``counted``. Blocks of rows meet blocks of
    sets; a score is made where it is put out and never exchanged."""
    w = F.col("weight").cast("double") if "weight" in sets.columns else F.lit(1.0)
    links, entries = cut(sets.select("set_id", "col", w.alias("w"))), cut(a.entries.select("row", "col", F.col("v").cast("double").alias("v")))
    ids = cut(links.select("set_id").distinct() if per is None else links.select("set_id").distinct().join(per, "set_id"))
    ids = ids.select("set_id", (F.lit(1.0) if per is None else F.col("t").cast("double")).alias("t"))
    parts = lambda x, y: max(1, -(-max(x, y) // _BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)).cast("int").alias("b")
    n, m = parts(entries.count(), a.n_rows), parts(links.count(), ids.count())
    pack = lambda d, key, k, **cols: d.groupBy(block(key, k)).agg(F.collect_list(F.struct(*(F.col(c).alias(x) for x, c in cols.items()))).alias("p"))
    field = lambda d, *names: d.select("b", *(F.col(f"p.{x}").alias(x) for x in names))
    left = field(pack(a.rows, "row", n, rows="row"), "rows").join(field(pack(entries, "row", n, e_row="row", e_col="col", e_v="v"), "e_row", "e_col", "e_v"), "b", "left").drop("b")
    right = field(pack(ids, "set_id", m, sets="set_id", per="t"), "sets", "per").join(field(pack(links, "set_id", m, l_set="set_id", l_col="col", l_w="w"), "l_set", "l_col", "l_w"), "b").drop("b")
    kinds = f"set_id {ids.schema['set_id'].dataType.simpleString()}, row {a.rows.schema['row'].dataType.simpleString()}, s double{', k long' if counted else ''}"
    return cut(left).repartition(n).crossJoin(cut(right)).mapInArrow(_cell_sums(counted), kinds)


def _every_row(a: Matrix, sets: DataFrame, d: DataFrame) -> DataFrame:
    ids = sets.select("set_id").distinct()
    return a.rows.crossJoin(F.broadcast(ids)).join(d, ["set_id", "row"], "left")  # the output has a row for each


def mean_score(a: Matrix, sets: DataFrame) -> DataFrame:
    """``set_id, row, score``: sum over the set by its size."""
    n = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    return _all_sums(a, sets, n.withColumnRenamed("n", "t")).select("set_id", "row", F.col("s").alias("score"))


def expressed_mean_score(a: Matrix, sets: DataFrame) -> DataFrame:
    """Mean over the set's stored columns of the row."""
    return _all_sums(a, sets, counted=True).select("set_id", "row", F.coalesce(F.col("s") / F.nullif(F.col("k"), F.lit(0)), F.lit(0.0)).alias("score"))


def weighted_score(a: Matrix, sets: DataFrame) -> DataFrame:
    """Sum of weight * value by the sum of positive weights; other weights are ignored."""
    pos = sets.where("weight > 0")
    t = pos.groupBy("set_id").agg(F.sum("weight").alias("t"))
    return _all_sums(a, pos, t).select("set_id", "row", F.col("s").alias("score"))


def zscore_across(scores: DataFrame) -> DataFrame:
    """Scores standardised over the rows of each set (population deviation, 0 if none)."""
    m = scores.groupBy("set_id").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))
    z = F.coalesce((F.col("score") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0))
    return scores.join(F.broadcast(m), "set_id").select("set_id", "row", z.alias("score"))


def state_score(a: Matrix, sets: DataFrame) -> DataFrame:
    """Set mean of expressed columns, standardised over rows (stemness, proliferation, stress, apoptosis ...)."""
    return zscore_across(expressed_mean_score(a, sets))


def signature_score(a: Matrix, sets: DataFrame) -> DataFrame:
    """Sum of weight * value by the sum of |weight|, standardised over rows."""
    t = sets.groupBy("set_id").agg(F.sum(F.abs("weight")).alias("t"))
    s = _all_sums(a, sets, t).select("set_id", "row", F.col("s").alias("score"))
    return zscore_across(s)


def combined_state_score(a: Matrix, sets: DataFrame, weights: DataFrame) -> DataFrame:
    """``row, score``: weighted mean of standardised set scores (``set_id, w``)."""
    z = state_score(a, sets).join(F.broadcast(weights), "set_id")
    return z.groupBy("row").agg((F.sum(F.col("w") * F.col("score")) / F.sum(F.abs("w"))).alias("score"))


def score_difference(a: Matrix, positive: DataFrame, negative: DataFrame, standardized: bool = False) -> DataFrame:
    """``row, score``: score of one set less that of another (each a ``col`` table)."""
    f = state_score if standardized else mean_score
    both = positive.select(F.lit(0).alias("set_id"), "col").unionByName(negative.select(F.lit(1).alias("set_id"), "col"))
    return f(a, both).groupBy("row").agg(F.sum(F.when(F.col("set_id") == 0, F.col("score")).otherwise(-F.col("score"))).alias("score"))


def column_means(a: Matrix) -> DataFrame:
    """``col, mean`` over all rows."""
    return col_moments(a).select("col", "mean")


def gene_set_score(a: Matrix, columns: DataFrame, method: str = "mean") -> DataFrame:
    """``row, score`` of one set (``col``): mean over the set, sum, or mean of expressed columns."""
    one = columns.select(F.lit(0).alias("set_id"), "col")
    if method == "sum":
        s = a.entries.join(columns, "col", "left_semi").groupBy("row").agg(F.sum("v").alias("score"))
        return a.over_rows(s).select("row", zero("score"))
    return {"mean": mean_score, "expressed": expressed_mean_score}[method](a, one).select("row", "score")


def zscore_score(a: Matrix, sets: DataFrame) -> DataFrame:
    """``set_id, row, score``: mean over the set of column z scores, implicit zeros included.

    The zeros' part is one constant a set; only stored entries are joined."""
    m = col_moments(a, ddof=0).where("var > 0").select("col", "mean", F.sqrt("var").alias("sd"))
    n = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    base = sets.join(m, "col").groupBy("set_id").agg(F.sum(-F.col("mean") / F.col("sd")).alias("b"))
    s = a.entries.join(sets, "col").join(m, "col").groupBy("set_id", "row").agg(F.sum(F.col("v") / F.col("sd")).alias("s"))
    d = _every_row(a, sets, s).join(F.broadcast(n), "set_id").join(F.broadcast(base), "set_id", "left")
    return d.select("set_id", "row", ((F.coalesce("s", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / F.col("n")).alias("score"))


def _row_ranks(a: Matrix) -> DataFrame:
    """Rank of stored positive entries in their row, largest first, ties by column."""
    w = Window.partitionBy("row").orderBy(F.desc("v"), "col")
    return a.entries.where("v > 0").withColumn("rank", F.row_number().over(w))


def auc_score(a: Matrix, sets: DataFrame, quantile: float = 0.05) -> DataFrame:
    """``set_id, row, score``: share of the set among a row's ceil(q * columns) highest columns."""
    top = -(-int(round(quantile * a.n_cols * 1e9)) // int(1e9))
    n = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    hit = _row_ranks(a).where(F.col("rank") <= top).join(sets, "col").groupBy("set_id", "row").agg(F.count(F.lit(1)).alias("h"))
    return _every_row(a, sets, hit).join(F.broadcast(n), "set_id").select("set_id", "row", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("score"))


def regulon_auc(a: Matrix, sets: DataFrame, percent: float = 5.0) -> DataFrame:
    """As ``auc_score`` with floor(columns * percent / 100) places."""
    top = int(a.n_cols * percent / 100)
    n = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    hit = _row_ranks(a).where(F.col("rank") <= top).join(sets, "col").groupBy("set_id", "row").agg(F.count(F.lit(1)).alias("h"))
    return _every_row(a, sets, hit).join(F.broadcast(n), "set_id").select("set_id", "row", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("score"))


def quantile_score(a: Matrix, sets: DataFrame, q: float) -> DataFrame:
    """``set_id, row, score``: the set's sorted values (zeros included) at index floor(q (n - 1))."""
    n = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    vals = a.entries.join(sets, "col").groupBy("set_id", "row").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # at most the set's size
    d = _every_row(a, sets, vals).join(F.broadcast(n), "set_id").withColumn("vs", F.coalesce("vs", F.array().cast("array<double>")))
    neg = F.size(F.filter("vs", lambda v: v < 0))
    zeros = F.col("n") - F.size("vs")
    at = F.floor(q * (F.col("n") - 1)).cast("int")
    score = F.when(at < neg, F.get("vs", at)).when(at < neg + zeros, F.lit(0.0)).otherwise(F.get("vs", (at - zeros).cast("int")))
    return d.select("set_id", "row", score.alias("score"))


def equal_width_bins(a: Matrix, n_bins: int = 25) -> DataFrame:
    """``col, bin`` of the column means."""
    from .information import equal_width

    return equal_width(col_moments(a).select("col", F.col("mean").alias("x")), n_bins).select("col", "bin")


def control_columns(a: Matrix, sets: DataFrame, per_column: int = 1, n_bins: int = 25, seed: int = 0) -> DataFrame:
    """``set_id, col``: for every column of a set, columns of its bin outside the set: neighbours in the bin's
    order by a seeded hash, from a place drawn for the column.

    The columns outside a set are never listed: the k-th of them follows from how many members lie before
    it, and members and draws of a set and bin are counted in one order."""
    from .testing import ordered

    b = cut(equal_width_bins(a, n_bins))
    mix = (F.pmod(F.xxhash64("col", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    place = ordered(b.select(F.col("col").alias("id"), "bin", (F.col("bin") + mix).alias("x")), "x").select(F.col("id").alias("col"), "bin", "rank")
    size = place.groupBy("bin").agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("first"))  # one row a bin
    place = cut(place.join(F.broadcast(size), "bin").select("col", "bin", (F.col("rank") - F.col("first")).alias("place"), "size"))
    own = Window.partitionBy("set_id", "bin")
    mine = sets.select("set_id", "col").distinct().join(place, "col")
    mine = cut(mine.withColumn("gap", F.col("place") - F.row_number().over(own.orderBy("place")) + 1).withColumn("left", F.col("size") - F.count(F.lit(1)).over(own)))
    start = F.pmod(F.xxhash64("col", F.lit(seed + 1)), F.col("left"))
    take = F.explode(F.sequence(F.lit(1), F.least(F.lit(per_column).cast("long"), F.col("left"))))
    draws = mine.where("left > 0").where(F.lit(per_column > 0)).select("set_id", "bin", start.alias("start"), take.alias("j"), "left").select("set_id", "bin", F.pmod(F.col("start") + F.col("j") - 1, F.col("left")).alias("at"), F.lit(1).alias("drawn"))
    both = mine.select("set_id", "bin", F.col("gap").alias("at"), F.lit(0).alias("drawn")).unionByName(draws)
    before = F.sum(1 - F.col("drawn")).over(own.orderBy("at", "drawn").rowsBetween(Window.unboundedPreceding, 0))
    picked = both.withColumn("place", F.col("at") + before).where("drawn = 1").select("set_id", "bin", "place")
    return picked.join(place.select("bin", "place", "col"), ["bin", "place"]).select("set_id", "col")


def module_score(a: Matrix, sets: DataFrame, per_column: int = 1, n_bins: int = 25, seed: int = 0) -> DataFrame:
    """``set_id, row, score``: set mean less the mean of control columns, as one sum with signed weights."""
    share = lambda d, sign: d.select("set_id", "col").join(d.groupBy("set_id").agg((sign / F.count(F.lit(1))).alias("weight")), "set_id")
    links = share(sets, 1.0).unionByName(share(cut(control_columns(a, sets, per_column, n_bins, seed)), -1.0))
    return _all_sums(a, links.select("set_id", "col", "weight")).select("set_id", "row", F.col("s").alias("score"))


def cell_cycle(a: Matrix, s_cols: DataFrame, g2m_cols: DataFrame, **kw) -> DataFrame:
    """``row, s, g2m, phase``: 0 G1 (both not above 0), 1 S, 2 G2M."""
    sets = s_cols.select(F.lit(1).alias("set_id"), "col").unionByName(g2m_cols.select(F.lit(2).alias("set_id"), "col"))
    m = module_score(a, sets, **kw).groupBy("row").agg(*(F.max(F.when(F.col("set_id") == k, F.col("score"))).alias(n) for k, n in ((1, "s"), (2, "g2m"))))
    return m.select("row", "s", "g2m", F.when((F.col("s") <= 0) & (F.col("g2m") <= 0), 0).when(F.col("s") >= F.col("g2m"), 1).otherwise(2).alias("phase"))


def differentiation_potential(a: Matrix) -> DataFrame:
    """``row, score`` in 0..1: mean of the columns that follow the number of stored entries most,
    weighted by |r| (the top max(10, min(200, columns / 10)))."""
    n = a.over_rows(a.entries.groupBy("row").agg(F.count(F.lit(1)).cast("double").alias("y"))).select("row", F.coalesce("y", F.lit(0.0)).alias("y"))
    top = max(10, min(200, a.n_cols // 10))
    r = pearson_with(a, n).orderBy(F.desc(F.abs("r")), "col").limit(top).select(F.lit(0).alias("set_id"), "col", F.abs("r").alias("weight"))
    s = weighted_score(a, r).select("row", "score")
    b = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.crossJoin(F.broadcast(b)).select("row", F.coalesce((F.col("score") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def state_entropy(a: Matrix) -> DataFrame:
    from .information import row_entropy

    return row_entropy(a).select("row", (F.col("h") / F.log(F.lit(float(max(a.n_cols, 2))))).alias("h"))


def transcriptional_diversity(a: Matrix) -> DataFrame:
    """``row, score`` = 1 - sum p^2 over positive values."""
    g = a.entries.where("v > 0").groupBy("row").agg((1 - F.sum(F.col("v") * F.col("v")) / F.pow(F.sum("v"), F.lit(2.0))).alias("score"))
    return a.over_rows(g).select("row", zero("score"))


def expression_complexity(a: Matrix, threshold: float = 0.0) -> DataFrame:
    g = a.entries.where(F.col("v") > threshold).groupBy("row").agg(F.count(F.lit(1)).alias("k"))
    return a.over_rows(g).select("row", (F.coalesce("k", F.lit(0)) / F.lit(float(a.n_cols))).alias("score"))


# --- enrichment --------------------------------------------------------------


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad / bc; 1e285 where bc is 0."""
    return F.coalesce(a * d / F.nullif((b * c).cast("double"), F.lit(0.0)), F.lit(1e285))


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of a two-by-two table."""
    return hypergeom_sf(a, a + b, a + c, a + b + c + d)


def ora(sets: DataFrame, chosen: DataFrame, n_total: int) -> DataFrame:
    """``set_id, overlap, p, odds, fold`` of every set against the chosen ids (``col``)."""
    n = chosen.distinct().agg(F.count(F.lit(1)).alias("n"))
    s = sets.distinct().join(chosen.distinct().withColumn("_in", F.lit(1)), "col", "left").groupBy("set_id").agg(F.count("_in").alias("k"), F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(n))
    k, n_, m, t = F.col("k"), F.col("n"), F.col("m"), F.lit(n_total)
    fold = F.coalesce(k * t / F.nullif((n_ * m).cast("double"), F.lit(0.0)), F.lit(0.0))
    return s.select("set_id", k.alias("overlap"), hypergeom_sf(k, n_, m, t).alias("p"), odds_ratio(k, n_ - k, m - k, t - n_ - m + k).alias("odds"), fold.alias("fold"))


def running_sum(ranked: DataFrame, sets: DataFrame, weighted: bool = False) -> DataFrame:
    """``set_id, rank, col, s``: running enrichment along ``rank, col, score``; steps 1 / |S| (or
    |score| over the set's sum) for members and -1 / (N - |S|) for others. One window a set."""
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    ids = sets.select("set_id").distinct()
    d = ranked.crossJoin(F.broadcast(ids)).join(sets.withColumn("_in", F.lit(1)), ["set_id", "col"], "left").crossJoin(F.broadcast(n))
    w = F.abs("score") if weighted else F.lit(1.0)
    every = Window.partitionBy("set_id")
    hit = F.when(F.col("_in") == 1, w).otherwise(0.0)
    d = d.withColumn("_h", hit).withColumn("_t", F.sum("_h").over(every)).withColumn("_m", F.count("_in").over(every))
    step = F.when(F.col("_in") == 1, F.coalesce(F.col("_h") / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0))).otherwise(-1 / F.nullif(F.col("n") - F.col("_m"), F.lit(0)))
    s = F.sum(step).over(every.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("set_id", "rank", "col", "_in", s.alias("s"))


def _peaks(members: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """``keys, es, peak`` of ``keys, rank, h, t``: members' ranks and weights, t their sum, among n ranks.

    Between members the running sum falls evenly, so its extremes lie at members, right before them
    and at the end: no row for any other rank. The largest magnitude counts (equal to nine digits:
    the first)."""
    w = Window.partitionBy(*keys).orderBy("rank")
    d = members.withColumn("_i", F.row_number().over(w)).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    d = d.withColumn("_c", F.coalesce(F.sum("h").over(w) / F.nullif(F.col("t"), F.lit(0.0)), F.lit(0.0))).withColumn("_b", F.coalesce((F.sum("h").over(w) - F.col("h")) / F.nullif(F.col("t"), F.lit(0.0)), F.lit(0.0)))
    fall = lambda ranks: F.coalesce(ranks / F.nullif(n - F.col("_k"), F.lit(0)), F.lit(0.0))
    here, before = F.col("_c") - fall(F.col("rank") - F.col("_i")), F.col("_b") - fall(F.col("rank") - F.col("_i"))
    last = F.when(F.col("_i") == F.col("_k"), F.col("_c") - fall(n - F.col("_k")))
    ends = F.array(F.struct(here.alias("s"), F.col("rank").cast("long").alias("rank")), F.struct(F.when(F.col("rank") > 1, before).alias("s"), (F.col("rank") - 1).cast("long").alias("rank")), F.struct(last.alias("s"), n.cast("long").alias("rank")))
    e = d.select(*keys, F.explode(ends).alias("e")).where("e.s is not null").select(*keys, "e.s", "e.rank")
    best = F.max_by(F.struct("s", "rank"), F.struct(F.round(F.abs("s"), 9), -F.col("rank")))
    return e.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.s").alias("es"), F.col("b.rank").alias("peak"))


def _of_sets(ranked: DataFrame, sets: DataFrame, weighted: bool, on: str) -> DataFrame:
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    d = sets.join(ranked, on).withColumn("h", F.abs("score").cast("double") if weighted else F.lit(1.0))
    d = d.withColumn("t", F.sum("h").over(Window.partitionBy("set_id"))).crossJoin(n)  # one row
    return _peaks(d.select("set_id", "rank", "h", "t", "n"), ["set_id"], F.col("n"))


def enrichment_score(ranked: DataFrame, sets: DataFrame, weighted: bool = True) -> DataFrame:
    """``set_id, es, peak``: the running sum's value of largest magnitude and its rank."""
    return _of_sets(ranked, sets, weighted, "col")


def gsea(ranked: DataFrame, sets: DataFrame, n_perm: int = 100, seed: int = 0) -> DataFrame:
    """``set_id, es, nes, p``: against n_perm drawings of as many ranks, by keyed permutations, so that only
    members are rows."""
    from .permute import drawn_places

    es = enrichment_score(ranked, sets)
    sizes = sets.join(ranked.select("col"), "col", "left_semi").groupBy("set_id").agg(F.count(F.lit(1)).alias("m"))
    fake = drawn_places(sizes, ranked.count(), n_perm, seed).select((F.col("set_id") * n_perm + F.col("perm")).alias("set_id"), (F.col("place") + 1).alias("rank"))
    null = _of_sets(ranked, fake, True, "rank").select(F.floor(F.col("set_id") / n_perm).alias("set_id"), F.col("es").alias("ne"))
    j = es.join(null, "set_id")
    same = F.signum("ne") == F.signum("es")
    g = j.groupBy("set_id", "es").agg(F.sum((F.abs("ne") >= F.abs("es")).cast("int")).alias("x"), F.avg(F.when(same, F.abs("ne"))).alias("m"))
    return g.select("set_id", "es", F.coalesce(F.col("es") / F.col("m"), F.lit(0.0)).alias("nes"), ((F.col("x") + 1) / (n_perm + 1)).alias("p"))


def leading_edge(ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_id, col``: members up to the peak (from it on, for a negative score)."""
    r = sets.join(ranked, "col").join(enrichment_score(ranked, sets), "set_id")
    return r.where("(es >= 0 and rank <= peak) or (es < 0 and rank >= peak)").select("set_id", "col")


#: Ranks of rows times members that a task makes.
_RANKED = 1 << 29


def _row_peaks(n: int, exponent: float):
    """Enrichment of all pairs of a block of rows and a block of sets. Columns without a value keep their
    order, so that a row's ranks follow from its stored entries: memory for one row's members at a time."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        weight = np.concatenate([[0.0], np.power(np.arange(n, 0, -1, dtype=np.float64), exponent)])  # by rank
        for batch in batches:
            for i in range(batch.num_rows):
                flat = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                get = lambda c: np.zeros(0) if flat(c) is None else flat(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                order = np.lexsort((get("l_pos"), get("l_set")))
                sets, pos = get("l_set")[order], get("l_pos")[order].astype(np.int64)
                names, first = np.unique(sets, return_index=True)
                size = np.diff(np.append(first, len(sets)))
                group, last = np.repeat(np.arange(len(names)), size), first + size - 1
                place, rest = np.arange(len(sets)) - first[group] + 1, (n - size).astype(np.float64)
                fall = np.divide(1.0, rest, out=np.zeros(len(names)), where=rest > 0)
                falls, passed, stored = fall[group], place * fall[group], np.zeros(n, bool)
                rows = np.sort(get("rows"))
                e_row, e_pos, e_v = get("e_row"), get("e_pos").astype(np.int64), get("e_v").astype(np.float64)
                top = np.where(np.isnan(e_v), np.inf, e_v)
                order = np.lexsort((e_pos, -top, ~np.isnan(e_v), e_row))
                e_row, e_pos, top = e_row[order], e_pos[order], top[order]
                start, end = np.searchsorted(e_row, rows), np.searchsorted(e_row, rows, side="right")
                step = max(1, _BATCH // len(names))
                for lo in range(0, len(rows), step):
                    es = np.empty((min(step, len(rows) - lo), len(names)))
                    for at in range(lo, min(lo + step, len(rows))):
                        cols, high = e_pos[start[at] : end[at]], int((top[start[at] : end[at]] > 0).sum())
                        rank = np.ones(n, np.int64)
                        rank[cols] = 0
                        np.cumsum(rank, out=rank)
                        rank += high
                        rank[cols] = np.arange(1, len(cols) + 1)
                        rank[cols[high:]] += n - len(cols)
                        r = rank[pos]
                        stored[cols] = True
                        moved = np.flatnonzero(stored[pos])
                        stored[cols] = False
                        if len(moved):  # those above 0 come first in their set, those below last; the others are in order
                            moved = moved[np.lexsort((r[moved], group[moved]))]
                            g, before_g = group[moved], np.searchsorted(group[moved], np.arange(len(names) + 1))
                            r = np.insert(np.delete(r, moved), np.append(first, len(sets))[g + (r[moved] > high)] - before_g[g + (r[moved] > high)], r[moved])
                        h = weight[r]
                        c = np.cumsum(h)
                        base = c[first] - h[first]
                        total = c[last] - base
                        scale = np.divide(1.0, total, out=np.zeros(len(names)), where=total != 0)
                        each = np.repeat(scale, size)
                        c -= np.repeat(base, size)
                        c *= each
                        end_s = c[last] - (n - size) * fall
                        c -= r * falls
                        c += passed
                        here, before = c, c - h * each
                        before[r == 1] = 0.0  # there is no rank before the first
                        up = np.maximum(np.abs(here), np.abs(before))
                        best = np.maximum(np.maximum.reduceat(up, first), np.abs(end_s))
                        some = np.flatnonzero(up >= np.repeat(best - 2e-9, size))  # the first of those equal to nine digits
                        s = np.concatenate([before[some], here[some], end_s])
                        k = np.concatenate([group[some], group[some], np.arange(len(names))])
                        where = np.concatenate([np.where(r[some] == 1, n + 1, r[some] - 1), r[some], np.full(len(names), n)])
                        pick = np.lexsort((where, -np.round(np.abs(s), 9), k))
                        es[at - lo] = s[pick[np.searchsorted(k[pick], np.arange(len(names)))]]
                    yield pa.RecordBatch.from_pydict({"row": np.repeat(rows[lo : lo + step], len(names)), "set_id": np.tile(names, len(es)), "es": es.ravel()})

    return run


def ssgsea(a: Matrix, sets: DataFrame, exponent: float = 0.25) -> DataFrame:
    """``row, set_id, es``: per row, columns ranked by value (zeros in their place, ties by id); weights
    are (n - rank + 1) ** exponent. Every row of the domain is ranked over all columns, in blocks of rows
    that meet blocks of sets: a rank of a column without a value is never a row."""
    from .testing import positions

    pos = cut(positions(a.cols.select(F.col("col").alias("id")).distinct()).select(F.col("id").alias("col"), "pos"))
    entries = cut(a.entries.where("v <> 0").join(pos, "col").select("row", "pos", F.col("v").cast("double").alias("v")))
    links = cut(sets.select("set_id", "col").join(pos, "col").select("set_id", "pos"))
    n, n_links = pos.count(), links.count()
    m = max(1, -(-n_links // _BLOCK))
    k = max(1, -(-max(entries.count(), a.n_rows) // (_BLOCK // 4)), -(-a.n_rows * max(n, n_links) // _RANKED))
    pack = lambda d, key, parts, **cols: d.groupBy(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(parts)).cast("int").alias("b")).agg(F.collect_list(F.struct(*(F.col(c).alias(x) for x, c in cols.items()))).alias("p")).select("b", *(F.col(f"p.{x}").alias(x) for x in cols))
    left = pack(a.rows, "row", k, rows="row").join(pack(entries, "row", k, e_row="row", e_pos="pos", e_v="v"), "b", "left").drop("b")
    right = pack(links, "set_id", m, l_set="set_id", l_pos="pos").drop("b")
    kinds = f"row {a.rows.schema['row'].dataType.simpleString()}, set_id {sets.schema['set_id'].dataType.simpleString()}, es double"
    return cut(left).repartition(k).crossJoin(cut(right)).mapInArrow(_row_peaks(n, exponent), kinds)


def gsva(a: Matrix, sets: DataFrame) -> DataFrame:
    """As ``ssgsea`` with equal weights."""
    return ssgsea(a, sets, 0.0)


def set_overlap(sets: DataFrame) -> DataFrame:
    """``a, b, overlap, jaccard`` for set pairs (a < b) that share a column."""
    s = sets.select("set_id", "col").distinct()
    n = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    both = s.join(s.select(F.col("set_id").alias("b"), "col"), "col").where("set_id < b").groupBy(F.col("set_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("overlap"))
    j = both.join(n.select(F.col("set_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("jaccard"))


def unique_members(sets: DataFrame, target: int) -> DataFrame:
    others = sets.where(F.col("set_id") != target).select("col")
    return sets.where(F.col("set_id") == target).select("col").join(others, "col", "left_anti")


# --- markers -----------------------------------------------------------------


def group_means(a: Matrix, groups: DataFrame) -> DataFrame:
    return group_stats(a, groups).select("col", "grp", "mean")


def percent_expressed(a: Matrix, groups: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``col, grp, pct``: share of a group's rows above the threshold (of at least 0)."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    c = a.entries.where(F.col("v") > threshold).join(groups, "row").groupBy("col", "grp").agg(F.count(F.lit(1)).alias("c"))
    return a.cols.crossJoin(F.broadcast(n)).join(c, ["col", "grp"], "left").select("col", "grp", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("pct"))


def log_fold_change(a: Matrix, groups: DataFrame, target: int, pseudo: float = 1.0) -> DataFrame:
    """``col, lfc``: log2 of the target's mean over the unweighted mean of the other groups' means."""
    m = group_means(a, groups).groupBy("col").agg(F.max(F.when(F.col("grp") == target, F.col("mean"))).alias("t"), F.avg(F.when(F.col("grp") != target, F.col("mean"))).alias("o"))
    return m.select("col", (F.log2(F.coalesce("t", F.lit(0.0)) + pseudo) - F.log2(F.coalesce("o", F.lit(0.0)) + pseudo)).alias("lfc"))


def _one_vs_rest(a: Matrix, groups: DataFrame, target: int) -> DataFrame:
    two = groups.select("row", (F.col("grp") == target).cast("int").alias("grp"))
    return two


def one_vs_rest(a: Matrix, groups: DataFrame, target: int, pseudo: float = 1.0) -> DataFrame:
    """``col, lfc, effect, pct_in, pct_out``."""
    two = _one_vs_rest(a, groups, target)
    s = two_group_stats(a, two)
    pct = percent_expressed(a, two).groupBy("col").agg(*(F.max(F.when(F.col("grp") == k, F.col("pct"))).alias(n) for k, n in ((1, "pct_in"), (0, "pct_out"))))
    d = cohens_d(*(F.col(c) for c in ("mean0", "var0", "n0", "mean1", "var1", "n1")))
    return s.join(pct, "col").select("col", F.log2((F.col("mean1") + pseudo) / (F.col("mean0") + pseudo)).alias("lfc"), d.alias("effect"), "pct_in", "pct_out")


def rank_groups(a: Matrix, groups: DataFrame, method: str = "fold_change", n_top: int = 10) -> DataFrame:
    """``grp, rank, col, score``: top columns of every group by fold change, effect or combination.

    Moments of a group's complement are those of all rows less the group's, so one pass serves all groups."""
    g = group_stats(a, groups).withColumn("ss", F.col("var") * F.greatest(F.col("n") - 1, F.lit(0)) + F.col("n") * F.col("mean") * F.col("mean"))
    w = Window.partitionBy("col")
    pos = a.entries.where("v > 0").join(groups, "row").groupBy("col", "grp").agg(F.count(F.lit(1)).alias("k"))
    g = g.join(pos, ["col", "grp"], "left").fillna(0, ["k"])
    n, s, q, k = F.col("n"), F.col("n") * F.col("mean"), F.col("ss"), F.col("k")
    d = g.select("col", "grp", n.alias("n1"), F.col("mean").alias("mean1"), F.col("var").alias("var1"), (F.sum(n).over(w) - n).alias("n0"), (F.sum(s).over(w) - s).alias("s0"), (F.sum(q).over(w) - q).alias("q0"), (k / n).alias("pct_in"), ((F.sum(k).over(w) - k) / F.nullif(F.sum(n).over(w) - n, F.lit(0))).alias("pct_out"))
    d = d.withColumn("mean0", F.coalesce(F.col("s0") / F.nullif(F.col("n0"), F.lit(0)), F.lit(0.0)))
    d = d.withColumn("var0", F.coalesce(F.greatest(F.lit(0.0), F.col("q0") - F.col("n0") * F.col("mean0") * F.col("mean0")) / F.nullif(F.col("n0") - 1, F.lit(0)), F.lit(0.0)))
    lfc = F.log2((F.col("mean1") + 1) / (F.col("mean0") + 1))
    eff = cohens_d(*(F.col(c) for c in ("mean0", "var0", "n0", "mean1", "var1", "n1")))
    score = {"fold_change": lfc, "effect": eff, "combined": eff * F.greatest(F.col("pct_in") - F.coalesce("pct_out", F.lit(0.0)), F.lit(0.01))}[method]
    top = Window.partitionBy("grp").orderBy(F.desc("score"), "col")
    return d.select("grp", "col", score.alias("score")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= n_top).select("grp", "rank", "col", "score")


def tau_specificity(means: DataFrame) -> DataFrame:
    """``col, tau`` = sum(1 - x / max) / (groups - 1)."""
    m = means.groupBy("col").agg(F.sum("mean").alias("s"), F.max("mean").alias("m"), F.count(F.lit(1)).alias("g"))
    return m.select("col", F.when((F.col("m") > 0) & (F.col("g") > 1), (F.col("g") - F.col("s") / F.col("m")) / (F.col("g") - 1)).otherwise(F.lit(0.0)).alias("tau"))


def gini_specificity(means: DataFrame) -> DataFrame:
    """``col, gini`` over group means."""
    w = Window.partitionBy("col").orderBy("mean", "grp")
    r = means.withColumn("_r", F.row_number().over(w)).groupBy("col").agg(F.sum(F.col("_r") * F.col("mean")).alias("w"), F.sum("mean").alias("s"), F.count(F.lit(1)).alias("g"))
    return r.select("col", F.coalesce(2 * F.col("w") / (F.col("g") * F.nullif(F.col("s"), F.lit(0.0))) - (F.col("g") + 1) / F.col("g"), F.lit(0.0)).alias("gini"))


def filter_markers(stats: DataFrame, min_fc: float = 1.5, min_pct: float = 0.1) -> DataFrame:
    return stats.where((F.col("lfc") >= F.log2(F.lit(min_fc))) & (F.col("pct_in") >= min_pct)).select("col")


def volcano(stats: DataFrame, fc_weight: float = 0.5, es_weight: float = 0.5) -> DataFrame:
    return stats.select("col", (fc_weight * F.col("lfc") + es_weight * F.col("effect")).alias("score"))


def differential_markers(a: Matrix, groups: DataFrame, first: int, second: int, pseudo: float = 1.0) -> DataFrame:
    """``col, lfc, pct_diff`` of one group against another."""
    d = group_means(a, groups).join(percent_expressed(a, groups), ["col", "grp"]).where(F.col("grp").isin(first, second)).groupBy("col")
    at = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    return d.agg(F.log2((at(first, "mean") + pseudo) / (at(second, "mean") + pseudo)).alias("lfc"), (at(first, "pct") - at(second, "pct")).alias("pct_diff"))


def top_markers(a: Matrix, groups: DataFrame, n_top: int = 10) -> DataFrame:
    """``grp, col, score, rank``: a group's mean less the mean of the other groups' means, best first."""
    w = Window.partitionBy("col")
    others = (F.sum("mean").over(w) - F.col("mean")) / F.nullif(F.count(F.lit(1)).over(w) - 1, F.lit(0))
    d = group_means(a, groups).select("grp", "col", (F.col("mean") - F.coalesce(others, F.lit(0.0))).alias("score"))
    best = Window.partitionBy("grp").orderBy(F.round("score", 9).desc(), "col")
    return d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_top)


# --- annotation --------------------------------------------------------------


def reference_profiles(a: Matrix, groups: DataFrame) -> DataFrame:
    """``grp, col, mean`` including zeros."""
    return group_means(a, groups).select("grp", "col", "mean")


def profile_correlation(a: Matrix, profiles: DataFrame) -> DataFrame:
    """``row, grp, r``: Pearson of every row with every profile over all columns."""
    n = float(a.n_cols)
    p = profiles.groupBy("grp").agg(F.avg("mean").alias("pm"), F.stddev_pop("mean").alias("ps"))
    m = row_moments(a, ddof=0).select("row", F.col("mean").alias("xm"), F.sqrt("var").alias("xs"))
    d = a.entries.join(profiles, "col").groupBy("row", "grp").agg(F.sum(F.col("v") * F.col("mean")).alias("xy"))
    j = m.crossJoin(F.broadcast(p)).join(d, ["row", "grp"], "left")
    r = (F.coalesce("xy", F.lit(0.0)) / n - F.col("xm") * F.col("pm")) / F.nullif(F.col("xs") * F.col("ps"), F.lit(0.0))
    return j.select("row", "grp", F.coalesce(r, F.lit(0.0)).alias("r"))


def best_label(scores: DataFrame, score: str = "r") -> DataFrame:
    """``row, grp, score``: the best group of a row, ties to the lower."""
    w = Window.partitionBy("row").orderBy(F.desc(score), "grp")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("row", "grp", F.col(score).alias("score"))


def correlation_assignment(a: Matrix, profiles: DataFrame) -> DataFrame:
    return best_label(profile_correlation(a, profiles))


def hierarchical_annotation(a: Matrix, coarse: DataFrame, fine: DataFrame, parents: DataFrame) -> DataFrame:
    """``row, coarse, fine, coarse_confidence, fine_confidence``: the fine profile is one of the coarse choice's children (``fine, coarse``)."""
    c = correlation_assignment(a, coarse).select("row", F.col("grp").alias("coarse"), ((F.col("score") + 1) / 2).alias("coarse_confidence"))
    r = profile_correlation(a, fine).join(parents.withColumnRenamed("fine", "grp"), "grp").join(c, ["row", "coarse"])
    f = best_label(r).select("row", F.col("grp").alias("fine"), ((F.col("score") + 1) / 2).alias("fine_confidence"))
    return c.join(f, "row", "left").select("row", "coarse", "fine", "coarse_confidence", "fine_confidence")


def marker_scores(a: Matrix, sets: DataFrame, normalize: bool = True) -> DataFrame:
    """``row, grp, score``: mean of a type's markers, softmax over types."""
    m = mean_score(a, sets).select("row", F.col("set_id").alias("grp"), "score")
    if not normalize:
        return m
    w = Window.partitionBy("row")
    e = m.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select("row", "grp", (F.col("e") / F.sum("e").over(w)).alias("score"))


def consensus(predictions: DataFrame) -> DataFrame:
    """Confidence-weighted vote over methods (``id, label, w``)."""
    return weighted_vote(predictions)


def novel_types(confidence: DataFrame, threshold: float = 0.3) -> DataFrame:
    return confidence.select("id", (F.col("confidence") < threshold).alias("novel"))


def novel_by_distance(a: Matrix, profiles: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``row, dist, novel``: cosine distance to the assigned profile; an unknown label is novel at distance 1."""
    p = profiles.groupBy("grp").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("pn"))
    x = a.entries.join(labels, "row").join(profiles, ["grp", "col"]).groupBy("row").agg(F.sum(F.col("v") * F.col("mean")).alias("d"))
    n = a.entries.groupBy("row").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("xn"))
    j = labels.join(p, "grp", "left").join(x, "row", "left").join(n, "row", "left")
    dist = F.coalesce(1 - F.coalesce("d", F.lit(0.0)) / F.nullif(F.col("xn") * F.col("pn"), F.lit(0.0)), F.lit(1.0))
    return j.select("row", dist.alias("dist"), (F.col("pn").isNull() | (dist > threshold)).alias("novel"))


def novel_clusters(novel: DataFrame, clusters: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    s = clusters.join(novel, "id").groupBy("cluster").agg(F.avg(F.col("novel").cast("double")).alias("f"))
    return s.select("cluster", (F.col("f") >= min_fraction).alias("novel"))


def annotation_entropy(probs: DataFrame) -> DataFrame:
    """``row, h``: entropy of type probabilities (``row, grp, score``) over the log of the number of types."""
    g = probs.groupBy("row").agg(F.coalesce(F.sum(F.when(F.col("score") > 1e-15, -F.col("score") * F.log("score"))), F.lit(0.0)).alias("h"), F.count(F.lit(1)).alias("k"))
    return g.select("row", F.when(F.col("k") > 1, F.col("h") / F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0)).alias("h"))


def marker_expression(a: Matrix, groups: DataFrame, markers: DataFrame) -> DataFrame:
    """``grp, col, mean, pct`` of marker columns."""
    sub = Matrix(a.entries.join(markers, "col", "left_semi"), a.rows, markers.select("col").distinct())
    return group_means(sub, groups).join(percent_expressed(sub, groups), ["col", "grp"]).select("grp", "col", "mean", "pct")


# --- association of two matrices over the same rows --------------------------


def cross_correlation(a: Matrix, b: Matrix, min_abs: float = 0.0, pairs: DataFrame | None = None) -> DataFrame:
    """``col, other, r`` of columns of a and b over all rows: all pairs, or the listed (``col, other``)."""
    n = float(a.n_rows)
    sa = col_moments(a, ddof=0).select("col", F.col("mean").alias("m1"), F.sqrt("var").alias("s1"))
    sb = col_moments(b, ddof=0).select(F.col("col").alias("other"), F.col("mean").alias("m2"), F.sqrt("var").alias("s2"))
    dots = a.entries.join(b.entries.select("row", F.col("col").alias("other"), F.col("v").alias("u")), "row")
    dots = dots.join(pairs, ["col", "other"], "left_semi") if pairs is not None else dots
    dots = dots.groupBy("col", "other").agg(F.sum(F.col("v") * F.col("u")).alias("xy"))
    base = pairs.join(sa, "col").join(sb, "other") if pairs is not None else sa.crossJoin(sb)
    r = (F.coalesce("xy", F.lit(0.0)) / n - F.col("m1") * F.col("m2")) / F.nullif(F.col("s1") * F.col("s2"), F.lit(0.0))
    d = base.join(dots, ["col", "other"], "left").select("col", "other", F.coalesce(r, F.lit(0.0)).alias("r"))
    return d.where(F.abs("r") >= min_abs) if min_abs > 0 else d


def correlation_p(r: Column, n: float) -> Column:
    """Two-sided normal p of a correlation: z = t sqrt(1 - 0.25 / df) with t = r sqrt(df / (1 - r^2))."""
    df = max(n - 2, 1)
    t = r * F.sqrt(df / F.greatest(1 - r * r, F.lit(1e-15)))
    return two_sided(t * (1 - 0.25 / df) ** 0.5)


def cis_regulatory(a: Matrix, b: Matrix, pairs: DataFrame) -> DataFrame:
    return cross_correlation(a, b, pairs=pairs).select("col", "other", "r", correlation_p(F.col("r"), a.n_rows).alias("p"))


def enhancer_links(a: Matrix, b: Matrix, threshold: float, max_links: int = 1000) -> DataFrame:
    """Links r >= max(threshold, 0.1), the first ``max_links`` of a column in order of the other."""
    w = Window.partitionBy("col").orderBy("other")
    d = cross_correlation(a, b).where(F.col("r") >= max(threshold, 0.1))
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_links).drop("_r")


def ranked_matrix(a: Matrix) -> Matrix:
    """Columns replaced by average ranks less the rank of their implicit zeros, so that zeros stay implicit.
    Correlations of the result are Spearman's."""
    c = a.entries.groupBy("col", "v").agg(F.count(F.lit(1)).alias("c"))
    z = a.over_cols(a.entries.groupBy("col").agg(F.count(F.lit(1)).alias("k"))).select("col", F.lit(0.0).alias("v"), (F.lit(a.n_rows) - F.coalesce("k", F.lit(0))).alias("c"))
    t = c.unionByName(z).groupBy("col", "v").agg(F.sum("c").alias("c")).where("c > 0")
    before = Window.partitionBy("col").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    r = t.withColumn("rank", F.coalesce(F.sum("c").over(before), F.lit(0)) + (F.col("c") + 1) / 2)
    r = r.withColumn("zero", F.coalesce(F.max(F.when(F.col("v") == 0, F.col("rank"))).over(Window.partitionBy("col")), F.lit(0.0)))
    return a.with_entries(a.entries.join(r, ["col", "v"]).select("row", "col", (F.col("rank") - F.col("zero")).alias("v")))


def feature_coupling(a: Matrix, b: Matrix, min_abs: float = 0.0) -> DataFrame:
    return cross_correlation(ranked_matrix(a), ranked_matrix(b), min_abs)


def correlation_in_subset(a: Matrix, col1: int, b: Matrix, col2: int, rows: DataFrame) -> DataFrame:
    """``r`` of one column of each matrix over a subset of rows."""
    x = rows.join(a.entries.where(F.col("col") == col1).select("row", "v"), "row", "left").join(b.entries.where(F.col("col") == col2).select("row", F.col("v").alias("u")), "row", "left").fillna(0.0)
    return x.agg(F.coalesce(F.corr("v", "u"), F.lit(0.0)).alias("r"))


def peak_activity(a: Matrix, peak_map: DataFrame) -> DataFrame:
    """``row, gene, v``: peaks summed by the gene they map to (``col, gene``; negative: none)."""
    return a.entries.join(peak_map.where("gene >= 0"), "col").groupBy("row", "gene").agg(F.sum("v").alias("v"))


# --- ligand-receptor communication -------------------------------------------

PAIR_SCORES = {
    "mean_product": lambda x, y: x * y, "geometric_mean": lambda x, y: F.sqrt(F.greatest(F.lit(0.0), x * y)),
    "min_mean": lambda x, y: F.least(x, y), "product": lambda x, y: x * y,
}


def lr_scores(a: Matrix, types: DataFrame, pairs: DataFrame, method: str = "mean_product") -> DataFrame:
    """``pair, sender, receiver, score`` from ``pair, ligand, receptor``: type means of both columns combined."""
    m = group_means(a, types)
    x = pairs.join(m.select(F.col("col").alias("ligand"), F.col("grp").alias("sender"), F.col("mean").alias("l")), "ligand")
    y = x.join(m.select(F.col("col").alias("receptor"), F.col("grp").alias("receiver"), F.col("mean").alias("r")), "receptor")
    return y.select("pair", "sender", "receiver", PAIR_SCORES[method](F.col("l"), F.col("r")).alias("score"))


def specificity(a: Matrix, types: DataFrame) -> DataFrame:
    """``col, grp, share``: a type's mean over the sum of types' means."""
    m = group_means(a, types)
    return m.select("col", "grp", F.coalesce(F.col("mean") / F.nullif(F.sum("mean").over(Window.partitionBy("col")), F.lit(0.0)), F.lit(0.0)).alias("share"))


def natmi(a: Matrix, types: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, sender, receiver, weight`` = product of both means and both specificities."""
    m = group_means(a, types).join(specificity(a, types), ["col", "grp"]).select("col", "grp", (F.col("mean") * F.col("share")).alias("ms"))
    x = pairs.join(m.select(F.col("col").alias("ligand"), F.col("grp").alias("sender"), F.col("ms").alias("l")), "ligand")
    return x.join(m.select(F.col("col").alias("receptor"), F.col("grp").alias("receiver"), F.col("ms").alias("r")), "receptor").select("pair", "sender", "receiver", (F.col("l") * F.col("r")).alias("weight"))


def lr_permutation(a: Matrix, types: DataFrame, pairs: DataFrame, n_perm: int = 100, seed: int = 0, method: str = "mean_product") -> DataFrame:
    """``pair, sender, receiver, score, p`` = (permuted scores at least as high + 1) / (n + 1); labels are
    shuffled by the order of seeded hashes. A permutation costs one aggregate of the pairs' columns."""
    used = pairs.select(F.col("ligand").alias("col")).union(pairs.select("receptor")).distinct()
    sub = Matrix(a.entries.join(used, "col", "left_semi"), a.rows, used)
    obs = lr_scores(sub, types, pairs, method)
    perms = a.entries.sparkSession.range(n_perm).select(F.col("id").alias("perm"))
    # A permuted label is that of the row at the same place of another order; places are by hash order.
    order = lambda key: F.row_number().over(Window.partitionBy("perm").orderBy(key, "row"))
    t = types.crossJoin(F.broadcast(perms))
    to = t.select("perm", "row", order(F.xxhash64("row", F.lit(seed))).alias("pos"))
    frm = t.select("perm", "grp", order(F.xxhash64("row", "perm", F.lit(seed + 1))).alias("pos"))
    shuffled = to.join(frm, ["perm", "pos"]).select("perm", "row", "grp")
    size = types.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    m = sub.entries.join(shuffled, "row").groupBy("perm", "col", "grp").agg(F.sum("v").alias("s"))
    full = perms.crossJoin(F.broadcast(used.crossJoin(F.broadcast(size)))).join(m, ["perm", "col", "grp"], "left").select("perm", "col", "grp", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))
    x = pairs.join(full.select("perm", F.col("col").alias("ligand"), F.col("grp").alias("sender"), F.col("mean").alias("l")), "ligand")
    y = x.join(full.select("perm", F.col("col").alias("receptor"), F.col("grp").alias("receiver"), F.col("mean").alias("r")), ["perm", "receptor"])
    null = y.select("pair", "sender", "receiver", PAIR_SCORES[method](F.col("l"), F.col("r")).alias("ns"))
    g = obs.join(null, ["pair", "sender", "receiver"]).groupBy("pair", "sender", "receiver", "score").agg(F.sum((F.col("ns") >= F.col("score")).cast("int")).alias("x"))
    return g.select("pair", "sender", "receiver", "score", ((F.col("x") + 1) / (n_perm + 1)).alias("p"))


def significant_interactions(scored: DataFrame, threshold: float = 0.05) -> DataFrame:
    return scored.where(F.col("p") < threshold)


def aggregate_network(scored: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``sender, receiver, weight, n``: mean score and number of significant pairs."""
    return significant_interactions(scored, threshold).groupBy("sender", "receiver").agg(F.avg("score").alias("weight"), F.count(F.lit(1)).alias("n"))


def role_score(a: Matrix, types: DataFrame, columns: DataFrame) -> DataFrame:
    """``grp, score``: mean over ligands (receptors) of a type's mean."""
    m = group_means(a, types).join(columns, "col", "left_semi")
    return m.groupBy("grp").agg(F.avg("mean").alias("score"))


def network_centrality(net: DataFrame) -> DataFrame:
    """``grp, in_strength, out_strength, betweenness`` of ``sender, receiver, weight``; betweenness sums
    two-hop paths over themselves plus the direct weight."""
    i = net.groupBy(F.col("receiver").alias("grp")).agg(F.sum("weight").alias("in_strength"))
    o = net.groupBy(F.col("sender").alias("grp")).agg(F.sum("weight").alias("out_strength"))
    a = net.select(F.col("sender").alias("i"), F.col("receiver").alias("k"), F.col("weight").alias("w1"))
    b = net.select(F.col("sender").alias("k"), F.col("receiver").alias("j"), F.col("weight").alias("w2"))
    d = net.select(F.col("sender").alias("i"), F.col("receiver").alias("j"), F.col("weight").alias("w3"))
    p = a.join(b, "k").where("i <> j and i <> k and j <> k").join(d, ["i", "j"], "left")
    path = F.col("w1") * F.col("w2")
    bt = p.groupBy(F.col("k").alias("grp")).agg(F.sum(F.coalesce(path / F.nullif(path + F.coalesce("w3", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("betweenness"))
    return i.join(o, "grp", "full").join(bt, "grp", "left").fillna(0.0).select("grp", "in_strength", "out_strength", "betweenness")


def spatial_communication(a: Matrix, edges: DataFrame, ligand: int, receptor: int) -> DataFrame:
    """``row, score`` = sum w (L_i R_j + L_j R_i) / sum w over neighbours."""
    x = a.rows
    for c, n in ((ligand, "l"), (receptor, "r")):
        x = x.join(a.entries.where(F.col("col") == c).select("row", F.col("v").alias(n)), "row", "left")
    x = x.fillna(0.0)
    j = edges.join(x.select(F.col("row").alias("src"), "l", "r"), "src").join(x.select(F.col("row").alias("dst"), F.col("l").alias("l2"), F.col("r").alias("r2")), "dst")
    s = j.groupBy(F.col("src").alias("row")).agg((F.sum(F.col("w") * (F.col("l") * F.col("r2") + F.col("l2") * F.col("r"))) / F.nullif(F.sum("w"), F.lit(0.0))).alias("score"))
    return a.over_rows(s).select("row", zero("score"))


def pathway_scores(scores: DataFrame, pathways: DataFrame) -> DataFrame:
    """``pathway, sender, receiver, score``: mean over a pathway's pairs (``pair, pathway``)."""
    return scores.join(pathways, "pair").groupBy("pathway", "sender", "receiver").agg(F.avg("score").alias("score"))


def differential_communication(a: Matrix, types: DataFrame, conditions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair, sender, receiver, diff, log2_ratio`` of condition 1 against 0 (``row, cond``)."""
    out = []
    for k in (0, 1):
        rows = conditions.where(F.col("cond") == k).select("row")
        sub = Matrix(a.entries.join(rows, "row", "left_semi"), rows, a.cols)
        out.append(lr_scores(sub, types.join(rows, "row", "left_semi"), pairs).withColumnRenamed("score", f"s{k}"))
    j = out[0].join(out[1], ["pair", "sender", "receiver"], "full").fillna(0.0, ["s0", "s1"])
    return j.select("pair", "sender", "receiver", (F.col("s1") - F.col("s0")).alias("diff"), F.log2((F.col("s1") + 1e-10) / (F.col("s0") + 1e-10)).alias("log2_ratio"))


def communication_probability(a: Matrix, types: DataFrame, pairs: DataFrame, half: float = 0.5) -> DataFrame:
    """``pair, sender, receiver, p``: saturating law of mass action, LR / (half + LR)."""
    s = lr_scores(a, types, pairs)
    return s.select("pair", "sender", "receiver", F.coalesce(F.col("score") / F.nullif(F.lit(half) + F.col("score"), F.lit(0.0)), F.lit(0.0)).alias("p"))


# --- networks of columns -----------------------------------------------------


def correlation_network(a: Matrix, threshold: float = 0.3, spearman: bool = False) -> DataFrame:
    """``a, b, r`` of column pairs (a < b) with |r| at or above the threshold."""
    m = ranked_matrix(a) if spearman else a
    return pearson(m.T, threshold).select(F.col("row").alias("a"), F.col("other").alias("b"), "r")


def partial_network(a: Matrix, threshold: float = 0.3, ridge: float = 0.01) -> DataFrame:
    """-r / (1 + ridge): the correlation with a ridged diagonal, negated; not an inverse covariance."""
    near = threshold * (1 + ridge) * (1 - 1e-9)  # the exact threshold follows
    d = pearson(a.T, near).select(F.col("row").alias("a"), F.col("other").alias("b"), (-F.col("r") / (1 + ridge)).alias("r"))
    return d.where(F.abs("r") >= threshold)


def mi_network(a: Matrix, threshold: float = 0.3, n_bins: int = 10) -> DataFrame:
    """``a, b, mi``: binned mutual information over log(bins), at or above the threshold.

    Cells outside the bin of 0 are joined; the other counts follow from margins."""
    from .information import _binned

    n = float(a.n_rows)
    b = cut(_binned(a, n_bins))
    zero_bin = b.groupBy("col").agg(F.max("zero_bin").alias("z"))
    off = b.where("bin <> zero_bin").select("row", "col", "bin")
    one = off.groupBy("col", "bin").agg(F.count(F.lit(1)).alias("c"))
    h = lambda c: F.when(c > 0, c / n * F.log(c / n)).otherwise(0.0)
    miss = one.groupBy("col").agg(F.sum("c").alias("k"))
    ent = zero_bin.join(one.groupBy("col").agg(F.sum(h(F.col("c"))).alias("s")), "col", "left").join(miss, "col", "left").fillna(0).select("col", (-(F.col("s") + h(n - F.col("k")))).alias("h"), "k")
    both = off.join(off.select("row", F.col("col").alias("o"), F.col("bin").alias("bin2")), "row").where("col < o").groupBy("col", "o", "bin", "bin2").agg(F.count(F.lit(1)).alias("c"))
    x_only = both.groupBy("col", "o", "bin").agg(F.sum("c").alias("t"))
    y_only = both.groupBy("col", "o", "bin2").agg(F.sum("c").alias("t"))
    pairs = ent.select("col", F.col("h").alias("hx"), F.col("k").alias("kx")).join(ent.select(F.col("col").alias("o"), F.col("h").alias("hy"), F.col("k").alias("ky")), F.col("col") < F.col("o"))
    joint = both.groupBy("col", "o").agg(F.sum(h(F.col("c"))).alias("j1"), F.sum("c").alias("nb"))
    sx = one.select("col", "bin", "c").join(pairs.select("col", "o"), "col").join(x_only, ["col", "o", "bin"], "left").groupBy("col", "o").agg(F.sum(h(F.col("c") - F.coalesce("t", F.lit(0)))).alias("j2"))
    sy = one.select(F.col("col").alias("o"), F.col("bin").alias("bin2"), "c").join(pairs.select("col", "o"), "o").join(y_only, ["col", "o", "bin2"], "left").groupBy("col", "o").agg(F.sum(h(F.col("c") - F.coalesce("t", F.lit(0)))).alias("j3"))
    d = pairs.join(joint, ["col", "o"], "left").join(sx, ["col", "o"], "left").join(sy, ["col", "o"], "left").fillna(0)
    hxy = -(F.col("j1") + F.col("j2") + F.col("j3") + h(n - F.col("kx") - F.col("ky") + F.col("nb")))
    mi = F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - hxy) / F.log(F.lit(float(n_bins)))
    return d.select(F.col("col").alias("a"), F.col("o").alias("b"), mi.alias("mi")).where(F.col("mi") >= threshold)


def tf_target_scores(a: Matrix, tfs: DataFrame, squared: bool = False, min_abs: float = 0.0) -> DataFrame:
    """``tf, target, score``: Pearson (or r^2 over the target's largest) of chosen columns with all others;
    Pearson only at or above ``min_abs``."""
    tfs = tfs.select(F.col("col").alias("tf")).distinct()
    r = pearson(a.T, 0.0 if squared else min_abs, tfs.select(F.col("tf").alias("row")))
    both = F.array(F.struct(F.col("row").alias("tf"), F.col("other").alias("target")), F.struct(F.col("other").alias("tf"), F.col("row").alias("target")))
    d = r.select("r", F.explode(both).alias("p")).select("p.tf", "p.target", F.col("r").alias("score")).join(F.broadcast(tfs), "tf", "left_semi")
    if not squared:
        return d
    q = F.col("score") * F.col("score")
    top = d.groupBy("target").agg(F.max(q).alias("top"))  # one row a column; the pairs are made again, not moved
    return d.join(F.broadcast(top), "target").select("tf", "target", F.coalesce(q / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def build_regulons(scores: DataFrame, threshold: float, min_size: int) -> DataFrame:
    """``set_id, col, weight`` of targets with |score| at the threshold, for columns with enough of them."""
    d = scores.where(F.abs("score") >= threshold)
    n = F.count(F.lit(1)).over(Window.partitionBy("tf"))
    return d.withColumn("_n", n).where(F.col("_n") >= min_size).select(F.col("tf").alias("set_id"), F.col("target").alias("col"), F.col("score").alias("weight"))


def regulon_activity(a: Matrix, regulons: DataFrame) -> DataFrame:
    """``set_id, row, score`` = sum |w| x / sum |w|."""
    return weighted_score(a, regulons.withColumn("weight", F.abs("weight")))


def network_statistics(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``id, degree, coefficient`` of edges (``a, b, r``) with |r| above the threshold."""
    from ..model import Graph
    from .graphs import clustering_coefficient

    e = cut(edges.where(F.abs("r") > threshold))
    g = Graph.of(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")))
    return network_degrees(e).join(clustering_coefficient(g), "id")


def network_degrees(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``id, degree`` of edges (``a, b, r``) with |r| above the threshold."""
    return edges.where(F.abs("r") > threshold).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hub_columns(degrees: DataFrame, fraction: float = 0.8) -> DataFrame:
    degrees = cut(degrees.select("id", "degree"))
    top = degrees.agg(F.max("degree").alias("m"))
    return degrees.crossJoin(F.broadcast(top)).where(F.col("degree") >= fraction * F.col("m")).select("id")


def correlation_matrix(a: Matrix, kind: str = "pearson") -> DataFrame:
    """``a, b, r`` of all column pairs (a < b); ``kind`` is pearson, spearman or bicor."""
    from .robust import bicor

    if kind == "bicor":
        return bicor(a)
    m = {"pearson": lambda: a, "spearman": lambda: ranked_matrix(a)}[kind]()
    return pearson(m.T).select(F.col("row").alias("a"), F.col("other").alias("b"), "r")


def adjacency(a: Matrix, power: float = 6.0, kind: str = "unsigned", corr: str = "pearson") -> DataFrame:
    """``a, b, w`` (a < b): |r|^p, ((1 + r) / 2)^p, or r^p of positive r (signed hybrid: sign kept); ``corr``
    is pearson, spearman or bicor."""
    r = F.col("r")
    w = {"unsigned": F.pow(F.abs(r), F.lit(power)), "signed": F.pow((1 + r) / 2, F.lit(power)), "signed_hybrid": F.signum(r) * F.pow(F.abs(r), F.lit(power))}[kind]
    return correlation_matrix(a, corr).select("a", "b", w.alias("w"))


def topological_overlap(adj: DataFrame) -> DataFrame:
    """``a, b, tom`` = (sum_u a_iu a_uj + a_ij) / (min(k_i, k_j) + 1 - a_ij)."""
    both = adj.unionByName(adj.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    k = both.groupBy("a").agg(F.sum("w").alias("k"))
    l = both.join(both.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w2")), "b").where("a < c").groupBy("a", F.col("c").alias("b")).agg(F.sum(F.col("w") * F.col("w2")).alias("l"))  # noqa: E741
    j = adj.join(l, ["a", "b"], "left").join(k, "a").join(k.select(F.col("a").alias("b"), F.col("k").alias("k2")), "b")
    return j.select("a", "b", ((F.coalesce("l", F.lit(0.0)) + F.col("w")) / (F.least("k", "k2") + 1 - F.col("w"))).alias("tom"))


def soft_threshold(a: Matrix, powers: list[float], n_bins: int = 20) -> DataFrame:
    """``power, fit``: signed R^2 of log10 p(k) on log10 k over bins of connectivity."""
    w = [F.pow(F.abs("r"), F.lit(float(x))).alias(f"w{i}") for i, x in enumerate(powers)]
    ends = pearson(a.T).select("row", "other", *w).select(F.explode(F.array("row", "other")).alias("id"), *[f"w{i}" for i in range(len(powers))])
    k = ends.groupBy("id").agg(F.array(*[F.struct(F.lit(float(x)).alias("power"), F.sum(f"w{i}").alias("x")) for i, x in enumerate(powers)]).alias("k"))
    k = cut(k.select("id", F.explode("k").alias("k")).select("k.power", "id", "k.x"))
    from .information import equal_width

    b = equal_width(k, n_bins, ("power",)).groupBy("power", "bin").agg(F.avg("x").alias("k"), F.count(F.lit(1)).alias("c")).where("k > 0")
    b = b.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("power")))
    f = b.groupBy("power").agg(F.corr(F.log10("k"), F.log10("p")).alias("r"), F.coalesce(F.covar_pop(F.log10("k"), F.log10("p")), F.lit(0.0)).alias("c"))
    return f.select("power", F.coalesce(-F.signum("c") * F.col("r") * F.col("r"), F.lit(0.0)).alias("fit"))


def module_connectivity(adj: DataFrame, modules: DataFrame) -> DataFrame:
    """``id, module, k``: mean adjacency to the other columns of the module (``id, module``)."""
    m1, m2 = modules.select(F.col("id").alias("a"), "module"), modules.select(F.col("id").alias("b"), F.col("module").alias("m2"))
    inside = adj.join(F.broadcast(m1), "a").join(F.broadcast(m2), "b").where("module = m2")
    return inside.select(F.explode(F.array("a", "b")).alias("id"), "module", "w").groupBy("id", "module").agg(F.avg("w").alias("k"))


def hub_genes(adj: DataFrame, modules: DataFrame, max_hubs: int = 10) -> DataFrame:
    w = Window.partitionBy("module").orderBy(F.desc(F.round("k", 12)), "id")  # sums in another order stay ties
    return module_connectivity(adj, modules).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_hubs)


def module_preservation(ref: DataFrame, test: DataFrame, modules: DataFrame) -> DataFrame:
    """``module, z`` = correlation of connectivities * sqrt(columns); 0 under three columns."""
    j = module_connectivity(ref, modules).join(module_connectivity(test, modules).select("id", F.col("k").alias("k2")), "id")
    return j.groupBy("module").agg(F.corr("k", "k2").alias("r"), F.count(F.lit(1)).alias("n")).select("module", F.when(F.col("n") >= 3, F.coalesce("r", F.lit(0.0)) * F.sqrt("n")).otherwise(F.lit(0.0)).alias("z"))


def eigengenes(a: Matrix, modules: DataFrame, n_iter: int = 50) -> DataFrame:
    """``module, row, x``: first principal component scores of a module's centred columns, by power
    iteration in the column space (scores are X times the vector; a module's state is its columns)."""
    n = float(a.n_rows)
    e = cut(a.entries.join(modules.select(F.col("id").alias("col"), "module"), "col"))
    mean = e.groupBy("module", "col").agg((F.sum("v") / n).alias("mean"))
    full = cut(modules.select(F.col("id").alias("col"), "module").join(mean, ["module", "col"], "left").fillna(0.0, ["mean"]))
    g = e.select("row", "module", "col", "v").join(e.select("row", "module", F.col("col").alias("o"), F.col("v").alias("u")), ["row", "module"]).groupBy("module", "col", "o").agg(F.sum(F.col("v") * F.col("u")).alias("xy"))
    pairs = full.join(full.select("module", F.col("col").alias("o"), F.col("mean").alias("m2")), "module").join(g, ["module", "col", "o"], "left")
    cov = cut(pairs.select("module", "col", "o", (F.coalesce("xy", F.lit(0.0)) / n - F.col("mean") * F.col("m2")).alias("c")))
    vec = full.select("module", "col", (1.0 / F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("module")))).alias("x"))
    for i in range(n_iter):
        y = cov.join(vec.select("module", F.col("col").alias("o"), "x"), ["module", "o"]).groupBy("module", "col").agg(F.sum(F.col("c") * F.col("x")).alias("y"))
        norm = F.sqrt(F.sum(F.col("y") * F.col("y")).over(Window.partitionBy("module")))
        vec = y.select("module", "col", F.coalesce(F.col("y") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias("x"))
        vec = cut(vec) if i % 5 == 4 else vec
    shift = full.join(vec, ["module", "col"]).groupBy("module").agg(F.sum(F.col("mean") * F.col("x")).alias("b"))
    s = e.join(vec, ["module", "col"]).groupBy("module", "row").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
    every = a.rows.crossJoin(F.broadcast(shift))
    return every.join(s, ["module", "row"], "left").select("module", "row", (F.coalesce("s", F.lit(0.0)) - F.col("b")).alias("x"))


def trait_correlation(eigen: DataFrame, traits: DataFrame) -> DataFrame:
    """``module, trait, r, p`` (``row, trait, y``); p of Fisher's z as 2 exp(-z^2 / 2), at most 1."""
    d = eigen.join(traits, "row").groupBy("module", "trait").agg(F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("r"), F.count(F.lit(1)).alias("n"))
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("r")))
    z = F.sqrt(F.greatest(F.col("n") - 3, F.lit(0))) * 0.5 * F.log((1 + r) / (1 - r))
    return d.select("module", "trait", "r", F.least(F.lit(1.0), 2 * F.exp(-z * z / 2)).alias("p"))


def module_membership(a: Matrix, eigen: DataFrame) -> DataFrame:
    """``col, module, r``: correlation of every column with every module's scores."""
    n = float(a.n_rows)
    s = eigen.groupBy("module").agg(F.avg("x").alias("xm"), F.stddev_pop("x").alias("xs"))
    d = a.entries.join(eigen, "row").groupBy("col", "module").agg(F.sum(F.col("v") * F.col("x")).alias("xy"))
    m = col_moments(a, ddof=0).select("col", "mean", F.sqrt("var").alias("sd"))
    r = (F.coalesce("xy", F.lit(0.0)) / n - F.col("mean") * F.col("xm")) / F.nullif(F.col("sd") * F.col("xs"), F.lit(0.0))
    return m.crossJoin(F.broadcast(s)).join(d, ["col", "module"], "left").select("col", "module", F.coalesce(r, F.lit(0.0)).alias("r"))


# --- subpopulations ----------------------------------------------------------


def marker_bitmask(a: Matrix, markers: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``row, label``: bits of the markers (``col, bit``) above the threshold."""
    s = a.entries.where(F.col("v") > threshold).join(markers, "col").groupBy("row").agg(F.sum(F.pow(F.lit(2.0), F.col("bit")).cast("long")).alias("label"))
    return a.over_rows(s).select("row", F.coalesce("label", F.lit(0)).alias("label"))


def centroid_distances(a: Matrix, groups: DataFrame) -> DataFrame:
    """``a, b, dist`` (a < b): L2 of group means."""
    m = group_means(a, groups)
    d = F.col("mean") - F.col("m2")
    return m.join(m.select("col", F.col("grp").alias("b"), F.col("mean").alias("m2")), "col").where("grp < b").groupBy(F.col("grp").alias("a"), "b").agg(F.sqrt(F.sum(d * d)).alias("dist"))


def heterogeneous_groups(a: Matrix, groups: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``grp, variance, heterogeneous``: mean variance of stored entries above the threshold times the weighted mean."""
    s = group_stats(a, groups, ddof=0, zeros=False).where("nnz > 0").groupBy("grp").agg(F.avg("var").alias("variance"), F.max("n").alias("n"))
    w = s.agg((F.sum(F.col("variance") * F.col("n")) / F.sum("n")).alias("m"))
    return s.crossJoin(F.broadcast(w)).select("grp", "variance", (F.col("variance") > threshold * F.col("m")).alias("heterogeneous"))


def group_cohesion(a: Matrix, groups: DataFrame) -> DataFrame:
    """``grp, cohesion`` = 1 / (root mean squared distance of pairs + 1e-10), from moments: twice the
    summed population variance is the mean squared distance over all ordered pairs."""
    s = group_stats(a, groups, ddof=0).groupBy("grp").agg((2 * F.sum("var")).alias("d"), F.max("n").alias("n"))
    mean_sq = F.col("d") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))
    return s.select("grp", F.coalesce(1 / (F.sqrt(mean_sq) + 1e-10), F.lit(0.0)).alias("cohesion"))


def group_separation(a: Matrix, groups: DataFrame) -> DataFrame:
    """``grp, separation``: distance to the nearest other group mean."""
    d = centroid_distances(a, groups)
    return d.select("a", "dist").union(d.select("b", "dist")).toDF("grp", "dist").groupBy("grp").agg(F.min("dist").alias("separation"))


def population_balance(groups: DataFrame) -> DataFrame:
    """``balance``: entropy of group shares over the log of the number of groups."""
    c = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    p = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select((F.col("n") / F.col("t")).alias("p"))
    return p.agg(F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("p") * F.log("p")) / F.log(F.count(F.lit(1)).cast("double"))).otherwise(F.lit(0.0)).alias("balance"))


def cluster_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """``label, stability``: the best Jaccard overlap of a cluster (``id, label``) with one of another clustering."""
    c = first.join(second.withColumnRenamed("label", "other"), "id").groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))
    size = lambda k: F.sum("n").over(Window.partitionBy(k))
    j = c.withColumn("j", F.col("n") / (size("label") + size("other") - F.col("n")))
    return j.groupBy("label").agg(F.max("j").alias("stability"))


def group_quality(a: Matrix, groups: DataFrame) -> DataFrame:
    """``grp, quality`` = cohesion * distance to the nearest other centroid."""
    d = centroid_distances(a, groups)
    m = d.select("a", "dist").union(d.select("b", "dist")).toDF("grp", "dist").groupBy("grp").agg(F.min("dist").alias("sep"))
    return group_cohesion(a, groups).join(m, "grp").select("grp", (F.col("cohesion") * F.col("sep")).alias("quality"))


def representatives(a: Matrix, groups: DataFrame, per_group: int = 1) -> DataFrame:
    """``grp, row, dist``: rows nearest to their group's mean: |x|^2 - 2 x.m + |m|^2."""
    m = group_means(a, groups)
    mm = m.groupBy("grp").agg(F.sum(F.col("mean") * F.col("mean")).alias("mm"))
    x = a.entries.join(groups, "row").join(m, ["col", "grp"]).groupBy("row").agg(F.sum(F.col("v") * F.col("v") - 2 * F.col("v") * F.col("mean")).alias("d"))
    j = groups.join(x, "row", "left").join(F.broadcast(mm), "grp").select("grp", "row", F.sqrt(F.greatest(F.lit(0.0), F.coalesce("d", F.lit(0.0)) + F.col("mm"))).alias("dist"))
    w = Window.partitionBy("grp").orderBy("dist", "row")
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group).drop("_r")


def silhouette(dists: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, s`` on stored distances (``row, nbr, dist``), divided by the full sizes of clusters."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    j = dists.join(labels.select(F.col("id").alias("row"), F.col("label").alias("own")), "row").join(labels.select(F.col("id").alias("nbr"), "label"), "nbr").join(n, "label")
    m = j.groupBy("row", "own", "label").agg((F.sum("dist") / F.max(F.when(F.col("own") == F.col("label"), F.col("n") - 1).otherwise(F.col("n")))).alias("m"))
    s = m.groupBy("row").agg(F.max(F.when(F.col("own") == F.col("label"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("label"), F.col("m"))).alias("b"))
    return s.select("row", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("s"))


__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
