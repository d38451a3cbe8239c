"""Linear algebra, normalisation, quality control and reshaping of sparse matrices.

All functions take a ``Matrix`` (or its entries) and return lazy DataFrames. Sums
over a row or column are one hash aggregate with map-side partials; implicit
zeros enter through the size of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Matrix, zero

# --- products and sums -------------------------------------------------------


def spmv(a: Matrix, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """``row, y``: beta * y + alpha * A x, from ``col, x`` and ``row, y``."""
    p = a.entries.join(x, "col").groupBy("row").agg((F.sum(F.col("v") * F.col("x")) * alpha).alias("p"))
    out = a.over_rows(p)
    if y is None or beta == 0:
        return out.select("row", F.coalesce("p", F.lit(0.0)).alias("y"))
    return out.join(y, "row", "left").select("row", (F.coalesce("p", F.lit(0.0)) + beta * F.coalesce("y", F.lit(0.0))).alias("y"))


def spmv_transpose(a: Matrix, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """``col, y``: beta * y + alpha * A' x, from ``row, x`` and ``col, y``."""
    swap = lambda d: d.withColumnRenamed("row", "col")
    y = y.withColumnRenamed("col", "row") if y is not None else None
    return swap(spmv(a.T, swap(x), y, alpha, beta))


def spmv_fused_linear(a: Matrix, x: DataFrame, z: DataFrame, y: DataFrame, alpha: float, beta: float, gamma: float) -> DataFrame:
    """``row, y``: gamma * y + alpha * A x + beta * A z in one join and aggregate."""
    both = x.join(z, "col", "full")
    term = F.col("v") * (alpha * F.coalesce("x", F.lit(0.0)) + beta * F.coalesce("z", F.lit(0.0)))
    p = a.entries.join(both, "col").groupBy("row").agg(F.sum(term).alias("p"))
    return a.over_rows(p).join(y, "row", "left").select("row", (F.coalesce("p", F.lit(0.0)) + gamma * F.coalesce("y", F.lit(0.0))).alias("y"))


def spmm(a: Matrix, x: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``row, k, y``: A X for a dense X given as ``col, k, x``."""
    return a.entries.join(x, "col").groupBy("row", "k").agg((F.sum(F.col("v") * F.col("x")) * alpha).alias("y"))


def row_norms(a: Matrix) -> DataFrame:
    return a.over_rows(a.entries.groupBy("row").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))).select("row", zero("norm"))


def squared_norms(a: Matrix) -> DataFrame:
    return a.over_rows(a.entries.groupBy("row").agg(F.sum(F.col("v") * F.col("v")).alias("norm_sq"))).select("row", zero("norm_sq"))


def row_sums(a: Matrix) -> DataFrame:
    return a.over_rows(a.entries.groupBy("row").agg(F.sum("v").alias("total"))).select("row", zero("total"))


def diagonal(a: Matrix) -> DataFrame:
    """``row, d``: stored diagonal entries, 0 where none, up to the shorter side."""
    d = a.entries.where("row = col").select("row", F.col("v").alias("d"))
    return a.rows.join(a.cols.select(F.col("col").alias("row")), "row", "left_semi").join(d, "row", "left").select("row", zero("d"))


def scale_rows(a: Matrix, s: DataFrame) -> Matrix:
    """v * s of the row (``row, s``); a zero factor keeps the entries as zeros."""
    return a.with_entries(a.entries.join(s, "row", "left").select("row", "col", (F.col("v") * F.coalesce("s", F.lit(1.0))).alias("v")))


def shift_rows(a: Matrix, s: DataFrame) -> Matrix:
    """v + s of the row on stored entries."""
    return a.with_entries(a.entries.join(s, "row", "left").select("row", "col", (F.col("v") + F.coalesce("s", F.lit(0.0))).alias("v")))


def gram(a: Matrix) -> DataFrame:
    """``row, other, dot`` of all row pairs (row <= other) that share a column."""
    b = a.entries.select(F.col("row").alias("other"), "col", F.col("v").alias("u"))
    return a.entries.join(b, "col").where("row <= other").groupBy("row", "other").agg(F.sum(F.col("v") * F.col("u")).alias("dot"))


# --- moments -----------------------------------------------------------------


def moments(entries: DataFrame, keys: list[str], n: Column | int, ddof: int = 1, v: Column | None = None) -> DataFrame:
    """``keys, n, total, mean, var`` over n values of which the rest are zero."""
    v = F.col("v") if v is None else v
    n = F.lit(n) if not isinstance(n, Column) else n
    g = entries.groupBy(*keys).agg(F.sum(v).alias("total"), F.sum(v * v).alias("_sq"), F.count(F.lit(1)).alias("nnz"))
    mean = F.col("total") / n
    var = F.greatest(F.lit(0.0), F.col("_sq") - n * mean * mean) / F.nullif(n - ddof, F.lit(0))
    return g.select(*keys, "nnz", "total", mean.alias("mean"), F.coalesce(var, F.lit(0.0)).alias("var"))


def row_moments(a: Matrix, ddof: int = 1) -> DataFrame:
    """``row, nnz, total, mean, var`` over all columns."""
    m = moments(a.entries, ["row"], a.n_cols, ddof)
    return a.over_rows(m).select("row", F.coalesce("nnz", F.lit(0)).alias("nnz"), zero("total"), zero("mean"), zero("var"))


def col_moments(a: Matrix, ddof: int = 1) -> DataFrame:
    """``col, nnz, total, mean, var`` over all rows."""
    m = moments(a.entries, ["col"], a.n_rows, ddof)
    return a.over_cols(m).select("col", F.coalesce("nnz", F.lit(0)).alias("nnz"), zero("total"), zero("mean"), zero("var"))


def clipped_moments(a: Matrix, clip: DataFrame) -> DataFrame:
    """``col, mean, var`` of min(v, clip of the column)."""
    e = a.entries.join(clip, "col", "left").withColumn("v", F.least("v", F.coalesce("clip", F.col("v"))))
    m = moments(e, ["col"], a.n_rows, 1)
    return a.over_cols(m).select("col", zero("mean"), zero("var"))


def detection_rate(a: Matrix) -> DataFrame:
    m = a.entries.groupBy("col").agg(F.count(F.lit(1)).alias("nnz"))
    return a.over_cols(m).select("col", (F.coalesce("nnz", F.lit(0)) / F.lit(a.n_rows)).alias("rate"))


def dispersion(stats: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Adds var / mean, 0 where the mean is not above eps."""
    return stats.withColumn("dispersion", F.when(F.col("mean") > eps, F.col("var") / F.col("mean")).otherwise(F.lit(0.0)))


def select_by_dispersion(a: Matrix, n_top: int) -> DataFrame:
    """The n_top most dispersed columns, ties by id."""
    return dispersion(col_moments(a)).select("col", "dispersion").orderBy(F.desc("dispersion"), "col").limit(n_top)


def select_by_vst(a: Matrix, clip: DataFrame, n_top: int) -> DataFrame:
    """The n_top columns by variance of clipped values."""
    return clipped_moments(a, clip).select("col", "var").orderBy(F.desc("var"), "col").limit(n_top)


def group_stats(a: Matrix, groups: DataFrame, ddof: int = 1, zeros: bool = True, compat: bool = False) -> DataFrame:
    """``col, grp, n, nnz, mean, var`` from ``row, grp``; with or without implicit zeros. With ``compat``, the
    squares of stored entries are taken about their own mean and only those of zeros about the mean of
    all, which is less than the variance; it is for comparison with results computed so."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    e = a.entries.join(groups, "row")
    g = e.groupBy("col", "grp").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("nnz"))
    g = a.cols.crossJoin(F.broadcast(sizes)).join(g, ["col", "grp"], "left")  # groups are few: one row each
    s, q, nnz = (F.coalesce(c, F.lit(0)) for c in ("s", "q", "nnz"))
    n = F.col("n") if zeros else nnz
    mean = s / F.nullif(n, F.lit(0))
    squares = q - n * mean * mean if not compat else q - F.coalesce(s * s / F.nullif(nnz, F.lit(0)), F.lit(0.0)) + (n - nnz) * mean * mean
    var = F.greatest(F.lit(0.0), squares) / F.when(n > ddof, n - ddof)
    return g.select("col", "grp", "n", nnz.alias("nnz"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(var, F.lit(0.0)).alias("var"))


def nonzero_group_stats(a: Matrix, groups: DataFrame) -> DataFrame:
    """Per group mean and variance of stored entries only."""
    return group_stats(a, groups, zeros=False)


# --- normalisation -----------------------------------------------------------


def normalize_total(a: Matrix, target: float = 1e4) -> Matrix:
    """Rows scaled so that their sums equal the target; empty rows stay empty."""
    sums = a.entries.groupBy("row").agg(F.sum("v").alias("_t"))
    e = a.entries.join(sums, "row").select("row", "col", F.when(F.col("_t") != 0, F.col("v") * target / F.col("_t")).otherwise(F.col("v")).alias("v"))
    return a.with_entries(e)


def masked_row_sums(a: Matrix, mask: DataFrame) -> DataFrame:
    """Row sums over the columns of ``mask`` (``col``)."""
    return row_sums(a.with_entries(a.entries.join(mask, "col", "left_semi")))


def highly_expressed(a: Matrix, max_fraction: float) -> DataFrame:
    """``col, flagged``: some entry exceeds that share of its row's sum."""
    sums = a.entries.groupBy("row").agg(F.sum("v").alias("_t"))
    hit = a.entries.join(sums, "row").groupBy("col").agg(F.max((F.col("v") > max_fraction * F.col("_t")).cast("int")).alias("flagged"))
    return a.over_cols(hit).select("col", F.coalesce("flagged", F.lit(0)).alias("flagged"))


def _mapped(a: Matrix, f) -> Matrix:
    return a.with_entries(a.entries.select("row", "col", f(F.col("v")).alias("v")))


def log1p(a: Matrix) -> Matrix:
    return _mapped(a, F.log1p)


def log2p1(a: Matrix) -> Matrix:
    return _mapped(a, lambda v: F.log2(1 + v))


def expm1(a: Matrix) -> Matrix:
    return _mapped(a, F.expm1)


def standardize(a: Matrix, stats: DataFrame, max_value: float | None = None, zero_center: bool = True) -> Matrix:
    """(v - mean) / std of the column on stored entries, clipped; ``stats`` has ``col, mean, std``."""
    z = (F.col("v") - (F.col("mean") if zero_center else F.lit(0.0))) / F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    if max_value:
        z = F.greatest(F.lit(-max_value), F.least(F.lit(max_value), z))
    return a.with_entries(a.entries.join(stats, "col").select("row", "col", z.alias("v")))


def softmax(a: Matrix, temperature: float = 1.0) -> Matrix:
    """Row softmax over stored entries; a temperature of 0 or less marks the maxima."""
    top = a.entries.groupBy("row").agg(F.max("v").alias("_m"))
    e = a.entries.join(top, "row")
    x = F.exp((F.col("v") - F.col("_m")) / temperature) if temperature > 0 else (F.col("v") == F.col("_m")).cast("double")
    e = e.withColumn("_x", x)
    total = e.groupBy("row").agg(F.sum("_x").alias("_s"))
    return a.with_entries(e.join(total, "row").select("row", "col", (F.col("_x") / F.col("_s")).alias("v")))


def log_softmax(a: Matrix, temperature: float = 1.0) -> Matrix:
    """Logarithm of the row softmax."""
    s = softmax(a, temperature)
    if temperature <= 0:
        return _mapped(s, lambda v: F.when(v > 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))))
    top = a.entries.groupBy("row").agg(F.max("v").alias("_m"))
    e = a.entries.join(top, "row").withColumn("_d", (F.col("v") - F.col("_m")) / temperature)
    total = e.groupBy("row").agg(F.log(F.sum(F.exp("_d"))).alias("_s"))
    return a.with_entries(e.join(total, "row").select("row", "col", (F.col("_d") - F.col("_s")).alias("v")))


# --- quality control ---------------------------------------------------------


def basic_qc(a: Matrix) -> DataFrame:
    """``row, n_genes, total_counts``."""
    q = a.entries.groupBy("row").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("v").alias("total_counts"))
    return a.over_rows(q).select("row", F.coalesce("n_genes", F.lit(0)).alias("n_genes"), zero("total_counts"))


def subset_pct(a: Matrix, subset: DataFrame) -> DataFrame:
    """``row, pct``: share in percent of a row's total in a column subset."""
    return fused_qc(a, subset).select("row", "pct")


def fused_qc(a: Matrix, subset: DataFrame) -> DataFrame:
    """``row, n_genes, total_counts, pct`` in one aggregate."""
    e = a.entries.join(subset.select("col", F.lit(1).alias("_in")), "col", "left")
    q = e.groupBy("row").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("v").alias("total_counts"), F.sum(F.when(F.col("_in") == 1, F.col("v")).otherwise(0.0)).alias("_s"))
    pct = F.when(F.col("total_counts") > 0, 100 * F.col("_s") / F.col("total_counts")).otherwise(F.lit(0.0))
    return a.over_rows(q).select("row", F.coalesce("n_genes", F.lit(0)).alias("n_genes"), zero("total_counts"), F.coalesce(pct, F.lit(0.0)).alias("pct"))


def subset_outliers(a: Matrix, subset: DataFrame, threshold: float) -> DataFrame:
    """``row, fraction, outlier``: a row's share of its sum in the subset's columns, and whether it is above the threshold."""
    s = a.entries.join(subset.select("col", F.lit(1.0).alias("_in")), "col", "left").groupBy("row").agg(F.sum(F.col("v") * F.coalesce("_in", F.lit(0.0))).alias("s"), F.sum("v").alias("t"))
    f = F.coalesce(F.col("s") / F.nullif(F.col("t"), F.lit(0.0)), F.lit(0.0))
    return a.over_rows(s).select("row", f.alias("fraction"), (f > threshold).alias("outlier"))


def qc_filter(a: Matrix, mito: DataFrame, min_genes=0, max_genes=1 << 60, min_counts=0.0, max_counts=1e300, max_mito_fraction=1.0) -> DataFrame:
    """``row, keep``: detected columns, totals and subset share within bounds."""
    q = fused_qc(a, mito)
    ok = F.col("n_genes").between(min_genes, max_genes) & F.col("total_counts").between(min_counts, max_counts) & (F.col("pct") <= 100 * max_mito_fraction)
    return q.select("row", ok.alias("keep"))


# --- structure ---------------------------------------------------------------


def vstack(a: Matrix, b: Matrix) -> Matrix:
    """b's rows after a's; row ids of b are shifted past the largest of a."""
    shift = (a.rows.agg(F.max("row")).first()[0] or -1) + 1
    down = lambda d: d.withColumn("row", F.col("row") + shift)
    return Matrix(a.entries.unionByName(down(b.entries)), a.rows.unionByName(down(b.rows)), a.cols.union(b.cols).distinct())


def hstack(a: Matrix, b: Matrix) -> Matrix:
    return vstack(a.T, b.T).T


def slice_rows(a: Matrix, keep: DataFrame) -> Matrix:
    """Rows in the order of ``keep`` (``row, pos``; repeats allowed), renumbered by pos."""
    e = a.entries.join(keep, "row").select(F.col("pos").alias("row"), "col", "v")
    return Matrix(e, keep.select(F.col("pos").alias("row")), a.cols)


def slice_cols(a: Matrix, keep: DataFrame) -> Matrix:
    return slice_rows(a.T, keep.withColumnRenamed("col", "row")).T


def row_range(a: Matrix, lo: int, hi: int) -> Matrix:
    """Rows lo <= row < hi; the filter reaches the scan."""
    return Matrix(a.entries.where((F.col("row") >= lo) & (F.col("row") < hi)), a.rows.where((F.col("row") >= lo) & (F.col("row") < hi)), a.cols)


def filter_cols(a: Matrix, mask: DataFrame) -> Matrix:
    """Columns of the mask, renumbered densely in order of id."""
    from .testing import positions

    return slice_cols(a, positions(mask.select(F.col("col").alias("id")).distinct()).select(F.col("id").alias("col"), F.col("pos").cast("long").alias("pos")))


def kept_entries(a: Matrix, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """``n``: stored entries that a slice would keep."""
    e = a.entries
    e = e.join(rows, "row", "left_semi") if rows is not None else e
    e = e.join(cols, "col", "left_semi") if cols is not None else e
    return e.agg(F.count(F.lit(1)).alias("n"))


def align_cols(a: Matrix, index_map: DataFrame, n_new: int) -> Matrix:
    """Columns renumbered by ``col, new``; ids outside 0..n_new-1 are dropped."""
    ok = index_map.where((F.col("new") >= 0) & (F.col("new") < n_new))
    e = a.entries.join(ok, "col").select("row", F.col("new").alias("col"), "v")
    return Matrix(e, a.rows, a.entries.sparkSession.range(n_new).select(F.col("id").alias("col")))


def row_lengths(a: Matrix) -> DataFrame:
    n = a.entries.groupBy("row").agg(F.count(F.lit(1)).alias("length"))
    return a.over_rows(n).select("row", F.coalesce("length", F.lit(0)).alias("length"))


def inverse_permutation(perm: DataFrame) -> DataFrame:
    """``i, inv`` with inv[p[i]] = i from ``i, p``."""
    return perm.select(F.col("p").alias("i"), F.col("i").alias("inv"))


def eliminate_zeros(a: Matrix, tolerance: float = 0.0) -> Matrix:
    return a.with_entries(a.entries.where(F.abs("v") > tolerance))


def prune(a: Matrix, threshold: float, keep_structure: bool = False) -> Matrix:
    """Small entries dropped (up to the threshold), or zeroed (below it) with the structure kept."""
    if keep_structure:
        return _mapped(a, lambda v: F.when(F.abs(v) < threshold, F.lit(0.0)).otherwise(v))
    return a.with_entries(a.entries.where(F.abs("v") > threshold))


def validate(a: Matrix) -> DataFrame:
    """``n_duplicates, n_out_of_domain, n_null, valid``."""
    d = a.entries.groupBy("row", "col").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n_duplicates"))
    out = a.entries.join(a.rows, "row", "left_anti").unionByName(a.entries.join(a.cols, "col", "left_anti")).agg(F.count(F.lit(1)).alias("n_out_of_domain"))
    nul = a.entries.agg(F.count(F.when(F.col("v").isNull(), 1)).alias("n_null"))
    return d.crossJoin(out).crossJoin(nul).withColumn("valid", (F.col("n_duplicates") == 0) & (F.col("n_out_of_domain") == 0) & (F.col("n_null") == 0))


def density(a: Matrix) -> DataFrame:
    """``nnz, density, sparsity``."""
    cells = float(a.n_rows * a.n_cols)
    n = a.entries.agg(F.count(F.lit(1)).alias("nnz"))
    d = F.col("nnz") / cells if cells else F.lit(0.0)
    return n.select("nnz", d.alias("density"), (1 - d).alias("sparsity"))


def to_csr(a: Matrix) -> DataFrame:
    """``row, indices, data`` with column ids in order; empty rows have empty arrays."""
    e = a.entries.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("e"))
    e = a.over_rows(e)
    return e.select("row", F.coalesce(F.col("e.col"), F.array().cast("array<long>")).alias("indices"), F.coalesce(F.col("e.v"), F.array().cast("array<double>")).alias("data"))


def from_csr(csr: DataFrame) -> Matrix:
    return Matrix.of(csr.select("row", F.explode(F.arrays_zip("indices", "data")).alias("e")).select("row", F.col("e.indices").alias("col"), F.col("e.data").alias("v")))


def indptr(a: Matrix) -> DataFrame:
    """``row, start``: offsets of rows in row order."""
    from .testing import sums_before

    return sums_before(row_lengths(a), "row", "length", "start").select("row", "start")


def from_dense(dense: DataFrame, keep=None) -> Matrix:
    """Entries of ``row, values`` arrays that pass a predicate (not zero)."""
    e = dense.select("row", F.posexplode("values").alias("col", "v")).withColumn("col", F.col("col").cast("long"))
    return Matrix(e.where(keep(F.col("v")) if keep else F.col("v") != 0), dense.select("row"), e.select("col").distinct())


def to_dense(a: Matrix) -> DataFrame:
    """``row, values``: dense rows, columns in order of id. For matrices of few columns."""
    cols = a.cols.agg(F.array_sort(F.collect_list("col")).alias("ids"))
    e = a.entries.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("m"))
    return a.over_rows(e).crossJoin(cols).select("row", F.transform("ids", lambda c: F.coalesce(F.element_at(F.col("m"), c), F.lit(0.0))).alias("values"))


def identity(spark, n: int) -> Matrix:
    return Matrix.of(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("v")))


def at(a: Matrix, row: int, col: int) -> DataFrame:
    """``v``: one cell, 0 where nothing is stored."""
    return a.entries.where((F.col("row") == row) & (F.col("col") == col)).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


# --- correlation -------------------------------------------------------------


#: Rows of a block of pairs; a task holds one block of at most the square of it.
PAIR_BLOCK = 1024


def _marked(df: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Adds ``k``: the row is one of the chosen (``row``; all without)."""
    if chosen is None:
        return df.withColumn("k", F.lit(True))
    return df.join(chosen.select("row").distinct().withColumn("k", F.lit(True)), "row", "left").withColumn("k", F.coalesce("k", F.lit(False)))


def _dots(a: Matrix, chosen: DataFrame | None = None) -> DataFrame:
    """``row, other, dot`` of the row pairs (row < other; one of them chosen) that share a column. Ranges of columns keep
    neighbouring columns together, so that a partition sums most products of a pair before the shuffle."""
    parts = a.n_cols // 16_384
    e = _marked(a.entries, chosen).repartitionByRange(*([parts] if parts > 1 else []), "col").groupBy("col").agg(F.sort_array(F.collect_list(F.struct("row", F.col("v").cast("double").alias("v"), "k"))).alias("e"))
    p = e.select("e", F.posexplode("e").alias("i", "x")).select("x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y")).where("x.row < y.row AND (x.k OR y.k)")
    return p.groupBy(F.col("x.row").alias("row"), F.col("y.row").alias("other")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("dot"))


def _correlations(n: float):
    def of(dot, mean, sd, mean2, sd2):
        import numpy as np

        dot /= n
        dot -= np.outer(mean, mean2)
        scale = np.outer(sd, sd2)
        with np.errstate(all="ignore"):
            r = np.where(scale == 0, 0.0, dot / scale)
        return np.fmax(-1.0, np.fmin(1.0, r))

    return of


def _distances(dot, q, _, q2, __):
    import numpy as np

    return np.sqrt(np.maximum(0.0, q[:, None] + q2[None, :] - 2 * dot))


def _block_pairs(value, min_abs: float):
    """A value of all pairs of two blocks of rows from two numbers of a row and the dot products that are not 0."""
    import numpy as np
    import pyarrow as pa

    def run(moments: pa.Table, dots: pa.Table) -> pa.Table:
        side = moments["side"].to_numpy()
        ids, mean, sd = (moments[c].to_numpy() for c in ("row", "mean", "sd"))
        same = bool((side == 0).any())
        one, two = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
        one, two = one[np.argsort(ids[one])], two[np.argsort(ids[two])]
        x, y = ids[one], ids[two]
        dot = np.zeros((len(x), len(y)))
        if len(dots) and len(x) and len(y):
            r, o = dots["row"].to_numpy(), dots["other"].to_numpy()
            at = np.minimum(np.searchsorted(x, r), len(x) - 1)
            first = x[at] == r
            left, right = np.where(first, r, o), np.where(first, o, r)
            dot[np.searchsorted(x, left), np.searchsorted(y, right)] = dots["dot"].to_numpy()
        cor = value(dot, mean[one], sd[one], mean[two], sd[two])
        k = moments["k"].to_numpy()
        keep = (np.abs(cor) >= min_abs) & (k[one][:, None] | k[two][None, :])
        if same:
            keep &= x[:, None] < y[None, :]
        i, j = np.nonzero(keep)
        return pa.table({"row": np.minimum(x[i], y[j]), "other": np.maximum(x[i], y[j]), "r": cor[i, j]})

    return run


def pearson(a: Matrix, min_abs: float = 0.0, chosen: DataFrame | None = None) -> DataFrame:
    """``row, other, r`` for all row pairs (row < other) of the domain with |r| at or above ``min_abs``,
    implicit zeros included; with ``chosen`` (``row``) those of which at least one row is chosen.

    Only pairs that share a column are joined; the others have a dot product of 0, so their r
    follows from means and deviations alone. Rows without variance give 0. Pairs are made in blocks of
    rows where they are needed: the moments travel once for a block, the dot products once, no pair."""
    s = _marked(row_moments(a, ddof=0), chosen).select(F.col("row").cast("long").alias("row"), "k", F.col("mean").cast("double").alias("mean"), F.sqrt("var").alias("sd"))
    return _pairs_by_blocks(s, _dots(a, chosen), a.n_rows, _correlations(float(a.n_cols)), min_abs)


def row_distances(a: Matrix) -> DataFrame:
    """``row, other, r``: Euclidean distances of all pairs (row < other) of rows with entries, in blocks as ``pearson``."""
    q = a.entries.groupBy("row").agg(F.sum(F.col("v") * F.col("v")).alias("mean"))
    s = q.select(F.col("row").cast("long").alias("row"), F.lit(True).alias("k"), "mean", F.lit(0.0).alias("sd"))
    return _pairs_by_blocks(s, _dots(a), a.n_rows, _distances, 0.0)


def _pairs_by_blocks(s: DataFrame, dots: DataFrame, n_rows: int, value, min_abs: float) -> DataFrame:
    blocks = -(-n_rows // PAIR_BLOCK) or 1
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")
    s = s.withColumn("b", block("row")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    side = F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2)
    parts = max(1, blocks * (blocks + 1) // 16)
    lo_hi = lambda x, y: [F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")]
    left = s.select(*lo_hi(F.col("b"), F.col("o")), side.alias("side"), "row", "mean", "sd", "k").repartition(parts, "lo", "hi")
    d = dots.select(F.col("row").cast("long").alias("row"), F.col("other").cast("long").alias("other"), "dot", block("row").alias("b"), block("other").alias("o"))
    right = d.select(*lo_hi(F.col("b"), F.col("o")), "row", "other", "dot").repartition(parts, "lo", "hi")
    return left.groupBy("lo", "hi").cogroup(right.groupBy("lo", "hi")).applyInArrow(_block_pairs(value, min_abs), "row long, other long, r double")


def pearson_stats(a: Matrix) -> DataFrame:
    """``row, mean, inv_std`` (population), inv_std 0 where the variance is."""
    m = row_moments(a, ddof=0)
    return m.select("row", "mean", F.when(F.col("var") > 0, 1 / F.sqrt("var")).otherwise(F.lit(0.0)).alias("inv_std"))


def pearson_with(a: Matrix, y: DataFrame) -> DataFrame:
    """``col, r``: correlation of every column with ``row, y`` over all rows."""
    n = float(a.n_rows)
    t = y.agg(F.avg("y").alias("ym"), F.sqrt(F.var_pop("y")).alias("ys"))
    e = a.entries.join(y, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("y")).alias("xy"))
    c = col_moments(a, ddof=0).join(e, "col", "left").crossJoin(F.broadcast(t))
    r = (F.coalesce("xy", F.lit(0.0)) / n - F.col("mean") * F.col("ym")) / F.nullif(F.sqrt("var") * F.col("ys"), F.lit(0.0))
    return c.select("col", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))).alias("r"))
