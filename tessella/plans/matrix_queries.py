"""Queries of the matrix operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix as M
from .base import q
from .inputs import with_

W = with_("m ri cj")
_x = lambda n: n.m.cols.select("col", (F.col("col") % 5 + 1).cast("double").alias("x"))
_z = lambda n: n.m.cols.select("col", (F.col("col") % 3).cast("double").alias("z"))
_y = lambda n: n.m.rows.select("row", (F.col("row") % 7).cast("double").alias("y"))
_s = lambda n: n.m.rows.select("row", (F.col("row") % 4).cast("double").alias("s"))
_sub = lambda n: n.m.cols.where("col % 10 = 0")
_stats = lambda n: M.col_moments(n.m).select("col", "mean", F.sqrt("var").alias("std"))
_clip = lambda n: n.m.cols.select("col", F.lit(60.0).alias("clip"))
_norm = lambda n: M.log1p(M.normalize_total(n.m, 1e3))
MOM = "SELECT j, coalesce(sum(v), 0) / max(n) AS mean, coalesce(sum(v * v) - max(n) * power(sum(v) / max(n), 2), 0) AS ss, max(n) AS n, count(v) AS nnz, coalesce(sum(v), 0) AS total FROM cj LEFT JOIN m USING (j) CROSS JOIN nr GROUP BY j"


def flagship(n):
    """Quality control, total-count normalisation, log1p, and the twenty most dispersed columns."""
    return M.select_by_dispersion(_norm(n), 20)


q("flagship", flagship, W + "SELECT j AS col, var / mean AS dispersion FROM (SELECT j, sum(w) / max(n) AS mean, (sum(w * w) - max(n) * power(sum(w) / max(n), 2)) / (max(n) - 1) AS var FROM (SELECT i, j, ln(1 + v * 1000 / sum(v) OVER (PARTITION BY i)) AS w FROM m) CROSS JOIN nr GROUP BY j) ORDER BY dispersion DESC, col LIMIT 20", "dispersion", "col")
q("spmv", lambda n: M.spmv(n.m, _x(n), _y(n), 2.0, 0.5), W + 'SELECT i AS "row", 2 * coalesce(sum(v * (j % 5 + 1)), 0) + 0.5 * (i % 7) AS y FROM ri LEFT JOIN m USING (i) GROUP BY i', "y", "row")
q("spmv_simple", lambda n: M.spmv(n.m, _x(n)), W + 'SELECT i AS "row", coalesce(sum(v * (j % 5 + 1)), 0) AS y FROM ri LEFT JOIN m USING (i) GROUP BY i', "y", "row")
q("spmv_transpose", lambda n: M.spmv_transpose(n.m, n.m.rows.select("row", (F.col("row") % 7).cast("double").alias("x"))), W + "SELECT j AS col, coalesce(sum(v * (i % 7)), 0) AS y FROM cj LEFT JOIN m USING (j) GROUP BY j", "y", "col")
q("spmv_fused_linear", lambda n: M.spmv_fused_linear(n.m, _x(n), _z(n), _y(n), 2.0, 3.0, 0.5), W + 'SELECT i AS "row", coalesce(sum(v * (2 * (j % 5 + 1) + 3 * (j % 3))), 0) + 0.5 * (i % 7) AS y FROM ri LEFT JOIN m USING (i) GROUP BY i', "y", "row")
q("spmm", lambda n: M.spmm(n.m, n.m.cols.select("col", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("col", "k", ((F.col("col") * (F.col("k") + 1)) % 11).cast("double").alias("x"))), W + 'SELECT i AS "row", k, sum(v * ((j * (k + 1)) % 11)) AS y FROM m CROSS JOIN (SELECT unnest(range(0, 3)) AS k) GROUP BY 1, 2', "y", "row k")
q("row_norms", lambda n: M.row_norms(n.m), W + 'SELECT i AS "row", sqrt(coalesce(sum(v * v), 0)) AS norm FROM ri LEFT JOIN m USING (i) GROUP BY i', "norm", "row")
q("squared_norms", lambda n: M.squared_norms(n.m), W + 'SELECT i AS "row", coalesce(sum(v * v), 0) AS norm_sq FROM ri LEFT JOIN m USING (i) GROUP BY i', "norm_sq", "row")
q("row_sums", lambda n: M.row_sums(n.m), W + 'SELECT i AS "row", coalesce(sum(v), 0) AS total FROM ri LEFT JOIN m USING (i) GROUP BY i', "total", "row")
q("extract_diagonal", lambda n: M.diagonal(n.m), W + 'SELECT i AS "row", coalesce(max(v), 0) AS d FROM ri JOIN cj ON i = cj.j LEFT JOIN m ON m.i = ri.i AND m.j = ri.i GROUP BY 1'.replace("SELECT i", "SELECT ri.i").replace("ON i =", "ON ri.i ="), "d", "row")
q("scale_rows", lambda n: M.scale_rows(n.m, _s(n)), W + 'SELECT i AS "row", j AS col, v * (i % 4) AS v FROM m', "v", "row col")
q("shift_rows", lambda n: M.shift_rows(n.m, _s(n)), W + 'SELECT i AS "row", j AS col, v + (i % 4) AS v FROM m', "v", "row col")
q("gram", lambda n: M.gram(n.m.T).withColumnRenamed("row", "a"), W + "SELECT a.j AS a, b.j AS other, sum(a.v * b.v) AS dot FROM m a JOIN m b ON a.i = b.i AND a.j <= b.j GROUP BY 1, 2", "dot", "a other")
q("row_moments", lambda n: M.row_moments(n.m), W + 'SELECT i AS "row", count(v) AS nnz, coalesce(sum(v), 0) AS total, coalesce(sum(v), 0) / max(n) AS mean, coalesce((sum(v * v) - max(n) * power(sum(v) / max(n), 2)) / (max(n) - 1), 0) AS var FROM ri LEFT JOIN m USING (i) CROSS JOIN nc GROUP BY i', "total mean var", "row nnz", 4)
q("standard_moments", lambda n: M.col_moments(n.m), W + f"SELECT j AS col, nnz, total, mean, ss / (n - 1) AS var FROM ({MOM})", "total mean var", "col nnz", 4)
q("clipped_moments", lambda n: M.clipped_moments(n.m, _clip(n)), W + "SELECT j AS col, coalesce(sum(least(v, 60)), 0) / max(n) AS mean, coalesce((sum(least(v, 60) * least(v, 60)) - max(n) * power(sum(least(v, 60)) / max(n), 2)) / (max(n) - 1), 0) AS var FROM cj LEFT JOIN m USING (j) CROSS JOIN nr GROUP BY j", "mean var", "col", 4)
q("detection_rate", lambda n: M.detection_rate(n.m), W + "SELECT j AS col, count(v) / max(n) AS rate FROM cj LEFT JOIN m USING (j) CROSS JOIN nr GROUP BY j", "rate", "col")
q("dispersion", lambda n: M.dispersion(M.col_moments(n.m)).select("col", "dispersion"), W + f"SELECT j AS col, CASE WHEN mean > 1e-12 THEN ss / (n - 1) / mean ELSE 0 END AS dispersion FROM ({MOM})", "dispersion", "col", 4)
q("select_by_dispersion", lambda n: M.select_by_dispersion(n.m, 15), W + f"SELECT j AS col, CASE WHEN mean > 1e-12 THEN ss / (n - 1) / mean ELSE 0 END AS dispersion FROM ({MOM}) ORDER BY dispersion DESC, col LIMIT 15", "dispersion", "col", 4)
q("select_by_vst", lambda n: M.select_by_vst(n.m, _clip(n), 15), W + "SELECT j AS col, coalesce((sum(least(v, 60) * least(v, 60)) - max(n) * power(sum(least(v, 60)) / max(n), 2)) / (max(n) - 1), 0) AS var FROM cj LEFT JOIN m USING (j) CROSS JOIN nr GROUP BY j ORDER BY var DESC, col LIMIT 15", "var", "col", 4)
GS = with_("m cj g") + "SELECT j AS col, cells.grp AS grp, max(cells.n) AS n, count(v) AS nnz, {mean} AS mean, {var} AS var FROM (SELECT j, grp, n FROM cj CROSS JOIN (SELECT grp, count(*) AS n FROM g GROUP BY grp)) cells LEFT JOIN (SELECT m.j AS mj, g.grp AS mg, v FROM m JOIN g USING (i)) e ON mj = j AND mg = grp GROUP BY 1, 2"
q("group_stats", lambda n: M.group_stats(n.m, n.groups), GS.format(mean="coalesce(sum(v), 0) / max(cells.n)", var="coalesce((sum(v * v) - max(cells.n) * power(sum(v) / max(cells.n), 2)) / (max(cells.n) - 1), 0)"), "mean var", "col grp n nnz", 4)
q("nonzero_group_stats", lambda n: M.nonzero_group_stats(n.m, n.groups), GS.format(mean="coalesce(avg(v), 0)", var="coalesce(var_samp(v), 0)"), "mean var", "col grp n nnz", 4)
q("normalize_total", lambda n: M.normalize_total(n.m, 1e4), W + 'SELECT i AS "row", j AS col, v * 10000 / sum(v) OVER (PARTITION BY i) AS v FROM m', "v", "row col")
q("primary_sums_masked", lambda n: M.masked_row_sums(n.m, _sub(n)), W + 'SELECT i AS "row", coalesce(sum(v), 0) AS total FROM ri LEFT JOIN (SELECT * FROM m WHERE j % 10 = 0) USING (i) GROUP BY i', "total", "row")
q("detect_highly_expressed", lambda n: M.highly_expressed(n.m, 0.2), W + "SELECT j AS col, coalesce(max(CASE WHEN v > 0.2 * t THEN 1 ELSE 0 END), 0) AS flagged FROM cj LEFT JOIN (SELECT j, v, sum(v) OVER (PARTITION BY i) AS t FROM m) USING (j) GROUP BY j", "", "col flagged")
for _n, _f, _e in (("log1p", M.log1p, "ln(1 + v)"), ("log2p1", M.log2p1, "log2(1 + v)")):
    q(_n, lambda n, f=_f: f(n.m), W + f'SELECT i AS "row", j AS col, {_e} AS v FROM m', "v", "row col")
q("expm1", lambda n: M.expm1(_norm(n)), W + 'SELECT i AS "row", j AS col, v * 1000 / sum(v) OVER (PARTITION BY i) AS v FROM m', "v", "row col", 9)
q("standardize", lambda n: M.standardize(n.m, _stats(n), 3.0), W + f'SELECT i AS "row", m.j AS col, greatest(-3, least(3, (v - mean) / (CASE WHEN ss > 0 THEN sqrt(ss / (n - 1)) ELSE 1 END))) AS v FROM m JOIN ({MOM}) s ON s.j = m.j', "v", "row col")
q("softmax", lambda n: M.softmax(n.m, 10.0), W + 'SELECT i AS "row", j AS col, e / sum(e) OVER (PARTITION BY i) AS v FROM (SELECT i, j, exp((v - max(v) OVER (PARTITION BY i)) / 10) AS e FROM m)', "v", "row col")
q("softmax_cold", lambda n: M.softmax(n.m, 0.0), W + 'SELECT i AS "row", j AS col, e / sum(e) OVER (PARTITION BY i) AS v FROM (SELECT i, j, CASE WHEN v = max(v) OVER (PARTITION BY i) THEN 1.0 ELSE 0.0 END AS e FROM m)', "v", "row col")
q("log_softmax", lambda n: M.log_softmax(n.m, 10.0), W + 'SELECT i AS "row", j AS col, d - ln(sum(exp(d)) OVER (PARTITION BY i)) AS v FROM (SELECT i, j, (v - max(v) OVER (PARTITION BY i)) / 10 AS d FROM m)', "v", "row col")
q("basic_qc", lambda n: M.basic_qc(n.m), W + 'SELECT i AS "row", count(v) AS n_genes, coalesce(sum(v), 0) AS total_counts FROM ri LEFT JOIN m USING (i) GROUP BY i', "total_counts", "row n_genes")
QC = W + 'SELECT i AS "row", count(v) AS n_genes, coalesce(sum(v), 0) AS total_counts, CASE WHEN sum(v) > 0 THEN 100 * sum(CASE WHEN j % 10 = 0 THEN v ELSE 0 END) / sum(v) ELSE 0 END AS pct FROM ri LEFT JOIN m USING (i) GROUP BY i'
q("fused_qc", lambda n: M.fused_qc(n.m, _sub(n)), QC, "total_counts pct", "row n_genes")
q("subset_pct", lambda n: M.subset_pct(n.m, _sub(n)), f'SELECT "row", pct FROM ({QC})', "pct", "row")
q("qc_filter", lambda n: M.qc_filter(n.m, _sub(n), 5, 60, 100, 2000, 0.2), f'SELECT "row", n_genes BETWEEN 5 AND 60 AND total_counts BETWEEN 100 AND 2000 AND pct <= 20 AS keep FROM ({QC})', "", "row")
q("vstack", lambda n: M.vstack(n.m, n.m2), with_("m m2 ri") + 'SELECT i AS "row", j AS col, v FROM m UNION ALL SELECT i + (SELECT max(i) + 1 FROM ri), j, v FROM m2', "v", "row col")
q("hstack", lambda n: M.hstack(n.m, n.m2), with_("m m2 cj") + 'SELECT i AS "row", j AS col, v FROM m UNION ALL SELECT i, j + (SELECT max(j) + 1 FROM cj), v FROM m2', "v", "row col")
q("slice_primary", lambda n: M.slice_rows(n.m, n.m.rows.where("row % 50 = 3").select("row", (F.col("row") * 2).alias("pos"))), W + 'SELECT i * 2 AS "row", j AS col, v FROM m WHERE i % 50 = 3', "v", "row col")
q("row_range", lambda n: M.row_range(n.m, 10, 60), W + 'SELECT i AS "row", j AS col, v FROM m WHERE i >= 10 AND i < 60', "v", "row col")
q("filter_secondary", lambda n: M.filter_cols(n.m, _sub(n)), W + 'SELECT i AS "row", dense_rank() OVER (ORDER BY j) - 1 AS col, v FROM m WHERE j % 10 = 0', "v", "row col")
q("inspect_slice", lambda n: M.kept_entries(n.m, n.m.rows.where("row % 50 = 3"), _sub(n)), W + "SELECT count(*) AS n FROM m WHERE i % 50 = 3 AND j % 10 = 0", "", "n")
q("align_secondary", lambda n: M.align_cols(n.m, n.m.cols.select("col", (F.col("col") * 3 - 30).alias("new")), 100), W + 'SELECT i AS "row", j * 3 - 30 AS col, v FROM m WHERE j * 3 - 30 >= 0 AND j * 3 - 30 < 100', "v", "row col")
q("primary_nnz", lambda n: M.row_lengths(n.m), W + 'SELECT i AS "row", count(v) AS length FROM ri LEFT JOIN m USING (i) GROUP BY i', "", "row length")
q("inverse_permutation", lambda n: M.inverse_permutation(n.places), "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, row_number() OVER (ORDER BY c_custkey) - 1 AS inv FROM customer", "", "i inv")
q("eliminate_zeros", lambda n: M.eliminate_zeros(M.scale_rows(n.m, _s(n))), W + 'SELECT i AS "row", j AS col, v * (i % 4) AS v FROM m WHERE i % 4 <> 0 AND v <> 0', "v", "row col")
q("prune", lambda n: M.prune(n.m, 30.0), W + 'SELECT i AS "row", j AS col, v FROM m WHERE abs(v) > 30', "v", "row col")
q("prune_keep", lambda n: M.prune(n.m, 30.0, True), W + 'SELECT i AS "row", j AS col, CASE WHEN abs(v) < 30 THEN 0 ELSE v END AS v FROM m', "v", "row col")
q("validate", lambda n: M.validate(n.m), "SELECT 0 AS n_duplicates, 0 AS n_out_of_domain, 0 AS n_null, true AS valid", "", "n_duplicates n_out_of_domain n_null")
q("density", lambda n: M.density(n.m), with_("m ri cj") + "SELECT count(*) AS nnz, count(*) / (max(nr.n) * max(nc.n)) AS density, 1 - count(*) / (max(nr.n) * max(nc.n)) AS sparsity FROM m, nr, nc", "density sparsity", "nnz", 9)
q("csr_round_trip", lambda n: M.from_csr(M.to_csr(n.m)), W + 'SELECT i AS "row", j AS col, v FROM m', "v", "row col")
q("indptr", lambda n: M.indptr(n.ev), with_("ev") + 'SELECT i AS "row", coalesce(sum(c) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT i, count(*) AS c FROM m GROUP BY i)', "", "row start")
q("dense_round_trip", lambda n: M.from_dense(M.to_dense(n.ev)), with_("ev") + 'SELECT i AS "row", j AS col, v FROM m WHERE v <> 0', "v", "row col")
q("identity", lambda n: M.identity(n.spark, n.m.n_cols), 'SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS "row", row_number() OVER (ORDER BY s_suppkey) - 1 AS col, 1.0 AS v FROM supplier', "v", "row col")
q("at", lambda n: M.at(n.ev, 5, 2), with_("ev") + "SELECT coalesce(max(v), 0) AS v FROM m WHERE i = 5 AND j = 2", "v")
PR = "SELECT a.j AS {a}, b.j AS other, CASE WHEN a.ss > 1e-9 AND b.ss > 1e-9 THEN (coalesce(xy, 0) / a.n - a.mean * b.mean) / sqrt(a.ss / a.n * b.ss / b.n) ELSE 0 END AS r FROM ({mom}) a JOIN ({mom}) b ON a.j < b.j LEFT JOIN (SELECT p.j AS pj, q.j AS qj, sum(p.v * q.v) AS xy FROM m p JOIN m q ON p.i = q.i AND p.j < q.j GROUP BY 1, 2) ON pj = a.j AND qj = b.j"
q("pearson", lambda n: M.pearson(n.m.T).withColumnRenamed("row", "a"), W + PR.format(a="a", mom=MOM), "r", "a other")
q("pearson_stats", lambda n: M.pearson_stats(n.m.T).withColumnRenamed("row", "a"), W + f"SELECT j AS a, mean, CASE WHEN ss > 1e-9 THEN 1 / sqrt(ss / n) ELSE 0 END AS inv_std FROM ({MOM})", "mean inv_std", "a")
q("pearson_with", lambda n: M.pearson_with(n.m, _y(n)), W + "SELECT j AS col, coalesce(corr(coalesce(v, 0), i % 7), 0) AS r FROM (SELECT ri.i, cj.j, v FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j) GROUP BY j", "r", "col")
