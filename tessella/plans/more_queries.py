"""Queries of alignment, doublets, projections, spectra, fates and the smaller helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special as X
from ..model import Graph
from ..operators import communities as C
from ..operators import doublets as D
from ..operators import graphs as G
from ..operators import information as I
from ..operators import matrix as M
from ..operators import neighbors as K
from ..operators import optimise as O
from ..operators import partitions as P
from ..operators import randomized as R
from ..operators import signatures as A
from ..operators import spatial as S
from ..operators import spectral as E
from ..operators import stats as T
from ..operators import subclusters as B
from ..operators import velocity as V
from .base import q
from .inputs import CTE, erfc_sql, sf_sql, two_sided_sql, with_
from .stats_queries import CD, FC, MW, TT, TWO

NB, EG, XP = with_("nb"), with_("nb e"), with_("nb xp")
# --- alignment and neighbours ------------------------------------------------
_anchor = lambda n: n.nbrs.where("row % 2 = 0 and nbr % 2 = 1").select(F.col("row").alias("cell1"), F.col("nbr").alias("cell2"))
CV = XP + ", pr AS (SELECT i AS c1, k AS c2 FROM nb WHERE i % 2 = 0 AND k % 2 = 1), cv AS (SELECT c2, j, sum(v) AS s FROM (SELECT c2, j, v FROM pr JOIN xp ON xp.i = c1 UNION ALL SELECT c2, j, -v FROM pr JOIN xp ON xp.i = c2) GROUP BY 1, 2) "
q("compute_correction_vectors", lambda n: K.correction_vectors(n.expr, n.expr, _anchor(n)), CV + "SELECT cv.c2 AS cell2, j AS col, s / c AS v FROM cv JOIN (SELECT c2, count(*) AS c FROM pr GROUP BY 1) z ON z.c2 = cv.c2", "v", "cell2 col")
q("smooth_correction_vectors", lambda n: K.smooth_vectors(n.nbrs, n.expr.entries.select("row", "col", "v"), 1.5), XP + ', w AS (SELECT i, k, exp(-dist * dist / 4.5) AS w FROM nb UNION ALL SELECT DISTINCT i, i, 1.0 FROM xp) SELECT w.i AS "row", j AS col, sum(w * v) / max(t) AS v FROM w JOIN (SELECT i, sum(w) AS t FROM w GROUP BY 1) z ON z.i = w.i JOIN xp ON xp.i = w.k GROUP BY 1, 2', "v", "row col")
q("multimodal_neighbors", lambda n: K.multimodal_neighbors(n.nbrs, n.nbrs.select("row", "nbr", (F.col("dist") * F.col("dist")).alias("dist")), 0.3, 0.7, 3).select("row", "nbr", "dist"), NB + 'SELECT i AS "row", k AS nbr, 0.3 * dist + 0.7 * dist * dist AS dist FROM nb QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, k) <= 3', "dist", "row nbr")
q("reference_mapping", lambda n: K.weighted_vote(n.nbrs.select(F.col("row").alias("id"), (F.col("nbr") % 3).alias("label"), (1 / (1 + F.col("dist"))).alias("w"))), NB + ", v AS (SELECT i AS id, k % 3 AS label, sum(1 / (1 + dist)) AS w FROM nb GROUP BY 1, 2) SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1", "confidence", "id label")
q("build_batch_groups", lambda n: n.vectors.groupBy((F.col("id") % 3).alias("grp")).agg(F.count(F.lit(1)).alias("n")), "SELECT vec_id % 3 AS grp, count(*) AS n FROM embeddings GROUP BY 1", "", "grp n")
q("cca_projection", lambda n: R.project(n.m, 8, "gaussian").select(F.lit(1).alias("part"), "row", "k", "y").unionByName(R.project(n.m2, 8, "gaussian").select(F.lit(2).alias("part"), "row", "k", "y")))
FILL = XP + ", f AS (SELECT nb.i, j, sum({w} * v) / sum({w}) AS f FROM nb JOIN xp ON xp.i = nb.k GROUP BY 1, 2) SELECT coalesce(xp.i, f.i) AS \"row\", coalesce(xp.j, f.j) AS col, coalesce(v, f) AS v FROM xp FULL JOIN f ON xp.i = f.i AND xp.j = f.j"
q("knn_impute_dense", lambda n: K.knn_impute(n.expr, n.nbrs, 2.0), FILL.format(w="exp(-power(dist / 2, 2))"), "v", "row col")
q("knn_impute_weighted_dense", lambda n: K.knn_impute_weighted(n.expr, n.nbrs.select("row", "nbr", (1 / (1 + F.col("dist"))).alias("w"))), FILL.format(w="(1 / (1 + dist))"), "v", "row col")
q("diffuse_matrix", lambda n: K.diffuse(n.expr, n.nbrs.select("row", "nbr", F.lit(0.2).alias("w")), 1), XP + 'SELECT nb.i AS "row", j AS col, sum(0.2 * v) AS v FROM nb JOIN xp ON xp.i = nb.k GROUP BY 1, 2', "v", "row col")
q("compute_kernel_matrix", lambda n: K.kernel_matrix(n.nbrs, 2.0), NB + 'SELECT i AS "row", nb.k AS nbr, exp(-power(dist / 2, 2) / 2) AS k FROM nb', "k", "row nbr")
# --- doublets and outliers ---------------------------------------------------
q("expected_doublets", lambda n: n.vectors.agg(F.round(F.count(F.lit(1)) * 0.06).cast("long").alias("n")), "SELECT CAST(round(count(*) * 0.06) AS BIGINT) AS n FROM embeddings")
q("estimate_doublet_rate", lambda n: n.vectors.agg((2 * (F.count(F.lit(1)) / 10000) * 0.05).alias("rate")), "SELECT 2 * (count(*) / 10000) * 0.05 AS rate FROM embeddings", "rate")
q("multiplet_rate_10x", lambda n: n.vectors.agg((0.008 * F.count(F.lit(1)) / 1000).alias("rate")), "SELECT 0.008 * count(*) / 1000 AS rate FROM embeddings", "rate")
_score = lambda n: n.p.select("id", F.col("p").alias("score"))
_called = lambda n: _score(n).crossJoin(F.broadcast(K.estimate_threshold(_score(n), 0.06))).select("id", (F.col("score") > F.col("threshold")).alias("doublet"))
TH = with_("p") + ", th AS (SELECT p AS threshold FROM (SELECT p, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS n FROM p) WHERE r = floor(0.94 * (n - 1)) + 1) "
q("detect_doublets", _called, TH + "SELECT id, p > threshold AS doublet FROM p, th", "", "id")
q("get_singlet_indices", lambda n: _called(n).where("not doublet").select("id"), TH + "SELECT id FROM p, th WHERE p <= threshold", "", "id")
DRAW = "(CAST('0x' || substr(md5(d || '|{s}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
#: Dense rows x of a table by place r, drawn pairs of them, and shares of drawn rows among the k nearest.
SIM = ", rr AS (SELECT id, x, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM {t}), dd AS (SELECT unnest(range(0, {n})) AS d), pq AS (SELECT d, CAST(floor(" + DRAW.format(s=1) + " * (SELECT max(n) FROM rr)) AS BIGINT) AS p, CAST(floor(" + DRAW.format(s=2) + " * ((SELECT max(n) FROM rr) - 1)) AS BIGINT) AS q FROM dd), sm AS (SELECT -d - 1 AS id, list_transform(range(1, 65), lambda t: (a.x[t] + b.x[t]) / 2) AS x FROM pq JOIN rr a ON a.r = p JOIN rr b ON b.r = q + CAST(q >= p AS BIGINT))"
DSC = SIM + ", al AS (SELECT id, x, 0 AS s, id AS o FROM rr UNION ALL SELECT id, x, 1, -id FROM sm), ds AS (SELECT a.id AS i, b.s, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.s, b.o) AS r FROM rr a JOIN al b ON a.id <> b.id) SELECT i AS \"row\", sum(s) / {k} AS score FROM ds WHERE r <= {k} GROUP BY 1"
PV = "WITH pv AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: greatest(v, 0)) AS x FROM embeddings), vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
NV = "(SELECT count(*) FROM embeddings)"
q("simulate_doublets", lambda n: D.simulate_doublets(n.expr, 50), PV + SIM.format(t="pv", n=50) + ' SELECT id AS "row", c - 1 AS col, x[c] AS v FROM (SELECT id, x, unnest(range(1, 65)) AS c FROM sm) WHERE x[c] > 0', "v", "row col")
q("knn_doublet_scores", lambda n: D.knn_doublet_scores(n.expr, D.simulate_doublets(n.expr, n.expr.n_rows, 0), 8), PV + DSC.format(t="pv", n=NV, k=8), "score", "row")
q("scrublet_scores", lambda n: D.scrublet_scores(n.expr), PV + DSC.format(t="pv", n=f"2 * {NV}", k=30), "score", "row")
q("compute_knn_doublet_scores_pca", lambda n: D.vector_doublet_scores(n.vectors, D.simulate_vectors(n.vectors, n.vectors.count()), 8), PV + DSC.format(t="vec", n=NV, k=8), "score", "row")
q("doubletfinder_pann", lambda n: D.pann_scores(n.vectors, D.simulate_vectors(n.vectors, n.vectors.count()), 0.01), PV + DSC.format(t="vec", n=NV, k=f"greatest(1, ceil(0.01 * 2 * {NV}))"), "score", "row")
_hot = lambda n: D.scrublet_scores(n.expr).select(F.col("row").alias("id"), (F.col("score") > 0.7).alias("doublet"))
q("classify_doublet_types_knn", lambda n: K.doublet_types(n.nbrs, n.vectors.select("id", (F.col("id") % 3).alias("label")), _hot(n)), "WITH " + CTE["nb"] + ", sc AS (" + PV + DSC.format(t="pv", n=f"2 * {NV}", k=30) + "), c AS (SELECT i, k % 3 AS b, count(*) AS c FROM nb GROUP BY 1, 2), s AS (SELECT i, c / sum(c) OVER (PARTITION BY i) AS s, row_number() OVER (PARTITION BY i ORDER BY c DESC, b) AS r FROM c) SELECT sc.\"row\" AS id, CASE WHEN score <= 0.7 THEN 0 WHEN coalesce(s, 0) > 0.2 THEN 1 ELSE 2 END AS type FROM sc LEFT JOIN s ON s.i = sc.\"row\" AND r = 2", "", "id type")
q("doublet_score_neighbours", lambda n: K.neighbor_zscore(n.expr, n.nbrs))
q("mitochondrial_outliers", lambda n: M.subset_outliers(n.m, n.m.cols.where("col % 5 = 0"), 0.2), with_("m ri") + ', t AS (SELECT ri.i, coalesce(sum(CASE WHEN j % 5 = 0 THEN v END) / nullif(sum(v), 0), 0) AS f FROM ri LEFT JOIN m ON m.i = ri.i GROUP BY 1) SELECT i AS "row", f AS fraction, f > 0.2 AS outlier FROM t', "fraction", "row")
# --- statistics --------------------------------------------------------------
q("count_groups", lambda n: n.two.agg(F.sum((F.col("grp") == 0).cast("long")).alias("n1"), F.sum((F.col("grp") == 1).cast("long")).alias("n2")), with_("two") + "SELECT CAST(sum(CASE WHEN grp = 0 THEN 1 END) AS BIGINT) AS n1, CAST(sum(CASE WHEN grp = 1 THEN 1 END) AS BIGINT) AS n2 FROM g")
q("count_k_groups", lambda n: T.group_sizes(n.groups), "WITH " + CTE["g"] + " SELECT grp, count(*) AS n FROM g GROUP BY 1", "", "grp n")
q("partition_two_groups", lambda n: n.m.entries.join(n.two, "row").groupBy("col").agg(*(f for k in (0, 1) for f in (F.sum((F.col("grp") == k).cast("long")).alias(f"n{k}"), F.sum(F.when(F.col("grp") == k, F.col("v")).otherwise(0.0)).alias(f"sum{k}")))), with_("m two") + "SELECT j AS col, count(CASE WHEN grp = 0 THEN 1 END) AS n0, sum(CASE WHEN grp = 0 THEN v ELSE 0 END) AS sum0, count(CASE WHEN grp = 1 THEN 1 END) AS n1, sum(CASE WHEN grp = 1 THEN v ELSE 0 END) AS sum1 FROM m JOIN g USING (i) GROUP BY 1", "sum0 sum1", "col n0 n1")
q("auroc_with_fc", lambda n: T.mwu(n.m, n.two).select("col", "auroc", "log2_fc", "p"), MW + f"SELECT j AS col, u / (n0 * n1) AS auroc, {FC} AS log2_fc, {two_sided_sql('(greatest(abs(u - n0 * n1 / 2) - 0.5, 0) / s)')} AS p FROM mz", "auroc log2_fc p", "col")
q("ttest_with_effect_size", lambda n: T.ttest(n.m, n.two, True, "hedges_g"), TWO + f"SELECT j AS col, {TT} AS t, {FC} AS log2_fc, {CD} * (1 - 3 / (4 * (n0 + n1 - 2) - 1)) AS effect, {two_sided_sql(TT)} AS p FROM tg", "t log2_fc effect p", "col")
q("unary_exp_sum", lambda n: n.m.entries.groupBy("col").agg(F.sum(F.exp(-0.01 * F.col("v") * F.col("v"))).alias("s")), with_("m") + "SELECT j AS col, sum(exp(-0.01 * v * v)) AS s FROM m GROUP BY 1", "s", "col")
q("compute_log2_fc", lambda n: n.table("part").select(F.col("p_partkey").alias("id"), X.log2_fold_change(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("lfc")), "SELECT p_partkey AS id, log2((p_retailprice + 1e-9) / (p_size + 1e-9)) AS lfc FROM part", "lfc", "id")
_z = lambda n: n.values.select("id", (F.col("value") * 4).alias("z"))
ZV = with_("val") + ", z AS (SELECT id, value * 4 AS z FROM val) "
for _n, _f, _s in (
    ("erfc", X.erfc, erfc_sql("z")), ("erf", X.erf, f"1 - {erfc_sql('z')}"), ("normal_cdf", X.normal_cdf, sf_sql("(-z)")), ("normal_sf", X.normal_sf, sf_sql("z")), ("normal_pdf", X.normal_pdf, "exp(-z * z / 2) / sqrt(2 * pi())"),
    ("normal_logcdf", X.normal_logcdf, f"ln(greatest({sf_sql('(-z)')}, 1e-300))"), ("normal_logsf", X.normal_logsf, f"ln(greatest({sf_sql('z')}, 1e-300))"),
):
    q(_n, lambda n, f=_f: _z(n).select("id", f(F.col("z")).alias("y")), ZV + f"SELECT id, {_s} AS y FROM z", "y", "id")
q("expression_entropy", lambda n: I.specificity_entropy(A.group_means(n.m, n.groups)), with_("m cj g") + ", gs AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1), gm AS (SELECT cj.j, gs.grp, coalesce(sum(v), 0) / max(n) AS mean FROM cj CROSS JOIN gs LEFT JOIN (SELECT m.j AS jj, g.grp AS gg, v FROM m JOIN g USING (i)) x ON jj = j AND gg = grp GROUP BY 1, 2), p AS (SELECT j, mean / nullif(sum(mean) OVER (PARTITION BY j), 0) AS p FROM gm) SELECT j AS col, coalesce(-sum(CASE WHEN p > 0 THEN p * ln(p) END), 0) / ln(count(*)) AS h FROM p GROUP BY 1", "h", "col")
q("compute_filtered_nnz", lambda n: n.m.entries.join(n.m.cols.where("col % 2 = 0"), "col", "left_semi").agg(F.count(F.lit(1)).alias("nnz")), with_("m") + "SELECT count(*) AS nnz FROM m WHERE j % 2 = 0")
# --- projections -------------------------------------------------------------
_r = lambda n, keep: n.m.cols.crossJoin(n.spark.range(4).select(F.col("id").alias("k"))).where(keep).select("col", "k", (F.sin(F.col("col") + 1.0) * (F.col("k") + 1)).alias("r"))
for _n, _w in (("project_with_dense_matrix", "true"), ("project_with_sparse_matrix", "(col + k) % 3 = 0")):
    q(_n, lambda n, w=_w: R.project_with(n.m, _r(n, w)), with_("m") + f"SELECT i AS \"row\", k, sum(v * sin(j + 1.0) * (k + 1)) AS y FROM m CROSS JOIN (SELECT unnest(range(0, 4)) AS k) WHERE {_w.replace('col', 'j')} GROUP BY 1, 2", "y", "row k")
q("project_auto", lambda n: R.project_auto(n.m, 16))
_counted = lambda n: [n.table(t).count() for t in ("customer", "supplier", "part", "orders")]
TN = " FROM (SELECT count(*) AS n FROM customer UNION ALL SELECT count(*) FROM supplier UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) FROM orders)"
q("compute_jl_dimension", lambda n: n.spark.createDataFrame([(x, R.jl_dimension(x, 0.2)) for x in _counted(n)], "n long, k long"), "SELECT n, CAST(ceil(4 * ln(CAST(n AS DOUBLE)) / (0.2 * 0.2 / 2 - power(0.2, 3) / 3)) AS BIGINT) AS k" + TN)
q("recommend_projection", lambda n: n.spark.createDataFrame([(x, k, R.recommend_projection(x, k)) for x in _counted(n) for k in (16, 100, 600)], "n long, k long, kind string"), "SELECT n, CAST(k AS BIGINT) AS k, CASE WHEN k <= 64 THEN 'countsketch' WHEN n > 100000 OR k < 512 THEN 'sparse' ELSE 'achlioptas' END AS kind FROM (SELECT n" + TN + ") CROSS JOIN (VALUES (16), (100), (600)) t(k)")
q("downsample_variable", lambda n: R.downsample(n.m, n.m.rows.select("row", (F.col("row") % 5 * 40.0 + 50).alias("target"))))
# --- spectra -----------------------------------------------------------------
_walk = lambda n: Graph(G.row_stochastic(n.graph), n.graph.nodes)
q("compute_top_eigenvectors", lambda n: E.top_eigenvectors(n.graph, 3, 6))
q("diffusion_map_embedding", lambda n: E.diffusion_map(_walk(n), 3, 6))
q("diffusion_pseudotime", lambda n: E.diffusion_pseudotime(_walk(n), 0, 3, 6))
q("metastable_states", lambda n: E.metastable_states(_walk(n), 3, 6))
q("nystrom_approximation", lambda n: E.nystrom(Graph(K.kernel_matrix(n.nbrs, 1.5).select(F.col("row").alias("src"), F.col("nbr").alias("dst"), F.col("k").alias("w")), n.graph.nodes), 3, 6))
q("alra_impute", lambda n: E.low_rank_impute(n.ev, 2, 6))
# --- graphs, fates, velocity -------------------------------------------------
q("transition_matrix_from_velocity", lambda n: G.row_stochastic(Graph(n.graph.edges.select("src", "dst", (F.col("w") - 0.2).alias("w")), n.graph.nodes), positive=True), EG + ", p AS (SELECT src, dst, w - 0.2 AS w FROM e WHERE w > 0.2) SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM p UNION ALL SELECT id, id, 1.0 FROM nd WHERE id NOT IN (SELECT src FROM p)", "w", "src dst")
q("time_to_absorption", lambda n: G.time_to_absorption(n.graph, [0, 1, 2], max_iter=24))
q("compute_dpt_multi_root", lambda n: G.dpt_multi_root(_walk(n), [0, 1], 8))
q("cluster_multilevel", lambda n: C.leiden(n.graph))
q("cell_fate_probability", lambda n: P.fate_probability(n.clones), with_("clo") + "SELECT clone, cluster AS type, count(*) / sum(count(*)) OVER (PARTITION BY clone) AS p FROM clo WHERE clone >= 0 GROUP BY 1, 2", "p", "clone type")
q("lineage_coupling", lambda n: P.shares(n.clones.where("clone >= 0"), "type", "clone"), with_("clo") + "SELECT clone, cluster AS type, count(*) / sum(count(*)) OVER (PARTITION BY clone) AS share FROM clo WHERE clone >= 0 GROUP BY 1, 2", "share", "clone type")
_y = lambda n: n.m.rows.select("row", (F.col("row") % 13).cast("double").alias("y"))
CY = with_("m ri cj") + "SELECT cj.j AS col, coalesce(corr(coalesce(v, 0), CAST(ri.i % 13 AS DOUBLE)), 0) AS r FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j GROUP BY 1"
q("lineage_drivers", lambda n: V.lineage_drivers(n.m, _y(n)), CY, "r", "col")
q("pseudotime_correlation", lambda n: M.pearson_with(n.m, _y(n)).select("col", "r"), CY, "r", "col")
q("velocity_stream", lambda n: V.velocity_stream(n.points, n.values.select("id", F.col("value").alias("vx"), (-F.col("value")).alias("vy")), 0, 4, 0.5))
# --- spatial -----------------------------------------------------------------
q("count_patterns", lambda n: S.count_kinds(S.lisa_patterns(n.graph, n.values, n.vectors.select("id", ((F.col("id") % 10) / 50).alias("p"))), "pattern"), with_("nb e val") + ", c AS (SELECT id, value - avg(value) OVER () AS z FROM val), l AS (SELECT src, max(a.z) AS zi, sum(w * b.z) AS lag FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst GROUP BY 1) SELECT CASE WHEN src % 10 / 50 >= 0.05 THEN 0 WHEN zi > 0 AND lag > 0 THEN 1 WHEN zi <= 0 AND lag <= 0 THEN 2 WHEN zi > 0 THEN 3 ELSE 4 END AS pattern, count(*) AS n FROM l GROUP BY 1", "", "pattern n")
q("multivariate_local_morans_i", lambda n: S.local_morans_by_column(n.graph, n.long_vectors), with_("nb e lv") + ", c AS (SELECT id, dim, x - avg(x) OVER (PARTITION BY dim) AS z, var_pop(x) OVER (PARTITION BY dim) AS m2 FROM lv) SELECT src AS id, a.dim AS dim, max(a.z) * sum(w * b.z) / max(a.m2) AS i FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst AND b.dim = a.dim GROUP BY 1, 2", "i", "id dim", digits=5)
q("colocalization_score", lambda n: S.colocalization(n.graph, n.vectors.select("id", (F.col("id") % 4).alias("type"))).where("a = 0 and b = 1").select("score"), EG + ", f AS (SELECT id % 4 AS t, count(*) / (SELECT count(*) FROM nd) AS f FROM nd GROUP BY 1) SELECT log2((SELECT count(*) FROM e WHERE src % 4 = 0 AND dst % 4 = 1) / ((SELECT f FROM f WHERE t = 0) * (SELECT f FROM f WHERE t = 1) * (SELECT count(*) FROM e))) AS score", "score")
GKS = with_("pts xp") + ", w AS (SELECT a.id AS s, b.id AS t, exp(-(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 0.02) AS w FROM pts a JOIN pts b ON a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.16), c AS (SELECT pts.id, dj.j, coalesce(v, 0) - avg(coalesce(v, 0)) OVER (PARTITION BY dj.j) AS z FROM pts CROSS JOIN (SELECT unnest(range(0, 64)) AS j) dj LEFT JOIN xp ON xp.i = pts.id AND xp.j = dj.j), ss AS (SELECT j, sum(z * z) AS ss FROM c GROUP BY 1) SELECT a.j AS col, max(n) * sum(w * a.z * b.z) / (sum(w) * max(ss)) AS i, (max(n) - 1) * sum(w * power(a.z - b.z, 2)) / (2 * sum(w) * max(ss)) AS c FROM w JOIN c a ON a.id = s JOIN c b ON b.id = t AND b.j = a.j JOIN ss ON ss.j = a.j, nx GROUP BY 1"
q("spatial_autocorrelation", lambda n: S.spatial_autocorrelation(n.points, n.expr, 0.1), GKS, "i c", "col", digits=5)
q("spatial_variability", lambda n: S.spatial_autocorrelation(n.points, n.expr, 0.1).select("col", "i"), f"SELECT col, i FROM ({GKS})", "i", "col", digits=5)
q("tissue_module", lambda n: C.spatial_domains(n.points, S.most_variable(n.long_vectors, 20), 3))
q("find_optimal_subclusters", lambda n: B.find_optimal_subclusters(n.vectors.select("id", "x"), 6))
q("subclustering", lambda n: C.subcluster(n.long_vectors, n.vectors.select("id", "label"), 1, 2))
# --- regression --------------------------------------------------------------
_rhs = lambda n: n.ev.rows.select("row", (F.col("row") % 7).cast("double").alias("y"))
q("lasso_coordinate_descent", lambda n: O.lasso(n.ev, _rhs(n), 0.5, max_iter=20))
q("elastic_net_coordinate_descent", lambda n: O.elastic_net(n.ev, _rhs(n), 0.5, 0.5, max_iter=20))
q("proximal_gradient", lambda n: O.proximal_gradient(n.ev, _rhs(n), 0.5, "mcp", max_iter=20))
q("lasso_path", lambda n: O.lasso_path(n.ev, _rhs(n), [1.0, 0.1], max_iter=10))
