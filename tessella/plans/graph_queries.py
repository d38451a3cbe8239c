"""Queries of neighbours, kernels, graphs, spatial statistics and velocity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Graph, Matrix
from ..operators import communities as C
from ..operators import graphs as G
from ..operators import linkage as L
from ..operators import neighbors as K
from ..operators import optimise as O
from ..operators import randomized as R
from ..operators import spatial as S
from ..operators import traversal as T
from ..operators import velocity as V
from .base import q
from .inputs import DIMS, two_sided_sql, with_

NB = with_("nb")
E = with_("nb e")
EV = with_("nb e val")
ET = with_("nb e ty")

# --- neighbours and kernels --------------------------------------------------
_batches = lambda n: n.vectors.select("id", (F.col("id") % 3).alias("label"))
SQ = "WITH pv AS (SELECT vec_id AS i, list_transform(CAST(embedding AS DOUBLE[]), lambda v: greatest(v, 0)) AS x FROM embeddings), d2 AS (SELECT a.i AS i, b.i AS k, list_distance(a.x, b.x) AS dist FROM pv a JOIN pv b ON a.i <> b.i) "
q("knn", lambda n: K.knn(n.expr, 5), SQ + 'SELECT i AS "row", k AS nbr, dist, row_number() OVER (PARTITION BY i ORDER BY dist, k) AS rank FROM d2 QUALIFY rank <= 5', "dist", "row nbr rank")
for _m, _d in (("manhattan", "list_sum(list_transform(range(1, 65), lambda t: abs(a.x[t] - b.x[t])))"), ("cosine", "round(1 - list_cosine_similarity(a.x, b.x), 12)"), ("correlation", "round(1 - list_cosine_similarity(list_transform(a.x, lambda t: t - list_avg(a.x)), list_transform(b.x, lambda t: t - list_avg(b.x))), 12)")):
    q(f"knn_{_m}", lambda n, m=_m: K.knn(n.expr, 5, m), SQ.replace("list_distance(a.x, b.x)", _d) + 'SELECT i AS "row", k AS nbr, dist, row_number() OVER (PARTITION BY i ORDER BY dist, k) AS rank FROM d2 QUALIFY rank <= 5', "dist", "row nbr rank")
q("bbknn", lambda n: K.bbknn(n.expr, n.vectors.select(F.col("id").alias("row"), (F.col("id") % 3).alias("grp")), 2), SQ + 'SELECT i AS "row", k AS nbr, dist, row_number() OVER (PARTITION BY i, k % 3 ORDER BY dist, k) AS rank, k % 3 AS grp FROM d2 QUALIFY rank <= 2', "dist", "row nbr rank grp")
q("dense_knn", lambda n: K.dense_knn(n.vectors, 5).select("row", "nbr", "dist"), NB + 'SELECT i AS "row", k AS nbr, dist FROM nb', "dist", "row nbr")
_half = lambda n, k: Matrix(n.expr.entries.where(F.col("row") % 2 == k), n.expr.rows.where(F.col("row") % 2 == k), n.expr.cols)
X12 = SQ + ", ab AS (SELECT i, k, row_number() OVER (PARTITION BY i ORDER BY dist, k) AS r FROM d2 WHERE i % 2 = 0 AND k % 2 = 1), ba AS (SELECT i, k, row_number() OVER (PARTITION BY i ORDER BY dist, k) AS r FROM d2 WHERE i % 2 = 1 AND k % 2 = 0), mn AS (SELECT ab.i AS cell1, ab.k AS cell2 FROM ab JOIN ba ON ab.i = ba.k AND ab.k = ba.i WHERE ab.r <= 6 AND ba.r <= 6) "
q("mnn_pairs", lambda n: K.mnn_pairs(_half(n, 0), _half(n, 1), 6), X12 + "SELECT cell1, cell2 FROM mn", "", "cell1 cell2")
q("find_anchors", lambda n: K.find_anchors(_half(n, 0), _half(n, 1), 6, 0.3), X12 + ", s AS (SELECT cell1, count(*) AS s FROM mn GROUP BY 1) SELECT i AS cell1, k AS cell2, s / (12 - s) AS score FROM ab JOIN s ON cell1 = i WHERE r <= 6 AND s / (12 - s) >= 0.3", "score", "cell1 cell2")
q("transfer_labels", lambda n: K.transfer_labels(n.nbrs.where("row % 2 = 0 and nbr % 2 = 1").select(F.col("row").alias("cell1"), F.col("nbr").alias("cell2"), F.lit(1.0).alias("score")), n.vectors.select("id", (F.col("id") % 3).alias("label")), n.vectors.where("id % 2 = 1").select("id")), NB + ", v AS (SELECT k AS id, i % 3 AS label, count(*) AS w FROM nb WHERE i % 2 = 0 AND k % 2 = 1 GROUP BY 1, 2), b AS (SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1) SELECT vec.id AS id, coalesce(b.label, 0) AS label, coalesce(confidence, 0) AS confidence FROM vec LEFT JOIN b ON b.id = vec.id WHERE vec.id % 2 = 1", "confidence", "id label")
q("batch_mixing", lambda n: K.batch_mixing(n.nbrs, _batches(n)), NB + 'SELECT i AS "row", avg(CASE WHEN i % 3 <> k % 3 THEN 1.0 ELSE 0 END) AS mixing FROM nb GROUP BY 1', "mixing", "row")
BE = NB + ", al AS (SELECT i, k FROM nb UNION ALL SELECT id, id FROM vec), c AS (SELECT i, k % 3 AS b, count(*) / sum(count(*)) OVER (PARTITION BY i) AS p FROM al GROUP BY 1, 2), be AS (SELECT i, -sum(p * ln(p)) / ln(3) AS h FROM c GROUP BY 1) "
q("batch_entropy", lambda n: K.batch_entropy(n.nbrs, _batches(n)), BE + 'SELECT i AS "row", h FROM be', "h", "row")
q("integration_score", lambda n: K.integration_score(n.nbrs, _batches(n)), BE + "SELECT avg(h) AS score FROM be", "score")
q("mean_batch_entropy", lambda n: K.batch_entropy(n.nbrs, _batches(n)).agg(F.avg("h").alias("h")), BE + "SELECT avg(h) AS h FROM be", "h")
q("lisi", lambda n: K.lisi(n.nbrs, _batches(n)), NB + ', c AS (SELECT i, k % 3 AS b, count(*) AS c FROM nb GROUP BY 1, 2) SELECT i AS "row", power(sum(c), 2) / sum(c * c) AS lisi FROM c GROUP BY 1', "lisi", "row")
q("kbet_score", lambda n: K.kbet(n.nbrs, _batches(n)), NB + ", s AS (SELECT id % 3 AS b, count(*) / (SELECT count(*) FROM vec) AS p FROM vec GROUP BY 1), g AS (SELECT r.i, s.b, 5 * p AS e, (SELECT count(*) FROM nb WHERE nb.i = r.i AND nb.k % 3 = s.b) AS o FROM (SELECT DISTINCT i FROM nb) r CROSS JOIN s), x AS (SELECT i, sum(power(o - e, 2) / e) AS chi FROM g GROUP BY 1) SELECT 1 - avg(CASE WHEN chi > 2 + 2 * sqrt(4) THEN 1.0 ELSE 0 END) AS score FROM x", "score")
KF = {"gaussian": "exp(-u * u / 2)", "epanechnikov": "CASE WHEN u < 1 THEN 0.75 * (1 - u * u) ELSE 0 END", "cosine": "CASE WHEN u < 1 THEN pi() / 4 * cos(pi() / 2 * u) ELSE 0 END", "laplacian": "exp(-u)", "cauchy": "1 / (1 + u * u)", "uniform": "CASE WHEN u < 1 THEN 0.5 ELSE 0 END", "triangular": "CASE WHEN u < 1 THEN 1 - u ELSE 0 END"}
for _k, _e in KF.items():
    q(f"kernel_{_k}", lambda n, k=_k: K.kernel_matrix(n.nbrs, 1.5, k), NB + f'SELECT i AS "row", k AS nbr, {_e} AS k FROM (SELECT i, k, dist / 1.5 AS u FROM nb)', "k", "row nbr")
GK = NB + ", gk AS (SELECT i, k, dist, exp(-power(dist / 1.5, 2) / 2) AS w FROM nb) "
q("kernel_row_sums", lambda n: K.kernel_row_sums(n.nbrs, 1.5), GK + 'SELECT i AS "row", sum(w) AS total FROM gk GROUP BY 1', "total", "row")
q("kde_from_distances", lambda n: K.kde(n.nbrs, 1.5), GK + 'SELECT i AS "row", (sum(w) + 1) / (count(*) + 1) AS density FROM gk GROUP BY 1', "density", "row")
q("local_bandwidth", lambda n: K.local_bandwidth(n.nbrs, 3), NB + 'SELECT i AS "row", max(dist) AS h FROM (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, k) <= 3) GROUP BY 1', "h", "row")
BW = NB + ", bw AS (SELECT i, max(dist) AS h FROM nb GROUP BY 1), ab AS (SELECT nb.i, k, dist, x.h AS h1, y.h AS h2 FROM nb JOIN bw x ON x.i = nb.i JOIN bw y ON y.i = k) "
q("adaptive_kde", lambda n: K.adaptive_kde(n.nbrs, K.local_bandwidth(n.nbrs)), BW + 'SELECT i AS "row", (sum(exp(-dist * dist / (2 * h1 * h2))) + 1) / (count(*) + 1) AS density FROM ab GROUP BY 1', "density", "row")
q("adaptive_rbf", lambda n: K.adaptive_rbf(n.nbrs, K.local_bandwidth(n.nbrs)), BW + 'SELECT i AS "row", k AS nbr, exp(-dist * dist / (2 * h1 * h2)) AS k FROM ab', "k", "row nbr")
q("rbf_sparse", lambda n: K.rbf(n.nbrs, 1.5), GK + 'SELECT i AS "row", k AS nbr, w AS k FROM gk', "k", "row nbr")
q("silverman_bandwidth", lambda n: K.silverman_bandwidth(n.values.withColumnRenamed("value", "x")), with_("val") + "SELECT 1.06 * stddev_samp(value) * power(count(*), -0.2) AS h FROM val", "h")
q("scott_bandwidth", lambda n: K.scott_bandwidth(n.values.withColumnRenamed("value", "x")), with_("val") + "SELECT stddev_samp(value) * power(count(*), -0.2) AS h FROM val", "h")
_yv = lambda n: n.values.select(F.col("id").alias("row"), F.col("value").alias("y"))
OWN = with_("nb val") + ", gk AS (SELECT i, k, exp(-power(dist / 1.5, 2) / 2) AS w FROM nb UNION ALL SELECT id, id, 1.0 FROM vec) "
q("nadaraya_watson", lambda n: K.nadaraya_watson(n.nbrs, _yv(n), 1.5), OWN + 'SELECT i AS "row", sum(w * value) / sum(w) AS y FROM gk JOIN val ON id = k GROUP BY 1', "y", "row")
q("kernel_smooth_graph", lambda n: K.kernel_smooth(n.nbrs.select("row", "nbr", F.lit(0.5).alias("w")), _yv(n)), with_("nb val") + 'SELECT a.id AS "row", (coalesce(sum(0.5 * b.value), 0) + a.value) / (coalesce(count(b.id) * 0.5, 0) + 1) AS y FROM val a LEFT JOIN nb ON nb.i = a.id LEFT JOIN val b ON b.id = nb.k GROUP BY a.id, a.value', "y", "row")
q("local_linear_regression", lambda n: K.local_linear(n.nbrs, n.points.join(n.values, "id").select(F.col("id").alias("row"), "x", F.col("value").alias("y")), 1.5), with_("nb val pts") + ", gk AS (SELECT i, k, exp(-power(dist / 1.5, 2) / 2) AS w FROM nb UNION ALL SELECT id, id, 1.0 FROM vec), s AS (SELECT i, sum(w) AS s0, sum(w * dx) AS s1, sum(w * dx * dx) AS s2, sum(w * value) AS t0, sum(w * dx * value) AS t1 FROM (SELECT gk.i, w, b.x - a.x AS dx, value FROM gk JOIN pts a ON a.id = gk.i JOIN pts b ON b.id = gk.k JOIN val ON val.id = gk.k) GROUP BY 1) SELECT i AS \"row\", CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS y FROM s", "y", "row")
q("mean_shift_step", lambda n: K.mean_shift_step(n.nbrs, n.long_vectors.withColumnRenamed("id", "row"), 1.5), with_("nb lv") + ', gk AS (SELECT i, k, exp(-power(dist / 1.5, 2) / 2) AS w FROM nb UNION ALL SELECT id, id, 1.0 FROM vec) SELECT i AS "row", dim, sum(w * lv.x) / sum(w) AS x FROM gk JOIN lv ON lv.id = k GROUP BY 1, 2', "x", "row dim")
q("kernel_entropy", lambda n: K.kernel_entropy(n.nbrs, 1.5), OWN + ', p AS (SELECT i, w / sum(w) OVER (PARTITION BY i) AS p FROM gk) SELECT i AS "row", -sum(p * ln(p)) AS h FROM p GROUP BY 1', "h", "row")
q("find_bandwidth_for_perplexity", lambda n: K.bandwidth_for_perplexity(n.nbrs, 3.0))
q("kernel_mmd_from_groups", lambda n: K.kernel_mmd(n.nbrs, n.vectors.select(F.col("id").alias("row"), (F.col("id") % 2).alias("grp")), 1.5), GK + "SELECT sqrt(greatest(0, avg(CASE WHEN i % 2 = 0 AND k % 2 = 0 THEN w END) + avg(CASE WHEN i % 2 = 1 AND k % 2 = 1 THEN w END) - 2 * avg(CASE WHEN i % 2 <> k % 2 THEN w END))) AS mmd FROM gk", "mmd")
# --- imputation, outliers, doublets ------------------------------------------
XW = with_("nb xp")
q("knn_impute", lambda n: K.knn_impute(n.expr, n.nbrs, 1.5), XW + ', f AS (SELECT nb.i, j, sum(exp(-power(dist / 1.5, 2)) * v) / sum(exp(-power(dist / 1.5, 2))) AS f FROM nb JOIN xp ON xp.i = nb.k GROUP BY 1, 2) SELECT coalesce(xp.i, f.i) AS "row", coalesce(xp.j, f.j) AS col, coalesce(v, f) AS v FROM xp FULL JOIN f ON xp.i = f.i AND xp.j = f.j', "v", "row col")
q("smooth_expression", lambda n: K.smooth_expression(n.expr, n.nbrs.select("row", "nbr", F.lit(1.0).alias("w")), 0.3), XW + 'SELECT i AS "row", j AS col, sum(v) AS v FROM (SELECT i, j, 0.7 * v AS v FROM xp UNION ALL SELECT nb.i, j, 0.3 * sum(v) / 5 FROM nb JOIN xp ON xp.i = nb.k GROUP BY 1, 2) GROUP BY 1, 2', "v", "row col")
TR = ", t AS (SELECT i, k, 0.2 AS w FROM nb) "
D2 = XW + TR + ", s1 AS (SELECT t.i, j, sum(w * v) AS v FROM t JOIN xp ON xp.i = t.k GROUP BY 1, 2), s2 AS (SELECT t.i, j, sum(w * v) AS v FROM t JOIN s1 ON s1.i = t.k GROUP BY 1, 2) "
q("diffusion_impute", lambda n: K.diffuse(n.expr, n.nbrs.select("row", "nbr", F.lit(0.2).alias("w")), 2), D2 + 'SELECT i AS "row", j AS col, v FROM s2', "v", "row col")
q("magic_impute", lambda n: K.magic_impute(n.expr, n.nbrs.select("row", "nbr", F.lit(1.0).alias("w")), 2), D2 + 'SELECT i AS "row", j AS col, v FROM s2', "v", "row col")
q("detect_dropouts", lambda n: K.detect_dropouts(n.expr, 0.1), with_("xp") + "SELECT j AS col, (1 - count(*) / max(n)) * (CASE WHEN avg(v) > 0.1 THEN 1 ELSE 0.5 END) AS p FROM xp, nx GROUP BY 1", "p", "col")
q("imputation_quality", lambda n: K.imputation_quality(n.expr.entries, n.expr.entries.select("row", "col", (F.col("v") * F.col("v")).alias("v"))), with_("xp") + "SELECT corr(v, v * v) AS r FROM xp", "r")
q("isolation_score", lambda n: K.isolation_score(n.expr), with_("xp") + ', s AS (SELECT vec_id AS i, coalesce(sum(v), 0) / 64 AS m, coalesce(sum(v * v), 0) / 64 - power(coalesce(sum(v), 0) / 64, 2) AS s FROM embeddings LEFT JOIN xp ON xp.i = vec_id GROUP BY 1) SELECT i AS "row", (abs(m - avg(m) OVER ()) / greatest(stddev_pop(m) OVER (), 1e-10) + abs(s - avg(s) OVER ()) / greatest(avg(s) OVER (), 1e-10)) / 2 AS score FROM s', "score", "row")
q("local_outlier_factor", lambda n: K.local_outlier_factor(n.nbrs), NB + ', kd AS (SELECT i, max(dist) AS kd FROM nb GROUP BY 1), rc AS (SELECT nb.i, k, greatest(dist, kd) AS r FROM nb JOIN kd ON kd.i = k), lr AS (SELECT i, count(*) / greatest(sum(r), 1e-10) AS l FROM rc GROUP BY 1) SELECT rc.i AS "row", avg(b.l) / max(a.l) AS lof FROM rc JOIN lr a ON a.i = rc.i JOIN lr b ON b.i = rc.k GROUP BY 1', "lof", "row")
q("rare_cell_detection", lambda n: K.rarity(n.nbrs), NB + ', m AS (SELECT i, avg(dist) AS m FROM nb GROUP BY 1) SELECT nb.i AS "row", max(a.m) / greatest(avg(b.m), 1e-10) AS rarity FROM nb JOIN m a ON a.i = nb.i JOIN m b ON b.i = nb.k GROUP BY 1', "rarity", "row")
q("ambient_detection", lambda n: K.ambient_score(n.m, 0.1))
q("outlier_genes", lambda n: K.outlier_genes(n.m, 1.0), with_("m cj ri") + ", s AS (SELECT j, sum(v) / max(n) AS m, sum(v * v) / max(n) - power(sum(v) / max(n), 2) AS s FROM m, nr GROUP BY 1), l AS (SELECT j, ln(s / (m * m)) AS l FROM s WHERE m > 1e-10 AND s > 0), md AS (SELECT *, quantile_cont(l, 0.5) OVER () AS med FROM l), mad AS (SELECT j, l, med, quantile_cont(abs(l - med), 0.5) OVER () AS mad FROM md) SELECT j AS col, (l - med) / greatest(1.4826 * mad, 1e-10) AS z FROM mad WHERE (l - med) / greatest(1.4826 * mad, 1e-10) > 1", "z", "col", digits=4)
q("neighbor_zscore", lambda n: K.neighbor_zscore(n.expr, n.nbrs), XW + ', s AS (SELECT nb.i, j, sum(v) / 5 AS m, sum(v * v) / 5 AS q FROM nb JOIN xp ON xp.i = nb.k GROUP BY 1, 2), z AS (SELECT xp.i, CASE WHEN coalesce(q - m * m, 0) > 1e-20 THEN abs(v - coalesce(m, 0)) / sqrt(q - m * m) ELSE 0 END AS z FROM xp LEFT JOIN s ON s.i = xp.i AND s.j = xp.j) SELECT vec_id AS "row", coalesce(avg(z), 0) AS score FROM embeddings LEFT JOIN z ON z.i = vec_id GROUP BY 1', "score", "row", digits=5)
q("empty_drops", lambda n: K.empty_drops(n.m, 0.01, 400, 300))
_sc = lambda n: n.p.select("id", F.col("p").alias("score"))
q("estimate_threshold", lambda n: K.estimate_threshold(_sc(n), 0.06), with_("p") + "SELECT p AS threshold FROM (SELECT p, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS n FROM p) WHERE r = floor(0.94 * (n - 1)) + 1", "threshold")
q("call_doublets", lambda n: K.call_doublets(_sc(n), 0.5), with_("p") + "SELECT id, p > 0.5 AS doublet FROM p", "", "id")
q("detect_bimodal_threshold", lambda n: K.bimodal_threshold(_sc(n)))
q("classify_doublet_types", lambda n: K.doublet_types(n.nbrs, _batches(n), n.vectors.select("id", (F.col("id") % 5 == 0).alias("doublet"))), NB + ", c AS (SELECT i, k % 3 AS b, count(*) AS c FROM nb GROUP BY 1, 2), s AS (SELECT i, c / sum(c) OVER (PARTITION BY i) AS s, row_number() OVER (PARTITION BY i ORDER BY c DESC, b) AS r FROM c) SELECT id, CASE WHEN id % 5 <> 0 THEN 0 WHEN coalesce(s, 0) > 0.2 THEN 1 ELSE 2 END AS type FROM vec LEFT JOIN s ON s.i = id AND r = 2", "", "id type")
q("density_doublet_score", lambda n: K.density_score(n.nbrs), NB + 'SELECT i AS "row", 1 / greatest(avg(dist), 1e-10) AS score FROM nb GROUP BY 1', "score", "row")
q("variance_doublet_score", lambda n: K.variance_score(n.expr), with_("xp") + ', m AS (SELECT j, sum(v) / max(n) AS m FROM xp, nx GROUP BY 1) SELECT vec_id AS "row", coalesce(avg(power(v - m, 2)), 0) AS score FROM embeddings LEFT JOIN xp ON xp.i = vec_id LEFT JOIN m ON m.j = xp.j GROUP BY 1', "score", "row")
q("combined_doublet_score", lambda n: K.combined_score(n.p.select("id", F.col("p").alias("a"), (1 - F.col("p")).alias("b"), (F.col("p") * 3).alias("c")), {"a": 0.6, "b": 0.2, "c": 0.2}), with_("p") + "SELECT id, 0.6 * p / max(p) OVER () + 0.2 * (1 - p) / max(1 - p) OVER () + 0.2 * p / max(p) OVER () AS score FROM p", "score", "id")
q("doublet_score_stats", lambda n: K.score_stats(_sc(n)), with_("p") + "SELECT avg(p) AS mean, stddev_pop(p) AS std, quantile_cont(p, 0.5) AS median FROM p", "mean std median")
q("cluster_doublet_enrichment", lambda n: K.cluster_doublets(_sc(n).withColumn("cluster", F.col("id") % 6)), with_("p") + "SELECT id % 6 AS cluster, avg(p) AS mean_score, avg(CASE WHEN p > g THEN 1.0 ELSE 0 END) AS share FROM p, (SELECT avg(p) AS g FROM p) GROUP BY 1", "mean_score share", "cluster")
# --- graphs ------------------------------------------------------------------
UND = E + ", u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), dg AS (SELECT id, count(b) AS d FROM nd LEFT JOIN (SELECT a, b FROM u UNION ALL SELECT b, a FROM u) x ON x.a = id GROUP BY 1) "
q("degree_sequence", lambda n: G.degree_sequence(n.graph), E + "SELECT id, count(dst) AS degree FROM nd LEFT JOIN e ON src = id GROUP BY 1", "", "id degree")
q("degree_statistics", lambda n: G.degree_statistics(n.graph), UND + "SELECT avg(d) AS mean, max(d) AS max, min(d) AS min, stddev_pop(d) AS std FROM dg", "mean std", "max min")
q("degree_distribution", lambda n: G.degree_distribution(n.graph, 12), UND + "SELECT d AS degree, count(*) AS n FROM dg WHERE d <= 12 GROUP BY 1", "", "degree n")
q("graph_density", lambda n: G.graph_density(n.graph), E + "SELECT count(*) / 2 / (max(n) * (max(n) - 1) / 2) AS density FROM e, (SELECT count(*) AS n FROM nd)", "density")
q("degree_centrality", lambda n: G.degree_centrality(n.graph), UND + "SELECT id, d / ((SELECT count(*) FROM nd) - 1) AS centrality FROM dg", "centrality", "id")
q("weighted_degree_centrality", lambda n: G.weighted_degree_centrality(n.graph), E + ", s AS (SELECT id, coalesce(sum(w), 0) AS s FROM nd LEFT JOIN e ON src = id GROUP BY 1) SELECT id, s / max(s) OVER () AS centrality FROM s", "centrality", "id")
TRI = UND + ", t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b) "
q("count_triangles", lambda n: G.count_triangles(n.graph), TRI + "SELECT count(*) AS n FROM t", "", "n")
q("clustering_coefficient", lambda n: G.clustering_coefficient(n.graph), TRI + ", c AS (SELECT id, count(*) AS t FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1) SELECT dg.id AS id, CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS coefficient FROM dg LEFT JOIN c ON c.id = dg.id", "coefficient", "id")
q("global_clustering_coefficient", lambda n: G.global_clustering(n.graph), TRI + "SELECT 3 * (SELECT count(*) FROM t) / (SELECT sum(d * (d - 1) / 2) FROM dg) AS coefficient", "coefficient")
REACH = E.replace("WITH ", "WITH RECURSIVE ", 1) + ", rc AS (SELECT id AS a, id AS b FROM nd UNION SELECT rc.a, e.dst FROM rc JOIN e ON e.src = rc.b), cc AS (SELECT a AS id, min(b) AS component FROM rc GROUP BY 1) "
q("connected_components", lambda n: G.connected_components(n.graph), REACH + "SELECT id, component FROM cc", "", "id component")
q("component_sizes", lambda n: G.component_sizes(n.graph), REACH + "SELECT component, count(*) AS n FROM cc GROUP BY 1", "", "component n")
q("is_connected", lambda n: G.is_connected(n.graph), REACH + "SELECT count(DISTINCT component) <= 1 AS connected FROM cc")
q("largest_component", lambda n: G.largest_component(n.graph), REACH + "SELECT id FROM cc WHERE component = (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)", "", "id")
HOP = E.replace("WITH ", "WITH RECURSIVE ", 1) + ", bf AS (SELECT 0 AS id, 0 AS hops UNION SELECT e.dst, hops + 1 FROM bf JOIN e ON e.src = bf.id WHERE hops < 12), h AS (SELECT id, min(hops) AS hops FROM bf GROUP BY 1) "
q("bfs", lambda n: G.bfs(n.graph, [0]).select("id", "hops"), HOP + "SELECT nd.id AS id, coalesce(h.hops, -1) AS hops FROM nd LEFT JOIN h ON h.id = nd.id", "", "id hops")
q("multi_source_bfs", lambda n: G.bfs(n.graph, [0, 1, 2]))
#: Hops between all nodes, and numbers of shortest paths level by level.
HP = "WITH RECURSIVE " + with_("nb e")[5:] + ", bf(s, v, h) AS (SELECT id, id, 0 FROM nd UNION SELECT s, dst, h + 1 FROM bf JOIN e ON src = v WHERE h < 24), hp AS (SELECT s, v, min(h) AS h FROM bf GROUP BY 1, 2) "
SG = HP + ", sg(s, v, h, c) AS (SELECT id, id, 0, 1.0::DOUBLE FROM nd UNION ALL SELECT sg.s, dst, max(sg.h) + 1, sum(c) FROM sg JOIN e ON src = sg.v JOIN hp ON hp.s = sg.s AND hp.v = dst AND hp.h = sg.h + 1 GROUP BY 1, 2), dp AS (SELECT a.s, a.v, a.c * b.c / c.c AS d FROM sg a JOIN sg b ON b.s = a.v AND b.h > 0 JOIN sg c ON c.s = a.s AND c.v = b.v AND c.h = a.h + b.h WHERE a.h > 0) "
ND = "(SELECT count(*) FROM nd)"
q("graph_diameter", lambda n: G.graph_diameter(n.graph), HP + "SELECT max(h) AS diameter FROM hp", "", "diameter")
q("average_path_length", lambda n: G.average_path_length(n.graph), HP + "SELECT avg(h) AS length FROM hp WHERE h > 0", "length")
q("closeness_centrality", lambda n: G.closeness_centrality(n.graph), HP + f"SELECT s AS id, coalesce(power(count(CASE WHEN h > 0 THEN 1 END), 2) / nullif(sum(h), 0) / ({ND} - 1), 0) AS centrality FROM hp GROUP BY 1", "centrality", "id")
q("harmonic_centrality", lambda n: G.harmonic_centrality(n.graph), HP + f"SELECT s AS id, coalesce(sum(CASE WHEN h > 0 THEN 1.0 / h END), 0) / ({ND} - 1) AS centrality FROM hp GROUP BY 1", "centrality", "id")
q("betweenness_centrality", lambda n: G.betweenness_centrality(n.graph), SG + f"SELECT id, coalesce(sum(d), 0) / (({ND} - 1) * ({ND} - 2)) AS centrality FROM nd LEFT JOIN dp ON v = id GROUP BY 1", "centrality", "id")
q("betweenness_centrality_sampled", lambda n: T.betweenness_sampled(n.graph, 50), SG.replace("dp AS", "sa AS (SELECT id AS s FROM nd ORDER BY CAST('0x' || substr(md5(id || '|0'), 1, 13) AS BIGINT), id LIMIT 50), dp AS").replace("WHERE a.h > 0", "WHERE a.h > 0 AND a.s IN (SELECT s FROM sa)") + f"SELECT id, coalesce(sum(d), 0) * {ND} / 50.0 / (({ND} - 1) * ({ND} - 2)) AS centrality FROM nd LEFT JOIN dp ON v = id GROUP BY 1", "centrality", "id")
q("topological_sort", lambda n: G.topological_sort(Graph(n.tree.where("parent >= 0").select(F.col("parent").alias("src"), F.col("clone").alias("dst"), F.lit(1.0).alias("w")), n.tree.select(F.col("clone").alias("id")))), with_("tree") + "SELECT clone AS id, CASE WHEN parent < 0 THEN 0 WHEN clone < 1000000 THEN 1 ELSE 2 END AS level FROM tree", "", "id level")
q("kcore_decomposition", lambda n: G.kcore(n.graph))
WALK = E.replace("WITH ", "WITH RECURSIVE ", 1) + ", t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e) "
#: A loop of n steps over ``it, id, x``: a node's next value is made of its own row and the walk's neighbours.
LOOP = ", it AS (SELECT 0 AS it, id, CAST({start} AS DOUBLE) AS x FROM nd UNION ALL SELECT it.it + 1, {node}, CAST({step} AS DOUBLE) FROM it JOIN t ON {on} = it.id WHERE it.it < {n} GROUP BY it.it, {node}) SELECT id, x FROM it WHERE it = {n}"
_ahead = lambda start, step, n: WALK + LOOP.format(start=start, step=step, n=n, node="t.src", on="t.dst")
_back = lambda start, step, n: WALK + LOOP.format(start=start, step=step, n=n, node="t.dst", on="t.src")
PR = _back("1.0 / (SELECT count(*) FROM nd)", "0.15 / (SELECT count(*) FROM nd) + 0.85 * sum(x * t.w)", 40)
q("pagerank", lambda n: G.pagerank(n.graph, max_iter=40), PR, "x", "id", digits=5)
q("personalized_pagerank", lambda n: G.personalized_pagerank(n.graph, n.spark.range(3), max_iter=40), _back("CASE WHEN id < 3 THEN 1.0 / 3 ELSE 0 END", "0.15 * (CASE WHEN t.dst < 3 THEN 1.0 / 3 ELSE 0 END) + 0.85 * sum(x * t.w)", 40), "x", "id", digits=4)
q("hits", lambda n: G.hits(n.graph, max_iter=30))
q("eigenvector_centrality", lambda n: G.eigenvector_centrality(n.graph, max_iter=30))
q("katz_centrality", lambda n: G.katz_centrality(n.graph, alpha=0.05))
q("row_stochastic", lambda n: G.row_stochastic(n.graph), E + "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e", "w", "src dst")
SN = E + ", dw AS (SELECT src, sum(w) AS d FROM e GROUP BY 1), sn AS (SELECT e.src, e.dst, w / sqrt(a.d * b.d) AS w FROM e JOIN dw a ON a.src = e.src JOIN dw b ON b.src = e.dst) "
q("compute_transition_matrix", lambda n: G.symmetric_normalized(n.graph), SN + "SELECT src, dst, w FROM sn", "w", "src dst")
q("symmetrize_transition", lambda n: G.symmetrize_transition(n.graph), E + "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e", "w", "src dst")
q("diffuse_vector", lambda n: G.diffuse_vector(Graph(G.row_stochastic(n.graph), n.graph.nodes), n.values.select("id", F.col("value").alias("x")), 2), EV + ", t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e), s1 AS (SELECT src AS id, sum(w * value) AS x FROM t JOIN val ON val.id = dst GROUP BY 1) SELECT src AS id, sum(w * x) AS x FROM t JOIN s1 ON s1.id = dst GROUP BY 1", "x", "id")
q("lazy_random_walk", lambda n: G.diffuse_vector(Graph(G.row_stochastic(n.graph), n.graph.nodes), n.values.select("id", F.col("value").alias("x")), 1, 0.5), EV + ", t AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e), s1 AS (SELECT src AS id, sum(w * value) AS x FROM t JOIN val ON val.id = dst GROUP BY 1) SELECT val.id AS id, 0.5 * value + 0.5 * x AS x FROM val JOIN s1 ON s1.id = val.id", "x", "id")
HK = EV
for _i in range(4):
    HK += f", h{_i + 1} AS (SELECT id, 0.75 * {'1.0' if not _i else f'x'} + 0.25 * coalesce(f, 0) AS x FROM {'nd' if not _i else f'h{_i}'} LEFT JOIN (SELECT src, sum(w{'' if not _i else ' * x'}) AS f FROM e {'' if not _i else f'JOIN h{_i} ON h{_i}.id = dst'} GROUP BY 1) p ON p.src = id)"
q("heat_kernel_signature", lambda n: G.heat_kernel_signature(n.graph, 1.0, 4), HK + " SELECT id, x FROM h4", "x", "id", digits=5)
q("random_walk_with_restart", lambda n: G.random_walk_with_restart(Graph(G.row_stochastic(n.graph), n.graph.nodes), [0, 1]), _ahead("CASE WHEN id < 2 THEN 0.5 ELSE 0 END", "0.15 * (CASE WHEN t.src < 2 THEN 0.5 ELSE 0 END) + 0.85 * sum(x * t.w)", 100), "x", "id", digits=4)
q("compute_dpt", lambda n: G.dpt(Graph(G.row_stochastic(n.graph), n.graph.nodes), 0, 8))
q("diffusion_distance", lambda n: G.diffusion_distance(Graph(G.row_stochastic(n.graph), n.graph.nodes), 2))
q("stationary_distribution", lambda n: G.stationary_distribution(n.graph, max_iter=24), _back("1.0 / (SELECT count(*) FROM nd)", "sum(x * t.w)", 24), "x", "id", digits=5)
q("identify_terminal_states", lambda n: G.terminal_states(n.graph), UND + "SELECT id, d <= 1 AS terminal FROM dg", "", "id")
AP = "SELECT id, {k} AS terminal, x AS p FROM (" + _ahead("CASE WHEN id = {k} THEN 1 ELSE 0 END", "CASE WHEN t.src = {k} THEN 1 WHEN t.src IN (0, 5) THEN 0 ELSE sum(x * t.w) END", 24) + ")"
q("absorption_probability", lambda n: G.absorption_probability(n.graph, [0, 5], max_iter=24), AP.replace("{k}", "0") + " UNION ALL " + AP.replace("{k}", "5"), "p", "id terminal", digits=4)
q("hitting_time", lambda n: G.hitting_time(n.graph, [0], max_iter=24))
q("forward_committor", lambda n: G.forward_committor(n.graph, [0], [5], max_iter=24), "SELECT id, x AS q FROM (" + _ahead("CASE WHEN id = 5 THEN 1 ELSE 0 END", "CASE WHEN t.src = 5 THEN 1 WHEN t.src = 0 THEN 0 ELSE sum(x * t.w) END", 24) + ")", "q", "id", digits=4)
q("harmonic_function", lambda n: G.harmonic_function(n.graph, n.values.where("id % 5 = 0"), max_iter=24), _ahead("CASE WHEN id % 5 = 0 THEN (SELECT CAST(embedding[3] AS DOUBLE) FROM embeddings WHERE vec_id = id) ELSE 0 END", "CASE WHEN t.src % 5 = 0 THEN (SELECT CAST(embedding[3] AS DOUBLE) FROM embeddings WHERE vec_id = t.src) ELSE sum(x * t.w) END", 24), "x", "id", digits=4)
q("coarse_grain_transition", lambda n: G.coarse_grain(n.graph, n.vectors.select("id", (F.col("id") % 3).alias("label"))), E + "SELECT src % 3 AS a, dst % 3 AS b, sum(w) / sum(sum(w)) OVER (PARTITION BY src % 3) AS p FROM e GROUP BY 1, 2", "p", "a b")
_pt = lambda n: n.values.select("id", F.col("value").alias("t"))
q("directional_score", lambda n: G.directional_score(n.graph, _pt(n)), EV + ", s AS (SELECT src, sum(CASE WHEN b.value > a.value THEN w ELSE 0 END) AS f, sum(CASE WHEN b.value < a.value THEN w ELSE 0 END) AS g FROM e JOIN val a ON a.id = src JOIN val b ON b.id = dst GROUP BY 1) SELECT src AS id, (f - g) / (f + g) AS score FROM s", "score", "id")
q("fate_entropy", lambda n: G.fate_entropy(n.vectors.select("id", F.explode(F.array(F.lit(0.2), F.lit(0.8))).alias("p"))), "SELECT vec_id AS id, -(0.2 * ln(0.2) + 0.8 * ln(0.8)) AS h FROM embeddings", "h", "id")
_seed = lambda n: n.vectors.select("id", F.when(F.col("id") % 7 == 0, F.col("label")).otherwise(-1).alias("label"))
q("label_propagation", lambda n: G.label_propagation(n.graph, _seed(n)))
q("label_spreading", lambda n: G.hard_labels(G.label_spreading(n.graph, _seed(n).where("label >= 0"), max_iter=20)).select("id", "label"))
q("confidence_propagation", lambda n: G.confidence_propagation(n.graph, _seed(n).withColumn("confidence", F.lit(1.0)), max_iter=20).select("id", "label"))
q("init_soft_labels", lambda n: G.soft_labels(_seed(n), 10, 0.9), with_("ty") + "SELECT id, k AS label, CASE WHEN id % 7 <> 0 THEN 0.1 WHEN type = k THEN 0.9 ELSE 0.1 / 9 END AS x FROM ty CROSS JOIN (SELECT unnest(range(0, 10)) AS k)", "x", "id label")
q("inductive_transfer", lambda n: G.inductive_transfer(n.nbrs.where("row % 2 = 1 and nbr % 2 = 0").select(F.col("row").alias("query"), F.col("nbr").alias("ref"), F.lit(1.0).alias("w")), _batches(n), n.vectors.where("id % 2 = 1").select("id"), 0.6), NB + ", v AS (SELECT i AS id, k % 3 AS label, count(*) AS w FROM nb WHERE i % 2 = 1 AND k % 2 = 0 GROUP BY 1, 2), b AS (SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS c FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1) SELECT vec.id AS id, CASE WHEN c >= 0.6 THEN b.label ELSE -1 END AS label FROM vec LEFT JOIN b ON b.id = vec.id WHERE vec.id % 2 = 1", "", "id label")
def _relaxed(e: str, roots: str, rounds: int = 40) -> str:
    """Least distances from the roots by rounds of relaxation, in ``sp``."""
    first = f"sp0 AS MATERIALIZED (SELECT id AS s, id, 0.0::DOUBLE AS x FROM nd WHERE id IN ({roots}))"
    each = [f"sp{k} AS MATERIALIZED (SELECT s, id, min(x) AS x FROM (SELECT s, id, x FROM sp{k - 1} UNION ALL SELECT s, dst, x + {e} FROM sp{k - 1} JOIN e ON src = id WHERE w > 0) GROUP BY 1, 2)" for k in range(1, rounds + 1)]
    return ", ".join(["", first, *each, f"sp AS (SELECT * FROM sp{rounds})"])


TIME = ", pt AS (SELECT nd.id AS id, coalesce(x / nullif((SELECT max(x) FROM sp), 0), CASE WHEN nd.id = 0 THEN 0 ELSE 1 END) AS t FROM nd LEFT JOIN sp ON sp.id = nd.id) "


def _smoothed(weight: str, rounds: int) -> str:
    """Times of ``pt`` drawn half way to their neighbours' weighted means, scaled to 0 .. 1, in ``ft``."""
    each = [f"t{k} AS MATERIALIZED (SELECT a.id AS id, max(a.t) / 2 + coalesce(sum({weight} * b.t) / sum({weight}), max(a.t)) / 2 AS t FROM t{k - 1} a LEFT JOIN e ON src = a.id LEFT JOIN t{k - 1} b ON b.id = dst LEFT JOIN vm ON vm.id = a.id GROUP BY a.id)" for k in range(1, rounds + 1)]
    return ", ".join(["", "t0 AS MATERIALIZED (SELECT * FROM pt)", *each, f"ft AS (SELECT id, (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()) AS t FROM t{rounds}) "])


VM = ", vm AS (SELECT vec_id AS id, abs(CAST(embedding[3] AS DOUBLE)) AS v FROM embeddings)"
_speed = lambda n: n.values.select("id", F.abs("value").alias("v"))
q("dijkstra", lambda n: G.shortest_paths(n.graph, [0, 1]), E + _relaxed("w", "0, 1") + " SELECT s.s AS source, nd.id AS id, coalesce(x, 1e30) AS x FROM (SELECT DISTINCT s FROM sp) s CROSS JOIN nd LEFT JOIN sp ON sp.s = s.s AND sp.id = nd.id", "x", "source id")
q("graph_pseudotime", lambda n: G.graph_pseudotime(n.graph, 0), E + _relaxed("w", "0") + TIME + "SELECT * FROM pt", "t", "id")
q("compute_pseudotime", lambda n: G.compute_pseudotime(n.graph, 0, "graph_distance"), E + _relaxed("w", "0") + TIME + "SELECT * FROM pt", "t", "id")
q("velocity_weighted_pseudotime", lambda n: G.velocity_weighted_pseudotime(n.graph, G.graph_pseudotime(n.graph, 0), _speed(n)), E + VM + _relaxed("w", "0") + TIME + _smoothed("(w * CASE WHEN b.t < a.t THEN 1 / (1 + v) ELSE 1 + v END)", 20) + "SELECT * FROM ft", "t", "id")
q("kernel_normalization", lambda n: n.long_vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", *(K.kernel_normalization(k, F.col("dim") + 1).alias(k) for k in ("gaussian", "epanechnikov", "uniform", "triangular"))), with_("lv") + "SELECT dim, power(2 * pi(), -(dim + 1) / 2) AS gaussian, 0.75 AS epanechnikov, 0.5 AS uniform, 1.0 AS triangular FROM lv GROUP BY 1", "gaussian epanechnikov uniform triangular", "dim")
q("select_root_cell", lambda n: G.select_root(n.values), with_("val") + "SELECT id FROM val ORDER BY value, id LIMIT 1", "", "id")
q("select_root_peripheral", lambda n: G.select_root_peripheral(n.graph), E + "SELECT src AS id FROM e GROUP BY 1 ORDER BY avg(w) DESC, src LIMIT 1", "", "id")
q("detect_branch_points", lambda n: G.branch_points(n.graph, _pt(n), 0.05), EV + ", s AS (SELECT src, count(*) AS d, sum(CASE WHEN b.value < a.value - 0.05 THEN 1 ELSE 0 END) AS x, sum(CASE WHEN b.value > a.value + 0.05 THEN 1 ELSE 0 END) AS y FROM e JOIN val a ON a.id = src JOIN val b ON b.id = dst GROUP BY 1) SELECT src AS id FROM s WHERE d >= 3 AND ((x >= 1 AND y >= 2) OR (x >= 2 AND y >= 1))", "", "id")
q("segment_trajectory", lambda n: G.segment_trajectory(_pt(n), n.vectors.where("id % 100 = 0").select("id")), with_("val") + "SELECT id, (SELECT count(*) FROM val b WHERE b.id % 100 = 0 AND b.value <= a.value) AS segment FROM val a", "", "id segment")
q("smooth_pseudotime", lambda n: G.smooth_pseudotime(n.graph, _pt(n), 1), EV + ", s AS (SELECT src, sum(w * value) / sum(w) AS m FROM e JOIN val ON id = dst GROUP BY 1) SELECT id, 0.5 * value + 0.5 * m AS t FROM val JOIN s ON src = id", "t", "id")
q("find_terminal_states", lambda n: G.late_states(_pt(n), 0.95), with_("val") + "SELECT id FROM val WHERE value >= (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value, id) AS r, count(*) OVER () AS n FROM val) WHERE r = floor((1 - (1 - 0.95)) * (n - 1)) + 1)", "", "id")
q("compute_backbone", lambda n: G.backbone(_pt(n), 10), with_("val") + ", o AS (SELECT id, row_number() OVER (ORDER BY value, id) AS r, count(*) OVER () AS n FROM val) SELECT k AS pos, id FROM o JOIN (SELECT unnest(range(0, 10)) AS k) ON r = floor(k * (n - 1) / 9) + 1", "", "pos id")
# --- message passing ---------------------------------------------------------
MP = with_("nb e lv")
for _k, _e in (("sum", "sum(w * x)"), ("mean", "sum(w * x) / sum(w)"), ("max", "max(x)"), ("min", "min(x)")):
    q(f"message_passing_{_k}", lambda n, k=_k: G.message_passing(n.graph, n.long_vectors, k), MP + f"SELECT src AS id, dim, {_e} AS x FROM e JOIN lv ON id = dst GROUP BY 1, 2", "x", "id dim")
q("sage_aggregate", lambda n: G.sage_aggregate(n.graph, n.long_vectors, "mean", 3), MP + "SELECT src AS id, dim, avg(x) AS x FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 3) f JOIN lv ON id = dst GROUP BY 1, 2", "x", "id dim")
_wt = lambda n: n.spark.createDataFrame([(i, o, 0.1 * (i + 1) - 0.2 * o) for i in range(DIMS) for o in range(2)], "dim int, out int, w double")
q("graph_convolution", lambda n: G.graph_convolution(n.graph, n.long_vectors, _wt(n)), MP + ", al AS (SELECT src, dst, w FROM e UNION ALL SELECT id, id, 1.0 FROM nd), dw AS (SELECT src, sum(w) AS d FROM al GROUP BY 1), h AS (SELECT al.src AS id, dim, sum(w / sqrt(a.d * b.d) * x) AS h FROM al JOIN dw a ON a.src = al.src JOIN dw b ON b.src = al.dst JOIN lv ON lv.id = al.dst GROUP BY 1, 2) SELECT id, o AS dim, greatest(0, sum(h * (0.1 * (dim + 1) - 0.2 * o))) AS x FROM h CROSS JOIN (SELECT unnest(range(0, 2)) AS o) GROUP BY 1, 2", "x", "id dim")
_att = lambda n: n.spark.createDataFrame([(i, 0.5 - 0.1 * i, 0.2 * i) for i in range(DIMS)], "dim int, a1 double, a2 double")
q("graph_attention", lambda n: G.graph_attention(n.graph, n.long_vectors, _att(n)).drop("head"), MP + ", al AS (SELECT src, dst FROM e UNION SELECT id, id FROM nd), s AS (SELECT id, sum((0.5 - 0.1 * dim) * x) AS s1, sum(0.2 * dim * x) AS s2 FROM lv GROUP BY 1), l AS (SELECT src, dst, CASE WHEN a.s1 + b.s2 > 0 THEN a.s1 + b.s2 ELSE 0.2 * (a.s1 + b.s2) END AS l FROM al JOIN s a ON a.id = src JOIN s b ON b.id = dst), p AS (SELECT src, dst, exp(l) / sum(exp(l)) OVER (PARTITION BY src) AS p FROM l) SELECT src AS id, dim, sum(p * x) AS x FROM p JOIN lv ON id = dst GROUP BY 1, 2", "x", "id dim")
q("multi_head_attention", lambda n: G.multi_head_attention(n.graph, n.long_vectors, [_att(n), _att(n)]))
q("feature_smoothing", lambda n: G.feature_smoothing(n.graph, n.long_vectors, 0.5, 1), MP + ", s AS (SELECT src, dim, sum(w * x) / sum(w) AS m FROM e JOIN lv ON id = dst GROUP BY 1, 2) SELECT id, lv.dim AS dim, 0.5 * x + 0.25 * m AS x FROM lv JOIN s ON src = id AND s.dim = lv.dim", "x", "id dim")
for _k, _e in (("sum", "sum(x)"), ("mean", "avg(x)"), ("max", "max(x)"), ("min", "min(x)")):
    q(f"global_pool_{_k}", lambda n, k=_k: G.global_pool(n.long_vectors, k), with_("lv") + f"SELECT dim, {_e} AS x FROM lv GROUP BY 1", "x", "dim")
q("hierarchical_pool", lambda n: G.hierarchical_pool(n.long_vectors, n.vectors.select("id", F.col("label").alias("cluster"))), with_("lv ty") + "SELECT type AS cluster, dim, avg(x) AS x FROM lv JOIN ty USING (id) GROUP BY 1, 2", "x", "cluster dim")
q("compute_edge_features", lambda n: G.edge_features(n.graph, n.long_vectors, False), MP + "SELECT src, dst, a.dim AS dim, b.x - a.x AS x FROM e JOIN lv a ON a.id = src JOIN lv b ON b.id = dst AND b.dim = a.dim", "x", "src dst dim")
q("compute_edge_features_concat", lambda n: G.edge_features(n.graph, n.long_vectors), MP + "SELECT src, dst, dim, x FROM e JOIN lv ON id = src UNION ALL SELECT src, dst, dim + 64, x FROM e JOIN lv ON id = dst", "x", "src dst dim")
q("skip_connection", lambda n: G.skip_connection(n.long_vectors, n.long_vectors, 0.5), with_("lv") + "SELECT id, dim, 1.5 * x AS x FROM lv", "x", "id dim")
q("layer_norm", lambda n: G.layer_norm(n.long_vectors), with_("lv") + "SELECT id, dim, (x - avg(x) OVER (PARTITION BY id)) / sqrt(var_pop(x) OVER (PARTITION BY id) + 1e-5) AS x FROM lv", "x", "id dim")
q("batch_norm", lambda n: G.batch_norm(n.long_vectors, 2.0, 0.5), with_("lv") + "SELECT id, dim, 2 * (x - avg(x) OVER (PARTITION BY dim)) / sqrt(var_pop(x) OVER (PARTITION BY dim) + 1e-5) + 0.5 AS x FROM lv", "x", "id dim")
q("dropout", lambda n: G.dropout(n.long_vectors, 0.3))
q("graph_connectivity", lambda n: G.pool_graph_connectivity(n.graph, n.vectors.select("id", F.col("label"))))
# --- spatial -----------------------------------------------------------------
q("row_standardize_weights", lambda n: S.row_standardize(n.graph), E + "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e", "w", "src dst")
q("distance_band_weights", lambda n: S.distance_band(n.points, 0.3).select("src", "dst", "dist"), with_("pts") + "SELECT a.id AS src, b.id AS dst, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM pts a JOIN pts b ON a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.09", "dist", "src dst")
q("knn_weights", lambda n: S.knn_weights(n.points, 4).select("src", "dst", "dist"), with_("pts") + "SELECT a.id AS src, b.id AS dst, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM pts a JOIN pts b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.id) <= 4", "dist", "src dst")
q("compute_spatial_lag", lambda n: S.spatial_lag(n.graph, n.values), EV + "SELECT src AS id, sum(w * value) / sum(w) AS lag FROM e JOIN val ON id = dst GROUP BY 1", "lag", "id")
CE = EV + ", c AS (SELECT id, value - avg(value) OVER () AS z, var_pop(value) OVER () AS m2, count(*) OVER () AS n FROM val), ez AS (SELECT src, dst, w, a.z AS zi, b.z AS zj, a.m2 AS m2, CAST(a.n AS DOUBLE) AS n FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst) "
MI = CE + ", g AS (SELECT sum(w * zi * zj) / (sum(w) * max(m2)) AS i, sum(w) AS s0, max(n) AS n, 2 * sum(w * w) AS s1 FROM ez), s2 AS (SELECT sum(power(2 * k, 2)) AS s2 FROM (SELECT sum(w) AS k FROM e GROUP BY src)), zz AS (SELECT i, (i + 1 / (n - 1)) / sqrt((n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - 1 / power(n - 1, 2)) AS z FROM g, s2) "
q("global_morans_i", lambda n: S.global_morans_i(n.graph, n.values), MI + f"SELECT i, z, {two_sided_sql('z')} AS p FROM zz", "i z p")
q("global_gearys_c", lambda n: S.global_gearys_c(n.graph, n.values), CE + f", g AS (SELECT (max(n) - 1) * sum(w * power(zi - zj, 2)) / (2 * sum(w) * max(n) * max(m2)) AS c, sum(w) AS s0, max(n) AS n, 2 * sum(w * w) AS s1 FROM ez), s2 AS (SELECT sum(power(2 * k, 2)) AS s2 FROM (SELECT sum(w) AS k FROM e GROUP BY src)), zz AS (SELECT c, (1 - c) / sqrt(((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)) AS z FROM g, s2) SELECT c, z, {two_sided_sql('z')} AS p FROM zz", "c z p")
q("spatial_autocorrelation_summary", lambda n: S.autocorrelation_summary(n.graph, n.values))
q("local_morans_i", lambda n: S.local_morans_i(n.graph, n.values).select("id", "i"), CE + "SELECT src AS id, max(zi) * sum(w * zj) / max(m2) AS i FROM ez GROUP BY 1", "i", "id")
q("local_gearys_c", lambda n: S.local_gearys_c(n.graph, n.values), CE + "SELECT src AS id, sum(w * power(zi - zj, 2)) / max(m2) AS c FROM ez GROUP BY 1", "c", "id")
q("moran_scatterplot", lambda n: S.moran_scatter(n.graph, n.values), CE + "SELECT src AS id, max(zi) / sqrt(max(m2)) AS x, sum(w * zj) / sum(w) / sqrt(max(m2)) AS lag FROM ez GROUP BY 1", "x lag", "id")
q("classify_lisa_patterns", lambda n: S.lisa_patterns(n.graph, n.values, n.vectors.select("id", ((F.col("id") % 10) / 50).alias("p"))), CE + "SELECT src AS id, CASE WHEN src % 10 / 50 >= 0.05 THEN 0 WHEN max(zi) > 0 AND sum(w * zj) > 0 THEN 1 WHEN max(zi) <= 0 AND sum(w * zj) <= 0 THEN 2 WHEN max(zi) > 0 THEN 3 ELSE 4 END AS pattern FROM ez GROUP BY 1", "", "id pattern")
GO = EV + ", al AS (SELECT src, dst, w FROM e UNION ALL SELECT id, id, 1.0 FROM nd), st AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, CAST(count(*) AS DOUBLE) AS n FROM val), go AS (SELECT src AS id, sum(w * value) / sum(w) AS g, (sum(w * value) - max(mu) * sum(w)) / (max(sd) * sqrt((max(n) * sum(w * w) - power(sum(w), 2)) / (max(n) - 1))) AS z FROM al JOIN val ON id = dst, st GROUP BY 1) "
q("getis_ord_g_star", lambda n: S.getis_ord(n.graph, n.values), GO + f"SELECT id, g, z, {two_sided_sql('z')} AS p FROM go", "g z p", "id")
q("identify_hotspots", lambda n: S.hotspots(S.getis_ord(n.graph, n.values)), GO + "SELECT id, CASE WHEN z >= 1.96 THEN 1 WHEN z <= -1.96 THEN -1 ELSE 0 END AS kind FROM go", "", "id kind")
q("classify_confidence_levels", lambda n: S.confidence_bins(S.getis_ord(n.graph, n.values)), GO + "SELECT id, sign(z) * ((CASE WHEN abs(z) >= 1.96 THEN 1 ELSE 0 END) + (CASE WHEN abs(z) >= 2.576 THEN 1 ELSE 0 END) + (CASE WHEN abs(z) >= 3.291 THEN 1 ELSE 0 END)) AS bin FROM go", "", "id bin")
q("count_hotspots", lambda n: S.count_kinds(S.hotspots(S.getis_ord(n.graph, n.values)), "kind"), GO + "SELECT CASE WHEN z >= 1.96 THEN 1 WHEN z <= -1.96 THEN -1 ELSE 0 END AS kind, count(*) AS n FROM go GROUP BY 1", "", "kind n")
q("detect_spatial_clusters", lambda n: S.hotspot_clusters(n.graph, S.hotspots(S.getis_ord(n.graph, n.values))))
q("bivariate_local_morans_i", lambda n: S.bivariate_local_i(n.graph, n.values, n.points.select("id", F.col("x").alias("value"))), with_("nb e val pts") + ", zx AS (SELECT id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM val), zy AS (SELECT id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM pts) SELECT src AS id, max(zx.z) * sum(w * zy.z) AS i FROM e JOIN zx ON zx.id = src JOIN zy ON zy.id = dst GROUP BY 1", "i", "id")
q("weight_sum", lambda n: S.weight_sum(n.graph), E + "SELECT sum(w) AS total FROM e", "total")
XE = with_("nb e xp") + ", d AS (SELECT vec_id AS id, dj.j AS j, coalesce(v, 0) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS j) dj LEFT JOIN xp ON xp.i = vec_id AND xp.j = dj.j), c AS (SELECT id, j, v - avg(v) OVER (PARTITION BY j) AS z FROM d) "
q("morans_i", lambda n: S.morans_i(n.graph, n.expr), XE + "SELECT a.j AS col, max(n) * sum(w * a.z * b.z) / (sum(w) * max(ss)) AS i FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst AND b.j = a.j JOIN (SELECT j, sum(z * z) AS ss FROM c GROUP BY 1) s ON s.j = a.j, nx GROUP BY 1", "i", "col")
q("gearys_c", lambda n: S.gearys_c(n.graph, n.expr), XE + "SELECT a.j AS col, (max(n) - 1) * sum(w * power(a.z - b.z, 2)) / (2 * sum(w) * max(ss)) AS c FROM e JOIN c a ON a.id = src JOIN c b ON b.id = dst AND b.j = a.j JOIN (SELECT j, sum(z * z) AS ss FROM c GROUP BY 1) s ON s.j = a.j, nx GROUP BY 1", "c", "col")
_ty = lambda n: n.vectors.select("id", (F.col("id") % 4).alias("type"))
q("neighborhood_composition", lambda n: S.neighborhood_composition(n.graph, _ty(n)), E + "SELECT src AS id, dst % 4 AS type, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM e GROUP BY 1, 2", "share", "id type")
NC = E + ", p AS (SELECT src, dst % 4 AS t, count(*) / sum(count(*)) OVER (PARTITION BY src) AS p FROM e GROUP BY 1, 2) "
q("niche_diversity", lambda n: S.niche_diversity(n.graph, _ty(n)), NC + "SELECT src AS id, -sum(p * ln(p)) AS h FROM p GROUP BY 1", "h", "id")
q("niche_boundary_score", lambda n: S.boundary_score(n.graph, _ty(n)), E + "SELECT src AS id, 1 - avg(CASE WHEN src % 4 = dst % 4 THEN 1.0 ELSE 0 END) AS score FROM e GROUP BY 1", "score", "id")
q("spatial_coherence", lambda n: S.spatial_coherence(n.graph, _ty(n)), E + "SELECT src AS id, avg(CASE WHEN src % 4 = dst % 4 THEN 1.0 ELSE 0 END) AS coherence FROM e GROUP BY 1", "coherence", "id")
q("boundary_cells", lambda n: S.boundary_cells(n.graph, _ty(n)), E + "SELECT src AS id, max(CASE WHEN src % 4 <> dst % 4 THEN 1 ELSE 0 END) = 1 AS boundary FROM e GROUP BY 1", "", "id")
q("cell_cell_contact", lambda n: S.contact_matrix(n.graph, _ty(n)), E + "SELECT src % 4 AS a, dst % 4 AS b, count(*) / (SELECT count(*) FROM e) AS share FROM e GROUP BY 1, 2", "share", "a b")
TF = E + ", f AS (SELECT id % 4 AS t, CAST(count(*) AS DOUBLE) AS k, count(*) / (SELECT count(*) FROM nd) AS f FROM nd GROUP BY 1), c AS (SELECT src % 4 AS a, dst % 4 AS b, count(*) AS c FROM e GROUP BY 1, 2), ob AS (SELECT x.t AS a, y.t AS b, x.k AS na, x.f AS fa, y.f AS fb, coalesce(c, 0) AS c, (SELECT count(*) FROM e) AS tot, (SELECT count(*) FROM e WHERE src % 4 = x.t) AS ta FROM f x CROSS JOIN f y LEFT JOIN c ON c.a = x.t AND c.b = y.t) "
q("neighborhood_enrichment", lambda n: S.neighborhood_enrichment(n.graph, _ty(n)).select("a", "b", "z"), TF + "SELECT a, b, (c / ta - fb) / sqrt(fb * (1 - fb) / na) AS z FROM ob", "z", "a b")
q("colocalization_matrix", lambda n: S.colocalization(n.graph, _ty(n)), TF + "SELECT a, b, log2(c / (fa * fb * tot)) AS score FROM ob", "score", "a b")
q("niche_similarity", lambda n: S.niche_similarity(n.graph, _ty(n), n.spark.range(3)), E + ", sh AS (SELECT nd.id AS id, t, coalesce(p, 0) AS p FROM nd CROSS JOIN (SELECT unnest(range(0, 4)) AS t) LEFT JOIN (SELECT src, dst % 4 AS ty, count(*) / sum(count(*)) OVER (PARTITION BY src) AS p FROM e GROUP BY 1, 2) c ON c.src = nd.id AND c.ty = t) SELECT a.id AS query, b.id AS id, 1 - sqrt(greatest(0, 0.5 * sum(CASE WHEN a.p > 0 THEN a.p * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * log2(2 * b.p / (a.p + b.p)) ELSE 0 END))) AS similarity FROM sh a JOIN sh b ON a.t = b.t WHERE a.id < 3 GROUP BY 1, 2", "similarity", "query id", digits=5)
q("spatial_gradient", lambda n: S.spatial_gradient(n.points, n.values), with_("pts val") + ", s AS (SELECT covar_pop(value, x) / var_pop(x) AS sx, covar_pop(value, y) / var_pop(y) AS sy FROM pts JOIN val USING (id)) SELECT sqrt(sx * sx + sy * sy) AS strength, sx / sqrt(sx * sx + sy * sy) AS dx, sy / sqrt(sx * sx + sy * sy) AS dy FROM s", "strength dx dy")
q("periodic_pattern", lambda n: S.periodic_pattern(n.points, n.values, [0.5, 1.0, 2.0, 4.0]), with_("pts val") + ", w AS (SELECT unnest([0.5, 1.0, 2.0, 4.0]) AS l), s AS (SELECT CAST(l AS DOUBLE) AS wavelength, power(corr(value, cos(2 * pi() * x / l)), 2) + power(corr(value, sin(2 * pi() * x / l)), 2) AS score FROM pts JOIN val USING (id), w GROUP BY l) SELECT * FROM s ORDER BY score DESC, wavelength LIMIT 1", "wavelength score")
q("ripleys_k", lambda n: S.ripleys_k(n.points, [0.1, 0.3, 0.5], 100.0), with_("pts") + ", r AS (SELECT unnest([0.1, 0.3, 0.5]) AS r) SELECT CAST(r AS DOUBLE) AS radius, 2 * (SELECT count(*) FROM pts a JOIN pts b ON a.id < b.id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= r) * 100.0 / power((SELECT count(*) FROM pts), 2) AS k FROM r", "radius k")
q("hotspot_analysis", lambda n: S.hotspot_analysis(n.points, n.values, 0.1))
q("spatial_smoothing", lambda n: S.spatial_smoothing(n.points, n.expr, 0.1), with_("pts xp") + ", d AS (SELECT a.id AS s, b.id AS t, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS d2 FROM pts a JOIN pts b ON a.id <> b.id), w AS (SELECT s, t, exp(-d2 / 0.02) AS w FROM d WHERE d2 <= 0.16), tw AS (SELECT s, sum(w) AS tw FROM w GROUP BY 1) SELECT w.s AS \"row\", j AS col, sum(w * v) / max(tw) AS v FROM w JOIN tw ON tw.s = w.s JOIN xp ON xp.i = w.t GROUP BY 1, 2", "v", "row col", digits=5)
KW = with_("pts") + ", kw AS (SELECT a.id AS s, b.id AS t, exp(-(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 0.02) AS w FROM pts a JOIN pts b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.16) "
q("spatial_entropy", lambda n: S.spatial_entropy(n.points, _ty(n), 0.1), KW + ", p AS (SELECT s, t % 4 AS ty, sum(w) / sum(sum(w)) OVER (PARTITION BY s) AS p FROM kw GROUP BY 1, 2) SELECT s AS id, -sum(p * ln(p)) / ln(4) AS h FROM p GROUP BY 1", "h", "id", digits=5)
q("cell_type_interaction", lambda n: S.cell_type_interaction(n.points, _ty(n), 0.2), with_("pts") + ", ed AS (SELECT a.id % 4 AS a, b.id % 4 AS b FROM pts a JOIN pts b ON a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.04), f AS (SELECT id % 4 AS t, count(*) / (SELECT count(*) FROM pts) AS f FROM pts GROUP BY 1) SELECT a, b, log2(count(*) / (max(x.f) * max(y.f) * (SELECT count(*) FROM ed))) AS score FROM ed JOIN f x ON x.t = a JOIN f y ON y.t = b GROUP BY 1, 2", "score", "a b")
q("spatial_coexpression", lambda n: S.spatial_coexpression(n.graph, n.values, n.points.select("id", F.col("x").alias("value"))), with_("nb e val pts") + ", zx AS (SELECT id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM val), zy AS (SELECT id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM pts) SELECT sum(w * zx.z * zy.z) / sum(w) AS score FROM e JOIN zx ON zx.id = src JOIN zy ON zy.id = dst", "score")
q("layer_assignment", lambda n: S.layer_assignment(n.points, 5), with_("pts") + "SELECT id, least(4, floor((x - min(x) OVER ()) / ((max(x) OVER () - min(x) OVER ()) / 5))) AS layer FROM pts", "", "id layer")
q("radial_layer_assignment", lambda n: S.radial_layers(n.points, 0.0, 0.0, 5), with_("pts") + ", r AS (SELECT id, sqrt(x * x + y * y) AS r FROM pts) SELECT id, least(4, floor(r / (max(r) OVER () / 5))) AS layer FROM r", "", "id layer")
q("zonation_score", lambda n: S.zonation(n.points, n.values, 0.0, 0.0), with_("pts val") + ", d AS (SELECT id, sqrt(x * x + y * y) AS d, value FROM pts JOIN val USING (id)) SELECT id, d / (SELECT max(d) FROM d) * abs((SELECT corr(d, value) FROM d)) AS score FROM d", "score", "id")
q("tissue_architecture", lambda n: S.tissue_architecture(n.graph, _ty(n), n.nbrs.select(F.col("row").alias("src"), "dist")))
q("region_statistics", lambda n: S.region_statistics(n.points, n.types.select("id", F.col("type").alias("region"))), with_("pts ty") + "SELECT type AS region, count(*) AS n, avg(x) AS cx, avg(y) AS cy, sqrt(var_pop(x) + var_pop(y)) AS spread FROM pts JOIN ty USING (id) GROUP BY 1", "cx cy spread", "region n")
q("morphological_features", lambda n: S.morphology(n.points, n.types.select("id", F.col("type").alias("label"))))
# --- velocity ----------------------------------------------------------------
KIN = with_("m m2 ri cj") + ", k AS (SELECT cj.j AS j, coalesce(sum(m.v), 0) / max(n) AS ms, coalesce(sum(m2.v), 0) / max(n) AS mu, coalesce(sum(m.v * m.v), 0) / max(n) AS qs, coalesce(sum(m2.v * m2.v), 0) / max(n) AS qu, coalesce(sum(m.v * m2.v), 0) / max(n) AS xy FROM cj LEFT JOIN m ON m.j = cj.j LEFT JOIN m2 ON m2.i = m.i AND m2.j = m.j CROSS JOIN nr GROUP BY 1), kf AS (SELECT j, greatest(1e-10, (xy - ms * mu) / (qs - ms * ms)) AS gamma, power(xy - ms * mu, 2) / ((qs - ms * ms) * (qu - mu * mu)) AS r2 FROM k) "
q("fit_gene_kinetics", lambda n: V.fit_kinetics(n.m, n.m2), KIN + "SELECT j AS col, gamma, r2 FROM kf", "gamma r2", "col")
q("compute_velocity", lambda n: V.compute_velocity(n.m, n.m2, V.fit_kinetics(n.m, n.m2)), KIN + 'SELECT m.i AS "row", m.j AS col, m2.v - gamma * m.v AS v FROM m JOIN m2 ON m2.i = m.i AND m2.j = m.j JOIN kf ON kf.j = m.j', "v", "row col", digits=5)
q("splice_ratio", lambda n: V.splice_ratio(n.m, n.m2), with_("m m2") + 'SELECT m.i AS "row", m.j AS col, m2.v / (m.v + 1e-10) AS ratio FROM m2 JOIN m ON m.i = m2.i AND m.j = m2.j', "ratio", "row col")
q("select_velocity_genes", lambda n: V.select_velocity_genes(V.compute_velocity(n.m, n.m2, V.fit_kinetics(n.m, n.m2)), V.fit_kinetics(n.m, n.m2), n.m.n_rows, 0.6), KIN + "SELECT j AS col FROM kf WHERE r2 >= 0.6", "", "col")
_vel = lambda n: n.expr.entries.select("row", "col", (F.col("v") - 0.1).alias("v"))
VL = NB + ", vl AS (SELECT vec_id AS i, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN v > 0 THEN v - 0.1 ELSE 0 END) AS v, list_transform(CAST(embedding AS DOUBLE[]), lambda v: greatest(v, 0)) AS x FROM embeddings), vc AS (SELECT nb.i AS i, nb.k AS k, coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 0), 0) AS c, greatest(0, coalesce((list_dot_product(a.v, b.x) - list_dot_product(a.v, a.x)) / nullif(sqrt(list_dot_product(a.v, a.v)) * list_distance(a.x, b.x), 0), 0)) AS g FROM nb JOIN vl a ON a.i = nb.i JOIN vl b ON b.i = nb.k) "
q("velocity_graph", lambda n: V.velocity_graph(_vel(n), n.expr.entries, n.nbrs), VL + "SELECT i AS src, k AS dst, exp(g) / sum(exp(g)) OVER (PARTITION BY i) AS w FROM vc", "w", "src dst", digits=5)
q("velocity_graph_cosine", lambda n: V.velocity_graph_cosine(_vel(n), n.nbrs), VL + "SELECT i AS src, k AS dst, (c + 1) / sum(c + 1) OVER (PARTITION BY i) AS w FROM vc", "w", "src dst")
q("velocity_confidence", lambda n: V.velocity_confidence(_vel(n), n.nbrs), VL + 'SELECT i AS "row", avg(c) AS confidence FROM vc GROUP BY 1', "confidence", "row")
q("boundary_detection", lambda n: S.boundary_detection(n.nbrs.select("row", "nbr"), n.expr), VL.replace(", vc AS", ", unused AS") + ', bd AS (SELECT nb.i AS i, avg(list_distance(a.x, b.x)) AS m FROM nb JOIN vl a ON a.i = nb.i JOIN vl b ON b.i = nb.k GROUP BY 1) SELECT i AS "row", m / max(m) OVER () AS score FROM bd', "score", "row", digits=5)
q("velocity_embedding", lambda n: V.velocity_embedding(n.long_vectors.withColumnRenamed("id", "row"), n.nbrs), with_("nb lv") + 'SELECT i AS "row", a.dim AS dim, avg(b.x - a.x) AS x FROM nb JOIN lv a ON a.id = i JOIN lv b ON b.id = k AND b.dim = a.dim GROUP BY 1, 2', "x", "row dim")
q("velocity_grid", lambda n: V.velocity_grid(n.points, n.values.select("id", F.col("value").alias("vx"), (-F.col("value")).alias("vy")), 6), with_("pts val") + ", c AS (SELECT least(5, floor((x - min(x) OVER ()) / ((max(x) OVER () - min(x) OVER ()) / 6))) AS gx, least(5, floor((y - min(y) OVER ()) / ((max(y) OVER () - min(y) OVER ()) / 6))) AS gy, value FROM pts JOIN val USING (id)) SELECT gx, gy, avg(value) AS vx, avg(-value) AS vy, count(*) AS n FROM c GROUP BY 1, 2", "vx vy", "gx gy n")
q("velocity_divergence", lambda n: V.velocity_divergence(n.points, n.values.select("id", F.col("value").alias("vx"), (-F.col("value")).alias("vy")), n.nbrs), with_("nb pts val") + 'SELECT nb.i AS "row", coalesce(avg(((y.value - x.value) * (b.x - a.x) - (y.value - x.value) * (b.y - a.y)) / nullif(power(b.x - a.x, 2) + power(b.y - a.y, 2), 0)), 0) AS divergence FROM nb JOIN pts a ON a.id = nb.i JOIN pts b ON b.id = nb.k JOIN val x ON x.id = nb.i JOIN val y ON y.id = nb.k GROUP BY 1', "divergence", "row", digits=5)
q("select_root_by_velocity", lambda n: V.select_root_by_velocity(n.graph), E + "SELECT id FROM nd LEFT JOIN e ON dst = id GROUP BY id ORDER BY coalesce(sum(w), 0), id LIMIT 1", "", "id")
q("latent_time", lambda n: V.latent_time(n.graph, 0), E + _relaxed("greatest(-ln(w), 1e-12)", "0") + TIME + "SELECT * FROM pt", "t", "id")
q("velocity_pseudotime", lambda n: V.velocity_pseudotime(n.graph, 0), E + ", vm AS (SELECT id, 0.0::DOUBLE AS v FROM nd)" + _relaxed("greatest(-ln(w), 1e-12)", "0") + TIME + _smoothed("w", 10) + "SELECT * FROM ft", "t", "id")
q("predict_future_state", lambda n: V.predict_future(Graph(G.row_stochastic(n.graph), n.graph.nodes), 2))
q("velocity_terminals", lambda n: V.velocity_terminals(n.graph, n.values.select("id", F.abs("value").alias("value")), 0.3, 3.0))
# --- communities, randomised, optimisation -----------------------------------
q("louvain", lambda n: C.louvain(n.graph, max_levels=2, max_rounds=4))
q("leiden", lambda n: C.leiden(n.graph))
q("kmeans", lambda n: C.kmeans(n.long_vectors, 4, 8))
q("spatial_domain", lambda n: C.spatial_domains(n.points, n.long_vectors, 3))
_away = lambda n: n.graph.edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), (1 / F.col("w") - 1).alias("d"))
q("hierarchical_clustering", lambda n: L.hierarchical(_away(n)))
q("cut_tree", lambda n: L.cut_tree(L.hierarchical(_away(n)), n.graph.nodes, 1.2))
q("detect_modules", lambda n: L.detect_modules(_away(n), n.graph.nodes, 1.2, 2))
q("blockwise_modules", lambda n: L.blockwise_modules(n.expr, 40, 1.0, 0.97, 2))
for _k in ("gaussian", "achlioptas", "sparse", "countsketch", "feature_hash"):
    q(f"project_{_k}", lambda n, k=_k: R.project(n.m, 16, k))
q("uniform_sampling", lambda n: R.uniform_sample(n.vectors.select("id"), 50))
q("importance_sampling", lambda n: R.importance_sample(n.p.select("id", F.col("p").alias("w")), 100))
q("systematic_sampling", lambda n: R.systematic_sample(n.p.select("id", F.col("p").alias("w")), 100))
q("balanced_sampling", lambda n: R.balanced_sample(n.vectors.select("id", "label"), 50))
q("stratified_sampling", lambda n: R.stratified_sample(n.values, 5, 50))
q("geometric_sketching", lambda n: R.geometric_sketch(n.long_vectors, 50, 4))
q("landmark_selection", lambda n: R.landmarks(n.long_vectors, 4))
q("density_preserving", lambda n: R.density_preserving(G.degree_sequence(n.graph), 50))
q("reservoir_sampling", lambda n: R.reservoir_sample(n.table("events").select(F.col("event_id").alias("id")), 100))
q("downsample", lambda n: R.downsample(n.m, 200.0))
q("binomial_resample", lambda n: R.binomial_resample(n.m, 0.5))
q("poisson_resample", lambda n: R.poisson_resample(n.m, 0.1))
q("rarefaction_diversity", lambda n: R.rarefaction(n.clones.select("id", "clone"), 300, 5))
q("batch_permutation_test", lambda n: R.permutation_test(n.ev, n.ev.rows.select("row", (F.col("row") % 2).alias("grp")), 20))
q("permutation_correlation_test", lambda n: R.permutation_correlation(n.points.select("id", "x", "y"), 20))
q("random_walk", lambda n: R.random_walks(n.graph.edges, n.spark.range(10).select(F.col("id").alias("walk"), "id"), 5))
q("current_flow_betweenness_approx", lambda n: R.visit_frequency(n.graph.edges, n.graph.nodes, 50, 5))
_ry = lambda n: n.expr.rows.join(n.expr.entries.where("col = 0").select("row", "v"), "row", "left").select("row", (3 * F.coalesce("v", F.lit(0.0))).alias("y"))
q("prox_l1", lambda n: O.prox_l1(n.values.select("id", F.col("value").alias("x")), 0.05), with_("val") + "SELECT id, sign(value) * greatest(0, abs(value) - 0.05) AS x FROM val", "x", "id")
q("prox_elastic_net", lambda n: O.prox_elastic_net(n.values.select("id", F.col("value").alias("x")), 0.1, 0.5), with_("val") + "SELECT id, sign(value) * greatest(0, abs(value) - 0.05) / 1.05 AS x FROM val", "x", "id")
q("fista", lambda n: O.fista(n.expr, _ry(n), 0.5, max_iter=30))
q("iht", lambda n: O.iht(n.expr, _ry(n), 2, 20))
q("group_lasso", lambda n: O.group_lasso(n.expr, _ry(n), n.expr.cols.select("col", (F.col("col") % 2).alias("grp")), 0.5, 20))
q("sparse_logistic_regression", lambda n: O.sparse_logistic(n.expr, n.expr.rows.select("row", (F.col("row") % 2).cast("double").alias("y")), 0.5, 20))
