"""Queries of set scores, enrichment, markers, annotation, communication and column networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import permute as U
from ..operators import robust as B
from ..operators import signatures as S
from .base import q
from .inputs import CTE, with_

MS = with_("m ri cj sets")
_w = lambda n: n.sets.withColumn("weight", F.lit(1.0) + F.col("col") % 3)
SUM = MS + ", ids AS (SELECT DISTINCT set_id FROM sets), sz AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), s AS (SELECT ids.set_id AS set_id, ri.i AS i, coalesce(sum(v), 0) AS s, count(v) AS k FROM ids CROSS JOIN ri LEFT JOIN (SELECT sets.set_id, m.i, v FROM m JOIN sets USING (j)) x ON x.set_id = ids.set_id AND x.i = ri.i GROUP BY 1, 2), e AS (SELECT set_id, i, CASE WHEN k > 0 THEN s / k ELSE 0 END AS e FROM s) "
q("mean_score", lambda n: S.mean_score(n.m, n.sets), SUM + 'SELECT set_id, i AS "row", s / n AS score FROM s JOIN sz USING (set_id)', "score", "set_id row")
q("expressed_mean_score", lambda n: S.expressed_mean_score(n.m, n.sets), SUM + 'SELECT set_id, i AS "row", e AS score FROM e', "score", "set_id row")
q("state_score", lambda n: S.state_score(n.m, n.sets), SUM + 'SELECT set_id, i AS "row", (e - avg(e) OVER (PARTITION BY set_id)) / stddev_pop(e) OVER (PARTITION BY set_id) AS score FROM e', "score", "set_id row")
WS = MS + ', ids AS (SELECT set_id, sum(1 + j % 3) AS t FROM sets GROUP BY 1), x AS (SELECT set_id, m.i, sum(v * (1 + j % 3)) AS s FROM m JOIN sets USING (j) GROUP BY 1, 2), w AS (SELECT ids.set_id AS set_id, ri.i AS "row", coalesce(s, 0) / t AS score FROM ids CROSS JOIN ri LEFT JOIN x ON x.set_id = ids.set_id AND x.i = ri.i) '
q("weighted_score", lambda n: S.weighted_score(n.m, _w(n)), WS + "SELECT * FROM w", "score", "set_id row")
q("signature_score", lambda n: S.signature_score(n.m, _w(n)), WS + "SELECT set_id, \"row\", coalesce((score - avg(score) OVER (PARTITION BY set_id)) / nullif(stddev_pop(score) OVER (PARTITION BY set_id), 0), 0) AS score FROM w", "score", "set_id row")
q("zscore_score", lambda n: S.zscore_score(n.m, n.sets), MS + ', d AS (SELECT ri.i, cj.j, coalesce(v, 0) AS v FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j), z AS (SELECT i, j, (v - avg(v) OVER (PARTITION BY j)) / nullif(stddev_pop(v) OVER (PARTITION BY j), 0) AS z FROM d) SELECT set_id, i AS "row", avg(coalesce(z, 0)) AS score FROM z JOIN sets USING (j) GROUP BY 1, 2', "score", "set_id row", digits=5)
q("auc_score", lambda n: S.auc_score(n.m, n.sets, 0.2), SUM + ', r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM m WHERE v > 0), h AS (SELECT set_id, i, count(*) AS h FROM r JOIN sets USING (j) WHERE r <= ceil(0.2 * (SELECT n FROM nc)) GROUP BY 1, 2) SELECT s.set_id AS set_id, s.i AS "row", coalesce(h, 0) / n AS score FROM s JOIN sz USING (set_id) LEFT JOIN h ON h.set_id = s.set_id AND h.i = s.i', "score", "set_id row")
q("quantile_score", lambda n: S.quantile_score(n.m, n.sets, 0.75), MS + ', l AS (SELECT set_id, ri.i AS i, list_sort(list(coalesce(v, 0))) AS l FROM sets CROSS JOIN ri LEFT JOIN m ON m.i = ri.i AND m.j = sets.j GROUP BY 1, 2) SELECT set_id, i AS "row", l[CAST(floor(0.75 * (len(l) - 1)) AS INT) + 1] AS score FROM l', "score", "set_id row")
q("module_score", lambda n: S.module_score(n.m, n.sets))
q("cell_cycle_score", lambda n: S.cell_cycle(n.m, n.m.cols.where("col % 9 = 0"), n.m.cols.where("col % 9 = 1")))
q("differential_score", lambda n: S.score_difference(n.m, n.m.cols.where("col % 9 = 0"), n.m.cols.where("col % 9 = 1")), MS + ', x AS (SELECT i, sum(CASE WHEN j % 9 = 0 THEN v ELSE 0 END) AS a, sum(CASE WHEN j % 9 = 1 THEN v ELSE 0 END) AS b FROM m GROUP BY 1) SELECT ri.i AS "row", coalesce(a, 0) / (SELECT count(*) FROM cj WHERE j % 9 = 0) - coalesce(b, 0) / (SELECT count(*) FROM cj WHERE j % 9 = 1) AS score FROM ri LEFT JOIN x ON x.i = ri.i', "score", "row")
q("differentiation_potential", lambda n: S.differentiation_potential(n.m), with_("m ri cj") + ', y AS (SELECT ri.i, CAST(count(v) AS DOUBLE) AS y FROM ri LEFT JOIN m ON m.i = ri.i GROUP BY 1), r AS (SELECT cj.j, abs(corr(coalesce(v, 0), y)) AS r FROM cj CROSS JOIN y LEFT JOIN m ON m.i = y.i AND m.j = cj.j GROUP BY 1), t AS (SELECT j, r FROM r ORDER BY r DESC, j LIMIT (SELECT greatest(10, least(200, CAST(n AS BIGINT) // 10)) FROM nc)), s AS (SELECT y.i, coalesce(sum(v * r), 0) / (SELECT sum(r) FROM t) AS s FROM y LEFT JOIN (SELECT m.i, v, r FROM m JOIN t USING (j)) x ON x.i = y.i GROUP BY 1) SELECT i AS "row", (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS score FROM s', "score", "row")
q("transcriptional_diversity", lambda n: S.transcriptional_diversity(n.m), with_("m ri") + 'SELECT ri.i AS "row", coalesce(1 - sum(v * v) / power(sum(v), 2), 0) AS score FROM ri LEFT JOIN m ON m.i = ri.i AND v > 0 GROUP BY 1', "score", "row")
q("expression_complexity", lambda n: S.expression_complexity(n.m, 20.0), with_("m ri cj") + 'SELECT ri.i AS "row", count(v) / max(n) AS score FROM ri LEFT JOIN m ON m.i = ri.i AND v > 20 CROSS JOIN nc GROUP BY 1', "score", "row")
_ranked = lambda n: n.m.cols.select("col", (F.col("col") + 1).alias("rank"), (F.lit(100.0) - F.col("col")).alias("score"))
RK = with_("cj sets") + ", d AS (SELECT ids.set_id, j, j + 1 AS rank, abs(100.0 - j) AS w, EXISTS (SELECT 1 FROM sets x WHERE x.set_id = ids.set_id AND x.j = cj.j) AS h FROM cj CROSS JOIN (SELECT DISTINCT set_id FROM sets) ids), rs AS (SELECT set_id, j, rank, h, sum(CASE WHEN h THEN w / t ELSE -1.0 / (n - c) END) OVER (PARTITION BY set_id ORDER BY rank) AS s FROM (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY set_id) AS c, sum(CASE WHEN h THEN w ELSE 0 END) OVER (PARTITION BY set_id) AS t, count(*) OVER (PARTITION BY set_id) AS n FROM d)), es AS (SELECT set_id, s AS es, rank AS peak FROM rs QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY round(abs(s), 9) DESC, rank) = 1) "
q("enrichment_score", lambda n: S.enrichment_score(_ranked(n), n.sets).select("set_id", "es"), RK + "SELECT set_id, es FROM es", "es", "set_id")
q("gsea_running_sum", lambda n: S.running_sum(_ranked(n), n.sets).select("set_id", "rank", "s"), with_("cj sets") + ", d AS (SELECT ids.set_id, j + 1 AS rank, EXISTS (SELECT 1 FROM sets x WHERE x.set_id = ids.set_id AND x.j = cj.j) AS h FROM cj CROSS JOIN (SELECT DISTINCT set_id FROM sets) ids) SELECT set_id, rank, sum(CASE WHEN h THEN 1.0 / c ELSE -1.0 / (n - c) END) OVER (PARTITION BY set_id ORDER BY rank) AS s FROM (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY set_id) AS c, count(*) OVER (PARTITION BY set_id) AS n FROM d)", "s", "set_id rank")
q("gsea", lambda n: S.gsea(_ranked(n), n.sets, 20))
q("leading_edge_genes", lambda n: S.leading_edge(_ranked(n), n.sets), RK + "SELECT set_id, j AS col FROM rs JOIN es USING (set_id) WHERE h AND ((es >= 0 AND rank <= peak) OR (es < 0 AND rank >= peak))", "", "set_id col")
LC = lambda a, b: f"(lgamma({a} + 1) - lgamma({b} + 1) - lgamma(({a}) - ({b}) + 1))"
OT = with_("cj sets") + f", sz AS (SELECT set_id, CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (WHERE j % 3 = 0) AS DOUBLE) AS k FROM sets GROUP BY 1), t AS (SELECT set_id, k, m, CAST((SELECT count(*) FROM cj WHERE j % 3 = 0) AS DOUBLE) AS n, nc.n AS t FROM sz, nc), h AS (SELECT set_id, k, m, n, t, CASE WHEN k <= 0 THEN 1.0 ELSE (SELECT least(1, sum(exp({LC('m', 'i')} + {LC('(t - m)', '(n - i)')} - {LC('t', 'n')}))) FROM (SELECT unnest(range(CAST(k AS BIGINT), CAST(least(n, m) AS BIGINT) + 1)) AS i) WHERE n - i <= t - m) END AS p FROM t) "
_chosen = lambda n: n.m.cols.where("col % 3 = 0")
q("ora_batch", lambda n: S.ora(n.sets, _chosen(n), n.m.n_cols), OT + "SELECT set_id, k AS overlap, p, coalesce(k * (t - n - m + k) / nullif((n - k) * (m - k), 0), 1e285) AS odds, coalesce(k * t / nullif(n * m, 0), 0) AS fold FROM h", "p odds fold", "set_id overlap")
q("ora_single_set", lambda n: S.ora(n.sets.where("set_id = 3"), _chosen(n), n.m.n_cols).select("overlap", "p"), OT + "SELECT k AS overlap, p FROM h WHERE set_id = 3", "p", "overlap")
_table2 = lambda n: n.p.select("id", *[(F.col("id") % k + 1).alias(c) for c, k in zip("abcd", (5, 7, 4, 9))])
ABCD = "WITH x AS (SELECT p_partkey AS id, p_partkey % 5 + 1 AS a, p_partkey % 7 + 1 AS b, p_partkey % 4 + 1 AS c, p_partkey % 9 + 1 AS d FROM part) "
q("odds_ratio", lambda n: _table2(n).select("id", S.odds_ratio(*(F.col(c) for c in "abcd")).alias("odds")), ABCD + "SELECT id, a * d / (b * c) AS odds FROM x", "odds", "id")
for _n in ("fisher_exact_test", "hypergeometric_test"):
    q(_n, lambda n: _table2(n).select("id", S.fisher_greater(*(F.col(c) for c in "abcd")).alias("p")), ABCD + f"SELECT id, (SELECT sum(exp({LC('(a + c)', 'i')} + {LC('(b + d)', '(a + b - i)')} - {LC('(a + b + c + d)', '(a + b)')})) FROM (SELECT unnest(range(a, least(a + b, a + c) + 1)) AS i) WHERE a + b - i <= b + d) AS p FROM x", "p", "id")
def _ssgsea_sql(exponent: float) -> str:
    return with_("m ri cj sets") + f", f AS (SELECT ri.i AS i, cj.j AS j, row_number() OVER (PARTITION BY ri.i ORDER BY coalesce(v, 0) DESC, cj.j) AS r FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j), h AS (SELECT f.i, f.j, r, s.set_id, EXISTS (SELECT 1 FROM sets x WHERE x.set_id = s.set_id AND x.j = f.j) AS h, power((SELECT count(*) FROM cj) - r + 1, {exponent}) AS w FROM f CROSS JOIN (SELECT DISTINCT set_id FROM sets) s), s AS (SELECT i, set_id, r, sum(CASE WHEN h THEN w / t ELSE -1.0::DOUBLE / ((SELECT count(*) FROM cj) - c) END) OVER (PARTITION BY i, set_id ORDER BY r) AS s FROM (SELECT *, sum(CASE WHEN h THEN w ELSE 0 END) OVER (PARTITION BY i, set_id) AS t, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY i, set_id) AS c FROM h)) SELECT i AS \"row\", set_id, s AS es FROM s QUALIFY row_number() OVER (PARTITION BY i, set_id ORDER BY round(abs(s), 9) DESC, r) = 1"


q("ssgsea", lambda n: S.ssgsea(n.m, n.sets), _ssgsea_sql(0.25), "es", "row set_id")
q("gsva_score", lambda n: S.gsva(n.m, n.sets), _ssgsea_sql(0.0), "es", "row set_id")
for _k, _f in (("median", U.median_difference), ("ks", U.ks_statistic)):
    q(f"permutation_test_{_k}", lambda n, f=_f: U.permutation_test(n.ev, n.ev.rows.select("row", (F.col("row") % 2).alias("grp")), f, 50))
_sets2 = lambda n: n.sets.unionByName(n.sets.select(F.col("set_id") + 100, F.col("col")).toDF("set_id", "col").where("col % 2 = 0"))
q("enrichment_map", lambda n: S.set_overlap(_sets2(n)), with_("sets") + ", s AS (SELECT set_id, j FROM sets UNION ALL SELECT set_id + 100, j FROM sets WHERE j % 2 = 0), k AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1) SELECT x.set_id AS a, y.set_id AS b, count(*) AS overlap, count(*) / (max(p.n) + max(q.n) - count(*)) AS jaccard FROM s x JOIN s y ON x.j = y.j AND x.set_id < y.set_id JOIN k p ON p.set_id = x.set_id JOIN k q ON q.set_id = y.set_id GROUP BY 1, 2", "jaccard", "a b overlap")
q("find_unique_markers", lambda n: S.unique_members(_sets2(n), 3), with_("sets") + "SELECT j AS col FROM sets WHERE set_id = 3 AND j % 2 = 1", "", "col")
GM = with_("m cj g") + ", gm AS (SELECT c.j AS j, c.grp AS grp, max(c.n) AS n, coalesce(sum(v), 0) / max(c.n) AS mean, count(CASE WHEN v > 0 THEN 1 END) / max(c.n) AS pct FROM (SELECT j, grp, n FROM cj CROSS JOIN (SELECT grp, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1)) c LEFT JOIN (SELECT m.j, g.grp, v FROM m JOIN g USING (i)) x ON x.j = c.j AND x.grp = c.grp GROUP BY 1, 2) "
q("group_mean_expression", lambda n: S.group_means(n.m, n.groups), GM + "SELECT j AS col, grp, mean FROM gm", "mean", "col grp")
q("percent_expressed", lambda n: S.percent_expressed(n.m, n.groups), GM + "SELECT j AS col, grp, pct FROM gm", "pct", "col grp")
q("log_fold_change", lambda n: S.log_fold_change(n.m, n.groups, 1), GM + "SELECT j AS col, log2(max(CASE WHEN grp = 1 THEN mean END) + 1) - log2(avg(CASE WHEN grp <> 1 THEN mean END) + 1) AS lfc FROM gm GROUP BY 1", "lfc", "col")
q("one_vs_rest_stats", lambda n: S.one_vs_rest(n.m, n.groups, 1).select("col", "lfc", "pct_in", "pct_out"), GM + "SELECT j AS col, log2((max(CASE WHEN grp = 1 THEN mean END) + 1) / (sum(CASE WHEN grp <> 1 THEN mean * n END) / sum(CASE WHEN grp <> 1 THEN n END) + 1)) AS lfc, max(CASE WHEN grp = 1 THEN pct END) AS pct_in, sum(CASE WHEN grp <> 1 THEN pct * n END) / sum(CASE WHEN grp <> 1 THEN n END) AS pct_out FROM gm GROUP BY 1", "lfc pct_in pct_out", "col")
GV = GM.rstrip() + ", gv AS (SELECT c.j AS j, c.grp AS grp, max(c.n) AS n, coalesce(sum(v), 0) AS s, coalesce(sum(v * v), 0) AS q, CAST(count(CASE WHEN v > 0 THEN 1 END) AS DOUBLE) AS k FROM (SELECT j, grp, n FROM cj CROSS JOIN (SELECT grp, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1)) c LEFT JOIN (SELECT m.j, g.grp, v FROM m JOIN g USING (i)) x ON x.j = c.j AND x.grp = c.grp GROUP BY 1, 2), vr AS (SELECT j, grp, n AS n1, s / n AS m1, (q - s * s / n) / (n - 1) AS v1, k / n AS p1, sum(n) OVER w - n AS n0, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS m0, (sum(q) OVER w - q - power(sum(s) OVER w - s, 2) / (sum(n) OVER w - n)) / (sum(n) OVER w - n - 1) AS v0, (sum(k) OVER w - k) / (sum(n) OVER w - n) AS p0 FROM gv WINDOW w AS (PARTITION BY j)), ve AS (SELECT *, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS e, log2((m1 + 1) / (m0 + 1)) AS lfc FROM vr) "
for _n, _m, _e, _t in (("rank_genes_groups", "combined", "e * greatest(p1 - p0, 0.01)", 5), ("rank_genes_by_score", "effect", "e", 1000), ("top_n_markers", "fold_change", "lfc", 3)):
    q(_n, lambda n, m=_m, t=_t: S.rank_groups(n.m, n.groups, m, t), GV + f"SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY round({_e}, 9) DESC, j) AS rank, j AS col, {_e} AS score FROM ve QUALIFY rank <= {_t}", "score", "grp rank col", digits=5)
q("tau_specificity", lambda n: S.tau_specificity(S.group_means(n.m, n.groups)), GM + "SELECT j AS col, CASE WHEN max(mean) > 0 THEN (count(*) - sum(mean) / max(mean)) / (count(*) - 1) ELSE 0 END AS tau FROM gm GROUP BY 1", "tau", "col")
q("gini_specificity", lambda n: S.gini_specificity(S.group_means(n.m, n.groups)), GM + ", r AS (SELECT j, mean, row_number() OVER (PARTITION BY j ORDER BY mean, grp) AS r FROM gm) SELECT j AS col, coalesce(2 * sum(r * mean) / (count(*) * nullif(sum(mean), 0)) - (count(*) + 1) / count(*), 0) AS gini FROM r GROUP BY 1", "gini", "col")
q("filter_markers", lambda n: S.filter_markers(S.one_vs_rest(n.m, n.groups, 1), 1.02, 0.1), GV + "SELECT j AS col FROM ve WHERE grp = 1 AND lfc >= log2(1.02) AND p1 >= 0.1", "", "col")
q("volcano_score", lambda n: S.volcano(S.one_vs_rest(n.m, n.groups, 1)), GV + "SELECT j AS col, 0.5 * lfc + 0.5 * e AS score FROM ve WHERE grp = 1", "score", "col", digits=5)
PF = with_("ev") + ", pr AS (SELECT grp, cj.j AS j, coalesce(sum(v), 0) / max(n) AS mean FROM (SELECT i % 3 AS grp, CAST(count(*) AS DOUBLE) AS n FROM ri GROUP BY 1) gs CROSS JOIN cj LEFT JOIN m ON m.i % 3 = grp AND m.j = cj.j GROUP BY 1, 2), pc AS (SELECT ri.i AS i, grp, coalesce(corr(coalesce(v, 0), mean), 0) AS r FROM ri CROSS JOIN pr LEFT JOIN m ON m.i = ri.i AND m.j = pr.j GROUP BY 1, 2), ca AS (SELECT i, grp, r FROM pc QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(r, 9) DESC, grp) = 1) "
_g3 = lambda n: n.ev.rows.select("row", (F.col("row") % 3).alias("grp"))
q("build_reference_profiles", lambda n: S.reference_profiles(n.ev, _g3(n)), PF + "SELECT grp, j AS col, mean FROM pr", "mean", "grp col")
q("profile_correlation", lambda n: S.profile_correlation(n.ev, S.reference_profiles(n.ev, _g3(n))), PF + 'SELECT i AS "row", grp, r FROM pc', "r", "row grp")
q("correlation_assignment", lambda n: S.correlation_assignment(n.ev, S.reference_profiles(n.ev, _g3(n))), PF + 'SELECT i AS "row", grp, r AS score FROM ca', "score", "row grp")
MG = with_("ev") + ", mg AS (SELECT ri.i AS i, s.grp AS grp, coalesce(sum(v), 0) / max(s.n) AS score FROM ri CROSS JOIN (SELECT j % 2 AS grp, count(*) AS n FROM cj GROUP BY 1) s LEFT JOIN m ON m.i = ri.i AND m.j % 2 = s.grp GROUP BY 1, 2), sm AS (SELECT i, grp, exp(score - max(score) OVER (PARTITION BY i)) AS e FROM mg), pm AS (SELECT i, grp, e / sum(e) OVER (PARTITION BY i) AS score FROM sm) "
_mk = lambda n: n.ev.cols.select((F.col("col") % 2).alias("set_id"), "col")
q("marker_gene_score", lambda n: S.marker_scores(n.ev, _mk(n)), MG + 'SELECT i AS "row", grp, score FROM pm', "score", "row grp")
q("assign_from_marker_scores", lambda n: S.best_label(S.marker_scores(n.ev, _mk(n), False), "score"), MG + 'SELECT i AS "row", grp, score FROM mg QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, grp) = 1', "score", "row grp")
q("annotation_entropy", lambda n: S.annotation_entropy(S.marker_scores(n.ev, _mk(n))), MG + 'SELECT i AS "row", sum(CASE WHEN score > 1e-15 THEN -score * ln(score) ELSE 0 END) / ln(count(*)) AS h FROM pm GROUP BY 1', "h", "row")
q("detect_novel_types_by_distance", lambda n: S.novel_by_distance(n.m, S.reference_profiles(n.m, n.groups), n.groups), GM + ', nv AS (SELECT g.i, 1 - coalesce(sum(v * mean), 0) / nullif(sqrt(sum(v * v)) * max(pn), 0) AS dist FROM g LEFT JOIN m ON m.i = g.i LEFT JOIN gm ON gm.j = m.j AND gm.grp = g.grp LEFT JOIN (SELECT grp, sqrt(sum(mean * mean)) AS pn FROM gm GROUP BY 1) p ON p.grp = g.grp GROUP BY 1) SELECT i AS "row", coalesce(dist, 1) AS dist, coalesce(dist, 1) > 0.3 AS novel FROM nv', "dist", "row", digits=5)
q("cis_regulatory", lambda n: S.cis_regulatory(n.m, n.m2, n.m.cols.select("col", F.col("col").alias("other"))).select("col", "other", "r"), with_("m m2 ri cj") + ", d AS (SELECT cj.j, coalesce(m.v, 0) AS x, coalesce(m2.v, 0) AS y FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j LEFT JOIN m2 ON m2.i = ri.i AND m2.j = cj.j) SELECT j AS col, j AS other, corr(x, y) AS r FROM d GROUP BY j", "r", "col other")
CX = with_("ev") + ", x AS (SELECT ri.i AS i, cj.j AS j, coalesce(v, 0) AS v FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j), rk AS (SELECT i, j, v, rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2 AS r FROM x), cc AS (SELECT a.j AS a, b.j AS b, coalesce(corr(a.v, b.v), 0) AS r, coalesce(corr(a.r, b.r), 0) AS s FROM rk a JOIN rk b ON a.i = b.i GROUP BY 1, 2) "
q("gene_peak_correlation", lambda n: S.cross_correlation(n.ev, n.ev, 0.1), CX + "SELECT a AS col, b AS other, r FROM cc WHERE abs(r) >= 0.1", "r", "col other")
q("enhancer_gene_link", lambda n: S.enhancer_links(n.ev, n.ev, 0.1, 2), CX + "SELECT a AS col, b AS other, r FROM cc WHERE r >= 0.1 QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 2", "r", "col other")
q("correlation_in_subset", lambda n: S.correlation_in_subset(n.ev, 0, n.ev, 1, n.ev.rows.where("row % 2 = 0")), CX + "SELECT corr(a.v, b.v) AS r FROM x a JOIN x b ON a.i = b.i WHERE a.j = 0 AND b.j = 1 AND a.i % 2 = 0", "r")
q("peak_to_gene_activity", lambda n: S.peak_activity(n.m, n.m.cols.select("col", (F.col("col") % 7 - 1).alias("gene"))), with_("m") + 'SELECT i AS "row", j % 7 - 1 AS gene, sum(v) AS v FROM m WHERE j % 7 > 0 GROUP BY 1, 2', "v", "row gene")
q("feature_coupling", lambda n: S.feature_coupling(n.ev, n.ev), CX + "SELECT a AS col, b AS other, s AS r FROM cc", "r", "col other")
_pairs = lambda n: n.spark.createDataFrame([(0, 0, 1), (1, 2, 3)], "pair long, ligand long, receptor long")
q("lr_score_matrix", lambda n: S.lr_scores(n.m, n.groups, _pairs(n)), GM + "SELECT p AS pair, a.grp AS sender, b.grp AS receiver, a.mean * b.mean AS score FROM (VALUES (0, 0, 1), (1, 2, 3)) t(p, l, r) JOIN gm a ON a.j = l JOIN gm b ON b.j = r", "score", "pair sender receiver")
q("expression_specificity", lambda n: S.specificity(n.m, n.groups), GM + "SELECT j AS col, grp, coalesce(mean / nullif(sum(mean) OVER (PARTITION BY j), 0), 0) AS share FROM gm", "share", "col grp")
q("natmi_edge_weight", lambda n: S.natmi(n.m, n.groups, _pairs(n)), GM + ", sp AS (SELECT j, grp, mean * coalesce(mean / nullif(sum(mean) OVER (PARTITION BY j), 0), 0) AS ms FROM gm) SELECT p AS pair, a.grp AS sender, b.grp AS receiver, a.ms * b.ms AS weight FROM (VALUES (0, 0, 1), (1, 2, 3)) t(p, l, r) JOIN sp a ON a.j = l JOIN sp b ON b.j = r", "weight", "pair sender receiver", digits=5)
q("lr_permutation_test", lambda n: S.lr_permutation(n.m, n.groups, _pairs(n), 10))
LS = GM + ", lr AS (SELECT p AS pair, a.grp AS sender, b.grp AS receiver, a.mean * b.mean AS score FROM (VALUES (0, 0, 1), (1, 2, 3)) t(p, l, r) JOIN gm a ON a.j = l JOIN gm b ON b.j = r) "
q("network_centrality", lambda n: S.network_centrality(S.lr_scores(n.m, n.groups, _pairs(n)).where("pair = 0").withColumnRenamed("score", "weight")), LS + ", w AS (SELECT sender AS i, receiver AS j, score AS w FROM lr WHERE pair = 0), bt AS (SELECT x.j AS grp, sum(x.w * y.w / (x.w * y.w + z.w)) AS b FROM w x JOIN w y ON y.i = x.j JOIN w z ON z.i = x.i AND z.j = y.j WHERE x.i <> y.j AND x.i <> x.j AND y.j <> x.j GROUP BY 1) SELECT a.grp AS grp, in_strength, out_strength, b AS betweenness FROM (SELECT j AS grp, sum(w) AS in_strength FROM w GROUP BY 1) a JOIN (SELECT i AS grp, sum(w) AS out_strength FROM w GROUP BY 1) o ON o.grp = a.grp JOIN bt ON bt.grp = a.grp", "in_strength out_strength betweenness", "grp", digits=5)
for _m, _e in (("geometric_mean", "sqrt(greatest(0, a.mean * b.mean))"), ("min_mean", "least(a.mean, b.mean)"), ("product", "a.mean * b.mean")):
    q(f"lr_score_{_m}", lambda n, m=_m: S.lr_scores(n.m, n.groups, _pairs(n), m), GM + f"SELECT p AS pair, a.grp AS sender, b.grp AS receiver, {_e} AS score FROM (VALUES (0, 0, 1), (1, 2, 3)) t(p, l, r) JOIN gm a ON a.j = l JOIN gm b ON b.j = r", "score", "pair sender receiver", digits=5)
q("lr_score_batch", lambda n: S.lr_scores(n.m, n.groups, n.m.cols.where("col % 2 = 0").select((F.col("col") / 2).cast("long").alias("pair"), F.col("col").alias("ligand"), (F.col("col") + 1).alias("receptor"))), GM + "SELECT a.j // 2 AS pair, a.grp AS sender, b.grp AS receiver, a.mean * b.mean AS score FROM gm a JOIN gm b ON b.j = a.j + 1 WHERE a.j % 2 = 0", "score", "pair sender receiver", digits=5)
_scored = lambda n: S.lr_scores(n.m, n.groups, _pairs(n)).withColumn("p", ((F.col("sender") * 3 + F.col("receiver") * 5 + F.col("pair")) % 10) / 100)
LP = LS + ", sg AS (SELECT *, ((sender * 3 + receiver * 5 + pair) % 10) / 100 AS p FROM lr) "
q("filter_significant_interactions", lambda n: S.significant_interactions(_scored(n)).select("pair", "sender", "receiver", "score"), LP + "SELECT pair, sender, receiver, score FROM sg WHERE p < 0.05", "score", "pair sender receiver", digits=5)
q("aggregate_to_network", lambda n: S.aggregate_network(_scored(n)), LP + "SELECT sender, receiver, avg(score) AS weight, count(*) AS n FROM sg WHERE p < 0.05 GROUP BY 1, 2", "weight", "sender receiver n", digits=5)
q("sender_score", lambda n: S.role_score(n.m, n.groups, n.m.cols.where("col % 2 = 0")), GM + "SELECT grp, avg(mean) AS score FROM gm WHERE j % 2 = 0 GROUP BY 1", "score", "grp")
q("receiver_score", lambda n: S.role_score(n.m, n.groups, n.m.cols.where("col % 2 = 1")), GM + "SELECT grp, avg(mean) AS score FROM gm WHERE j % 2 = 1 GROUP BY 1", "score", "grp")
q("aggregate_to_pathways", lambda n: S.pathway_scores(S.lr_scores(n.m, n.groups, _pairs(n)), n.spark.range(2).select(F.col("id").alias("pair"), F.lit(7).alias("pathway"))), LS + "SELECT 7 AS pathway, sender, receiver, avg(score) AS score FROM lr GROUP BY 2, 3", "score", "pathway sender receiver", digits=5)
q("communication_probability", lambda n: S.communication_probability(n.m, n.groups, _pairs(n)), LS + "SELECT pair, sender, receiver, score / (0.5 + score) AS p FROM lr", "p", "pair sender receiver")
DC = with_("m g") + ", n AS (SELECT grp, i % 2 AS c, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1, 2), me AS (SELECT j, g.grp, m.i % 2 AS c, sum(v) / max(n) AS mean FROM m JOIN g USING (i) JOIN n ON n.grp = g.grp AND n.c = m.i % 2 WHERE j IN (0, 1, 2, 3) GROUP BY 1, 2, 3), fu AS (SELECT j, grp, c, coalesce(mean, 0) AS mean FROM (SELECT unnest(range(0, 4)) AS j) CROSS JOIN n LEFT JOIN me USING (j, grp, c)), sc AS (SELECT p AS pair, a.grp AS sender, b.grp AS receiver, sum(CASE WHEN a.c = 0 THEN a.mean * b.mean END) AS s0, sum(CASE WHEN a.c = 1 THEN a.mean * b.mean END) AS s1 FROM (VALUES (0, 0, 1), (1, 2, 3)) t(p, l, r) JOIN fu a ON a.j = l JOIN fu b ON b.j = r AND b.c = a.c GROUP BY 1, 2, 3) "
q("differential_communication", lambda n: S.differential_communication(n.m, n.groups, n.m.rows.select("row", (F.col("row") % 2).alias("cond")), _pairs(n)), DC + "SELECT pair, sender, receiver, s1 - s0 AS diff, log2((s1 + 1e-10) / (s0 + 1e-10)) AS log2_ratio FROM sc", "diff log2_ratio", "pair sender receiver", digits=4)
q("spatial_communication_score", lambda n: S.spatial_communication(n.expr, n.graph.edges, 0, 1), with_("nb e xp") + ', v AS (SELECT vec_id AS id, coalesce(max(CASE WHEN j = 0 THEN v END), 0) AS l, coalesce(max(CASE WHEN j = 1 THEN v END), 0) AS r FROM embeddings LEFT JOIN xp ON xp.i = vec_id AND j < 2 GROUP BY 1) SELECT src AS "row", sum(w * (a.l * b.r + b.l * a.r)) / sum(w) AS score FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst GROUP BY 1', "score", "row")
CN = with_("m ri cj") + ", x AS (SELECT ri.i AS i, cj.j AS j, coalesce(v, 0) AS v FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j), cr AS (SELECT a.j AS a, b.j AS b, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.i = b.i AND a.j < b.j GROUP BY 1, 2) "
q("correlation_network", lambda n: S.correlation_network(n.m, 0.1), CN + "SELECT a, b, r FROM cr WHERE abs(r) >= 0.1", "r", "a b")
q("correlation_network_sparse", lambda n: S.correlation_network(n.m, 0.02), CN + "SELECT a, b, r FROM cr WHERE abs(r) >= 0.02", "r", "a b")
q("partial_correlation_network", lambda n: S.partial_network(n.m, 0.05), CN + "SELECT a, b, -r / 1.01 AS r FROM cr WHERE abs(r / 1.01) >= 0.05", "r", "a b")
TT = CN + ", tt AS (SELECT a AS tf, b AS target, r FROM cr UNION ALL SELECT b, a, r FROM cr) "
q("tf_target_score", lambda n: S.tf_target_scores(n.m, n.m.cols), TT + "SELECT tf, target, r AS score FROM tt", "score", "tf target")
q("infer_grn", lambda n: S.tf_target_scores(n.m, n.m.cols, min_abs=0.05), TT + "SELECT tf, target, r AS score FROM tt WHERE abs(r) >= 0.05", "score", "tf target")
RG = TT + ", rg AS (SELECT tf, target, r FROM tt WHERE abs(r) >= 0.03 QUALIFY count(*) OVER (PARTITION BY tf) >= 2) "
_reg = lambda n: S.build_regulons(S.tf_target_scores(n.m, n.m.cols, min_abs=0.03), 0.03, 2)
q("build_regulons", lambda n: _reg(n), RG + "SELECT tf AS set_id, target AS col, r AS weight FROM rg", "weight", "set_id col")
q("regulon_activity", lambda n: S.regulon_activity(n.m, _reg(n)), RG + 'SELECT tf AS set_id, i AS "row", sum(abs(r) * v) / sum(abs(r)) AS score FROM rg JOIN x ON x.j = target GROUP BY 1, 2', "score", "set_id row")
q("regulon_auc_score", lambda n: S.regulon_auc(n.m, n.sets, 30.0), MS + ', sz AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM m WHERE v > 0), h AS (SELECT set_id, i, count(*) AS h FROM r JOIN sets USING (j) WHERE r <= floor((SELECT n FROM nc) * 0.3) GROUP BY 1, 2) SELECT sz.set_id AS set_id, ri.i AS "row", coalesce(h, 0) / sz.n AS score FROM sz CROSS JOIN ri LEFT JOIN h ON h.set_id = sz.set_id AND h.i = ri.i', "score", "set_id row")
NS = CN + ", u AS (SELECT a, b FROM cr WHERE abs(r) > 0.02), z AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), dg AS (SELECT a AS id, count(*) AS degree FROM z GROUP BY 1) "
q("network_statistics", lambda n: S.network_statistics(S.correlation_network(n.m, 0.0), 0.02), NS + "SELECT id, max(degree) AS degree, CASE WHEN max(degree) > 1 THEN count(t.a) / (max(degree) * (max(degree) - 1)) ELSE 0 END AS coefficient FROM dg LEFT JOIN (SELECT x.a, x.b, y.b AS c FROM z x JOIN z y ON x.a = y.a AND x.b <> y.b JOIN z w ON w.a = x.b AND w.b = y.b) t ON t.a = dg.id GROUP BY 1", "coefficient", "id degree")
q("identify_hub_columns", lambda n: S.hub_columns(S.network_degrees(S.correlation_network(n.m, 0.0), 0.02), 0.8), NS + "SELECT id FROM dg WHERE degree >= 0.8 * (SELECT max(degree) FROM dg)", "", "id")
q("mutual_information_network", lambda n: S.mi_network(n.ev, 0.0))
q("genie3_importance", lambda n: S.tf_target_scores(n.m, n.m.cols, squared=True), TT + "SELECT tf, target, coalesce(r * r / nullif(max(r * r) OVER (PARTITION BY target), 0), 0) AS score FROM tt", "score", "tf target")
for _k, _e in (("wgcna_adjacency", "r * r"), ("wgcna_adjacency_signed", "power((1 + r) / 2, 2)"), ("wgcna_adjacency_signed_hybrid", "sign(r) * r * r")):
    q(_k, lambda n, k=_k: S.adjacency(n.m, 2.0, k[16:] or "unsigned"), CN + f"SELECT a, b, {_e} AS w FROM cr", "w", "a b")
#: Medians and deviations of all columns of the positive vectors, zeros included, and their biweight midcorrelation.
BI = with_("xp") + ", x AS (SELECT vec_id AS i, dj.j AS j, coalesce(v, 0) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS j) dj LEFT JOIN xp ON xp.i = vec_id AND xp.j = dj.j), md AS (SELECT j, quantile_cont(v, 0.5) AS med FROM x GROUP BY 1), mad AS (SELECT x.j AS j, max(med) AS med, 1.4826 * quantile_cont(abs(v - med), 0.5) AS mad FROM x JOIN md ON md.j = x.j GROUP BY 1), bw AS (SELECT i, x.j AS j, v, mad, CASE WHEN mad >= 1e-15 AND abs((v - med) / (9 * mad)) < 1 THEN (v - med) * power(1 - power((v - med) / (9 * mad), 2), 2) ELSE 0 END AS t FROM x JOIN mad ON mad.j = x.j), bc AS (SELECT p.j AS a, q.j AS b, CASE WHEN min(p.mad) < 1e-15 OR min(q.mad) < 1e-15 THEN coalesce(corr(p.v, q.v), 0) WHEN sqrt(sum(p.t * p.t) * sum(q.t * q.t)) > 1e-15 THEN sum(p.t * q.t) / sqrt(sum(p.t * p.t) * sum(q.t * q.t)) ELSE 0 END AS r FROM bw p JOIN bw q ON p.i = q.i AND p.j < q.j GROUP BY 1, 2) "
q("column_medians", lambda n: B.column_medians(n.expr), BI + "SELECT j AS col, med AS median, mad FROM mad", "median mad", "col")
q("correlation_matrix_bicor", lambda n: S.correlation_matrix(n.expr, "bicor"), BI + "SELECT a, b, r FROM bc", "r", "a b")
q("wgcna_adjacency_bicor", lambda n: S.adjacency(n.expr, 2.0, "signed", "bicor"), BI + "SELECT a, b, power((1 + r) / 2, 2) AS w FROM bc", "w", "a b")
TO = CX + ", ad AS (SELECT a, b, r * r AS w FROM cc WHERE a <> b), k AS (SELECT a, sum(w) AS k FROM ad GROUP BY 1), l AS (SELECT x.a, y.b, sum(x.w * y.w) AS l FROM ad x JOIN ad y ON x.b = y.a WHERE x.a < y.b GROUP BY 1, 2), tom AS (SELECT ad.a AS a, ad.b AS b, (coalesce(l, 0) + w) / (least(p.k, q.k) + 1 - w) AS tom FROM ad LEFT JOIN l ON l.a = ad.a AND l.b = ad.b JOIN k p ON p.a = ad.a JOIN k q ON q.a = ad.b WHERE ad.a < ad.b) "
q("topological_overlap_matrix", lambda n: S.topological_overlap(S.adjacency(n.ev, 2.0)), TO + "SELECT a, b, tom FROM tom", "tom", "a b")
q("tom_dissimilarity", lambda n: S.topological_overlap(S.adjacency(n.ev, 2.0)).select("a", "b", (1 - F.col("tom")).alias("d")), TO + "SELECT a, b, 1 - tom AS d FROM tom", "d", "a b")
_mod = lambda n: n.m.cols.select(F.col("col").alias("id"), (F.col("col") % 3).alias("module"))
MC = CN + ", ad AS (SELECT a, b, r * r AS w FROM cr UNION ALL SELECT b, a, r * r FROM cr), mc AS (SELECT a AS id, a % 3 AS module, avg(w) AS k FROM ad WHERE a % 3 = b % 3 GROUP BY 1) "
q("identify_hub_genes", lambda n: S.hub_genes(S.adjacency(n.m, 2.0), _mod(n), 3), MC + "SELECT id, module, k, row_number() OVER (PARTITION BY module ORDER BY round(k, 12) DESC, id) AS rank FROM mc QUALIFY rank <= 3", "k", "id module rank")
q("module_preservation", lambda n: S.module_preservation(S.adjacency(n.m, 2.0), S.adjacency(n.m, 1.0), _mod(n)), MC + ", m1 AS (SELECT a AS id, avg(sqrt(w)) AS k FROM ad WHERE a % 3 = b % 3 GROUP BY 1) SELECT module, CASE WHEN count(*) >= 3 THEN coalesce(corr(mc.k, m1.k), 0) * sqrt(count(*)) ELSE 0 END AS z FROM mc JOIN m1 USING (id) GROUP BY 1", "z", "module")
_eig = lambda n: n.m.rows.crossJoin(n.spark.range(2).select(F.col("id").alias("module"))).select("module", "row", ((F.col("row") * (F.col("module") + 3)) % 17).cast("double").alias("x"))
EI = with_("m ri cj") + ", eg AS (SELECT k AS module, i, CAST((i * (k + 3)) % 17 AS DOUBLE) AS x FROM ri CROSS JOIN (SELECT unnest(range(0, 2)) AS k)) "
q("gene_module_membership", lambda n: S.module_membership(n.m, _eig(n)), EI + "SELECT cj.j AS col, module, coalesce(corr(coalesce(v, 0), x), 0) AS r FROM cj CROSS JOIN eg LEFT JOIN m ON m.i = eg.i AND m.j = cj.j GROUP BY 1, 2", "r", "col module")
q("module_trait_correlation", lambda n: S.trait_correlation(_eig(n), n.m.rows.select("row", F.lit(0).alias("trait"), (F.col("row") % 11).cast("double").alias("y"))), EI + ", r AS (SELECT module, corr(x, i % 11) AS r, count(*) AS n FROM eg GROUP BY 1), z AS (SELECT module, r, sqrt(n - 3) * 0.5 * ln((1 + r) / (1 - r)) AS z FROM r) SELECT module, 0 AS trait, r, least(1, 2 * exp(-z * z / 2)) AS p FROM z", "r p", "module trait")
q("module_eigengene", lambda n: S.eigengenes(n.ev, n.ev.cols.select(F.col("col").alias("id"), F.lit(0).alias("module")), 30))
q("pick_soft_threshold", lambda n: S.soft_threshold(n.m, [1.0, 2.0, 4.0]))
q("centroid_distances", lambda n: S.centroid_distances(n.m, n.groups), GM + "SELECT a.grp AS a, b.grp AS b, sqrt(sum(power(a.mean - b.mean, 2))) AS dist FROM gm a JOIN gm b ON a.j = b.j AND a.grp < b.grp GROUP BY 1, 2", "dist", "a b")
CO = with_("m cj g") + ", d2 AS (SELECT grp, j, max(n) AS n, coalesce(sum(v), 0) / max(n) AS mean, coalesce(sum(v * v), 0) / max(n) - power(coalesce(sum(v), 0) / max(n), 2) AS var FROM (SELECT j, grp, n FROM cj CROSS JOIN (SELECT grp, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1)) c LEFT JOIN (SELECT m.j AS jj, g.grp AS gg, v FROM m JOIN g USING (i)) x ON jj = j AND gg = grp GROUP BY 1, 2), co AS (SELECT grp, 1 / (sqrt(2 * sum(var) * max(n) / (max(n) - 1)) + 1e-10) AS cohesion FROM d2 GROUP BY 1), cd AS (SELECT a.grp AS a, b.grp AS b, sqrt(sum(power(a.mean - b.mean, 2))) AS dist FROM d2 a JOIN d2 b ON a.j = b.j AND a.grp <> b.grp GROUP BY 1, 2), se AS (SELECT a AS grp, min(dist) AS separation FROM cd GROUP BY 1) "
q("cluster_cohesion", lambda n: S.group_cohesion(n.m, n.groups), CO + "SELECT grp, cohesion FROM co", "cohesion", "grp")
q("cluster_separation", lambda n: S.group_separation(n.m, n.groups), CO + "SELECT grp, separation FROM se", "separation", "grp")
q("cluster_quality_score", lambda n: S.group_quality(n.m, n.groups), CO + "SELECT grp, cohesion * separation AS quality FROM co JOIN se USING (grp)", "quality", "grp")
HV = with_("m g") + ", hv AS (SELECT grp, avg(var) AS variance FROM (SELECT grp, j, var_pop(v) AS var FROM m JOIN g USING (i) GROUP BY 1, 2) GROUP BY 1), gn AS (SELECT grp, count(*) AS n FROM g GROUP BY 1) "
q("identify_heterogeneous_clusters", lambda n: S.heterogeneous_groups(n.m, n.groups), HV + "SELECT grp, variance, variance > (SELECT sum(variance * n) / sum(n) FROM hv JOIN gn USING (grp)) AS heterogeneous FROM hv", "variance", "grp", digits=5)
q("population_balance", lambda n: S.population_balance(n.groups), "WITH " + CTE["g"] + ", c AS (SELECT grp, count(*) AS n FROM g GROUP BY 1) SELECT CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 0 END AS balance FROM (SELECT n, sum(n) OVER () AS t FROM c)", "balance")
q("cluster_stability", lambda n: S.cluster_stability(n.labels.select("id", F.col("a").alias("label")), n.labels.select("id", F.col("b").alias("label"))), with_("lab") + ", c AS (SELECT a, b, count(*) AS n FROM lab GROUP BY 1, 2), x AS (SELECT a, max(n / (p + q - n)) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS p, sum(n) OVER (PARTITION BY b) AS q FROM c) GROUP BY 1) SELECT a AS label, s AS stability FROM x", "stability", "label")
RP = GM + ", rp AS (SELECT g.grp, g.i, sqrt(greatest(0, coalesce(sum(v * v - 2 * v * mean), 0) + max(mm))) AS dist FROM g LEFT JOIN m ON m.i = g.i LEFT JOIN gm ON gm.j = m.j AND gm.grp = g.grp JOIN (SELECT grp, sum(mean * mean) AS mm FROM gm GROUP BY 1) s ON s.grp = g.grp GROUP BY 1, 2) "
q("representative_cells", lambda n: S.representatives(n.m, n.groups, 3), RP + 'SELECT grp, i AS "row", dist FROM rp QUALIFY row_number() OVER (PARTITION BY grp ORDER BY dist, i) <= 3', "dist", "grp row")
SI = with_("nb") + ", s AS (SELECT id % 3 AS l, count(*) AS n FROM vec GROUP BY 1), si AS (SELECT i, k % 3 AS l, i % 3 AS own, sum(dist) / max(CASE WHEN i % 3 = k % 3 THEN n - 1 ELSE n END) AS m FROM nb JOIN s ON s.l = k % 3 GROUP BY 1, 2, 3), sa AS (SELECT i, max(CASE WHEN l = own THEN m END) AS a, min(CASE WHEN l <> own THEN m END) AS b FROM si GROUP BY 1), sv AS (SELECT i, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM sa) "
_l3 = lambda n: n.vectors.select("id", (F.col("id") % 3).alias("label"))
q("silhouette_samples", lambda n: S.silhouette(n.nbrs, _l3(n)), SI + 'SELECT i AS "row", s FROM sv', "s", "row")
q("silhouette_score", lambda n: S.silhouette(n.nbrs, _l3(n)).agg(F.avg("s").alias("score")), SI + "SELECT avg(s) AS score FROM sv", "score")
q("marker_based_subpopulation", lambda n: S.marker_bitmask(n.m, n.m.cols.where("col < 4").select("col", F.col("col").alias("bit")), 20.0), with_("m ri") + 'SELECT ri.i AS "row", coalesce(sum(power(2, j)), 0) AS label FROM ri LEFT JOIN m ON m.i = ri.i AND j < 4 AND v > 20 GROUP BY 1', "", "row label")
q("count_cell_types", lambda n: n.groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "WITH " + CTE["g"] + " SELECT grp, count(*) AS n FROM g GROUP BY 1", "", "grp n")
q("cell_type_marker_expression", lambda n: S.marker_expression(n.m, n.groups, n.m.cols.where("col % 4 = 0")), GM + "SELECT grp, j AS col, mean, pct FROM gm WHERE j % 4 = 0", "mean pct", "grp col")
_conf = lambda n: n.p.select("id", F.col("p").alias("confidence"))
q("detect_novel_types", lambda n: S.novel_types(_conf(n), 0.3), with_("p") + "SELECT id, p < 0.3 AS novel FROM p", "", "id")
q("cluster_novel_cells", lambda n: S.novel_clusters(S.novel_types(_conf(n), 0.3), n.p.select("id", (F.col("id") % 8).alias("cluster")), 0.55), with_("p") + "SELECT id % 8 AS cluster, avg(CASE WHEN p < 0.3 THEN 1.0 ELSE 0 END) >= 0.55 AS novel FROM p GROUP BY 1", "", "cluster")
q("consensus_annotation", lambda n: S.consensus(n.p.select("id", F.explode(F.array(*[F.struct(((F.col("id") * k) % 4).alias("label"), (F.lit(0.2) * k + F.col("p")).alias("w")) for k in (1, 2, 3)])).alias("e")).select("id", "e.label", "e.w")), with_("p") + ", v AS (SELECT id, (id * k) % 4 AS label, sum(0.2 * k + p) AS w FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2) SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(w, 12) DESC, label) = 1", "confidence", "id label")
HA = PF + ", fp AS (SELECT i % 6 AS grp, CAST(count(*) AS DOUBLE) AS n FROM ri GROUP BY 1), pr6 AS (SELECT fp.grp AS grp, cj.j AS j, coalesce(sum(v), 0) / max(n) AS mean FROM fp CROSS JOIN cj LEFT JOIN m ON m.i % 6 = fp.grp AND m.j = cj.j GROUP BY 1, 2), p6 AS (SELECT ri.i AS i, grp, coalesce(corr(coalesce(v, 0), mean), 0) AS r FROM ri CROSS JOIN pr6 LEFT JOIN m ON m.i = ri.i AND m.j = pr6.j GROUP BY 1, 2) "
q("hierarchical_annotation", lambda n: S.hierarchical_annotation(n.ev, S.reference_profiles(n.ev, _g3(n)), S.reference_profiles(n.ev, n.ev.rows.select("row", (F.col("row") % 6).alias("grp"))), n.spark.range(6).select(F.col("id").alias("fine"), (F.col("id") % 3).alias("coarse"))), HA + 'SELECT ca.i AS "row", ca.grp AS coarse, p6.grp AS fine, (ca.r + 1) / 2 AS coarse_confidence, (p6.r + 1) / 2 AS fine_confidence FROM ca JOIN p6 ON p6.i = ca.i AND p6.grp % 3 = ca.grp QUALIFY row_number() OVER (PARTITION BY ca.i ORDER BY round(p6.r, 9) DESC, p6.grp) = 1', "coarse_confidence fine_confidence", "row coarse fine")
q("differential_markers", lambda n: S.differential_markers(n.m, n.groups, 1, 2), GM + "SELECT j AS col, log2((max(CASE WHEN grp = 1 THEN mean END) + 1) / (max(CASE WHEN grp = 2 THEN mean END) + 1)) AS lfc, max(CASE WHEN grp = 1 THEN pct END) - max(CASE WHEN grp = 2 THEN pct END) AS pct_diff FROM gm GROUP BY 1", "lfc pct_diff", "col")
q("top_markers_per_type", lambda n: S.top_markers(n.m, n.groups, 4), GM + ", t AS (SELECT j, grp, mean - (sum(mean) OVER (PARTITION BY j) - mean) / (count(*) OVER (PARTITION BY j) - 1) AS score FROM gm) SELECT grp, j AS col, score, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, j) AS rank FROM t QUALIFY rank <= 4", "score", "grp col rank")
q("pathway_activity", lambda n: S.zscore_across(S.mean_score(n.m, n.sets)), SUM + 'SELECT set_id, i AS "row", coalesce((s / n - avg(s / n) OVER (PARTITION BY set_id)) / nullif(stddev_pop(s / n) OVER (PARTITION BY set_id), 0), 0) AS score FROM s JOIN sz USING (set_id)', "score", "set_id row", digits=5)
q("compute_gene_means", lambda n: S.column_means(n.m), with_("m cj ri") + "SELECT cj.j AS col, coalesce(sum(v), 0) / max(n) AS mean FROM cj LEFT JOIN m ON m.j = cj.j CROSS JOIN nr GROUP BY 1", "mean", "col")
q("bin_genes_by_expression", lambda n: S.equal_width_bins(n.m, 5), with_("m cj ri") + ", c AS (SELECT cj.j AS j, coalesce(sum(v), 0) / max(n) AS x FROM cj LEFT JOIN m ON m.j = cj.j CROSS JOIN nr GROUP BY 1) SELECT j AS col, CASE WHEN max(x) OVER () > min(x) OVER () THEN least(4, floor((x - min(x) OVER ()) / ((max(x) OVER () - min(x) OVER ()) / 5))) ELSE 0 END AS bin FROM c", "", "col bin")
q("select_control_genes", lambda n: S.control_columns(n.m, n.sets, 1, 5))
q("gene_set_score", lambda n: S.gene_set_score(n.m, n.m.cols.where("col % 9 = 0"), "sum"), with_("m ri") + 'SELECT ri.i AS "row", coalesce(sum(CASE WHEN j % 9 = 0 THEN v END), 0) AS score FROM ri LEFT JOIN m ON m.i = ri.i GROUP BY 1', "score", "row")
q("state_entropy", lambda n: S.state_entropy(n.ev), with_("ev") + ', p AS (SELECT i, v / sum(v) OVER (PARTITION BY i) AS p FROM m WHERE v > 0) SELECT ri.i AS "row", coalesce(sum(-p * ln(p)), 0) / ln((SELECT n FROM nc)) AS h FROM ri LEFT JOIN p ON p.i = ri.i GROUP BY 1', "h", "row")
q("combined_state_score", lambda n: S.combined_state_score(n.m, n.sets, n.sets.select("set_id").distinct().select("set_id", (F.col("set_id") % 3 + 1.0).alias("w"))), SUM + ', z AS (SELECT set_id, i, coalesce((e - avg(e) OVER (PARTITION BY set_id)) / nullif(stddev_pop(e) OVER (PARTITION BY set_id), 0), 0) AS z FROM e) SELECT i AS "row", sum((set_id % 3 + 1) * z) / sum(set_id % 3 + 1) AS score FROM z GROUP BY 1', "score", "row", digits=5)
