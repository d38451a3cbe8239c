"""Queries of tests, corrections, information measures, labelings and lineages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import information as N
from ..operators import partitions as P
from ..operators import stats as S
from ..operators import testing as T
from .base import q
from .inputs import chisq_sql, sf_sql, two_sided_sql, with_

# --- two-group tests ---------------------------------------------------------
TWO = with_("m cj two") + """, tg AS (SELECT j, n0, n1, coalesce(sum(CASE WHEN grp = 0 THEN v END), 0) / n0 AS mean0, coalesce(sum(CASE WHEN grp = 1 THEN v END), 0) / n1 AS mean1,
 (coalesce(sum(CASE WHEN grp = 0 THEN v * v END), 0) - power(coalesce(sum(CASE WHEN grp = 0 THEN v END), 0), 2) / n0) / (n0 - 1) AS var0,
 (coalesce(sum(CASE WHEN grp = 1 THEN v * v END), 0) - power(coalesce(sum(CASE WHEN grp = 1 THEN v END), 0), 2) / n1) / (n1 - 1) AS var1
 FROM cj CROSS JOIN (SELECT CAST(sum(1 - grp) AS DOUBLE) AS n0, CAST(sum(grp) AS DOUBLE) AS n1 FROM g) LEFT JOIN (SELECT m.j AS mj, grp, v FROM m JOIN g USING (i)) ON mj = j GROUP BY j, n0, n1) """
TT = "(mean1 - mean0) / sqrt(var0 / n0 + var1 / n1)"
TP = "(mean1 - mean0) / sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1))"
FC = "log2((mean1 + 1e-9) / (mean0 + 1e-9))"
CD = "(mean1 - mean0) / sqrt(((n0 - 1) * var0 + (n1 - 1) * var1) / (n0 + n1 - 2))"
q("two_group_stats", lambda n: S.two_group_stats(n.m, n.two), TWO + "SELECT j AS col, n0, n1, mean0, mean1, var0, var1 FROM tg", "mean0 mean1 var0 var1", "col n0 n1", 4)
q("ttest_welch", lambda n: S.ttest(n.m, n.two), TWO + f"SELECT j AS col, {TT} AS t, {FC} AS log2_fc, {CD} AS effect, {two_sided_sql(TT)} AS p FROM tg", "t log2_fc effect p", "col")
q("ttest_pooled", lambda n: S.ttest(n.m, n.two, welch=False), TWO + f"SELECT j AS col, {TP} AS t, {FC} AS log2_fc, {CD} AS effect, {two_sided_sql(TP)} AS p FROM tg", "t log2_fc effect p", "col")
#: Squares of stored entries about their own mean.
OWN = TWO
for _g in (0, 1):
    _s = f"coalesce(sum(CASE WHEN grp = {_g} THEN v END), 0)"
    OWN = OWN.replace(f"power({_s}, 2) / n{_g})", f"coalesce(power({_s}, 2) / nullif(count(CASE WHEN grp = {_g} THEN 1 END), 0), 0) + (n{_g} - count(CASE WHEN grp = {_g} THEN 1 END)) * power({_s} / n{_g}, 2))")
q("ttest_compat", lambda n: S.ttest(n.m, n.two, compat=True), OWN + f"SELECT j AS col, {TT} AS t, {FC} AS log2_fc, {CD} AS effect, {two_sided_sql(TT)} AS p FROM tg", "t log2_fc effect p", "col")
q("effect_cohens_d_compat", lambda n: S.effect_size(n.m, n.two, compat=True), OWN + f"SELECT j AS col, {CD} AS effect FROM tg", "effect", "col")
for _k, _e in (("cohens_d", CD), ("hedges_g", f"{CD} * (1 - 3 / (4 * (n0 + n1 - 2) - 1))"), ("glass_delta", "(mean1 - mean0) / sqrt(var0)"), ("cles", "0.5")):
    q(f"effect_{_k}", lambda n, k=_k: S.effect_size(n.m, n.two, k), TWO + f"SELECT j AS col, {_e} AS effect FROM tg", "effect", "col")
DENSE2 = with_("m cj two") + ", d AS (SELECT cj.j AS j, g.grp AS grp, coalesce(v, 0) AS v FROM g CROSS JOIN cj LEFT JOIN m ON m.i = g.i AND m.j = cj.j) "
RANK = ", rk AS (SELECT j, grp, v, rank() OVER (PARTITION BY j ORDER BY v) + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY j, v) AS t FROM d) "
MW = DENSE2 + RANK + """, mw AS (SELECT j, CAST(sum(1 - grp) AS DOUBLE) AS n0, CAST(sum(grp) AS DOUBLE) AS n1, sum(CASE WHEN grp = 0 THEN r END) AS r0, sum(t * t - 1.0) AS ties, avg(CASE WHEN grp = 0 THEN v END) AS mean0, avg(CASE WHEN grp = 1 THEN v END) AS mean1 FROM rk GROUP BY j),
 mz AS (SELECT *, r0 - n0 * (n0 + 1) / 2 AS u, sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS s FROM mw) """
q("mwu_test", lambda n: S.mwu(n.m, n.two), MW + f"SELECT j AS col, u, u / (n0 * n1) AS auroc, {FC} AS log2_fc, {two_sided_sql('(greatest(abs(u - n0 * n1 / 2) - 0.5, 0) / s)')} AS p FROM mz", "u auroc log2_fc p", "col")
q("auroc", lambda n: S.auroc(n.m, n.two), MW + f"SELECT j AS col, u / (n0 * n1) AS auroc, {two_sided_sql('(greatest(abs(u - n0 * n1 / 2) - 0.5, 0) / s)')} AS p FROM mz", "auroc p", "col")
DENSEK = with_("m cj g") + ", d AS (SELECT cj.j AS j, g.grp AS grp, coalesce(v, 0) AS v FROM g CROSS JOIN cj LEFT JOIN m ON m.i = g.i AND m.j = cj.j) "
HH = "greatest(0, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)))"
q("kruskal_wallis", lambda n: S.kruskal_wallis(n.m, n.groups), DENSEK + RANK + f", kw AS (SELECT j, sum(r * r / c) AS q, CAST(sum(c) AS DOUBLE) AS n, count(*) AS k, sum(ti) AS ties FROM (SELECT j, grp, sum(r) AS r, count(*) AS c, sum(t * t - 1.0) AS ti FROM rk GROUP BY 1, 2) GROUP BY j) SELECT j AS col, {HH} AS h, {chisq_sql(HH, '(k - 1.0)')} AS p FROM kw", "h p", "col")
q("kruskal_wallis_compat", lambda n: S.kruskal_wallis(n.m, n.groups, compat=True), DENSEK + RANK + f", kw AS (SELECT j, sum(r * r / c) AS q, CAST(sum(c) AS DOUBLE) AS n, count(*) AS k, sum(ti) AS ties FROM (SELECT j, grp, sum(CASE WHEN v = 0 THEN 0 ELSE r END) AS r, count(*) AS c, sum(t * t - 1.0) AS ti FROM rk GROUP BY 1, 2) GROUP BY j) SELECT j AS col, {HH} AS h, {chisq_sql(HH, '(k - 1.0)')} AS p FROM kw", "h p", "col")
LAM = "((k - 1.0) * f / ((k - 1.0) * f + (n - k)))"
ZF = f"((cbrt({LAM}) - (1 - 2 / (9 * (k - 1.0)))) / sqrt(2 / (9 * (k - 1.0))) - (cbrt(1 - {LAM}) - (1 - 2 / (9 * (n - k)))) / sqrt(2 / (9 * (n - k))))"
q("oneway_anova", lambda n: S.oneway_anova(n.m, n.groups), DENSEK + f", an AS (SELECT j, CAST(count(*) AS DOUBLE) AS k, CAST(sum(c) AS DOUBLE) AS n, sum(c * m * m) - power(sum(c * m), 2) / sum(c) AS ssb, sum(ss) AS ssw FROM (SELECT j, grp, count(*) AS c, avg(v) AS m, var_samp(v) * (count(*) - 1) AS ss FROM d GROUP BY 1, 2) GROUP BY j), fa AS (SELECT j, k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM an) SELECT j AS col, f, CASE WHEN f <= 0 THEN 1.0 ELSE {sf_sql(ZF)} END AS p FROM fa", "f p", "col", 5)
q("ks_test", lambda n: S.ks(n.m, n.two).select("col", "d"), DENSE2 + "SELECT j AS col, max(abs(f0 - f1)) AS d FROM (SELECT j, v, sum(sum(1 - grp)) OVER w / sum(sum(1 - grp)) OVER (PARTITION BY j) AS f0, sum(sum(grp)) OVER w / sum(sum(grp)) OVER (PARTITION BY j) AS f1 FROM d GROUP BY j, v WINDOW w AS (PARTITION BY j ORDER BY v)) GROUP BY j", "d", "col")
q("mmd_rbf", lambda n: S.mmd_rbf(n.ev, n.ev.with_entries(n.ev.entries.withColumn("v", F.col("v") / 2)), 1e-4), with_("ev") + ", x AS (SELECT ri.i, cj.j, coalesce(v, 0) AS v FROM ri CROSS JOIN cj LEFT JOIN m ON m.i = ri.i AND m.j = cj.j) SELECT a.j AS col, greatest(0, avg(exp(-1e-4 * power(a.v - b.v, 2))) + avg(exp(-1e-4 * power(a.v / 2 - b.v / 2, 2))) - 2 * avg(exp(-1e-4 * power(a.v - b.v / 2, 2)))) AS mmd FROM x a JOIN x b ON a.j = b.j GROUP BY a.j", "mmd", "col")
_lab3 = lambda n: n.labels.select("id", F.col("a").alias("type"), F.col("b").alias("cond"))
CHI = "sum(power(c - e, 2) * (1 / e + 1 / (nc - e))) OVER (PARTITION BY type)"
q("composition_analysis", lambda n: S.composition(_lab3(n)), with_("lab") + f", t AS (SELECT a.a AS type, b.b AS cond, a.nt, b.nc, (SELECT count(*) FROM lab) AS n, coalesce(c, 0) AS c FROM (SELECT a, count(*) AS nt FROM lab GROUP BY a) a CROSS JOIN (SELECT b, count(*) AS nc FROM lab GROUP BY b) b LEFT JOIN (SELECT a, b, count(*) AS c FROM lab GROUP BY 1, 2) x ON x.a = a.a AND x.b = b.b), u AS (SELECT *, nt * nc / n AS e FROM t), w AS (SELECT *, {CHI} AS chi FROM u) SELECT type, cond, c / nc AS proportion, {chisq_sql('chi', '3.0')} AS p FROM w", "proportion p", "type cond")
q("abundance_test", lambda n: S.abundance(n.labels.select("id", F.col("a").alias("cluster"), (F.col("b") % 2).alias("cond"))), with_("lab") + f", t AS (SELECT a AS cluster, CAST(sum(1 - b % 2) AS DOUBLE) AS c0, CAST(sum(b % 2) AS DOUBLE) AS c1, (SELECT CAST(sum(1 - b % 2) AS DOUBLE) FROM lab) AS n0, (SELECT CAST(sum(b % 2) AS DOUBLE) FROM lab) AS n1 FROM lab GROUP BY a), u AS (SELECT *, (n0 + n1) * power(c0 * (n1 - c1) - (n0 - c0) * c1, 2) / ((c0 + n0 - c0) * (c1 + n1 - c1) * (c0 + c1) * (n0 - c0 + n1 - c1)) AS chi FROM t) SELECT cluster, (c1 / n1) / (c0 / n0) AS fold_change, {chisq_sql('chi', '1.0')} AS p FROM u", "fold_change p", "cluster")
q("condition_response", lambda n: S.condition_response(n.m, n.two), MW + f"SELECT j AS col, CASE WHEN mean1 > 1e-10 AND mean0 > 1e-10 THEN log2(mean1 / mean0) WHEN mean1 > 1e-10 THEN 10 WHEN mean0 > 1e-10 THEN -10 ELSE 0 END AS score, {two_sided_sql('(greatest(abs(u - n0 * n1 / 2) - 0.5, 0) / s)')} AS p FROM mz", "score p", "col")
q("differential_abundance", lambda n: S.differential_abundance(n.clones.where("clone >= 0").select("id", F.col("cluster"), F.col("clone").alias("sample"), (F.col("clone") % 2).alias("cond"))).select("cluster", "score"), with_("clo") + ", s AS (SELECT clone, count(*) AS n FROM clo WHERE clone >= 0 GROUP BY 1), pr AS (SELECT k.cluster, s.clone, coalesce(c, 0) / n AS f FROM (SELECT DISTINCT cluster FROM clo) k CROSS JOIN s LEFT JOIN (SELECT cluster, clone, count(*) AS c FROM clo WHERE clone >= 0 GROUP BY 1, 2) x ON x.cluster = k.cluster AND x.clone = s.clone) SELECT cluster, log2(avg(CASE WHEN clone % 2 = 1 THEN f END) / avg(CASE WHEN clone % 2 = 0 THEN f END)) AS score FROM pr GROUP BY cluster", "score", "cluster")
# --- corrections -------------------------------------------------------------
PP = with_("p") + ", o AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS n FROM p) "
UP = "OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
DOWN = "OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
q("benjamini_hochberg", lambda n: T.benjamini_hochberg(n.p), PP + f"SELECT id, p, least(1, min(p * n / r) {UP}) AS q FROM o", "p q", "id")
q("benjamini_yekutieli", lambda n: T.benjamini_yekutieli(n.p), PP + f"SELECT id, p, least(1, min(p * n / r * (SELECT sum(1.0::DOUBLE / r) FROM o)) {UP}) AS q FROM o", "p q", "id")
q("bonferroni", lambda n: T.bonferroni(n.p), PP + "SELECT id, p, least(1, p * n) AS q FROM o", "p q", "id")
q("holm_bonferroni", lambda n: T.holm(n.p), PP + f"SELECT id, p, least(1, max(p * (n - r + 1)) {DOWN}) AS q FROM o", "p q", "id")
q("hochberg", lambda n: T.hochberg(n.p), PP + f"SELECT id, p, least(1, min(p * (n - r + 1)) {UP}) AS q FROM o", "p q", "id")
PI0 = "(SELECT least(1, min(s)) FROM (SELECT sum(CASE WHEN p > l / 20.0 THEN 1.0 ELSE 0 END) / (count(*) * (1 - l / 20.0)) AS s FROM p CROSS JOIN (SELECT unnest(range(1, 20)) AS l) GROUP BY l))"
q("storey_qvalue", lambda n: T.storey_qvalue(n.p), PP + f"SELECT id, p, least(1, min({PI0} * p * n / r) {UP}) AS q FROM o", "p q", "id")
q("local_fdr", lambda n: T.local_fdr(n.p))
q("empirical_fdr", lambda n: T.empirical_fdr(n.p.select("id", (1 - F.col("p")).alias("score")), n.p.select((F.col("id") % 3).alias("perm"), (0.9 - F.col("p") / 2).alias("score"))), with_("p") + ", ob AS (SELECT id, 1 - p AS score, row_number() OVER (ORDER BY 1 - p DESC, id) AS r FROM p), nu AS (SELECT 0.9 - p / 2 AS score FROM p), x AS (SELECT o.id, o.score, o.r, (SELECT count(*) FROM nu WHERE nu.score >= o.score) AS above FROM ob o) SELECT id, score, least(1, min(above / 3 / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM x", "score q", "id")
q("significant_indices", lambda n: T.significant(n.p, 0.05), with_("p") + "SELECT id FROM p WHERE p <= 0.05", "", "id")
q("significant_indices_strict", lambda n: T.significant(n.p, 0.01, True), with_("p") + "SELECT id FROM p WHERE p < 0.01", "", "id")
q("count_significant", lambda n: T.count_significant(n.p, 0.05), with_("p") + "SELECT count(*) AS n FROM p WHERE p <= 0.05", "", "n")
q("neglog10_pvalues", lambda n: T.neglog10(n.p), with_("p") + "SELECT id, -log10(greatest(p, 1e-300)) AS neglog10 FROM p", "neglog10", "id")
q("fisher_combine", lambda n: T.fisher_combine(n.p), with_("p") + "SELECT -2 * sum(ln(greatest(p, 1e-300))) AS statistic FROM p", "statistic")
TQ = "sqrt(-2 * ln(greatest(least(p, 1 - p), 1e-300)))"
q("stouffer_combine", lambda n: T.stouffer_combine(n.p.withColumn("weight", F.col("id") % 3 + 1.0)), with_("p") + f", z AS (SELECT id % 3 + 1.0::DOUBLE AS w, (CASE WHEN p <= 0.5 THEN 1 ELSE -1 END) * ({TQ} - (2.515517 + {TQ} * (0.802853 + {TQ} * 0.010328)) / (1 + {TQ} * (1.432788 + {TQ} * (0.189269 + {TQ} * 0.001308)))) AS z FROM p) SELECT sum(w * z) / sqrt(sum(w * w)) AS statistic FROM z", "statistic")
q("sort_by_pvalue", lambda n: T.sort_by_pvalue(n.p), with_("p") + "SELECT id, p FROM p", "p", "id")
# --- information -------------------------------------------------------------
_pq = lambda n, k: n.labels.groupBy(F.col(k).alias("id")).agg((F.count(F.lit(1)) / F.lit(float(n.labels.count()))).alias("p" if k == "a" else "q"))
PQ = with_("lab") + ", pp AS (SELECT a AS id, count(*) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY a), qq AS (SELECT b AS id, count(*) / (SELECT count(*) FROM lab) AS q FROM lab GROUP BY b), z AS (SELECT coalesce(pp.id, qq.id) AS id, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM pp FULL JOIN qq ON pp.id = qq.id) "
_bin = lambda n: n.labels.select(F.col("a").alias("x"), F.col("b").alias("y"))
HX = with_("lab") + ", h AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS c FROM lab GROUP BY 1, 2), hh AS (SELECT (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM h) AS hxy, (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT sum(c) AS c FROM h GROUP BY a)) AS hx, (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT sum(c) AS c FROM h GROUP BY b)) AS hy) "
q("discrete_entropy", lambda n: N.discrete_entropy(_pq(n, "a")), PQ + "SELECT -sum(p * ln(p)) AS h FROM pp", "h")
q("count_entropy", lambda n: N.count_entropy(P.label_sizes(n.labels, "a").select(F.col("n").alias("c"))), HX + "SELECT hx AS h FROM hh", "h")
q("row_entropy", lambda n: N.row_entropy(n.m, True), with_("m ri") + 'SELECT ri.i AS "row", coalesce((ln(sum(v)) - sum(v * ln(v)) / sum(v)) / (CASE WHEN count(v) > 1 THEN ln(count(v)) END), 0) AS h FROM ri LEFT JOIN m ON m.i = ri.i AND v > 0 GROUP BY ri.i', "h", "row")
q("kl_divergence", lambda n: N.kl_divergence(_pq(n, "b").withColumnRenamed("q", "p"), _pq(n, "a").withColumnRenamed("p", "q")), PQ + "SELECT sum(CASE WHEN q > 0 THEN q * ln(q / p) ELSE 0 END) AS d FROM z", "d")
q("kl_divergence_missing", lambda n: N.kl_divergence(_pq(n, "a"), _pq(n, "b")), PQ + "SELECT sum(CASE WHEN p > 0 THEN CASE WHEN q > 0 THEN p * ln(p / q) ELSE 1e10 END ELSE 0 END) AS d FROM z", "d", digits=3)
q("js_divergence", lambda n: N.js_divergence(_pq(n, "a"), _pq(n, "b")), PQ + "SELECT 0.5 * sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) AS d FROM z", "d")
q("symmetric_kl", lambda n: N.symmetric_kl(_pq(n, "a"), _pq(n, "b")), PQ + "SELECT 0.5 * sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) + q * ln(q / p) ELSE 0 END) AS d FROM z", "d")
q("cross_entropy", lambda n: N.cross_entropy(_pq(n, "b").withColumnRenamed("q", "p"), _pq(n, "a").withColumnRenamed("p", "q")), PQ + "SELECT -sum(q * ln(greatest(p, 1e-15))) AS h FROM z", "h")
q("perplexity", lambda n: N.perplexity(_pq(n, "b").withColumnRenamed("q", "p"), _pq(n, "a").withColumnRenamed("p", "q")), PQ + "SELECT exp(-sum(q * ln(greatest(p, 1e-15)))) AS perplexity FROM z", "perplexity")
q("gini_impurity", lambda n: N.gini_impurity(_pq(n, "a")), PQ + "SELECT 1 - sum(p * p) AS gini FROM pp", "gini")
q("histogram_2d", lambda n: N.histogram2d(_bin(n)), with_("lab") + "SELECT a AS x, b AS y, count(*) AS c FROM lab GROUP BY 1, 2", "", "x y c")
for _n, _f, _e, _c in (("joint_entropy", N.joint_entropy, "hxy", "h"), ("marginal_entropy", N.marginal_entropy, "hx", "h"), ("conditional_entropy", N.conditional_entropy, "hxy - hx", "h"), ("mutual_information", N.mutual_information, "greatest(0, hx + hy - hxy)", "mi"), ("information_gain", N.information_gain, "greatest(0, hx + hy - hxy) / ln(2)", "gain"), ("normalized_mi", N.normalized_mi, "2 * greatest(0, hx + hy - hxy) / (hx + hy)", "nmi")):
    q(_n, lambda n, f=_f: f(_bin(n)), HX + f"SELECT {_e} AS {_c} FROM hh", _c, digits=8)
q("adjusted_mi", lambda n: N.adjusted_mi(_bin(n)), HX + ", ex AS (SELECT sum(e * ln(e)) AS e FROM (SELECT x.c * y.c / power((SELECT sum(c) FROM h), 2) AS e FROM (SELECT sum(c) AS c FROM h GROUP BY a) x CROSS JOIN (SELECT sum(c) AS c FROM h GROUP BY b) y)) SELECT (greatest(0, hx + hy - hxy) - e) / (greatest(hx, hy) - e) AS ami FROM hh, ex", "ami", digits=8)
q("discretize_equal_width", lambda n: N.equal_width(n.p.select("id", F.col("p").alias("x")), 10), with_("p") + "SELECT id, p AS x, least(9, floor((p - min(p) OVER ()) / ((max(p) OVER () - min(p) OVER ()) / 10))) AS bin FROM p", "x", "id bin")
q("discretize_equal_frequency", lambda n: N.equal_frequency(n.p.select("id", F.col("p").alias("x")), 7), with_("p") + "SELECT id, p AS x, least(6, floor((row_number() OVER (ORDER BY p, id) - 1) / ceil(count(*) OVER () / 7))) AS bin FROM p", "x", "id bin")
MI = with_("m cj g") + ", d AS (SELECT cj.j AS j, g.grp AS y, coalesce(v, 0) AS v FROM g CROSS JOIN cj LEFT JOIN m ON m.i = g.i AND m.j = cj.j), b AS (SELECT j, y, coalesce(least(9, floor((v - min(v) OVER (PARTITION BY j)) / nullif((max(v) OVER (PARTITION BY j) - min(v) OVER (PARTITION BY j)) / 10, 0))), 0) AS x FROM d), h AS (SELECT j, x, y, CAST(count(*) AS DOUBLE) AS c FROM b GROUP BY 1, 2, 3), mi AS (SELECT a.j AS col, greatest(0, hx + hy - hxy) AS mi FROM (SELECT j, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS hxy FROM h GROUP BY j) a JOIN (SELECT j, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS hx FROM (SELECT j, x, sum(c) AS c FROM h GROUP BY 1, 2) GROUP BY j) b ON a.j = b.j JOIN (SELECT j, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS hy FROM (SELECT j, y, sum(c) AS c FROM h GROUP BY 1, 2) GROUP BY j) c ON a.j = c.j) "
_gy = lambda n: n.groups.select("row", F.col("grp").alias("y"))
q("feature_mi", lambda n: N.feature_mi(n.m, _gy(n)), MI + "SELECT * FROM mi", "mi", "col")
q("select_features_mi", lambda n: N.select_features_mi(n.m, _gy(n), 10), MI + "SELECT * FROM mi ORDER BY mi DESC, col LIMIT 10", "mi", "col")
q("mrmr_selection", lambda n: N.mrmr_selection(n.ev, n.ev.rows.select("row", (F.col("row") % 3).alias("y")), 3))
# --- labelings ---------------------------------------------------------------
PRS = with_("lab") + ", t AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS c FROM lab GROUP BY 1, 2), k AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM t) AS bb, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM t GROUP BY a)) AS pa, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM t GROUP BY b)) AS pb, (SELECT sum(c) FROM t) AS n) "
q("adjusted_rand_index", lambda n: P.adjusted_rand_index(n.labels), PRS + "SELECT (bb - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) AS ari FROM k", "ari", digits=8)
q("fowlkes_mallows_index", lambda n: P.fowlkes_mallows(n.labels), PRS + "SELECT bb / sqrt(pa * pb) AS fmi FROM k", "fmi", digits=8)
q("normalized_mutual_information", lambda n: P.normalized_mutual_information(n.labels), HX + "SELECT (hx + hy - hxy) / ((hx + hy) / 2) AS nmi FROM hh", "nmi", digits=8)
q("v_measure", lambda n: P.v_measure(n.labels, 0.5), HX + ", v AS (SELECT (hx + hy - hxy) / hx AS homogeneity, (hx + hy - hxy) / hy AS completeness FROM hh) SELECT *, 1.5 * homogeneity * completeness / (0.5 * homogeneity + completeness) AS v FROM v", "homogeneity completeness v", digits=8)
q("purity_score", lambda n: P.purity(n.labels), PRS + "SELECT sum(m) / sum(s) AS purity FROM (SELECT max(c) AS m, sum(c) AS s FROM t GROUP BY b)", "purity")
q("cluster_purity", lambda n: P.cluster_purity(n.labels), PRS + "SELECT b, max(c) / sum(c) AS purity FROM t GROUP BY b", "purity", "b")
q("confusion_matrix", lambda n: P.confusion(n.labels), PRS + "SELECT a, b, c FROM t", "", "a b c")
F1 = PRS + ", f AS (SELECT k AS class, 2 * coalesce(max(h), 0) / (sum(ta) + sum(tb)) AS f1 FROM (SELECT a AS k, sum(c) AS ta, 0 AS tb, sum(CASE WHEN a = b THEN c ELSE 0 END) AS h FROM t GROUP BY a UNION ALL SELECT b, 0, sum(c), 0 FROM t GROUP BY b) GROUP BY k) "
q("class_f1", lambda n: P.class_f1(n.labels), F1 + "SELECT class, f1 FROM f", "f1", "class")
q("annotation_quality_metrics", lambda n: P.classification_quality(n.labels), F1 + "SELECT (SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) FROM lab) AS accuracy, avg(f1) AS macro_f1 FROM f", "accuracy macro_f1")
q("community_sizes", lambda n: P.label_sizes(n.labels, "a"), with_("lab") + "SELECT a, count(*) AS n FROM lab GROUP BY a", "", "a n")
q("sort_communities_by_size", lambda n: P.relabel_by_size(n.labels.select("id", F.col("a").alias("label"))), with_("lab") + ", s AS (SELECT a, row_number() OVER (ORDER BY count(*) DESC, a) - 1 AS label FROM lab GROUP BY a) SELECT id, label FROM lab JOIN s USING (a)", "", "id label")
q("cell_type_proportions", lambda n: P.shares(n.labels, "a", "b"), with_("lab") + "SELECT b, a, count(*) / sum(count(*)) OVER (PARTITION BY b) AS share FROM lab GROUP BY 1, 2", "share", "a b")
# --- clones and lineage ------------------------------------------------------
CL = with_("clo") + ", sz AS (SELECT clone, CAST(count(*) AS DOUBLE) AS n FROM clo WHERE clone >= 0 GROUP BY 1) "
_c1 = lambda n: n.clones.where("cluster < 3")
_c2 = lambda n: n.clones.where("cluster >= 2 and clone < 20")
CL2 = with_("clo") + ", s1 AS (SELECT clone, CAST(count(*) AS DOUBLE) AS n FROM clo WHERE clone >= 0 AND cluster < 3 GROUP BY 1), s2 AS (SELECT clone, CAST(count(*) AS DOUBLE) AS n FROM clo WHERE clone >= 0 AND cluster >= 2 AND clone < 20 GROUP BY 1), jn AS (SELECT coalesce(s1.clone, s2.clone) AS clone, s1.n AS n1, s2.n AS n2 FROM s1 FULL JOIN s2 ON s1.clone = s2.clone) "
q("clone_size_distribution", lambda n: P.clone_sizes(n.clones), CL + "SELECT clone, n FROM sz", "", "clone n")
q("clonal_diversity", lambda n: P.clonal_diversity(n.clones), CL + "SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS shannon, 1 - sum(n * n) / power(sum(n), 2) AS simpson, 2 * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS r FROM sz)", "shannon simpson gini")
q("clone_dynamics", lambda n: P.clone_dynamics(_c1(n), _c2(n)), CL2 + "SELECT clone, log2((coalesce(n2, 0) + 1) / (coalesce(n1, 0) + 1)) AS rate FROM jn", "rate", "clone")
q("shared_clonotypes", lambda n: P.shared_clones(_c1(n), _c2(n)), CL2 + "SELECT clone FROM jn WHERE n1 > 0 AND n2 > 0", "", "clone")
q("clone_jaccard", lambda n: P.clone_jaccard(_c1(n), _c2(n)), CL2 + "SELECT sum(CASE WHEN n1 > 0 AND n2 > 0 THEN 1.0 ELSE 0 END) / count(*) AS jaccard FROM jn", "jaccard")
q("repertoire_overlap_morisita", lambda n: P.morisita_horn(_c1(n), _c2(n)), CL2 + "SELECT 2 * sum(p * q) / sum(p * p + q * q) AS overlap FROM (SELECT coalesce(n1, 0) / (SELECT sum(n) FROM s1) AS p, coalesce(n2, 0) / (SELECT sum(n) FROM s2) AS q FROM jn)", "overlap")
q("clonality_score", lambda n: P.clonality(n.clones), with_("clo") + ", t AS (SELECT cluster, clone, count(*) / max(s) AS p FROM clo JOIN (SELECT cluster, count(*) AS s FROM clo GROUP BY 1) USING (cluster) WHERE clone >= 0 GROUP BY 1, 2) SELECT cluster, CASE WHEN count(*) > 1 THEN 1 + sum(p * ln(p)) / ln(count(*)) ELSE 1 END AS clonality FROM t GROUP BY 1", "clonality", "cluster")
q("diversity_per_cluster", lambda n: P.diversity_per_cluster(n.clones), with_("clo") + ", t AS (SELECT cluster, clone, CAST(count(*) AS DOUBLE) AS n FROM clo WHERE clone >= 0 GROUP BY 1, 2) SELECT cluster, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS shannon, 1 - sum(n * n) / power(sum(n), 2) AS simpson FROM t GROUP BY 1", "shannon simpson", "cluster")
q("detect_expanded_clones", lambda n: P.expanded_clones(n.clones, 52), CL + "SELECT clone, n FROM sz WHERE n >= 52", "", "clone n")
q("clone_size_statistics", lambda n: P.clone_size_statistics(n.clones), CL + "SELECT avg(n) AS mean_size, quantile_cont(n, 0.5) AS median_size, max(n) AS max_size, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS n_singletons, count(*) AS n_clones FROM sz", "mean_size median_size", "max_size n_singletons n_clones")
FP = with_("clo") + ", t AS (SELECT clone, cluster, count(*) / sum(count(*)) OVER (PARTITION BY clone) AS p FROM clo WHERE clone >= 0 GROUP BY 1, 2) "
q("clone_transition_matrix", lambda n: P.clone_transitions(n.clones), FP + "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT a.cluster AS src, b.cluster AS dst, sum(a.p * b.p) AS w FROM t a JOIN t b USING (clone) GROUP BY 1, 2)", "p", "src dst")
q("clone_phenotype", lambda n: P.clone_profiles(n.m, n.clones), with_("m clo") + ", sz AS (SELECT clone, count(*) AS n FROM clo WHERE clone >= 0 GROUP BY 1) SELECT clone, j AS col, sum(v) / max(n) AS mean FROM m JOIN clo ON id = i JOIN sz USING (clone) GROUP BY 1, 2", "mean", "clone col")
q("clonal_fate_probability", lambda n: P.fate_probability(n.clones), FP + "SELECT clone, cluster AS type, p FROM t", "p", "clone type")
q("fate_bias", lambda n: P.fate_bias(n.clones), FP + "SELECT clone, 1 + sum(p * ln(p)) / ln(5) AS bias FROM t GROUP BY 1", "bias", "clone")
q("fate_bias_per_type", lambda n: P.fate_bias_per_type(n.clones), with_("clo") + ", t AS (SELECT cluster, clone, count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS p FROM clo WHERE clone >= 0 GROUP BY 1, 2) SELECT cluster AS type, 1 + sum(p * ln(p)) / ln((SELECT count(DISTINCT clone) FROM clo WHERE clone >= 0)) AS bias FROM t GROUP BY 1", "bias", "type")
q("lineage_commitment", lambda n: P.lineage_commitment(n.clones), FP + ", b AS (SELECT clone, 1 + sum(p * ln(p)) / ln(5) AS bias FROM t GROUP BY 1) SELECT id, coalesce(bias, 0) AS commitment FROM clo LEFT JOIN b USING (clone)", "commitment", "id")
q("lineage_sharing", lambda n: P.lineage_sharing(n.clones.where("id % 5 = 0")), with_("clo") + ", s AS (SELECT DISTINCT clone, cluster AS t FROM clo WHERE clone >= 0 AND id % 5 = 0) SELECT x.t AS a, y.t AS b, count(*) / ((SELECT count(*) FROM s WHERE s.t = x.t) + (SELECT count(*) FROM s WHERE s.t = y.t) - count(*)) AS jaccard FROM s x JOIN s y ON x.clone = y.clone AND x.t < y.t GROUP BY 1, 2", "jaccard", "a b")
q("build_lineage_tree", lambda n: P.lineage_tree(n.clones), CL + ", mt AS (SELECT clone, avg(t) AS t FROM clo WHERE clone >= 0 GROUP BY 1) SELECT clone, coalesce((SELECT b.clone FROM mt b WHERE b.t < a.t ORDER BY b.t DESC, b.clone LIMIT 1), -1) AS parent FROM mt a", "", "clone parent")
q("clone_generation", lambda n: P.clone_generation(n.tree), with_("tree") + "SELECT clone, CASE WHEN parent < 0 THEN 0 WHEN clone < 1000000 THEN 1 ELSE 2 END AS generation FROM tree", "", "clone generation")
q("lineage_distance", lambda n: P.lineage_distance(n.tree), "WITH RECURSIVE " + with_("tree")[5:] + ", up AS (SELECT clone, clone AS anc, 0 AS d FROM tree UNION ALL SELECT up.clone, parent, d + 1 FROM up JOIN tree ON tree.clone = anc WHERE parent >= 0) SELECT x.clone AS a, y.clone AS b, min(x.d + y.d) AS distance FROM up x JOIN up y ON x.anc = y.anc AND x.clone < y.clone GROUP BY 1, 2", "", "a b distance")
q("barcode_clone_assignment", lambda n: P.barcode_clones(n.clones.select("id", (F.col("id") * 31 % 97).alias("barcode"))), with_("clo") + "SELECT id, dense_rank() OVER (ORDER BY id * 31 % 97) - 1 AS clone FROM clo", "", "id clone")
q("progenitor_score", lambda n: P.progenitor_score(n.clones.withColumn("t", F.col("t") / 1000)), with_("clo") + "SELECT id, CASE WHEN clone >= 0 AND count(*) OVER (PARTITION BY clone) > 1 THEN exp(-(t / 1000 - min(t / 1000) OVER (PARTITION BY clone))) ELSE 0 END AS score FROM clo", "score", "id")
q("lineage_transition_probability", lambda n: P.lineage_transitions(n.clones), with_("clo") + ", s AS (SELECT cluster AS src, lead(cluster) OVER (PARTITION BY clone ORDER BY t, id) AS dst FROM clo WHERE clone >= 0) SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS p FROM s WHERE dst IS NOT NULL GROUP BY 1, 2", "p", "src dst")
q("modularity", lambda n: P.modularity(n.graph, n.vectors.select("id", F.col("label"))), with_("nb e ty") + ", k AS (SELECT src, sum(w) AS k FROM e GROUP BY 1) SELECT (SELECT sum(w) FROM e JOIN ty a ON a.id = src JOIN ty b ON b.id = dst WHERE a.type = b.type) / (SELECT sum(w) FROM e) - (SELECT sum(t * t) FROM (SELECT sum(k) AS t FROM k JOIN ty ON id = src GROUP BY type)) / power((SELECT sum(w) FROM e), 2) AS q", "q")
q("community_members", lambda n: P.community_members(n.labels.select("id", F.col("a").alias("label")), 2), with_("lab") + "SELECT id FROM lab WHERE a = 2", "", "id")
