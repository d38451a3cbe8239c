"""Sparse regression of ``row, y`` on a matrix's columns, by distributed gradients.

A step is two joins: residuals from the coefficients (X b), then the gradient
(X' r). The step size is 1 / L with L from power iteration on X'X. Coordinate
descent would visit columns one after the other; the same optimum is reached here
by accelerated proximal steps over all columns at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Matrix

EPS = 1e-12


def soft(x: Column, t: Column | float) -> Column:
    return F.signum(x) * F.greatest(F.lit(0.0), F.abs(x) - t)


def prox_l1(x: DataFrame, lam: float) -> DataFrame:
    return x.select("id", soft(F.col("x"), lam).alias("x"))


def prox_elastic_net(x: DataFrame, lam: float, l1_ratio: float) -> DataFrame:
    return x.select("id", (soft(F.col("x"), lam * l1_ratio) / (1 + lam * (1 - l1_ratio))).alias("x"))


def proximal(kind: str, t: float, l1_ratio: float = 0.5, gamma: float = 3.7):
    """The proximal map of a penalty with weight t."""

    def scad(x: Column) -> Column:
        a = F.abs(x)
        mid = ((gamma - 1) * x - F.signum(x) * gamma * t) / (gamma - 2)
        return F.when(a <= 2 * t, soft(x, t)).when(a <= gamma * t, mid).otherwise(x)

    def mcp(x: Column) -> Column:
        return F.when(F.abs(x) <= gamma * t, soft(x, t) / (1 - 1 / gamma)).otherwise(x)

    maps = {"l1": lambda x: soft(x, t), "l2": lambda x: x / (1 + t), "elastic_net": lambda x: soft(x, t * l1_ratio) / (1 + t * (1 - l1_ratio)), "scad": scad, "mcp": mcp}
    return maps[kind]


def lipschitz(a: Matrix, n_iter: int = 15) -> float:
    """Largest eigenvalue of X'X by power iteration."""
    v = cut(a.cols.select("col", F.lit(1.0).alias("x")))
    top = 1.0
    for _ in range(n_iter):
        xv = a.entries.join(v, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("x")).alias("r"))
        w = cut(a.entries.join(xv, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("r")).alias("x")))
        top = w.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        v = w.select("col", (F.col("x") / top).alias("x"))
    return float(top)


def normal_equations(a: Matrix, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``col, o, g`` = X'X, ``col, c`` = X'y): the rows are read once, iterations stay among columns."""
    e = cut(a.entries.select("row", "col", F.col("v").cast("double").alias("v")))
    g = e.join(e.select("row", F.col("col").alias("o"), F.col("v").alias("u")), "row").groupBy("col", "o").agg(F.sum(F.col("v") * F.col("u")).alias("g"))
    c = e.join(y, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("y")).alias("c"))
    return cut(g), cut(a.over_cols(c).select("col", F.coalesce("c", F.lit(0.0)).alias("c")))


def _gradient(eq: tuple[DataFrame, DataFrame], b: DataFrame) -> DataFrame:
    """``col, g`` = X'X b - X'y."""
    gram, c = eq
    gb = gram.join(b.select(F.col("col").alias("o"), "b"), "o").groupBy("col").agg(F.sum(F.col("g") * F.col("b")).alias("gb"))
    return c.join(gb, "col", "left").select("col", (F.coalesce("gb", F.lit(0.0)) - F.col("c")).alias("g"))


def proximal_gradient(a: Matrix, y: DataFrame, alpha: float, kind: str = "l1", max_iter: int = 100, tol: float = 1e-6, accelerate: bool = False, l1_ratio: float = 0.5, scale: float = 1.0) -> DataFrame:
    """``col, b`` minimising |X b - y|^2 / 2 + alpha * scale * penalty."""
    step, eq = 1.0 / (1.01 * lipschitz(a)), normal_equations(a, y)
    prox = proximal(kind, alpha * scale * step, l1_ratio)
    b = a.cols.select("col", F.lit(0.0).alias("b"), F.lit(0.0).alias("z"))
    t = 1.0
    for _ in range(max_iter):
        g = _gradient(eq, b.select("col", F.col("z").alias("b")))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2 if accelerate else 1.0
        mom = (t - 1) / t_new if accelerate else 0.0
        n = b.join(g, "col").select("col", F.col("b").alias("old"), prox(F.col("z") - step * F.col("g")).alias("b"))
        b, t = n.select("col", "b", (F.col("b") + mom * (F.col("b") - F.col("old"))).alias("z"), F.abs(F.col("b") - F.col("old")).alias("d")), t_new
        b = cut(b)
        d = b.agg(F.max("d"), F.max(F.abs("b"))).first()
        if (d[0] or 0.0) <= tol * max(d[1] or 0.0, 1.0):
            break
    return b.select("col", "b")


def ista(a, y, alpha, **kw) -> DataFrame:
    return proximal_gradient(a, y, alpha, "l1", **kw)


def fista(a, y, alpha, **kw) -> DataFrame:
    return proximal_gradient(a, y, alpha, "l1", accelerate=True, **kw)


def lasso(a: Matrix, y: DataFrame, alpha: float, **kw) -> DataFrame:
    """The lasso with the penalty alpha * n (rows)."""
    return proximal_gradient(a, y, alpha, "l1", accelerate=True, scale=float(a.n_rows), **kw)


def elastic_net(a: Matrix, y: DataFrame, alpha: float, l1_ratio: float, **kw) -> DataFrame:
    return proximal_gradient(a, y, alpha, "elastic_net", accelerate=True, l1_ratio=l1_ratio, scale=float(a.n_rows), **kw)


def lasso_path(a: Matrix, y: DataFrame, alphas: list[float], **kw) -> DataFrame:
    out = None
    for x in alphas:
        d = lasso(a, y, x, **kw).select(F.lit(float(x)).alias("alpha"), "col", "b")
        out = d if out is None else out.unionByName(d)
    return out


def iht(a: Matrix, y: DataFrame, sparsity: int, max_iter: int = 50) -> DataFrame:
    """Iterative hard thresholding: a gradient step, then the ``sparsity`` largest coefficients stay."""
    step, eq = 1.0 / (1.01 * lipschitz(a)), normal_equations(a, y)
    b = a.cols.select("col", F.lit(0.0).alias("b"))
    for _ in range(max_iter):
        n = a.over_cols(b).join(_gradient(eq, b), "col").select("col", (F.coalesce("b", F.lit(0.0)) - step * F.col("g")).alias("b"))
        b = n.where("b <> 0").orderBy(F.desc(F.abs("b")), "col").limit(sparsity)
        b = cut(b)
    return a.over_cols(b).select("col", F.coalesce("b", F.lit(0.0)).alias("b"))


def group_lasso(a: Matrix, y: DataFrame, groups: DataFrame, alpha: float, max_iter: int = 100) -> DataFrame:
    """``col, b``: blocks (``col, grp``) shrunk together at alpha * sqrt(size)."""
    step, eq = 1.0 / (1.01 * lipschitz(a)), normal_equations(a, y)
    w = Window.partitionBy("grp")
    b = a.cols.select("col", F.lit(0.0).alias("b"))
    for _ in range(max_iter):
        n = b.join(_gradient(eq, b), "col").join(groups, "col").select("col", "grp", (F.col("b") - step * F.col("g")).alias("u"))
        norm = F.sqrt(F.sum(F.col("u") * F.col("u")).over(w))
        b = n.select("col", (F.col("u") * F.greatest(F.lit(0.0), 1 - alpha * step * F.sqrt(F.count(F.lit(1)).over(w)) / F.greatest(norm, F.lit(EPS)))).alias("b"))
        b = cut(b)
    return b


def sparse_logistic(a: Matrix, y: DataFrame, alpha: float, max_iter: int = 100) -> DataFrame:
    """``col, b`` (col -1: intercept) of an L1 logistic model of ``row, y`` in 0, 1."""
    ones = y.select("row", F.lit(-1).cast("long").alias("col"), F.lit(1.0).alias("v"))
    full = Matrix(a.entries.select("row", "col", "v").unionByName(ones), a.rows, a.cols.unionByName(a.cols.sparkSession.range(1).select(F.lit(-1).cast("long").alias("col"))))
    step = 4.0 / (1.01 * lipschitz(full))
    b = cut(full.cols.select("col", F.lit(0.0).alias("b")))
    for _ in range(max_iter):
        xb = full.entries.join(b.where("b <> 0"), "col").groupBy("row").agg(F.sum(F.col("v") * F.col("b")).alias("p"))
        r = y.join(xb, "row", "left").select("row", (1 / (1 + F.exp(-F.coalesce("p", F.lit(0.0)))) - F.col("y")).alias("r"))
        g = full.entries.join(r, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("r")).alias("g"))
        u = F.col("b") - step * F.coalesce("g", F.lit(0.0))
        b = b.join(g, "col", "left").select("col", F.when(F.col("col") == -1, u).otherwise(soft(u, alpha * step)).alias("b"))
        b = cut(b)
    return b
