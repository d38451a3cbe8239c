"""Leading eigenvectors of graphs and what is built on them.

Orthogonal iteration: an iterate is a table ``id, x0 .. xk-1``; a step is one join
and aggregate of the edges, and the k x k matrix of its columns' products, all
that reaches the driver, gives the factor that makes them orthonormal.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..loops import cut
from ..model import Graph, Matrix
from .communities import kmeans
from .randomized import normal


def _products(y: DataFrame, names: list[str], others: list[str]) -> np.ndarray:
    row = y.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a in names for b in others)).first()
    return np.array(row, float).reshape(len(names), len(others))


def _mixed(y: DataFrame, names: list[str], m: np.ndarray) -> DataFrame:
    """The columns ``names`` times a small matrix."""
    return y.select("id", *(sum((F.col(a) * float(m[i, j]) for i, a in enumerate(names)), F.lit(0.0)).alias(b) for j, b in enumerate(names)))


def orthogonal_iteration(g: Graph, k: int, n_iter: int = 50, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(``id, x0 .. xk-1``, values): orthonormal columns that the graph's matrix maps into their span,
    and the eigenvalues of the k x k matrix between them, largest modulus first."""
    names = [f"x{j}" for j in range(k)]
    e = cut(g.edges.select("src", "dst", "w"))
    state = cut(g.nodes.select("id", *(normal("id", F.lit(j), seed=seed).alias(n) for j, n in enumerate(names))))

    def orthonormal(y: DataFrame) -> DataFrame:
        gram = _products(y, names, names)
        values, vectors = np.linalg.eigh(gram)
        return _mixed(y, names, vectors / np.sqrt(np.maximum(values, 1e-300)))

    def push(x: DataFrame) -> DataFrame:
        y = e.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))
        return g.over_nodes(y).select("id", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))

    state = orthonormal(state)
    for _ in range(n_iter):
        state = orthonormal(cut(push(state)))
    state = cut(state)
    image = push(state).select("id", *(F.col(n).alias("y" + n) for n in names))
    small = _products(state.join(image, "id"), names, ["y" + n for n in names])
    values, vectors = np.linalg.eig(small)
    order = np.argsort(-np.abs(values), kind="stable")
    turn = np.real(vectors[:, order])
    return _mixed(state, names, turn / np.linalg.norm(turn, axis=0)), np.real(values[order])


def _long(x: DataFrame, k: int) -> DataFrame:
    return x.select("id", F.posexplode(F.array(*(F.col(f"x{j}") for j in range(k)))).alias("dim", "x"))


def diffusion_map(transition: Graph, k: int, n_iter: int = 50) -> DataFrame:
    """``id, dim, x``: leading eigenvectors of the transition matrix times their eigenvalues."""
    x, values = orthogonal_iteration(transition, k, n_iter)
    scale = F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("dim") + 1)
    return _long(x, k).select("id", "dim", (F.col("x") * scale).alias("x"))


def top_eigenvectors(g: Graph, k: int, n_iter: int = 50) -> DataFrame:
    """``id, dim, x, value``."""
    x, values = orthogonal_iteration(g, k, n_iter)
    return _long(x, k).withColumn("value", F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("dim") + 1))


def diffusion_pseudotime(transition: Graph, root: int, k: int = 4, n_iter: int = 50) -> DataFrame:
    """``id, t``: distance to the root among the components, over the largest."""
    x = cut(diffusion_map(transition, k, n_iter))
    r = x.where(F.col("id") == root).select("dim", F.col("x").alias("r"))
    d = x.join(F.broadcast(r), "dim").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("r"), F.lit(2.0)))).alias("d"))
    return d.crossJoin(F.broadcast(d.agg(F.max("d").alias("m")))).select("id", F.coalesce(F.col("d") / F.nullif(F.col("m"), F.lit(0.0)), F.lit(0.0)).alias("t"))


def metastable_states(transition: Graph, k: int, n_iter: int = 50) -> DataFrame:
    """``id, label, state, p``: k-means among the components; memberships fall with exp(-d^2) to the means."""
    x = cut(diffusion_map(transition, k, n_iter))
    labels = cut(kmeans(x, k))
    means = x.join(labels, "id").groupBy(F.col("label").alias("state"), "dim").agg(F.avg("x").alias("m"))
    d = x.join(F.broadcast(means), "dim").groupBy("id", "state").agg(F.exp(-F.sum(F.pow(F.col("x") - F.col("m"), F.lit(2.0)))).alias("e"))
    total = d.groupBy("id").agg(F.sum("e").alias("t"))
    return d.join(total, "id").join(labels, "id").select("id", "label", "state", (F.col("e") / F.col("t")).alias("p"))


def nystrom(kernel: Graph, k: int, n_iter: int = 50) -> DataFrame:
    """``id, dim, x``: eigenvectors of a kernel times the roots of their eigenvalues."""
    x, values = orthogonal_iteration(kernel, k, n_iter)
    scale = F.element_at(F.array(*(F.lit(math.sqrt(max(float(v), 0.0))) for v in values)), F.col("dim") + 1)
    return _long(x, k).select("id", "dim", (F.col("x") * scale).alias("x"))


def low_rank_impute(a: Matrix, rank: int, n_iter: int = 20) -> DataFrame:
    """``row, col, v``: the rank-k approximation of the matrix, stored values kept and negative ones 0.

    Its space comes from the columns' products; the output is dense by definition."""
    o = a.entries.select("row", F.col("col").alias("dst"), F.col("v").alias("u"))
    e = a.entries.join(o, "row").groupBy(F.col("col").alias("src"), "dst").agg(F.sum(F.col("v") * F.col("u")).alias("w"))
    x, _ = orthogonal_iteration(Graph(e, a.cols.select(F.col("col").alias("id"))), rank, n_iter)
    v = cut(_long(x, rank).withColumnRenamed("id", "col").withColumnRenamed("x", "u"))
    score = cut(a.entries.join(v, "col").groupBy("row", "dim").agg(F.sum(F.col("v") * F.col("u")).alias("s")))
    low = score.join(v, "dim").groupBy("row", "col").agg(F.sum(F.col("s") * F.col("u")).alias("f"))
    kept = a.entries.where("v <> 0")
    return low.join(kept, ["row", "col"], "full").select("row", "col", F.coalesce("v", F.greatest(F.lit(0.0), F.col("f"))).alias("v"))
