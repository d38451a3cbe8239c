"""Doublets: simulated rows, and the share of them among a row's nearest neighbours.

One exact search (``blocks``) runs over observed and simulated rows together: observed
rows ask and give, simulated ones only give. No profile is made dense outside a pair
of blocks, and simulated rows are joins of stored entries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Matrix
from .blocks import block_knn, rows_of, rows_of_vectors
from .testing import positions

#: Neighbours looked at and simulated rows for an observed one.
NEIGHBOURS, PER_ROW = 30, 2


def draw(*cols, seed: int = 0) -> Column:
    """A number in [0, 1) from the MD5 of ids and a seed, which any SQL engine can draw too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def parents(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``new, row``: for each of ``n`` simulated rows -1, -2, ... two distinct rows (``row``) drawn evenly."""
    at = positions(rows.select(F.col("row").alias("id")))
    m = F.lit(rows.count())
    d = rows.sparkSession.range(n)
    p, q = F.floor(draw("id", seed=seed + 1) * m), F.floor(draw("id", seed=seed + 2) * (m - 1))
    d = d.select((-F.col("id") - 1).alias("new"), p.alias("p"), q.alias("q")).select("new", F.explode(F.array("p", F.when(F.col("q") >= F.col("p"), F.col("q") + 1).otherwise(F.col("q")))).alias("pos"))
    return d.join(at, "pos").select("new", F.col("id").alias("row"))


def simulate_doublets(a: Matrix, n: int, seed: int = 0) -> DataFrame:
    """``row, col, v``: averages of two distinct rows; simulated rows are -1, -2, ..."""
    return parents(a.rows, n, seed).join(a.entries, "row").groupBy(F.col("new").alias("row"), "col").agg((F.sum("v") / 2).alias("v"))


def simulate_vectors(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``id, x``: averages of two distinct vectors of ``id, x``."""
    two = parents(vectors.select(F.col("id").alias("row")), n, seed).join(vectors.select(F.col("id").alias("row"), "x"), "row")
    both = two.groupBy("new").agg(F.array_sort(F.collect_list(F.struct("row", "x"))).alias("v"))  # two
    return both.select(F.col("new").alias("id"), F.zip_with(F.col("v")[0]["x"], F.col("v")[1]["x"], lambda p, q: (p + q) / 2).alias("x"))


def _scores(observed: DataFrame, simulated: DataFrame, k: int, metric: str = "euclidean", n_cols: int | None = None) -> DataFrame:
    """``row, score``: the share of simulated rows among the k nearest of all other rows. Simulated rows
    are numbered behind the observed ones, which so come first among equally near ones."""
    last = observed.agg(F.max("row")).first()[0]
    after = simulated.withColumn("row", F.lit((last or 0) + 0) - F.col("row"))
    near = block_knn(observed, after, k, metric=metric, both=True, n_cols=n_cols)
    return near.groupBy("row").agg((F.sum((F.col("nbr") > F.lit(last)).cast("double")) / k).alias("score"))


def knn_doublet_scores(a: Matrix, simulated: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``row, score`` of every row of ``a`` against its other rows and ``simulated`` (``row, col, v``, rows -1, -2, ...)."""
    return _scores(rows_of(a), rows_of(Matrix.of(simulated)), k)


def vector_doublet_scores(vectors: DataFrame, simulated: DataFrame, k: int) -> DataFrame:
    """As ``knn_doublet_scores`` for dense ``id, x``, as of a projection."""
    return _scores(rows_of_vectors(vectors), rows_of_vectors(simulated), k)


def scrublet_scores(a: Matrix, n_simulated: int | None = None, k: int = NEIGHBOURS, seed: int = 0) -> DataFrame:
    """``row, score``: simulates doublets (two for a row, if not told) and scores all rows against them."""
    return knn_doublet_scores(a, simulate_doublets(a, n_simulated or PER_ROW * a.n_rows, seed), k)


def pann_scores(vectors: DataFrame, simulated: DataFrame, share: float) -> DataFrame:
    """``row, score`` with k = ``share`` of all rows, observed and simulated."""
    return vector_doublet_scores(vectors, simulated, max(1, math.ceil(share * (vectors.count() + simulated.count()))))
