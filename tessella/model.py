"""Canonical tables: a sparse matrix, a graph, vectors.

A matrix is its stored entries ``row, col, v`` with the domains of row and column
ids, so implicit zeros are counted and never materialised. A graph is ``src, dst,
w`` with the domain of its nodes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Matrix:
    entries: DataFrame  # row, col, v
    rows: DataFrame  # row
    cols: DataFrame  # col
    name: str = field(default="")

    @classmethod
    def of(cls, entries: DataFrame) -> Matrix:
        """A matrix whose domains are the ids that occur."""
        return cls(entries, entries.select("row").distinct(), entries.select("col").distinct())

    @cached_property
    def n_rows(self) -> int:
        return self.rows.count()

    @cached_property
    def n_cols(self) -> int:
        return self.cols.count()

    @property
    def T(self) -> Matrix:
        e = self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
        return Matrix(e, self.cols.select(F.col("col").alias("row")), self.rows.select(F.col("row").alias("col")))

    def over_rows(self, df: DataFrame) -> DataFrame:
        """``df`` (with a row column) for every row of the domain."""
        return self.rows.join(df, "row", "left")

    def over_cols(self, df: DataFrame) -> DataFrame:
        return self.cols.join(df, "col", "left")

    def with_entries(self, entries: DataFrame) -> Matrix:
        return Matrix(entries, self.rows, self.cols)


@dataclass
class Graph:
    edges: DataFrame  # src, dst, w
    nodes: DataFrame  # id

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @classmethod
    def of(cls, edges: DataFrame) -> Graph:
        return cls(edges, edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())

    def matrix(self) -> Matrix:
        e = self.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("v"))
        return Matrix(e, self.nodes.select(F.col("id").alias("row")), self.nodes.select(F.col("id").alias("col")))

    def over_nodes(self, df: DataFrame) -> DataFrame:
        return self.nodes.join(df, "id", "left")


def zero(c: str):
    """The column with null as zero, for ids without entries."""
    return F.coalesce(F.col(c), F.lit(0.0)).alias(c)
