"""Matrices from and to files: entry tables and row arrays (HDF5: see ``hdf5``)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Matrix
from ..operators.matrix import from_csr, to_csr


def write_entries(a: Matrix, path: str, row_block: int = 1 << 20) -> None:
    """Entries as Parquet in folders of row blocks, sorted by column inside: a range of rows prunes folders, a range of columns row groups and pages."""
    e = a.entries.withColumn("block", F.floor(F.col("row") / row_block).cast("long"))
    e.repartition("block").sortWithinPartitions("block", "col", "row").write.mode("overwrite").partitionBy("block").parquet(f"{path}/entries")
    a.rows.write.mode("overwrite").parquet(f"{path}/rows")
    a.cols.write.mode("overwrite").parquet(f"{path}/cols")
    a.entries.sparkSession.range(1).select(F.lit(row_block).cast("long").alias("row_block")).write.mode("overwrite").parquet(f"{path}/size")


def read_entries(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> Matrix:
    """The matrix, or its part in half-open ranges of ids: of ``rows`` only the folders that hold some
    are listed, of ``cols`` only the row groups and pages whose statistics reach into the range are read."""
    e, r, c = spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cols")
    if rows is not None:
        size = spark.read.parquet(f"{path}/size").first()["row_block"]
        inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1])
        e = e.where((F.col("block") >= rows[0] // size) & (F.col("block") <= (rows[1] - 1) // size) & inside)
        r = r.where(inside)
    if cols is not None:
        inside = (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
        e, c = e.where(inside), c.where(inside)
    return Matrix(e.select("row", "col", "v"), r, c)


def write_rows(a: Matrix, path: str) -> None:
    """One row of index and value arrays for each matrix row."""
    to_csr(a).write.mode("overwrite").parquet(path)


def read_rows(spark: SparkSession, path: str) -> Matrix:
    return from_csr(spark.read.parquet(path))
