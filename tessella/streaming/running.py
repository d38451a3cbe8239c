"""Streaming variants: windowed group statistics and a mergeable uniform sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(stream: DataFrame, key: str, value: str, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, key, n, total, mean, var`` of tumbling windows; rows later than the watermark are dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks take zoned timestamps
    g = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key))
    return g.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).select(F.col("w.start").alias("start"), key, "n", "total", "mean", "var")


def sample_batch(batch: DataFrame, sample: DataFrame | None, n: int, seed: int = 0) -> DataFrame:
    """The sample after one more batch (``id``): the n smallest hashes of both."""
    both = batch.select("id") if sample is None else batch.select("id").unionByName(sample.select("id")).distinct()
    return both.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
