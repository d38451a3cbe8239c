"""Files and streams."""

from pyspark.sql import functions as F

from tessella.model import Matrix
from tessella.operators.randomized import uniform_sample
from tessella.sources import matrices
from tessella.streaming.running import sample_batch, windowed_stats

SF = "/root/testdata/sf0.001"


def test_round_trips(spark, tmp_path):
    e = [(0, 0, 1.0), (0, 2, 2.0), (5, 1, 3.0)]
    a = Matrix(spark.createDataFrame(e, "row long, col long, v double"), spark.range(7).withColumnRenamed("id", "row"), spark.range(3).withColumnRenamed("id", "col"))
    matrices.write_entries(a, str(tmp_path / "m"), row_block=4)
    b = matrices.read_entries(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, b.entries.collect())) == e and b.n_rows == 7
    matrices.write_rows(a, str(tmp_path / "r"))
    assert sorted(map(tuple, matrices.read_rows(spark, str(tmp_path / "r")).entries.collect())) == e


def test_windowed_stats_equal_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = windowed_stats(s, "event_type", "value", width="1 day").writeStream.outputMode("complete").format("memory").queryName("stats").start()
    try:
        q.processAllAvailable()
        got = {(r.start, r.event_type): r.n for r in spark.table("stats").collect()}
    finally:
        q.stop()
    want = {(r.w.start, r.event_type): r.n for r in ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("value").alias("n")).collect()}
    assert got == want


def test_sample_of_batches(spark):
    parts = [spark.range(0, 400), spark.range(400, 1000)]
    s = sample_batch(parts[1], sample_batch(parts[0], None, 30, 5), 30, 5)
    assert {r.id for r in s.collect()} == {r.id for r in uniform_sample(spark.range(1000), 30, 5).collect()}
