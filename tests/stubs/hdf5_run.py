"""Writes, reads, fails and lists under the folder given; prints what it saw."""

import shutil
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.model import Matrix
from tessella.sources.hdf5 import read_hdf5, register, write_hdf5

place = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
entries = sorted((r, c, float(r * 100 + c)) for r in range(0, 60, 2) for c in range(r % 7 + 1))
entries += [(61, c, 1.5) for c in range(50)]
a = Matrix(spark.createDataFrame(entries, "row long, col long, v double").repartition(4), spark.range(70).withColumnRenamed("id", "row"), spark.range(60).withColumnRenamed("id", "col"))
read = lambda p, n=1 << 20: read_hdf5(spark, f"{place}/{p}", entries=n)
rows = lambda d: sorted(map(tuple, d.collect()))
out = {"entries": entries}
write_hdf5(a, f"{place}/m")
out["back"] = rows(read("m", 20))
out["splits"] = read("m", 20).rdd.getNumPartitions()
import glob  # noqa: E402

out["files"] = len(glob.glob(f"{place}/m/*.h5"))
shutil.copytree(f"{place}/m", f"{place}/ranged", ignore=shutil.ignore_patterns("*.reads"))
out["part"] = rows(read("ranged").where("row >= 20 and row < 23"))
write_hdf5(a, f"{place}/m")
out["appended"] = read("m").count()
write_hdf5(a, f"{place}/m", mode="overwrite")
out["overwritten"] = read("m").count()
bad = Matrix(a.entries.withColumn("v", F.when(F.col("row") == 61, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double")), a.rows, a.cols)
try:
    write_hdf5(bad, f"{place}/failed")
    out["failed"] = False
except Exception:
    out["failed"] = True
register(spark)
spark.createDataFrame([(f,) for f in glob.glob(f"{place}/m/*.h5")], "path string").createOrReplaceTempView("files")
out["objects"] = [(r.object, r.kind, r.shape, r.attributes) for r in spark.sql("SELECT o.* FROM files, LATERAL hdf5_objects(files.path) AS o").collect()]
print(out)
