"""k-means of all k and silhouettes from summaries, against numpy; ranges of stored matrices."""

import numpy as np
import pytest


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)


def test_silhouettes_and_fixed_points(spark):
    from tessella.operators.subclusters import find_optimal_subclusters, kmeans_all, silhouettes

    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(50, 5)) for c in np.eye(4, 5) * 14])
    labelled = kmeans_all(frame(spark, x), [2, 3, 4, 5], seed=2)
    rows = labelled.collect()
    score = {r.k: r.score for r in silhouettes(labelled).collect()}
    for k in (2, 3, 4, 5):
        label = np.zeros(200, int)
        for r in rows:
            if r.k == k:
                label[r.id] = r.label
        centres = np.array([x[label == c].mean(0) for c in range(k)])
        assert (((x[:, None] - centres[None]) ** 2).sum(2).argmin(1) == label).all()
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        s = []
        for i in range(200):
            own = (label == label[i]) & (np.arange(200) != i)
            a = d[i, own].mean() if own.any() else 0.0
            b = min(d[i, label == c].mean() for c in range(k) if c != label[i])
            s.append((b - a) / max(a, b))
        assert abs(score[k] - np.mean(s)) < 1e-9
    assert find_optimal_subclusters(frame(spark, x), 6).first().k == 4


@pytest.mark.parametrize("x", [np.zeros((9, 2)), np.zeros((30, 2)), np.zeros((0, 2))])
def test_few_or_equal_rows_are_one_cluster(spark, x):
    from tessella.operators.subclusters import find_optimal_subclusters

    assert find_optimal_subclusters(frame(spark, x), 3).collect()[0].k == 1


def test_ranges_prune_folders_and_row_groups(spark, tmp_path):
    from tessella.model import Matrix
    from tessella.sources.matrices import read_entries, write_entries

    e = spark.range(0, 40_000).selectExpr("id % 400 as row", "id div 400 as col", "cast(id as double) as v")
    a = Matrix(e, spark.range(400).withColumnRenamed("id", "row"), spark.range(100).withColumnRenamed("id", "col"))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "4096")
    try:
        write_entries(a, str(tmp_path / "m"), row_block=100)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    b = read_entries(spark, str(tmp_path / "m"), rows=(150, 260), cols=(10, 12))
    assert sorted(map(tuple, b.entries.collect())) == sorted((r, c, float(c * 400 + r)) for r in range(150, 260) for c in (10, 11))
    assert b.n_rows == 110 and b.n_cols == 2
    plan = b.entries._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(row,150)" in plan

    def rows_of_scan(df):
        run = df._jdf.queryExecution()
        run.toRdd().count()
        scan = next(p for p in leaves(run.executedPlan()) if "Scan" in p.nodeName())
        return {k: scan.metrics().apply(k).value() for k in ("numFiles", "numOutputRows")}

    def leaves(p):
        it = p.collectLeaves().iterator()
        while it.hasNext():
            yield it.next()

    whole, part = rows_of_scan(read_entries(spark, str(tmp_path / "m")).entries), rows_of_scan(b.entries)
    # Two of four folders, and of those the row groups that have the columns.
    assert whole["numOutputRows"] == 40_000 and part["numFiles"] == whole["numFiles"] // 2
    assert part["numOutputRows"] < 20_000 / 5
