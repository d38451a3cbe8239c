"""Pipeline stages on nulls, empty and very long texts, repeated rows, other columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from .test_llm import frame, model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (None, None), (3, rows[3][1]), (3, rows[3][1]), (102, " ".join(rng.choice(vocab) for _ in range(30_000))), (103, rows[5][1] + " end")]
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("source")))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs.cache(), path


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tables, empty):
    import corpus_pipeline

    model_path()
    docs, path = tables
    docs = docs.limit(0) if empty else docs
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, path)
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == COLUMNS, name
        rows = out.collect()
        if empty:
            assert not rows, name
        elif name == "near_copies":
            # The copies of 0, 3 and 5 are one row each; rows without words all stay.
            assert sorted(r.doc_id for r in rows if r.text and r.doc_id is not None) == [*range(40), 102]
            assert sum(not r.text for r in rows) == 3
        elif name == "repeats":
            assert len(rows) == docs.count()
        elif last:
            assert len(rows) == docs.count() and all(r.n_tokens == len(r.ids) >= 1 for r in rows)
