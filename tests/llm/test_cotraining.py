"""The co-trained classifier: what the views tell each other, by brute force, and that it matters."""

import random

import numpy as np
from pyspark.sql import functions as F

from .test_llm import frame


def corpus(n=900, seed=3):
    """Sources s0 (good) and s1 (bad). Labelled documents have few of the words that the others use, each too rarely to be fitted."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        bad = i % 2
        kind = "ab"[bad]
        known = i < n // 3
        own = [f"{kind}x{rng.randrange(12)}" if known and rng.random() < 0.9 else f"{kind}y{rng.randrange(200)}" for _ in range(25)]
        docs.append((i, " ".join(own + [f"c{rng.randrange(80)}" for _ in range(25)]), f"s{bad}"))
        if known:
            labels.append((i, 1 - bad, 0))
    # Documents without a source: only their words tell.
    docs += [(10_000 + i, " ".join([f"{'ab'[i % 2]}y{rng.randrange(200)}" for _ in range(25)] + [f"c{rng.randrange(80)}" for _ in range(25)]), None) for i in range(60)]
    return docs, labels


def tables(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(i, t, "en", s, 200, "clash") for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long, words string").repartition(3)
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_views_teach_each_other(spark):
    from tessella.llm.quality import classify

    df, labels = tables(spark)
    right = {}
    for rounds in (0, 3):
        got = classify(df, labels, rounds=rounds).where("doc_id >= 10000").collect()
        right[rounds] = np.mean([r.text_score > 0.5 if r.doc_id % 2 == 0 else r.text_score < 0.5 for r in got])
    assert right[3] > 0.95 > right[0] + 0.2, right


def test_what_is_told(spark):
    """Counts of one exchange over the whole table."""
    from tessella.llm.quality import CONFIDENT, _read, features, fit, told

    df, labels = tables(spark)
    rows = features(df)
    model = fit(rows, labels, rounds=0)
    pool = rows.where("doc_id >= 300")
    got = told(pool, model)
    t = pool.toArrow()
    doc, bucket, shapes, meta = _read(t)
    p = [1 / (1 + np.exp(-z)) for z in model.logits(doc, bucket, shapes, meta)]
    feats = [[set(bucket[doc == i].tolist()) for i in range(len(meta))], [list(m) for m in meta.tolist()]]
    told_any = 0
    for view in (0, 1):
        want, docs = {}, [0, 0]
        for i, f in enumerate(feats[view]):
            other = p[1 - view][i]
            if other > CONFIDENT or other < 1 - CONFIDENT:
                bad = int(other > 0.5)
                docs[bad] += 1
                for x in f:
                    want[x, bad] = want.get((x, bad), 0) + 1
        counts, n = got[view]
        assert n.tolist() == docs and {(a, b): counts[a, b] for a, b in zip(*np.nonzero(counts))} == want
        told_any += sum(docs)
    assert told_any > 100


def test_edges_of_the_table(spark):
    """Very long, empty and null texts, null metadata, repeated rows and ids, ties, no labels."""
    from tessella.llm.quality import classify, keep_good

    df, labels = tables(spark)
    long = " ".join(f"by{i % 12}" for i in range(60_000))
    odd = frame(spark, [(20_000, long), (20_001, ""), (20_002, None), (20_003, "%" * 5000), (None, "ay1 ay2"), (0, "ax1"), (0, "ax1"), (0, long)]).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.lit("x").alias("words"))
    every = df.unionByName(odd)
    got = classify(every, labels.union(labels.limit(3)))
    assert got.count() == every.count() and got.where("score is null or isnan(score)").count() == 0
    same = [r for r in got.where("doc_id = 0").collect()]
    assert len(same) == 4
    scored = {(r.doc_id, r.keep) for r in got.where("doc_id between 10 and 400").collect()}
    kept = {r.doc_id for r in keep_good(every, labels.union(labels.limit(3))).where("doc_id between 10 and 400").collect()}
    assert kept == {i for i, k in scored if k}
    assert keep_good(every, labels.limit(0)).count() == every.count() and keep_good(every.limit(0), labels).count() == 0
