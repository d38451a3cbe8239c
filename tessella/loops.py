"""Driver loops whose state is cut to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder and goes on from it. Unlike a
    checkpointed plan, a table carries no inferred constraints, which grow with every round."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], max_iter: int, tol: float | None = None, key: str = "id", value: str = "x", norm: str = "l1", every: int | None = None) -> DataFrame:
    """Applies ``step`` up to ``max_iter`` times; stops when the change of ``value`` by ``key`` over
    ``every`` steps is below ``tol`` (sum of absolute changes, or the largest). The plan is cut every
    ``every`` steps (more than one only for steps that read the state once, else the plan doubles with
    each): with ``tol`` each, without it every few, if not told."""
    held, every = state, every or (1 if tol is not None else 3)
    for i in range(max_iter):
        state = step(state)
        if (i + 1) % every and i + 1 < max_iter:
            continue
        if tol is None:
            state = cut(state) if (i + 1) % every == 0 else state
            continue
        state = cut(state)
        change = F.abs(F.col("_new") - F.col("_old"))
        pair = state.select(key, F.col(value).cast("double").alias("_new")).join(held.select(key, F.col(value).cast("double").alias("_old")), key)
        delta = pair.agg((F.sum(change) if norm == "l1" else F.max(change)).alias("d")).first()["d"]
        held = state
        if delta is None or delta < tol:
            break
    return state
