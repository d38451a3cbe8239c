"""Registration of queries with their SQL; results are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Matrix
from .inputs import Inputs

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to some digits (no negative zero), whole numbers as long."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        out.append((F.round(c, digits) + 0.0).alias(f.name) if kind in ("double", "float") else c.cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)


def q(name: str, build: Callable[[Inputs], DataFrame | Matrix], sql: str | None = None, d: str = "", i: str = "", digits: int = 6) -> None:
    """Registers ``build``; ``sql`` is wrapped so that the columns ``d`` are rounded and ``i`` are BIGINT."""

    def run(spark, sf_dir: str) -> DataFrame:
        out = build(Inputs(spark, sf_dir))
        return rounded(out.entries.select("row", "col", "v") if isinstance(out, Matrix) else out, digits)

    assert name not in QUERIES, name
    QUERIES[name] = run
    if sql:
        parts = [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0::DOUBLE AS "{c}"' for c in d.split()] + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in i.split()]
        ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})" if parts else sql
