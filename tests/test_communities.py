"""Leiden: what is refined shapes the levels after it, in the operator and in its queries."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessella.model import Graph
from tessella.operators import communities as C


@pytest.fixture()
def moves(monkeypatch):
    """Whether each phase refined; moves give four ids a community, refinement two."""
    calls = []

    def phase(edges, labels, resolution, max_rounds, seed, inside=None):
        calls.append(inside is not None)
        return labels.select("id", (F.col("id") - F.col("id") % (4 if inside is None else 2)).alias("label"))

    monkeypatch.setattr(C, "_local_moving", phase)
    return calls


def cliques(spark, k=2, size=4):
    e = [(c * size + i, c * size + j, 1.0) for c in range(k) for i, j in itertools.permutations(range(size), 2)]
    return Graph.of(spark.createDataFrame(e, "src long, dst long, w double"))


def test_no_refinement_without_a_level_after_it(spark, moves):
    assert {r.id: r.label for r in C.leiden(cliques(spark), max_levels=1).collect()} == {i: i - i % 4 for i in range(8)}
    assert moves == [False]


def test_registered_queries_use_what_is_refined(spark, moves, monkeypatch):
    """Every refinement of the query is followed by a level that moves its parts."""
    from tessella import registry
    from tessella.plans import inputs

    monkeypatch.setattr(inputs.Inputs, "graph", property(lambda self: cliques(spark)))
    assert registry.QUERIES["leiden"](spark, "/root/testdata/sf0.001").count() == 8
    assert moves == [False, True, False]
