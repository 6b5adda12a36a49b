"""Neighbours by blocks that are read again instead of exchanged."""

import numpy as np

from kelpwood.operators import hierarchy, neighbours
from kelpwood.operators.graph import checkpointed


def _vectors(spark, n=700, copies=40):
    x = np.random.default_rng(4).normal(size=(n, 8)).round(3)
    x[-copies:] = x[0]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)


def test_pairs_of_blocks_are_not_exchanged(spark, monkeypatch):
    """What leaves the comparison is a list for each block and part of the blocks, however many blocks it met."""
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "HELD", 16 << 10)
    _, df = _vectors(spark)
    points, apart, _, _ = neighbours.dealt(df, "id", "v")
    blocks = neighbours.packed(points)
    pairs = neighbours.met(blocks, np.ones(apart.shape, bool))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
    count, parts = blocks.count(), -(-700 * 8 * 8 // (16 << 10))
    assert pairs.count() == count**2 and count > 10 * parts
    assert count <= pairs.mapInArrow(neighbours._nearest_rows(3), neighbours.FOUND).count() <= count * parts


def test_nearest_of_parts(spark, monkeypatch):
    """Blocks in several parts, copies among them: the distances and ids of brute force, ties to the lesser id."""
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "HELD", 16 << 10)
    x, df = _vectors(spark)
    got = {r["id"]: r for r in neighbours.k_nearest(df, "id", "v", 5, unit=False).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:5]
        assert got[i]["nbr"] == order.tolist() and np.allclose(got[i]["d"], d[i][order], rtol=1e-12, atol=0)


def test_shortest_edges_of_parts(spark, monkeypatch):
    """Each component's shortest edge to another one, where its block meets the others in several tasks."""
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "HELD", 16 << 10)
    x, df = _vectors(spark, copies=1)
    points, apart, _, _ = neighbours.dealt(df, "id", "v")
    blocks = neighbours.packed(points)
    state = checkpointed(points.selectExpr("id", "block", "id % 7 / 10D as core", "id % 50 as comp"))
    marked = checkpointed(blocks.join(hierarchy._marked(state), "block").select(*blocks.columns, "core", "comp"))
    found = neighbours.met(marked, np.ones(apart.shape, bool)).mapInArrow(hierarchy._shortest_rows, hierarchy.EDGE)
    got = {r["c"]: r["e"] for r in hierarchy._shortest(found).collect()}
    i = np.arange(len(x))
    w = np.maximum(np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), i[:, None] % 7 / 10), i % 7 / 10)
    w[i[:, None] % 50 == i % 50] = np.inf
    for c in range(50):
        e = got[c]
        assert np.isclose(e["w"], w[i % 50 == c].min(), rtol=1e-12) and np.isclose(w[e["a"], e["b"]], e["w"]) and {e["a"] % 50, e["b"] % 50} == {e["ca"], e["cb"]} and c in (e["ca"], e["cb"])
