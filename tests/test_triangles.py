"""Triangles are found from rows per edge, and statistics tidy the edges once."""

from itertools import combinations

from pyspark.sql import functions as F

from tabwright.operators import graph, joins


def brute(pairs):
    simple = {frozenset(p) for p in pairs if None not in p and p[0] != p[1]}
    ids = sorted({x for p in simple for x in p})
    return {frozenset(t) for t in combinations(ids, 3) if all(frozenset(x) in simple for x in combinations(t, 2))}


def found(spark, pairs, kind):
    edges = spark.createDataFrame(pairs, f"src {kind}, dst {kind}")
    rows = graph.triangles(edges).collect()
    assert len(rows) == len({frozenset(r) for r in rows})
    return {frozenset(r) for r in rows}


def test_triangles_of_hubs_repeats_loops_and_nulls(spark, monkeypatch):
    ring = [(i, (i + 1) % 40) for i in range(40)] + [(i, (i * i + 3) % 40) for i in range(40)]
    pairs = [*ring, *[(100, i) for i in range(40)], *[(i, 101) for i in range(0, 40, 2)], (100, 101), (3, 3), (5, None), (None, 7), (None, None), ring[0], ring[0][::-1]]
    want = brute(pairs)
    assert len(want) > 40
    assert found(spark, pairs, "bigint") == want
    named = [tuple(None if x is None else f"n{x}" for x in p) for p in pairs]
    assert found(spark, named, "string") == brute(named)
    # every node's edges by the way of hubs, and none
    for share in (1_000_000, 1):
        monkeypatch.setattr(joins, "HEAVY_SHARE", share)
        assert found(spark, pairs, "bigint") == want


def test_wedges_are_not_listed(spark):
    edges = spark.range(30).crossJoin(spark.range(30).select((F.col("id") + 100).alias("dst"))).withColumnRenamed("id", "src")
    out = graph.triangles(edges)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "LeftSemi" not in plan
    assert out.count() == 0


def test_statistics_tidy_the_edges_once(spark, monkeypatch):
    calls = []
    real = graph.simple_edges
    monkeypatch.setattr(graph, "simple_edges", lambda edges: calls.append(1) or real(edges))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (2, 1)], "src bigint, dst bigint")
    nodes = spark.range(1, 6)
    row = graph.graph_stats(nodes, real(edges)).first()
    assert (row.nodes, row.edges, row.connected_components) == (5, 4, 2)
    assert abs(row.clustering_coefficient - (1 + 1 + 1 / 3) / 5) < 1e-12
    assert len(calls) == 1
    tidy = real(edges).localCheckpoint()
    assert graph.graph_stats(nodes, tidy, simple=tidy).first() == row
    assert len(calls) == 1
