"""Queries that need no cell but their own are not moved again; samples are drawn once; curves may be flat."""

import numpy as np
from pyspark.sql import functions as F

from tabwright.operators import modelled, nearest


def test_queries_that_may_need_other_cells_are_told_at_home():
    draw = np.random.default_rng(3)
    for groups in (False, True):
        points, queries = draw.normal(size=(5000, 3)), draw.normal(size=(800, 3))
        queries[:40, 1:] = np.where(draw.random((40, 2)) < 0.5, np.nan, queries[:40, 1:])
        if groups:
            points[:, 0], queries[:, 0] = draw.integers(0, 3, 5000), draw.integers(0, 4, 800)
        tree = nearest.Tree(points, 60, groups)
        boxes = tree.over_cells(*nearest._boxes(points, tree.cell_of(points), tree.cells))
        bound = np.where(draw.random(800) < 0.05, np.inf, draw.random(800) * 0.3)
        row, cell = tree.reached(queries, bound, *boxes, groups)
        needed = set(row[cell != tree.cell_of(queries)[row]].tolist())
        told = set(np.flatnonzero(tree.leave_home(queries, bound, *boxes, groups)).tolist())
        assert needed <= told and len(told) < 700


def test_queries_are_stored_twice_at_most(spark, monkeypatch):
    stored = []

    def recorded(df, real=nearest.cut_lineage):
        out = real(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(nearest, "cut_lineage", recorded)
    # groups of points that lie far from each other, and a query beside each
    points = spark.range(400).select("id", (F.col("id") % 20 * 1000 + F.floor(F.col("id") / 20) * 0.01).alias("x"))
    queries = spark.range(317).select((F.col("id") + 5000).alias("id"), (F.col("id") % 20 * 1000 + 0.033).alias("x"))
    got = nearest.nearest(queries, points, ["x"], 2, cell_points=20).collect()
    assert {r.id: list(r.near) for r in got} == {5000 + i: [60 + i % 20, 80 + i % 20] for i in range(317)}
    assert stored.count(317) == 2


def test_flat_curves_have_no_correlation(spark):
    rows = spark.range(400).selectExpr("id", "double(id % 10) AS a", "double(id % 5) AS b")
    assert modelled.manifold_similarity(rows, rows.where("id < 300"), ["a", "b"], ["id"]).first().manifold_score == 0.0
    other = spark.range(400).selectExpr("id", "double(id * id) AS a", "double(id % 7) AS b")
    assert modelled.manifold_similarity(rows, other, ["a", "b"], ["id"]).first().manifold_score == 0.0
    assert modelled.manifold_similarity(other, other, ["a", "b"], ["id"]).first().manifold_score > 0.999999


def test_interactions_draw_their_samples_once(spark):
    rows = spark.range(500).selectExpr("id", "double(id % 37) AS a", "double(id % 41) AS b", "double(id % 43) AS c")
    out = modelled.interaction_preservation(rows, rows, ["a", "b", "c"], ["id"], 30)
    assert "sha2(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().score == 1.0


def test_queries_that_share_an_id_have_the_neighbours_of_all(spark):
    points = spark.range(60).select((F.col("id") + 100).alias("id"), (F.col("id") * 1.0).alias("x"))
    queries = spark.createDataFrame([(1, 5.1), (1, 50.2), (2, 20.1), (2, 20.1), (3, 30.1)], "id bigint, x double")
    for cell_points in (6, 8192):
        got = sorted((r.id, list(r.near)) for r in nearest.nearest(queries, points, ["x"], 2, cell_points=cell_points).collect())
        assert got == [(1, [105, 150]), (1, [105, 150]), (2, [120, 120]), (2, [120, 120]), (3, [130, 131])]
