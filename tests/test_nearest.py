"""Exact nearest rows against brute force; joins with heavy keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import compare, modelled, nearest
from tabwright.operators import synthesis as syn
from tabwright.operators.joins import fact_join


def brute(queries, points, k, groups):
    out = {}
    for i, g, q in queries:
        found = []
        for j, h, p in points:
            if i != j and (not groups or g == h):
                gaps = [(a - b) ** 2 for a, b in zip(q, p) if a is not None and b is not None]
                found.append((float(np.sqrt(sum(gaps))), j))
        out[i] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("groups", [False, True])
def test_nearest(spark, groups):
    draw = np.random.default_rng(4)
    rows = [(i, int(i % 4), [float(x) for x in draw.integers(0, 12, 3)]) for i in range(400)]
    rows += [(1000 + i, 1, [3.0, 3.0, 3.0]) for i in range(150)]  # a third of the rows is one point
    rows += [(2000 + i, 2, [None if draw.random() < 0.4 else float(x) for x in draw.normal(0, 9, 3)]) for i in range(40)]
    rows += [(3000, 9, [1.0, 1.0, 1.0]), (3001, 3, [1e9, -1e9, 0.0]), (3002, 3, [None, None, None])]
    df = spark.createDataFrame([(i, g, *x) for i, g, x in rows], "id bigint, g bigint, x double, y double, z double").repartition(5)
    got = nearest.nearest(df, df, ["x", "y", "z"], 4, "g" if groups else None, cell_points=30).collect()
    expected = brute(rows, rows, 4, groups)
    assert len(got) == len(rows)
    for r in got:
        assert list(r.near) == [j for _, j in expected[r.id]], r.id
        assert list(r.distance) == pytest.approx([d for d, _ in expected[r.id]])


def test_cells_are_found_down_the_tree(monkeypatch):
    draw = np.random.default_rng(7)
    points, queries = draw.normal(size=(20_000, 3)), draw.normal(size=(500, 3))
    tree = nearest.Tree(points, 2000, False)
    low, high = nearest._boxes(points, tree.cell_of(points), tree.cells)
    looked, plain = [], nearest.within
    monkeypatch.setattr(nearest, "within", lambda q, *more: looked.append(len(q)) or plain(q, *more))
    bound = np.full(len(queries), 0.05)
    got = set(zip(*(x.tolist() for x in tree.reached(queries, bound, *tree.over_cells(low, high), False))))
    gap = np.maximum(np.maximum(low[None] - queries[:, None], queries[:, None] - high[None]), 0)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.sqrt((gap**2).sum(2)) <= 0.05))))
    assert sum(looked) < len(queries) * tree.cells / 20


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, 2.0)], "id bigint, x double")
    assert [tuple(r) for r in nearest.nearest(df, df.limit(0), ["x"], 2).collect()] == [(1, [], [])]
    assert [tuple(r) for r in nearest.nearest(df, df, ["x"], 2).collect()] == [(1, [], [])]
    assert nearest.nearest(df.limit(0), df, ["x"], 2).collect() == []


def test_queries_of_one_cell_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TASK_QUERIES", 16)
    points = spark.range(200).select(F.col("id"), F.col("id").cast("double").alias("x"))
    queries = spark.range(300).select((F.col("id") + 1000).alias("id"), F.lit(50.2).alias("x"))
    got = nearest.nearest(queries, points, ["x"], 1, cell_points=20).collect()
    assert len(got) == 300 and {r.near[0] for r in got} == {50}


def test_every_synthetic_row_is_looked_at(spark):
    original = spark.range(3000).select((F.col("id") * 7.0).alias("v"), (F.col("id") % 11).cast("double").alias("w"))
    made = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 7.0 + 3.5).alias("v"), F.lit(None).cast("double").alias("w"))
    made = made.unionByName(original.limit(5).withColumn("k", F.lit(-1).cast("bigint")))
    out = compare.closest_record(original, made, ["v", "w"], ["k"])
    assert out.count() == 2005 and out.where("distance = 0").count() == 5
    assert out.where("distance > 0").agg(F.min("distance"), F.max("distance")).first()[0] > 0
    assert compare.privacy_score(original, made, ["v", "w"], ["k"]).first().exact_matches >= 5
    none = compare.closest_record(original.limit(0), made.limit(2), ["v"], ["k"]).collect()
    assert len(none) == 2 and all(r.distance is None for r in none)


def test_smote_of_several_classes(spark):
    rows = [(i, float(i % 30), "big", "a") for i in range(60)]
    rows += [(100 + i, 1000.0 + i, "mid", "m") for i in range(20)] + [(200 + i, -50.0 - i, "small", "s") for i in range(7)] + [(300, 1.0, None, "n")]
    t = spark.createDataFrame(rows, "k bigint, v double, y string, c string")
    out = syn.smote(t, "y", ["k"], k=3)
    sizes = {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"big": 60, "mid": 60, "small": 60, None: 1}
    new = out.where("is_synthetic").collect()
    assert all((r.y == "mid" and 1000 <= r.v <= 1019 and r.c == "m") or (r.y == "small" and -56 <= r.v <= -50 and r.c == "s") for r in new)


def test_fact_join(spark):
    rows = [(1, "a")] * 3000 + [(i, "b") for i in range(2, 60)] + [(None, "a"), (1, None)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    facts = df.where("k IS NOT NULL AND s IS NOT NULL AND k % 3 <> 0").groupBy("k", "s").agg(F.count("*").alias("n"), F.max("k").alias("f"))
    got = sorted(map(str, fact_join(df, facts, ["k", "s"], "n").collect()))
    assert got == sorted(map(str, df.join(facts, ["k", "s"], "left").collect()))


def test_covering_triples():
    assert modelled.covering_triples(list("abcdefgh")) == [list("abc"), list("def"), list("fgh")]
    assert modelled.covering_triples(list("ab")) == [] and modelled.covering_triples(list("abc")) == [list("abc")]


def test_a_forest_on_the_synthetic_rows_is_trained_once(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id AS k", "id % 37 AS a", "id % 41 AS b", "id % 43 AS c", "(id * 7) % 97 + id % 37 AS d")
    real, synthetic = rows.where("k % 3 > 0"), rows.where("k % 3 = 0")
    names, trained = ["a", "b", "c", "d"], []
    plain = modelled.RandomForestRegressor.fit
    alone = modelled.importance_preservation(real, synthetic, "d", names, 3).first()
    monkeypatch.setattr(modelled.RandomForestRegressor, "fit", lambda self, df: trained.append(1) or plain(self, df))
    fits = {}
    assert modelled.regression_efficacy(real, synthetic, "d", names, ["k"], 3, fits=fits) is not None
    assert modelled.importance_preservation(real, synthetic, "d", names, 3, fits=fits).first() == alone
    assert len(trained) == 3
