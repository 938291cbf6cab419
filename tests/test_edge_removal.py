"""Edges are taken away in the right order, and no row of an edge carries its hash to the disk."""

from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tabwright.operators import graph_models, indexing


def left_over(edges, surplus):
    """What is left by sorting: protected edges last, then by the lower degree, then by hash."""
    digest = {e: sha256("|".join(["42", "keep", *[str(x) for x in e if x is not None]]).encode()).hexdigest() for e in edges}
    degree = Counter(x for e in edges for x in e)
    first = {x: min(digest[e] for e in edges if x in e) for x in degree}

    def turn(e):
        last = digest[e] in (first[e[0]], first[e[1]]) or min(degree[e[0]], degree[e[1]]) <= 1
        return last, 0 if last else min(degree[e[0]], degree[e[1]]), digest[e]

    gone = set(sorted((e for e in edges if None not in e), key=turn)[:surplus])
    return Counter(e for e in edges if e not in gone)


PAIRS = [(i % 23, (i * i + 5) % 31) for i in range(300)]
SIMPLE = sorted({(min(p), max(p)) for p in PAIRS if p[0] != p[1]})
ODD = [*PAIRS, *[(0, 100 + i) for i in range(40)], (None, 3), (3, None), (None, None), (7, 7), (500, 501)]


@pytest.mark.parametrize("rows", [SIMPLE, ODD])
@pytest.mark.parametrize("share", [0.001, 0.1, 0.5, 0.93, 1.0, 2.0])
def test_the_right_edges_go(spark, rows, share):
    edges = spark.createDataFrame(rows, "src bigint, dst bigint").repartition(3)
    surplus = max(1, int(len(rows) * share))
    got = Counter(tuple(r) for r in graph_models.remove_edges(edges, surplus).collect())
    assert got == left_over(rows, surplus)


def test_all_edges_may_share_one_node(spark):
    edges = spark.range(1, 3001).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    got = Counter(tuple(r) for r in graph_models.remove_edges(edges, 100).collect())
    assert got == left_over([(0, i) for i in range(1, 3001)], 100)


def test_hashes_of_edges_are_not_stored(spark, monkeypatch):
    stored = []

    def recorded(df, *rest, real=indexing.cut_lineage):
        out = real(df, *rest)
        stored.append((sum(kind == "string" for _, kind in out.dtypes), out.count()))
        return out

    monkeypatch.setattr(indexing, "cut_lineage", recorded)
    monkeypatch.setattr(graph_models, "cut_lineage", recorded)
    edges = spark.range(4000).select((F.col("id") % 97).alias("src"), (100 + F.col("id") % 89).alias("dst"))
    assert graph_models.remove_edges(edges, 400).count() == 3600
    assert all(n < 100 for strings, n in stored if strings)
