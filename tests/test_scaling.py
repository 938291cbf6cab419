"""Work that has to stay in proportion to its input: draws, expansions, star-shaped graphs, long orders."""

from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import graph, graph_models
from tabwright.operators.indexing import expand_counts
from tabwright.plans import graph_queries
from tabwright.session import cut_lineage


def hashes_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("sha2(")


def test_long_orders_give_the_same_pairs(spark):
    rows = [(o, i % 37, (o * 7 + i * i) % 11) for o, n in ((1, 120), (2, 3), (3, 1), (4, 40)) for i in range(n)]
    rows += [(2, None, 5), (None, 1, 2), (None, 2, 3), (4, 1, None), rows[0]]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint")
    want = []
    for o in (1, 2, 3, 4):
        parts = [r[2] for r in sorted({r for r in rows if r[0] == o}, key=lambda r: [(v is not None, v or 0) for v in r])]
        want += [(min(a, b), max(a, b)) for a, b in zip(parts, parts[1:]) if a is not None and b is not None and a != b]
    for most in (10_000, 50, 2):
        assert sorted(map(tuple, graph_queries._line_pairs(lines, most).collect())) == sorted(want)


def test_every_draw_is_hashed_once(spark):
    assert hashes_of(graph_models.erdos_renyi(spark, 500, 0.01)) == 1
    assert hashes_of(graph_models.watts_strogatz(spark, 500, 4, 0.2)) == 2
    degrees = spark.range(50).select("id", F.lit(4).alias("degree"))
    assert hashes_of(graph_models.chung_lu(degrees)) == 2
    sizes = spark.createDataFrame([("a", 0, 30), ("b", 30, 20)], "block string, start bigint, size bigint")
    assert hashes_of(graph_models.stochastic_block(sizes, 0.2, 0.05)) == 2
    assert hashes_of(graph_models.barabasi_albert(spark, 100, 2)) <= graph_models.HOPS + 2


def test_drawn_columns_are_the_same_numbers(spark):
    rows = spark.range(200)
    plain = rows.select("id", keyed.index_below(1000, "x", F.col("id")).alias("a"), keyed.uniform("y", F.col("id")).alias("b"))
    drawn = keyed.with_drawn(rows, a=keyed.index_below(1000, "x", F.col("id")), b=keyed.uniform("y", F.col("id")))
    assert sorted(plain.collect()) == sorted(drawn.collect())


def test_few_rows_with_large_counts_are_expanded_in_many_tasks(spark):
    few = spark.createDataFrame([("a", 400_000), ("b", 0), ("c", 25_000)], "k string, n bigint")
    out = expand_counts(few, "n", "j")
    assert out.count() == 425_000
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_components_spread_the_links_of_hubs(spark, monkeypatch):
    keys = []

    def recorded(rows, facts, names, *rest):
        keys.append(tuple(names))
        return real(rows, facts, names, *rest)

    real = graph.fact_join
    monkeypatch.setattr(graph, "fact_join", recorded)
    pairs = [(0, i) for i in range(1, 3000)] + [(5000 + i, 9999) for i in range(2000)] + [(20_000 + i, 20_001 + i) for i in range(60)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = graph.connected_components(graph.node_table(edges), edges).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {(r.component, r.n) for r in got} == {(0, 3000), (5000, 2001), (20_000, 61)}
    assert {("dst",), ("src",)} == set(keys)


def test_stored_rows_keep_how_they_are_dealt(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = cut_lineage(spark.range(5000).withColumn("k", F.col("id") % 70).repartition(4, "k").sortWithinPartitions("k"), keep_layout=True)
        joined = held.join(spark.range(70).withColumnRenamed("id", "k").withColumn("v", F.col("k")), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
        assert joined.count() == 5000
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hubs_vote_in_parts_and_count_them_together(spark):
    # a hub whose neighbours hold two labels, 1200 and 1300 strong, after the first round
    pairs = [(10_000, 20_000 + i) for i in range(2500)] + [(1 if i < 1200 else 2, 20_000 + i) for i in range(2500)]
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "src bigint, dst bigint")
    nodes = graph.node_table(edges)
    labels = {r.id: r.community for r in graph.communities(nodes, edges, rounds=2).collect()}
    assert labels[10_000] == 2 and len(labels) == 2503
