"""Graphs with hubs, rare open wedges, one large community; draws from tables of any length."""

import itertools

from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import draws, graph, graph_models, logs
from tabwright.operators import synthesis as syn
from tabwright.operators.indexing import with_running_sum


def edges_of(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src bigint, dst bigint")


def test_the_last_open_wedges_are_closed(spark):
    pairs = set(itertools.combinations(range(14), 2)) - {(0, 1), (5, 9), (2, 13)}
    df = edges_of(spark, pairs)
    assert {tuple(r) for r in graph_models.open_pairs(df).collect()} == {(0, 1), (5, 9), (2, 13)}
    closed = graph_models.close_triads(df, 50).collect()
    assert {tuple(r) for r in closed} == set(itertools.combinations(range(14), 2)) and len(closed) == 91
    assert graph_models.close_triads(df, 2).count() == len(pairs) + 2
    whole = edges_of(spark, itertools.combinations(range(6), 2))
    assert graph_models.close_triads(whole, 5).count() == 15


def test_a_star_is_one_community(spark):
    leaves = 5000
    hub = spark.range(1, leaves + 1).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    more = spark.range(20).select((F.col("id") + 100_000).alias("src"), (F.col("id") + 100_001).alias("dst"))
    df = hub.unionByName(more)
    nodes = df.select(F.col("src").alias("id")).union(df.select("dst")).distinct()
    roots = graph.connected_components(nodes, df).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {(r.component, r.n) for r in roots} == {(0, leaves + 1), (100_000, 21)}
    labels = graph.communities(nodes, hub)
    assert labels.where("id <= 5000").select("community").distinct().count() == 1


def test_new_nodes_beside_one_large_community(spark):
    pairs = [(i, (i * 7 + 1) % 900) for i in range(900)] + [(900 + i, 900 + (i + 1) % 100) for i in range(100)]
    df = graph.simple_edges(edges_of(spark, [p for p in pairs if p[0] != p[1]]))
    nodes = spark.range(1000)
    labels = nodes.select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("community"))
    more, made = graph_models.augment(nodes, df, labels, 50, 5000, p_intra=1.0)
    assert more.count() == 1050
    ends = made.where("dst >= 5000").join(labels.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.count_distinct("community").alias("n"))
    assert ends.where("n > 1").count() == 0 and ends.count() == 50


def test_draws_do_not_depend_on_the_form_of_their_table(spark):
    rows = [(f"v{i % 40}" if i % 11 else None, f"p{i % 3}") for i in range(700)] + [(f"rare{i}", "p1") for i in range(90)]
    df = spark.createDataFrame(rows, "value string, given string")
    counts = df.select(F.lit("c").alias("child"), "given", "value").groupBy("child", "given", "value").agg(F.count("*").alias("n"))
    asked = spark.range(3000).withColumn("parent", F.concat(F.lit("p"), (F.col("id") % 4).cast("string")))
    u = keyed.uniform("t", F.col("id"))
    forms = [draws.drawers(counts, short)["c"].draw(asked, "drawn", u, F.col("parent")) for short in (10_000, 1)]
    short, long = (sorted(map(str, f.collect())) for f in forms)
    assert short == long and len(short) == 3000
    assert forms[1].where("parent = 'p3' AND drawn IS NOT NULL").count() == 0
    alone = counts.groupBy("child", "value").agg(F.sum("n").alias("n")).withColumn("given", F.lit(""))
    forms = [draws.drawers(alone, s)["c"].draw(asked, "drawn", u) for s in (10_000, 1)]
    assert sorted(map(str, forms[0].collect())) == sorted(map(str, forms[1].collect()))


def test_log_fields_draw_alike_at_every_length(spark):
    records = spark.createDataFrame([(f"/p{i % 60}", i) for i in range(500)], "path string, n bigint")
    rows = spark.range(400)
    got = []
    for most in (10, 1000):
        model = logs.fit_fields(records, ["path"], most)["path"]
        got.append(sorted(map(str, logs.with_draws(rows, {"path": model}).select("id", logs.draw(model, "path", F.col("id")).alias("p")).collect())))
    assert got[0] == got[1]


def test_a_thousand_categories_stay_in_the_tree(spark):
    rows = spark.range(20_000).select((F.col("id") % 1000).cast("string").alias("city"), (F.col("id") % 1000 % 5).cast("string").alias("region"))
    rows = rows.withColumn("name", F.concat(F.lit("n"), F.monotonically_increasing_id()))
    model = syn.fit_tree(rows, ["city", "region", "name"])
    assert model.parents == {"city": None, "region": "city", "name": None}
    made = syn.sample_tree(model, spark.range(3000))
    assert made.where("region <> CAST(CAST(city AS int) % 5 AS string)").count() == 0 and made.select("city").distinct().count() > 800
    assert made.where("name IS NULL").count() == 0


def test_running_sum(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("n")).repartition(6)
    got = {r.k: r.s for r in with_running_sum(df, ["k"], "n", "s").collect()}
    total, expected = 0, {}
    for k, n in sorted((i * 37 % 1000, i % 5) for i in range(1000)):
        total += n
        expected[k] = total
    assert got == expected
