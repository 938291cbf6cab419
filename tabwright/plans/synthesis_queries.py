"""Synthetic customers and orders: as many rows as observed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import synthesis as syn
from tabwright.plans.drift_queries import rounded
from tabwright.plans.registry import query, sql_index, sql_marginal, sql_uniform, table

_CUSTOMERS = "(SELECT c_custkey AS id FROM customer)"


@query(
    "independent_marginals",
    f"""SELECT id, c_acctbal::DOUBLE AS c_acctbal, c_nationkey::INTEGER AS c_nationkey, c_mktsegment
      FROM {sql_marginal('c_acctbal', 'customer', _CUSTOMERS)} JOIN {sql_marginal('c_nationkey', 'customer', _CUSTOMERS)} USING (id) JOIN {sql_marginal('c_mktsegment', 'customer', _CUSTOMERS)} USING (id)""",
)
def independent_marginals(spark, folder):
    rows = table(spark, folder, "customer")
    ids = rows.select(F.col("c_custkey").alias("id"))
    return syn.independent_rows(rows, ["c_acctbal", "c_nationkey", "c_mktsegment"], ids, ["c_custkey"]).select("id", "c_acctbal", "c_nationkey", "c_mktsegment")


@query("gaussian_copula")
def gaussian_copula(spark, folder):
    rows = table(spark, folder, "part")
    model = syn.fit_copula(rows, ["p_size", "p_retailprice"])
    return syn.sample_copula(model, rows.select(F.col("p_partkey").alias("id")))


@query(
    "pair_information",
    """WITH c AS (SELECT p_brand AS x, p_type AS y, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2)
       SELECT 'p_brand' AS a, 'p_type' AS b, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS information FROM
        (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM c)""",
)
def pair_information(spark, folder):
    rows = table(spark, folder, "part").select("p_brand", "p_type")
    return rounded(syn.mutual_information(syn.pair_counts(rows, ["p_brand", "p_type"])), information=6)


@query("dependency_tree")
def dependency_tree(spark, folder):
    rows = table(spark, folder, "orders")
    model = syn.fit_tree(rows, ["o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"])
    return syn.sample_tree(model, rows.select(F.col("o_orderkey").alias("id")))


_DAYS = "(SELECT l_orderkey * 8 + l_linenumber AS id, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 7)::VARCHAR AS week, substr(l_shipdate::VARCHAR, 1, 4) AS year FROM lineitem)"


@query(
    "tree_draws",
    f"""WITH t AS {_DAYS}, r AS (SELECT week, n, sum(n) OVER (ORDER BY n DESC, week)::DOUBLE / (sum(n) OVER ())::DOUBLE AS hi,
          (sum(n) OVER (ORDER BY n DESC, week) - n)::DOUBLE / (sum(n) OVER ())::DOUBLE AS lo FROM (SELECT week, count(*) AS n FROM t GROUP BY 1)),
        c AS (SELECT week, year, sum(n) OVER w::DOUBLE / (sum(n) OVER (PARTITION BY week))::DOUBLE AS hi, (sum(n) OVER w - n)::DOUBLE / (sum(n) OVER (PARTITION BY week))::DOUBLE AS lo
          FROM (SELECT week, year, count(*) AS n FROM t GROUP BY 1, 2) WINDOW w AS (PARTITION BY week ORDER BY n DESC, year)),
        d AS (SELECT id, week, {sql_uniform('tree:year', 'id')} AS u FROM (SELECT id, {sql_uniform('tree:week', 'id')} AS v FROM t) JOIN r ON v >= lo AND v < hi)
      SELECT id, d.week, year FROM d JOIN c ON d.week = c.week AND u >= lo AND u < hi""",
)
def tree_draws(spark, folder):
    """A root of some 360 categories, and a column that depends on it."""
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 7).cast("string").alias("week"), F.substring(F.col("l_shipdate").cast("string"), 1, 4).alias("year")
    )
    return syn.sample_tree(syn.fit_tree(rows, ["week", "year"]), rows.select("id")).select("id", "week", "year")


@query("private_marginals")
def private_marginals(spark, folder):
    rows = table(spark, folder, "orders")
    return syn.noisy_rows(rows, ["o_orderstatus", "o_orderpriority", "o_totalprice"], rows.select(F.col("o_orderkey").alias("id")), 1.0)


def labelled_parts(spark, folder):
    rows = table(spark, folder, "part")
    return rows.withColumn("big", (F.col("p_size") > 44).cast("string"))


@query(
    "class_sizes_after_oversampling",
    """WITH c AS (SELECT (p_size > 44)::VARCHAR AS big, count(*) AS n FROM part GROUP BY 1)
       SELECT big, (SELECT max(n) FROM c) AS rows, (SELECT max(n) FROM c) - n AS synthetic_rows FROM c""",
)
def class_sizes_after_oversampling(spark, folder):
    out = syn.smote(labelled_parts(spark, folder), "big", ["p_partkey"])
    return out.groupBy("big").agg(F.count("*").alias("rows"), F.count_if("is_synthetic").alias("synthetic_rows"))


def _oversampled_sql():
    row = ("class", "number", "copy")
    return f"""WITH m AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y, (p_size > 44)::VARCHAR AS class FROM part),
      n AS (SELECT class, count(*) AS size FROM m GROUP BY 1), q AS (SELECT class, size, (SELECT max(size) FROM n) - size AS extra FROM n WHERE size < (SELECT max(size) FROM n)),
      b AS (SELECT m.*, size, extra, row_number() OVER (PARTITION BY m.class ORDER BY substr(sha256(p_partkey::VARCHAR), 1, 3), p_partkey) - 1 AS number FROM m JOIN q USING (class)),
      g AS (SELECT a.class, a.number, list_sort(list({{'d': sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)), 'number': c.number}}))[:5] AS near
            FROM b a JOIN b c ON a.class = c.class AND a.number <> c.number GROUP BY 1, 2),
      s AS (SELECT b.*, unnest(range((extra // size + (number < extra % size)::BIGINT)::BIGINT)) AS copy FROM b),
      d AS (SELECT s.*, near[{sql_index('len(near)', 'smote', *row)} + 1].number AS other, {sql_uniform('smote-u', *row)} AS u FROM s JOIN g USING (class, number))
      SELECT d.class, d.number, copy, round(d.x + u * (b.x - d.x), 6) AS p_size, round(d.y + u * (b.y - d.y), 6) AS p_retailprice
      FROM d JOIN b ON b.class = d.class AND b.number = d.other"""


@query("oversampled_rows", _oversampled_sql())
def oversampled_rows(spark, folder):
    rows = labelled_parts(spark, folder).select("p_partkey", "p_size", "p_retailprice", "big")
    return rounded(syn.new_rows_between(rows, "big", ["p_partkey"]), p_size=6, p_retailprice=6)


@query(
    "nearest_neighbours",
    """SELECT a.p_partkey AS id, [x.id for x in list_sort(list({'d': sqrt(pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2)), 'id': b.p_partkey}))[:5]] AS near
       FROM part a JOIN part b ON a.p_partkey <> b.p_partkey GROUP BY 1""",
)
def nearest_neighbours(spark, folder):
    points = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return syn.nearest_neighbours(points, ["p_size", "p_retailprice"], 5).select("id", "near")


@query("synthetic_table")
def synthetic_table(spark, folder):
    rows = table(spark, folder, "customer")
    return syn.synthesize_table(rows, ["c_custkey"], rows.count(), roles={"c_name": "pii"}, epsilon=1.0)
