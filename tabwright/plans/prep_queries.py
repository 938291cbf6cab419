"""Filters, roles, imputation, encoding, scaling, sampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import prep
from tabwright.plans.profile_queries import HOLES, with_nulls
from tabwright.plans.registry import query, sql_digest, sql_uniform, table

CONDITIONS = [
    {"column": "o_totalprice", "operator": "gte", "value": "150000"},
    {"column": "o_orderstatus", "operator": "ne", "value": "F"},
    {"column": "o_custkey", "operator": "lt", "value": "not a number"},
    {"column": "no_such_column", "operator": "eq", "value": 1},
]


@query(
    "condition_filter",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus <> 'F'",
)
def condition_filter(spark, folder):
    kept = prep.apply_conditions(table(spark, folder, "orders"), CONDITIONS)
    return kept.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("condition_filter_fallback", "SELECT c_custkey, c_acctbal FROM customer")
def condition_filter_fallback(spark, folder):
    rows = table(spark, folder, "customer")
    impossible = [{"column": "c_acctbal", "operator": "gt", "value": 1e12}]
    return prep.apply_conditions(rows, impossible).select("c_custkey", "c_acctbal")


@query(
    "column_roles",
    "SELECT c_custkey, substr(sha256(c_name), 1, 12) AS c_name, c_acctbal, c_mktsegment FROM customer",
)
def column_roles(spark, folder):
    return prep.apply_roles(table(spark, folder, "customer"), {"c_name": "pii", "c_nationkey": "skip", "c_acctbal": "pii"})


@query(
    "prepared_features",
    f"""SELECT o_orderkey::DOUBLE AS o_orderkey, round(coalesce(o_custkey, (SELECT quantile_cont(o_custkey, 0.5) FROM {HOLES}))::DOUBLE, 6) AS o_custkey,
        coalesce(o_orderstatus, '__MISSING__') AS o_orderstatus, o_totalprice FROM {HOLES}""",
)
def prepared_features(spark, folder):
    out = prep.prepare_features(with_nulls(spark, folder), "o_totalprice")
    return out.select("o_orderkey", F.round("o_custkey", 6).alias("o_custkey"), "o_orderstatus", "o_totalprice")


@query(
    "label_codes",
    "SELECT p_name AS value, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)",
)
def label_codes(spark, folder):
    return prep.label_codes(table(spark, folder, "part"), "p_name")


@query(
    "label_encoded",
    """SELECT p_partkey, coalesce(code, -1) AS p_brand_code FROM part LEFT JOIN
        (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_retailprice < 920)) USING (p_brand)""",
)
def label_encoded(spark, folder):
    rows = table(spark, folder, "part")
    codes = prep.label_codes(rows.where("p_retailprice < 920"), "p_brand")
    return prep.encode_labels(rows, "p_brand", codes).select("p_partkey", "p_brand_code")


@query(
    "task_type",
    """SELECT count(DISTINCT o_orderpriority) AS distinct_values,
        CASE WHEN count(DISTINCT o_orderpriority) <= 20 THEN 'classification' ELSE 'regression' END AS task FROM orders
       UNION ALL SELECT count(DISTINCT o_totalprice), CASE WHEN count(DISTINCT o_totalprice) <= 20 THEN 'classification' ELSE 'regression' END FROM orders""",
)
def task_type(spark, folder):
    rows = table(spark, folder, "orders")
    return prep.task_type(rows, "o_orderpriority").unionByName(prep.task_type(rows, "o_totalprice"))


SCALED = ["l_quantity", "l_extendedprice"]
_OPEN, _DONE = "(SELECT * FROM lineitem WHERE l_linestatus = 'O')", "(SELECT * FROM lineitem WHERE l_linestatus = 'F')"


def line_halves(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *SCALED, "l_linestatus")
    return rows.where("l_linestatus = 'O'").drop("l_linestatus"), rows.where("l_linestatus = 'F'").drop("l_linestatus")


@query(
    "min_max_scaling",
    f"""SELECT l_orderkey, l_linenumber, """
    + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM {_OPEN})) / ((SELECT max({c}) - min({c}) FROM {_OPEN}) + 1e-7), 6) AS {c}"
        for c in SCALED
    )
    + f" FROM {_DONE}",
)
def min_max_scaling(spark, folder):
    fit, apply = line_halves(spark, folder)
    out = prep.min_max_scale(apply, prep.fit_ranges(fit, SCALED), SCALED)
    return out.withColumns({c: F.round(c, 6) for c in SCALED})


@query(
    "min_max_restored",
    f"SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM {_DONE}",
)
def min_max_restored(spark, folder):
    fit, apply = line_halves(spark, folder)
    ranges = prep.fit_ranges(fit, SCALED)
    out = prep.min_max_restore(prep.min_max_scale(apply, ranges, SCALED), ranges, SCALED)
    return out.withColumns({"l_quantity": F.round("l_quantity", 6), "l_extendedprice": F.round("l_extendedprice", 4)})


@query(
    "z_scaling",
    f"SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM {_OPEN})) / ((SELECT stddev_samp({c}) FROM {_OPEN}) + 1e-10), 6) AS {c}"
        for c in SCALED
    )
    + f" FROM {_DONE}",
)
def z_scaling(spark, folder):
    fit, apply = line_halves(spark, folder)
    return prep.z_scale(apply, fit, SCALED).withColumns({c: F.round(c, 6) for c in SCALED})


@query(
    "fixed_sample",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_digest('sample', 'o_orderkey')}, o_orderkey LIMIT 100",
)
def fixed_sample(spark, folder):
    return prep.fixed_sample(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])


@query(
    "split_by_hash",
    f"SELECT l_orderkey, l_linenumber, {sql_uniform('split', 'l_orderkey', 'l_linenumber')} < 0.7 AS is_train FROM lineitem",
)
def split_by_hash(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return prep.split_by_hash(rows, ["l_orderkey", "l_linenumber"])


@query(
    "split_by_order",
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 < floor(0.7::DOUBLE * (SELECT count(*) FROM events)) AS is_train FROM events""",
)
def split_by_order(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "ts")
    return prep.split_by_order(rows, ["ts", "event_id"]).select("event_id", "is_train")


@query(
    "aligned_schema",
    """SELECT o_orderkey, TRY_CAST(o_orderpriority AS BIGINT) AS o_custkey, o_totalprice::VARCHAR IS NOT NULL AS kept
       FROM orders""",
)
def aligned_schema(spark, folder):
    rows = table(spark, folder, "orders")
    generated = rows.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_orderpriority").alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.lit("x").alias("unknown"),
    )
    out = prep.align_schema(generated, rows)
    return out.select("o_orderkey", "o_custkey", F.col("o_totalprice").isNotNull().alias("kept"))
