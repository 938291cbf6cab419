"""Profiles of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import profile as prof
from tabwright.plans.registry import query, table

ORDERS = [
    ("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
]
CUSTOMER = [
    ("c_custkey", "integer"), ("c_name", "string"), ("c_nationkey", "integer"), ("c_acctbal", "float"),
    ("c_mktsegment", "string"),
]


def with_nulls(spark, folder):
    """Orders with holes: every seventh customer key and every third status missing."""
    rows = table(spark, folder, "orders")
    return rows.withColumns(
        {
            "o_custkey": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")),
            "o_orderstatus": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")),
        }
    )


HOLES = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"""


def sql_profile(source, columns):
    parts = [
        f"SELECT {i} AS position, '{c}' AS column_name, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d FROM {source}"
        for i, (c, k) in enumerate(columns)
    ]
    return f"""SELECT position, column_name,
        CASE WHEN kind <> 'string' THEN kind WHEN d < 20 AND n > 100 THEN 'categorical' ELSE 'text' END AS column_type,
        CASE WHEN kind IN ('integer', 'float') THEN 'numeric' ELSE 'categorical' END AS tag,
        n AS rows, nulls, round(nulls * 100.0::DOUBLE / n, 6) AS null_percentage, d AS distinct_values
        FROM ({' UNION ALL '.join(parts)})"""


def rounded_profile(df):
    return df.withColumn("null_percentage", F.round("null_percentage", 6))


@query("column_profile", sql_profile(HOLES, ORDERS))
def column_profile(spark, folder):
    return rounded_profile(prof.profile(with_nulls(spark, folder)))


@query(
    "document_profile",
    sql_profile(
        "documents",
        [("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "integer")],
    ),
)
def document_profile(spark, folder):
    return rounded_profile(prof.profile(table(spark, folder, "documents")))


@query("column_profile_approximate")
def column_profile_approximate(spark, folder):
    return prof.profile(table(spark, folder, "orders"), approximate=True)


@query(
    "target_candidates",
    f"""SELECT task, row_number() OVER (PARTITION BY task ORDER BY round(null_percentage, 2),
          CASE WHEN task = 'classification' THEN -distinct_values ELSE 0 END, position)::INTEGER AS rank,
          column_name, column_type, distinct_values, null_percentage
        FROM (SELECT *, CASE WHEN (column_type = 'categorical' OR (column_type = 'integer' AND distinct_values <= 20))
              AND distinct_values BETWEEN 2 AND 20 THEN 'classification'
            WHEN column_type IN ('integer', 'float') AND distinct_values > 20 THEN 'regression' END AS task
          FROM ({sql_profile(HOLES, ORDERS)}) WHERE null_percentage <= 30 AND distinct_values / rows <= 0.95) WHERE task IS NOT NULL""",
)
def target_candidates(spark, folder):
    return rounded_profile(prof.target_candidates(prof.profile(with_nulls(spark, folder))))


def dated_orders(spark, folder):
    rows = table(spark, folder, "orders")
    return rows.select("*", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day_text"))


@query(
    "datetime_columns",
    """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', 'order_day_text']) AS column_name,
        unnest([false, false, bool_and(TRY_CAST(o_orderstatus AS TIMESTAMP) IS NOT NULL), false, true,
          bool_and(TRY_CAST(o_orderpriority AS TIMESTAMP) IS NOT NULL),
          bool_and(TRY_CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL)]) AS is_datetime FROM orders""",
)
def datetime_columns(spark, folder):
    return prof.datetime_columns(dated_orders(spark, folder))


@query(
    "time_series_score",
    """WITH o AS (SELECT bool_or(ts < p) AS fell FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id, ts) AS p FROM events)),
        d AS (SELECT 1 + bool_and(TRY_CAST(event_type AS TIMESTAMP) IS NOT NULL)::BIGINT + bool_and(TRY_CAST(props AS TIMESTAMP) IS NOT NULL)::BIGINT AS n FROM events)
       SELECT n AS datetime_columns, 0::BIGINT AS temporal_features, NOT fell AS ordered,
        CASE WHEN fell THEN 0.5 ELSE 0.7 END::DOUBLE AS score, true AS is_time_series FROM o, d""",
)
def time_series_score(spark, folder):
    return prof.series_score(table(spark, folder, "events"), "event_id", "ts")


@query(
    "semantic_types",
    f"""SELECT position, column_name, column_type, CASE WHEN column_type IN ('integer', 'float') THEN 'numerical'
        WHEN column_type = 'datetime' THEN 'datetime' WHEN distinct_values / rows > 0.95 THEN 'id' ELSE 'categorical' END AS semantic_type
        FROM ({sql_profile('customer', CUSTOMER)})""",
)
def semantic_types(spark, folder):
    return prof.semantic_types(prof.profile(table(spark, folder, "customer")))


def sql_set_profile(name, columns):
    return f"""SELECT '{name}' AS table_name, {len(columns)}::BIGINT AS columns, column_name, rows, distinct_values,
        CASE WHEN column_type = 'datetime' THEN 'datetime' ELSE tag END AS tag FROM ({sql_profile(name, columns)})"""


@query("table_set_profile", f"{sql_set_profile('orders', ORDERS)} UNION ALL {sql_set_profile('customer', CUSTOMER)}")
def table_set_profile(spark, folder):
    return prof.profile_tables({t: table(spark, folder, t) for t in ("orders", "customer")})


@query(
    "sampling_step",
    """WITH h AS (SELECT DISTINCT o_orderdate AS ts FROM orders WHERE o_orderdate IS NOT NULL),
        g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM h)
       SELECT CASE WHEN count(DISTINCT gap) = 1 THEN max(gap) / 1e6 ELSE 86400 END::DOUBLE AS step_seconds,
        count(DISTINCT gap) AS distinct_steps FROM g""",
)
def sampling_step(spark, folder):
    return prof.sampling_step(table(spark, folder, "orders"), "o_orderdate")
