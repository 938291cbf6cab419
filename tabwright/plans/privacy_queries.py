"""Noise on orders, customers, events and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabwright.operators import privacy
from tabwright.plans.drift_queries import rounded
from tabwright.plans.registry import query, sql_laplace, sql_normal, table

EPS, DELTA = 0.5, 1e-5
_SIGMA = math.sqrt(2.0 * math.log(1.25 / DELTA)) / EPS


@query("laplace_noise", f"SELECT o_orderkey, round(o_totalprice + {sql_laplace('2.0', 'lap', 'o_orderkey')}, 6) AS noisy FROM orders")
def laplace_noise(spark, folder):
    noisy = privacy.add_laplace(F.col("o_totalprice"), 1.0, EPS, "lap", F.col("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(noisy, 6).alias("noisy"))


@query("gaussian_noise", f"SELECT o_orderkey, round(o_totalprice + {_SIGMA} * {sql_normal('gau', 'o_orderkey')}, 6) AS noisy FROM orders")
def gaussian_noise(spark, folder):
    noisy = privacy.add_gaussian(F.col("o_totalprice"), 1.0, EPS, DELTA, "gau", F.col("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(noisy, 6).alias("noisy"))


@query(
    "noisy_statistics",
    " UNION ALL ".join(
        f"""SELECT column_name, n, round((m + {sql_laplace('1::DOUBLE / n / 0.25', 'dp-mean', 'column_name')}) * w + lo, 4) AS noisy_mean,
            round(greatest(0, s + {sql_laplace('1::DOUBLE / n / 0.25', 'dp-std', 'column_name')}) * w, 4) AS noisy_std FROM
            (SELECT '{c}' AS column_name, count({c}) AS n, (avg({c}) - min({c})) / (max({c}) - min({c})) AS m,
              stddev_pop({c}) / (max({c}) - min({c})) AS s, min({c}) AS lo, max({c}) - min({c}) AS w FROM lineitem)"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def noisy_statistics(spark, folder):
    out = privacy.noisy_statistics(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], EPS)
    return rounded(out, noisy_mean=4, noisy_std=4)


@query(
    "noisy_categories",
    f"""WITH c AS (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2
          UNION ALL SELECT 'c_name', c_name, count(*) FROM customer GROUP BY 2),
        y AS (SELECT *, greatest(0, n + {sql_laplace('2.0', 'dp-count', 'column_name', 'value')}) AS noisy FROM c)
        SELECT column_name, value, n, round(noisy / sum(noisy) OVER (PARTITION BY column_name), 9) AS share FROM y""",
)
def noisy_categories(spark, folder):
    return rounded(privacy.noisy_categories(table(spark, folder, "customer"), ["c_mktsegment", "c_name"], EPS), share=9)


_W = "((SELECT max(o_totalprice) - min(o_totalprice) FROM orders) / (SELECT count(*) FROM orders))"


@query(
    "perturbed_laplace",
    f"SELECT o_orderkey, o_orderstatus, round(o_totalprice + {sql_laplace(f'{_W} / 0.5', 'perturb:o_totalprice', 'o_orderkey')}, 6) AS o_totalprice FROM orders",
)
def perturbed_laplace(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(privacy.perturb(rows, ["o_totalprice"], ["o_orderkey"], EPS), o_totalprice=6)


@query(
    "perturbed_gaussian",
    f"SELECT o_orderkey, round(o_totalprice + {_W} * {_SIGMA} * {sql_normal('perturb:o_totalprice', 'o_orderkey')}, 6) AS o_totalprice FROM orders",
)
def perturbed_gaussian(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rounded(privacy.perturb(rows, ["o_totalprice"], ["o_orderkey"], EPS, DELTA, "gaussian"), o_totalprice=6)


@query(
    "perturbation_metadata",
    "SELECT 'laplace' AS mechanism, 0.5::DOUBLE AS epsilon, 1e-5::DOUBLE AS delta, 1::BIGINT AS columns_perturbed, count(*) AS rows FROM orders",
)
def perturbation_metadata(spark, folder):
    return privacy.perturb_metadata(table(spark, folder, "orders"), ["o_totalprice"], EPS, DELTA, "laplace")


@query(
    "vote_winner",
    f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
        y AS (SELECT *, n + {_SIGMA} * {sql_normal('votes', 'user_id', 'event_type')} AS noisy FROM c)
        SELECT user_id, arg_max(event_type, noisy) AS winner, round(max(noisy), 6) AS noisy_votes FROM y GROUP BY 1""",
)
def vote_winner(spark, folder):
    return rounded(privacy.vote_winner(table(spark, folder, "events"), "user_id", "event_type", EPS, DELTA), noisy_votes=6)


@query(
    "clipped_vectors",
    """SELECT vec_id, [round(x::DOUBLE * least(1, 0.75::DOUBLE / n), 6) for x in embedding] AS clipped FROM
        (SELECT *, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS n FROM embeddings)""",
)
def clipped_vectors(spark, folder):
    clipped = F.transform(privacy.clip_vector(F.col("embedding"), 0.75), lambda x: F.round(x, 6))
    return table(spark, folder, "embeddings").select("vec_id", clipped.alias("clipped"))


@query(
    "budget_ledger",
    """WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
          CASE event_type WHEN 'purchase' THEN 4 WHEN 'error' THEN 3 ELSE 1 END AS a FROM events),
        f AS (SELECT user_id, i, CASE WHEN a <= 50 THEN a ELSE 0 END AS spent, (a <= 50)::BIGINT AS accepted FROM s WHERE i = 1
          UNION ALL SELECT s.user_id, s.i, CASE WHEN spent + a <= 50 THEN spent + a ELSE spent END, accepted + (spent + a <= 50)::BIGINT
          FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
       SELECT user_id, arg_max(accepted, i) AS accepted, max(i) - arg_max(accepted, i) AS rejected, arg_max(spent, i)::DOUBLE AS spent,
        50 - arg_max(spent, i)::DOUBLE AS remaining, arg_max(spent, i) >= 50 AS depleted FROM f GROUP BY 1""",
)
def budget_ledger(spark, folder):
    amount = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "error", 3).otherwise(1)
    spends = table(spark, folder, "events").select("user_id", "ts", "event_id", amount.alias("amount"))
    return privacy.budget_ledger(spends, "user_id", ["ts", "event_id"], "amount", 50.0)
