"""Model-based comparison and concept drift of early against late orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import modelled
from tabwright.plans.drift_queries import BASE, NUMBERS, SNAP, lines, order_halves, rounded, sql_counts, sql_ks
from tabwright.plans.registry import query, sql_digest, table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
ORDER_FEATURES = ["o_totalprice", "o_custkey", "o_orderpriority"]


def line_halves(spark, folder):
    return [t.select(*KEYS, *NUMBERS, "l_linestatus") for t in lines(spark, folder)]


@query("classification_efficacy")
def classification_efficacy(spark, folder):
    return modelled.classification_efficacy(*line_halves(spark, folder), "l_linestatus", NUMBERS, KEYS)


@query("regression_efficacy")
def regression_efficacy(spark, folder):
    return modelled.regression_efficacy(*line_halves(spark, folder), "l_extendedprice", NUMBERS, KEYS)


@query("model_efficacy")
def model_efficacy(spark, folder):
    return modelled.model_efficacy(*line_halves(spark, folder), KEYS, {"l_linestatus": "classification", "l_quantity": "regression"}, trees=20)[0]


@query("importance_preservation")
def importance_preservation(spark, folder):
    return modelled.importance_preservation(*line_halves(spark, folder), "l_linestatus", NUMBERS)


def _skewed(spark, folder):
    """Lines whose price has long tails: price times quantity to the fourth."""
    a, b = lines(spark, folder)
    heavy = (F.col("l_extendedprice") * F.pow("l_quantity", F.lit(4))).alias("heavy")
    return a.select("l_quantity", heavy), b.select("l_quantity", heavy)


_HEAVY = "(SELECT l_quantity, l_extendedprice * pow(l_quantity, 4) AS heavy FROM {s})"


@query(
    "outlier_preservation",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(a, 6) AS rate_first, round(b, 6) AS rate_second,
            round(greatest(0, CASE WHEN a > 0 THEN 1 - abs(a - b) / (a + 1e-10) WHEN b = 0 THEN 1 ELSE 0.5 END), 6) AS score FROM
            (SELECT (SELECT avg(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT) FROM {_HEAVY.format(s=BASE)}) AS a,
              (SELECT avg(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT) FROM {_HEAVY.format(s=SNAP)}) AS b
             FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {_HEAVY.format(s=BASE)}))"""
        for c in ("l_quantity", "heavy")
    ),
)
def outlier_preservation(spark, folder):
    return rounded(modelled.outlier_preservation(*_skewed(spark, folder), ["l_quantity", "heavy"]), rate_first=6, rate_second=6, score=6)


def _parts(spark, folder):
    rows = table(spark, folder, "part")
    return rows.where("p_size <= 25"), rows.where("p_size > 25")


_PA, _PB = "(SELECT * FROM part WHERE p_size <= 25)", "(SELECT * FROM part WHERE p_size > 25)"


@query(
    "rare_category_preservation",
    f"""WITH c AS (SELECT * FROM ({sql_counts(['p_name', 'p_brand'], 'VARCHAR', _PA, _PB)}) WHERE n_first > 0),
      t AS (SELECT column_name, quantile_cont(n_first, 0.2) AS cut FROM c GROUP BY 1)
      SELECT column_name, count(*) AS rare_values, count(*) FILTER (WHERE n_second > 0) AS kept, round(count(*) FILTER (WHERE n_second > 0) / count(*), 6) AS score
      FROM c JOIN t USING (column_name) WHERE n_first <= cut GROUP BY 1""",
)
def rare_category_preservation(spark, folder):
    return rounded(modelled.rare_category_preservation(*_parts(spark, folder), ["p_name", "p_brand"]), score=6)


def _outlier_score(column, first, second):
    rate = "(SELECT avg(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT) FROM {t})"
    a, b = (rate.format(c=column, t=t) for t in (first, second))
    return f"""SELECT greatest(0, CASE WHEN a > 0 THEN 1 - abs(a - b) / (a + 1e-10) WHEN b = 0 THEN 1 ELSE 0.5 END) AS score FROM
        (SELECT {a} AS a, {b} AS b FROM (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {first}))"""


@query(
    "rare_event_score",
    f"""WITH c AS (SELECT * FROM ({sql_counts(['p_name', 'p_brand'], 'VARCHAR', _PA, _PB)}) WHERE n_first > 0),
      t AS (SELECT column_name, quantile_cont(n_first, 0.2) AS cut FROM c GROUP BY 1),
      s AS (SELECT avg((n_second > 0)::INT) AS score FROM c JOIN t USING (column_name) WHERE n_first <= cut GROUP BY column_name),
      o AS ({_outlier_score('p_retailprice', _PA, _PB)} UNION ALL {_outlier_score('p_size', _PA, _PB)})
      SELECT round(avg(score), 6) AS rare_event_score FROM (SELECT score FROM o UNION ALL SELECT score FROM s)""",
)
def rare_event_score(spark, folder):
    a, b = _parts(spark, folder)
    return rounded(modelled.rare_event_score(a, b, ["p_retailprice", "p_size"], ["p_name", "p_brand"]), rare_event_score=6)


_TRIPLE = ["o_totalprice", "o_custkey", "o_day"]


def _dated(spark, folder):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return [t.select("o_orderkey", "o_totalprice", "o_custkey", day.alias("o_day")) for t in order_halves(spark, folder)]


def _sample_sql(test, n, columns):
    return f"""(SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey, {', '.join(columns)} FROM (SELECT *, o_custkey::DOUBLE AS c2,
        date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS o_day FROM orders WHERE o_orderdate {test} TIMESTAMP '1998-01-01' ORDER BY {sql_digest('sample', 'o_orderkey')}, o_orderkey LIMIT {n}))"""


def _distances(test):
    gap = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in _TRIPLE)
    return f"(SELECT sqrt({gap}) AS value FROM {_sample_sql(test, 100, _TRIPLE)} a JOIN {_sample_sql(test, 100, _TRIPLE)} b ON a.i < b.i)"


@query(
    "interaction_preservation",
    f"SELECT round(ks, 6) AS ks, round(1 - ks, 6) AS score FROM ({sql_ks(['value'], _distances('<'), _distances('>='))})",
)
def interaction_preservation(spark, folder):
    return rounded(modelled.interaction_preservation(*_dated(spark, folder), _TRIPLE, ["o_orderkey"], 100), ks=6, score=6)


def _all_sql(test):
    return f"""(SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_totalprice, o_custkey,
        date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS o_day FROM orders WHERE o_orderdate {test} TIMESTAMP '1998-01-01')"""


def _curve(test):
    z = ", ".join(f"({c} - (SELECT avg({c}) FROM base)) / (SELECT stddev_pop({c}) FROM base) AS {c}" for c in _TRIPLE)
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _TRIPLE)
    return f"""(WITH base AS {_all_sql('<')}, z AS MATERIALIZED (SELECT i, {z} FROM {_all_sql(test)}),
      p AS (SELECT a.i, min(sqrt({gap}), 10) AS near FROM z a JOIN z b ON a.i <> b.i GROUP BY 1),
      m AS (SELECT i, round(list_reduce(near, lambda x, y: x + y) / len(near), 12) AS d FROM p)
      SELECT row_number() OVER (ORDER BY d, i) - 1 AS at_, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS k,
        count(*) OVER () AS n FROM m)"""


@query(
    "manifold_similarity",
    f"""WITH x AS {_curve('<')}, y AS {_curve('>=')}, t AS (SELECT least((SELECT any_value(n) FROM x), (SELECT any_value(n) FROM y)) AS n),
       s AS (SELECT unnest(range((SELECT n FROM t))) AS id)
       SELECT round(greatest(0, corr(x.k, y.k)), 6) AS manifold_score FROM s, t
       JOIN x ON x.at_ = id * x.n // t.n JOIN y ON y.at_ = id * y.n // t.n""",
)
def manifold_similarity(spark, folder):
    return rounded(modelled.manifold_similarity(*_dated(spark, folder), _TRIPLE, ["o_orderkey"]), manifold_score=6)


@query("detectability")
def detectability(spark, folder):
    return modelled.detectability(*line_halves(spark, folder), NUMBERS, KEYS)


@query("boundary_preservation")
def boundary_preservation(spark, folder):
    return modelled.boundary_preservation(*line_halves(spark, folder), "l_linestatus", NUMBERS)


@query("novel_report")
def novel_report(spark, folder):
    return modelled.novel_report(*line_halves(spark, folder), KEYS, trees=10)


@query("prediction_drift")
def prediction_drift(spark, folder):
    return modelled.prediction_drift(*order_halves(spark, folder), "o_orderstatus", ORDER_FEATURES, ["o_orderkey"], trees=20, folds=3)


@query("importance_shift")
def importance_shift(spark, folder):
    return modelled.importance_shift(*order_halves(spark, folder), "o_orderstatus", ORDER_FEATURES, trees=20)


@query("concept_drift")
def concept_drift(spark, folder):
    return modelled.concept_drift(*order_halves(spark, folder), "o_orderstatus", ["o_orderkey"], ORDER_FEATURES, trees=10, folds=3)
