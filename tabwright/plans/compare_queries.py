"""Two-table comparison: open against finished order lines, early against late orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import compare
from tabwright.plans.drift_queries import (
    EARLY,
    LATE,
    NUMBERS,
    PAIR_TEXTS,
    SUMMARY_SQL,
    order_halves,
    lines,
    rounded,
    sql_counts,
    sql_histogram,
    sql_ks,
    sql_measures,
)
from tabwright.plans.drift_queries import BASE as FIRST
from tabwright.plans.drift_queries import SNAP as SECOND
from tabwright.plans.registry import query, table

PAIRS = [(a, b) for a in NUMBERS for b in NUMBERS]


def sql_matrix(source, fn):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {fn}({a}, {b}) AS value FROM {source}" for a, b in PAIRS)


@query("correlation_matrix", f"SELECT a, b, round(value, 6) AS value FROM ({sql_matrix('lineitem', 'corr')})")
def correlation_matrix(spark, folder):
    return rounded(compare.pair_matrix(table(spark, folder, "lineitem"), NUMBERS), value=6)


@query("covariance_matrix", f"SELECT a, b, round(value, 2) AS value FROM ({sql_matrix('lineitem', 'covar_samp')})")
def covariance_matrix(spark, folder):
    return rounded(compare.pair_matrix(table(spark, folder, "lineitem"), NUMBERS, "cov"), value=2)


def sql_two(fn):
    return f"({sql_matrix(FIRST, fn)}) x JOIN ({sql_matrix(SECOND, fn)}) y USING (a, b)"


@query(
    "matrix_difference",
    f"""SELECT 'correlation' AS matrix, round(avg(abs(x.value - y.value)), 6) AS mean_difference FROM {sql_two('corr')}
        UNION ALL SELECT 'covariance', round(avg(abs(x.value - y.value)), 2) FROM {sql_two('covar_samp')}""",
)
def matrix_difference(spark, folder):
    first, second = lines(spark, folder)
    corr = compare.matrix_difference(first, second, NUMBERS).select(F.lit("correlation").alias("matrix"), F.round("mean_difference", 6).alias("mean_difference"))
    cov = compare.matrix_difference(first, second, NUMBERS, "cov").select(F.lit("covariance").alias("matrix"), F.round("mean_difference", 2).alias("mean_difference"))
    return corr.unionByName(cov)


@query(
    "correlation_preservation",
    f"SELECT round(greatest(0, corr(x.value, y.value)), 6) AS correlation_score FROM {sql_two('corr')} WHERE a < b",
)
def correlation_preservation(spark, folder):
    return rounded(compare.correlation_preservation(*lines(spark, folder), NUMBERS), correlation_score=6)


def sql_ranks(source):
    ranked = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NUMBERS)
    return f"(SELECT {ranked} FROM {source})"


@query("rank_correlation_matrix", f"SELECT a, b, round(value, 6) AS value FROM ({sql_matrix(sql_ranks('lineitem'), 'corr')})")
def rank_correlation_matrix(spark, folder):
    return rounded(compare.spearman_matrix(table(spark, folder, "lineitem"), NUMBERS), value=6)


@query(
    "rank_correlation_preservation",
    f"""SELECT round(avg(abs(x.value - y.value)), 6) AS mean_difference, round(greatest(0, corr(x.value, y.value)), 6) AS spearman_score
        FROM ({sql_matrix(sql_ranks(FIRST), 'corr')}) x JOIN ({sql_matrix(sql_ranks(SECOND), 'corr')}) y USING (a, b) WHERE a < b""",
)
def rank_correlation_preservation(spark, folder):
    return rounded(compare.spearman_preservation(*lines(spark, folder), NUMBERS), mean_difference=6, spearman_score=6)


_SIMILARITY_SQL = f"""SELECT column_name, 'numeric' AS column_type, ks, js, overlap, greatest(0, least(1, 1 - js)) AS quality_score
    FROM ({sql_measures(sql_histogram(['o_totalprice', 'o_custkey'], EARLY, LATE))}) JOIN ({sql_ks(['o_totalprice', 'o_custkey'], EARLY, LATE)}) USING (column_name)
    UNION ALL SELECT column_name, 'categorical', NULL, js, overlap, greatest(0, least(1, 1 - js)) FROM ({sql_measures(sql_counts(PAIR_TEXTS, 'VARCHAR', EARLY, LATE))})"""
_SIMILAR = ["o_totalprice", "o_custkey", *PAIR_TEXTS]


@query(
    "column_similarity",
    f"""SELECT column_name, column_type, round(ks, 6) AS ks, round(js, 6) AS js, round(overlap, 6) AS overlap,
        round(quality_score, 6) AS quality_score FROM ({_SIMILARITY_SQL})""",
)
def column_similarity(spark, folder):
    s = compare.column_similarity(*order_halves(spark, folder), _SIMILAR)
    return rounded(s.select("column_name", "column_type", "ks", "js", "overlap", "quality_score"), ks=6, js=6, overlap=6, quality_score=6)


@query(
    "best_and_worst_columns",
    f"SELECT row_number() OVER (ORDER BY js, column_name)::INTEGER AS position, column_name, round(js, 6) AS js, round(quality_score, 6) AS quality_score FROM ({_SIMILARITY_SQL})",
)
def best_and_worst_columns(spark, folder):
    return rounded(compare.top_by_js(compare.column_similarity(*order_halves(spark, folder), _SIMILAR)), js=6, quality_score=6)


def _t_sql(side):
    a, b = f"a.mean_{side}", f"b.mean_{side}"
    na, nb = f"a.n_{side}::DOUBLE", f"b.n_{side}::DOUBLE"
    pooled = f"((({na} - 1) * a.std_{side} * a.std_{side} + ({nb} - 1) * b.std_{side} * b.std_{side}) / ({na} + {nb} - 2))"
    return f"({a} - {b}) / sqrt({pooled} * (1::DOUBLE / {na} + 1::DOUBLE / {nb}))"


@query(
    "pairwise_t_statistics",
    f"""SELECT a.column_name AS column_a, b.column_name AS column_b, round({_t_sql('first')}, 5) AS t_first, round({_t_sql('second')}, 5) AS t_second
        FROM ({SUMMARY_SQL}) a JOIN ({SUMMARY_SQL}) b ON a.column_name < b.column_name""",
)
def pairwise_t_statistics(spark, folder):
    t = compare.pairwise_t_tests(*lines(spark, folder), NUMBERS).select("column_a", "column_b", "t_first", "t_second")
    return rounded(t, t_first=5, t_second=5)


@query("pairwise_t_tests")
def pairwise_t_tests(spark, folder):
    return compare.pairwise_t_tests(*lines(spark, folder), NUMBERS)


@query("mean_tests")
def mean_tests(spark, folder):
    return compare.mean_tests(*lines(spark, folder), NUMBERS)


_CELLS = """SELECT a.l_returnflag AS value_a, a.l_linestatus AS value_b, n, n_a, n_b FROM
    (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) a
    JOIN (SELECT l_returnflag, count(*) AS n_a FROM lineitem GROUP BY 1) r USING (l_returnflag)
    JOIN (SELECT l_linestatus, count(*) AS n_b FROM lineitem GROUP BY 1) c USING (l_linestatus)"""


@query("contingency_table", _CELLS)
def contingency_table(spark, folder):
    out = compare.contingency(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select("value_a", "value_b", "n", "n_a", "n_b")


def sql_chi_independence(source, a, b):
    return f"""(WITH c AS (SELECT {a} AS va, {b} AS vb, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2),
      ra AS (SELECT va, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT vb, sum(n) AS nb FROM c GROUP BY 1),
      g AS (SELECT coalesce(n, 0) AS o, na * nb / (SELECT sum(n) FROM c) AS e, (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb
        FROM ra CROSS JOIN rb LEFT JOIN c USING (va, vb))
      SELECT '{a}' AS column_a, '{b}' AS column_b,
        sum(pow(CASE WHEN ka = 2 AND kb = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END, 2) / e) AS chi_square,
        (max(ka) - 1) * (max(kb) - 1) AS dof FROM g)"""


@query(
    "chi_square_independence",
    " UNION ALL ".join(
        f"SELECT column_a, column_b, round(chi_square, 5) AS chi_square, dof FROM {sql_chi_independence(s, a, b)}"
        for s, a, b in (
            ("orders", "o_orderstatus", "o_orderpriority"),
            ("lineitem", "l_returnflag", "l_linestatus"),
            ("part", "p_brand", "p_name"),
        )
    ),
)
def chi_square_independence(spark, folder):
    one = compare.chi_square_independence(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")
    two = compare.chi_square_independence(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")
    three = compare.chi_square_independence(table(spark, folder, "part"), "p_brand", "p_name")
    return rounded(one.unionByName(two).unionByName(three), chi_square=5)


@query("pairwise_chi_square_tests")
def pairwise_chi_square_tests(spark, folder):
    return compare.pairwise_chi_square(*order_halves(spark, folder), PAIR_TEXTS)


# --- structure: customers against suppliers under common names, with derived holes ----


def parties(spark, folder):
    c = table(spark, folder, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "IF(c_custkey % 9 = 0, NULL, c_acctbal) AS balance",
        "c_mktsegment AS segment", "CAST(c_nationkey AS STRING) AS nation_text",
    )
    s = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "CAST(s_nationkey AS BIGINT) AS nation", "IF(s_suppkey % 6 = 0, NULL, s_acctbal) AS balance",
        "CAST(s_nationkey AS STRING) AS nation_text",
    )
    return c, s


_C = """(SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS balance,
    c_mktsegment AS segment, c_nationkey::VARCHAR AS nation_text FROM customer)"""
_S = """(SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS balance,
    s_nationkey::VARCHAR AS nation_text FROM supplier)"""
_SHARED = ["id", "name", "nation", "balance", "nation_text"]
_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT avg(({c} IS NULL)::INT) * 100 FROM {_C}) AS mf, (SELECT avg(({c} IS NULL)::INT) * 100 FROM {_S}) AS ms"
    for c in _SHARED
)


@query(
    "missing_patterns",
    f"SELECT column_name, round(mf, 6) AS missing_first, round(ms, 6) AS missing_second, round(greatest(0, 1 - abs(mf - ms) / 10), 6) AS score FROM ({_MISSING_SQL})",
)
def missing_patterns(spark, folder):
    return rounded(compare.missing_patterns(*parties(spark, folder)), missing_first=6, missing_second=6, score=6)


_RANGE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, min_first, max_first, min_second, max_second,
        min_second >= min_first - 0.1::DOUBLE * (max_first - min_first) AND max_second <= max_first + 0.1::DOUBLE * (max_first - min_first) AS within_bounds,
        greatest(0, 1 - (abs(min_first - min_second) + abs(max_first - max_second)) / (max_first - min_first) / 2) AS score
        FROM (SELECT min({c})::DOUBLE AS min_first, max({c})::DOUBLE AS max_first FROM {_C}), (SELECT min({c})::DOUBLE AS min_second, max({c})::DOUBLE AS max_second FROM {_S})"""
    for c in ("id", "nation", "balance")
)


@query("value_ranges", f"SELECT * REPLACE (round(score, 6) AS score) FROM ({_RANGE_SQL})")
def value_ranges(spark, folder):
    return rounded(compare.value_ranges(*parties(spark, folder)), score=6)


_CARD_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, df AS distinct_first, ds AS distinct_second, kept / df AS category_preservation,
        least(df, ds) / greatest(df, ds) AS cardinality_ratio, (kept / df + least(df, ds) / greatest(df, ds)) / 2 AS score,
        df - kept AS missing_categories, ds - kept AS new_categories
        FROM (SELECT (SELECT count(DISTINCT {c}) FROM {_C}) AS df, (SELECT count(DISTINCT {c}) FROM {_S}) AS ds,
          (SELECT count(DISTINCT {c}) FROM {_C} WHERE {c} IN (SELECT {c} FROM {_S})) AS kept)"""
    for c in ("name", "nation_text")
)


@query(
    "cardinality",
    f"SELECT * REPLACE (round(category_preservation, 6) AS category_preservation, round(cardinality_ratio, 6) AS cardinality_ratio, round(score, 6) AS score) FROM ({_CARD_SQL})",
)
def cardinality(spark, folder):
    return rounded(compare.cardinality(*parties(spark, folder)), category_preservation=6, cardinality_ratio=6, score=6)


_NULLS_SQL = f"""SELECT nf AS null_rate_first, rf AS rows_first, ns AS null_rate_second, rs AS rows_second, greatest(0, 1 - abs(nf - ns) / 10) AS score FROM
    (SELECT avg((balance IS NULL)::INT) / 6 * 100 AS nf, count(*) AS rf FROM {_C}), (SELECT avg((balance IS NULL)::INT) / 5 * 100 AS ns, count(*) AS rs FROM {_S})"""


@query("null_rates", f"SELECT * REPLACE (round(null_rate_first, 6) AS null_rate_first, round(null_rate_second, 6) AS null_rate_second, round(score, 6) AS score) FROM ({_NULLS_SQL})")
def null_rates(spark, folder):
    return rounded(compare.null_rates(*parties(spark, folder)), null_rate_first=6, null_rate_second=6, score=6)


@query(
    "structural_score",
    f"""WITH p AS (SELECT 'schema' AS component, 0.8::DOUBLE AS score
        UNION ALL SELECT 'missing_pattern', (SELECT avg(greatest(0, 1 - abs(mf - ms) / 10)) FROM ({_MISSING_SQL}))
        UNION ALL SELECT 'value_range', (SELECT avg(score) FROM ({_RANGE_SQL}))
        UNION ALL SELECT 'cardinality', (SELECT avg(score) FROM ({_CARD_SQL}))
        UNION ALL SELECT 'data_quality', (SELECT score FROM ({_NULLS_SQL})))
       SELECT component, round(score, 6) AS score FROM p UNION ALL SELECT 'overall', round(avg(score), 6) FROM p""",
)
def structural_score(spark, folder):
    # The nation column is an int on one side and a bigint on the other: 4 of 5 common types match.
    return rounded(compare.structural_score(*parties(spark, folder)), score=6)


# --- distance ---------------------------------------------------------------

_DIMS = ["o_totalprice", "o_custkey"]
_Z = ", ".join(f"(SELECT avg({c}) FROM {EARLY}) AS m_{c}, (SELECT stddev_samp({c}) FROM {EARLY}) + 1e-10 AS s_{c}" for c in _DIMS)
_DCR_SQL = f"""WITH z AS (SELECT {_Z}),
    a AS (SELECT {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _DIMS)} FROM {EARLY}, z),
    b AS (SELECT o_orderkey, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _DIMS)} FROM {LATE}, z)
    SELECT b.o_orderkey, min(sqrt({' + '.join(f'pow(a.{c} - b.{c}, 2)' for c in _DIMS)})) AS distance FROM a, b GROUP BY 1"""


@query("distance_to_closest_record", f"SELECT o_orderkey, round(distance, 6) AS distance FROM ({_DCR_SQL})")
def distance_to_closest_record(spark, folder):
    return rounded(compare.closest_record(*order_halves(spark, folder), _DIMS, ["o_orderkey"]), distance=6)


@query(
    "privacy_score",
    f"""SELECT round(d, 6) AS mean_distance, x AS exact_matches, round(x / n, 6) AS exact_match_rate,
        round(CASE WHEN x > 0 THEN greatest(0.1, base - least(0.15, x / n * 0.3)) ELSE base END, 6) AS privacy_score FROM (
        SELECT *, CASE WHEN d < 0.01 THEN 0.1 WHEN d < 0.5 THEN 0.2 + d / 0.5 * 0.3 WHEN d < 1 THEN 0.5 + (d - 0.5) / 0.5 * 0.2
          WHEN d < 2 THEN 0.7 + (d - 1) * 0.15 ELSE least(0.95, 0.85 + (d - 2) / 3 * 0.1) END AS base
        FROM (SELECT avg(distance) AS d, count(*) FILTER (WHERE distance < 0.01) AS x, count(*) AS n FROM ({_DCR_SQL})))""",
)
def privacy_score(spark, folder):
    p = compare.privacy_score(*order_halves(spark, folder), _DIMS, ["o_orderkey"])
    return rounded(p, mean_distance=6, exact_match_rate=6, privacy_score=6)


@query(
    "exact_copies",
    f"""WITH k AS (SELECT DISTINCT l_quantity, l_discount, l_tax FROM {FIRST})
        SELECT count(*) FILTER (WHERE (l_quantity, l_discount, l_tax) IN (SELECT (l_quantity, l_discount, l_tax) FROM k)) AS copies,
          count(*) AS rows, round(count(*) FILTER (WHERE (l_quantity, l_discount, l_tax) IN (SELECT (l_quantity, l_discount, l_tax) FROM k)) / count(*), 6) AS copy_rate
        FROM {SECOND}""",
)
def exact_copies(spark, folder):
    return rounded(compare.exact_copies(*lines(spark, folder), ["l_quantity", "l_discount", "l_tax"]), copy_rate=6)


@query(
    "anonymity",
    """WITH c AS (SELECT p_brand, p_size, count(*) AS size, count(DISTINCT p_type) AS v FROM part GROUP BY 1, 2)
       SELECT count(*) AS classes, min(size) AS k, round(avg(size), 6) AS mean_class_size,
        round(sum(size) FILTER (WHERE size < 5) / sum(size), 6) AS share_at_risk, min(v) AS l,
        round(sum(size) FILTER (WHERE v = 1) / sum(size), 6) AS share_disclosed FROM c""",
)
def anonymity(spark, folder):
    a = compare.anonymity(table(spark, folder, "part"), ["p_brand", "p_size"], "p_type")
    return rounded(a, mean_class_size=6, share_at_risk=6, share_disclosed=6)


@query("comparison_report")
def comparison_report(spark, folder):
    first, second = order_halves(spark, folder)
    return compare.comparison_report(first, second, ["o_orderkey"], _SIMILAR)
