"""Drift and distribution queries over order lines, accepted against all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import distributions as dist
from tabwright.operators import drift
from tabwright.plans.registry import query, sql_long, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_linestatus"]
PAIR_TEXTS = ["o_orderstatus", "o_orderpriority"]
BASE = "(SELECT * FROM lineitem WHERE l_returnflag = 'A')"
SNAP = "(SELECT * FROM lineitem WHERE l_returnflag <> 'A')"
EARLY = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')"
LATE = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"


def lines(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.where(F.col("l_returnflag") == "A"), rows.where(F.col("l_returnflag") != "A")


def order_halves(spark, folder):
    rows = table(spark, folder, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")
    return rows.where(F.col("o_orderdate") < cut), rows.where(F.col("o_orderdate") >= cut)


def rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def both(columns, cast, first=BASE, second=SNAP):
    return f"{sql_long(first, columns, cast, 'first')} UNION ALL {sql_long(second, columns, cast, 'second')}"


def sql_counts(columns, cast, first=BASE, second=SNAP):
    return f"""SELECT column_name, value,
        count(*) FILTER (WHERE side = 'first') AS n_first, count(*) FILTER (WHERE side = 'second') AS n_second
        FROM ({both(columns, cast, first, second)}) GROUP BY 1, 2"""


def sql_ks(columns, first=BASE, second=SNAP):
    return f"""SELECT column_name, max(abs(cf / tf - cs / ts)) AS ks, max(tf)::BIGINT AS n_first, max(ts)::BIGINT AS n_second FROM (
        SELECT column_name,
          sum(n_first) OVER (PARTITION BY column_name ORDER BY value)::DOUBLE AS cf,
          sum(n_second) OVER (PARTITION BY column_name ORDER BY value)::DOUBLE AS cs,
          sum(n_first) OVER (PARTITION BY column_name)::DOUBLE AS tf,
          sum(n_second) OVER (PARTITION BY column_name)::DOUBLE AS ts
        FROM ({sql_counts(columns, 'DOUBLE', first, second)})) GROUP BY 1"""


def sql_measures(items):
    """items: SQL giving column_name, n_first, n_second per bin or category."""
    return f"""SELECT column_name, sum(p * ln(p / q)) AS kl,
        sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 AS js,
        sum(least(f, g)) AS overlap, sum(pow(f - g, 2) / (f + 1e-10)) AS chi_square_distance, count(*) AS items
      FROM (SELECT column_name, f, g, (f + 1e-10) / (1 + k * 1e-10) AS p, (g + 1e-10) / (1 + k * 1e-10) AS q FROM (
        SELECT column_name, n_first::DOUBLE / sum(n_first) OVER w AS f, n_second::DOUBLE / sum(n_second) OVER w AS g,
          count(*) OVER w AS k
        FROM ({items}) WINDOW w AS (PARTITION BY column_name))) GROUP BY 1"""


def sql_histogram(columns, first=BASE, second=SNAP, bins=29):
    return f"""WITH v AS ({both(columns, 'DOUBLE', first, second)}),
      r AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1),
      b AS (SELECT r.column_name, g.bin FROM r, (SELECT unnest(range({bins}))::INTEGER AS bin) g),
      h AS (SELECT v.column_name, side,
        CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}) ELSE {bins - 1} END::INTEGER AS bin
        FROM v JOIN r USING (column_name))
      SELECT b.column_name, b.bin, count(*) FILTER (WHERE side = 'first') AS n_first,
        count(*) FILTER (WHERE side = 'second') AS n_second
      FROM b LEFT JOIN h ON b.column_name = h.column_name AND b.bin = h.bin GROUP BY 1, 2"""


SUMMARY_SQL = f"""SELECT column_name, count(*) FILTER (WHERE side = 'first') AS n_first,
    count(*) FILTER (WHERE side = 'second') AS n_second,
    avg(value) FILTER (WHERE side = 'first') AS mean_first, avg(value) FILTER (WHERE side = 'second') AS mean_second,
    stddev_samp(value) FILTER (WHERE side = 'first') AS std_first, stddev_samp(value) FILTER (WHERE side = 'second') AS std_second,
    min(value) FILTER (WHERE side = 'first') AS min_first, min(value) FILTER (WHERE side = 'second') AS min_second,
    max(value) FILTER (WHERE side = 'first') AS max_first, max(value) FILTER (WHERE side = 'second') AS max_second
    FROM ({both(NUMBERS, 'DOUBLE')}) GROUP BY 1"""


@query(
    "numeric_summary",
    f"""SELECT column_name, n_first, n_second, round(mean_first, 6) AS mean_first, round(mean_second, 6) AS mean_second,
        round(std_first, 6) AS std_first, round(std_second, 6) AS std_second,
        min_first, min_second, max_first, max_second,
        round(abs(mean_first - mean_second), 6) AS mean_difference, round(abs(std_first - std_second), 6) AS std_difference,
        round(std_second / std_first, 6) AS std_ratio
        FROM ({SUMMARY_SQL})""",
)
def numeric_summary(spark, folder):
    s = dist.paired_summary(*lines(spark, folder), NUMBERS)
    out = s.select(
        "*",
        F.abs(F.col("mean_first") - F.col("mean_second")).alias("mean_difference"),
        F.abs(F.col("std_first") - F.col("std_second")).alias("std_difference"),
        (F.col("std_second") / F.col("std_first")).alias("std_ratio"),
    )
    names = ["mean_first", "mean_second", "std_first", "std_second", "mean_difference", "std_difference", "std_ratio"]
    return rounded(out, **{n: 6 for n in names})


@query(
    "frequency_table",
    f"""SELECT column_name, value, round(n_first / sum(n_first) OVER w, 9) AS share_first,
        round(n_second / sum(n_second) OVER w, 9) AS share_second
        FROM ({sql_counts(PAIR_TEXTS, 'VARCHAR', EARLY, LATE)}) WINDOW w AS (PARTITION BY column_name)""",
)
def frequency_table(spark, folder):
    c = dist.with_totals(dist.paired_counts(*order_halves(spark, folder), PAIR_TEXTS, "categorical"), "n_first", "n_second")
    return c.select(
        "column_name",
        "value",
        F.round(F.col("n_first") / F.col("total_n_first"), 9).alias("share_first"),
        F.round(F.col("n_second") / F.col("total_n_second"), 9).alias("share_second"),
    )


@query(
    "exact_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {q}::DOUBLE AS fraction, round(quantile_cont({c}, {q}), 6) AS quantile FROM lineitem"
        for c in NUMBERS
        for q in (0.05, 0.25, 0.5, 0.75, 0.95)
    ),
)
def exact_quantiles(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rounded(dist.quantiles(rows, NUMBERS, [0.05, 0.25, 0.5, 0.75, 0.95]), quantile=6)


@query(
    "sketched_quantiles",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, {q}::DOUBLE AS fraction, true AS close" for c in NUMBERS for q in (0.05, 0.5, 0.95)),
)
def sketched_quantiles(spark, folder):
    """Sketches of two halves of the lines, merged; close: the value's exact ranks are within two hundredths of the fraction."""
    rows = table(spark, folder, "lineitem")
    halves = [dist.quantile_sketches(rows.where(F.col("l_orderkey") % 2 == k), NUMBERS) for k in (0, 1)]
    found = dist.approximate_quantiles(dist.merged_sketches(halves[0].unionByName(halves[1])), [0.05, 0.5, 0.95])
    counts = dist.running_counts(dist.ordered_counts(rows, NUMBERS, dist.fit_cut_points([rows], NUMBERS)), "n")
    ranks = counts.join(F.broadcast(found), "column_name").groupBy("column_name", "fraction").agg(
        F.max(F.when(F.col("value") <= F.col("quantile"), F.col("cum_n") / F.col("total_n"))).alias("upto"),
        F.coalesce(F.max(F.when(F.col("value") < F.col("quantile"), F.col("cum_n") / F.col("total_n"))), F.lit(0.0)).alias("below"),
    )
    close = (F.col("upto") >= F.col("fraction") - 0.02) & (F.col("below") <= F.col("fraction") + 0.02)
    return ranks.select("column_name", "fraction", close.alias("close"))


@query("joint_histogram", sql_histogram(NUMBERS))
def joint_histogram(spark, folder):
    return dist.joint_histogram(*lines(spark, folder), NUMBERS)


@query("ks_statistic", f"SELECT column_name, round(ks, 6) AS ks, n_first, n_second FROM ({sql_ks(NUMBERS)})")
def ks_statistic(spark, folder):
    first, second = lines(spark, folder)
    cuts = dist.fit_cut_points([first, second], NUMBERS)
    return rounded(dist.ks_distance(dist.ordered_paired_counts(first, second, NUMBERS, cuts)), ks=6)


_M = ["kl", "js", "overlap", "chi_square_distance"]
_M_SQL = "column_name, items, " + ", ".join(f"round({m}, 6) AS {m}" for m in _M)


@query("histogram_divergence", f"SELECT {_M_SQL} FROM ({sql_measures(sql_histogram(NUMBERS))})")
def histogram_divergence(spark, folder):
    return rounded(dist.frequency_measures(dist.joint_histogram(*lines(spark, folder), NUMBERS)), **{m: 6 for m in _M})


@query(
    "category_divergence",
    f"SELECT {_M_SQL} FROM ({sql_measures(sql_counts(PAIR_TEXTS, 'VARCHAR', EARLY, LATE))})",
)
def category_divergence(spark, folder):
    c = dist.paired_counts(*order_halves(spark, folder), PAIR_TEXTS, "categorical")
    return rounded(dist.frequency_measures(c), **{m: 6 for m in _M})


_NUMERIC_DRIFT_SQL = f"""SELECT s.column_name, ks AS drift_score,
    greatest(0, least(1, {{p}})) AS p_value, mean_first AS mean_baseline, mean_second AS mean_snapshot,
    mean_second - mean_first AS mean_shift
  FROM ({SUMMARY_SQL}) s JOIN (SELECT column_name, ks,
      greatest(sqrt(n_first::DOUBLE * n_second / (n_first + n_second)) * ks, 1e-3) AS lam FROM ({sql_ks(NUMBERS)})) k
    USING (column_name)"""
_UP = " + ".join(f"({2.0 * (-1) ** (k - 1)}) * exp({-2.0 * k * k} * lam * lam)" for k in range(1, 6))
_LOW = " + ".join(f"exp({-((2 * k - 1) ** 2)}::DOUBLE * pi() * pi() / 8 / (lam * lam))" for k in range(1, 6))
_NUMERIC_DRIFT_SQL = _NUMERIC_DRIFT_SQL.format(p=f"CASE WHEN lam > 1 THEN {_UP} ELSE 1 - sqrt(2 * pi()) / lam * ({_LOW}) END")


@query(
    "numeric_drift",
    f"""SELECT column_name, round(drift_score, 6) AS drift_score, round(p_value, 6) AS p_value,
        round(mean_baseline, 6) AS mean_baseline, round(mean_snapshot, 6) AS mean_snapshot, round(mean_shift, 6) AS mean_shift,
        CASE WHEN p_value < 0.001 OR drift_score > 0.3 THEN 'red' WHEN p_value < 0.05 OR drift_score > 0.1 THEN 'yellow'
          ELSE 'green' END AS alert_level
        FROM ({_NUMERIC_DRIFT_SQL})""",
)
def numeric_drift(spark, folder):
    report = drift.numeric_drift(*lines(spark, folder), NUMBERS)
    kept = report.select(
        "column_name", "drift_score", "p_value", "mean_baseline", "mean_snapshot", "mean_shift", "alert_level"
    )
    return rounded(kept, drift_score=6, p_value=6, mean_baseline=6, mean_snapshot=6, mean_shift=6)


def sql_chi(columns, first, second):
    return f"""SELECT column_name, sum(pow(n_second - e, 2) / e) AS chi_square,
        count(*) FILTER (WHERE n_first = 0) AS new_categories, count(*) FILTER (WHERE n_second = 0) AS missing_categories
        FROM (SELECT *, greatest(n_first::DOUBLE * sum(n_second) OVER w / sum(n_first) OVER w, 1e-10) AS e
          FROM ({sql_counts(columns, 'VARCHAR', first, second)}) WINDOW w AS (PARTITION BY column_name)) GROUP BY 1"""


@query(
    "categorical_drift",
    f"""SELECT column_name, round(js, 6) AS drift_score, round(chi_square, 4) AS chi_square, new_categories, missing_categories
        FROM ({sql_measures(sql_counts(PAIR_TEXTS, 'VARCHAR', EARLY, LATE))}) JOIN ({sql_chi(PAIR_TEXTS, EARLY, LATE)}) USING (column_name)""",
)
def categorical_drift(spark, folder):
    report = drift.categorical_drift(*order_halves(spark, folder), PAIR_TEXTS)
    kept = report.select("column_name", "drift_score", "chi_square", "new_categories", "missing_categories")
    return rounded(kept, drift_score=6, chi_square=4)


@query(
    "category_changes",
    """WITH a AS (SELECT DISTINCT c_name AS value FROM customer), b AS (SELECT DISTINCT s_name AS value FROM supplier),
       c AS (SELECT DISTINCT c_nationkey::VARCHAR AS value FROM customer), d AS (SELECT DISTINCT s_nationkey::VARCHAR AS value FROM supplier)
       SELECT 'name' AS column_name, value, 'new' AS change FROM b WHERE value NOT IN (SELECT value FROM a)
       UNION ALL SELECT 'name', value, 'missing' FROM a WHERE value NOT IN (SELECT value FROM b)
       UNION ALL SELECT 'nation', value, 'new' FROM d WHERE value NOT IN (SELECT value FROM c)
       UNION ALL SELECT 'nation', value, 'missing' FROM c WHERE value NOT IN (SELECT value FROM d)""",
)
def category_changes(spark, folder):
    a = table(spark, folder, "customer").selectExpr("c_name AS name", "CAST(c_nationkey AS STRING) AS nation")
    b = table(spark, folder, "supplier").selectExpr("s_name AS name", "CAST(s_nationkey AS STRING) AS nation")
    return drift.category_changes(dist.paired_counts(a, b, ["name", "nation"], "categorical"))


_REPORT_SQL = f"""SELECT column_name, 'numeric' AS column_type, drift_score,
        CASE WHEN drift_score > 0.3 THEN 'red' WHEN drift_score > 0.1 THEN 'yellow' ELSE 'green' END AS alert_level
        FROM ({_NUMERIC_DRIFT_SQL})
      UNION ALL SELECT column_name, 'categorical', js,
        CASE WHEN js > 0.3 THEN 'red' WHEN js > 0.1 THEN 'yellow' ELSE 'green' END
        FROM ({sql_measures(sql_counts(TEXTS, 'VARCHAR'))})"""


@query(
    "drift_report",
    f"SELECT column_name, column_type, round(drift_score, 6) AS drift_score, alert_level FROM ({_REPORT_SQL})",
)
def drift_report(spark, folder):
    report = drift.drift_report(*lines(spark, folder), NUMBERS + TEXTS, use_p_value=False)
    return rounded(report.select("column_name", "column_type", "drift_score", "alert_level"), drift_score=6)


@query("drift_report_full")
def drift_report_full(spark, folder):
    return drift.drift_report(*lines(spark, folder), NUMBERS + TEXTS)


@query(
    "drift_summary",
    f"""SELECT count(*) AS columns, round(least(1, avg(drift_score)), 6) AS overall_score,
        count(*) FILTER (WHERE alert_level = 'red') AS red_columns, count(*) FILTER (WHERE alert_level = 'yellow') AS yellow_columns,
        count(*) FILTER (WHERE alert_level = 'green') AS green_columns FROM ({_REPORT_SQL})""",
)
def drift_summary(spark, folder):
    report = drift.drift_report(*lines(spark, folder), NUMBERS + TEXTS, use_p_value=False)
    return rounded(drift.drift_summary(report), overall_score=6)


# --- conditional shift ------------------------------------------------------

FEATURES = ["o_totalprice", "o_custkey", "o_orderpriority"]


def sql_bins(target, target_cast):
    def numeric_side(c, source, mark):
        return f"""SELECT '{c}' AS feature, (CASE WHEN {c} < e[1] THEN NULL
            WHEN {c} <= e[2] THEN 0 WHEN {c} <= e[3] THEN 1 WHEN {c} <= e[4] THEN 2 WHEN {c} <= e[5] THEN 3
            WHEN {c} <= e[6] THEN 4 END)::VARCHAR AS bin, {target}::{target_cast} AS target, '{mark}' AS side
            FROM {source}, (SELECT quantile_cont({c}::DOUBLE, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM {EARLY})"""

    parts = [numeric_side(c, s, m) for c in FEATURES[:2] for s, m in ((EARLY, "b"), (LATE, "s"))]
    parts += [
        f"SELECT 'o_orderpriority', o_orderpriority, {target}::{target_cast}, '{m}' FROM {s}"
        for s, m in ((EARLY, "b"), (LATE, "s"))
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE bin IS NOT NULL"


_TEXT_BINS = f"""WITH c AS (SELECT feature, bin, target, count(*) FILTER (WHERE side = 'b') AS nf, count(*) FILTER (WHERE side = 's') AS ns
      FROM ({sql_bins('o_orderstatus', 'VARCHAR')}) GROUP BY 1, 2, 3),
    f AS (SELECT *, sum(nf) OVER w AS tf, sum(ns) OVER w AS ts, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY feature, bin)),
    s AS (SELECT feature, bin, tf, ts, (nf / tf + 1e-10) / (1 + k * 1e-10) AS p, (ns / ts + 1e-10) / (1 + k * 1e-10) AS q
      FROM f WHERE tf > 0 AND ts > 0)
    SELECT feature, bin, max(tf)::BIGINT AS n_baseline, max(ts)::BIGINT AS n_snapshot,
      least(1, sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2) AS diff FROM s GROUP BY 1, 2"""


@query("conditional_bins_text", f"SELECT feature, bin, n_baseline, n_snapshot, round(diff, 6) AS diff FROM ({_TEXT_BINS})")
def conditional_bins_text(spark, folder):
    return rounded(drift.conditional_bins(*order_halves(spark, folder), "o_orderstatus", FEATURES), diff=6)


@query(
    "conditional_bins_numeric",
    f"""SELECT feature, bin, count(*) FILTER (WHERE side = 'b') AS n_baseline, count(*) FILTER (WHERE side = 's') AS n_snapshot,
        round(avg(target) FILTER (WHERE side = 'b'), 4) AS baseline_mean, round(avg(target) FILTER (WHERE side = 's'), 4) AS snapshot_mean,
        round(least(1, abs(avg(target) FILTER (WHERE side = 'b') - avg(target) FILTER (WHERE side = 's')) /
          (SELECT max(o_totalprice) - min(o_totalprice) FROM {EARLY})), 6) AS diff
        FROM ({sql_bins('o_totalprice', 'DOUBLE')}) WHERE feature <> 'o_totalprice' GROUP BY 1, 2""",
)
def conditional_bins_numeric(spark, folder):
    b = drift.conditional_bins(*order_halves(spark, folder), "o_totalprice", FEATURES)
    return rounded(b, baseline_mean=4, snapshot_mean=4, diff=6)


_FEATURES_SQL = f"""SELECT feature, avg(diff) AS score, count(*) AS bins, sum(n_baseline)::BIGINT AS rows_baseline,
    sum(n_snapshot)::BIGINT AS rows_snapshot FROM ({_TEXT_BINS}) GROUP BY 1"""
_ALERT = "CASE WHEN score > 0.3 THEN 'red' WHEN score > 0.1 THEN 'yellow' ELSE 'green' END AS alert_level"


@query(
    "conditional_features",
    f"""SELECT feature, round(score, 6) AS conditional_drift_score, bins, rows_baseline, rows_snapshot, {_ALERT}
        FROM ({_FEATURES_SQL}) WHERE rows_baseline >= 5 AND rows_snapshot >= 5""",
)
def conditional_features(spark, folder):
    b = drift.conditional_bins(*order_halves(spark, folder), "o_orderstatus", FEATURES)
    return rounded(drift.conditional_features(b), conditional_drift_score=6)


@query(
    "conditional_top_features",
    f"""SELECT row_number() OVER (ORDER BY score DESC, feature)::INTEGER AS position, feature, round(score, 6) AS conditional_drift_score,
        {_ALERT} FROM ({_FEATURES_SQL}) ORDER BY 1 LIMIT 2""",
)
def conditional_top_features(spark, folder):
    b = drift.conditional_bins(*order_halves(spark, folder), "o_orderstatus", FEATURES)
    return rounded(drift.conditional_top(drift.conditional_features(b), 2), conditional_drift_score=6)


@query(
    "conditional_overall",
    f"SELECT round(least(1, avg(score)), 6) AS overall_score, count(*) AS features FROM ({_FEATURES_SQL})",
)
def conditional_overall(spark, folder):
    b = drift.conditional_bins(*order_halves(spark, folder), "o_orderstatus", FEATURES)
    return rounded(drift.conditional_overall(drift.conditional_features(b)), overall_score=6)
