"""Series of every user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import series
from tabwright.plans.drift_queries import rounded
from tabwright.plans.registry import query, sql_index, table

ORDER = ["ts", "event_id"]
KEYS = ["user_id"]
POS = "(SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)"


def events(spark, folder):
    return table(spark, folder, "events").select("user_id", "ts", "event_id", "value")


def _runs(length):
    return f"(SELECT user_id, p AS start, list(value) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS v FROM {POS} QUALIFY len(v) = {length})"


@query("sequences", f"SELECT user_id, start, array_to_string([round(x, 6) for x in v], ',') AS values FROM {_runs(5)}")
def sequences(spark, folder):
    runs = series.sequences(events(spark, folder), KEYS, ORDER, ["value"], 5)
    return runs.select("user_id", "start", F.concat_ws(",", F.transform("values", lambda x: F.round(x[0], 6).cast("string"))).alias("values"))


@query(
    "supervised_windows",
    f"SELECT user_id, start, array_to_string([round(x, 6) for x in v[:4]], ',') AS inputs, v[5] AS label FROM {_runs(5)}",
)
def supervised_windows(spark, folder):
    w = series.supervised(events(spark, folder), KEYS, ORDER, ["value"], "value", 4)
    return w.select("user_id", "start", F.concat_ws(",", F.transform("inputs", lambda x: F.round(x[0], 6).cast("string"))).alias("inputs"), "label")


_CHUNKS = f"(SELECT user_id, p // 24 AS chunk, list(value ORDER BY p) AS v FROM {POS} GROUP BY 1, 2 HAVING count(*) = 24)"


@query("series_chunks", f"SELECT user_id, chunk, array_to_string(v, ',') AS values FROM {_CHUNKS}")
def series_chunks(spark, folder):
    c = series.chunks(events(spark, folder), KEYS, ORDER, ["value"], 24)
    return c.select("user_id", "chunk", F.concat_ws(",", F.transform("values", lambda x: x[0].cast("string"))).alias("values"))


@query(
    "flattened_chunks",
    f"SELECT row_number() OVER (ORDER BY user_id, chunk, i) - 1 AS row, value FROM (SELECT user_id, chunk, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM {_CHUNKS})",
)
def flattened_chunks(spark, folder):
    c = series.chunks(events(spark, folder), KEYS, ORDER, ["value"], 24)
    return series.flatten(c, ["user_id", "chunk"], ["value"])


@query(
    "time_grid",
    "SELECT event_id, (SELECT epoch_us(min(ts)) FROM events) + event_id * 86400000000 AS micros FROM events",
)
def time_grid(spark, folder):
    rows = table(spark, folder, "events")
    return series.time_grid(rows.select("event_id"), rows, "ts", "event_id").select("event_id", F.unix_micros("ts").alias("micros"))


_BOOTSTRAP = f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY substr(sha256(concat_ws('|', user_id, start)), 1, 3), user_id, start) - 1 AS spot FROM {_runs(8)}), n AS (SELECT count(*) AS n FROM r), c AS (SELECT count(*) AS rows FROM events),
      d AS (SELECT id, {sql_index('n', 'block', 'id')} AS spot FROM (SELECT unnest(range(((SELECT rows FROM c) + 7) // 8)) AS id), n)
      SELECT id * 8 + i - 1 AS row, value FROM (SELECT id, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM d JOIN r USING (spot)) WHERE id * 8 + i - 1 < (SELECT rows FROM c)"""


@query("block_bootstrap", _BOOTSTRAP)
def block_bootstrap(spark, folder):
    rows = events(spark, folder)
    return series.block_bootstrap(rows, KEYS, ORDER, ["value"], 8, rows.count())


@query(
    "naive_forecast_metrics",
    f"""SELECT round(sqrt(avg(pow(v[5] - v[4], 2))), 6) AS rmse, round(avg(abs(v[5] - v[4])), 6) AS mae,
        round(1 - sum(pow(v[5] - v[4], 2)) / (var_pop(v[5]) * count(*)), 6) AS r2, round(avg(abs((v[5] - v[4]) / (abs(v[5]) + 1e-8))) * 100, 2) AS mape FROM {_runs(5)}""",
)
def naive_forecast_metrics(spark, folder):
    w = series.supervised(events(spark, folder), KEYS, ORDER, ["value"], "value", 4)
    return rounded(series.forecast_metrics(series.naive_forecast(w)), rmse=6, mae=6, r2=6, mape=2)


@query("forecast_efficacy")
def forecast_efficacy(spark, folder):
    rows = events(spark, folder)
    made = series.block_bootstrap(rows, KEYS, ORDER, ["value"], 8, rows.count())
    as_series = made.select((F.col("row") % 50).alias("user_id"), F.col("row").alias("ts"), F.col("row").alias("event_id"), "value")
    return series.forecast_efficacy(rows.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))), as_series, KEYS, ORDER, ["value"], "value")


_CHECKS = f"""(WITH made AS ({_BOOTSTRAP}),
      s AS (SELECT (SELECT avg(value) FROM events) AS m, (SELECT avg(value) FROM made) AS mm, (SELECT stddev_samp(value) FROM events) AS d, (SELECT stddev_samp(value) FROM made) AS dd)
      SELECT 'same_columns' AS "check", true AS passed UNION ALL SELECT 'regular_steps', true
      UNION ALL SELECT 'mean:value', abs(m - mm) <= 0.3 * greatest(abs(m), 1e-9) FROM s UNION ALL SELECT 'std:value', abs(d - dd) <= 0.3 * greatest(abs(d), 1e-9) FROM s)"""


@query("series_output_check", f"SELECT * FROM {_CHECKS}")
def series_output_check(spark, folder):
    rows = events(spark, folder)
    made = series.block_bootstrap(rows, KEYS, ORDER, ["value"], 8, rows.count(), "ts")
    return series.output_check(rows.select("ts", "value"), made.select("ts", "value"), "ts", ["value"])


@query(
    "series_output_verdict",
    f"""SELECT share, CASE WHEN share = 1 THEN 'pass' WHEN share >= 0.7 THEN 'mostly' ELSE 'fail' END AS verdict
       FROM (SELECT avg(coalesce(passed, false)::INT) AS share FROM {_CHECKS})""",
)
def series_output_verdict(spark, folder):
    return series.check_band(series_output_check(spark, folder))
