"""The events file as a stream, run to its end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.scalars import attach
from tabwright.plans import log_queries
from tabwright.plans.drift_queries import rounded, sql_ks
from tabwright.plans.registry import query, table
from tabwright.plans.scratch import scratch_path
from tabwright.streaming import jobs


def event_stream(spark, folder) -> DataFrame:
    schema = table(spark, folder, "events").schema
    stream = jobs.read_stream(spark, folder, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def change_stream(spark, folder) -> DataFrame:
    """Events as changes of users: a signup inserts, a purchase deletes, anything else updates."""
    return as_changes(event_stream(spark, folder))


def as_changes(rows: DataFrame) -> DataFrame:
    operation = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "purchase", "DELETE").otherwise("UPDATE")
    image = F.struct("user_id", "event_type", "value")
    return rows.select(
        operation.alias("operation"), F.lit("users").alias("table"), "ts", F.col("event_id").alias("seq"),
        F.when(operation == "DELETE", image).alias("before"), F.when(operation != "DELETE", image).alias("after"),
    )


#: A window is written once the watermark, ten minutes behind the latest event, has passed its end.
_CLOSED = "time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


def finished(query_handle):
    query_handle.awaitTermination()


_OP = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'DELETE' ELSE 'UPDATE' END"


@query(
    "stream_latest_state",
    f"SELECT user_id, event_type, value FROM (SELECT *, {_OP} AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE op <> 'DELETE'",
)
def stream_latest_state(spark, folder):
    out, mark = scratch_path(spark, "state"), scratch_path(spark, "state-check")
    finished(jobs.run_table(jobs.latest_state(change_stream(spark, folder), ["user_id"]), out, mark, "update"))
    return jobs.upserts(spark, out, ["user_id"]).select("user_id", "after.event_type", "after.value")


@query(
    "stream_windowed_counts",
    f"""SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_micros, 'users' AS "table", {_OP} AS operation, count(*) AS events FROM events
        GROUP BY time_bucket(INTERVAL '1 hour', ts), 3 HAVING {_CLOSED}""",
)
def stream_windowed_counts(spark, folder):
    out, mark = scratch_path(spark, "counts"), scratch_path(spark, "counts-check")
    finished(jobs.run_table(jobs.windowed_counts(change_stream(spark, folder)), out, mark))
    return jobs.finished_windows(spark, out).select(F.unix_micros("start").alias("start_micros"), "table", "operation", "events")


_LATE = "(event_id % 50 = 7 AND ts < (SELECT max(ts) FROM events) - INTERVAL '1 day')"


def late_stream(spark, folder):
    """One event in fifty arrives a day or more behind the last of the others, after all of them."""
    rows = table(spark, folder, "events")
    late = (F.col("event_id") % 50 == 7) & (F.col("ts") < F.col("_last") - F.expr("INTERVAL 1 DAY"))
    marked = attach(rows, rows.agg(F.max("ts").alias("_last"))).withColumn("_late", F.coalesce(late, F.lit(False))).drop("_last")
    source = scratch_path(spark, "late-source")
    # The file source takes older files first.  A batch is judged by the watermark that the batch before it began with.
    even = F.col("event_id") % 2 == 0
    for part, arrived in enumerate((~F.col("_late") & even, ~F.col("_late") & ~even, F.col("_late"))):
        marked.where(arrived).drop("_late").coalesce(1).write.parquet(f"{source}/part{part}")
    stream = jobs.read_stream(spark, f"{source}/*", rows.schema, files_per_batch=1)
    return as_changes(stream.withColumn("ts", F.col("ts").cast("timestamp")))


@query(
    "stream_late_events",
    f"""SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_micros, 'users' AS "table", {_OP} AS operation, count(*) AS events
        FROM events WHERE NOT {_LATE} GROUP BY time_bucket(INTERVAL '1 hour', ts), 3 HAVING {_CLOSED}""",
)
def stream_late_events(spark, folder):
    """Late events come after the others have closed their window: they are left out."""
    out, mark = scratch_path(spark, "late"), scratch_path(spark, "late-check")
    finished(jobs.run_table(jobs.windowed_counts(late_stream(spark, folder)), out, mark))
    return jobs.finished_windows(spark, out).select(F.unix_micros("start").alias("start_micros"), "table", "operation", "events")


@query(
    "stream_state_late_events",
    f"""SELECT user_id, event_type, value FROM (SELECT *, {_OP} AS op FROM events
        WHERE NOT (event_id % 50 = 7 AND ts < (SELECT max(ts) FROM events) - INTERVAL '1 day')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE op <> 'DELETE'""",
)
def stream_state_late_events(spark, folder):
    """Changes behind the watermark do not touch the table, though the state of their keys is gone."""
    out, mark = scratch_path(spark, "late-state"), scratch_path(spark, "late-state-check")
    finished(jobs.run_table(jobs.latest_state(late_stream(spark, folder), ["user_id"], "1 hour"), out, mark, "update"))
    return jobs.upserts(spark, out, ["user_id"]).select("user_id", "after.event_type", "after.value")


@query(
    "stream_error_rate",
    """SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_micros, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
        round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events WHERE user_id % 10 <> 3
        GROUP BY time_bucket(INTERVAL '1 hour', ts) HAVING """
    # the log's own times have whole seconds, and only lines that parse move the watermark
    + _CLOSED.replace("max(ts)", "max(date_trunc('second', ts))").replace("FROM events", "FROM events WHERE user_id % 10 <> 3"),
)
def stream_error_rate(spark, folder):
    # The same line format as the batch access log, built on the stream.
    stream = event_stream(spark, folder)
    lines = stream.select(log_queries.access_line().alias("line"))
    out, mark = scratch_path(spark, "errors"), scratch_path(spark, "errors-check")
    finished(jobs.run_table(jobs.access_error_rate(lines), out, mark))
    return rounded(jobs.finished_windows(spark, out).select(F.unix_micros("start").alias("start_micros"), "requests", "errors", "error_rate"), error_rate=6)


@query(
    "stream_masked",
    """SELECT event_id, substr(sha256(user_id::VARCHAR), 1, 16) AS user_hash, '[REDACTED]' AS props FROM events""",
)
def stream_masked(spark, folder):
    stream = event_stream(spark, folder).select("event_id", F.col("user_id").cast("string").alias("user_hash"), "props")
    out, mark = scratch_path(spark, "masked"), scratch_path(spark, "masked-check")
    finished(jobs.run_append(jobs.masked(stream, {"user_hash": ("username", "hash"), "props": ("name", "redact")}), out, mark))
    return spark.read.parquet(out).select("event_id", "user_hash", "props")


_FIRST_HALF = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')"


@query(
    "stream_drift",
    f"""SELECT 0 AS batch, column_name, round(ks, 6) AS drift_score FROM ({sql_ks(['value'], _FIRST_HALF, 'events')})""",
)
def stream_drift(spark, folder):
    baseline = table(spark, folder, "events").where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    out, mark = scratch_path(spark, "drift"), scratch_path(spark, "drift-check")
    finished(jobs.watch_drift(event_stream(spark, folder), baseline, ["value"], out, mark))
    return rounded(spark.read.parquet(out).select("batch", "column_name", "drift_score"), drift_score=6)
