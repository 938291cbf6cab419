"""Logs derived from every event: written as lines, parsed back, analysed, and drawn anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.log_formats import ACCESS, APPLICATION
from tabwright.operators import logs
from tabwright.plans.drift_queries import rounded
from tabwright.plans.registry import query, sql_normal, sql_uniform, table
from tabwright.session import cut_lineage, shuffle_partitions

STATUS = {"error": 500, "purchase": 302, "signup": 201, "click": 200, "view": 304}
LEVEL = {"error": "ERROR", "purchase": "INFO", "signup": "WARNING", "click": "DEBUG", "view": "INFO"}


def _mapped(mapping, column="event_type"):
    chain = F
    for k, v in mapping.items():
        chain = chain.when(F.col(column) == k, F.lit(str(v)))
    return chain.otherwise(F.lit("x"))


def _mapped_sql(mapping):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " ELSE 'x' END"


def access_line() -> Column:
    """An event as an access-log line; every tenth user's lines are damaged, signups have no size."""
    size = F.when(F.col("event_type") == "signup", "-").otherwise(F.floor(F.col("value") * 100).cast("string"))
    return F.concat(
        F.format_string("10.0.%d.%d", F.floor(F.col("user_id") / 256), F.col("user_id") % 256),
        F.format_string(" - user%d [", "user_id"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'),
        F.col("event_type"), F.when(F.col("user_id") % 10 == 3, F.lit(" HTTP")).otherwise(F.lit(' HTTP/1.1" ')),
        _mapped(STATUS), F.lit(" "), size,
    )


def access_log(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("event_id", access_line().alias("line"))


ACCESS_SQL = f"""(SELECT event_id, printf('10.0.%d.%d', user_id // 256, user_id % 256) AS ip, printf('user%d', user_id) AS user,
    strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS timestamp, 'GET' AS method, '/' || event_type AS path, ({_mapped_sql(STATUS)})::INT AS status,
    CASE WHEN event_type = 'signup' THEN 0 ELSE floor(value * 100) END::BIGINT AS size FROM events WHERE user_id % 10 <> 3)"""


@query("access_log_parse", f"SELECT * FROM {ACCESS_SQL}")
def access_log_parse(spark, folder):
    return logs.parse_access(access_log(spark, folder))


@query("log_parse_counts", "SELECT count(*) AS lines, count(*) FILTER (WHERE user_id % 10 <> 3) AS parsed FROM events")
def log_parse_counts(spark, folder):
    return logs.parse_counts(access_log(spark, folder), ACCESS)


def syslog(spark, folder) -> DataFrame:
    pid = F.when(F.col("user_id") % 2 == 0, F.format_string("[%d]", F.col("user_id") + 100)).otherwise("")
    line = F.concat(
        F.date_format("ts", "MMM dd HH:mm:ss"), F.format_string(" host%d ", F.col("user_id") % 7), F.col("event_type"), pid,
        F.lit(": "), F.col("props"),
    )
    return table(spark, folder, "events").select("event_id", line.alias("line"))


@query(
    "syslog_parse",
    """SELECT event_id, strftime(ts, '%b %d %H:%M:%S') AS timestamp, printf('host%d', user_id % 7) AS hostname, event_type AS process,
        CASE WHEN user_id % 2 = 0 THEN printf('%d', user_id + 100) ELSE '' END AS pid, props AS message FROM events""",
)
def syslog_parse(spark, folder):
    return logs.parse_syslog(syslog(spark, folder))


def application_log(spark, folder) -> DataFrame:
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), _mapped(LEVEL), F.lit("  ["), F.col("event_type"), F.lit("] user "),
        F.col("user_id").cast("string"), F.lit(" "), F.col("props"),
    )
    return table(spark, folder, "events").select("event_id", line.alias("line"))


APPLICATION_SQL = f"""(SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {_mapped_sql(LEVEL)} AS level, event_type AS component,
    'user ' || user_id || ' ' || props AS message FROM events)"""


@query("application_log_parse", f"SELECT * FROM {APPLICATION_SQL}")
def application_log_parse(spark, folder):
    return logs.parse_application(application_log(spark, folder))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a table of one row group is one task's, with all that is worked out per row."""
    # by place, not by turns, for which every task would first sort its rows
    place = F.xxhash64(F.monotonically_increasing_id())
    return df.withColumn("_place", place).repartition(shuffle_partitions(df.sparkSession), "_place").drop("_place")


def json_log(spark, folder, events=None) -> DataFrame:
    """JSON lines; errors carry a code, and purchases are cut short."""
    record = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), _mapped(LEVEL).alias("level"), "user_id", "value",
            F.when(F.col("event_type") == "error", F.col("event_id") % 9).alias("code"),
        )
    )
    line = F.when(F.col("event_type") == "purchase", F.substring(record, 1, 20)).otherwise(record)
    return (table(spark, folder, "events") if events is None else events).select("event_id", line.alias("line"))


JSON_SCHEMA = "timestamp string, level string, user_id bigint, value double, code bigint"
JSON_FIELDS = ["timestamp", "level", "user_id", "value", "code"]


@query(
    "json_log_parse",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, {_mapped_sql(LEVEL)} AS level, user_id, value,
        CASE WHEN event_type = 'error' THEN event_id % 9 END AS code FROM events WHERE event_type <> 'purchase'""",
)
def json_log_parse(spark, folder):
    return logs.parse_json(json_log(spark, folder), JSON_SCHEMA)


@query("csv_log_parse", "SELECT event_id, event_id::VARCHAR AS id, 'a \"b\", ' || event_type AS what, user_id::VARCHAR AS who FROM events")
def csv_log_parse(spark, folder):
    quoted = F.concat(F.lit('"a \\"b\\", '), F.col("event_type"), F.lit('"'))
    line = F.concat_ws(",", F.col("event_id").cast("string"), quoted, F.col("user_id").cast("string"))
    rows = table(spark, folder, "events").select("event_id", line.alias("line"))
    header = rows.limit(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("id,what,who").alias("line"))
    return logs.parse_csv(rows.unionByName(header), ["id", "what", "who"], ["event_id"])


@query(
    "log_format_detection",
    # what each log is made of: the share of its lines in its format is one, but for plain words
    """SELECT source, CASE WHEN matching > 0.5 * n THEN source_format ELSE 'unknown' END AS format, n AS lines_read FROM (
        SELECT 'access' AS source, 'apache' AS source_format, count(*) AS n, count(*) AS matching FROM events
        UNION ALL SELECT 'syslog', 'syslog', count(*), count(*) FROM events
        UNION ALL SELECT 'application', 'application', count(*), count(*) FROM events
        UNION ALL SELECT 'json', 'json', count(*), count(*) FILTER (WHERE event_type <> 'purchase') FROM events
        UNION ALL SELECT 'plain', '', count(*), 0 FROM events)""",
)
def log_format_detection(spark, folder):
    plain = table(spark, folder, "events").select("event_id", F.col("event_type").alias("line"))
    sources = {
        "access": access_log(spark, folder), "syslog": syslog(spark, folder), "application": application_log(spark, folder),
        "json": json_log(spark, folder), "plain": plain,
    }
    parts = [logs.detect_format(d, ["event_id"]).select(F.lit(n).alias("source"), "format", "lines_read") for n, d in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- distributions ----------------------------------------------------------

FIELDS = ["ip", "user", "method", "path", "status", "size"]
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value FROM {ACCESS_SQL}" for f in FIELDS)
_COUNTS = f"(SELECT field, value, count(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2)"
_TOP = f"(SELECT field, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS position, value, n FROM {_COUNTS} QUALIFY position <= 50)"
_ALL = f"(SELECT field, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS position, value, n FROM {_COUNTS})"


def parsed(spark, folder):
    return logs.parse_access(access_log(spark, folder))


@query("field_top_values", f"SELECT * FROM {_TOP}")
def field_top_values(spark, folder):
    return logs.top_values(parsed(spark, folder), FIELDS)


@query(
    "field_summary",
    f"""SELECT field, CASE WHEN field IN ('status', 'size') THEN 'integer' ELSE 'string' END AS kind, sum(n)::BIGINT AS total, count(*) AS distinct_values,
        min(value::DOUBLE) FILTER (WHERE field IN ('status', 'size')) AS low, max(value::DOUBLE) FILTER (WHERE field IN ('status', 'size')) AS high,
        round(sum(value::DOUBLE * n) FILTER (WHERE field IN ('status', 'size')) / sum(n), 6) AS mean
        FROM (SELECT field, CASE WHEN field IN ('status', 'size') THEN value END AS value, n FROM {_COUNTS}) GROUP BY 1""",
)
def field_summary(spark, folder):
    return rounded(logs.field_summary(parsed(spark, folder), FIELDS), mean=6)


@query(
    "field_report",
    f"""SELECT field, (SELECT count(*) FROM {_COUNTS} c WHERE c.field = t.field) AS distinct_values, list(value ORDER BY position) AS top
        FROM {_TOP} t WHERE position <= 5 GROUP BY 1""",
)
def field_report(spark, folder):
    return logs.field_report(parsed(spark, folder), FIELDS)


# --- draws ------------------------------------------------------------------

END = "2024-02-01 00:00:00"


def joined_draws(draws, base="(SELECT event_id AS id FROM events)", top=_ALL):
    """CTEs giving id and one drawn column per (name, field, u, keep)."""
    parts = []
    for name, field, u, keep in draws:
        parts.append(
            f"""{name}_t AS (SELECT id, arg_min(value, hi) AS {name} FROM (SELECT id, {u} AS u FROM {base}) b JOIN
            (SELECT value, sum(n) OVER (ORDER BY position)::DOUBLE / (sum(n) OVER ())::DOUBLE AS hi FROM {top} t WHERE field = '{field}' AND {keep}) c ON u < hi GROUP BY 1)"""
        )
    return ", ".join(parts)


def numeric_sql(observed, tag, low, high, mean):
    gauss = f"least({high}, greatest({low}, {mean} + CASE WHEN {high} > {low} THEN ({high} - {low}) / 4 ELSE 1 END * {sql_normal(tag + ':g', 'id')}))"
    return f"CASE WHEN {sql_uniform(tag + ':m', 'id')} < 0.7 THEN coalesce(TRY_CAST({observed} AS DOUBLE), {gauss}) ELSE {gauss} END"


def ts_sql(hours):
    return f"(epoch_us(TIMESTAMP '{END}') - floor({sql_uniform('log-ts', 'id')} * {hours * 3_600_000_000})::BIGINT)"


def rows(spark, folder, hours=24):
    """One new line per event."""
    return logs.spread_times(spread(table(spark, folder, "events").select(F.col("event_id").alias("id"))), END, hours)


@query("weighted_draw", f"WITH {joined_draws([('path', 'path', sql_uniform('path', 'id'), 'true')])} SELECT id, path FROM path_t")
def weighted_draw(spark, folder):
    models = logs.fit_fields(parsed(spark, folder), ["path"])
    return logs.with_draws(rows(spark, folder), models).select("id", logs.draw(models["path"], "path", F.col("id")).alias("path"))


_SIZE = "(SELECT min(size)::DOUBLE AS lo, max(size)::DOUBLE AS hi, avg(size) AS me FROM " + ACCESS_SQL + ")"
_SIZE_TOP_DRAW = ("size_v", "size", sql_uniform("size:v", "id"), "true")


@query(
    "numeric_draw",
    f"WITH {joined_draws([_SIZE_TOP_DRAW])} SELECT id, round({numeric_sql('size_v', 'size', 'lo', 'hi', 'me')}, 4) AS size FROM size_v_t, {_SIZE}",
)
def numeric_draw(spark, folder):
    models = logs.fit_fields(parsed(spark, folder), ["size"])
    return logs.with_draws(rows(spark, folder), {"size:v": models["size"]}).select("id", F.round(logs.numeric_draw(models["size"], "size", F.col("id")), 4).alias("size"))


@query("log_times", f"SELECT id, {ts_sql(24)} AS micros FROM (SELECT event_id AS id FROM events)")
def log_times(spark, folder):
    return rows(spark, folder).select("id", F.unix_micros("ts").alias("micros"))


_ACCESS_DRAWS = joined_draws(
    [
        *[(f"{f}_v", f, sql_uniform(f, "id"), "true") for f in ("ip", "user", "method", "path", "status")],
        _SIZE_TOP_DRAW,
        ("broken", "status", sql_uniform("error", "id"), "value::INT >= 400"),
    ]
)


@query(
    "access_log_synthesis",
    f"""WITH {_ACCESS_DRAWS}
      SELECT id, ip_v || ' - ' || user_v || ' [' || strftime(make_timestamp({ts_sql(24)}), '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method_v || ' ' || path_v || ' HTTP/1.1" ' ||
        CASE WHEN {sql_uniform('flip', 'id')} < 0.2 AND status_v::INT < 400 THEN broken ELSE status_v END || ' ' ||
        greatest(0, round({numeric_sql('size_v', 'size', 'lo', 'hi', 'me')})::BIGINT)::VARCHAR AS line
      FROM ip_v_t JOIN user_v_t USING (id) JOIN method_v_t USING (id) JOIN path_v_t USING (id) JOIN status_v_t USING (id) JOIN size_v_t USING (id)
        JOIN broken_t USING (id), {_SIZE}""",
)
def access_log_synthesis(spark, folder):
    models = logs.fit_fields(parsed(spark, folder), FIELDS)
    return logs.access_lines(rows(spark, folder), models, 0.2).select("id", "line")


_SYSLOG_SQL = """(SELECT printf('host%d', user_id % 7) AS hostname, event_type AS process, CASE WHEN user_id % 2 = 0 THEN printf('%d', user_id + 100) ELSE '' END AS pid,
    props AS message FROM events)"""


def top_sql(source, fields):
    long = " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value FROM {source}" for f in fields)
    return f"""(SELECT field, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS position, value, n FROM
        (SELECT field, value, count(*) AS n FROM ({long}) WHERE value IS NOT NULL GROUP BY 1, 2))"""


_SYSLOG_FIELDS = ["hostname", "process", "pid", "message"]


@query(
    "syslog_synthesis",
    f"""WITH {joined_draws([(f'{f}_v', f, sql_uniform(f, 'id'), 'true') for f in _SYSLOG_FIELDS], top=top_sql(_SYSLOG_SQL, _SYSLOG_FIELDS))}
      SELECT id, strftime(make_timestamp({ts_sql(24)}), '%b %d %H:%M:%S') || ' ' || hostname_v || ' ' || process_v || '[' ||
        CASE WHEN pid_v = '' THEN (floor({sql_uniform('pid', 'id')} * 64001)::BIGINT + 1000)::VARCHAR ELSE pid_v END || ']: ' || message_v AS line
      FROM hostname_v_t JOIN process_v_t USING (id) JOIN pid_v_t USING (id) JOIN message_v_t USING (id)""",
)
def syslog_synthesis(spark, folder):
    models = logs.fit_fields(logs.parse_syslog(syslog(spark, folder)), _SYSLOG_FIELDS)
    return logs.syslog_lines(rows(spark, folder), models).select("id", "line")


_APP_FIELDS = ["level", "component", "message"]
_APP_TOP = top_sql(APPLICATION_SQL, _APP_FIELDS)


@query(
    "application_log_synthesis",
    f"""WITH {joined_draws([*[(f'{f}_v', f, sql_uniform(f, 'id'), 'true') for f in _APP_FIELDS], ('severe', 'level', sql_uniform('severity', 'id'), "value IN ('ERROR', 'FATAL')")], top=_APP_TOP)},
      l AS (SELECT *, CASE WHEN level_v = 'WARNING' THEN 'WARN' ELSE level_v END AS w FROM level_v_t JOIN component_v_t USING (id) JOIN message_v_t USING (id) JOIN severe_t USING (id))
      SELECT id, strftime(make_timestamp({ts_sql(24)}), '%Y-%m-%d %H:%M:%S') || ' ' ||
        rpad(CASE WHEN {sql_uniform('raise', 'id')} < 0.2 AND w NOT IN ('ERROR', 'FATAL') THEN severe ELSE w END, 5, ' ') || ' [' || component_v || '] ' || message_v AS line FROM l""",
)
def application_log_synthesis(spark, folder):
    models = logs.fit_fields(logs.parse_application(application_log(spark, folder)), _APP_FIELDS)
    return logs.application_lines(rows(spark, folder), models, 0.2).select("id", "line")


@query("json_log_synthesis")
def json_log_synthesis(spark, folder):
    # parsed once, by all tasks: what follows reads the records five times
    records = cut_lineage(logs.parse_json(json_log(spark, folder, spread(table(spark, folder, "events"))), JSON_SCHEMA).select(*JSON_FIELDS))
    models = logs.fit_fields(records, JSON_FIELDS)
    return logs.json_lines(rows(spark, folder), records, JSON_FIELDS, models, 0.2).select("id", "line")


_STAMPED = "(SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || event_type || ' happened' AS message FROM events)"


@query(
    "generic_log_synthesis",
    f"""WITH {joined_draws([('message_v', 'message', sql_uniform('message', 'id'), 'true')], top=top_sql(_STAMPED, ['message']))}
      SELECT id, strftime(make_timestamp({ts_sql(24)}), '%Y-%m-%d %H:%M:%S') || substr(message_v, 21) AS line FROM message_v_t""",
)
def generic_log_synthesis(spark, folder):
    stamped = table(spark, folder, "events").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), F.col("event_type"), F.lit(" happened")).alias("line")
    )
    models = logs.fit_fields(logs.parse_any(stamped), ["message"])
    return logs.generic_lines(rows(spark, folder), models).select("id", "line")


@query("application_parse_counts", "SELECT count(*) AS lines, count(*) AS parsed FROM events")
def application_parse_counts(spark, folder):
    return logs.parse_counts(application_log(spark, folder), APPLICATION)
