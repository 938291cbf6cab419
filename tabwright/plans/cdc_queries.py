"""Change events of all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import cdc
from tabwright.plans.registry import query, sql_digest, sql_index, sql_uniform, table

KEYS = ["o_orderkey"]
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
TS = "2024-03-01 12:00:00"


def versions(spark, folder):
    """Orders and their next version: some prices raised, some rows gone, some rows new."""
    old = table(spark, folder, "orders").select(*COLUMNS)
    key = F.col("o_orderkey")
    kept = old.where(key % 11 != 4).withColumn("o_totalprice", F.when(key % 7 == 0, F.round(F.col("o_totalprice") + 1, 2)).otherwise(F.col("o_totalprice")))
    fresh = old.where(key % 13 == 2).withColumns({"o_orderkey": key + 10_000_000, "o_orderstatus": F.lit("it's new")})
    return old, kept.unionByName(fresh)


OLD = f"(SELECT {', '.join(COLUMNS)} FROM orders)"
NEW = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice, o_orderpriority
    FROM orders WHERE o_orderkey % 11 <> 4 UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'it''s new', o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 13 = 2)"""
DIFF = f"""(SELECT CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
    {', '.join(f'a.{c} AS b_{c}, b.{c} AS a_{c}' for c in COLUMNS)}
    FROM {OLD} a FULL JOIN {NEW} b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice)"""


def diff(spark, folder):
    return cdc.snapshot_diff(*versions(spark, folder), "orders", KEYS, TS, COLUMNS)


@query("snapshot_diff", f"SELECT operation, coalesce(a_o_orderkey, b_o_orderkey) AS o_orderkey, b_o_totalprice AS price_before, a_o_totalprice AS price_after, 'o_orderkey' AS primary_key FROM {DIFF}")
def snapshot_diff(spark, folder):
    events = diff(spark, folder)
    return events.select("operation", *cdc.event_key(events, KEYS), F.col("before.o_totalprice").alias("price_before"), F.col("after.o_totalprice").alias("price_after"), F.array_join("primary_keys", ",").alias("primary_key"))


@query("replayed_table", f"SELECT * FROM {NEW}")
def replayed_table(spark, folder):
    old, _ = versions(spark, folder)
    return cdc.replay(diff(spark, folder), KEYS, old)


def _json(prefix):
    fields = ", ".join(f"{c} := {prefix}{c}" for c in COLUMNS)
    return f"to_json(struct_pack({fields}))"


_MS = "epoch_ms(TIMESTAMP '2024-03-01 12:00:00')"


@query(
    "debezium_events",
    f"""SELECT '{{"schema":{{"type":"struct","name":"orders.Envelope"}},"payload":{{"before":' || CASE WHEN operation = 'INSERT' THEN 'null' ELSE {_json('b_')}::VARCHAR END ||
        ',"after":' || CASE WHEN operation = 'DELETE' THEN 'null' ELSE {_json('a_')}::VARCHAR END || ',"source":{{"version":"2.4.0","connector":"tabwright-cdc","name":"tabwright","ts_ms":' || {_MS} ||
        ',"db":"tabwright_db","table":"orders"}},"op":"' || CASE operation WHEN 'INSERT' THEN 'c' WHEN 'UPDATE' THEN 'u' ELSE 'd' END || '","ts_ms":' || {_MS} || '}}}}' AS value FROM {DIFF}""",
)
def debezium_events(spark, folder):
    return cdc.debezium(diff(spark, folder)).select("value")


def _lit(prefix, c):
    return f"{prefix}{c}::VARCHAR" if c in ("o_orderkey", "o_custkey", "o_totalprice") else f"'''' || replace({prefix}{c}, '''', '''''') || ''''"


@query(
    "sql_statements",
    f"""SELECT CASE operation WHEN 'INSERT' THEN 'INSERT INTO orders ({', '.join(COLUMNS)}) VALUES (' || {" || ', ' || ".join(_lit('a_', c) for c in COLUMNS)} || ');'
        WHEN 'UPDATE' THEN 'UPDATE orders SET ' || {" || ', ' || ".join(f"'{c} = ' || " + _lit('a_', c) for c in COLUMNS[1:])} || ' WHERE o_orderkey = ' || b_o_orderkey || ';'
        ELSE 'DELETE FROM orders WHERE o_orderkey = ' || b_o_orderkey || ';' END AS statement FROM {DIFF}""",
)
def sql_statements(spark, folder):
    return cdc.sql_statements(diff(spark, folder), KEYS).select("statement")


@query(
    "cdc_csv_rows",
    f"""SELECT '2024-03-01T12:00:00Z' AS timestamp, operation, 'orders' AS "table", CASE WHEN operation = 'DELETE' THEN {_json('b_')} ELSE {_json('a_')} END::VARCHAR AS data FROM {DIFF}""",
)
def cdc_csv_rows(spark, folder):
    return cdc.csv_rows(diff(spark, folder))


# --- generated workload -----------------------------------------------------

START = "2024-01-01 00:00:00"
HOURS = 24
_PER = 0.35 / 0.5


def schedule_sql():
    d = "CASE WHEN " + sql_uniform("cdc-d", "o_orderkey") + f" < {0.15 / 0.5} THEN 1 ELSE 0 END"
    u = "CASE WHEN " + sql_uniform("cdc-u", "o_orderkey") + f" < {_PER} THEN 1 ELSE 0 END"
    return f"""(SELECT o_orderkey, version::INTEGER AS version, CASE WHEN version = 0 THEN 'INSERT' WHEN version <= u THEN 'UPDATE' ELSE 'DELETE' END AS operation,
      epoch_us(TIMESTAMP '{START}') + floor((f / 2 + (1::DOUBLE - f / 2) * version / (u + d + 1)) * {HOURS * 3_600_000_000})::BIGINT AS micros
      FROM (SELECT *, unnest(range(0, u + d + 1)) AS version FROM (SELECT o_orderkey, {u} AS u, {d} AS d, {sql_uniform('cdc-t', 'o_orderkey')} AS f FROM orders)))"""


@query("change_schedule", f"SELECT * FROM {schedule_sql()}")
def change_schedule(spark, folder):
    s = cdc.change_schedule(table(spark, folder, "orders"), KEYS, START, HOURS)
    return s.select("o_orderkey", "version", "operation", F.unix_micros("ts").alias("micros"))


_FREE = [c for c in COLUMNS if c not in (*KEYS, "o_custkey")]


def _events_sql() -> str:
    """Images of every version: the columns a version changes come from a donor row and stay until changed again."""
    w = len(_FREE)
    first, count = sql_index(str(w), "cdc-first", "o_orderkey", "version"), sql_index(str(min(3, w)), "cdc-count", "o_orderkey", "version")
    hits = ", ".join(f"CASE WHEN operation = 'UPDATE' AND (({i} - a) % {w} + {w}) % {w} < b THEN d.{c} END AS hit_{c}" for i, c in enumerate(_FREE))
    own = ", ".join(f"o.{c}" for c in ["o_custkey", *_FREE])
    now = ", ".join(f"coalesce(last_value(hit_{c} IGNORE NULLS) OVER w, {c}) AS now_{c}" for c in _FREE)
    seen = ", ".join(
        [f"CASE WHEN operation <> 'DELETE' THEN now_{c} END AS after_{c}, lag(now_{c}) OVER w AS before_{c}" for c in _FREE]
        + ["CASE WHEN operation <> 'DELETE' THEN o_custkey END AS after_o_custkey, lag(o_custkey) OVER w AS before_o_custkey"]
    )
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY substr(sha256(o_orderkey::VARCHAR), 1, 3), o_orderkey) - 1 AS spot FROM orders),
      s AS (SELECT *, {sql_index('(SELECT count(*) FROM orders)', 'cdc-donor', 'o_orderkey', 'version')} AS spot, {first} AS a, {count} + 1 AS b FROM {schedule_sql()}),
      h AS (SELECT s.o_orderkey, version, operation, micros, {own}, {hits} FROM s JOIN orders o USING (o_orderkey) JOIN r d ON d.spot = s.spot),
      n AS (SELECT *, {now} FROM h WINDOW w AS (PARTITION BY o_orderkey ORDER BY version ROWS UNBOUNDED PRECEDING))
      SELECT operation, o_orderkey, micros, version::BIGINT AS seq, {seen} FROM n WINDOW w AS (PARTITION BY o_orderkey ORDER BY version)"""


@query("change_events", _events_sql())
def change_events(spark, folder):
    events = cdc.change_events(table(spark, folder, "orders").select(*COLUMNS), "orders", KEYS, START, HOURS, ["o_custkey"])
    images = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in COLUMNS if c not in KEYS]
    return events.select("operation", *cdc.event_key(events, KEYS), F.unix_micros("ts").alias("micros"), "seq", *images)


@query("ordered_change_events", f"SELECT operation, o_orderkey, micros FROM {schedule_sql()}")
def ordered_change_events(spark, folder):
    events = cdc.change_events(table(spark, folder, "orders").select(*COLUMNS), "orders", KEYS, START, HOURS, ["o_custkey"])
    return cdc.ordered_events(events).select(F.unix_micros("ts").alias("micros"), "operation", *cdc.event_key(events, KEYS))


def all_events(spark, folder):
    """Orders and customers as one stream of schedule rows."""
    a = cdc.change_schedule(table(spark, folder, "orders"), KEYS, START, HOURS).select(F.lit("orders").alias("table"), "operation", "ts", F.col("o_orderkey").alias("key"), "version")
    b = cdc.change_schedule(table(spark, folder, "customer"), ["c_custkey"], START, HOURS).select(F.lit("customer").alias("table"), "operation", "ts", F.col("c_custkey").alias("key"), "version")
    return a.unionByName(b)


ALL = f"""(SELECT 'orders' AS "table", operation, micros, o_orderkey AS key, version FROM {schedule_sql()}
    UNION ALL SELECT 'customer', operation, micros, c_custkey, version FROM {schedule_sql().replace('o_orderkey', 'c_custkey').replace('FROM orders', 'FROM customer')})"""


@query("event_counts", f'SELECT "table", operation, count(*) AS events FROM {ALL} GROUP BY ROLLUP ("table", operation)')
def event_counts(spark, folder):
    return cdc.event_counts(all_events(spark, folder))


@query(
    "event_summary",
    f"""SELECT count(*) AS total_events, count(*) FILTER (WHERE operation = 'INSERT') AS inserts, count(*) FILTER (WHERE operation = 'UPDATE') AS updates,
        count(*) FILTER (WHERE operation = 'DELETE') AS deletes, count(DISTINCT "table") AS tables_affected FROM {ALL}""",
)
def event_summary(spark, folder):
    return cdc.event_summary(all_events(spark, folder))


@query("first_events", f"SELECT micros, operation, o_orderkey FROM {schedule_sql()}")
def first_events(spark, folder):
    events = cdc.change_events(table(spark, folder, "orders").select(*COLUMNS), "orders", KEYS, START, HOURS, ["o_custkey"])
    return cdc.first_events(events, KEYS).select(F.unix_micros("ts").alias("micros"), "operation", "o_orderkey")


SCHEMA = [
    {"name": "order_id", "data_type": "BIGINT", "primary_key": True},
    {"name": "customer_id", "data_type": "BIGINT"},
    {"name": "amount", "data_type": "DECIMAL(10,2)"},
    {"name": "quantity", "data_type": "INT"},
    {"name": "paid", "data_type": "BOOLEAN"},
    {"name": "note", "data_type": "VARCHAR(40)"},
    {"name": "due", "data_type": "DATE"},
    {"name": "token", "data_type": "UUID"},
]
_H = sql_digest("value:token", "id")


@query(
    "new_rows_with_keys",
    f"""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY substr(sha256(c_custkey::VARCHAR), 1, 3), c_custkey) - 1 AS spot FROM customer), r AS (SELECT o_orderkey AS id FROM orders)
      SELECT id + 1 AS order_id, c_custkey AS customer_id, round({sql_uniform('value:amount', 'id')} * 1000, 2) AS amount, {sql_index('10000', 'value:quantity', 'id')} + 1 AS quantity,
        {sql_uniform('value:paid', 'id')} < 0.5 AS paid, 'note_' || ({sql_index('999', 'value:note', 'id')} + 1) AS note,
        strftime(DATE '2024-01-01' - ({sql_index('366', 'value:due', 'id')})::INTEGER, '%Y-%m-%d') AS due,
        substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-4' || substr({_H}, 14, 3) || '-8' || substr({_H}, 18, 3) || '-' || substr({_H}, 21, 12) AS token
      FROM r JOIN p ON spot = {sql_index('(SELECT count(*) FROM customer)', 'fk:customer_id', 'id')}""",
)
def new_rows_with_keys(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    made = cdc.new_rows(rows, SCHEMA, 1, {"customer_id": (table(spark, folder, "customer"), "c_custkey")})
    return made.withColumn("due", F.col("due").cast("string"))
