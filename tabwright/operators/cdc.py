"""Change events: made from tables, diffed from snapshots, formatted, summarised, replayed.

An event row is (operation, table, ts, seq, before, after, primary_keys); the images are typed structs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import keyed
from tabwright.operators.indexing import with_hashed_index
from tabwright.operators.scalars import attach

# SQL type names and the kind of value they take.
SQL_KINDS = {
    "INT": "integer", "INTEGER": "integer", "BIGINT": "integer", "SMALLINT": "integer", "SERIAL": "integer",
    "BIGSERIAL": "integer", "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "NVARCHAR": "string",
    "BOOLEAN": "boolean", "BOOL": "boolean", "FLOAT": "float", "DOUBLE": "float", "DECIMAL": "float",
    "NUMERIC": "float", "REAL": "float", "DATE": "date", "TIMESTAMP": "timestamp", "DATETIME": "timestamp", "UUID": "uuid",
}
CODES = {"INSERT": "c", "UPDATE": "u", "DELETE": "d"}


def image(columns: list[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in columns])


def envelope(df: DataFrame, operation: Column, table: str, ts: Column, seq: Column, before: Column, after: Column, keys: list[str]) -> DataFrame:
    return df.select(
        operation.alias("operation"), F.lit(table).alias("table"), ts.alias("ts"), seq.alias("seq"),
        before.alias("before"), after.alias("after"), F.array(*[F.lit(k) for k in keys]).alias("primary_keys"),
    )


# --- making events ----------------------------------------------------------


def change_schedule(
    df: DataFrame, keys: list[str], start, hours: int, insert: float = 0.5, update: float = 0.35, delete: float = 0.15, seed: int = keyed.SEED
) -> DataFrame:
    """(keys, version, operation, ts): each row's life as events.

    Every key starts with an insert; updates and at most one delete follow it in time.  The three ratios are
    normalised, and an insert happens once per row, so rows get update/insert updates on average.
    """
    ids = [F.col(k) for k in keys]
    per_row = update / insert
    whole = int(per_row)
    updates = F.lit(whole) + (keyed.uniform("cdc-u", *ids, seed=seed) < (per_row - whole)).cast("int")
    deletes = (keyed.uniform("cdc-d", *ids, seed=seed) < min(1.0, delete / insert)).cast("int")
    plan = df.select(*keys, updates.alias("_u"), deletes.alias("_d"), keyed.uniform("cdc-t", *ids, seed=seed).alias("_f"))
    steps = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("_u") + F.col("_d"))).alias("version"))
    operation = F.when(F.col("version") == 0, "INSERT").when(F.col("version") <= F.col("_u"), "UPDATE").otherwise("DELETE")
    # The insert falls in the first half; later steps share the rest of the range evenly.
    share = F.col("_f") / 2 + (F.lit(1.0) - F.col("_f") / 2) * F.col("version") / (F.col("_u") + F.col("_d") + 1)
    begin = start if isinstance(start, Column) else F.lit(start).cast("timestamp")
    micros = F.unix_micros(begin) + F.floor(share * F.lit(hours * 3_600_000_000)).cast("bigint")
    return steps.select(*keys, "version", operation.alias("operation"), F.timestamp_micros(micros).alias("ts"))


def changed_column(position: int, width: int, *ids: Column, seed: int = keyed.SEED) -> Column:
    """Is this column among the one to three that a version changes?  They are neighbours on the circle of columns."""
    first = keyed.index_below(width, "cdc-first", *ids, seed=seed)
    count = keyed.index_below(min(3, width), "cdc-count", *ids, seed=seed) + 1
    return F.pmod(F.lit(position) - first, F.lit(width)) < count


def change_events(
    df: DataFrame, table: str, keys: list[str], start, hours: int, frozen: list[str] = (), seed: int = keyed.SEED, **ratios
) -> DataFrame:
    """Change events of a table's rows, with update images that take one to three values from a donor row.

    Donors are found by a hashed row number, an even equi-join.  Images chain per key (a handful of versions).
    """
    columns = df.columns
    free = [c for c in columns if c not in keys and c not in frozen]
    schedule = change_schedule(df, keys, start, hours, seed=seed, **ratios)
    indexed = with_hashed_index(df, keys, "_i")
    total = df.agg(F.count("*").alias("_n"))
    ids = [*[F.col(k) for k in keys], F.col("version")]
    steps = attach(schedule, total).withColumn("_donor", keyed.index_below(F.col("_n"), "cdc-donor", *ids, seed=seed))
    donors = indexed.select(F.col("_i").alias("_donor"), *[F.col(c).alias(f"_new__{c}") for c in free])
    rows = steps.join(df, keys).join(donors, "_donor")
    w = W.partitionBy(*keys).orderBy("version").rowsBetween(W.unboundedPreceding, 0)
    state = {}
    for i, c in enumerate(free):
        hit = (F.col("operation") == "UPDATE") & changed_column(i, len(free), *ids, seed=seed)
        latest = F.last(F.when(hit, F.struct(F.col(f"_new__{c}").alias("v"))), ignorenulls=True).over(w)
        state[f"_now__{c}"] = F.when(latest.isNotNull(), latest["v"]).otherwise(F.col(c))
    now = rows.withColumns(state)
    after = F.struct(*[(F.col(f"_now__{c}") if c in free else F.col(c)).alias(c) for c in columns])
    imaged = now.withColumn("_after", after)
    imaged = imaged.withColumn("_before", F.lag("_after").over(W.partitionBy(*keys).orderBy("version")))
    return envelope(
        imaged, F.col("operation"), table, F.col("ts"), F.col("version").cast("bigint"), F.col("_before"),
        F.when(F.col("operation") != "DELETE", F.col("_after")), keys,
    )


def ordered_events(events: DataFrame) -> DataFrame:
    """Global order by time; ``orderBy`` range-partitions, so no task sorts everything."""
    keys = [F.coalesce(F.col(f"after.{c}"), F.col(f"before.{c}")) for c in events.schema["after"].dataType.names[:1]]
    return events.orderBy("ts", "seq", "table", *keys)


def fallback_value(sql_type: str, column: str, *ids: Column, now="2024-01-01 00:00:00", seed: int = keyed.SEED) -> Column:
    """A typed value for a column of the given SQL type."""
    kind = SQL_KINDS.get(sql_type.split("(")[0].strip().upper(), "string")
    tag = f"value:{column}"
    base = F.lit(now).cast("timestamp")
    if kind == "integer":
        return keyed.index_below(10_000, tag, *ids, seed=seed) + 1
    if kind == "float":
        return F.round(keyed.uniform(tag, *ids, seed=seed) * 1000, 2)
    if kind == "boolean":
        return keyed.uniform(tag, *ids, seed=seed) < 0.5
    if kind == "date":
        return F.date_sub(base.cast("date"), keyed.index_below(366, tag, *ids, seed=seed).cast("int"))
    if kind == "timestamp":
        seconds = keyed.index_below(91 * 86_400, tag, *ids, seed=seed)
        return F.timestamp_micros(F.unix_micros(base) - seconds * 1_000_000)
    if kind == "uuid":
        h = keyed.digest(tag, *ids, seed=seed)
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat(F.lit(f"{column}_"), (keyed.index_below(999, tag, *ids, seed=seed) + 1).cast("string"))


def new_rows(
    rows: DataFrame, schema: list[dict], first_key: int = 1, parents: dict[str, tuple[DataFrame, str]] | None = None, seed: int = keyed.SEED
) -> DataFrame:
    """Rows for ids 0.. in ``rows``: sequential primary key, foreign keys of existing parents, typed values.

    ``schema`` lists {name, data_type, primary_key}; ``parents`` maps a column to (parent table, parent column).
    A foreign key is the parent at a hashed position of the parent index: an even equi-join.
    """
    parents = parents or {}
    key = F.col("id")
    out = rows.select("id")
    for column, (parent, parent_column) in parents.items():
        indexed = with_hashed_index(parent.select(F.col(parent_column).alias(column)).distinct(), [column], "_at")
        sized = attach(out, indexed.agg(F.count("*").alias("_n")))
        out = sized.withColumn("_at", keyed.index_below(F.col("_n"), f"fk:{column}", key, seed=seed)).drop("_n").join(indexed, "_at").drop("_at")
    cells = []
    for c in schema:
        if c.get("primary_key"):
            cells.append((key + first_key).alias(c["name"]))
        elif c["name"] in parents:
            cells.append(F.col(c["name"]))
        else:
            cells.append(fallback_value(c["data_type"], c["name"], key, seed=seed).alias(c["name"]))
    return out.select(*cells)


# --- diff and replay --------------------------------------------------------


def snapshot_diff(old: DataFrame, new: DataFrame, table: str, keys: list[str], ts, columns: list[str] | None = None) -> DataFrame:
    """Events that turn one version of a table into the next: one full outer join on the key."""
    columns = columns or old.columns
    a = old.select(*keys, image(columns).alias("before"))
    b = new.select(*keys, image(columns).alias("after"))
    joined = a.join(b, keys, "full")
    operation = (
        F.when(F.col("before").isNull(), "INSERT")
        .when(F.col("after").isNull(), "DELETE")
        .when(~F.col("before").eqNullSafe(F.col("after")), "UPDATE")
    )
    moment = ts if isinstance(ts, Column) else F.lit(ts).cast("timestamp")
    changed = joined.withColumn("_op", operation).where(F.col("_op").isNotNull())
    return envelope(changed, F.col("_op"), table, moment, F.lit(0).cast("bigint"), F.col("before"), F.col("after"), keys)


def event_key(events: DataFrame, keys: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in keys]


def replay(events: DataFrame, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """The table after all events: the last image per key by (ts, seq), deletes dropped.

    ``max_by`` combines map-side, so a key with a third of all events costs one row per task.
    """
    columns = events.schema["after"].dataType.names
    last = events.select(*event_key(events, keys), "after", "ts", "seq").groupBy(*keys).agg(F.max_by(F.struct("after"), F.struct("ts", "seq")).alias("_l"))
    touched = last.where(F.col("_l.after").isNotNull()).select("_l.after.*")
    if base is None:
        return touched.select(*columns)
    return base.select(*columns).join(last.select(*keys), keys, "left_anti").select(*columns).unionByName(touched.select(*columns))


# --- formats ----------------------------------------------------------------


def debezium(events: DataFrame, database: str = "tabwright", connector: str = "tabwright-cdc", version: str = "2.4.0") -> DataFrame:
    """(ts, seq, value): one JSON envelope per event."""
    millis = F.unix_millis("ts")
    code = F.lit("c")
    for op, c in CODES.items():
        code = F.when(F.col("operation") == op, F.lit(c)).otherwise(code)
    source = F.struct(
        F.lit(version).alias("version"), F.lit(connector).alias("connector"), F.lit(database).alias("name"),
        millis.alias("ts_ms"), F.lit(database + "_db").alias("db"), F.col("table"),
    )
    payload = F.struct("before", "after", source.alias("source"), code.alias("op"), millis.alias("ts_ms"))
    schema = F.struct(F.lit("struct").alias("type"), F.concat("table", F.lit(".Envelope")).alias("name"))
    return events.select("ts", "seq", F.to_json(F.struct(schema.alias("schema"), payload.alias("payload")), {"ignoreNullFields": "false"}).alias("value"))


def sql_literal(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "TRUE").otherwise("FALSE")
    elif isinstance(kind, T.NumericType):
        text = value.cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit("'"), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.isNull(), "NULL").otherwise(text)


def insert_statement(df_schema: T.StructType, table: Column, prefix: str = "") -> Column:
    values = [sql_literal(F.col(prefix + f.name), f.dataType) for f in df_schema.fields]
    names = ", ".join(f.name for f in df_schema.fields)
    return F.concat(F.lit("INSERT INTO "), table, F.lit(f" ({names}) VALUES ("), F.concat_ws(", ", *values), F.lit(");"))


def sql_statements(events: DataFrame, keys: list[str]) -> DataFrame:
    """(ts, seq, statement); updates without a settable column and statements without a key are left out."""
    schema = events.schema["after"].dataType

    def assign(side, fields, joint):
        return F.concat_ws(joint, *[F.concat(F.lit(f"{f.name} = "), sql_literal(F.col(f"{side}.{f.name}"), f.dataType)) for f in fields])

    key_fields = [f for f in schema.fields if f.name in keys]
    free = [f for f in schema.fields if f.name not in keys]
    where = assign("before", key_fields, " AND ") if key_fields else F.lit(None)
    insert = insert_statement(schema, F.col("table"), "after.")
    update = F.concat(F.lit("UPDATE "), F.col("table"), F.lit(" SET "), assign("after", free, ", "), F.lit(" WHERE "), where, F.lit(";"))
    delete = F.concat(F.lit("DELETE FROM "), F.col("table"), F.lit(" WHERE "), where, F.lit(";"))
    statement = F.when((F.col("operation") == "INSERT") & F.col("after").isNotNull(), insert)
    if key_fields and free:
        statement = statement.when((F.col("operation") == "UPDATE") & F.col("after").isNotNull() & F.col("before").isNotNull(), update)
    if key_fields:
        statement = statement.when((F.col("operation") == "DELETE") & F.col("before").isNotNull(), delete)
    return events.select("ts", "seq", statement.alias("statement")).where(F.col("statement").isNotNull())


def csv_rows(events: DataFrame) -> DataFrame:
    """timestamp, operation, table and the after (or before) image as JSON."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    data = F.to_json(F.coalesce("after", "before"), {"ignoreNullFields": "false"})
    return events.select(stamp.alias("timestamp"), "operation", "table", data.alias("data"))


# --- summaries --------------------------------------------------------------


def event_counts(events: DataFrame) -> DataFrame:
    """(table, operation, events) with subtotals per table and the grand total in one pass (nulls mark totals)."""
    return events.rollup("table", "operation").agg(F.count("*").alias("events"))


def event_summary(events: DataFrame) -> DataFrame:
    """One row: all events, each operation, tables affected."""
    return events.agg(
        F.count("*").alias("total_events"),
        *[F.count_if(F.col("operation") == op).alias(name) for op, name in (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))],
        F.count_distinct("table").alias("tables_affected"),
    )


def first_events(events: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """All events, or the first n in time order."""
    named = events.select("ts", "seq", "operation", "table", *event_key(events, keys))
    return named if n is None else named.orderBy("ts", "seq", "table", *keys).limit(n)


def union_events(parts: list[DataFrame]) -> DataFrame:
    """Events of several tables as one stream: images become JSON because their types differ."""
    text = [
        p.select("operation", "table", "ts", "seq", F.to_json("before").alias("before"), F.to_json("after").alias("after"), "primary_keys")
        for p in parts
    ]
    return reduce(DataFrame.unionByName, text)
