"""Column profiles: types, null share, distinct counts, likely targets, time-series signs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage, shuffle_partitions

# Words in a column name that hint at time.
TEMPORAL_KEYWORDS = [
    "time", "date", "year", "month", "day", "hour", "minute", "second", "timestamp", "period", "sequence",
]


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, T.IntegralType):
        return "integer"
    if isinstance(field.dataType, T.NumericType):
        return "float"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column_name, distinct_values).  Exact by default: one deduplicating shuffle for all columns together.

    Long texts are deduplicated by digest so that a whole document never travels just to be counted.
    """
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"d__{c}") for c in columns])
        entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d__{c}").alias("distinct_values")) for c in columns])
        return row.select(F.inline(entries))

    def short(c):
        text = F.col(c).cast("string")
        return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)

    rows = df.select(*[short(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    unique = rows.where(F.col("value").isNotNull()).distinct()
    return unique.groupBy("column_name").agg(F.count("*").alias("distinct_values"))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct values, profiler type and the numeric/categorical tag."""
    columns = df.columns
    nulls = df.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n__{c}") for c in columns])
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(_kind(f)).alias("kind"),
                F.col("rows"), F.col(f"n__{f.name}").alias("nulls"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    base = nulls.select(F.inline(entries))
    joined = base.join(F.broadcast(distinct_counts(df, columns, approximate)), "column_name", "left")
    distinct = F.coalesce("distinct_values", F.lit(0))
    column_type = (
        F.when(F.col("kind") != "string", F.col("kind"))
        .when((distinct < 20) & (F.col("rows") > 100), "categorical")
        .otherwise("text")
    )
    tag = F.when(F.col("kind").isin("integer", "float", "boolean"), "numeric").otherwise("categorical")
    return joined.select(
        "position",
        "column_name",
        column_type.alias("column_type"),
        tag.alias("tag"),
        "rows",
        "nulls",
        F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("rows")), F.lit(0.0)).alias("null_percentage"),
        distinct.cast("bigint").alias("distinct_values"),
    )


def target_candidates(profiled: DataFrame) -> DataFrame:
    """Columns worth predicting, ranked: (task, position, column_name, column_type, distinct_values, null_percentage)."""
    usable = (F.col("null_percentage") <= 30) & (
        F.coalesce(F.try_divide(F.col("distinct_values"), F.col("rows")), F.lit(0.0)) <= 0.95
    )
    kind, distinct = F.col("column_type"), F.col("distinct_values")
    classes = ((kind == "categorical") | (kind.isin("integer", "boolean") & (distinct <= 20))) & distinct.between(2, 20)
    task = F.when(classes, "classification").when(kind.isin("float", "integer") & (distinct > 20), "regression")
    rows = profiled.where(usable).withColumn("task", task).where(F.col("task").isNotNull())
    cardinality = F.when(F.col("task") == "classification", -distinct).otherwise(0)
    # One row per column of the table.
    order = W.partitionBy("task").orderBy(F.round("null_percentage", 2), cardinality, F.col("position"))
    return rows.withColumn("rank", F.row_number().over(order)).select(
        "task", "rank", "column_name", "column_type", "distinct_values", "null_percentage"
    )


def datetime_columns(df: DataFrame) -> DataFrame:
    """(column_name, is_datetime): timestamp and date columns, and text columns in which every value parses."""
    checks, names = [], []
    for f in df.schema.fields:
        kind = _kind(f)
        if kind == "datetime":
            checks.append(F.lit(True).alias(f.name))
        elif kind == "string":
            parsed = F.col(f.name).try_cast("timestamp").isNotNull()
            checks.append(F.coalesce(F.bool_and(F.when(F.col(f.name).isNotNull(), parsed)), F.lit(False)).alias(f.name))
        else:
            checks.append(F.lit(False).alias(f.name))
        names.append(f.name)
    row = df.agg(F.count("*").alias("_rows"), *checks)
    entries = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("is_datetime")) for n in names])
    return row.select(F.inline(entries))


def is_ordered(df: DataFrame, order_column: str, value_column: str, keys: list[str] | None = None) -> DataFrame:
    """One row, ``ordered``: does the value never fall while the order column rises?

    The check compares neighbours inside ranges of the order column and then range against range, so no
    single task sees the whole table.
    """
    from tabwright.operators.indexing import range_bucket

    kept = df.select(F.col(order_column).alias("_o"), F.col(value_column).alias("_v")).where("_o IS NOT NULL AND _v IS NOT NULL")
    ranged = kept.withColumn("_range", range_bucket(kept, ["_o"], None))
    w = W.partitionBy("_range").orderBy("_o", "_v")
    steps = ranged.withColumn("_fell", F.col("_v") < F.lag("_v").over(w))
    per_range = steps.groupBy("_range").agg(
        F.coalesce(F.bool_or("_fell"), F.lit(False)).alias("fell"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )
    # One row per range from here on.
    across = per_range.withColumn("crossed", F.col("low") < F.lag("high").over(W.orderBy("_range")))
    return across.agg((~F.coalesce(F.bool_or(F.col("fell") | F.coalesce("crossed", F.lit(False))), F.lit(False))).alias("ordered"))


def series_score(df: DataFrame, order_column: str | None = None, value_column: str | None = None) -> DataFrame:
    """One row saying whether a table looks like a time series and how sure that is."""
    hints = [c for c in df.columns if any(k in c.lower() for k in TEMPORAL_KEYWORDS)]
    found = datetime_columns(df).agg(F.count(F.when(F.col("is_datetime"), 1)).alias("datetime_columns"))
    if order_column and value_column:
        ordered = is_ordered(df, order_column, value_column)
    else:
        ordered = df.sparkSession.range(1).select(F.lit(False).alias("ordered"))
    score = (
        F.when(F.col("datetime_columns") > 0, 0.5).otherwise(0.0)
        + F.lit(0.1 * len(hints))
        + F.when(F.col("ordered"), 0.2).otherwise(0.0)
    )
    both = attach(found, ordered).withColumn("score", F.least(F.lit(1.0), score))
    return both.select(
        "datetime_columns",
        F.lit(len(hints)).cast("bigint").alias("temporal_features"),
        "ordered",
        "score",
        ((F.col("datetime_columns") > 0) | (F.col("score") > 0.3)).alias("is_time_series"),
    )


def semantic_types(profiled: DataFrame) -> DataFrame:
    """Column roles: numbers stay numbers whatever the name says; nearly unique text is an id."""
    ratio = F.coalesce(F.try_divide(F.col("distinct_values"), F.col("rows")), F.lit(0.0))
    role = (
        F.when(F.col("column_type").isin("integer", "float"), "numerical")
        .when(F.col("column_type") == "datetime", "datetime")
        .when(F.col("column_type") == "boolean", "boolean")
        .when(ratio > 0.95, "id")
        .otherwise("categorical")
    )
    return profiled.select("position", "column_name", "column_type", role.alias("semantic_type"))


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of a set of tables with the numeric / datetime / categorical tag of each column."""
    parts = []
    for name, df in tables.items():
        tag = (
            F.when(F.col("column_type") == "datetime", "datetime")
            .when(F.col("tag") == "numeric", "numeric")
            .otherwise("categorical")
        )
        parts.append(
            profile(df).select(
                F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("columns"),
                "column_name", "rows", "distinct_values", tag.alias("tag"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def sampling_step(df: DataFrame, time_column: str, first: int | None = None) -> DataFrame:
    """Seconds between rows, from all distinct timestamps or the earliest so many; one day where they do not agree on one step.

    Gaps inside ranges of the times are taken range by range; those between ranges from one row per range.
    """
    times = df.select(F.unix_micros(F.col(time_column).cast("timestamp")).alias("ts")).where("ts IS NOT NULL").distinct()
    if first is not None:
        times = times.orderBy("ts").limit(first)
    times = cut_lineage(times)
    ranged = times.repartitionByRange(shuffle_partitions(df.sparkSession), "ts").withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    inside = ranged.select((F.col("ts") - F.lag("ts").over(W.partitionBy("_range").orderBy("ts"))).alias("gap"))
    ends = ranged.groupBy("_range").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))  # one row per range
    between = ends.select((F.col("_from") - F.lag("_to").over(W.orderBy("_range"))).alias("gap"))
    gaps = inside.unionByName(between).where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("_n"))
    return gaps.agg(
        F.when(F.count("*") == 1, F.max("gap") / 1e6).otherwise(86400.0).alias("step_seconds"),
        F.count("*").alias("distinct_steps"),
    )
