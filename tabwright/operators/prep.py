"""Filters, column roles, imputation, encoding, scaling, sampling and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import keyed
from tabwright.operators import distributions as dist
from tabwright.operators.scalars import attach
from tabwright.operators.indexing import with_global_index
from tabwright.operators.joins import fact_join
from tabwright.session import cut_lineage

MISSING = "__MISSING__"

_COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


def condition_predicate(df: DataFrame, conditions: list[dict]) -> Column | None:
    """The conjunction of the usable conditions; unknown columns, operators and uncastable values are ignored."""
    predicate = None
    for c in conditions:
        compare = _COMPARE.get(c.get("operator"))
        if c.get("column") not in df.columns or compare is None:
            continue
        kind = df.schema[c["column"]].dataType
        if isinstance(kind, T.NumericType):
            try:
                value = F.lit(float(c["value"]))
            except (TypeError, ValueError):
                continue
        elif isinstance(kind, T.StringType):
            value = F.lit(str(c["value"]))
        else:
            value = F.lit(str(c["value"])).try_cast(kind)
        part = compare(F.col(c["column"]), value)
        predicate = part if predicate is None else predicate & part
    return predicate


def apply_conditions(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """Keep the rows that meet every condition, or the whole table when none does."""
    predicate = condition_predicate(df, conditions)
    if predicate is None:
        return df
    kept = df.where(predicate)
    return df if kept.isEmpty() else kept


def short_hash(column: str, length: int = 12) -> Column:
    return F.substring(F.sha2(F.col(column).cast("string"), 256), 1, length)


def apply_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``skip`` columns go, text ``pii`` columns become short digests, the rest stays."""
    texts = set(dist.categorical_columns(df))
    hashed = {c: short_hash(c) for c, r in roles.items() if r == "pii" and c in texts}
    skipped = [c for c, r in roles.items() if r == "skip" and c in df.columns]
    return df.withColumns(hashed).drop(*skipped) if hashed else df.drop(*skipped)


def prepare_features(df: DataFrame, target: str) -> DataFrame:
    """Drop rows without a target; numeric nulls become the median, text nulls a marker."""
    kept = df.where(F.col(target).isNotNull())
    numbers = [c for c in dist.numeric_columns(kept) if c != target]
    texts = [c for c in dist.categorical_columns(kept) if c != target]
    medians = dist.quantile_map(kept, numbers, [0.5]) if numbers else {}
    fills = {c: F.coalesce(dist.numeric(c), F.lit(medians[c].get(0.5))) for c in numbers}
    fills.update({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in texts})
    return kept.withColumns(fills) if fills else kept


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values in sorted order numbered from 0."""
    values = cut_lineage(df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct())
    return with_global_index(values, ["value"], "code")


#: Codes that are broadcast at most.
BROADCAST_CODES = 10_000


def encode_labels(df: DataFrame, column: str, codes: DataFrame, output: str | None = None) -> DataFrame:
    """Replace a column by its code; a value the codes do not know gets -1."""
    output = output or f"{column}_code"
    named = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    keyed_rows = df.withColumn("_v", F.col(column).cast("string"))
    # A class may hold most rows: few codes are broadcast, of many only those of the heaviest classes.
    if codes.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES:
        joined = keyed_rows.join(F.broadcast(named), "_v", "left")
    else:
        sizes = keyed_rows.groupBy("_v").agg(F.count("*").alias("_rows"))
        joined = fact_join(keyed_rows, cut_lineage(named.join(sizes, "_v")), ["_v"], "_rows").drop("_rows")
    return joined.withColumn(output, F.coalesce("_c", F.lit(-1))).drop("_v", "_c")


def task_type(df: DataFrame, target: str) -> DataFrame:
    """One row: classification up to 20 distinct values, regression above."""
    # A stop at 21 distinct values would do; the count itself is part of the answer.
    row = df.agg(F.count_distinct(target).alias("distinct_values"))
    return row.select("distinct_values", F.when(F.col("distinct_values") <= 20, "classification").otherwise("regression").alias("task"))


def fit_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of min and max per column."""
    parts = []
    for c in columns:
        parts += [F.min(dist.numeric(c)).alias(f"min__{c}"), F.max(dist.numeric(c)).alias(f"max__{c}")]
    return df.agg(*parts)


def min_max_scale(df: DataFrame, ranges: DataFrame, columns: list[str], epsilon: float = 1e-7) -> DataFrame:
    """Scale with ranges fitted elsewhere."""
    joined = attach(df, ranges)
    scaled = {c: (dist.numeric(c) - F.col(f"min__{c}")) / (F.col(f"max__{c}") - F.col(f"min__{c}") + epsilon) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def min_max_restore(df: DataFrame, ranges: DataFrame, columns: list[str], epsilon: float = 1e-7) -> DataFrame:
    joined = attach(df, ranges)
    restored = {c: F.col(c) * (F.col(f"max__{c}") - F.col(f"min__{c}") + epsilon) + F.col(f"min__{c}") for c in columns}
    return joined.withColumns(restored).select(*df.columns)


def z_scale(df: DataFrame, original: DataFrame, columns: list[str], epsilon: float = 1e-10) -> DataFrame:
    """Centre and scale with the mean and sample deviation of the original table."""
    parts = []
    for c in columns:
        parts += [F.avg(dist.numeric(c)).alias(f"mean__{c}"), F.stddev_samp(dist.numeric(c)).alias(f"std__{c}")]
    joined = attach(df, original.agg(*parts))
    scaled = {c: (dist.numeric(c) - F.col(f"mean__{c}")) / (F.col(f"std__{c}") + epsilon) for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def fixed_sample(df: DataFrame, n: int, keys: list[str], seed: int = keyed.SEED) -> DataFrame:
    """The n rows with the smallest key digests: the same rows on every run, found as a distributed top-n."""
    order = keyed.digest("sample", *[F.col(k) for k in keys], seed=seed)
    return df.withColumn("_order", order).orderBy("_order", *keys).limit(n).drop("_order")


def split_by_hash(df: DataFrame, keys: list[str], share: float = 0.7, seed: int = keyed.SEED) -> DataFrame:
    """Add ``is_train``: a repeatable shuffled split without a shuffle."""
    return df.withColumn("is_train", keyed.uniform("split", *[F.col(k) for k in keys], seed=seed) < share)


def split_by_order(df: DataFrame, order: list[str], share: float = 0.7) -> DataFrame:
    """Add ``is_train``: the first share of the rows in order."""
    indexed = with_global_index(df, order, "_index")
    total = df.agg(F.count("*").alias("_total"))
    joined = attach(indexed, total)
    return joined.withColumn("is_train", F.col("_index") < F.floor(F.lit(share) * F.col("_total"))).drop("_index", "_total")


def align_schema(df: DataFrame, like: DataFrame) -> DataFrame:
    """The original's columns in its order and types; unknown columns go, values that do not fit become null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in like.schema.fields if f.name in df.columns])
