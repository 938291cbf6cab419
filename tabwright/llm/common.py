"""Helpers that the operators of this subpackage share: stored tables, joins on hot keys, row numbers, running totals."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.plans.scratch import scratch_path
from tabwright.session import shuffle_partitions

#: A key is hot if it holds more than one row in so many; there are fewer such keys than this number.
HOT_SHARE = 1000
#: Hot rows are spread over so many join keys of their own.
SPREAD = 4096


_CACHES: dict[str, Callable[[], None]] = {}


def claim_worker(name: str, clear: Callable[[], None] | None = None) -> None:
    """A Python worker serves tasks of several operators; what one keeps between its tasks goes when another begins."""
    for other, empty in _CACHES.items():
        if other != name:
            empty()
    if any(other != name for other in _CACHES) or clear is None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        _return_free_pages()
    if clear is not None:
        _CACHES[name] = clear


def _return_free_pages() -> None:
    """What was freed goes back to the system, where the C library can do so; fragments of caches would stay otherwise."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its pages
        pass


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, lost executors cost nothing before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_id() -> Column:
    """Unique per row; stays fixed only once the table is stored."""
    return F.monotonically_increasing_id()


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of rows with one fact row per key, however many rows a key holds.

    `count` is the column of facts with a key's number of rows, `total` the number of all rows. Keys with more than
    total / HOT_SHARE rows are fewer than HOT_SHARE, so their facts are broadcast; other keys are shuffled. Rows that found
    their hot facts, and rows with a null key, take part in the shuffle under spread keys that match nothing.
    """
    values = [c for c in facts.columns if c not in keys]
    hot = facts.filter(F.col(count) * HOT_SHARE > total)
    cold = facts.filter(F.col(count) * HOT_SHARE <= total)
    never = F.pmod(F.hash(*keys), F.lit(1))  # always 0; a literal would be folded away, and the rows dealt by the keys alone
    hot = hot.select(*keys, F.struct(*values).alias("_hot"), F.lit(True).alias("_is_hot"))
    cold = cold.select(*keys, F.struct(*values).alias("_cold"), never.alias("_spread"))
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    spread = (F.pmod(F.hash(row_id()), F.lit(SPREAD)) + 1).cast("int")
    out = rows.join(F.broadcast(hot), keys, "left")
    out = out.withColumn("_spread", F.when(F.col("_is_hot") | some_null, spread).otherwise(F.lit(0)))
    out = out.join(cold, [*keys, "_spread"], "left")
    found = [F.when(F.col("_is_hot"), F.col(f"_hot.{v}")).otherwise(F.col(f"_cold.{v}")).alias(v) for v in values]
    return out.select(*[F.col(c) for c in rows.columns], *found)


def place(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-sorted rows with `_part`, the number of their range."""
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())


def number_rows(df: DataFrame, order: list[Column], name: str, number: str) -> DataFrame:
    """Global row numbers from 0 without gaps, in the given order; equal rows get any order among themselves.

    Ranges are sorted on their own and stored with each row's place in its range; the ranges' sizes, one row per range,
    give the starts. No task sees more than one range.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = store(place(df, order).withColumn("_at", at), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.join(F.broadcast(starts), "_part")
    return out.select(*df.columns, (F.col("_start") + F.col("_at")).alias(number))


def running_total(df: DataFrame, order: list[Column], value: str, name: str, total: str, group: str | None = None) -> DataFrame:
    """Running sum of a long column in the given order, this row included; per group if one is named.

    The order must begin with the group, a long that is not null. Each range adds up its own rows in batches; only a range's
    first group can have begun before it, so the totals to add are one row per range.
    """
    own = total + "_in_range"
    grouped = df.withColumn("_group", F.col(group) if group else F.lit(0).cast("long"))
    placed = place(grouped, order)
    schema = T.StructType([*placed.schema.fields, T.StructField(own, T.LongType())])

    def add_up(batches):
        last, carry = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = batch.column("_group").to_numpy(zero_copy_only=False)
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False))
            first = np.concatenate([[True], groups[1:] != groups[:-1]])
            starts = np.flatnonzero(first)
            base = np.where(starts > 0, sums[starts - 1], 0)
            if last is not None and groups[0] == last:
                base[0] -= carry
            sums = sums - np.repeat(base, np.diff(np.append(starts, len(groups))))
            last, carry = groups[-1], sums[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, own])

    placed = store(placed.mapInArrow(add_up, schema), name)
    ends = placed.groupBy("_part", "_group").agg(F.max(own).alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", "_group", F.sum("_sum").over(before).alias("_before")).filter("_before > 0")
    out = placed.join(F.broadcast(starts), ["_part", "_group"], "left")
    return out.select(*df.columns, (F.col(own) + F.coalesce("_before", F.lit(0))).alias(total))


def identity(id_column: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """What names a row across scans: its id, null or not, and a hash of its text."""
    named = F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit("null"))
    return {"_key": named, "_text_hash": F.xxhash64(text_or_empty(text))}


def apply_decisions(docs: DataFrame, decided: DataFrame, copies: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as an operator decided.

    `decided` has one row per row of docs, with its id and `_text_hash`; `copies` says how often that row stays. Rows alike in
    id and text cannot be told apart between scans: they share their copies, and one of them stands for all.
    """
    named = decided.select(identity(id_column)["_key"].alias("_key"), "_text_hash", copies.cast("long").alias("_copies"))
    facts = named.groupBy("_key", "_text_hash").agg(F.sum("_copies").alias("_copies"), F.count("*").alias("_alike"))
    facts = store(facts, "decisions")
    total = facts.agg(F.coalesce(F.sum("_alike"), F.lit(0))).first()[0]
    whole = docs.select(F.struct(*docs.columns).alias("_all"), *[c.alias(n) for n, c in identity(id_column, text).items()])
    kept = hot_join(whole, facts, ["_key", "_text_hash"], "_alike", total).filter("_copies > 0")
    alike = kept.filter("_alike > 1").groupBy("_key", "_text_hash")
    alike = alike.agg(F.first("_all").alias("_all"), F.first("_copies").alias("_copies")).select("_all", "_copies")
    out = kept.filter("_alike = 1").select("_all", "_copies").unionByName(alike)
    return out.select("_all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_all.*")
