"""Global row numbers without a global window.

The key space is cut into ranges; every range is numbered by its own task and starts where the ranges before it end.  Ties and hot keys are spread by giving a unique order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.operators.distributions import bucket_count, bucket_of
from tabwright.session import cut_lineage, shuffle_partitions


def range_bucket(df: DataFrame, order: list[str], ranges: int | None) -> Column:
    """Which splitter range a row falls in; the splitters are the keys with the smallest hashes."""
    ranges = ranges or min(256, bucket_count(df))
    key = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(ranges)
    splitters = sorted({tuple(r) for r in key.collect()})
    if not splitters:
        return F.lit(0)
    fields = df.select(*order).schema.fields

    def literal(value, field):
        return F.lit(value).cast(field.dataType).alias(field.name)

    array = F.array(*[F.struct(*[literal(v, f) for v, f in zip(s, fields)]) for s in splitters])
    return bucket_of(F.struct(*[F.col(c) for c in order]), array)


def with_global_index(df: DataFrame, order: list[str], name: str = "index", ranges: int | None = None) -> DataFrame:
    """Add a 0-based position in the order of the given columns, which must be unique together and not null.

    Rows are range-sorted into as many tasks as a shuffle has and stored with their places; one total per range gives
    where it starts.  The input is read twice (range bounds, rows): hand in a table or something cut off its lineage.
    """
    n = ranges or shuffle_partitions(df.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumns({"_range": F.spark_partition_id(), "_local": place}))
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per range
    out = ranged.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
    return out.select(*df.columns, name)


def with_running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and with this one, in the order of columns that are unique together.

    Ranges are added up on their own, one task each; the totals of the ranges before, one row per range, are carried on.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    own = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranged = cut_lineage(cut_lineage(ranged).withColumn("_own", F.sum(value).over(own)))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_t"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    out = ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_own") + F.col("_before"))
    return out.select(*df.columns, name)


def with_hashed_index(df: DataFrame, keys: list[str], name: str = "index") -> DataFrame:
    """Add a 0-based number in the order of (first three hex digits of the key digest, keys).

    For draws that need some numbering rather than a sorted one: no splitters have to be fitted, and keys that
    lie close together are spread evenly.  Rows are dealt by the digits, of which there are 4096 in equal parts, so the
    input is read once; each part starts where those before it end.
    """
    digest = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    digits = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")  # in the order of their text
    dealt = df.withColumn("_digits", digits).repartition(shuffle_partitions(df.sparkSession), "_digits")
    dealt = cut_lineage(dealt.sortWithinPartitions("_digits", *keys).withColumn("_local", place))
    totals = dealt.groupBy("_digits").agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    before = W.orderBy("_digits").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_digits", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_before"))
    # one row per value of the digits
    out = dealt.join(F.broadcast(offsets), "_digits").withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
    return out.select(*df.columns, name)


def with_digest_index(df: DataFrame, digest: str, keys: list[str], name: str = "index") -> DataFrame:
    """Add a 0-based position in the order of a hex digest column, ties by keys."""
    return with_global_index(df, [digest, *keys], name)


EXPAND_CHUNK = 10_000


def expand_counts(df: DataFrame, count: str, name: str, chunk: int = EXPAND_CHUNK) -> DataFrame:
    """Repeat every row ``count`` times, numbered from 0 in ``name``.

    A count in the billions first becomes chunks, which are spread over the cluster, so that neither one array
    nor one task holds a hot row's copies.
    """
    last = ((F.col(count) - 1) / chunk).cast("bigint")
    chunks = df.where(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    # a number of partitions, which is kept: chunks are few bytes, and would be packed into one task before they grow
    spread = chunks.repartition(shuffle_partitions(df.sparkSession), *[F.col(c) for c in df.columns], F.col("_chunk"))
    low = F.col("_chunk") * chunk
    high = F.least(low + chunk, F.col(count).cast("bigint")) - 1
    return spread.withColumn(name, F.explode(F.sequence(low, high))).drop("_chunk")
