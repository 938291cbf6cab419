"""Joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one row in so many, so there are fewer heavy keys than this.
HEAVY_SHARE = 1000
#: Rows of heavy keys pass the shuffle under so many other keys.
SPREAD = 1024


def fact_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """``rows`` with the other columns of ``facts``, which has one row per key; a left join.

    ``count`` names the column of facts with the number of rows that have the key.  Facts of heavy keys, fewer than
    HEAVY_SHARE, are broadcast; rows that found theirs, or have a null key, are spread over keys that match nothing.
    ``total`` is the sum of the counts, where the caller knows it.
    """
    if total is None:
        total = facts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    heavy = F.col(count) * HEAVY_SHARE > total
    values = [c for c in facts.columns if c not in keys]
    most = facts.where(heavy).select(*keys, F.struct(*values).alias("_heavy"))
    rest = facts.where(~heavy).select(*keys, F.struct(*values).alias("_light"))
    out = rows.join(F.broadcast(most), keys, "left")
    any_null = F.concat(*[F.col(k).cast("string") for k in keys]).isNull()
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD)) + 1
    out = out.withColumn("_salt", F.when(F.col("_heavy").isNotNull() | any_null, salt).otherwise(F.lit(0)))
    # Always 0, but no constant: a constant would be taken out of the join, and rows dealt by the keys alone.
    rest = rest.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(1)))
    joined = out.join(rest, [*keys, "_salt"], "left")
    found = [F.when(F.col("_heavy").isNotNull(), F.col(f"_heavy.{v}")).otherwise(F.col(f"_light.{v}")).alias(f"_fact__{v}") for v in values]
    shaped = joined.select(*rows.columns, *found)
    return shaped.withColumnsRenamed({f"_fact__{v}": v for v in values})
