"""One-row results beside data rows, as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Add the columns of a one-row table to every row.

    The table becomes a scalar subquery: it runs once, its value is inlined, and no join operator appears in
    the plan.  More than one row is an error at run time.
    """
    names = names or tuple(one_row.columns)
    packed = one_row.select(F.struct(*names).alias("_row")).scalar()
    return df.withColumn("_row", packed).select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in names])
