"""Raw log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): every non-blank line; undecodable bytes turn into the replacement character."""
    return spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.col("value").alias("line"))
