"""Tables, previews and report files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header (types inferred unless a schema is given) or Parquet; other extensions are refused."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension == ".csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if extension == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {extension or path}")


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """Entries of a folder on whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in system.listStatus(path))


def read_table_set(spark: SparkSession, folder: str, extension: str = ".csv") -> dict[str, DataFrame]:
    """Every table of a folder, named by its file stem."""
    found = {}
    for path in list_paths(spark, folder):
        stem, ext = os.path.splitext(os.path.basename(path.rstrip("/")))
        if ext.lower() == extension:
            found[stem] = read_table(spark, path)
    return found


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metric rows as JSON lines."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def preview(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(*keys).limit(n)
