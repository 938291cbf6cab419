"""Registry of runnable queries and, where plain SQL can say the same, of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # The twins read the tables' wall-clock times as they are.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- SQL text for the twins -------------------------------------------------


def sql_digest(tag: str, *keys: str, seed: int = 42) -> str:
    parts = ", ".join([f"'{seed}'", f"'{tag}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"sha256(concat_ws('|', {parts}))"


def sql_uniform(tag: str, *keys: str, seed: int = 42) -> str:
    h = sql_digest(tag, *keys, seed=seed)
    return f"(((('0x' || substr({h}, 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def sql_index(n: str, tag: str, *keys: str, seed: int = 42) -> str:
    return f"floor({sql_uniform(tag, *keys, seed=seed)} * ({n}))::BIGINT"


def sql_laplace(scale: str, tag: str, *keys: str, seed: int = 42) -> str:
    u = f"({sql_uniform(tag, *keys, seed=seed)} - 0.5::DOUBLE)"
    return f"(-({scale}) * sign({u}) * ln(1::DOUBLE - 2::DOUBLE * abs({u})))"


def sql_normal(tag: str, *keys: str, seed: int = 42) -> str:
    r = sql_uniform(tag + ":r", *keys, seed=seed)
    a = sql_uniform(tag + ":a", *keys, seed=seed)
    return f"(sqrt(-2::DOUBLE * ln({r})) * cos(2::DOUBLE * 3.141592653589793::DOUBLE * {a}))"


def sql_long(source: str, columns: list[str], cast: str, side: str = "") -> str:
    """UNION ALL of (column_name, value) rows, one branch per column."""
    mark = f", '{side}' AS side" if side else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS {cast}) AS value{mark} FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )


def sql_marginal(column: str, source: str, ids: str) -> str:
    """(id, column) drawn by frequency: the first value, commonest first, whose cumulative share exceeds the id's uniform number."""
    return f"""(SELECT id, value AS {column} FROM (SELECT id, {sql_uniform(f'draw:{column}', 'id')} AS u FROM {ids}) JOIN
      (SELECT value, coalesce(lag(hi) OVER (ORDER BY hi), 0) AS lo, hi FROM
        (SELECT value, sum(n) OVER (ORDER BY n DESC, value)::DOUBLE / (sum(n) OVER ())::DOUBLE AS hi FROM
          (SELECT {column}::VARCHAR AS value, count(*) AS n FROM {source} GROUP BY 1))) ON u >= lo AND u < hi)"""
