"""Time series: windows, chunks, regular grids, block bootstrap, forecasts and output checks."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import distributions as dist
from tabwright.operators.indexing import with_global_index, with_hashed_index
from tabwright.operators.profile import sampling_step
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage

CHUNK = 8192


def positioned(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``position``, the 0-based place of a row in its series; no task sorts a whole hot series."""
    indexed = cut_lineage(with_global_index(df, [*keys, *order], "_g"))
    if not keys:
        return indexed.withColumnRenamed("_g", "position")
    starts = indexed.groupBy(*keys).agg(F.min("_g").alias("_s"))
    return indexed.join(starts, keys).withColumn("position", F.col("_g") - F.col("_s")).drop("_g", "_s")


def sequences(df: DataFrame, keys: list[str], order: list[str], features: list[str], length: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, start, values): every run of ``length`` consecutive rows, stride 1, values as an array of arrays.

    A series is cut into chunks of positions; the first rows of a chunk are also given to the chunk before it, so
    that windows never need a whole series in one task.
    """
    rows = positioned(df, keys, order)
    chunk = max(chunk, length)
    own = F.floor(F.col("position") / chunk)
    borrowed = (F.col("position") % chunk < length - 1) & (own > 0)
    homes = F.array_compact(F.array(own, F.when(borrowed, own - 1)))
    values = F.array(*[F.col(c).cast("double") for c in features])
    spread = rows.select(*keys, "position", values.alias("_v"), F.explode(homes).alias("_c"))
    w = W.partitionBy(*keys, "_c").orderBy("position").rowsBetween(0, length - 1)
    windows = spread.withColumn("values", F.collect_list("_v").over(w))
    starts_here = F.floor(F.col("position") / chunk) == F.col("_c")
    return windows.where(starts_here & (F.size("values") == length)).select(*keys, F.col("position").alias("start"), "values")


def supervised(df: DataFrame, keys: list[str], order: list[str], features: list[str], target: str, length: int) -> DataFrame:
    """(keys, start, inputs, label): ``length`` rows in, the target of the next row out."""
    runs = sequences(df, keys, order, features, length + 1)
    at = features.index(target)
    return runs.select(*keys, "start", F.slice("values", 1, length).alias("inputs"), F.get(F.get("values", F.lit(length)), F.lit(at)).alias("label"))


def chunks(df: DataFrame, keys: list[str], order: list[str], features: list[str], length: int = 24) -> DataFrame:
    """(keys, chunk, values): consecutive rows in blocks of ``length``, the incomplete tail dropped."""
    rows = positioned(df, keys, order)
    values = F.array(*[F.col(c).cast("double") for c in features])
    grouped = rows.groupBy(*keys, F.floor(F.col("position") / length).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("position", values.alias("v")))).alias("_l"))
    return grouped.where(F.size("_l") == length).select(*keys, "chunk", F.transform("_l", lambda x: x["v"]).alias("values"))


def flatten(runs: DataFrame, order: list[str], features: list[str], n: int | None = None) -> DataFrame:
    """(row, features): sequences laid end to end in order, cut to the first n rows."""
    rows = runs.select(*order, F.posexplode("values").alias("_p", "_v"))
    if n is not None:
        rows = rows.orderBy(*order, "_p").limit(n)
    rows = cut_lineage(rows)
    numbered = with_global_index(rows, [*order, "_p"], "row")
    return numbered.select("row", *[F.get("_v", F.lit(i)).alias(c) for i, c in enumerate(features)])


def time_grid(rows: DataFrame, df: DataFrame, time_column: str, index: str = "row", name: str = "ts") -> DataFrame:
    """Add regular timestamps from the observed minimum at the inferred step."""
    first = df.agg(F.min(F.unix_micros(F.col(time_column).cast("timestamp"))).alias("_first"))
    sized = attach(attach(rows, first), sampling_step(df, time_column).select("step_seconds"))
    micros = F.col("_first") + (F.col(index) * F.col("step_seconds") * 1e6).cast("bigint")
    return sized.withColumn(name, F.timestamp_micros(micros)).drop("_first", "step_seconds")


def block_bootstrap(
    df: DataFrame, keys: list[str], order: list[str], features: list[str], length: int, rows: int, time_column: str | None = None, seed: int = keyed.SEED
) -> DataFrame:
    """A synthetic series of ``rows`` rows: observed windows of ``length`` drawn at hashed positions, laid end to end.

    The moving-block bootstrap (Kuensch 1989) keeps dependence inside a block.
    """
    runs = cut_lineage(with_hashed_index(cut_lineage(sequences(df, keys, order, features, length)), [*keys, "start"], "_at").select("_at", "values"))
    needed = -(-rows // length)
    total = runs.agg(F.count("*").alias("_n"))
    draws = attach(df.sparkSession.range(needed), total)
    draws = draws.withColumn("_at", keyed.index_below(F.col("_n"), "block", F.col("id"), seed=seed)).drop("_n")
    joined = draws.join(runs, "_at")
    made = joined.select(F.posexplode("values").alias("_p", "_v"), "id").select(
        (F.col("id") * length + F.col("_p")).alias("row"), *[F.get("_v", F.lit(i)).alias(c) for i, c in enumerate(features)]
    )
    made = made.where(F.col("row") < rows)
    return time_grid(made, df, time_column) if time_column else made


# --- forecasts --------------------------------------------------------------


def forecast_metrics(pairs: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: RMSE, MAE, R2, MAPE."""
    error = F.col(actual) - F.col(predicted)
    return pairs.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(actual) * F.count(actual))).alias("r2"),
        (F.avg(F.abs(error / (F.abs(F.col(actual)) + 1e-8))) * 100).alias("mape"),
    )


def naive_forecast(windows: DataFrame, at: int = 0) -> DataFrame:
    """Predict the last observed value."""
    return windows.withColumn("prediction", F.get(F.element_at("inputs", -1), F.lit(at)))


def band(score: Column) -> Column:
    return F.when(score >= 0.85, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


def efficacy(real: Column, synthetic: Column) -> Column:
    return F.lit(1.0) - F.least(F.lit(1.0), F.abs(real - synthetic) / (F.abs(real) + 1e-7))


def _lagged(windows: DataFrame, length: int, width: int) -> DataFrame:
    flat = F.flatten("inputs")
    named = windows.select("*", *[F.get(flat, F.lit(i)).alias(f"_f{i}") for i in range(length * width)])
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(length * width)], outputCol="features", handleInvalid="skip")
    return assembler.transform(named).select("label", "features")


def forecast_efficacy(real: DataFrame, synthetic: DataFrame, keys: list[str], order: list[str], features: list[str], target: str, length: int = 5) -> DataFrame:
    """One row: an autoregression trained on real and one trained on synthetic windows, both tested on the real tail.

    The test windows start in the last 30 % of each series.
    """
    windows = cut_lineage(supervised(real, keys, order, features, target, length))
    size = windows.groupBy(*keys).agg(F.max("start").alias("_m")) if keys else windows.agg(F.max("start").alias("_m"))
    joined = windows.join(size, keys) if keys else attach(windows, size)
    train = joined.where(F.col("start") < F.floor(0.7 * (F.col("_m") + 1)))
    test = cut_lineage(_lagged(joined.where(F.col("start") >= F.floor(0.7 * (F.col("_m") + 1))), length, len(features)))
    other = supervised(synthetic, keys, order, features, target, length)
    model = LinearRegression(regParam=1e-6)
    a = forecast_metrics(model.fit(_lagged(train, length, len(features))).transform(test)).select(*[F.col(c).alias(f"{c}_real") for c in ("rmse", "mae", "r2", "mape")])
    b = forecast_metrics(model.fit(_lagged(other, length, len(features))).transform(test)).select(*[F.col(c).alias(f"{c}_synthetic") for c in ("rmse", "mae", "r2", "mape")])
    score = efficacy(F.col("rmse_real"), F.col("rmse_synthetic"))
    return attach(a, b).withColumn("efficacy", score).withColumn("band", band(F.col("efficacy")))


# --- output check -----------------------------------------------------------


def output_check(original: DataFrame, made: DataFrame, time_column: str, columns: list[str], tolerance: float = 0.3) -> DataFrame:
    """(check, passed): same columns, at most three time steps, mean and deviation of each column within 30 %."""
    spark = original.sparkSession
    same = spark.createDataFrame([("same_columns", set(original.columns) == set(made.columns))], "check string, passed boolean")
    moments = cut_lineage(made.select(time_column).where(F.col(time_column).isNotNull()).distinct())
    ordered = cut_lineage(with_global_index(moments, [time_column], "_i"))
    nxt = ordered.select((F.col("_i") - 1).alias("_i"), F.col(time_column).alias("_next"))
    gaps = ordered.join(nxt, "_i").select((F.unix_micros("_next") - F.unix_micros(F.col(time_column).cast("timestamp"))).alias("gap"))
    steps = gaps.agg((F.count_distinct("gap") <= 3).alias("passed")).select(F.lit("regular_steps").alias("check"), "passed")
    s = dist.paired_summary(original, made, columns)

    def near(a, b):
        return F.abs(F.col(a) - F.col(b)) <= tolerance * F.greatest(F.abs(F.col(a)), F.lit(1e-9))

    checks = s.select(F.inline(F.array(
        F.struct(F.concat(F.lit("mean:"), "column_name").alias("check"), near("mean_first", "mean_second").alias("passed")),
        F.struct(F.concat(F.lit("std:"), "column_name").alias("check"), near("std_first", "std_second").alias("passed")),
    )))
    return reduce(DataFrame.unionByName, [same, steps, checks])


def check_band(checks: DataFrame) -> DataFrame:
    share = F.avg(F.coalesce(F.col("passed"), F.lit(False)).cast("double"))
    return checks.agg(share.alias("share"), F.when(share == 1, "pass").when(share >= 0.7, "mostly").otherwise("fail").alias("verdict"))
