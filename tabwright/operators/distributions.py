"""Shared distribution kernel.

Both tables are turned into long rows ``(column_name, value)`` and counted once per distinct value with a
map-side partial sum, so a value that holds a third of all rows crosses the network as one row per task.
Everything ordered (running sums, ranks, quantiles, the Kolmogorov-Smirnov distance) works in two levels:
cut points split every column into buckets of about equal weight, each bucket is scanned by its own task,
and bucket totals (columns x buckets rows) carry the running sum from one bucket to the next.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.session import shuffle_partitions

EPSILON = 1e-10
HISTOGRAM_BINS = 29
CUT_POINT_SHARE = 0.05


# --- column lists -----------------------------------------------------------


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def categorical_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    kinds = (T.StringType, T.BooleanType) if booleans else (T.StringType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def common_columns(first: DataFrame, second: DataFrame) -> list[str]:
    return sorted(set(first.columns) & set(second.columns))


def numeric(column: str) -> Column:
    """A column as a double in which NaN is null and negative zero is zero."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


# --- long form --------------------------------------------------------------


def long_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.select(*[numeric(c).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "value").where(F.col("value").isNotNull())


def long_text(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "value").where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: list[str], kind: str = "categorical") -> DataFrame:
    """(column_name, value, n) over one table, nulls left out."""
    rows = long_numeric(df, columns) if kind == "numeric" else long_text(df, columns)
    return rows.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def paired_counts(first: DataFrame, second: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column_name, value, n_first, n_second); a value seen on one side only has 0 on the other."""
    to_long = long_numeric if kind == "numeric" else long_text
    tagged = (
        to_long(first, columns)
        .withColumn("one", F.lit(1).cast("bigint"))
        .withColumn("two", F.lit(0).cast("bigint"))
        .unionByName(
            to_long(second, columns)
            .withColumn("one", F.lit(0).cast("bigint"))
            .withColumn("two", F.lit(1).cast("bigint"))
        )
    )
    return tagged.groupBy("column_name", "value").agg(F.sum("one").alias("n_first"), F.sum("two").alias("n_second"))


def column_totals(counts: DataFrame, *names: str) -> DataFrame:
    """One row per column_name: the sum of each count column, named total_<count>."""
    return counts.groupBy("column_name").agg(*[F.sum(n).alias(f"total_{n}") for n in names])


def with_totals(counts: DataFrame, *names: str) -> DataFrame:
    # One row per column of the schema: safe to broadcast whatever the data size.
    return counts.join(F.broadcast(column_totals(counts, *names)), "column_name")


# --- one-pass summaries -----------------------------------------------------


def stack_row(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """Turn one wide row of ``field__column`` values into one row per column."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{f}__{c}`").alias(f) for f in fields])
            for c in columns
        ]
    )
    return row.select(F.inline(entries))


def summarise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min and max of every numeric column in a single pass without unpivoting."""
    aggregates = []
    for c in columns:
        v = numeric(c)
        aggregates += [
            F.count(v).alias(f"n__{c}"),
            F.avg(v).alias(f"mean__{c}"),
            F.stddev_samp(v).alias(f"std__{c}"),
            F.min(v).alias(f"min__{c}"),
            F.max(v).alias(f"max__{c}"),
        ]
    return stack_row(df.agg(*aggregates), columns, ["n", "mean", "std", "min", "max"])


def paired_summary(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Both summaries side by side, one row per column."""

    def rename(df, suffix):
        return df.select("column_name", *[F.col(c).alias(f"{c}_{suffix}") for c in ("n", "mean", "std", "min", "max")])

    return rename(summarise(first, columns), "first").join(
        F.broadcast(rename(summarise(second, columns), "second")), "column_name"
    )


# --- ordered work in two levels ---------------------------------------------


def bucket_count(df: DataFrame) -> int:
    return max(16, min(4096, 4 * shuffle_partitions(df.sparkSession)))


def fit_cut_points(tables: list[DataFrame], columns: list[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate equal-weight cut points per column: one aggregate, columns x buckets numbers on the driver.

    They only decide how work is split, so neither the approximation nor the sampled fit ever changes a result.
    """
    buckets = buckets or bucket_count(tables[0])
    fractions = [i / buckets for i in range(1, buckets)]
    rows = None
    for t in tables:
        part = t.select(*[numeric(c).alias(c) for c in columns]).sample(CUT_POINT_SHARE, seed=7)
        rows = part if rows is None else rows.unionByName(part)
    fitted = rows.agg(*[F.percentile_approx(F.col(c), fractions, 20 * buckets).alias(c) for c in columns]).first()
    return {c: sorted(set(fitted[c] or [])) for c in columns}


def bucket_of(value: Column, cuts: Column) -> Column:
    """How many cut points lie at or below the value, by binary search in a sorted array."""
    size = F.size(cuts)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1))
    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def halve(state, _):
        middle = ((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.get(cuts, middle) <= value
        return (
            F.when(state["lo"] >= state["hi"], state)
            .when(below, F.struct((middle + 1).alias("lo"), state["hi"].alias("hi")))
            .otherwise(F.struct(state["lo"].alias("lo"), middle.alias("hi")))
        )

    return F.aggregate(steps, start, halve, lambda state: state["lo"])


def long_bucketed(df: DataFrame, columns: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """(column_name, bucket, value): long rows that carry the range their value falls in."""
    wide = df.select(*[numeric(c).alias(c) for c in columns])
    ends = (float("-inf"), float("inf"))
    bucketed = Bucketizer(
        splitsArray=[[ends[0], *(cuts[c] or [0.0]), ends[1]] for c in columns],
        inputCols=columns,
        outputCols=[f"_bucket__{c}" for c in columns],
        handleInvalid="keep",
    ).transform(wide)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_bucket__{c}").cast("int").alias("bucket"), F.col(c).alias("value"))
        for c in columns
    ]
    return bucketed.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())


def ordered_counts(df: DataFrame, columns: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """(column_name, bucket, value, n)."""
    return long_bucketed(df, columns, cuts).groupBy("column_name", "bucket", "value").agg(F.count("*").alias("n"))


def ordered_paired_counts(
    first: DataFrame, second: DataFrame, columns: list[str], cuts: dict[str, list[float]]
) -> DataFrame:
    """(column_name, bucket, value, n_first, n_second)."""
    tagged = (
        long_bucketed(first, columns, cuts)
        .withColumn("is_first", F.lit(True))
        .unionByName(long_bucketed(second, columns, cuts).withColumn("is_first", F.lit(False)))
    )
    return tagged.groupBy("column_name", "bucket", "value").agg(
        F.count(F.when(F.col("is_first"), 1)).alias("n_first"), F.count(F.when(~F.col("is_first"), 1)).alias("n_second")
    )


def running_counts(bucketed: DataFrame, *names: str) -> DataFrame:
    """Add ``cum_<name>`` (inclusive running sum in value order) and ``total_<name>`` per column."""
    inside = W.partitionBy("column_name", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("column_name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("column_name")
    # At most columns x buckets rows.
    totals = bucketed.groupBy("column_name", "bucket").agg(*[F.sum(n).alias(f"b_{n}") for n in names])
    offsets = totals.select(
        "column_name",
        "bucket",
        *[F.coalesce(F.sum(f"b_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in names],
        *[F.sum(f"b_{n}").over(whole).alias(f"total_{n}") for n in names],
    )
    local = bucketed.select("*", *[F.sum(n).over(inside).alias(f"in_{n}") for n in names])
    joined = local.join(F.broadcast(offsets), ["column_name", "bucket"])
    for n in names:
        joined = joined.withColumn(f"cum_{n}", F.col(f"in_{n}") + F.col(f"before_{n}")).drop(f"in_{n}", f"before_{n}")
    return joined


def ks_distance(counts: DataFrame) -> DataFrame:
    """Largest gap between the two cumulative distributions of each column.

    Within a bucket the gap is the bucket's offset plus a local part, so only the smallest and largest local
    part matter: the scan leaves one row per bucket, and no joined detail is needed.
    """
    sized = with_totals(counts, "n_first", "n_second")
    inside = W.partitionBy("column_name", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    gap = F.try_divide(F.sum("n_first").over(inside), F.col("total_n_first")) - F.try_divide(
        F.sum("n_second").over(inside), F.col("total_n_second")
    )
    per_bucket = (
        sized.select("column_name", "bucket", "total_n_first", "total_n_second", "n_first", "n_second", gap.alias("gap"))
        .groupBy("column_name", "bucket", "total_n_first", "total_n_second")
        .agg(
            F.min("gap").alias("low"),
            F.max("gap").alias("high"),
            (
                F.try_divide(F.sum("n_first"), F.first("total_n_first"))
                - F.try_divide(F.sum("n_second"), F.first("total_n_second"))
            ).alias("net"),
        )
    )
    before = W.partitionBy("column_name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    shifted = per_bucket.withColumn("offset", F.coalesce(F.sum("net").over(before), F.lit(0.0)))
    return shifted.groupBy("column_name").agg(
        F.max(F.greatest(F.abs(F.col("offset") + F.col("low")), F.abs(F.col("offset") + F.col("high")))).alias("ks"),
        F.max("total_n_first").alias("n_first"),
        F.max("total_n_second").alias("n_second"),
    )


def quantiles(df: DataFrame, columns: list[str], fractions: list[float], buckets: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: (column_name, fraction, quantile).

    The built-in exact ``percentile`` keeps every distinct value of a group in one task; this reads the two
    neighbouring order statistics off the two-level running counts instead.
    """
    cuts = fit_cut_points([df], columns, buckets)
    return quantiles_of_counts(running_counts(ordered_counts(df, columns, cuts), "n"), fractions)


def quantiles_of_counts(running: DataFrame, fractions: list[float]) -> DataFrame:
    spots = []
    for i, q in enumerate(fractions):
        position = F.lit(float(q)) * (F.col("total_n") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("total_n") - 1)
        spots += [
            F.min(F.when(F.col("cum_n") > low, F.col("value"))).alias(f"low_{i}"),
            F.min(F.when(F.col("cum_n") > high, F.col("value"))).alias(f"high_{i}"),
        ]
    found = running.groupBy("column_name").agg(F.max("total_n").alias("total_n"), *spots)
    entries = []
    for i, q in enumerate(fractions):
        position = F.lit(float(q)) * (F.col("total_n") - 1)
        part = position - F.floor(position)
        value = F.col(f"low_{i}") + part * (F.col(f"high_{i}") - F.col(f"low_{i}"))
        entries.append(F.struct(F.lit(float(q)).alias("fraction"), value.alias("quantile")))
    return found.select("column_name", F.inline(F.array(*entries)))


def quantile_sketches(df: DataFrame, columns: list[str], k: int = 400) -> DataFrame:
    """(column_name, sketch): a KLL sketch per numeric column, of bounded size, from one pass; sketches of parts can be merged."""
    row = df.agg(*[F.kll_sketch_agg_double(numeric(c), k).alias(f"sketch__{c}") for c in columns])
    return stack_row(row, columns, ["sketch"])


def merged_sketches(sketches: DataFrame, k: int = 400) -> DataFrame:
    """One sketch per column of the rows that several sketches have seen."""
    return sketches.groupBy("column_name").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def approximate_quantiles(sketches: DataFrame, fractions: list[float]) -> DataFrame:
    """(column_name, fraction, quantile) read from sketches: values whose rank is close to the fraction, with no interpolation."""
    found = [F.struct(F.lit(float(q)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("quantile")) for q in fractions]
    return sketches.select("column_name", F.inline(F.array(*found)))


def quantile_map(df: DataFrame, columns: list[str], fractions: list[float]) -> dict[str, dict[float, float]]:
    """The same on the driver: columns x fractions numbers."""
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for r in quantiles(df, columns, fractions).collect():
        out[r.column_name][r.fraction] = r.quantile
    return out


def quantile_grid(df: DataFrame, columns: list[str], steps: int) -> dict[str, list[float]]:
    """Exact quantiles at 0, 1/steps, ..., 1 on the driver: columns x (steps + 1) numbers.

    A distinct value covers the positions between the counts before and after it; integer arithmetic gives the
    grid points that fall there, so each grid point is emitted by exactly one value.
    """
    cuts = fit_cut_points([df], columns)
    rows = running_counts(ordered_counts(df, columns, cuts), "n")
    last = F.col("total_n") - 1
    before = F.col("cum_n") - F.col("n")

    def points(first, end):
        # Grid points i with first <= (i * last) div steps <= end.
        low = F.expr("0") if first is None else F.greatest(F.lit(0), F.ceil(first * steps / F.greatest(last, F.lit(1))))
        high = F.least(F.lit(steps), F.ceil((end + 1) * steps / F.greatest(last, F.lit(1))) - 1)
        return F.when(last <= 0, F.sequence(F.lit(0), F.lit(steps))).when(low <= high, F.sequence(low.cast("int"), high.cast("int")))

    low = rows.select("column_name", "total_n", F.col("value").alias("low"), F.explode(points(before, F.col("cum_n") - 1)).alias("i"))
    high_end = F.when(F.col("cum_n") == F.col("total_n"), F.col("cum_n")).otherwise(F.col("cum_n") - 2)
    high = rows.select("column_name", F.col("value").alias("high"), F.explode(points(F.greatest(F.lit(0), before - 1), high_end)).alias("i"), before.alias("b"), "cum_n", "total_n")
    spot = F.least(F.floor(F.col("i") * last / steps) + 1, last)
    high = high.where((spot >= F.col("b")) & (spot < F.col("cum_n"))).select("column_name", "i", "high")
    out: dict[str, list[float]] = {c: [0.0] * (steps + 1) for c in columns}
    for r in low.join(high, ["column_name", "i"]).collect():
        part = (r.i * (r.total_n - 1)) % steps / steps
        out[r.column_name][r.i] = r.low + part * (r.high - r.low)
    return out


def sketch_quantiles(df: DataFrame, columns: list[str], fractions: list[float], accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles from one pass, for tables where an exact answer is not worth a shuffle."""
    row = df.agg(*[F.percentile_approx(numeric(c), fractions, accuracy).alias(f"q__{c}") for c in columns])
    return stack_row(row, columns, ["q"]).select(
        "column_name", F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in fractions]), "q")).alias("z")
    ).select("column_name", F.col("z.0").alias("fraction"), F.col("z.q").alias("quantile"))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, rank): ranks from 1 with ties averaged, one row per distinct value."""
    cuts = fit_cut_points([df], columns)
    running = running_counts(ordered_counts(df, columns, cuts), "n")
    rank = F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)
    return running.select("column_name", "value", "n", "total_n", rank.alias("rank"))


# --- histograms and frequency measures --------------------------------------


def joint_histogram(first: DataFrame, second: DataFrame, columns: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column_name, bin, n_first, n_second) on equal-width bins over the joint range, empty bins included."""
    ranges = paired_summary(first, second, columns).select(
        "column_name",
        F.least("min_first", "min_second").alias("low"),
        F.greatest("max_first", "max_second").alias("high"),
    )

    def binned(df, side):
        # One row per column: bounded by the schema.
        rows = long_numeric(df, columns).join(F.broadcast(ranges), "column_name")
        width = (F.col("high") - F.col("low")) / bins
        spot = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) / width)).otherwise(bins - 1)
        ones = {"n_first": 1 if side == "first" else 0, "n_second": 0 if side == "first" else 1}
        return rows.select(
            "column_name",
            F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"),
            *[F.lit(v).cast("bigint").alias(k) for k, v in ones.items()],
        )

    every_bin = ranges.select(
        "column_name",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.lit(0).cast("bigint").alias("n_first"),
        F.lit(0).cast("bigint").alias("n_second"),
    )
    return (
        binned(first, "first")
        .unionByName(binned(second, "second"))
        .unionByName(every_bin)
        .groupBy("column_name", "bin")
        .agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"))
    )


def frequency_measures(items: DataFrame) -> DataFrame:
    """KL, JS, overlap and chi-square distance per column from paired counts of bins or categories.

    Epsilon is added to every frequency before renormalising, so the smoothed shares are (f + e) / (1 + k e).
    """
    totals = items.groupBy("column_name").agg(
        F.sum("n_first").alias("total_first"), F.sum("n_second").alias("total_second"), F.count("*").alias("items")
    )
    shares = (
        items.join(F.broadcast(totals), "column_name")
        .withColumn("f", F.try_divide(F.col("n_first"), F.col("total_first")))
        .withColumn("g", F.try_divide(F.col("n_second"), F.col("total_second")))
    )
    norm = F.lit(1.0) + F.col("items") * F.lit(EPSILON)
    p = (F.col("f") + F.lit(EPSILON)) / norm
    q = (F.col("g") + F.lit(EPSILON)) / norm
    smooth = shares.withColumn("p", p).withColumn("q", q).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return smooth.groupBy("column_name").agg(
        F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"),
        (
            F.sum(F.col("p") * F.log(F.col("p") / F.col("m"))) / 2
            + F.sum(F.col("q") * F.log(F.col("q") / F.col("m"))) / 2
        ).alias("js"),
        F.sum(F.least("f", "g")).alias("overlap"),
        F.sum(F.pow(F.col("f") - F.col("g"), F.lit(2)) / (F.col("f") + F.lit(EPSILON))).alias("chi_square_distance"),
        F.count("*").alias("items"),
    )
