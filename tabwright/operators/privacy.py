"""Calibrated noise: statistics, category counts, whole tables, votes, clipping and a budget ledger."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import distributions as dist
from tabwright.operators.indexing import range_bucket
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage


def laplace_scale(sensitivity, epsilon: float):
    return sensitivity / epsilon


def gaussian_sigma(sensitivity, epsilon: float, delta: float):
    return sensitivity * math.sqrt(2.0 * math.log(1.25 / delta)) / epsilon


def add_laplace(value: Column, sensitivity, epsilon: float, tag: str, *keys: Column, seed: int = keyed.SEED) -> Column:
    return value + keyed.laplace(laplace_scale(sensitivity, epsilon), tag, *keys, seed=seed)


def add_gaussian(
    value: Column, sensitivity, epsilon: float, delta: float, tag: str, *keys: Column, seed: int = keyed.SEED
) -> Column:
    return value + gaussian_sigma(sensitivity, epsilon, delta) * keyed.normal(tag, *keys, seed=seed)


def noisy_statistics(df: DataFrame, columns: list[str], epsilon: float, seed: int = keyed.SEED) -> DataFrame:
    """(column_name, noisy_mean, noisy_std): values scaled to [0, 1], half the budget for each figure.

    The deviation is the population one; sensitivity is 1/n; a negative noisy deviation becomes 0.
    """
    aggregates = []
    for c in columns:
        v = dist.numeric(c)
        aggregates += [
            F.count(v).alias(f"n__{c}"), F.avg(v).alias(f"mean__{c}"), F.stddev_pop(v).alias(f"std__{c}"),
            F.min(v).alias(f"low__{c}"), F.max(v).alias(f"high__{c}"),
        ]
    rows = dist.stack_row(df.agg(*aggregates), columns, ["n", "mean", "std", "low", "high"])
    width = F.col("high") - F.col("low")
    unit = F.when(width > 0, width).otherwise(1.0)
    scale = F.try_divide(F.lit(1.0), F.col("n")) / (epsilon / 2)
    mean = (F.col("mean") - F.col("low")) / unit + keyed.laplace(scale, "dp-mean", F.col("column_name"), seed=seed)
    std = F.col("std") / unit + keyed.laplace(scale, "dp-std", F.col("column_name"), seed=seed)
    return rows.select(
        "column_name",
        "n",
        (mean * unit + F.col("low")).alias("noisy_mean"),
        (F.greatest(F.lit(0.0), std) * unit).alias("noisy_std"),
    )


def noisy_categories(df: DataFrame, columns: list[str], epsilon: float, seed: int = keyed.SEED) -> DataFrame:
    """(column_name, value, share): Laplace(1/epsilon) on every count, floor 0, renormalised.

    Where every noisy count of a column is 0 the true shares are used.
    """
    counts = dist.value_counts(df, columns)
    noise = keyed.laplace(1.0 / epsilon, "dp-count", F.col("column_name"), F.col("value"), seed=seed)
    noisy = counts.withColumn("noisy", F.greatest(F.lit(0.0), F.col("n") + noise))
    totals = noisy.groupBy("column_name").agg(F.sum("n").alias("total_n"), F.sum("noisy").alias("total_noisy"))
    share = F.when(F.col("total_noisy") > 0, F.col("noisy") / F.col("total_noisy")).otherwise(F.try_divide(F.col("n"), F.col("total_n")))
    # Totals: one row per column of the schema.
    return noisy.join(F.broadcast(totals), "column_name").select("column_name", "value", "n", share.alias("share"))


def perturb(
    df: DataFrame,
    columns: list[str],
    keys: list[str],
    epsilon: float,
    delta: float = 1e-5,
    mechanism: str = "laplace",
    sensitivity: str = "mean",
    seed: int = keyed.SEED,
) -> DataFrame:
    """Add noise to every numeric cell.

    ``sensitivity="mean"`` uses (max - min) / n, which protects a published mean rather than each record;
    ``"range"`` uses max - min, the per-record guarantee.
    """
    if mechanism not in ("laplace", "gaussian"):
        raise ValueError(f"unknown mechanism: {mechanism}")
    if sensitivity not in ("mean", "range"):
        raise ValueError(f"unknown sensitivity: {sensitivity}")
    fitted = df.agg(*[(F.max(dist.numeric(c)) - F.min(dist.numeric(c))).alias(f"_w__{c}") for c in columns], F.count("*").alias("_n"))
    joined = attach(df, fitted)
    ids = [F.col(k) for k in keys]
    noisy = {}
    for c in columns:
        spread = F.col(f"_w__{c}") / F.col("_n") if sensitivity == "mean" else F.col(f"_w__{c}")
        if mechanism == "laplace":
            noisy[c] = add_laplace(dist.numeric(c), spread, epsilon, f"perturb:{c}", *ids, seed=seed)
        else:
            noisy[c] = add_gaussian(dist.numeric(c), spread, epsilon, delta, f"perturb:{c}", *ids, seed=seed)
    return joined.withColumns(noisy).select(*df.columns)


def perturb_metadata(df: DataFrame, columns: list[str], epsilon: float, delta: float, mechanism: str) -> DataFrame:
    """One row describing a perturbation."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(mechanism).alias("mechanism"), F.lit(float(epsilon)).alias("epsilon"), F.lit(float(delta)).alias("delta"),
        F.lit(len(columns)).cast("bigint").alias("columns_perturbed"), "rows",
    )


def vote_winner(votes: DataFrame, item: str, label: str, epsilon: float, delta: float = 1e-5, seed: int = keyed.SEED) -> DataFrame:
    """(item, winner, noisy_votes): the class with most votes after Gaussian noise of sensitivity 1."""
    counts = votes.groupBy(item, label).agg(F.count("*").alias("n"))
    noisy = add_gaussian(F.col("n").cast("double"), 1.0, epsilon, delta, "votes", F.col(item), F.col(label), seed=seed)
    scored = counts.withColumn("noisy", noisy)
    return scored.groupBy(item).agg(F.max_by(label, "noisy").alias("winner"), F.max("noisy").alias("noisy_votes"))


def clip_vector(vector: Column, max_norm: float) -> Column:
    """Scale a vector down to the given L2 norm; shorter vectors stay."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    factor = F.least(F.lit(1.0), F.lit(float(max_norm)) / F.greatest(F.sqrt(squares), F.lit(1e-12)))
    return F.transform(vector, lambda x: x.cast("double") * factor)


def budget_ledger(spends: DataFrame, dataset: str, order: list[str], amount: str, limit: float) -> DataFrame:
    """(dataset, accepted, rejected, spent, remaining, depleted): spends in order, refused where they would exceed the limit.

    A refused spend does not count, so whether one fits depends on all before it.  That is settled in rounds:
    running sums accept everything up to a dataset's first misfit; after it only later spends that still fit
    go on.  An amount that misfits once never fits again, so rounds are bounded by the number of distinct
    amounts.  Running sums are computed per (dataset, range of the order), so a hot dataset is many tasks.
    """
    position = F.struct(*order)
    base = spends.select(dataset, *order, F.col(amount).cast("double").alias("_amount"))
    base = base.withColumn("_range", range_bucket(base, order, None))
    requests = base.groupBy(dataset).agg(F.count("*").alias("requests"))
    state = requests.select(dataset, F.lit(0.0).alias("spent"), F.lit(0).cast("bigint").alias("accepted"))
    candidates = base.where(F.col("_amount") <= limit)
    inside = W.partitionBy(dataset, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(dataset).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    while True:
        totals = candidates.groupBy(dataset, "_range").agg(F.sum("_amount").alias("_t"))
        offsets = totals.select(dataset, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_before"))
        summed = (
            candidates.withColumn("_in", F.sum("_amount").over(inside))
            .join(offsets, [dataset, "_range"])
            .join(state.select(dataset, "spent"), dataset)
            .withColumn("_misfit", F.col("spent") + F.col("_before") + F.col("_in") > limit + 1e-9)
        )
        stops = summed.where("_misfit").groupBy(dataset).agg(F.min(position).alias("_stop"))
        marked = summed.join(stops, dataset, "left")
        taken = marked.where(F.col("_stop").isNull() | (position < F.col("_stop"))).groupBy(dataset).agg(
            F.sum("_amount").alias("_s"), F.count("*").alias("_k")
        )
        state = cut_lineage(
            state.join(taken, dataset, "left").select(
                dataset,
                (F.col("spent") + F.coalesce("_s", F.lit(0.0))).alias("spent"),
                (F.col("accepted") + F.coalesce("_k", F.lit(0))).alias("accepted"),
            )
        )
        later = marked.where(position > F.col("_stop")).select(dataset, *order, "_amount", "_range")
        fits = later.join(state.select(dataset, "spent"), dataset).where(F.col("spent") + F.col("_amount") <= limit + 1e-9)
        candidates = cut_lineage(fits.drop("spent"))
        if candidates.isEmpty():
            break
    remaining = F.lit(float(limit)) - F.col("spent")
    return requests.join(state, dataset).select(
        dataset, "accepted", (F.col("requests") - F.col("accepted")).alias("rejected"), "spent",
        remaining.alias("remaining"), (remaining <= 1e-9).alias("depleted"),
    )
