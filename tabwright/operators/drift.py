"""Feature and concept drift between a baseline and a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.functions.special import chi_square_tail, kolmogorov_tail
from tabwright.operators import distributions as dist
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage

REPORT = [
    "column_name", "column_type", "test_used", "drift_score", "p_value", "alert_level",
    "mean_baseline", "mean_snapshot", "std_baseline", "std_snapshot", "mean_shift",
    "chi_square", "new_categories", "missing_categories",
]


def alert_level(score: Column, p_value: Column | None = None) -> Column:
    """red, yellow or green; a None p-value leaves the decision to the score alone."""
    red, yellow = score > 0.3, score > 0.1
    if p_value is not None:
        red, yellow = (p_value < 0.001) | red, (p_value < 0.05) | yellow
    return F.when(red, "red").when(yellow, "yellow").otherwise("green")


def numeric_drift(baseline: DataFrame, snapshot: DataFrame, columns: list[str], use_p_value: bool = True) -> DataFrame:
    """KS distance, p-value, means and spreads per numeric column; an empty side scores 0 and stays green."""
    cuts = dist.fit_cut_points([baseline, snapshot], columns)
    ks = dist.ks_distance(dist.ordered_paired_counts(baseline, snapshot, columns, cuts))
    return _numeric_rows(ks, dist.paired_summary(baseline, snapshot, columns), use_p_value)


def _numeric_rows(ks: DataFrame, summary: DataFrame, use_p_value: bool) -> DataFrame:
    joined = summary.join(F.broadcast(ks.select("column_name", "ks")), "column_name", "left")
    filled = (F.col("n_first") > 0) & (F.col("n_second") > 0)
    harmonic = F.try_divide(F.col("n_first") * F.col("n_second"), F.col("n_first") + F.col("n_second"))
    score = F.when(filled, F.col("ks")).otherwise(0.0)
    p = F.when(filled, kolmogorov_tail(F.sqrt(harmonic) * F.col("ks"))).otherwise(1.0)
    rows = joined.withColumn("drift_score", score).withColumn("p_value", p)
    return rows.select(
        "column_name",
        F.lit("numeric").alias("column_type"),
        F.lit("ks").alias("test_used"),
        "drift_score",
        "p_value",
        F.when(~filled, "green")
        .otherwise(alert_level(F.col("drift_score"), F.col("p_value") if use_p_value else None))
        .alias("alert_level"),
        F.col("mean_first").alias("mean_baseline"),
        F.col("mean_second").alias("mean_snapshot"),
        F.col("std_first").alias("std_baseline"),
        F.col("std_second").alias("std_snapshot"),
        (F.col("mean_second") - F.col("mean_first")).alias("mean_shift"),
        F.lit(None).cast("double").alias("chi_square"),
        F.lit(None).cast("bigint").alias("new_categories"),
        F.lit(None).cast("bigint").alias("missing_categories"),
    )


def category_changes(counts: DataFrame) -> DataFrame:
    """(column_name, value, change): values only the snapshot has are new, values only the baseline has are missing."""
    change = F.when(F.col("n_first") == 0, "new").when(F.col("n_second") == 0, "missing")
    return counts.withColumn("change", change).where(F.col("change").isNotNull()).select("column_name", "value", "change")


def categorical_drift(
    baseline: DataFrame, snapshot: DataFrame, columns: list[str], use_p_value: bool = True
) -> DataFrame:
    """JS divergence plus a chi-square of snapshot counts against rescaled baseline counts."""
    return _categorical_rows(dist.paired_counts(baseline, snapshot, columns, "categorical"), columns, use_p_value)


def _categorical_rows(counts: DataFrame, columns: list[str], use_p_value: bool) -> DataFrame:
    measures = dist.frequency_measures(counts).select("column_name", "js", "items")
    sized = dist.with_totals(counts, "n_first", "n_second")
    expected = F.greatest(
        F.try_divide(F.col("n_first") * F.col("total_n_second"), F.col("total_n_first")), F.lit(dist.EPSILON)
    )
    chi = sized.groupBy("column_name").agg(
        F.sum(F.pow(F.col("n_second") - expected, F.lit(2)) / expected).alias("chi_square"),
        F.sum(F.when(F.col("n_first") == 0, 1).otherwise(0)).alias("new_categories"),
        F.sum(F.when(F.col("n_second") == 0, 1).otherwise(0)).alias("missing_categories"),
        F.max("total_n_first").alias("n_first"),
        F.max("total_n_second").alias("n_second"),
    )
    filled = (F.col("n_first") > 0) & (F.col("n_second") > 0)
    names = counts.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    rows = (
        F.broadcast(names)
        .join(F.broadcast(chi), "column_name", "left")
        .join(F.broadcast(measures), "column_name", "left")
        .withColumn("filled", F.coalesce(filled, F.lit(False)))
        .withColumn("drift_score", F.when(F.col("filled"), F.col("js")).otherwise(0.0))
        .withColumn(
            "p_value",
            F.when(
                F.col("filled"),
                chi_square_tail(F.coalesce("chi_square", F.lit(0.0)), F.coalesce(F.col("items") - 1, F.lit(0)).cast("double")),
            ).otherwise(1.0),
        )
    )
    empty = F.lit(None).cast("double")
    return rows.select(
        "column_name",
        F.lit("categorical").alias("column_type"),
        F.lit("chi_square").alias("test_used"),
        "drift_score",
        "p_value",
        F.when(~F.col("filled"), "green")
        .otherwise(alert_level(F.col("drift_score"), F.col("p_value") if use_p_value else None))
        .alias("alert_level"),
        *[empty.alias(c) for c in REPORT[6:11]],
        "chi_square",
        F.col("new_categories").cast("bigint").alias("new_categories"),
        F.col("missing_categories").cast("bigint").alias("missing_categories"),
    )


def drift_report(
    baseline: DataFrame, snapshot: DataFrame, columns: list[str] | None = None, use_p_value: bool = True
) -> DataFrame:
    """One row per common column."""
    shared = [c for c in dist.common_columns(baseline, snapshot) if columns is None or c in columns]
    numbers = [c for c in shared if c in dist.numeric_columns(baseline, booleans=True)]
    texts = [c for c in shared if c in dist.categorical_columns(baseline)]
    parts = []
    if numbers:
        parts.append(numeric_drift(baseline, snapshot, numbers, use_p_value))
    if texts:
        parts.append(categorical_drift(baseline, snapshot, texts, use_p_value))
    if not parts:
        raise ValueError("the tables share no numeric or text column")
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report


class BaselineProfile:
    """What a baseline leaves behind: value counts and moments of its columns, stored; its rows are read once.

    Counts of parts of a baseline add up, so a profile can be grown by :func:`grown_profile`.
    """

    def __init__(self, numbers, texts, cuts, values, categories, moments):
        self.numbers, self.texts, self.cuts = numbers, texts, cuts
        self.values, self.categories, self.moments = values, categories, moments


def baseline_profile(baseline: DataFrame, columns: list[str] | None = None) -> BaselineProfile:
    kept = [c for c in baseline.columns if columns is None or c in columns]
    numbers = [c for c in kept if c in dist.numeric_columns(baseline, booleans=True)]
    texts = [c for c in kept if c in dist.categorical_columns(baseline)]
    if not numbers and not texts:
        raise ValueError("the baseline has no numeric or text column")
    cuts = dist.fit_cut_points([baseline], numbers) if numbers else {}
    values = cut_lineage(dist.ordered_counts(baseline, numbers, cuts)) if numbers else None
    categories = cut_lineage(dist.long_text(baseline, texts).groupBy("column_name", "value").agg(F.count("*").alias("n"))) if texts else None
    return BaselineProfile(numbers, texts, cuts, values, categories, cut_lineage(_moments(values)) if numbers else None)


def _moments(values: DataFrame) -> DataFrame:
    """Count, mean and deviation of each column from its value counts."""
    n = F.sum("n").alias("n")
    means = values.groupBy("column_name").agg(n, (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    gaps = values.join(F.broadcast(means.select("column_name", "mean")), "column_name")  # one row per column
    squares = gaps.groupBy("column_name").agg(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2))).alias("_s"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_s") / (F.col("n") - 1)))
    return means.join(F.broadcast(squares), "column_name").select("column_name", "n", "mean", std.alias("std"))


def grown_profile(profile: BaselineProfile, more: DataFrame) -> BaselineProfile:
    """The profile of the old rows and the new ones; only the new ones are read."""
    values, categories = profile.values, profile.categories
    if values is not None:
        added = values.unionByName(dist.ordered_counts(more, profile.numbers, profile.cuts))
        values = cut_lineage(added.groupBy("column_name", "bucket", "value").agg(F.sum("n").alias("n")))
    if categories is not None:
        new = dist.long_text(more, profile.texts).groupBy("column_name", "value").agg(F.count("*").alias("n"))
        categories = cut_lineage(categories.unionByName(new).groupBy("column_name", "value").agg(F.sum("n").alias("n")))
    moments = cut_lineage(_moments(values)) if values is not None else None
    return BaselineProfile(profile.numbers, profile.texts, profile.cuts, values, categories, moments)


def profile_drift(profile: BaselineProfile, snapshot: DataFrame, use_p_value: bool = True) -> DataFrame:
    """The drift report of a snapshot against a stored profile; no row of the baseline is read."""

    def paired(base: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        first = base.select(*keys, F.col("n").alias("n_first"), zero.alias("n_second"))
        second = counted.select(*keys, zero.alias("n_first"), F.col("n").alias("n_second"))
        return first.unionByName(second).groupBy(*keys).agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"))

    parts = []
    if profile.numbers:
        counted = dist.ordered_counts(snapshot, profile.numbers, profile.cuts)
        ks = dist.ks_distance(paired(profile.values, counted, ["column_name", "bucket", "value"]))
        sides = [
            t.select("column_name", *[F.col(c).alias(f"{c}_{side}") for c in ("n", "mean", "std")])
            for t, side in ((profile.moments, "first"), (dist.summarise(snapshot, profile.numbers), "second"))
        ]
        summary = sides[1].join(F.broadcast(sides[0]), "column_name", "left").na.fill(0, ["n_first"])
        parts.append(_numeric_rows(ks, summary, use_p_value))
    if profile.texts:
        counted = dist.long_text(snapshot, profile.texts).groupBy("column_name", "value").agg(F.count("*").alias("n"))
        parts.append(_categorical_rows(paired(profile.categories, counted, ["column_name", "value"]), profile.texts, use_p_value))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drift_summary(report: DataFrame) -> DataFrame:
    """Mean score (at most 1) and the number of columns at each alert level."""
    return report.agg(
        F.count("*").alias("columns"),
        F.least(F.lit(1.0), F.avg("drift_score")).alias("overall_score"),
        *[F.count(F.when(F.col("alert_level") == a, 1)).alias(f"{a}_columns") for a in ("red", "yellow", "green")],
    )


# --- conditional shift: P(target | feature bin) -----------------------------


def quantile_edges(df: DataFrame, columns: list[str], bins: int = 5) -> dict[str, list[float]]:
    """Distinct quantile edges of each column; columns x (bins + 1) numbers."""
    found = dist.quantile_map(df, columns, [i / bins for i in range(bins + 1)])
    return {c: sorted(set(found[c].values())) for c in columns}


def bin_index(value: Column, edges: list[float]) -> Column:
    """Right-closed bin with the lowest edge included; null outside the edges."""
    chain = None
    for i in range(1, len(edges)):
        hit = value <= F.lit(edges[i])
        if i == 1:
            hit = hit & (value >= F.lit(edges[0]))
            chain = F.when(value < F.lit(edges[0]), F.lit(None).cast("int")).when(hit, 0)
        else:
            chain = chain.when(hit, i - 1)
    return F.lit(None).cast("int") if chain is None else chain


def _binned(df: DataFrame, target: str, numbers: dict[str, list[float]], texts: list[str], side: str) -> DataFrame:
    """(feature, bin, target, side) rows that have both the feature and the target."""
    kept = df.where(F.col(target).isNotNull())
    spots = [F.struct(F.lit(c).alias("feature"), bin_index(dist.numeric(c), e).cast("string").alias("bin")) for c, e in numbers.items()]
    spots += [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin")) for c in texts]
    return (
        kept.select(F.col(target).alias("target"), F.explode(F.array(*spots)).alias("s"))
        .select("s.feature", "s.bin", "target", F.lit(side).alias("side"))
        .where(F.col("bin").isNotNull())
    )


def conditional_bins(
    baseline: DataFrame, snapshot: DataFrame, target: str, features: list[str] | None = None, bins: int = 5
) -> DataFrame:
    """Difference of the target between the tables inside every common feature bin: (feature, bin, diff, ...).

    A numeric target compares bin means over the baseline's range; a text target compares bin distributions by
    JS divergence.  Both are capped at 1.
    """
    shared = [c for c in dist.common_columns(baseline, snapshot) if c != target and (features is None or c in features)]
    numbers = [c for c in shared if c in dist.numeric_columns(baseline, booleans=True)]
    texts = [c for c in shared if c in dist.categorical_columns(baseline)]
    edges = {}
    if numbers:
        fitted = quantile_edges(baseline.where(F.col(target).isNotNull()), numbers, bins)
        edges = {c: e for c, e in fitted.items() if len(e) > 1}
    rows = _binned(baseline, target, edges, texts, "b").unionByName(_binned(snapshot, target, edges, texts, "s"))
    is_base = F.col("side") == "b"
    if target in dist.numeric_columns(baseline, booleans=True):
        y = F.col("target").cast("double")
        spread = baseline.agg((F.max(dist.numeric(target)) - F.min(dist.numeric(target))).alias("spread"))
        binned = rows.groupBy("feature", "bin").agg(
            F.count(F.when(is_base, 1)).alias("n_baseline"),
            F.count(F.when(~is_base, 1)).alias("n_snapshot"),
            F.avg(F.when(is_base, y)).alias("baseline_mean"),
            F.avg(F.when(~is_base, y)).alias("snapshot_mean"),
        )
        gap = F.abs(F.col("baseline_mean") - F.col("snapshot_mean"))
        diff = F.when(F.col("spread") > 0, F.least(F.lit(1.0), gap / F.col("spread"))).otherwise(0.0)
        scored = attach(binned, spread).withColumn("diff", diff).drop("spread")
    else:
        counts = rows.groupBy("feature", "bin", F.col("target").cast("string").alias("target")).agg(
            F.count(F.when(is_base, 1)).alias("n_first"), F.count(F.when(~is_base, 1)).alias("n_second")
        )
        totals = counts.groupBy("feature", "bin").agg(
            F.sum("n_first").alias("n_baseline"), F.sum("n_second").alias("n_snapshot")
        )
        keyed = counts.join(totals, ["feature", "bin"]).where("n_baseline > 0 AND n_snapshot > 0")
        items = keyed.select(
            F.to_json(F.struct("feature", "bin")).alias("column_name"), F.col("target").alias("value"), "n_first", "n_second"
        )
        js = dist_js_by_group(items)
        scored = totals.withColumn("column_name", F.to_json(F.struct("feature", "bin"))).join(js, "column_name")
        scored = scored.withColumn("diff", F.least(F.lit(1.0), F.col("js"))).drop("column_name", "js")
    return scored.where("n_baseline > 0 AND n_snapshot > 0")


def dist_js_by_group(items: DataFrame) -> DataFrame:
    """JS divergence per group for group counts that may be many: no broadcast of the group totals."""
    totals = items.groupBy("column_name").agg(
        F.sum("n_first").alias("tf"), F.sum("n_second").alias("ts"), F.count("*").alias("k")
    )
    e = F.lit(dist.EPSILON)
    norm = F.lit(1.0) + F.col("k") * e
    p = (F.col("n_first") / F.col("tf") + e) / norm
    q = (F.col("n_second") / F.col("ts") + e) / norm
    rows = items.join(totals, "column_name").withColumn("p", p).withColumn("q", q)
    m = (F.col("p") + F.col("q")) / 2
    return rows.groupBy("column_name").agg(
        (F.sum(F.col("p") * F.log(F.col("p") / m)) / 2 + F.sum(F.col("q") * F.log(F.col("q") / m)) / 2).alias("js")
    )


def conditional_features(binned: DataFrame, least_rows: int = 5) -> DataFrame:
    """Mean bin difference per feature with its alert; features with too few rows on a side are left out."""
    return (
        binned.groupBy("feature")
        .agg(
            F.avg("diff").alias("conditional_drift_score"),
            F.count("*").alias("bins"),
            F.sum("n_baseline").alias("rows_baseline"),
            F.sum("n_snapshot").alias("rows_snapshot"),
        )
        .where((F.col("rows_baseline") >= least_rows) & (F.col("rows_snapshot") >= least_rows))
        .withColumn("alert_level", alert_level(F.col("conditional_drift_score")))
    )


def conditional_top(features: DataFrame, k: int = 3) -> DataFrame:
    """The k features that moved most; there is one row per column, so one window task is enough."""
    order = W.orderBy(F.desc("conditional_drift_score"), "feature")
    ranked = features.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k).select("position", "feature", "conditional_drift_score", "alert_level")


def conditional_overall(features: DataFrame) -> DataFrame:
    return features.agg(
        F.least(F.lit(1.0), F.coalesce(F.avg("conditional_drift_score"), F.lit(0.0))).alias("overall_score"),
        F.count("*").alias("features"),
    )
