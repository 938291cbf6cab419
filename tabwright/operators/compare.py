"""Comparison of two tables: distributions, structure, correlation, pair tests, distance, privacy."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.functions.special import chi_square_tail, kolmogorov_tail, student_two_sided
from tabwright.operators import distributions as dist
from tabwright.operators.joins import fact_join
from tabwright.operators.nearest import nearest
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage


# --- matrices ---------------------------------------------------------------


def pair_matrix(df: DataFrame, columns: list[str], measure: str = "corr") -> DataFrame:
    """(a, b, value) for every ordered pair, pairwise complete, from one aggregate over the table.

    ``measure`` is ``corr`` or ``cov``.
    """
    fn = {"corr": F.corr, "cov": F.covar_samp}[measure]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.select(*[dist.numeric(c).alias(c) for c in columns]).agg(
        *[fn(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    entries = []
    for i, (a, b) in enumerate(pairs):
        value = F.col(f"p{i}") if a != b or measure != "corr" else F.when(F.col(f"p{i}").isNotNull(), 1.0)
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("value")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), value.alias("value")))
    return row.select(F.inline(F.array(*entries)))


def matrix_difference(first: DataFrame, second: DataFrame, columns: list[str], measure: str = "corr") -> DataFrame:
    """One row: mean absolute difference over all cells, diagonal included."""
    m = pair_matrix(first, columns, measure).withColumnRenamed("value", "x")
    n = pair_matrix(second, columns, measure).withColumnRenamed("value", "y")
    return m.join(F.broadcast(n), ["a", "b"]).agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_difference"))


def correlation_preservation(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """One row: Pearson correlation of the two upper triangles, floored at 0; 1.0 with fewer than two columns."""
    if len(columns) < 2:
        return first.sparkSession.range(1).select(F.lit(1.0).alias("correlation_score"))
    m = pair_matrix(first, columns).where("a < b").withColumnRenamed("value", "x")
    n = pair_matrix(second, columns).where("a < b").withColumnRenamed("value", "y")
    score = F.corr("x", "y")
    return m.join(F.broadcast(n), ["a", "b"]).agg(
        F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(score), score), F.lit(0.0))).alias("correlation_score")
    )


def rank_table(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The table with every column replaced by its average rank (nulls stay null).

    Ranks come from the two-level running counts, one row per distinct value, and are joined back per column.
    """
    ranks = cut_lineage(dist.average_ranks(df, columns))
    out = df.select(*key, *[dist.numeric(c).alias(c) for c in columns])
    for c in columns:
        part = ranks.where(F.col("column_name") == c).select(F.col("value").alias(c), F.col("n").alias(f"_n__{c}"), F.col("rank").alias(f"_rank__{c}"))
        out = fact_join(out, part, [c], f"_n__{c}")
    return out.select(*key, *[F.col(f"_rank__{c}").alias(c) for c in columns])


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, value): Spearman's rank correlation of every pair."""
    return pair_matrix(rank_table(df, columns, []), columns)


def spearman_preservation(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean absolute difference and Pearson correlation of the two rank-correlation triangles."""
    m = spearman_matrix(first, columns).where("a < b").withColumnRenamed("value", "x")
    n = spearman_matrix(second, columns).where("a < b").withColumnRenamed("value", "y")
    return m.join(F.broadcast(n), ["a", "b"]).agg(
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_difference"),
        F.greatest(F.lit(0.0), F.coalesce(F.corr("x", "y"), F.lit(0.0))).alias("spearman_score"),
    )


# --- column quality ---------------------------------------------------------


def numeric_similarity(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """KS, KL, JS, overlap and moment differences per numeric column."""
    cuts = dist.fit_cut_points([first, second], columns)
    ks = dist.ks_distance(dist.ordered_paired_counts(first, second, columns, cuts)).select("column_name", "ks")
    measures = dist.frequency_measures(dist.joint_histogram(first, second, columns)).drop("items")
    joined = dist.paired_summary(first, second, columns).join(F.broadcast(measures), "column_name")
    joined = joined.join(F.broadcast(ks), "column_name", "left")
    harmonic = F.try_divide(F.col("n_first") * F.col("n_second"), F.col("n_first") + F.col("n_second"))
    return joined.select(
        "column_name",
        F.lit("numeric").alias("column_type"),
        "ks",
        kolmogorov_tail(F.sqrt(harmonic) * F.col("ks")).alias("ks_p_value"),
        F.abs(F.col("mean_first") - F.col("mean_second")).alias("mean_difference"),
        F.abs(F.col("std_first") - F.col("std_second")).alias("std_difference"),
        F.try_divide("std_second", "std_first").alias("std_ratio"),
        "kl",
        "js",
        "overlap",
        F.lit(None).cast("double").alias("chi_square_distance"),
    )


def categorical_similarity(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    none = F.lit(None).cast("double")
    measures = dist.frequency_measures(dist.paired_counts(first, second, columns, "categorical"))
    return measures.select(
        "column_name",
        F.lit("categorical").alias("column_type"),
        *[none.alias(c) for c in ("ks", "ks_p_value", "mean_difference", "std_difference", "std_ratio")],
        "kl",
        "js",
        "overlap",
        "chi_square_distance",
    )


def quality_score(js: Column, p_value: Column) -> Column:
    """1 - JS clipped to [0, 1]; the KS p-value where only that exists, else 0.7."""
    from_js = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - js))
    return F.coalesce(from_js, p_value, F.lit(0.7))


def column_similarity(first: DataFrame, second: DataFrame, columns: list[str] | None = None) -> DataFrame:
    shared = [c for c in dist.common_columns(first, second) if columns is None or c in columns]
    numbers = [c for c in shared if c in dist.numeric_columns(first, booleans=True)]
    texts = [c for c in shared if c in dist.categorical_columns(first)]
    parts = []
    if numbers:
        parts.append(numeric_similarity(first, second, numbers))
    if texts:
        parts.append(categorical_similarity(first, second, texts))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("quality_score", quality_score(F.col("js"), F.col("ks_p_value")))


# --- pair tests -------------------------------------------------------------


def t_test(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) of Student's two-sample test with pooled variance."""
    dof = n1 + n2 - 2
    pooled = F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, dof)
    inverse = F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)
    return F.try_divide(m1 - m2, F.sqrt(pooled * inverse)), dof.cast("double")


def pairwise_t_tests(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Column against column within each table: does the verdict at 0.05 agree?

    Also says whether each column's own mean differs between the tables.  Works on one row per column.
    """
    s = dist.paired_summary(first, second, columns)
    a = s.select(*[F.col(c).alias(f"a_{c}") for c in s.columns])
    b = s.select(*[F.col(c).alias(f"b_{c}") for c in s.columns])
    pairs = a.join(F.broadcast(b), F.col("a_column_name") < F.col("b_column_name"))
    out = pairs
    for side in ("first", "second"):
        t, dof = t_test(*[F.col(f"{p}_{m}_{side}") for p in "ab" for m in ("n", "mean", "std")])
        out = out.withColumn(f"t_{side}", t).withColumn(f"p_{side}", student_two_sided(t, dof))
    return out.select(
        F.col("a_column_name").alias("column_a"),
        F.col("b_column_name").alias("column_b"),
        "t_first",
        "p_first",
        "t_second",
        "p_second",
        ((F.col("p_first") < 0.05) == (F.col("p_second") < 0.05)).alias("consistent"),
    )


def mean_tests(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Each column against itself in the other table."""
    s = dist.paired_summary(first, second, columns)
    t, dof = t_test(*[F.col(f"{m}_{side}") for side in ("first", "second") for m in ("n", "mean", "std")])
    p = student_two_sided(t, dof)
    return s.select("column_name", t.alias("t"), p.alias("p_value"), (p < 0.05).alias("means_differ"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(value_a, value_b, n) with both marginals, for rows that have both values."""
    counts = (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).cast("string").alias("value_a"), F.col(b).cast("string").alias("value_b"))
        .agg(F.count("*").alias("n"))
    )
    rows = counts.groupBy("value_a").agg(F.sum("n").alias("n_a"))
    columns = counts.groupBy("value_b").agg(F.sum("n").alias("n_b"))
    return counts.join(rows, "value_a").join(columns, "value_b")


def chi_square_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (column_a, column_b, chi_square, dof) over the full grid, Yates-corrected when it is 2 x 2.

    Cells that never occur add their expected count.  Since sum(e) over all cells is N, they are accounted for
    by N minus the expected counts of the seen cells: no grid of empty cells is ever built.
    """
    cells = contingency(df, a, b)
    sizes = cells.agg(
        F.sum("n").alias("total"), F.count_distinct("value_a").alias("k_a"), F.count_distinct("value_b").alias("k_b")
    )
    rows = attach(cells, sizes).withColumn("e", F.col("n_a") * F.col("n_b") / F.col("total"))
    gap = F.abs(F.col("n") - F.col("e"))
    corrected = F.when((F.col("k_a") == 2) & (F.col("k_b") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    summed = rows.agg(
        F.sum(corrected * corrected / F.col("e")).alias("seen"),
        F.sum("e").alias("seen_e"),
        F.count("*").alias("cells"),
        F.max("total").alias("total"),
        F.max("k_a").alias("k_a"),
        F.max("k_b").alias("k_b"),
    )
    # An empty cell of a 2 x 2 table is corrected too: (e - min(0.5, e))^2 / e with e = total - seen_e.
    empty = F.col("total") - F.col("seen_e")
    two = (F.col("k_a") == 2) & (F.col("k_b") == 2) & (F.col("cells") == 3)
    shrunk = empty - F.least(F.lit(0.5), empty)
    rest = F.when(F.col("cells") == F.col("k_a") * F.col("k_b"), 0.0).when(two, shrunk * shrunk / empty).otherwise(empty)
    dof = (F.col("k_a") - 1) * (F.col("k_b") - 1)
    return summed.select(
        F.lit(a).alias("column_a"),
        F.lit(b).alias("column_b"),
        F.when(dof > 0, F.col("seen") + rest).otherwise(0.0).alias("chi_square"),
        dof.alias("dof"),
    )


def pairwise_chi_square(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """Independence test of every pair of text columns in both tables and whether the verdicts agree."""
    parts = []
    for a, b in combinations(columns, 2):
        x = chi_square_independence(first, a, b).select("column_a", "column_b", F.col("chi_square").alias("chi_first"), F.col("dof").alias("dof_first"))
        y = chi_square_independence(second, a, b).select("column_a", "column_b", F.col("chi_square").alias("chi_second"), F.col("dof").alias("dof_second"))
        parts.append(x.join(F.broadcast(y), ["column_a", "column_b"]))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.withColumn("p_first", chi_square_tail("chi_first", F.col("dof_first").cast("double")))
    rows = rows.withColumn("p_second", chi_square_tail("chi_second", F.col("dof_second").cast("double")))
    return rows.withColumn("consistent", (F.col("p_first") < 0.05) == (F.col("p_second") < 0.05))


# --- structure --------------------------------------------------------------


def schema_match(first: DataFrame, second: DataFrame) -> DataFrame:
    """(column_name, status, type_first, type_second, same_type): metadata only, one row per column."""
    spark = first.sparkSession
    names = "column_name string, kind string"
    a = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in first.schema.fields], names)
    b = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in second.schema.fields], names)
    joined = a.withColumnRenamed("kind", "type_first").join(b.withColumnRenamed("kind", "type_second"), "column_name", "full")
    status = F.when(F.col("type_second").isNull(), "missing").when(F.col("type_first").isNull(), "extra").otherwise("common")
    return joined.select(
        "column_name", status.alias("status"), "type_first", "type_second",
        F.coalesce(F.col("type_first") == F.col("type_second"), F.lit(False)).alias("same_type"),
    )


def missing_patterns(first: DataFrame, second: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, missing_first, missing_second, score): percentages of nulls and how close they are."""
    shared = [c for c in dist.common_columns(first, second) if columns is None or c in columns]

    def shares(df, suffix):
        row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"m__{c}") for c in shared])
        return dist.stack_row(row, shared, ["m"]).withColumnRenamed("m", f"missing_{suffix}")

    joined = shares(first, "first").join(F.broadcast(shares(second, "second")), "column_name")
    gap = F.abs(F.col("missing_first") - F.col("missing_second"))
    return joined.withColumn("score", F.greatest(F.lit(0.0), F.lit(1.0) - gap / 10))


def value_ranges(first: DataFrame, second: DataFrame, columns: list[str] | None = None, margin: float = 0.1) -> DataFrame:
    """Is the second table within the first one's range plus a margin, and how well are both ends kept?"""
    shared = set(dist.common_columns(first, second))
    numbers = [c for c in dist.numeric_columns(first) if c in shared and (columns is None or c in columns)]
    s = dist.paired_summary(first, second, numbers)
    width = F.col("max_first") - F.col("min_first")
    inside = (F.col("min_second") >= F.col("min_first") - margin * width) & (
        F.col("max_second") <= F.col("max_first") + margin * width
    )
    gaps = (F.abs(F.col("min_first") - F.col("min_second")) + F.abs(F.col("max_first") - F.col("max_second"))) / width
    score = F.when(width > 0, F.greatest(F.lit(0.0), F.lit(1.0) - gaps / 2)).otherwise(
        F.when(F.col("min_first") == F.col("min_second"), 1.0).otherwise(0.0)
    )
    return s.select(
        "column_name", "min_first", "max_first", "min_second", "max_second",
        inside.alias("within_bounds"), score.alias("score"),
    )


def cardinality(first: DataFrame, second: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct counts, share of categories kept, distinct ratio and their mean per non-numeric column."""
    shared = set(dist.common_columns(first, second))
    numbers = set(dist.numeric_columns(first))
    texts = [c for c in first.columns if c in shared and c not in numbers and (columns is None or c in columns)]
    counts = dist.paired_counts(first, second, texts, "categorical")
    one, two = F.col("n_first") > 0, F.col("n_second") > 0
    rows = counts.groupBy("column_name").agg(
        F.count(F.when(one, 1)).alias("distinct_first"),
        F.count(F.when(two, 1)).alias("distinct_second"),
        F.count(F.when(one & two, 1)).alias("kept"),
        F.count(F.when(one & ~two, 1)).alias("missing_categories"),
        F.count(F.when(~one & two, 1)).alias("new_categories"),
    )
    preserved = F.coalesce(F.try_divide("kept", "distinct_first"), F.lit(1.0))
    ratio = F.coalesce(
        F.try_divide(F.least("distinct_first", "distinct_second"), F.greatest("distinct_first", "distinct_second")), F.lit(1.0)
    )
    ratio = F.when(F.col("distinct_first") > 0, ratio).otherwise(F.when(F.col("distinct_second") == 0, 1.0).otherwise(0.0))
    return rows.select(
        "column_name", "distinct_first", "distinct_second",
        preserved.alias("category_preservation"), ratio.alias("cardinality_ratio"),
        ((preserved + ratio) / 2).alias("score"), "missing_categories", "new_categories",
    )


def null_rates(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: mean of per-column null rates, row counts, and their similarity."""

    def side(df, suffix):
        rates = [F.avg(F.col(c).isNull().cast("double")) for c in df.columns]
        return df.agg(
            F.coalesce(reduce(lambda x, y: x + y, rates) / len(rates) * 100, F.lit(0.0)).alias(f"null_rate_{suffix}"),
            F.count("*").alias(f"rows_{suffix}"),
        )

    both = attach(side(first, "first"), side(second, "second"))
    gap = F.abs(F.col("null_rate_first") - F.col("null_rate_second"))
    return both.withColumn("score", F.greatest(F.lit(0.0), F.lit(1.0) - gap / 10))


def structural_score(first: DataFrame, second: DataFrame) -> DataFrame:
    """(component, score): the five structural parts and, last, their mean."""
    schema = schema_match(first, second)
    common = F.count(F.when(F.col("status") == "common", 1))
    same = F.count(F.when((F.col("status") == "common") & F.col("same_type"), 1))
    parts = [
        schema.agg(F.coalesce(F.try_divide(same, common), F.lit(0.0)).alias("score")).select(F.lit("schema").alias("component"), "score"),
        missing_patterns(first, second).agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("score")).select(F.lit("missing_pattern").alias("component"), "score"),
        null_rates(first, second).select(F.lit("data_quality").alias("component"), "score"),
    ]
    shared = set(dist.common_columns(first, second))
    if [c for c in dist.numeric_columns(first) if c in shared]:
        ranges = value_ranges(first, second).agg(F.avg("score").alias("score"))
    else:
        ranges = first.sparkSession.range(1).select(F.lit(1.0).alias("score"))
    parts.append(ranges.select(F.lit("value_range").alias("component"), "score"))
    if [c for c in first.columns if c in shared and c not in dist.numeric_columns(first)]:
        kept = cardinality(first, second).agg(F.avg("score").alias("score"))
    else:
        kept = first.sparkSession.range(1).select(F.lit(1.0).alias("score"))
    parts.append(kept.select(F.lit("cardinality").alias("component"), "score"))
    rows = reduce(DataFrame.unionByName, parts)
    # Five rows: rollup adds their mean in the same pass.
    return rows.rollup("component").agg(F.avg("score").alias("score")).select(
        F.coalesce("component", F.lit("overall")).alias("component"), "score"
    )


# --- distance to the closest record -----------------------------------------


def closest_record(original: DataFrame, synthetic: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, distance): Euclidean distance, in the original's z-scores, from every synthetic row to its nearest original.

    A missing dimension on either side contributes nothing; without originals the distance is null.
    """
    stats = original.agg(
        *[F.avg(dist.numeric(c)).alias(f"mean__{c}") for c in columns],
        *[F.stddev_samp(dist.numeric(c)).alias(f"std__{c}") for c in columns],
    ).first()

    def scaled(df, *more):
        z = [((dist.numeric(c) - F.lit(stats[f"mean__{c}"])) / (F.lit(stats[f"std__{c}"]) + 1e-10)).alias(f"_z__{c}") for c in columns]
        return df.select(*more, *z)

    row = F.monotonically_increasing_id()
    probes = cut_lineage(scaled(synthetic, *[F.col(k).alias(k) for k in keys]).withColumn("id", row))
    points = scaled(original).withColumn("id", -row - 1)  # no query's number
    found = nearest(probes, points, [f"_z__{c}" for c in columns], 1)
    return probes.join(found, "id").select(*keys, F.get("distance", F.lit(0)).alias("distance"))


def exact_copies(original: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many synthetic rows, over the whole table, repeat an original row in every numeric column.

    Values are compared as they are.  The original side is deduplicated and the synthetic side counted per distinct row
    before the join, so a row repeated a billion times is one row of the join.
    """
    values = [dist.numeric(c).alias(c) for c in columns]
    known = original.select(*values).distinct()
    wanted = synthetic.select(*values).groupBy(*columns).agg(F.count("*").alias("n"))
    same = reduce(lambda x, y: x & y, [F.col(f"w.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns])
    found = wanted.alias("w").join(known.alias("k"), same, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("copies"))
    return attach(found, synthetic.agg(F.count("*").alias("rows"))).withColumn("copy_rate", F.try_divide("copies", "rows"))


def privacy_from_distance(distances: DataFrame) -> DataFrame:
    """One row: mean distance, exact matches (< 0.01), and the piecewise privacy score."""
    row = distances.agg(
        F.avg("distance").alias("mean_distance"),
        F.count_if(F.col("distance") < 0.01).alias("exact_matches"),
        F.count("distance").alias("n"),
    )
    d = F.col("mean_distance")
    base = (
        F.when(d < 0.01, 0.1)
        .when(d < 0.5, 0.2 + d / 0.5 * 0.3)
        .when(d < 1.0, 0.5 + (d - 0.5) / 0.5 * 0.2)
        .when(d < 2.0, 0.7 + (d - 1.0) * 0.15)
        .otherwise(F.least(F.lit(0.95), 0.85 + (d - 2.0) / 3.0 * 0.10))
    )
    rate = F.try_divide("exact_matches", "n")
    score = F.when(
        F.col("exact_matches") > 0, F.greatest(F.lit(0.1), base - F.least(F.lit(0.15), rate * 0.3))
    ).otherwise(base)
    return row.select("mean_distance", "exact_matches", rate.alias("exact_match_rate"), score.alias("privacy_score"))


def privacy_score(original: DataFrame, synthetic: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    if not columns:
        none = F.lit(None).cast("double")
        return original.sparkSession.range(1).select(
            none.alias("mean_distance"), F.lit(0).cast("bigint").alias("exact_matches"),
            none.alias("exact_match_rate"), F.lit(0.8).alias("privacy_score"),
        )
    return privacy_from_distance(closest_record(original, synthetic, columns, keys))


def anonymity(df: DataFrame, quasi: list[str], sensitive: str, threshold: int = 5) -> DataFrame:
    """One row of re-identification and disclosure figures over classes of equal quasi-identifiers.

    ``k`` is the smallest class, ``share_at_risk`` the share of rows in classes smaller than the threshold, and
    ``l`` the fewest distinct sensitive values in a class.
    """
    # Two levels: values are deduplicated per class before classes are formed, so a hot class is never one group of rows.
    cells = df.groupBy(*quasi, F.col(sensitive).alias("_s")).agg(F.count("*").alias("_n"))
    classes = cells.groupBy(*quasi).agg(F.sum("_n").alias("size"), F.count("_s").alias("values"))
    return classes.agg(
        F.count("*").alias("classes"),
        F.min("size").alias("k"),
        F.avg("size").alias("mean_class_size"),
        (F.sum(F.when(F.col("size") < threshold, F.col("size")).otherwise(0)) / F.sum("size")).alias("share_at_risk"),
        F.min("values").alias("l"),
        (F.sum(F.when(F.col("values") == 1, F.col("size")).otherwise(0)) / F.sum("size")).alias("share_disclosed"),
    )


# --- the whole report -------------------------------------------------------


def overall_quality(column_score: Column, correlation: Column, privacy: Column, novel: Column | None = None) -> Column:
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    base = clip(0.5 * F.coalesce(column_score, F.lit(0.5)) + 0.3 * correlation + 0.2 * privacy)
    return base if novel is None else clip(0.7 * base + 0.3 * novel)


def comparison_report(
    original: DataFrame, synthetic: DataFrame, keys: list[str], columns: list[str] | None = None, novel: DataFrame | None = None
) -> DataFrame:
    """One summary row: quality parts, best and worst column by JS, structure, and agreement of the pair tests.

    ``novel`` is an optional one-row table with ``novel_score`` from the model-based metrics.
    """
    shared = [c for c in dist.common_columns(original, synthetic) if c not in keys and (columns is None or c in columns)]
    numbers = [c for c in shared if c in dist.numeric_columns(original)]
    texts = [c for c in shared if c in dist.categorical_columns(original)]
    similar = column_similarity(original, synthetic, shared).agg(
        F.avg("quality_score").alias("column_score"),
        F.min_by("column_name", "js").alias("best_column"),
        F.max_by("column_name", "js").alias("worst_column"),
    )
    parts = [
        correlation_preservation(original, synthetic, numbers),
        privacy_score(original, synthetic, numbers, keys).select("mean_distance", "exact_match_rate", "privacy_score"),
        structural_score(original.select(*shared), synthetic.select(*shared)).where("component = 'overall'").select(F.col("score").alias("structural_score")),
    ]
    tests = []
    if len(numbers) > 1:
        tests.append(pairwise_t_tests(original, synthetic, numbers).select("consistent"))
    if len(texts) > 1:
        tests.append(pairwise_chi_square(original, synthetic, texts).select("consistent"))
    if tests:
        agreed = reduce(DataFrame.union, tests).agg(F.avg(F.col("consistent").cast("double")).alias("consistent_share"))
        parts.append(agreed)
    if novel is not None:
        parts.append(novel.select("novel_score"))
    row = similar
    for p in parts:  # one-row tables
        row = attach(row, p)
    score = overall_quality(F.col("column_score"), F.col("correlation_score"), F.col("privacy_score"), F.col("novel_score") if novel is not None else None)
    return row.withColumn("overall_quality", score)


def top_by_js(similarity: DataFrame) -> DataFrame:
    """Columns from the closest to the farthest distribution; one row per column."""
    return similar_rank(similarity, W.orderBy("js", "column_name"))


def similar_rank(similarity: DataFrame, order) -> DataFrame:
    return similarity.withColumn("position", F.row_number().over(order)).select("position", "column_name", "js", "quality_score")
