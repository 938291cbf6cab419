import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions.special import beta_lower, chi_square_tail, gamma_upper, kolmogorov_tail, normal_cdf, normal_quantile
from tabwright.operators import compare, drift
from tabwright.operators import distributions as dist
from tabwright.operators.indexing import expand_counts, with_digest_index, with_global_index, with_hashed_index


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


def ks(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    cuts = dist.fit_cut_points([x, y], ["v"], 8)
    return dist.ks_distance(dist.ordered_paired_counts(x, y, ["v"], cuts)).first()


def brute_ks(a, b):
    a, b = [np.array([v for v in s if v is not None]) for s in (a, b)]
    points = np.concatenate([a, b])
    return max(abs((a <= p).mean() - (b <= p).mean()) for p in points)


def test_ks_of_equal_samples_is_zero(spark):
    assert ks(spark, [1, 2, 3, 3], [1, 2, 3, 3]).ks == pytest.approx(0)


def test_ks_with_a_hot_value_and_nulls(spark):
    rng = np.random.default_rng(1)
    a = [5.0] * 400 + list(rng.normal(0, 3, 800)) + [None] * 20
    b = [5.0] * 100 + list(rng.normal(1, 3, 900)) + [float("nan")]
    assert ks(spark, a, b).ks == pytest.approx(brute_ks(a, [v for v in b if v == v]))


def test_quantiles_match_numpy_with_ties_and_spikes(spark):
    rng = np.random.default_rng(2)
    values = [0.0] * 300 + list(np.round(rng.exponential(2, 500), 1)) + [1e9]
    fractions = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = dist.quantile_map(frame(spark, values), ["v"], fractions)["v"]
    assert [got[q] for q in fractions] == pytest.approx(list(np.quantile(values, fractions)))
    grid = dist.quantile_grid(frame(spark, values), ["v"], 64)["v"]
    assert grid == pytest.approx(list(np.quantile(values, np.linspace(0, 1, 65))))


def test_quantile_of_one_row_and_of_none(spark):
    assert dist.quantile_map(frame(spark, [4]), ["v"], [0.5])["v"][0.5] == 4
    assert dist.quantile_map(frame(spark, [None]), ["v"], [0.5])["v"] == {}


def test_sketch_quantiles_are_close(spark):
    got = {r.fraction: r.quantile for r in dist.sketch_quantiles(frame(spark, range(1001)), ["v"], [0.25, 0.5]).collect()}
    assert got[0.5] == pytest.approx(500, abs=5) and got[0.25] == pytest.approx(250, abs=5)


def test_average_ranks(spark):
    ranks = {r.value: r["rank"] for r in dist.average_ranks(frame(spark, [3, 1, 3, 7]), ["v"]).collect()}
    assert ranks == {1.0: 1.0, 3.0: 2.5, 7.0: 4.0}


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    h = dist.joint_histogram(frame(spark, [0, 29]), frame(spark, [14.5]), ["v"]).collect()
    assert len(h) == 29
    by_bin = {r.bin: (r.n_first, r.n_second) for r in h}
    assert by_bin[0] == (1, 0) and by_bin[28] == (1, 0) and by_bin[14] == (0, 1)


def test_histogram_of_a_constant(spark):
    h = {r.bin: r.n_first for r in dist.joint_histogram(frame(spark, [2, 2]), frame(spark, [2]), ["v"]).collect()}
    assert sum(h.values()) == 2 and h[28] == 2


def test_js_bounds_and_symmetry(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    b = spark.createDataFrame([("z",), ("z",)], "c string")
    one = dist.frequency_measures(dist.paired_counts(a, b, ["c"], "categorical")).first()
    two = dist.frequency_measures(dist.paired_counts(b, a, ["c"], "categorical")).first()
    assert one.js == pytest.approx(two.js) and one.js <= math.log(2) + 1e-9
    assert one.js == pytest.approx(math.log(2), abs=1e-6) and one.overlap == 0


def test_p_values_against_tables(spark):
    assert gamma_upper(0.5, 3.841 / 2) == pytest.approx(0.05, abs=1e-4)
    assert gamma_upper(5, 18.307 / 2) == pytest.approx(0.05, abs=1e-4)
    assert beta_lower(5, 0.5, 10 / (10 + 2.228**2)) == pytest.approx(0.05, abs=1e-4)
    row = spark.range(1).select(
        kolmogorov_tail(F.lit(1.358)).alias("k"), kolmogorov_tail(F.lit(0.5)).alias("low"), normal_cdf(F.lit(1.959964)).alias("n"),
        normal_quantile(F.lit(0.975)).alias("q"), chi_square_tail(F.lit(3.841), F.lit(1.0)).alias("c"),
    ).first()
    assert row.k == pytest.approx(0.05, abs=1e-4) and row.low == pytest.approx(0.9639, abs=1e-3)
    assert row.n == pytest.approx(0.975, abs=1e-6) and row.q == pytest.approx(1.959964, abs=1e-5) and row.c == pytest.approx(0.05, abs=1e-4)


def test_drift_of_an_empty_side_is_green(spark):
    base = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v double, c string")
    rows = {r.column_name: r for r in drift.drift_report(base, base.limit(0)).collect()}
    assert rows["v"].drift_score == 0 and rows["v"].alert_level == "green" and rows["c"].p_value == 1


def test_new_category_turns_red_and_is_counted(spark):
    base = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    snap = spark.createDataFrame([("a",)] * 50 + [("new",)] * 50, "c string")
    r = drift.drift_report(base, snap).first()
    assert r.alert_level == "red" and r.new_categories == 1 and r.missing_categories == 1


def test_identical_tables_do_not_drift(spark):
    base = spark.createDataFrame([(float(i), "ab"[i % 2], i % 3 == 0) for i in range(60)], "v double, c string, f boolean")
    s = drift.drift_summary(drift.drift_report(base, base)).first()
    assert s.overall_score == pytest.approx(0) and s.green_columns == s.columns == 3


def test_quantile_bins_are_right_closed(spark):
    edges = [0.0, 1.0, 2.0]
    rows = frame(spark, [-1, 0, 1, 1.5, 2, 3]).select(drift.bin_index(F.col("v"), edges).alias("b")).collect()
    assert [r.b for r in rows] == [None, 0, 0, 1, 1, None]


def test_chi_square_matches_a_hand_computed_grid(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30, "p string, q string")
    cells = np.array([[10, 20], [30, 0]], float)
    e = cells.sum(1, keepdims=True) * cells.sum(0, keepdims=True) / cells.sum()
    gap = np.abs(cells - e)
    expected = (((gap - np.minimum(0.5, gap)) ** 2) / e).sum()
    r = compare.chi_square_independence(df, "p", "q").first()
    assert r.chi_square == pytest.approx(expected) and r.dof == 1


def test_closest_record_ignores_missing_dimensions(spark):
    original = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "k int, x double, y double")
    made = spark.createDataFrame([(1, 0.0, None), (2, 5.0, 5.0)], "k int, x double, y double")
    d = {r.k: r.distance for r in compare.closest_record(original, made, ["x", "y"], ["k"]).collect()}
    s = np.std([0, 10], ddof=1)
    assert d[1] == pytest.approx(0) and d[2] == pytest.approx(math.sqrt(2) * 5 / s)


def test_privacy_score_without_numbers(spark):
    t = spark.createDataFrame([("a",)], "c string")
    assert compare.privacy_score(t, t, [], ["c"]).first().privacy_score == 0.8


def test_identical_tables_compare_well(spark):
    t = spark.createDataFrame([(i, float(i % 17), float(i * i % 23), "abc"[i % 3], "xy"[i % 2]) for i in range(200)], "k int, v double, w double, c string, d string")
    r = compare.comparison_report(t, t, ["k"]).first()
    assert r.column_score == pytest.approx(1) and r.structural_score == pytest.approx(1) and r.consistent_share == 1 and r.exact_match_rate == 1


def test_spearman_of_a_monotone_pair(spark):
    t = spark.createDataFrame([(float(i), float(i**3)) for i in range(30)], "a double, b double")
    m = {(r.a, r.b): r.value for r in compare.spearman_matrix(t, ["a", "b"]).collect()}
    assert m["a", "b"] == pytest.approx(1)


def test_indexes_are_dense_and_ordered(spark):
    t = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(200)], "k string, i int")
    for out in (with_global_index(t, ["k", "i"], "n", 16), with_hashed_index(t, ["k", "i"], "n")):
        assert sorted(r.n for r in out.collect()) == list(range(500))
    rows = with_global_index(t, ["k", "i"], "n", 16).orderBy("n").collect()
    assert [(r.k, r.i) for r in rows] == sorted((r.k, r.i) for r in rows)
    d = t.withColumn("h", F.sha2(F.concat_ws("|", "k", "i"), 256))
    rows = with_digest_index(d, "h", ["k", "i"], "n").orderBy("n").collect()
    assert [r.h for r in rows] == sorted(r.h for r in rows)


def test_expand_counts_across_chunks(spark):
    t = spark.createDataFrame([("hot", 2500), ("one", 1), ("none", 0)], "k string, n bigint")
    got = expand_counts(t, "n", "j", chunk=100).groupBy("k").agg(F.count("*").alias("c"), F.count_distinct("j").alias("d"), F.max("j").alias("m"))
    assert {r.k: (r.c, r.d, r.m) for r in got.collect()} == {"hot": (2500, 2500, 2499), "one": (1, 1, 0)}
