import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import cdc, modelled, prep, profile, series
from tabwright.operators import relational as rel
from tabwright.operators import synthesis as syn
from tabwright.sources import tables


def test_csv_round_trip_and_refusals(spark, tmp_path):
    t = spark.createDataFrame([(1, "a,b", 2.5), (2, None, None)], "k int, c string, v double")
    tables.write_csv(t, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t.csv")).collect())) == [(1, "a,b", 2.5), (2, None, None)]
    assert list(tables.read_table_set(spark, str(tmp_path))) == ["t"]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_profile_types(spark):
    t = spark.createDataFrame([(i, float(i), i % 2 == 0, "ab"[i % 2], f"t{i}", "2024-01-05") for i in range(150)], "i int, f double, b boolean, c string, u string, d string")
    kinds = {r.column_name: r.column_type for r in profile.profile(t).collect()}
    assert kinds == {"i": "integer", "f": "float", "b": "boolean", "c": "categorical", "u": "text", "d": "categorical"}
    assert {r.column_name for r in profile.datetime_columns(t).where("is_datetime").collect()} == {"d"}
    roles = {r.column_name: r.semantic_type for r in profile.semantic_types(profile.profile(t)).collect()}
    assert roles["u"] == "id" and roles["i"] == "numerical"
    tasks = {(r.task, r.column_name) for r in profile.target_candidates(profile.profile(t)).collect()}
    assert ("classification", "c") in tasks and ("classification", "b") in tasks and ("regression", "i") not in tasks


def test_empty_table_profile(spark):
    t = spark.createDataFrame([], "i int, c string")
    rows = profile.profile(t).collect()
    assert [(r.rows, r.distinct_values, r.null_percentage) for r in rows] == [(0, 0, 0.0)] * 2


def test_sampling_step(spark):
    hourly = spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00",) for h in range(5)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert profile.sampling_step(hourly, "t").first().step_seconds == 3600
    uneven = hourly.where(F.hour("t") != 2)
    assert profile.sampling_step(uneven, "t").first().step_seconds == 86400


def test_monotone_check(spark):
    t = spark.createDataFrame([(i, float(i if i != 70 else 3)) for i in range(100)], "o int, v double")
    assert profile.is_ordered(t, "o", "v").first().ordered is False
    assert profile.is_ordered(t.where("o <> 70"), "o", "v").first().ordered is True


def test_conditions_and_roles(spark):
    t = spark.createDataFrame([(1, "x", True), (2, "y", False)], "v int, c string, b boolean")
    keep = lambda *c: sorted(r.v for r in prep.apply_conditions(t, list(c)).collect())
    assert keep({"column": "v", "operator": "gte", "value": "2"}) == [2]
    assert keep({"column": "b", "operator": "eq", "value": "true"}) == [1]
    assert keep({"column": "v", "operator": "gt", "value": 9}) == [1, 2]
    assert keep({"column": "v", "operator": "like", "value": 1}) == [1, 2]


def test_unknown_label_gets_minus_one(spark):
    t = spark.createDataFrame([("b",), ("a",)], "c string")
    codes = prep.label_codes(t, "c")
    out = prep.encode_labels(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", codes)
    assert sorted((str(r.c), r.c_code) for r in out.collect()) == [("None", -1), ("a", 0), ("z", -1)]


def two_versions(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, c string, v double")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b'", None), (4, "d", 4.0)], "k int, c string, v double")
    return old, new


def test_replaying_a_diff_gives_the_new_version(spark):
    old, new = two_versions(spark)
    events = cdc.snapshot_diff(old, new, "t", ["k"], "2024-01-01 00:00:00")
    assert {(r.operation, r.k) for r in events.select("operation", *cdc.event_key(events, ["k"])).collect()} == {("UPDATE", 2), ("DELETE", 3), ("INSERT", 4)}
    assert sorted(map(tuple, cdc.replay(events, ["k"], old).collect()), key=str) == sorted(map(tuple, new.collect()), key=str)
    statements = {r.statement for r in cdc.sql_statements(events, ["k"]).collect()}
    assert "UPDATE t SET c = 'b''', v = NULL WHERE k = 2;" in statements and "DELETE FROM t WHERE k = 3;" in statements


def test_event_lives_are_in_order_and_replay(spark, folder):
    t = spark.createDataFrame([(i, f"c{i % 5}", float(i), i % 7) for i in range(300)], "k bigint, c string, v double, f int")
    events = cdc.change_events(t, "t", ["k"], "2024-01-01 00:00:00", 24, ["f"], insert=0.2, update=0.6, delete=0.1).cache()
    rows = events.select("operation", "ts", "seq", "before", "after", *cdc.event_key(events, ["k"])).orderBy("k", "seq").collect()
    assert events.where("operation = 'INSERT'").count() == 300 and events.where("operation = 'UPDATE'").count() == 900
    previous = None
    for r in rows:
        if r.seq == 0:
            assert r.operation == "INSERT" and r.before is None
        else:
            assert r.ts > previous.ts and r.before == previous.after
        if r.operation == "UPDATE":
            changed = [c for c in ("c", "v", "f") if r.before[c] != r.after[c]]
            assert "f" not in changed and len(changed) <= 3
        previous = r
    gone = events.where("operation = 'DELETE'").count()
    assert cdc.replay(events, ["k"]).count() == 300 - gone


def test_broken_rows_are_each_flagged(spark):
    t = spark.createDataFrame([(i, i % 5, "s", float(i + 1), str(i)) for i in range(60)], "k bigint, f bigint, s string, v double, n string")
    bad = rel.break_rows(t, ["k"], "s", "f", "v", "n", 4)
    parents = {"p": spark.createDataFrame([(i,) for i in range(5)], "f bigint")}
    rules = [
        {"kind": "not_null", "columns": ["s"]}, {"kind": "check", "expression": "v > 0"}, {"kind": "data_type", "column": "n", "type": "double"},
        {"kind": "foreign_key", "column": "f", "parent_table": "p", "parent_column": "f"},
    ]
    for kind in ("not_null", "check", "data_type", "foreign_key"):
        found = rel.violations(bad.where(F.col("violation") == kind), rules, ["k"], parents)
        assert {(r.kind, r.n) for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {(kind, 4)}
    repeated = rel.violations(t.unionByName(bad.where("violation = 'duplicate_key'").drop("violation")), [{"kind": "primary_key", "columns": ["k"]}], ["k"])
    assert repeated.count() == 8
    assert rel.validation_score(t, rel.violations(t, rules, ["k"], parents)).first().score == 1.0


def test_synthetic_children_have_parents(spark):
    parent = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "p bigint, g string")
    child = spark.createDataFrame([(i, 0 if i < 60 else i % 30, float(i)) for i in range(180)], "c bigint, p bigint, v double")
    made = rel.synthesize_parents(parent, "p", 2)
    children = rel.synthesize_children(made, "p", parent, child, "p", ["c"])
    assert made.count() == 80 and rel.orphans(children, "p", made, "p").count() == 0
    assert children.select("c").distinct().count() == children.count() > 50
    assert rel.dependency_order(["c", "p"], [{"parent_table": "p", "child_table": "c"}]) == ["p", "c"]


@pytest.mark.parametrize("chunk", [4, 7, 8192])
def test_windows_cross_chunks(spark, chunk):
    data = {"hot": list(range(50)), "b": list(range(100, 109)), "short": [1, 2]}
    t = spark.createDataFrame([(k, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)], "k string, o int, v double")
    got = {(r.k, r.start): [x[0] for x in r["values"]] for r in series.sequences(t, ["k"], ["o"], ["v"], 4, chunk).collect()}
    assert got == {(k, i): [float(x) for x in vs[i : i + 4]] for k, vs in data.items() for i in range(len(vs) - 3)}


def test_chunks_drop_the_tail(spark):
    t = spark.createDataFrame([(i, float(i)) for i in range(11)], "o int, v double")
    assert sorted((r.chunk, [x[0] for x in r["values"]]) for r in series.chunks(t, [], ["o"], ["v"], 4).collect()) == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7])]


def test_perfect_forecast(spark):
    t = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    r = series.forecast_metrics(t).first()
    assert (r.rmse, r.mae, r.r2) == (0, 0, 1)


@pytest.mark.parametrize("spread", [1.0, 50.0])
def test_neighbours_are_exact(spark, spread):
    rng = np.random.default_rng(4)
    points = np.vstack([np.zeros((200, 2)), rng.normal(0, spread, (500, 2)), rng.normal(1000, 1, (60, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id bigint, x double, y double")
    got = {r.id: list(r.near) for r in syn.nearest_neighbours(df, ["x", "y"], 3).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(points)
    for i in range(len(points)):
        assert np.sort(d[i])[:3] == pytest.approx(d[i][got[i]])


def test_smote_points_lie_on_segments(spark):
    rows = [(i, float(i % 40), "big", "a") for i in range(40)] + [(100 + i, 1000.0 + 10 * i, "small", "zy"[i % 2]) for i in range(6)]
    t = spark.createDataFrame(rows, "k bigint, v double, y string, c string")
    out = syn.smote(t, "y", ["k"], k=2)
    new = out.where("is_synthetic").collect()
    assert len(new) == 34 and all(r.y == "small" and 1000 <= r.v <= 1050 and r.c in "zy" for r in new)
    assert out.where("NOT is_synthetic").count() == 46
    assert syn.smote(t.where("y = 'big'"), "y", ["k"]).where("is_synthetic").count() == 0
    with pytest.raises(ValueError):
        syn.smote(t, "y", ["k"], strategy="bogus")


def test_copula_keeps_correlation_and_range(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 1500)
    t = spark.createDataFrame([(i, float(np.exp(a)), int(round(10 * a + b))) for i, (a, b) in enumerate(zip(x, rng.normal(0, 2, 1500)))], "k bigint, u double, w bigint")
    made = syn.sample_copula(syn.fit_copula(t, ["u", "w"]), spark.range(1500)).cache()
    before = syn.compare.spearman_matrix(t, ["u", "w"]).where("a = 'u' AND b = 'w'").first().value
    after = syn.compare.spearman_matrix(made, ["u", "w"]).where("a = 'u' AND b = 'w'").first().value
    assert after == pytest.approx(before, abs=0.05) and dict(made.dtypes)["w"] == "bigint"
    low, high = t.agg(F.min("u"), F.max("u")).first()
    assert made.where((F.col("u") < low) | (F.col("u") > high)).count() == 0


def test_tree_keeps_a_dependency(spark):
    t = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2], None if i % 2 else float(i % 9)) for i in range(600)], "k bigint, p string, q string, v double")
    model = syn.fit_tree(t, ["p", "q", "v"])
    made = syn.sample_tree(model, spark.range(500))
    assert {(r.p, r.q) for r in made.select("p", "q").distinct().collect()} == {("a", "x"), ("b", "y")}
    assert made.where("p = 'b' AND v IS NOT NULL").count() == 0


def test_private_draws_refuse_identifying_texts(spark):
    t = spark.createDataFrame([(i, f"name {i}") for i in range(200)], "k bigint, c string")
    with pytest.raises(ValueError):
        syn.noisy_rows(t, ["c"], spark.range(10), 1.0)


def test_run_with_conditions(spark):
    t = spark.createDataFrame([(i, float(i), "ab"[i % 2], f"n{i}") for i in range(300)], "k bigint, v double, c string, name string")
    out = syn.synthesize_table(t, ["k"], 200, roles={"name": "skip"}, conditions=[{"column": "c", "operator": "eq", "value": "a"}])
    rows = out.collect()
    assert out.columns == ["id", "v", "c"] and rows and {r.c for r in rows} == {"a"}
    with pytest.raises(ValueError):
        modelled.concept_drift(t, t, "no such column", ["k"])


def test_efficacy_of_a_learnable_target(spark):
    t = spark.createDataFrame([(i, float(i % 50), float(i % 7), "low" if i % 50 < 25 else "high") for i in range(600)], "k bigint, a double, b double, y string")
    r = modelled.classification_efficacy(t, t, "y", ["a", "b"], ["k"], trees=5).first()
    assert r.trained_on_real > 0.95 and r.efficacy_score == pytest.approx(1, abs=0.05) and r.verdict == "EXCELLENT"
    assert modelled.classification_efficacy(t.limit(20), t, "y", ["a", "b"], ["k"]) is None
    d = modelled.prediction_drift(t, t.withColumn("y", F.when(F.col("y") == "low", "high").otherwise("low")), "y", ["a", "b"], ["k"], trees=5, folds=2).first()
    assert d.alert_level == "red" and d.score_drop > 0.9


def test_related_tables_leave_no_orphan(spark):
    """A child of two parents, a grandchild, and twice the rows."""
    a = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(20)], "a long, t string")
    b = spark.createDataFrame([(100 + i, float(i)) for i in range(7)], "b long, v double")
    c = spark.createDataFrame([(i, i % 5, 100 + i % 3, i % 4) for i in range(40)], "c long, a long, b long, w long")
    d = spark.createDataFrame([(i, i % 40) for i in range(60)], "d long, c long")
    links = [("a", "a", "c", "a"), ("b", "b", "c", "b"), ("c", "c", "d", "c")]
    relations = [dict(zip(("parent_table", "parent_column", "child_table", "child_column"), r)) for r in links]
    made = rel.synthesize_tables({"d": d, "c": c, "b": b, "a": a}, relations, {n: [n] for n in "abcd"}, num_rows=120)
    assert made["a"].count() == 40 and made["b"].count() == 14
    for parent, key, child, column in links:
        known = {r[0] for r in made[parent].select(key).collect()}
        used = [r[0] for r in made[child].select(column).collect()]
        assert used and set(used) <= known
    # only three of the seven observed b have children: as many shares as before
    assert len({r.b for r in made["c"].select("b").collect()}) <= 6


def test_sampling_step_reads_all_times(spark):
    t = spark.range(150).select(F.timestamp_seconds(F.when(F.col("id") < 110, F.col("id") * 86400).otherwise(110 * 86400 + F.col("id") * 3600)).alias("t"))
    r = profile.sampling_step(t, "t").first()
    assert (r.step_seconds, r.distinct_steps) == (86400, 3)
    daily = spark.range(500).select(F.timestamp_seconds(F.col("id") * 7200).alias("t"))
    assert tuple(profile.sampling_step(daily, "t").first()) == (7200.0, 1)
