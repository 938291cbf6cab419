from pyspark.sql import functions as F

from tabwright.operators import drift, pii
from tabwright.streaming import jobs

SCHEMA = "operation string, `table` string, ts timestamp, seq bigint, before struct<k:bigint,v:string>, after struct<k:bigint,v:string>"


def write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        full = [(op, "t", ts, seq, None if op == "INSERT" else (k, v), None if op == "DELETE" else (k, v)) for op, ts, seq, k, v in rows]
        df = spark.createDataFrame([(o, t, s, q, b, a) for o, t, s, q, b, a in full], SCHEMA.replace("ts timestamp", "ts string"))
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    return f"{folder}/*"


def stream_of(spark, folder, batches):
    path = write_batches(spark, folder, batches)
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_survives_late_and_equal_times(spark, tmp_path):
    batches = [
        [("INSERT", "2024-01-01 00:00:00", 0, 1, "a"), ("INSERT", "2024-01-01 00:00:00", 0, 2, "x")],
        [("DELETE", "2024-01-01 02:00:00", 0, 2, "x"), ("UPDATE", "2024-01-01 01:00:00", 2, 1, "c")],
        # Late: an older update of a deleted row, and an equal time with a smaller sequence number.
        [("UPDATE", "2024-01-01 01:00:00", 0, 2, "late"), ("UPDATE", "2024-01-01 01:00:00", 1, 1, "b"), ("INSERT", "2024-01-01 03:00:00", 0, 3, "z")],
    ]
    stream = stream_of(spark, str(tmp_path / "in"), batches)
    jobs.run_table(jobs.latest_state(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "mark"), "update").awaitTermination()
    rows = jobs.upserts(spark, str(tmp_path / "out"), ["k"]).collect()
    assert {(r.k, r.after.v) for r in rows} == {(1, "c"), (3, "z")}


def test_windows_count_once(spark, tmp_path):
    batches = [[("INSERT", f"2024-01-01 0{h}:10:00", 0, h, "a")] * 2 for h in range(4)]
    # two hours behind the watermark: dropped; behind it by minutes only, but in a window that is still open: counted
    batches.append([("INSERT", "2024-01-01 01:30:00", 0, 9, "a"), ("INSERT", "2024-01-01 03:01:00", 0, 9, "a"), ("INSERT", "2024-01-01 06:00:00", 0, 9, "a")])
    stream = stream_of(spark, str(tmp_path / "in"), batches)
    jobs.run_table(jobs.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    rows = jobs.finished_windows(spark, str(tmp_path / "out")).collect()
    assert sorted((r.start.hour, r.events) for r in rows) == [(0, 2), (1, 2), (2, 2), (3, 3)]


def test_masked_stream_equals_masked_batch(spark, tmp_path):
    t = spark.createDataFrame([(i, None if i == 3 else f"user{i}@mail.com") for i in range(6)], "k int, email string")
    t.write.parquet(str(tmp_path / "in"))
    plan = {"email": ("email", "hash")}
    stream = jobs.read_stream(spark, str(tmp_path / "in"), t.schema)
    jobs.run_append(jobs.masked(stream, plan), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, pii.mask_table(t, plan).collect()))


def test_drift_of_each_batch(spark, tmp_path):
    base = spark.createDataFrame([(float(i % 10), "ab"[i % 2]) for i in range(100)], "v double, c string")
    for i, shift in enumerate((0.0, 100.0)):
        base.withColumn("v", F.col("v") + shift).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    jobs.watch_drift(stream, base, ["v", "c"], str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).where("column_name = 'v'").collect()
    assert sorted(r.alert_level for r in rows) == ["green", "red"]
    assert drift.drift_report(base, base, use_p_value=False).where("alert_level = 'green'").count() == 2


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    # every batch has keys of its own, a day after the last; tombstones and rows leave the state alike
    batches = [[("DELETE" if k % 2 else "INSERT", f"2024-01-{1 + b:02d} 00:00:00", 0, 100 * b + k, "a") for k in range(20)] for b in range(8)]
    # far behind the watermark: left out, though the state of its key is gone
    batches.append([("UPDATE", "2024-01-01 00:00:00", 5, 1, "late"), ("UPDATE", "2024-01-09 00:00:00", 0, 2, "new")])
    stream = stream_of(spark, str(tmp_path / "in"), batches)
    handle = jobs.run_table(jobs.latest_state(stream, ["k"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "mark"), "update")
    handle.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in handle.recentProgress if p.stateOperators]
    assert sizes and max(sizes) <= 80 and sizes[-1] <= 2
    rows = {r.k: r.after.v for r in jobs.upserts(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert 1 not in rows and rows[2] == "new" and rows[100] == "a" and len(rows) == 80


def test_a_profile_stands_for_its_rows(spark):
    rows = [(float(i % 17) * 1.5, "abc"[i % 3], None if i % 7 else i) for i in range(400)]
    base = spark.createDataFrame(rows, "v double, c string, w bigint")
    snap = spark.createDataFrame([(float(i % 23), "abd"[i % 3], i) for i in range(300)], "v double, c string, w bigint")

    def plain(report):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in report.collect())

    expected = plain(drift.drift_report(base, snap))
    assert plain(drift.profile_drift(drift.baseline_profile(base), snap)) == expected
    half = drift.baseline_profile(base.where("v < 9"))
    assert plain(drift.profile_drift(drift.grown_profile(half, base.where("v >= 9")), snap)) == expected
