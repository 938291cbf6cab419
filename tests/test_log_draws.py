"""Log lines are drawn from stretches of numbers, one per value, and what they are drawn from is parsed once."""

from bisect import bisect_right

from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import logs
from tabwright.plans import log_queries


def expanded(values):
    counts = {v: values.count(v) for v in set(values) if v is not None}
    return [v for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) for _ in range(n)]


def test_long_lists_have_one_row_per_value(spark, monkeypatch):
    values = ["often"] * 400 + [f"v{i % 90:03d}" for i in range(250)] + [None] * 7
    records = spark.createDataFrame([(v,) for v in values], "name string")
    model = logs.fit_fields(records, ["name"])["name"]
    assert model.donors.count() == 91 and model.total == 650
    want = expanded(values)
    rows = spark.range(600)
    places = rows.select("id", F.floor(keyed.uniform("name", F.col("id")) * 650).cast("bigint").alias("at")).collect()
    for held in (logs.HELD, 0):
        monkeypatch.setattr(logs, "HELD", held)
        got = {r["id"]: r["_drawn_name"] for r in logs.with_draws(rows, {"name": model}).collect()}
        assert got == {r["id"]: want[r["at"]] for r in places}
    some = model.only("value > 'v04'")
    kept = [v for v in want if v > "v04"]
    assert some.total == len(kept) and some.donors.count() == len(set(kept))
    got = {r["id"]: r["_drawn_name"] for r in logs.with_draws(rows, {"name": some}).collect()}
    places = rows.select("id", F.floor(keyed.uniform("name", F.col("id")) * len(kept)).cast("bigint").alias("at")).collect()
    assert got == {r["id"]: kept[r["at"]] for r in places}
    assert model.only("value = 'none'") is None


def test_cells_of_a_list_find_what_a_search_of_all_finds(spark):
    for counts in ([1] * 50, [1000] + [1] * 60, [7, 5, 5, 3, 2, 2, 1, 1, 1], list(range(200, 0, -1)), [0, 3] * 10):
        values = [(f"v{i}", n) for i, n in enumerate(counts)]
        total, highs, run = sum(counts), [], 0
        for n in counts:
            run += n
            highs.append(run / total)
        highs[-1] = 1.0
        points = sorted({max(0.0, min(x + d, 1 - 2**-53)) for x in [*highs, *[i / len(counts) for i in range(len(counts))]] for d in (-1e-16, 0, 1e-16, 1e-9)})
        got = spark.createDataFrame([(p,) for p in points], "u double").select("u", logs.weighted_draw(values, F.col("u")).alias("v")).collect()
        assert {r.u: r.v for r in got} == {p: f"v{bisect_right(highs, p)}" for p in points}


def test_json_lines_parse_once_and_are_made_after_the_sort(spark, folder):
    out = log_queries.json_log_synthesis(spark, folder)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "JsonToStructs" not in plan and "from_json" not in plan and "parse_json" not in plan
    assert 0 <= plan.find("StructsToJson") < plan.find("Sort [")
    ids = [r["event_id"] for r in log_queries.table(spark, folder, "events").select("event_id").collect()]
    assert sorted(r["id"] for r in out.collect()) == sorted(ids)
