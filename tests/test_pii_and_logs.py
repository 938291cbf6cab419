import json

import pytest
from pyspark.sql import functions as F

from tabwright.operators import documents, logs, pii, privacy


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first().x


def test_known_hash_masks(spark):
    assert one(spark, "123-45-6789", lambda v: pii.hash_digits(v)).startswith("0105462945")
    assert one(spark, "123-45-6789", lambda v: pii.hash_letters(v)).startswith("ABKFEGCJOP")
    assert one(spark, "123-45-6789", lambda v: pii.hash_mask(v, "ssn")) == "010-54-6294"


@pytest.mark.parametrize("strategy", ["hash", "redact", "generalize", "synthetic", "other"])
def test_masks_keep_nulls_and_repeat(spark, strategy):
    t = spark.createDataFrame([("a@b.com",), (None,), ("a@b.com",)], "v string")
    for kind in ("email", "ssn", "name", "date_of_birth", "ip", "age", "salary", "zip_code", "geolocation", "device_id", "vehicle_vin", "no such type"):
        rows = [r.x for r in t.select(pii.mask_expression(F.col("v"), kind, strategy).alias("x")).collect()]
        assert rows[1] is None and rows[0] == rows[2] and rows[0] is not None


def test_generalize_edges(spark):
    cases = {("age", "37.9"): "30-39", ("age", "x"): "[GENERALIZED]", ("salary", "$61,500"): "50000-74999", ("zip_code", "12"): "12",
             ("geolocation", "40.71,-74.00"): "40.7, -74.0", ("date_of_birth", "1985-03-15"): "1980s", ("education", "PhD"): "PhD", ("ssn", "1"): "[GENERALIZED]"}
    for (kind, value), expected in cases.items():
        assert one(spark, value, lambda v, kind=kind: pii.generalize(v, kind)) == expected


def test_birth_dates_stay_in_range_and_format(spark):
    t = spark.createDataFrame([(f"{y}/01/31",) for y in (1900, 1931, 1985, 2011, 2024)] + [("no date",)], "v string")
    rows = [r.x for r in t.select(pii.shift_date(F.col("v"), "yyyy/MM/dd").alias("x")).collect()]
    assert all(1930 <= int(x[:4]) <= 2010 and x[4] == "/" for x in rows)


def test_detection_modes(spark):
    t = spark.createDataFrame([(i, f"1985-03-{i + 1:02d}", f"10.0.0.{i}", f"user{i}@mail.com") for i in range(20)], "k int, birthday string, zip_area string, contact string")
    compat = {r.column_name: r for r in pii.detect(t, ["k"]).collect()}
    strict = {r.column_name: r for r in pii.detect(t, ["k"], mode="strict").collect()}
    assert compat["birthday"].pii_type == "phone" and strict["birthday"].pii_type == "date_of_birth"
    assert compat["zip_area"].pii_type == "ip" and compat["contact"].suggested_strategy == "synthetic"
    assert pii.hinted_type("shipping_method") == "ip" and pii.hinted_type("shipping_method", "strict") is None


def test_numbers_become_text_without_exponents(spark):
    t = spark.createDataFrame([(12340000.0,), (0.25,)], "v double")
    assert [r.x for r in t.select(pii.plain_text(t, "v").alias("x")).collect()] == ["12340000.0", "0.25"]


def test_date_format_detection(spark):
    t = spark.createDataFrame([(i, f"{i + 1:02d}.03.1985") for i in range(25)], "k int, d string")
    assert pii.detect_date_format(t, "d", ["k"]) == "d.M.yyyy"
    u = spark.createDataFrame([(1, "March 15, 1985"), (2, "April 1, 1990")], "k int, d string")
    assert pii.detect_date_format(u, "d", ["k"]) == "MMMM d, yyyy"


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, line string")


def test_format_detection(spark):
    csv = lines(spark, "id,what,who", "1,a,b")
    assert logs.detect_format(csv, ["n"]).first().format == "csv"
    assert logs.detect_format(lines(spark, "plain text"), ["n"]).first().format == "unknown"
    assert logs.detect_format(lines(spark, " ", ""), ["n"]).first().format == "unknown"
    assert logs.detect_format(lines(spark, '{"a": 1}'), ["n"]).first().format == "json"


def test_a_broken_line_does_not_shift_users(spark):
    rows = lines(spark, '1.1.1.1 - ann [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 5', "broken", '2.2.2.2 - bob [01/Jan/2024:00:00:01 +0000] "GET /x HTTP/1.1" 404 -')
    got = [(r.ip, r.user, r.status, r.size) for r in logs.parse_access(rows).orderBy("n").collect()]
    assert got == [("1.1.1.1", "ann", 200, 5), ("2.2.2.2", "bob", 404, 0)]


def test_weighted_draw_follows_weights_and_quotes(spark):
    values = [("it's", 3), ("a\\b", 1), (None, 1)]
    u = spark.range(1000).select(logs.weighted_draw(values, (F.col("id") + 0.5) / 1000).alias("v"))
    assert {r.v: r["count"] for r in u.groupBy("v").count().collect()} == {"it's": 600, "a\\b": 200, None: 200}


def test_top_values_with_many_distinct(spark):
    t = spark.createDataFrame([(f"v{i % 700}",) for i in range(2000)] + [("hot",)] * 900, "f string")
    top = logs.top_values(t, ["f"], 3).orderBy("position").collect()
    assert [(r.value, r.n) for r in top] == [("hot", 900), ("v0", 3), ("v1", 3)]


def test_json_synthesis_is_valid_and_ordered(spark):
    records = spark.createDataFrame([("t", "INFO", 5, True), ("t", "ERROR", 7, None)], "timestamp string, level string, n bigint, ok boolean")
    fields = records.columns
    models = logs.fit_fields(records, fields)
    out = logs.json_lines(logs.make_rows(spark, 50, "2024-02-01 00:00:00", 2), records, fields, models, 0.5).collect()
    times = [json.loads(r.line)["timestamp"] for r in out]
    assert len(times) == 50 and times == sorted(times)
    assert all(5 <= json.loads(r.line)["n"] <= 7 for r in out if "n" in json.loads(r.line))


def test_error_rate_raises_levels(spark):
    models = {"level": logs.FieldModel("string", [("INFO", 1)])}
    rows = logs.make_rows(spark, 400, "2024-02-01 00:00:00", 1)
    lined = logs.application_lines(rows, models, 0.25).select(F.count_if(F.col("line").contains(" ERROR ")).alias("e")).first().e
    assert 70 <= lined <= 130


def test_ledger_against_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    spends = [("hot" if i % 3 else f"d{i % 5}", i, rng.choice([0.5, 1.0, 2.5, 4.0])) for i in range(240)]
    expected = {}
    for name, _, amount in spends:
        spent, ok, no = expected.get(name, (0.0, 0, 0))
        expected[name] = (spent + amount, ok + 1, no) if spent + amount <= 20 + 1e-9 else (spent, ok, no + 1)
    df = spark.createDataFrame(spends, "name string, at int, amount double")
    got = {r.name: (r.spent, r.accepted, r.rejected) for r in privacy.budget_ledger(df, "name", ["at"], "amount", 20.0).select(F.col("name"), "spent", "accepted", "rejected").collect()}
    assert got == expected


def test_perturb_refuses_unknown_mechanisms(spark):
    t = spark.createDataFrame([(1, 2.0)], "k int, v double")
    with pytest.raises(ValueError):
        privacy.perturb(t, ["v"], ["k"], 1.0, mechanism="dp_sgd")


def test_blocks(spark):
    text = "TITLE\nfirst line\nsecond line\n\n- one\n- TWO\n1) a\n2) b\n|x|y|\n\n|z|\nNote:\nat 10:30:"
    t = spark.createDataFrame([(1, text)], "doc int, text string")
    got = [(r.kind, r.level, r.content) for r in documents.blocks(t, ["doc"]).orderBy("block").collect()]
    assert got == [
        ("header", 1, "TITLE"), ("paragraph", None, "first line second line"), ("bullet_list", None, "one\nTWO"),
        ("numbered_list", None, "a\nb"), ("table", None, "|x|y|\n|z|"), ("header", 2, "Note:"), ("paragraph", None, "at 10:30:"),
    ]


def test_components_and_structure(spark):
    text = "Dear John Smith, on 2024-01-05 or Jan 3, 2024 pay $1,200.50 (15%) to a@b.com, see https://x.y\nSUMMARY\nPart 2\n* a\n\nTotal:"
    t = spark.createDataFrame([(1, text)], "doc int, text string")
    c = documents.content_components(t, ["doc"]).first()
    assert (c.dates_found, c.currency_amounts, c.percentages, c.emails_found, c.urls_found) == (2, 1, 1, 1, 1)
    s = documents.structural_elements(t, ["doc"]).first()
    assert (s.uppercase_headings, s.colon_headings, s.bullet_points, s.sections, s.paragraphs) == (1, 1, 1, 1, 2)
    kind = t.select(documents.content_type(F.col("text")).alias("k")).first().k
    assert kind == "letter"


def test_first_values_of_a_sparse_column(spark):
    t = spark.createDataFrame([(i, f"a{i}", f"b{i}" if i >= 480 else None) for i in range(500)], "k int, full string, sparse string")
    got = {}
    for r in pii.first_values(t, ["full", "sparse"], ["k"], 5).orderBy("column_name", "position").collect():
        got.setdefault(r.column_name, []).append(r.value)
    assert got == {"full": [f"a{i}" for i in range(5)], "sparse": [f"b{i}" for i in range(480, 485)]}


def test_whole_columns_decide(spark):
    rows = [(i, "n/a" if i < 1000 else f"user{i}@mail.com", "x" if i < 1000 else "2020-01-31") for i in range(4000)]
    t = spark.createDataFrame(rows, "k long, contact_info string, d string")
    found = {r.column_name: r.pii_type for r in pii.detect(t, ["k"], ["contact_info"]).collect()}
    assert found == {"contact_info": "email"}
    assert pii.detect_date_format(t, "d", ["k"]) == "yyyy-MM-dd"
    assert pii.pattern_rates(t, ["contact_info"], ["k"], first=100).first().email == 0.0
    log = lines(spark, *["free text"] * 5, *['{"a": 1}'] * 9)
    assert logs.detect_format(log, ["n"]).first().format == "json"


def test_doubles_keep_their_digits(spark):
    values = [1.23456781, 1.23456789, 1e-9, 2e-9, 1.25e-7, 12345678.0, 1.5e10, 1.2345678912345e8, -4.5e-5, 0.0, 100.5, 1e22, None]
    t = spark.createDataFrame([(v,) for v in values], "v double").select(pii.plain_text(spark.createDataFrame([], "v double"), "v").alias("t"))
    texts = [r.t for r in t.collect()]
    assert texts[:12] == [
        "1.23456781", "1.23456789", "0.000000001", "0.000000002", "0.000000125", "12345678.0", "15000000000.0", "123456789.12345",
        "-0.000045", "0.0", "100.5", "1" + "0" * 22 + ".0",
    ]
    assert texts[12] is None


def test_json_and_csv_records(spark):
    got = logs.parse_json(lines(spark, "5", "[1]", '{"a": 3}'), "a int").collect()
    assert [r.a for r in got] == [3]
    rows = logs.parse_csv(lines(spark, "a,b", "1,2", "a,b"), ["a", "b"], ["n"]).collect()
    assert [(r.a, r.b) for r in rows] == [("1", "2"), ("a", "b")]


def test_a_tab_alone_makes_no_table(spark):
    text = "\tsome text\n\n\na\tb\n\n\tc | d\nplain"
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.kind, r.lines) for r in documents.blocks(t, ["doc_id"]).orderBy("block").collect()]
    assert got == [("paragraph", 1), ("table", 2), ("paragraph", 1)]


def test_words_end_where_letters_end(spark):
    t = spark.createDataFrame([(1, "é12 34 x@y.com John Doe éAda Poe")], "doc_id long, text string")
    r = documents.content_components(t, ["doc_id"]).first()
    assert r.numbers_found == 1 and r.emails_found == 1
