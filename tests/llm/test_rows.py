"""Shards, mixes, archives, searches and the pipeline."""

import base64
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabwright.llm import mixing, queries, sharding, topk, warc
from tabwright.llm.common import hot_join, number_rows, running_total
from tests.llm.test_copies import brute_groups
from tools.check import TABLES, normalise


@pytest.mark.parametrize("n", [0, 1, 2, 3, 39, 40, 41, 1000, 9999])
def test_feistel_is_a_permutation(n):
    out = sharding.feistel(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    if n > 900:
        assert (np.diff(out) == 1).mean() < 0.01 and (out != sharding.feistel(np.arange(n), n, seed=7)).mean() > 0.9


def test_shards(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 5)) for i in range(203)] + [(None, "x"), (3, "é" * 3), (3, "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(7)
    out = sharding.shard_rows(df)
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(r.shard + 40 * r.slot == r.permuted and r.law == "rows" and r.grown_shard is None for r in got)
    expected = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == expected
    again = sharding.shard_rows(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_rows(df.limit(0)).count() == 0


def brute_mix(rows, seed=42):
    sizes = {}
    words = [(i, s, len((t or "").encode().split())) for i, t, s in rows]
    for _, s, n in words:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in full)
        shared = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else weight[s] * rest / shared for s in names}
        more = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    order, given = [], dict.fromkeys(names, 0)
    turns = sorted(range(len(words)), key=lambda k: (hashlib.md5(f"{seed}|{words[k][0]}".encode()).hexdigest(), words[k][0], words[k][2]))
    for epoch in (0, 1):
        for k in turns:
            i, s, n = words[k]
            given[s] += n
            finish = given[s] / target[s] if target[s] > 0 else 0.0
            order.append((finish, names.index(s), epoch, hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i, n, k))
    spent, taken = 0, [0] * len(words)
    for *_, n, k in sorted(order):
        spent += n
        if spent <= sum(target.values()):
            taken[k] += n
    return {i: (n, sizes[s], target[s], taken[k]) for k, (i, s, n) in enumerate(words)}


def test_mix(spark):
    draw = random.Random(6)
    sources = ["a", "b", "ä", "z", None, "empty"]
    rows = [(i, " ".join("w" * draw.randint(0, 60)), draw.choice(["a"] * 8 + sources)) for i in range(400)]
    rows += [(900, None, "empty"), (901, "", "nothing"), (902, " x\t y", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, target int").repartition(6)
    out = mixing.mix(df)
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in out.collect()}
    expected = brute_mix(rows)
    assert {k: (v[0], v[1], v[3]) for k, v in got.items()} == {k: (v[0], v[1], v[3]) for k, v in expected.items()}
    assert all(math.isclose(got[k][2], v[2]) for k, v in expected.items())
    assert all(t <= 2 * n for n, _, _, t in got.values())
    per_source = {}
    for i, _, s in rows:
        per_source.setdefault(s, [0, got[i][2]])[0] += got[i][3]
    assert all(abs(taken - target) <= 200 for taken, target in per_source.values())
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    copies = mixed.groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] * got[r["doc_id"]][0] for r in copies if got[r["doc_id"]][0]} == {k: v[3] for k, v in got.items() if v[3]}
    assert mixing.mix(df.limit(0)).count() == 0


def test_archive(spark):
    pages = [(1, "http://a/\r\nx y", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "u", ""), (None, "n", "<p>one</p>"), (5, "http://é/", "ü" * 5000)]
    pages += [(6, "http://c/", "big " * 3000)] * 2
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    for least in (0, 100):
        records = warc.read_archive(spark, warc.write_archive(df, least)).collect()
        assert len(records) == len(pages) and all(r.verified for r in records)
        for r in records:
            body = bytes(r.payload)
            same = [p for p in pages if (p[2] or "").encode() == body]
            assert r.page_id in [p[0] for p in same] and r.bytes == len(body)
            assert r.sha1 == base64.b32encode(hashlib.sha1(body).digest()).decode()
            kind = dict(line.split(": ", 1) for line in r.header.strip().split("\r\n")[1:])
            best = max((p[0] for p in same if p[0] is not None), default=None)
            if len(body) >= least and r.page_id != best:
                assert kind["WARC-Type"] == "revisit" and r.refers_to == best and kind["Content-Length"] == "0"
            if len(body) < least:
                assert kind["WARC-Type"] == "response" and r.refers_to is None and int(kind["Content-Length"]) == len(body)
        assert sum("WARC-Type: response" in r.header for r in records) == (4 if least == 0 else 7)
    folders = warc.write_archive(df)
    records = {bytes(r.record) for r in warc.record_bytes(warc.read_archive(spark, folders)).collect()}
    assert any(b.endswith(b"\r\n\r\n<p>one</p>\r\n\r\n") for b in records)
    bad = spark.read.parquet(folders["payloads"]).withColumn("payload", F.concat("payload", F.lit(b"!")))
    broken = folders["payloads"] + "-broken"
    bad.write.parquet(broken)
    assert not any(r.verified for r in warc.read_archive(spark, {**folders, "payloads": broken}).collect())
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_topk(spark):
    draw = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(0, 0.3, 20)]) for i in range(300)]
    rows += [(500 + i, rows[50][1]) for i in range(40)]
    rows += [(600, None), (601, [None] * 20), (650, [float("nan")] * 20), (602, [float("inf")] * 20), (700, [1.0, -0.001]), (701, [0.5, 0.5])]
    rows += [(None, rows[0][1]), (100, rows[3][1]), (750, []), (751, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = [tuple(r) for r in topk.search(df).collect()]
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for a, (i, q) in enumerate(good):
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(good) if a != b and len(v) == len(q)]
        scored.sort(key=lambda s: s[:3])
        expected += [(i, rank + 1, s[3], -s[0]) for rank, s in enumerate(scored[:5])]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert topk.search(df.limit(0)).count() == 0


def test_bounds_hold():
    draw = np.random.default_rng(9)
    q, x = np.floor(draw.normal(0, 80, (20, 64))), np.floor(draw.normal(10, 80, (50, 64)))
    exact = q @ x.T
    last = np.inf
    for level in topk.LEVELS:
        bound = topk.features(q, level) @ topk.features(x, level).T
        assert (bound >= exact - 1e-6).all() and bound.mean() <= last
        last = bound.mean()
    big = np.array([[2.0**60, 1.0], [1.0, 1.0]])
    a, b, score = topk.tile_topk(big, np.array([0, 1]), big, np.array([0, 1]), np.array([0, 1]), 5)
    assert score.tolist() == [2**60 + 1] * 2


def test_numbers_and_totals(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("g", (F.col("id") % 3 == 0).cast("long")).withColumn("v", F.col("id") % 10)
    numbered = number_rows(df, [F.col("v"), F.col("id")], "t", "n").collect()
    expected = {r.id: k for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.v, r.id)))}
    assert {r.id: r.n for r in numbered} == expected
    summed = running_total(df, [F.col("g"), F.col("id")], "v", "t", "s", "g").collect()
    total = {0: 0, 1: 0}
    for r in sorted(summed, key=lambda r: (r.g, r.id)):
        total[r.g] += r.v
        assert r.s == total[r.g]
    facts = df.groupBy("g").agg(F.count("*").alias("n"))
    for all_rows in (1000, 10**9):  # hot, cold
        joined = hot_join(df.withColumn("g", F.when(F.col("id") < 900, F.col("g"))), facts, ["g"], "n", all_rows).collect()
        assert len(joined) == 1000 and all((r.n is None) == (r.g is None) for r in joined)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet").limit(120)
    docs = docs.unionByName(docs.limit(10)).unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000))
    docs = docs.unionByName(spark.createDataFrame([(70_000, "12 34", "en", "s", 5), (70_001, None, None, None, None)], docs.schema)).cache()
    assert [name for name, _ in corpus_pipeline.STAGES][1:3] == ["exact_dedup", "ngram_jaccard_join"]
    (_, language), (_, exact), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    known = language(spark, docs, folder)
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()}
    assert {70_000, 70_001} <= lost and len(lost) <= 4
    once = exact(spark, docs, folder).collect()
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted((r.text or "", r.doc_id) for r in once) == sorted(best.items())
    single = exact(spark, docs, folder)
    left = near(spark, single, folder)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert {r.doc_id for r in left.collect()} == {c for _, c in brute_groups(rows, 5, 80)}
    assert known.columns == left.columns == docs.columns
    mixed = mix(spark, single, folder)
    expected = brute_mix([(r.doc_id, r.text, r.source) for r in single.collect()])
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + expected[r.doc_id][0]
    assert {k: v for k, v in words.items() if v} == {k: v[3] for k, v in expected.items() if v[3]}
    coded = encode(spark, docs, folder)
    assert coded.count() == docs.count() and coded.filter("NOT decoded_equal").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, folder, name):
    database = duckdb.connect()
    for t in TABLES:
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    result = database.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert normalise(df.columns, [tuple(r) for r in df.collect()]) == normalise(names, result.fetchall())
