"""Numbers in a hashed order, and keys moved to new parents."""

import hashlib

from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import relational as rel
from tabwright.operators.indexing import with_hashed_index


def hashed_order(keys):
    return sorted(keys, key=lambda k: (hashlib.sha256(str(k).encode()).hexdigest()[:3], k))


def test_hashed_numbers_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def marked(x):
        seen.add(1)
        return (x * 3 - 500,)

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(3000), 4).map(marked), "k bigint")
    got = {r.k: r.n for r in with_hashed_index(df, ["k"], "n").collect()}
    assert got == {k: i for i, k in enumerate(hashed_order([x * 3 - 500 for x in range(3000)]))}
    assert seen.value == 3000


def test_moved_keys_take_turns(spark):
    for n_new in (3, 10, 24):
        parent = spark.createDataFrame([(k,) for k in [*range(10), None, 4]], "p bigint")
        new = spark.createDataFrame([(100 + k,) for k in range(n_new)], "p bigint")
        rows = spark.createDataFrame([(i, i % 10 if i % 13 else None) for i in range(300)] + [(300, 77)], "c bigint, f bigint")
        moved = rel.moved_keys(rows, "f", parent, new, "p", ["c"])
        turns = -(-n_new // 10)
        drawn = {r.c: r.t for r in rows.select("c", keyed.index_below(turns, "turn:f", F.col("c")).alias("t")).collect()}
        old, made = hashed_order(range(10)), hashed_order(range(100, 100 + n_new))
        want = {r.c: made[(old.index(r.f) + 10 * drawn[r.c]) % n_new] if r.f in old else None for r in rows.collect()}
        assert {r.c: r.f for r in moved.collect()} == want
        # the rows meet the parents in one join, the last
        tree = [x for x in moved._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
        assert tree[0].index("Join") < tree[1].index("Join") and "f#" in tree[0] and "f#" not in tree[1].split("=")[0]
