"""Shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 by id. A keyed Feistel network over the mixed-radix square a x b (a = ceil(sqrt n), b = ceil(n / a))
permutes the numbers; a result of n or more is permuted again until it falls inside (cycle walking), so the shuffle is a
bijection of 0..n-1. Shard and slot are the remainder and quotient of the permuted number: computable for any row from its
number alone, shard sizes differ by at most one, and slots have no gaps. Equal texts are rows like any others: a group may
hold a third of all rows, which no shard of a fortieth could keep together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import number_rows, store, text_or_empty

ROUNDS = 6
#: Multipliers of the splitmix64 finaliser, fixed values.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def feistel(numbers: np.ndarray, n: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1 applied to the given numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = _mix(np.arange(rounds, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
    out = np.asarray(numbers).astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        x = out[open_]
        left, right = x // np.uint64(b), x % np.uint64(b)
        for i in range(0, rounds, 2):
            left = (left + _mix(right ^ keys[i]) % np.uint64(a)) % np.uint64(a)
            right = (right + _mix(left ^ keys[i + 1]) % np.uint64(b)) % np.uint64(b)
        out[open_] = left * np.uint64(b) + right
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 42, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), permuted.

    Null text is empty (size 16, checksum 0). Null ids come first in the numbering; rows with the same id are ordered by
    checksum and size, and rows alike in all of these get their numbers in any order. Other columns are not looked at.
    """
    content = text_or_empty(text)
    rows = docs.select(
        F.col(id_column),
        (F.octet_length(content) + F.lit(16)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = store(rows, "shard-rows")
    n = rows.count()
    order = [F.col(id_column).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    numbered = number_rows(rows, order, "shard-order", "_number")

    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), n, seed))

    out = numbered.withColumn("permuted", permuted("_number"))
    return out.select(
        id_column,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("permuted") % shards).cast("int").alias("shard"),
        F.expr(f"permuted div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "permuted",
    )
