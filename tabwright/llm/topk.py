"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments, coarse and fine. By Cauchy-Schwarz a segment's part of an inner product is at most
s (m_q m_x + d_q d_x), with the segments' length s, means m and standard deviations d; since the squared distance is
|q|^2 + |x|^2 - 2 <q,x>, this bounds the distance from below as well. Queries and vectors meet in tiles of bounded size. In a
tile the coarse bounds of all pairs choose a few candidates per query, whose exact scores give a threshold; pairs whose
coarse bound falls below it are dropped, then those whose finer bounds do, and only survivors get exact products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import row_id, store
from tabwright.session import shuffle_partitions

#: Largest numbers of queries and vectors that meet in a tile.
TILE_QUERIES, TILE_VECTORS = 4096, 32_768
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16, 32)
#: Queries and pairs handled at a time within a tile.
STRIP, PAIRS = 256, 262_144


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(s) times mean and deviation of each segment; the product of two such rows bounds the inner product."""
    columns = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1]))):
        root = np.sqrt(len(part))
        columns += [root * x[:, part].mean(1), root * x[:, part].std(1)] if len(part) else []
    return np.stack(columns, 1) if columns else np.zeros((len(x), 1))


def _exact(q: np.ndarray, x: np.ndarray, safe: bool) -> np.ndarray:
    """Products of whole numbers held as doubles, row by row; beyond 2**53 in Python's integers."""
    if safe:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = (sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q.tolist(), x.tolist()))
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def tile_topk(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, k: int):
    """(query, vector, score) index arrays of each query's k best vectors of the tile; ties to smaller ids."""
    limit = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    safe = limit < 2.0**53
    slack = 1e-9 * max(limit, 1.0) + 1e-6
    finest = x.shape[1]
    levels = [s for s in LEVELS if s < finest] or [max(1, finest)]
    x_features = [features(x, s) for s in levels]
    found = []
    for start in range(0, len(q), STRIP):
        part = q[start : start + STRIP]
        rows = q_rows[start : start + STRIP]
        bound = features(part, levels[0]) @ x_features[0].T
        own = rows[:, None] == x_rows[None, :]
        bound[own] = -np.inf
        m = min(len(x), 4 * k)
        near = np.argpartition(-bound, m - 1, axis=1)[:, :m] if m < len(x) else np.tile(np.arange(len(x)), (len(part), 1))
        first = _exact(np.repeat(part, m, 0), x[near.ravel()], safe).reshape(len(part), m).astype(np.float64)
        first[np.take_along_axis(own, near, 1)] = -np.inf
        worst = min(k, m)
        threshold = -np.sort(-first, axis=1)[:, worst - 1] if m >= k else np.full(len(part), -np.inf)
        threshold[~np.isfinite(threshold)] = -np.inf
        left, right = np.nonzero((bound >= threshold[:, None] - slack) & ~own)
        for level, table in zip(levels[1:], x_features[1:]):
            q_table = features(part, level)
            alive = np.zeros(len(left), bool)
            for i in range(0, len(left), PAIRS):
                a, b = left[i : i + PAIRS], right[i : i + PAIRS]
                alive[i : i + PAIRS] = np.einsum("ij,ij->i", q_table[a], table[b]) >= threshold[a] - slack
            left, right = left[alive], right[alive]
        score = np.zeros(len(left), np.int64)
        for i in range(0, len(left), PAIRS):
            a, b = left[i : i + PAIRS], right[i : i + PAIRS]
            score[i : i + PAIRS] = _exact(part[a], x[b], safe)
        keep = score >= threshold[left]
        left, right, score = left[keep], right[keep], score[keep]
        order = np.lexsort((x_rows[right], x_ids[right], -score.astype(np.float64) if safe else ~score, left))
        left, right, score = left[order], right[order], score[order]
        begins = np.searchsorted(left, left, side="left")
        keep = np.arange(len(left)) - begins < k
        found.append((left[keep] + start, right[keep], score[keep]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by `every`.

    Components become floor(256 x). Rows whose vector is null, or holds a null or non-finite component, take no part; a null
    id is no query, and as a candidate it comes after all others of its score. Rows with the same id are rows of their own.
    Vectors meet those of their own length only; empty ones score 0. Scores beyond 64 bits become the limit of the range.
    """
    real = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(real, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # v - pmod(v, 1) is the floor without a detour through 64-bit integers
    whole = F.transform(real, lambda v: F.rint(v * 256.0 - F.pmod(v * 256.0, F.lit(1.0))))
    rows = vectors.filter(F.col(vector).isNotNull() & good)
    rows = rows.select(F.col(id_column).cast("long").alias("_id"), row_id().alias("_row"), whole.alias("_x"))
    rows = store(rows.withColumn("_length", F.size("_x")), "topk-vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("_id") % every == 0, 1)).alias("queries")).first()
    parts = max(2 * shuffle_partitions(rows.sparkSession), -(-counts["n"] // TILE_VECTORS))
    strips = max(1, -(-counts["queries"] // TILE_QUERIES))
    place = lambda seed, n: F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    queries = rows.filter(F.col("_id") % every == 0).select("*", place("query", strips).alias("_strip"), all_of(parts).alias("_part"))
    others = rows.select("*", place("vector", parts).alias("_part"), all_of(strips).alias("_strip"))
    keys = ["_length", "_strip", "_part"]

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        q_rows, x_rows = left.column("_row").to_numpy(), right.column("_row").to_numpy()
        ids = right.column("_id").fill_null(2**63 - 1).to_numpy()
        a, b, score = tile_topk(matrix(left), q_rows, matrix(right), x_rows, ids, k)
        columns = [pa.array(q_rows[a]), left.column("_id").take(pa.array(a)), right.column("_id").take(pa.array(b)), pa.array(x_rows[b]), pa.array(score)]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)

    near = queries.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(
        meet, "query_row long, query_id long, vec_id long, row long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
