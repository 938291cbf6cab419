"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on many random lines. Two vectors within the angle of the threshold lie close on every line, others
on few: of PROJECTIONS lines, a pair is verified if it lies within a window centred on one of them on at least `least_collisions`
lines, a number that all but MISSED of the pairs exactly at the threshold reach. Single lines tell little (a random pair shares
half of all windows), so windows are not looked up in the whole table: on each of a number of tables, rows are dealt by the side
of the origin on some further lines, few enough that a cell holds about CELL rows, and tables are added until a pair at the
threshold meets in one of them with the wanted recall. In a cell rows are sorted along a line, and strips meet only the strips
their windows reach. Equal vectors are one row throughout; a cell hands on counts and a forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import hot_join, row_id, store
from tabwright.llm.ngram_join import components

#: Lines on which collisions are counted, and half the width of a window in deviations of a pair at the threshold.
PROJECTIONS, WINDOW = 32, 2.0
#: Share of the pairs at the threshold that the count may miss, and that all tables may miss.
MISSED, MISSED_CELLS = 1e-4, 2e-3
#: Rows of a cell that are aimed at, rows of a block of a larger cell, rows of a strip, pairs verified at a time.
CELL, BLOCK, STRIP, PAIRS = 4096, 4096, 512, 65_536
#: Half the width, in the same deviations, of the window along the line that strips are sorted by.
REACH = 4.0
#: Positions on a line are kept in steps, so many a unit, up to LIMIT steps on either side; see `count_collisions`.
STEPS, LIMIT = 24, 100
#: Seeds of the lines that are counted on and of those that tell cells.
COUNTED, CELLS = 11, 12


def least_collisions(lines: int, chance: float, missed: float) -> int:
    """The largest count that a pair colliding on each line with this chance reaches, but for the share missed."""
    tail, k = 0.0, 0
    while k < lines:
        tail += math.comb(lines, k) * chance**k * (1 - chance) ** (lines - k)
        if tail > missed:
            return k
        k += 1
    return lines


def collision_chance(deviations: float) -> float:
    return math.erf(deviations / math.sqrt(2))


def layout(rows: int, cosine: float, cell: int = CELL) -> tuple[int, int]:
    """(lines that a cell is told by, tables) for so many rows."""
    lines = max(0, math.ceil(math.log2(max(1, rows) / cell)))
    if lines == 0:
        return 0, 1
    same = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** lines
    return lines, math.ceil(math.log(MISSED_CELLS) / math.log(1 - same)) if same < 1 else 1


def directions(length: int, lines: int, seed: int) -> np.ndarray:
    """Random lines, the same for every task."""
    return np.random.default_rng(seed + 1_000_003 * length).standard_normal((length, lines))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a power of two first, so that no square overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cell_codes(unit: np.ndarray, lines: int, tables: int) -> np.ndarray:
    """[row, table]: the row's cell, a bit for each line."""
    codes = np.zeros((len(unit), tables), np.int64)
    if lines:
        sides = unit @ directions(unit.shape[1], lines * tables, CELLS) >= 0
        for k in range(lines):
            codes = 2 * codes + sides[:, k * tables : (k + 1) * tables]
    return codes


def count_collisions(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """[left, right]: lines on which the right position lies in the window around the left one. Positions and differences stay
    within a byte's wrap-around: 2 LIMIT + 3 width < 256."""
    counts = np.zeros((len(left), len(right)), np.uint8)
    for line in range(left.shape[1]):
        counts += (left[:, line, None] - right[None, :, line] + np.uint8(width)) <= 2 * width
    return counts


def near_pairs(x: np.ndarray, sides: np.ndarray, cosine: float):
    """Index arrays (a, b) of the verified pairs; sides: 0 and 1 meet each other only, 2 meets all of its kind."""
    deviation = math.sqrt(2 - 2 * cosine)
    need = least_collisions(PROJECTIONS, collision_chance(WINDOW), MISSED)
    width = math.ceil(WINDOW * deviation * STEPS) + 1  # rounding may part a pair by a step more
    exact = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    squares = np.einsum("ij,ij->i", exact, exact)
    along = units(x) @ directions(x.shape[1], PROJECTIONS, COUNTED)
    steps = np.clip(np.floor(along * STEPS), -LIMIT, LIMIT - 1)
    places = (steps + LIMIT).astype(np.uint8)
    order = np.argsort(along[:, 0], kind="stable")
    line, places, sides = along[order, 0], places[order], sides[order]
    half = PROJECTIONS // 2
    for start in range(0, len(order), STRIP):
        stop = min(start + STRIP, len(order))
        end = int(np.searchsorted(line, line[stop - 1] + REACH * deviation, side="right"))
        counts = count_collisions(places[start:stop, :half], places[start:end, :half], width)
        open_ = counts >= max(0, need - (PROJECTIONS - half))
        open_ &= np.arange(start, stop)[:, None] < np.arange(start, end)[None, :]
        open_ &= (sides[start:stop, None] != sides[None, start:end]) | (sides[start:stop, None] == 2)
        i, j = np.nonzero(open_)
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            rest = places[start + a, half:] - places[start + b, half:] + np.uint8(width) <= 2 * width
            good = counts[a, b] + rest.sum(1) >= need
            a, b = order[start + a[good]], order[start + b[good]]
            product = np.einsum("ij,ij->i", exact[a], exact[b])
            linked = product / np.sqrt(squares[a] * squares[b]) >= cosine
            if linked.any():
                yield a[linked], b[linked]


class _Forest:
    """Least members of what links join; lists of links become one parent a row."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return self.parent
            self.parent = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            x, y = roots[a], roots[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def near_groups(
    vectors: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector: str = "embedding", cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    n_links: other rows found whose cosine with the row's is at least the threshold (0 to 1), equal vectors among them;
    component_id: the least id that links reach, the row's own included; kept: whether that is its own. A vector that is null,
    all zero, empty, or holds a null or a component that is not finite is linked with nothing, and vectors are linked with
    those of their own length only. Rows with the same id are rows of their own; a null id is no one's least, and a component
    of null ids only is null and kept. Other columns are not looked at; an empty table gives no rows.
    """
    numbers = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("_id"), numbers.alias("_x"))
    usable = F.coalesce(F.col("_x").isNotNull() & finite & F.exists("_x", lambda v: v != 0), F.lit(False))
    hashes = [F.when(F.col("_ok"), F.xxhash64("_x")).alias("high"), F.when(F.col("_ok"), F.xxhash64(F.lit("low"), "_x")).alias("low")]
    rows = rows.withColumn("_ok", usable).select("_id", *hashes, F.when(F.col("_ok"), F.col("_x")).alias("_x"), row_id().alias("_row"))
    rows = store(rows, "vectors-rows")
    total = rows.count()
    key = ["high", "low"]
    same = rows.filter("high IS NOT NULL").groupBy(*key)
    sets = same.agg(F.min("_row").alias("set"), F.min("_id").alias("least"), F.count("*").alias("copies"), F.first("_x").alias("x"))
    sets = store(sets, "vectors-sets")
    different = sets.count()
    lines, tables = layout(different, cosine, cell)

    def code(batches):
        for batch in batches:
            lists = batch.column("x")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            codes = np.zeros((len(sizes), tables), np.int64)
            for length in np.unique(sizes):
                own = np.flatnonzero(sizes == length)
                x = flat[(ends[own] - length)[:, None] + np.arange(length)]
                codes[own] = cell_codes(units(x), lines, tables)
            offsets = pa.array(np.arange(len(sizes) + 1) * tables, pa.int32())
            arrays = [*batch.columns, pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["set", "copies", "x", "length", "codes"])

    coded = sets.select("set", "copies", "x").mapInArrow(code, "set long, copies long, x array<double>, length int, codes array<long>")
    coded = store(coded, "vectors-coded")
    cells = ["length", "trial", "code"]
    sizes = coded.select("length", F.posexplode("codes").alias("trial", "code")).groupBy(*cells).agg(F.count("*").alias("_n"))
    sizes = store(sizes.filter("_n > 1").withColumn("blocks", F.ceil(F.col("_n") / block).cast("int")), "vectors-cells")
    met = coded.select("set", "copies", "x", "length", F.posexplode("codes").alias("trial", "code"))
    met = hot_join(met, sizes, cells, "_n", different * tables).filter("blocks IS NOT NULL")
    met = met.withColumn("_block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        *cells,
        F.least("_block", "_other").alias("i"),
        F.greatest("_block", "_other").alias("j"),
        F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") < F.col("_other"), 0).otherwise(1).alias("side"),
        "set",
        "copies",
        "x",
    )

    def meet(tile: pa.Table) -> pa.Table:
        trial, length = tile.column("trial")[0].as_py(), tile.column("length")[0].as_py()
        names, copies = tile.column("set").to_numpy(), tile.column("copies").to_numpy()
        x = tile.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        order = np.argsort(names)  # the forest's least members are the least sets
        names, copies, x, sides = names[order], copies[order], x[order], tile.column("side").to_numpy()[order]
        links = np.zeros(len(names), np.int64)
        forest, codes = _Forest(len(names)), None
        for a, b in near_pairs(x, sides, cosine):
            if trial:  # a pair that met in a table before was counted there
                codes = cell_codes(units(x), lines, tables) if codes is None else codes
                new = ~(codes[a, :trial] == codes[b, :trial]).any(1)
                a, b = a[new], b[new]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            forest.join(a, b)
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(names[some]), "b": pa.array(names[forest.roots()[some]]), "links": pa.array(links[some])})

    found = met.groupBy(*cells, "i", "j").applyInArrow(meet, "a long, b long, links long")
    found = store(found, "vectors-links")
    roots = components(found.select("a", "b"), "vectors-components").select(F.col("node").alias("set"), "root")
    linked = found.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    named = sets.select("set", *key, "least", "copies").join(linked, "set", "left").join(roots, "set", "left")
    named = store(named.withColumn("root", F.coalesce("root", "set")), "vectors-named")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    facts = hot_join(named, groups, ["root"], "_n", different)
    facts = facts.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies")
    out = hot_join(rows.drop("_x"), store(facts, "vectors-facts"), key, "copies", total)
    component = F.when(F.col("high").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
