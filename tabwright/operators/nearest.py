"""Exact nearest rows of whole tables.

Points are dealt to cells of a k-d tree fitted on a bounded sample; the tree only decides how work is split.  Every cell
has the exact box of its points, and so has every node above the cells.  A query first visits the cell it falls into, which gives
it a distance to beat, and then only the cells whose boxes lie within that distance; it finds them down the tree.  Most queries
need no other cell: the task of their own cell tells so, and they are not moved again.  Cells and queries meet in tasks of
bounded size, however many queries fall into one cell; nothing but the boxes, one row per cell, is brought to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.session import cut_lineage, shuffle_partitions

#: Points aimed at per cell, most cells, sampled points per cell, queries that meet a cell in one task.
CELL_POINTS, MOST_CELLS, SAMPLED, TASK_QUERIES = 8192, 16_384, 32, 8192
#: Points of a leaf inside a task, queries handled at a time (and inside a task, where nodes are few), and pairs of a query
#: and a node looked at together.
LEAF, STRIP, TOGETHER, PAIRS = 128, 1024, 4096, 1 << 18


class Tree:
    """Cuts of space: at a node the rows above its cut in its dimension go right, others, and missing ones, left."""

    def __init__(self, points: np.ndarray, cells: int, groups: bool):
        self.dimension, self.cut, self.below = [], [], []
        self.cells = 0
        self._grow(points, cells, groups)
        self.dimension, self.cut, self.below = np.array(self.dimension), np.array(self.cut), np.array(self.below)

    def _grow(self, points: np.ndarray, cells: int, groups: bool) -> int:
        node = len(self.dimension)
        self.dimension.append(-1)
        self.cut.append(0.0)
        self.below.append((self.cells, -1))
        found = self._split(points, groups) if cells > 1 and len(points) > 1 else None
        if found is None:
            self.cells += 1
            return node
        dimension, cut = found
        high = points[:, dimension] > cut
        self.dimension[node], self.cut[node] = dimension, cut
        share = min(cells - 1, max(1, round(cells * (1 - high.mean()))))
        left = self._grow(points[~high], share, groups)
        self.below[node] = (left, self._grow(points[high], cells - share, groups))
        return node

    @staticmethod
    def _split(points: np.ndarray, groups: bool) -> tuple[int, float] | None:
        """The group number first, as long as there are several; then the dimension that spreads most."""
        filled = np.where(np.isnan(points), -np.inf, points)
        order = [0] if groups else []
        with np.errstate(invalid="ignore"):
            spread = np.nan_to_num(np.nanstd(np.where(np.isinf(points), np.nan, points)[:, len(order) :], axis=0)) if points.shape[1] > len(order) else np.zeros(0)
        order += (np.argsort(-spread, kind="stable") + len(order)).tolist()
        for dimension in order:
            values = np.unique(filled[:, dimension])
            values = values[np.isfinite(values)]
            if len(values) < 2:
                continue
            middle = float(np.median(filled[:, dimension]))
            cut = middle if values[0] <= middle < values[-1] else float(values[0]) if middle < values[0] else float(values[-2])
            return dimension, cut
        return None

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        """One step down for all rows at a time."""
        node, todo = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(todo := todo[self.dimension[node[todo]] >= 0]):
            at = node[todo]
            node[todo] = self.below[at, (points[todo, self.dimension[at]] > self.cut[at]).astype(np.int64)]
        return self.below[node, 0]

    def over_cells(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corners of the boxes of all nodes, from those of the cells; children come after their parents."""
        lows, highs = np.empty((len(self.cut), low.shape[1])), np.empty((len(self.cut), low.shape[1]))
        for node in reversed(range(len(self.cut))):
            left, right = self.below[node]
            if self.dimension[node] < 0:
                lows[node], highs[node] = low[left], high[left]
            else:
                lows[node], highs[node] = np.minimum(lows[left], lows[right]), np.maximum(highs[left], highs[right])
        return lows, highs

    def reached(self, queries: np.ndarray, bound: np.ndarray, lows: np.ndarray, highs: np.ndarray, groups: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of all cells that may hold a point within a query's bound; no step looks at cells that are far from it."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        todo = [(np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while todo:
            rows, nodes = todo.pop()
            if len(rows) > PAIRS:
                half = len(rows) // 2
                todo += [(rows[:half], nodes[:half]), (rows[half:], nodes[half:])]
                continue
            near = within(queries[rows], bound[rows], lows[nodes], highs[nodes], groups)
            rows, nodes = rows[near], nodes[near]
            last = self.dimension[nodes] < 0
            found.append((rows[last], self.below[nodes[last], 0]))
            rows, nodes = rows[~last], nodes[~last]
            if len(rows):
                todo.append((np.concatenate([rows, rows]), self.below[nodes].T.ravel()))
        return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])

    def leave_home(self, queries: np.ndarray, bound: np.ndarray, lows: np.ndarray, highs: np.ndarray, groups: bool) -> np.ndarray:
        """May a point within a query's bound lie outside its own cell?  Looks at the boxes beside its way down."""
        out, node, todo = np.zeros(len(queries), bool), np.zeros(len(queries), np.int64), np.arange(len(queries))
        while len(todo := todo[self.dimension[node[todo]] >= 0]):
            at = node[todo]
            high = (queries[todo, self.dimension[at]] > self.cut[at]).astype(np.int64)
            beside = self.below[at, 1 - high]
            out[todo] |= within(queries[todo], bound[todo], lows[beside], highs[beside], groups)
            node[todo] = self.below[at, high]
        return out


def within(queries: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, groups: bool) -> np.ndarray:
    """May the box hold a point within the query's bound?  The first column may be a group number, which has to lie in the box."""
    total = np.zeros(len(queries))
    with np.errstate(invalid="ignore"):
        for c in range(1 if groups else 0, queries.shape[1]):
            gap = np.maximum(low[:, c] - queries[:, c], queries[:, c] - high[:, c])
            gap = np.nan_to_num(np.maximum(gap, 0), nan=0.0, posinf=0.0)
            total += gap * gap
    near = np.sqrt(total) * (1 - 1e-12) <= bound
    return near & (queries[:, 0] >= low[:, 0]) & (queries[:, 0] <= high[:, 0]) if groups else near


def _boxes(points: np.ndarray, cells: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Corners of each cell's box; a cell with a missing value is open in that dimension."""
    low = np.full((number, points.shape[1]), np.inf)
    high = np.full((number, points.shape[1]), -np.inf)
    np.minimum.at(low, cells, np.where(np.isnan(points), -np.inf, points))
    np.maximum.at(high, cells, np.where(np.isnan(points), np.inf, points))
    return low, high


def search(
    queries: np.ndarray, own: np.ndarray, bound: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, groups: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k nearest points within each query's bound, ties by id; a query's own id is left out.

    Missing slots have an infinite distance.  Inside a task the points are cut into small leaves of their own.
    """
    tree = Tree(points, -(-len(points) // max(LEAF, 4 * (k + 1))), groups)
    cells = tree.cell_of(points)
    low, high = _boxes(points, cells, tree.cells)
    lows, highs = tree.over_cells(low, high)
    members = np.split(np.argsort(cells, kind="stable"), np.searchsorted(np.sort(cells), np.arange(1, tree.cells)))
    filled = np.isfinite(queries).all() and np.isfinite(points).all()
    best = np.full((len(queries), k), np.inf)
    names = np.full((len(queries), k), -1, np.int64)

    def distances(rows: np.ndarray, inside: np.ndarray) -> np.ndarray:
        total = np.zeros((len(rows), len(inside)))
        with np.errstate(invalid="ignore"):
            for c in range(1 if groups else 0, points.shape[1]):
                gap = queries[rows, c][:, None] - points[inside, c][None, :]
                gap *= gap
                total += gap if filled else np.nan_to_num(gap, nan=0.0, posinf=np.inf)
        np.sqrt(total, out=total)
        total[own[rows][:, None] == ids[inside][None, :]] = np.inf
        if groups:
            total[queries[rows, 0][:, None] != points[inside, 0][None, :]] = np.inf
        return total

    def tighten(rows: np.ndarray, inside: np.ndarray) -> None:
        if len(inside) >= k:
            bound[rows] = np.minimum(bound[rows], np.partition(distances(rows, inside), k - 1, axis=1)[:, k - 1])

    def by_cell(rows: np.ndarray, at: np.ndarray):
        """The rows of each cell, at most STRIP at a time."""
        order, done = np.argsort(at, kind="stable"), 0
        for part in np.split(rows[order], np.flatnonzero(np.diff(at[order])) + 1) if len(rows) else []:
            cell = at[order[done]]
            done += len(part)
            yield from ((cell, part[i : i + STRIP]) for i in range(0, len(part), STRIP))

    # The k-th distance in a query's own leaf bounds the others; where the leaf has too few points, that in the whole cell.
    bound = bound.copy()
    for cell, rows in by_cell(np.arange(len(queries)), tree.cell_of(queries)):
        tighten(rows, members[cell])
    loose = np.flatnonzero(np.isinf(bound))
    for start in range(0, len(loose), LEAF):
        tighten(loose[start : start + LEAF], np.arange(len(points)))
    for start in range(0, len(queries), TOGETHER):
        rows, at = tree.reached(queries[start : start + TOGETHER], bound[start : start + TOGETHER], lows, highs, groups)
        found = []
        for cell, part in by_cell(rows + start, at):
            inside = members[cell]
            total = distances(part, inside)
            row, column = np.nonzero((total <= bound[part][:, None]) & np.isfinite(total))
            found.append((part[row], total[row, column], ids[inside[column]]))
        if not found:
            continue
        rows, near, who = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((who, near, rows))
        rows, near, who = rows[order], near[order], who[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        best[rows[keep], place[keep]], names[rows[keep], place[keep]] = near[keep], who[keep]
    return best, names


def nearest(
    queries: DataFrame, points: DataFrame, columns: list[str], k: int, group: str | None = None, cell_points: int = CELL_POINTS
) -> DataFrame:
    """(id, near, distance): ids and Euclidean distances of the k nearest points of each query, closest first, ties by id.

    Both tables have ``id`` (a long, unique, not null) and the columns; a point with the query's id is left out.  A missing
    dimension on either side adds nothing to a distance.  With ``group`` (a number), only points of the query's group count.
    Queries without any point get empty lists.
    """
    names = [*([group] if group else []), *columns]
    groups = group is not None

    def numbers(df: DataFrame) -> DataFrame:
        values = [F.col(c).cast("double") for c in names]
        return df.select("id", F.array(*[F.when(~F.isnan(v), v) for v in values]).alias("x"))

    # Of equal points, the k + 1 with the smallest ids are all that can be asked for; the window keeps as many per task.
    # Lists are dear to compare: rows are sorted by their hash first.
    hashed = numbers(points).withColumn("_h", F.xxhash64("x"))
    alike = W.partitionBy("_h", "x").orderBy("id")
    few = cut_lineage(hashed.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).select("id", "x"))
    total = few.count()
    if total == 0:
        empty = [F.array().cast("array<bigint>").alias("near"), F.array().cast("array<double>").alias("distance")]
        return queries.select("id", *empty)
    cells = min(MOST_CELLS, -(-total // cell_points))
    share = min(1.0, SAMPLED * cells / total)
    drawn = few.where(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1_000_000)) < max(1, round(share * 1_000_000)))
    tree = Tree(_matrix(drawn.select("x").toArrow(), len(names)), cells, groups)  # at most about SAMPLED x MOST_CELLS rows

    def with_cell(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.cell_of(_matrix(table, len(names))))], names=["id", "x", "cell"])

    placed = cut_lineage(few.mapInArrow(with_cell, "id bigint, x array<double>, cell bigint"))
    ends = [f(F.coalesce(F.get("x", F.lit(i)), F.lit(s))) for i in range(len(names)) for f, s in ((F.min, -np.inf), (F.max, np.inf))]
    boxes = placed.groupBy("cell").agg(F.array(*ends).alias("ends")).orderBy("cell").toArrow()  # one row per cell
    corners = _matrix(boxes.select(["ends"]).rename_columns(["x"]), 2 * len(names))
    low, high = np.full((tree.cells, len(names)), np.inf), np.full((tree.cells, len(names)), -np.inf)
    low[boxes["cell"].to_numpy()], high[boxes["cell"].to_numpy()] = corners[:, 0::2], corners[:, 1::2]
    sent = queries.sparkSession.sparkContext.broadcast((tree, *tree.over_cells(low, high)))

    def begin(batches):
        """Of each query the cell to begin with."""
        tree = sent.value[0]
        for batch in batches:
            home = tree.cell_of(_matrix(pa.Table.from_batches([batch]), len(names)))
            open_end = pa.array(np.full(len(home), np.inf))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), open_end, pa.array(home)], names=["id", "x", "bound", "cell"])

    def go_on(batches):
        """Of each query the other cells within its bound."""
        tree, lows, highs = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, STRIP):
                part = batch.slice(start, STRIP)
                asked = _matrix(pa.Table.from_batches([part]), len(names))
                home = tree.cell_of(asked)
                row, cell = tree.reached(asked, part.column("bound").to_numpy(zero_copy_only=False), lows, highs, groups)
                row, cell = row[cell != home[row]], cell[cell != home[row]]
                taken = [part.column(c).take(pa.array(row)) for c in ("id", "x", "bound")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(cell)], names=["id", "x", "bound", "cell"])

    def meet(asked: pa.Table, held: pa.Table, home: bool) -> pa.Table:
        """The nearest points of a cell; at home also the place of each query that has to go on, and null for others."""
        schema = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.int64())), ("distance", pa.list_(pa.float64())), ("x", pa.list_(pa.float64()))])
        if asked.num_rows == 0:
            return schema.empty_table()
        q, own, bound = _matrix(asked, len(names)), asked.column("id").to_numpy(), asked.column("bound").to_numpy()
        more = np.zeros(len(q), bool)
        if held.num_rows == 0:
            near, distance = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        else:
            distance, near = search(q, own, bound, _matrix(held, len(names)), held.column("id").to_numpy(), k, groups)
        if home:
            more = sent.value[0].leave_home(q, distance[:, -1], *sent.value[1:], groups)
        good = np.isfinite(distance)
        offsets = pa.array(np.concatenate([[0], good.sum(1).cumsum()]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[good])) for v in (near, distance)]
        places = asked.column("x").combine_chunks().take(pa.array(np.arange(len(q)), mask=~more))
        return pa.table([pa.array(own), *lists, places], schema=schema)

    def meet_home(asked: pa.Table, held: pa.Table) -> pa.Table:
        return meet(asked, held, True)

    def meet_other(asked: pa.Table, held: pa.Table) -> pa.Table:
        return meet(asked, held, False)

    def met(asked: DataFrame, way) -> DataFrame:
        """Stored queries of a cell are dealt to as many tasks as their number asks for; each gets the cell's points."""
        sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / TASK_QUERIES).alias("tasks"))  # one row per cell
        left = asked.join(F.broadcast(sizes), "cell").withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks"))).drop("tasks")
        right = placed.join(F.broadcast(sizes), "cell").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)))
        # a number of partitions, which is kept: few bytes are much work here
        left, right = [t.repartition(shuffle_partitions(t.sparkSession), "cell", "task") for t in (left, right.drop("tasks"))]
        pairs = left.groupBy("cell", "task").cogroup(right.groupBy("cell", "task"))
        return cut_lineage(pairs.applyInArrow(way, "id bigint, near array<bigint>, distance array<double>, x array<double>"))

    shape = "id bigint, x array<double>, bound double, cell bigint"
    asked = cut_lineage(numbers(queries).mapInArrow(begin, shape))
    home = met(asked, meet_home)
    last = F.when(F.size("distance") >= k, F.element_at("distance", -1)).otherwise(F.lit(float("inf")))
    again = home.where("x IS NOT NULL").select("id", "x", last.alias("bound"))
    # Queries that share an id, which they should not, are one query of several places: each has the neighbours of all.
    shared = cut_lineage(home.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1"))
    some = not shared.isEmpty()
    if some:
        bounds = home.join(shared.select("id"), "id", "left_semi").select("id", last.alias("bound"))
        again = again.join(shared, "id", "left_anti").unionByName(asked.select("id", "x").join(bounds, "id"))
        home = home.join(shared, "id", "left").withColumn("x", F.when(F.col("_n").isNotNull(), F.coalesce("x", F.array().cast("array<double>"))).otherwise(F.col("x")))
    other = met(cut_lineage(again.mapInArrow(go_on, shape)), meet_other)
    # k entries from each cell a query visited
    pairs = F.flatten(F.collect_list(F.arrays_zip("distance", "near")))
    found = home.where("x IS NOT NULL").select("id", "near", "distance").unionByName(other.select("id", "near", "distance"))
    best = found.groupBy("id").agg(F.slice(F.array_sort(pairs), 1, k).alias("_l"))
    if some:
        best = best.join(shared, "id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))))
    best = best.select("id", F.transform("_l", lambda s: s["near"]).alias("near"), F.transform("_l", lambda s: s["distance"]).alias("distance"))
    return home.where("x IS NULL").select("id", "near", "distance").unionByName(best)


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The lists of column x as rows; missing values become NaN."""
    flat = table.column("x").combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
