"""Merkle manifest of a dataset as append logs in postorder, with proofs read from computed positions.

The leaves of a tree (one tree per group, and one above all groups) are dealt to builders in aligned runs of 2**RUN_LEVELS. A
builder appends each node when its last leaf has arrived: a leaf, then every node that it completes. With j the number of a
node's last leaf and k its level, 2 j - popcount(j) + k nodes are written before it, since the complete subtrees left of leaf j
have 2**(k+1) - 1 nodes each; so siblings are addressed without an index. The roots of the runs are the leaves of the next
tier, until one run holds the whole tree. Proofs are read from the top down: a run gets the path of its root once, and hands
its leaves (or the runs below) theirs. Every run is a row of bounded size, however many leaves a group has.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.common import hot_join, number_rows, store, text_or_empty

#: Leaves of a run: two to this power.
RUN_LEVELS = 6
RUN = 1 << RUN_LEVELS
#: How a node on a path stands to its sibling.
ALONE, LEFT, RIGHT = 0, 1, 2
#: Tree number of the tree above all groups; groups are numbered by their first leaf.
TOP = -1


def digest(*parts: bytes) -> bytes:
    """SHA-256 as lowercase hex text of the parts one after another."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def position(level: int, index: int, leaves: int) -> int:
    """Place in the postorder log, from 0, of the node that is the index-th of its level, in a tree of so many leaves."""
    last = min((index + 1) << level, leaves) - 1
    return 2 * last - last.bit_count() + level


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes up to the given level in the order of their completion."""
    log: list[bytes] = []
    waiting: list[tuple[int, bytes]] = []
    for node in leaves:
        level = 0
        log.append(node)
        while waiting and waiting[-1][0] == level:
            node = digest(waiting.pop()[1], node)
            level += 1
            log.append(node)
        waiting.append((level, node))
    level, node = waiting.pop()
    while level < levels:  # no more leaves come: what waits is joined, or rises alone
        node = digest(waiting.pop()[1], node) if waiting and waiting[-1][0] == level else digest(node)
        level += 1
        log.append(node)
    return log


def path(nodes: bytes, leaf: int, leaves: int, levels: int) -> bytes:
    """A leaf's siblings up to the given level, from a log of 32-byte nodes: a byte for the side, then the sibling if any."""
    out = []
    for level in range(levels):
        own = leaf >> level
        other = own ^ 1
        if other << level >= leaves:
            out.append(bytes([ALONE]))
            continue
        at = 32 * position(level, other, leaves)
        out.append(bytes([LEFT if other < own else RIGHT]) + nodes[at : at + 32])
    return b"".join(out)


def siblings(packed: bytes) -> list[tuple[int, bytes]]:
    """(side, hex digest or nothing) of each level of a path, from the leaf upwards."""
    out, i = [], 0
    while i < len(packed):
        side = packed[i]
        width = 0 if side == ALONE else 32
        out.append((side, hexlify(packed[i + 1 : i + 1 + width])))
        i += 1 + width
    return out


def fold(leaf: bytes, way: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for side, other in way:
        leaf = digest(other, leaf) if side == LEFT else digest(leaf, other)
    return leaf


def record_digest(columns: list[Column]) -> Column:
    """Hex digest of a row: every value as its length in bytes, a colon and itself; null as a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass
class Manifest:
    """Tiers of runs, lowest first, of the groups' trees and of the tree above them.

    A run's row has tree, leaves (of its tree on its tier), run, nodes (the log, 32 bytes a node) and, on the lowest tier of the
    groups, the rows it holds as lists `ids` and `claims`.
    """

    groups: list[DataFrame]
    top: list[DataFrame]
    #: Hex digest, None for an empty table.
    root: str | None


def _builder(names: list[str], carried: list[str]):
    """Makes a run's row of its leaves: the log, and the carried columns as lists."""

    def build_run(run: pa.Table) -> pa.Table:
        run = run.sort_by("index").combine_chunks()
        leaves = run.column("leaves")[0].as_py()
        levels = RUN_LEVELS if leaves > RUN else height(leaves)
        log = append_log([hexlify(d) for d in run.column("digest").to_pylist()], levels)
        columns = [run.column(c).slice(0, 1) for c in ("tree", "leaves", "run")]
        columns.append(pa.array([unhexlify(b"".join(log))], pa.binary()))
        for c in carried:
            values = run.column(c).chunk(0)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.table(columns, names=names)

    return build_run


def _tiers(elements: DataFrame, largest: int, name: str, carried: list[str]) -> list[DataFrame]:
    """elements: tree, leaves, index, digest (32 bytes) and the carried columns; largest: the most leaves a tree has."""
    tiers: list[DataFrame] = []
    while True:
        fields = [T.StructField(n, T.LongType()) for n in ("tree", "leaves", "run")] + [T.StructField("nodes", T.BinaryType())]
        fields += [T.StructField(c, T.ArrayType(elements.schema[c].dataType)) for c in carried]
        make = _builder([f.name for f in fields], carried)
        dealt = elements.select("tree", "leaves", F.shiftright("index", RUN_LEVELS).alias("run"), "index", "digest", *carried)
        runs = dealt.groupBy("tree", "leaves", "run").applyInArrow(make, T.StructType(fields))
        tiers.append(store(runs, f"{name}-{len(tiers)}"))
        if largest <= RUN:
            return tiers
        # the roots of a tree's runs are the next tier's leaves; trees of one run are done
        root = F.expr("substring(nodes, -32)").alias("digest")
        above = F.expr(f"(leaves + {RUN - 1}) div {RUN}").alias("leaves")
        elements = tiers[-1].filter(F.col("leaves") > RUN).select("tree", above, F.col("run").alias("index"), root)
        largest, carried = -(-largest // RUN), []


def build(rows: DataFrame, order: list[Column]) -> Manifest:
    """rows: `group` (string, may be null), `digest` (32 bytes), `ids`, `claims`. Groups ascend bytewise, null first; the
    leaves of a group ascend by the given order. Equal leaves are leaves of their own."""
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "group"), F.lit("null")))
    numbered = number_rows(keyed, [F.col("group").asc_nulls_first(), *order], "merkle-order", "_number")
    trees = numbered.groupBy("_key").agg(F.min("_number").alias("tree"), F.count("*").alias("leaves"))
    trees = store(trees, "merkle-trees")
    sizes = trees.agg(F.count("*").alias("trees"), F.max("leaves").alias("largest"), F.sum("leaves").alias("all")).first()
    if not sizes["trees"]:
        return Manifest([], [], None)
    elements = hot_join(numbered, trees, ["_key"], "leaves", sizes["all"])
    elements = elements.withColumn("index", F.col("_number") - F.col("tree"))
    groups = _tiers(elements, sizes["largest"], "merkle-log", ["ids", "claims"])
    roots = None
    for tier in groups:  # a tree ends on the tier where it is one run
        ended = tier.filter(F.col("leaves") <= RUN).select("tree", F.expr("substring(nodes, -32)").alias("digest"))
        roots = ended if roots is None else roots.unionByName(ended)
    roots = number_rows(roots, [F.col("tree")], "merkle-roots", "index").withColumn("ids", F.col("tree"))
    roots = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(sizes["trees"]).cast("long").alias("leaves"), "index", "digest", "ids")
    top = _tiers(roots, sizes["trees"], "merkle-top", ["ids"])
    return Manifest(groups, top, bytes(top[-1].first()["nodes"][-32:]).hex())


_PATHS = "tree long, run long, above binary"


def _hand_down(runs: DataFrame, above: DataFrame | None, top: bool) -> DataFrame:
    """The paths of the runs of the next lower tier, or (at the lowest tier of the top) of the groups' whole trees."""

    def hand(batches):
        for batch in batches:
            trees, numbers, ways = [], [], []
            ids = batch.column("ids").to_pylist() if top else None
            columns = [batch.column(c).to_pylist() for c in ("tree", "leaves", "run", "nodes", "above")]
            for i, (tree, leaves, run, nodes, upper) in enumerate(zip(*columns)):
                held = min(RUN, leaves - run * RUN)
                levels = RUN_LEVELS if leaves > RUN else height(leaves)
                for k in range(held):
                    trees.append(ids[i][k] if top else tree)
                    numbers.append(0 if top else run * RUN + k)
                    ways.append(path(nodes, k, held, levels) + upper)
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.int64()), pa.array(numbers, pa.int64()), pa.array(ways, pa.binary())],
                names=["tree", "run", "above"],
            )

    return _with_paths(runs, above).mapInArrow(hand, _PATHS)


def _with_paths(runs: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return runs.withColumn("above", F.lit(b""))
    return runs.join(above, ["tree", "run"])


def run_paths(manifest: Manifest) -> DataFrame:
    """The lowest runs of the groups with `above`, the path of each run's root to the root of all."""
    ways = None
    for k in reversed(range(len(manifest.top))):
        ways = store(_hand_down(manifest.top[k], ways, k == 0), "merkle-paths")
    roots, handed = ways, None
    for k in reversed(range(len(manifest.groups))):
        tier = manifest.groups[k]
        # trees that end on this tier begin with the path of their root; the others' runs got theirs from the tier above
        paths = roots.join(tier.filter(F.col("leaves") <= RUN).select("tree"), "tree").select("tree", "run", "above")
        paths = paths if handed is None else paths.unionByName(handed)
        if k == 0:
            return _with_paths(tier, paths)
        handed = store(_hand_down(tier, paths, False), "merkle-paths")


_SIDES = {ALONE: "none", LEFT: "left", RIGHT: "right"}


def audit(
    docs: DataFrame,
    claimed: Column | None = None,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    id_column: str = "doc_id",
    outputs: str = "digests",
) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified; with outputs="proofs" also
    `proof`, a side and a digest for each level from the leaf upwards (side none: no sibling there).

    The leaf is the digest of the named columns; its tree is that of its group, in the order of ids (null first, then by leaf).
    Where `claimed` (hex) is not null, that digest is folded with the leaf's siblings instead of the leaf itself. Null values
    and a null group are values of their own, empty texts have length 0, equal rows are leaves of their own, and an empty table
    gives no rows. Columns that are not named are not looked at, whatever they are called.
    """
    claim = F.lit(None).cast("binary") if claimed is None else F.unhex(claimed)
    rows = docs.select(
        F.col(group).cast("string").alias("group"),
        F.unhex(record_digest([F.col(c) for c in columns])).alias("digest"),
        F.col(id_column).alias("ids"),
        claim.alias("claims"),
    )
    manifest = build(rows, [F.col("ids").asc_nulls_first(), F.col("digest")])
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    fields = [T.StructField(id_column, rows.schema["ids"].dataType), *[T.StructField(n, T.StringType()) for n in texts]]
    fields.append(T.StructField("verified", T.BooleanType()))
    proof = outputs == "proofs"
    if proof:
        step = T.StructType([T.StructField("side", T.StringType()), T.StructField("digest", T.StringType())])
        fields.append(T.StructField("proof", T.ArrayType(step)))
    names = [f.name for f in fields]
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], T.StructType(fields))
    root = manifest.root.encode()
    types = [pa.string()] * len(texts) + [pa.bool_(), pa.list_(pa.struct([("side", pa.string()), ("digest", pa.string())]))]

    def check(batches):
        for batch in batches:
            made = []
            inputs = [batch.column(c).to_pylist() for c in ("leaves", "run", "nodes", "above", "claims")]
            for leaves, run, nodes, above, claims in zip(*inputs):
                held = min(RUN, leaves - run * RUN)
                levels = RUN_LEVELS if leaves > RUN else height(leaves)
                upper, subroot = siblings(above), None
                for k in range(held):
                    at = 32 * position(0, k, held)
                    leaf = hexlify(nodes[at : at + 32])
                    way = siblings(path(nodes, k, held, levels)) + upper
                    if subroot is None:
                        subroot = fold(leaf, way[: height(leaves)]).decode()
                    folded = fold(leaf if claims[k] is None else hexlify(claims[k]), way)
                    joined = digest(*[d for _, d in way])
                    row = [leaf.decode(), subroot, root.decode(), joined.decode(), folded.decode(), folded == root]
                    if proof:
                        row.append([{"side": _SIDES[side], "digest": d.decode() or None} for side, d in way])
                    made.append(row)
            if made:
                columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
                yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), *columns], names=names)

    return run_paths(manifest).mapInArrow(check, T.StructType(fields))
