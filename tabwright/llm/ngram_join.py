"""Documents whose n-gram sets have a Jaccard similarity of at least a threshold, by blocked sparse matrix products.

Rows of the incidence matrix are different n-gram sets, columns are n-grams. All sets are put in one order of the columns: by
frequency for columns that many documents have, by hash for the others, which come first. Two linked sets then share columns
among the first of each, so only these are indexed, and rows with too few shared columns there are dropped. Columns are
gathered to clusters by their most typical row; linked rows share a cluster. A cluster's rows are dealt to blocks of bounded
size, and each pair of blocks is one tile: the product of its two incidence blocks is added up over strips of columns, and
pairs that can no longer reach the bound given by their sizes are discarded after each strip. Tiles hand on a forest, not
pairs; connected components over all of them give the groups. Equal sets are one row throughout.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.bpe import blocks
from tabwright.llm.common import apply_decisions, claim_worker, hot_join, row_id, store
from tabwright.session import shuffle_partitions

#: A column is frequent if a document in so many has it; the order knows the frequency of at most so many columns.
FREQUENT_SHARE, FREQUENT_COLUMNS = 2000, 1 << 18
#: The index is longer than need be by one column in so many, so that linked sets share as many indexed columns at least.
SLACK = 10
#: Rows, and columns of all rows together, of a block; columns of a strip.
BLOCK_ROWS, BLOCK_ENTRIES, STRIP = 128, 1_000_000, 4096
KEPT_WORDS = 500_000
#: Rows whose index entries make up about one task.
BUCKET_ROWS = 20_000

#: Odd multipliers for the hashes, fixed values.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str, words: int) -> np.ndarray:
    """The set of word n-grams of a text as sorted 64-bit hashes; fewer words are one n-gram, none give an empty set."""
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    # bytes: lower() and split() know only A-Z and ASCII white space
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    size = len(parts) - n + 1
    grams = np.full(size, n, np.uint64)
    for k in range(n):
        grams = (grams ^ hashes[k : k + size]) * _ODD[k % 4]
        grams ^= grams >> np.uint64(29)
    grams = np.sort(grams.view(np.int64))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def least_common(a, b, percent: int):
    """The smallest intersection of sets of these sizes whose similarity reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def index_length(n: int, percent: int) -> int:
    """How many of a set's first columns are indexed; see `asked`."""
    return min(n, n + percent * -n // 100 + max(1, n // SLACK))


def asked(n: int, percent: int) -> int:
    """Indexed columns that a set of n shares with any set it is linked to.

    Of the common columns, at least percent * n / 100, all but those behind the index of the set whose index ends first are
    in both indexes; that leaves max(1, m // SLACK) of them, for the size m of that set, which is at least percent * n / 100.
    """
    return max(1, -(percent * -n // 100) // SLACK)


def frequent_columns(docs: DataFrame, text: str, words: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent columns and their counts, by hash. They only set the order of columns, on which no result depends."""

    def count(batches):
        claim_worker("ngrams", _HASHES.clear)
        for whole in batches:
            for batch in blocks(whole, text):
                sets = [shingles(t, words) for t in batch.column(text).to_pylist()]
                grams, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64),) * 2
                often = counts >= max(3, len(sets) // FREQUENT_SHARE)
                arrays = [pa.array(grams[often], pa.int64()), pa.array(counts[often], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["gram", "n"])

    counted = docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = counted.filter(F.col("n") >= max(16, rows // FREQUENT_SHARE))
    top = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT_COLUMNS).toArrow()
    order = np.argsort(top["gram"].to_numpy())
    return top["gram"].to_numpy()[order], top["n"].to_numpy()[order]


def incidence(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], rows: int) -> DataFrame:
    """Rows of (_mark, _id, _text_hash) with n, a 128-bit hash of the set, its indexed frequent columns and their share of the
    set; and, where gram is not null, entries (gram, high) of the index for other columns that several different sets have.

    Index entries cross the network packed, 16 bytes each, dealt by column; a task unpacks about BUCKET_ROWS rows' worth and
    drops what is alone. No column here is frequent: those of the list need no such test and stay with their row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    buckets = max(shuffle_partitions(docs.sparkSession), -(-rows // BUCKET_ROWS))
    kind = docs.schema["_id"].dataType.simpleString()
    names = ["_id", "_text_hash", "_mark", "n", "high", "low", "typical", "frequent"]
    fields = f"_id {kind}, _text_hash long, _mark long, n long, high long, low long, typical float, frequent array<long>"

    def run(batches):
        claim_worker("ngrams", _HASHES.clear)
        grams, counts = shared.value
        for whole in batches:
            for batch in blocks(whole, "_text"):
                n, high, low, typical, listed, index = [], [], [], [], [], []
                for value in batch.column("_text").to_pylist():
                    own = shingles(value, words)
                    n.append(len(own))
                    if len(own) == 0:
                        high.append(None), low.append(None), typical.append(0.0), listed.append([])
                        continue
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
                    weight = np.zeros(len(own), np.int64)
                    if len(grams):
                        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                        weight = np.where(grams[at] == own, counts[at], 0)
                    length = index_length(len(own), percent)
                    rare = own[weight == 0]
                    typical.append(1.0 - len(rare) / len(own))
                    listed.append([])
                    if len(rare) < length:
                        often = np.flatnonzero(weight)
                        listed[-1] = own[often[np.argsort(weight[often], kind="stable")[: length - len(rare)]]].tolist()
                    rare = rare[:length]
                    index.append(np.stack([rare, np.full(len(rare), high[-1])], 1))
                columns = [batch.column(c) for c in names[:3]] + [pa.array(n, pa.int64()), pa.array(high, pa.int64())]
                columns += [pa.array(low, pa.int64()), pa.array(typical, pa.float32()), pa.array(listed, pa.list_(pa.int64()))]
                dealt = pa.array(np.arange(batch.num_rows) % buckets, pa.int64())
                packed = pa.nulls(batch.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([dealt, *columns, packed], names=["bucket", *names, "packed"])
                pairs = np.concatenate(index) if index else np.zeros((0, 2), np.int64)
                bucket = (pairs[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64) if len(pairs) else np.zeros(0, np.int64)
                order = np.argsort(bucket, kind="stable")
                pairs, bucket = pairs[order], bucket[order]
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
                parts = [pairs[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
                empty = [pa.nulls(len(parts), c.type) for c in columns]
                dealt = pa.array(bucket[cuts[:-1]], pa.int64()) if parts else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([dealt, *empty, pa.array(parts, pa.binary())], names=["bucket", *names, "packed"])

    def unpack(bucket: pa.Table) -> pa.Table:
        plain = bucket.filter(pc.is_null(bucket.column("packed"))).select(names)
        plain = plain.append_column("gram", pa.nulls(plain.num_rows, pa.int64()))
        data = b"".join(bucket.column("packed").drop_null().to_pylist())
        pairs = np.frombuffer(data, np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        if len(pairs):
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
            new = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])
            group = np.cumsum(new) - 1
            pairs = pairs[np.bincount(group)[group] > 1]
        entries = {c: pa.nulls(len(pairs), plain.schema.field(c).type) for c in names}
        entries |= {"high": pa.array(pairs[:, 1], pa.int64()), "gram": pa.array(pairs[:, 0], pa.int64())}
        return pa.concat_tables([plain, pa.table(entries)]).combine_chunks()

    dealt = docs.mapInArrow(run, f"bucket long, {fields}, packed binary")
    return dealt.groupBy("bucket").applyInArrow(unpack, f"{fields}, gram long")


def bitmap(marks: DataFrame, count: int) -> np.ndarray:
    """A filter of 64-bit marks, of at most 2**26 bits: 8 MB for the driver and each task, however many marks there are."""
    bits = 1 << min(26, max(16, (16 * count).bit_length()))
    place = F.pmod(F.col("_mark"), F.lit(bits))
    words = marks.select(F.expr("1L").alias("one"), place.alias("p")).select(
        (F.col("p") / 64).cast("long").alias("word"), F.expr("shiftleft(one, cast(p % 64 as int))").alias("bit")
    )
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy()
    return out


def tile_forest(rows: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(row, smallest row it is connected to) within a tile. sides: 0 and 1 for two blocks, 2 for a block with itself."""
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    sizes = np.array([len(s) for s in sets])
    a, b = sizes[left][:, None], sizes[right][None, :]
    need = least_common(a, b, percent)
    open_ = (np.minimum(a, b) * 100 >= percent * np.maximum(a, b)) & (rows[left][:, None] != rows[right][None, :])
    if not open_.any():
        return []
    columns, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    both = (np.bincount(place, sides[owner] != 1, minlength=len(columns)) > 0) & (
        np.bincount(place, sides[owner] != 0, minlength=len(columns)) > 0
    )
    both &= np.bincount(place, minlength=len(columns)) > 1
    number = np.cumsum(both) - 1
    kept = both[place]
    place, owner = number[place[kept]], owner[kept]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    overlap = np.zeros(need.shape, np.float32)
    rest = np.bincount(owner, minlength=len(sets))
    for first in range(0, int(both.sum()), STRIP):
        lo, hi = np.searchsorted(place, [first, first + STRIP])
        block = np.zeros((len(sets), STRIP), np.float32)
        block[owner[lo:hi], place[lo:hi] - first] = 1
        overlap += block[left] @ block[right].T
        rest -= np.bincount(owner[lo:hi], minlength=len(sets))
        open_ &= overlap + np.minimum(rest[left][:, None], rest[right][None, :]) >= need
        if not open_.any():
            return []
    i, j = np.nonzero(open_ & (overlap >= need))
    parent = {int(r): int(r) for r in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(rows[left[i]].tolist(), rows[right[j]].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in parent if root(x) != x]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node with an edge, except the roots: the smallest node of its component.

    Alternating stars: each node hands its larger, then its smaller neighbours the smallest node it knows. Every round is
    stored; rounds grow with the logarithm of the largest component. Hubs are split by the join, not gathered.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("_least"), F.count("*").alias("_n"))
        total = pairs.count()
        out = hot_join(pairs, least, ["a"], "_n", total).withColumn("_least", F.least("a", "_least"))
        handed = out.filter("b > a" if large else "b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
        if not large:
            handed = handed.unionByName(out.select("a", F.col("_least").alias("b")))
        return store(handed.filter("a <> b").distinct(), name)

    pairs = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    mark = None
    while True:
        seen = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == tuple(seen) or seen["n"] == 0:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        pairs = star(star(pairs, True), False)


def similar_groups(docs: DataFrame, words: int = 4, percent: int = 85, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, `_row` (unique), `_text_hash`, `_kept` (one row of each component).

    Component: the smallest id that links of at least the given similarity reach. Null text is empty; a text without words
    has no n-gram, is linked with nothing and is its own component. Rows with the same id are rows of their own, a null id is
    no one's smallest; a component of null ids only is null. The kept row has the smallest id, nulls last. Other columns are
    not looked at.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(id_column).alias("_id"), content.alias("_text"), F.xxhash64(content).alias("_text_hash"))
    source = source.withColumn("_mark", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text_hash"))
    n_rows = source.count()
    frequent = frequent_columns(source, "_text", words, n_rows)
    both = store(incidence(source, words, percent, frequent, n_rows).withColumn("_row", row_id()), "ngram-rows")
    rows = both.filter("gram IS NULL").drop("gram")
    total = n_rows
    key = ["high", "low"]
    first = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    sets = rows.filter("n > 0").groupBy(*key).agg(
        F.min(F.struct("_row", "_mark")).alias("one"),
        F.min("_id").alias("least"),
        F.min(first).alias("first"),
        F.count("*").alias("copies"),
        F.first("n").alias("n"),
        F.first("typical").alias("typical"),
    )
    sets = store(sets.select("*", F.col("one._row").alias("set")), "ngram-sets")
    # one row of each set tells its frequent columns; the others are told by their hash, so copies count once
    often = rows.filter(F.size("frequent") > 0).select("_row", "frequent")
    often = often.join(sets.select(F.col("set").alias("_row"), "high"), "_row").select(F.explode("frequent").alias("gram"), "high")
    entries = both.filter("gram IS NOT NULL").select("gram", "high").unionByName(often)
    least = F.greatest(F.lit(1), F.expr(f"(({percent} * n + 99) div 100) div {SLACK}"))
    found = entries.groupBy("high").agg(F.count("*").alias("_n"))
    alive = sets.select("high", "set", "n", "typical").join(found, "high").filter(F.col("_n") >= least)
    entries = entries.join(alive.drop("_n"), "high").drop("high")
    # Linked sets are of like size: of one band, or of neighbours. Columns are cut by bands, each with the band below it.
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + F.lit(1e-9)).cast("int")
    entries = entries.withColumn("_own", own).select("*", F.explode(F.array("_own", F.col("_own") + 1)).alias("band"))
    entries = store(entries, "ngram-entries")
    column = ["gram", "band"]
    wide = entries.groupBy(*column).agg(F.count("*").alias("_n"), F.count_if(F.col("_own") == F.col("band")).alias("_of_band"))
    wide = wide.filter("_n > 1 AND _of_band > 0").drop("_of_band")
    entries = hot_join(entries, wide, column, "_n", entries.count()).filter("_n IS NOT NULL").drop("_n")
    entries = store(entries, "ngram-shared")
    alive = entries.groupBy("set", "n").agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") >= least).select("set")
    entries = store(entries.join(alive, "set"), "ngram-alive")
    typical = F.max(F.struct("typical", -F.col("n"), F.col("set")))["set"]
    columns = entries.groupBy(*column).agg(F.count("*").alias("_n"), typical.alias("cluster")).filter("_n > 1")
    members = hot_join(entries.select(*column, "set", "n"), columns, column, "_n", entries.count())
    members = store(members.filter("cluster IS NOT NULL").select("cluster", "band", "set", "n").distinct(), "ngram-members")
    size = F.greatest(F.count("*") / F.lit(BLOCK_ROWS), F.sum("n") / F.lit(BLOCK_ENTRIES))
    cluster = ["cluster", "band"]
    clusters = members.groupBy(*cluster).agg(F.ceil(size).cast("int").alias("blocks"), F.count("*").alias("_n")).filter("_n > 1")
    members = hot_join(members, clusters, cluster, "_n", members.count()).filter("blocks IS NOT NULL")
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    members = members.withColumn("_block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = store(
        members.select(
            *cluster,
            "set",
            F.least("_block", "_other").alias("i"),
            F.greatest("_block", "_other").alias("j"),
            F.when(F.col("_block") == F.col("_other"), 2).when(F.col("_block") < F.col("_other"), 0).otherwise(1).alias("side"),
        ),
        "ngram-tiles",
    )
    keyed = sets.select("set", *key, F.col("one._mark").alias("_mark"))
    marks = store(members.select("set").distinct().join(keyed, "set"), "ngram-marks")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(marks, marks.count()))

    def grams(batches):
        claim_worker("ngrams", _HASHES.clear)
        table = wanted.value
        last = len(table) * 64 - 1
        for whole in batches:
            place = whole.column("_mark").to_numpy(zero_copy_only=False) & last
            some = whole.filter(pa.array((table[place >> 6] >> (place & 63)) & 1 == 1))
            for batch in blocks(some, "_text"):
                found = [shingles(t, words).tobytes() for t in batch.column("_text").to_pylist()]
                digests = [np.frombuffer(hashlib.blake2b(g, digest_size=16).digest(), "<i8") for g in found]
                high, low = (pa.array([int(d[k]) for d in digests], pa.int64()) for k in (0, 1))
                arrays = [batch.column("_mark"), high, low, pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["_mark", *key, "grams"])

    # rows alike in id and text come back several times; a tile takes each set once
    vectors = source.select("_text", "_mark").mapInArrow(grams, "_mark long, high long, low long, grams binary")
    vectors = members.join(marks, "set").join(vectors, [*key, "_mark"])

    def product(tile: pa.Table) -> pa.Table:
        numbers, once = np.unique(tile.column("set").to_numpy(), return_index=True)
        packed = tile.column("grams").to_pylist()
        sets = [np.frombuffer(packed[k], np.int64) for k in once]
        sides = tile.column("side").to_numpy()[once]
        forest = tile_forest(numbers, sides, sets, percent)
        return pa.table({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([y for _, y in forest], pa.int64())})

    tiles = vectors.select(*cluster, "i", "j", "set", "side", "grams")
    edges = tiles.groupBy(*cluster, "i", "j").applyInArrow(product, "a long, b long")
    roots = components(edges, "ngram-components").select(F.col("node").alias("set"), "root")
    named = sets.join(roots, "set", "left").withColumn("root", F.coalesce("root", F.col("set")))
    named = store(named, "ngram-named")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("_first"), F.count("*").alias("_n"))
    named = hot_join(named, groups, ["root"], "_n", named.count()).select(*key, "component_id", "_first", "copies")
    out = hot_join(rows.select("_id", "_row", "_text_hash", "n", *key), store(named, "ngram-groups"), key, "copies", total)
    return out.select(
        F.col("_id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
        "_row",
        "_text_hash",
        ((F.col("n") == 0) | (F.col("_row") == F.col("_first._row"))).alias("_kept"),
    )


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay where one row of each group does, with all their columns."""
    return apply_decisions(docs, similar_groups(docs, words, percent), F.col("_kept"))
