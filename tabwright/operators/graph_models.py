"""Graph synthesis: every edge is drawn on its own from a keyed hash, so generation is as parallel as its edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators import graph
from tabwright.operators.indexing import expand_counts, with_digest_index, with_global_index, with_hashed_index, with_running_sum
from tabwright.operators.joins import fact_join
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage


def _clean(edges: DataFrame, directed: bool = False) -> DataFrame:
    if directed:
        return edges.where("src <> dst").select("src", "dst").distinct()
    return graph.simple_edges(edges)


def numbered_nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


# --- degree sequences -------------------------------------------------------


def scale_degree_sequence(degrees: DataFrame, n: int) -> DataFrame:
    """(id, degree) for n nodes: node i takes the degree at position floor(i * n0 / n) of the descending sequence.

    Degrees are kept between 1 and n - 1; where their sum comes out odd, node 0 gets one more.
    """
    degrees = cut_lineage(degrees)
    ordered = degrees.select(F.col("id").alias("_id"), (-F.col("degree")).alias("_neg"), "degree")
    indexed = with_global_index(ordered, ["_neg", "_id"], "_i").select("_i", "degree")
    total = degrees.agg(F.count("*").alias("_n0"))
    rows = attach(degrees.sparkSession.range(n), total).withColumn("_i", F.expr(f"(id * _n0) div {n}")).drop("_n0")
    taken = rows.join(indexed, "_i").select("id", F.greatest(F.lit(1), F.least(F.lit(n - 1), F.col("degree"))).cast("bigint").alias("degree"))
    odd = taken.agg((F.sum("degree") % 2).alias("_odd"))
    fixed = attach(cut_lineage(taken), odd)
    return fixed.select("id", (F.col("degree") + F.when(F.col("id") == 0, F.col("_odd")).otherwise(0)).alias("degree"))


def stubs(degrees: DataFrame, name: str = "degree") -> DataFrame:
    """(id, _j): every node once per unit of degree."""
    return expand_counts(degrees.select("id", name), name, "_j").select("id", "_j")


def shuffled_stubs(degrees: DataFrame, tag: str, seed: int, name: str = "degree") -> DataFrame:
    """Stubs numbered in a hashed order."""
    rows = stubs(degrees, name).withColumn("_h", keyed.digest(tag, F.col("id"), F.col("_j"), seed=seed))
    return cut_lineage(with_digest_index(rows, "_h", ["id", "_j"], "_i").select("_i", "id"))


def configuration_model(degrees: DataFrame, seed: int = keyed.SEED) -> DataFrame:
    """Stubs in a hashed order, neighbours 2i and 2i + 1 joined; loops and repeats dropped."""
    numbered = shuffled_stubs(degrees, "stub", seed)
    pairs = numbered.groupBy(F.floor(F.col("_i") / 2).alias("_p")).agg(F.min("id").alias("src"), F.max("id").alias("dst"), F.count("*").alias("_k"))
    return _clean(pairs.where("_k = 2"))


def directed_configuration_model(degrees: DataFrame, seed: int = keyed.SEED) -> DataFrame:
    """``degrees`` has out_degree and in_degree; the i-th out stub meets the i-th in stub."""
    out = shuffled_stubs(degrees, "out-stub", seed, "out_degree").withColumnRenamed("id", "src")
    inn = shuffled_stubs(degrees, "in-stub", seed, "in_degree").withColumnRenamed("id", "dst")
    return _clean(out.join(inn, "_i"), directed=True)


def chung_lu(degrees: DataFrame, seed: int = keyed.SEED) -> DataFrame:
    """Half as many draws as stubs, both ends taken at hashed stub positions, that is by degree."""
    numbered = cut_lineage(with_hashed_index(stubs(degrees), ["id", "_j"], "_i").select("_i", "id"))
    total = degrees.agg(F.sum(F.greatest("degree", F.lit(0))).alias("_t"))
    stub_count = total.first()["_t"] or 0
    draws = numbered.sparkSession.range((stub_count + 1) // 2).select(F.col("id").alias("e"), F.lit(stub_count).cast("bigint").alias("_t"))
    ends = keyed.with_drawn(draws, **{f"_{x}": keyed.index_below(F.col("_t"), f"cl-{x}", F.col("e"), seed=seed) for x in "ab"})
    a = numbered.select(F.col("_i").alias("_a"), F.col("id").alias("src"))
    b = numbered.select(F.col("_i").alias("_b"), F.col("id").alias("dst"))
    return _clean(ends.join(a, "_a").join(b, "_b"))


#: Hops of a place that are columns of their own.
HOPS = 8


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = keyed.SEED) -> DataFrame:
    """Preferential attachment without a sequential state (Sanders and Schulz 2016).

    Edge e fills places 2e (its source, node e div m) and 2e + 1.  The second place copies a uniformly drawn
    earlier place; an odd place is itself a copy, so the draw is repeated from there until it is even.
    """
    m = max(1, m)
    rows = spark.range(n * m).withColumnRenamed("id", "e")

    def hop(place, _):
        return F.when(place % 2 == 0, place).otherwise(keyed.index_below(place, "ba", place, seed=seed))

    # Half of the draws end with each hop: the first hops are plain columns, the rest, needed by few rows, a loop.
    rows = rows.select("e", (F.col("e") * 2 + 1).alias("_place0"))
    for i in range(HOPS):
        rows = keyed.with_drawn(rows.select("e", f"_place{i}"), **{f"_place{i + 1}": hop(F.col(f"_place{i}"), None)})
    last = F.col(f"_place{HOPS}")
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(64 - HOPS)), last, hop)
    rows = keyed.with_drawn(rows.select("e", last), _place=F.when(last % 2 == 0, last).otherwise(rest))
    return _clean(rows.select(F.expr(f"e div {m}").alias("src"), F.expr(f"_place div {2 * m}").alias("dst")))


def _pair(k: Column) -> tuple[Column, Column]:
    """The k-th pair (i, j) with 0 <= j < i, exact in whole numbers.  It names k many times: hand in a column of its own."""
    guess = F.floor((F.sqrt(F.lit(8.0) * k + 1) + 1) / 2).cast("bigint")
    first = lambda i: (i * (i - 1) / 2).cast("bigint")
    i = F.when(first(guess) > k, guess - 1).when(first(guess + 1) <= k, guess + 1).otherwise(guess)
    return i, k - first(i)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = keyed.SEED) -> DataFrame:
    """Pair numbers drawn with repeats; -N ln(1 - p) draws leave N p different pairs on average."""
    p = min(p or 0.05, 1 - 1e-9)
    pairs = n * (n - 1) // 2
    draws = spark.range(max(0, round(-pairs * math.log1p(-p))))
    i, j = _pair(F.col("_k"))
    # j < i, so there are no loops and one form of every pair
    return keyed.with_drawn(draws, _k=keyed.index_below(pairs, "er", F.col("id"), seed=seed)).select(j.alias("src"), i.alias("dst")).distinct()


def rewire_share(average_degree: float, clustering: float, n: int) -> tuple[int, float]:
    """(k, beta) of a small-world ring: k even and near the average degree, beta from the lattice clustering."""
    k = max(2, round(average_degree))
    k = min(k + k % 2, n - 1 - (n - 1) % 2)
    lattice = 3 * (k - 2) / (4 * (k - 1)) if k > 1 else 0.0
    beta = max(0.01, min(0.99, 1.0 - clustering / lattice)) if lattice > 0 and clustering > 0 else 0.3
    return k, beta


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seed: int = keyed.SEED) -> DataFrame:
    """A ring of n nodes, each joined to k / 2 on one side; an edge's far end moves with probability beta."""
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("j"))
    ids = [F.col("i"), F.col("j")]
    rows = keyed.with_drawn(rows, _moved=keyed.uniform("ws", *ids, seed=seed) < beta)
    rows = keyed.with_drawn(rows, _other=F.when(F.col("_moved"), keyed.index_below(n - 1, "ws-to", *ids, seed=seed)))
    # A random other node: skip over i itself.
    other = F.when(F.col("_other") >= F.col("i"), F.col("_other") + 1).otherwise(F.col("_other"))
    target = F.when(F.col("_moved"), other).otherwise((F.col("i") + F.col("j")) % n)
    return _clean(rows.select(F.col("i").alias("src"), target.alias("dst")))


def stochastic_block(sizes: DataFrame, p_intra: float, p_inter: float, seed: int = keyed.SEED) -> DataFrame:
    """Edges of a block model with ``sizes(block, start, size)``; node numbers run from start to start + size - 1.

    Inside a block, pair numbers are drawn as in :func:`erdos_renyi`.  Between blocks, two nodes are drawn from
    all, and pairs that fall into one block are dropped; no table of block pairs is needed.
    """
    spark = sizes.sparkSession
    thin = lambda p: -math.log1p(-min(max(p, 0.0), 1 - 1e-9))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    counted = sizes.select("block", "start", "size", F.round(pairs * thin(p_intra)).cast("bigint").alias("_m"))
    inside = expand_counts(counted, "_m", "_e")
    i, j = _pair(F.col("_k"))
    inside = keyed.with_drawn(inside, _k=keyed.index_below((F.col("size") * (F.col("size") - 1) / 2).cast("bigint"), "sbm-in", F.col("block"), F.col("_e"), seed=seed))
    # j < i, so there are no loops and one form of every pair
    intra = inside.select((F.col("start") + j).alias("src"), (F.col("start") + i).alias("dst")).distinct()
    totals = sizes.agg(F.sum("size").alias("n"), F.sum(F.col("size") * (F.col("size") - 1) / 2).alias("inside")).first()
    n = int(totals.n)
    all_pairs = n * (n - 1) // 2
    # Of all pairs drawn, the share between blocks is kept; the draw rate is set so that those reach p_inter.
    draws = spark.range(round(all_pairs * thin(p_inter)))
    draws = keyed.with_drawn(draws, _k=keyed.index_below(max(1, all_pairs), "sbm-out", F.col("id"), seed=seed))
    draws = draws.select("_k").distinct()
    a, b = _pair(F.col("_k"))
    # Node number -> block by an equi-join on a per-node table.
    members = expand_counts(sizes.select("block", "start", "size"), "size", "_k").select((F.col("start") + F.col("_k")).alias("node"), "block")
    across = (
        draws.select(b.alias("src"), a.alias("dst"))
        .join(members.select(F.col("node").alias("src"), F.col("block").alias("_bs")), "src")
        .join(members.select(F.col("node").alias("dst"), F.col("block").alias("_bd")), "dst")
        .where("_bs <> _bd").select("src", "dst")
    )
    # pairs inside a block and between blocks are never the same
    return intra.unionByName(across)


def block_sizes(labels: DataFrame, n: int) -> DataFrame:
    """(block, start, size): community sizes scaled to n nodes, numbered without gaps.

    Starts are rounded cumulative shares, so the sizes add up to n exactly.
    """
    sizes = labels.groupBy("community").agg(F.count("*").alias("k"))
    nodes = with_global_index(labels.select("community", "id"), ["community", "id"], "_i")
    ends = nodes.groupBy("community").agg(F.min("_i").alias("_low"), (F.max("_i") + 1).alias("_high"))
    total = sizes.agg(F.sum("k").alias("_n"))
    rows = attach(ends, total)
    start = F.round(F.col("_low") * n / F.col("_n")).cast("bigint")
    end = F.round(F.col("_high") * n / F.col("_n")).cast("bigint")
    return rows.select(F.col("community").alias("block"), start.alias("start"), (end - start).alias("size")).where("size > 0")


# --- adjustments ------------------------------------------------------------


#: The turn of edges that go only where the others do not suffice: later than that of any degree.
LAST_TURN = (1 << 63) - 1


def remove_edges(edges: DataFrame, surplus: int, seed: int = keyed.SEED) -> DataFrame:
    """Drop ``surplus`` edges, those with ends of low degree first.

    Each node protects its edge of smallest hash, so a whole batch can go at once; protected edges go only where the others
    do not suffice.  Edges are not sorted: counts tell the last one to go, and hashes are made where they are read, not moved.
    """
    if surplus <= 0:
        return edges
    digest = keyed.digest("keep", F.col("src"), F.col("dst"), seed=seed)
    # 60 bits of it: two edges of a node that share them and have its smallest hash would both be protected
    short = keyed.hex_to_long(digest, 1, 15)
    hashed = keyed.with_drawn(edges.select("src", "dst"), _h=short)
    ends = hashed.select(F.explode(F.array("src", "dst")).alias("id"), "_h").where("id IS NOT NULL")
    facts = cut_lineage(ends.groupBy("id").agg(F.count("*").alias("_k"), F.min("_h").alias("_h")))
    total = facts.agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]
    near = fact_join(edges.select("src", "dst"), facts.withColumnRenamed("id", "src"), ["src"], "_k", total)
    near = near.select("src", "dst", F.col("_k").alias("_a"), (F.col("_h") == short).alias("_kept"))
    both = fact_join(near, facts.withColumnRenamed("id", "dst"), ["dst"], "_k", total)
    last = F.col("_kept") | (F.col("_h") == short) | (F.col("_a") <= 1) | (F.col("_k") <= 1)
    turn = F.when(last, LAST_TURN).otherwise(F.least("_a", "_k"))
    # edges without an end have no turn and stay
    scored = cut_lineage(both.select("src", "dst", F.when(F.col("_a").isNotNull() & F.col("_k").isNotNull(), turn).alias("_turn")))
    return scored.where(~F.coalesce(_goes(scored, surplus, digest), F.lit(False))).select("src", "dst")


def _goes(scored: DataFrame, surplus: int, digest: Column) -> Column:
    """Is an edge among the first ``surplus`` by turn and digest?  Repeats of the last one go with it."""

    def reached(counts: DataFrame, left: int) -> tuple:
        """The value at which so many rows are reached, and how many of its rows that takes; no value if there are fewer."""
        for value, n in sorted(map(tuple, counts.collect())):
            if n >= left:
                return value, left
            left -= n
        return None, 0

    turn = F.col("_turn")
    held = scored.where(turn.isNotNull())
    at, left = reached(held.groupBy("_turn").agg(F.count("*")), surplus)  # one row per degree
    if at is None:
        return turn.isNotNull()
    held = held.where(turn == at)
    begin, left = reached(held.groupBy(F.substring(digest, 1, 4)).agg(F.count("*")), left)  # 65,536 rows at most
    few = cut_lineage(held.where(digest.startswith(begin)).groupBy(digest.alias("_h")).agg(F.count("*").alias("_n")))
    end = with_running_sum(few, ["_h"], "_n", "_s").where(F.col("_s") >= left).agg(F.min("_h")).first()[0]
    return (turn < at) | ((turn == at) & (digest <= end))


def _absent_pairs(every: DataFrame, n: int, edges: DataFrame, seed: int) -> DataFrame:
    """(e, src, dst): the pairs without an edge, by hash.  For dense graphs, which have as many pairs as edges or so."""
    pairs = every.sparkSession.range(n * (n - 1) // 2)
    # pair number p is (i, j), j < i, with i (i - 1) / 2 + j = p; the root is corrected by one where it was rounded
    i = F.floor((F.sqrt(8.0 * F.col("id") + 1.0) + 1.0) / 2.0).cast("bigint")
    pairs = pairs.withColumn("_i", i)
    below = F.col("_i") * (F.col("_i") - 1) > 2 * F.col("id")
    above = F.col("_i") * (F.col("_i") + 1) <= 2 * F.col("id")
    pairs = pairs.withColumn("_i", F.col("_i") + F.when(below, -1).when(above, 1).otherwise(0))
    pairs = pairs.select("_i", (F.col("id") - F.expr("_i * (_i - 1) div 2")).alias("_j"))
    made = pairs.join(every.select("_i", F.col("id").alias("x")), "_i").join(every.select(F.col("_i").alias("_j"), F.col("id").alias("y")), "_j")
    made = made.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).join(edges, ["src", "dst"], "left_anti")
    return made.withColumn("e", keyed.digest("add-absent", F.col("src"), F.col("dst"), seed=seed))


def add_edges(nodes: DataFrame, edges: DataFrame, missing: int, bias: float = 0.7, seed: int = keyed.SEED) -> DataFrame:
    """Add ``missing`` new edges, or all that are possible; seven in ten join two nodes of at most average degree.

    Pairs are drawn in rounds until there are enough: loops and repeats are drawn again.  Where over half of all pairs would
    be edges, the new ones are chosen among the absent pairs.
    """
    edges = edges.select("src", "dst")
    if missing <= 0:
        return edges
    d = graph.degrees(nodes, edges)
    mean = d.agg(F.avg("degree").alias("_m"))
    low = attach(d, mean).where("degree <= _m").select("id")
    every = cut_lineage(with_hashed_index(nodes.select("id"), ["id"], "_i"))
    lows = cut_lineage(with_hashed_index(low, ["id"], "_i"))
    n, k = every.count(), lows.count()
    have = edges.where("src <> dst").count()
    missing = min(missing, n * (n - 1) // 2 - have)
    if missing <= 0:
        return edges
    if 4 * (have + missing) > n * (n - 1):
        ranked = with_global_index(cut_lineage(_absent_pairs(every, n, edges, seed)), ["e", "src", "dst"], "_i")
        return edges.unionByName(ranked.where(F.col("_i") < missing).select("src", "dst"))
    begin, out = 0, cut_lineage(edges)
    while missing > 0:
        draws = nodes.sparkSession.range(begin, begin + missing * 2 + 16)
        begin += missing * 2 + 16
        e = F.col("id")
        biased = (keyed.uniform("add-bias", e, seed=seed) < bias) & F.lit(k > 1)
        size = lambda tag: F.when(
            biased, keyed.index_below(max(k, 1), f"add-low-{tag}", e, seed=seed)
        ).otherwise(keyed.index_below(n, f"add-{tag}", e, seed=seed))
        draws = draws.select(e.alias("e"), biased.alias("_biased"), size("a").alias("_a"), size("b").alias("_b"))
        ends = every.select(F.lit(False).alias("_biased"), "_i", "id").unionByName(lows.select(F.lit(True).alias("_biased"), "_i", "id"))
        made = draws.join(ends.select("_biased", F.col("_i").alias("_a"), F.col("id").alias("x")), ["_biased", "_a"])
        made = made.join(ends.select("_biased", F.col("_i").alias("_b"), F.col("id").alias("y")), ["_biased", "_b"]).where("x <> y")
        fresh = made.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.min("e").alias("e"))
        fresh = fresh.join(out, ["src", "dst"], "left_anti")
        ranked = cut_lineage(with_global_index(cut_lineage(fresh), ["e"], "_i").where(F.col("_i") < missing).select("src", "dst"))
        missing -= ranked.count()
        out = out.unionByName(ranked)
        if begin > 64 * (n + have) + 4096:  # the low nodes may be joined to each other already: leave the bias
            bias = 0.0
    return out


def adjust_edge_count(nodes: DataFrame, edges: DataFrame, target: int, seed: int = keyed.SEED) -> DataFrame:
    have = edges.count()
    return remove_edges(edges, have - target, seed) if have > target else add_edges(nodes, edges, target - have, seed=seed)


def ensure_connected(nodes: DataFrame, edges: DataFrame, seed: int = keyed.SEED) -> DataFrame:
    """One bridge from every other component to the one with the smallest label."""
    labels = graph.connected_components(nodes, edges)
    pick = F.min_by("id", keyed.digest("bridge", F.col("id"), seed=seed))
    ends = labels.groupBy("component").agg(pick.alias("end"))
    hub = ends.agg(F.min("component").alias("_c"), F.min_by("end", "component").alias("_hub"))
    bridges = attach(ends, hub).where("component <> _c")
    made = bridges.select(F.least("end", "_hub").alias("src"), F.greatest("end", "_hub").alias("dst"))
    return edges.select("src", "dst").unionByName(made)


def adjacency_index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places(_i, src, dst), spans(src, _start, _n)): each node's neighbours at consecutive numbers."""
    places = cut_lineage(with_global_index(cut_lineage(graph.both_ways(edges)), ["src", "dst"], "_i"))
    return places, places.groupBy("src").agg(F.min("_i").alias("_start"), F.count("*").alias("_n"))


def open_pairs(simple: DataFrame) -> DataFrame:
    """(src, dst) of all pairs of nodes with a common neighbour and no edge.

    A centre's pairs are listed only if it has more of them than triangles.
    """
    sides = graph.both_ways(simple)
    corners = graph.triangles(simple).select(F.explode(F.array("a", "b", "c")).alias("src")).groupBy("src").agg(F.count("*").alias("closed"))
    sizes = sides.groupBy("src").agg(F.count("*").alias("n")).join(corners, "src", "left")
    centres = sizes.where(F.col("n") * (F.col("n") - 1) / 2 > F.coalesce("closed", F.lit(0))).select("src")
    around = cut_lineage(sides.join(centres, "src"))
    pairs = around.withColumnRenamed("dst", "a").join(around.withColumnRenamed("dst", "b"), "src").where("a < b")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct().join(simple, ["src", "dst"], "left_anti")


def close_triads(edges: DataFrame, k: int, seed: int = keyed.SEED) -> DataFrame:
    """Add k edges that close open wedges; fewer only where fewer pairs of nodes are open.

    Wedges are drawn, not listed: a random directed edge a -> u, then a random neighbour b of u, looked up by
    number.  A hub therefore costs what its drawn wedges cost.  Once a round of draws finds no open wedge, they are rare:
    then those that are left are listed, around the centres that have any.
    """
    if k <= 0:
        return edges.select("src", "dst")
    simple = cut_lineage(graph.simple_edges(edges))
    places, spans = adjacency_index(simple)
    total = places.agg(F.count("*").alias("_t"))
    begin, out = 0, simple
    while k > 0:
        draws = attach(edges.sparkSession.range(begin, begin + 4 * k + 16), total)  # spare draws for closed and repeated wedges
        begin += 4 * k + 16
        e = F.col("id")
        picked = draws.select(e.alias("e"), keyed.index_below(F.col("_t"), "wedge", e, seed=seed).alias("_i")).join(places, "_i").select("e", F.col("src").alias("a"), F.col("dst").alias("src"))
        second = picked.join(spans, "src").select("e", "a", (F.col("_start") + keyed.index_below(F.col("_n"), "wedge-b", F.col("e"), seed=seed)).alias("_i"))
        wedges = second.join(places.select("_i", F.col("dst").alias("b")), "_i").where("a <> b")
        fresh = wedges.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("e").alias("e"))
        fresh = fresh.join(out, ["src", "dst"], "left_anti")
        ranked = cut_lineage(with_global_index(cut_lineage(fresh), ["e"], "_i").where(F.col("_i") < k).select("src", "dst"))
        made = ranked.count()
        if made == 0:
            rest = open_pairs(simple).join(out, ["src", "dst"], "left_anti").withColumn("_h", F.xxhash64("src", "dst", F.lit(seed)))
            ranked = cut_lineage(with_global_index(cut_lineage(rest), ["_h", "src", "dst"], "_i").where(F.col("_i") < k).select("src", "dst"))
            return out.unionByName(ranked)
        k -= made
        out = out.unionByName(ranked)
    return out


def augment(nodes: DataFrame, edges: DataFrame, labels: DataFrame, extra: int, first_id: int, p_intra: float = 0.7, seed: int = keyed.SEED) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with ``extra`` more nodes numbered from ``first_id``.

    A new node takes the degree of a random node and the community of another (so by community size); its ends
    are degree-weighted draws, inside the community with probability ``p_intra``, from stubs numbered by community.
    """
    simple = cut_lineage(graph.simple_edges(edges))
    d = cut_lineage(graph.degrees(nodes, simple))
    every = cut_lineage(with_hashed_index(d.join(labels, "id"), ["id"], "_i"))
    n = every.count()
    new = nodes.sparkSession.range(extra)
    e = F.col("id")
    drawn = new.select(e.alias("id"), keyed.index_below(n, "aug-degree", e, seed=seed).alias("_d"), keyed.index_below(n, "aug-home", e, seed=seed).alias("_h"))
    drawn = drawn.join(every.select(F.col("_i").alias("_d"), F.greatest(F.col("degree"), F.lit(1)).alias("degree")), "_d").join(
        every.select(F.col("_i").alias("_h"), "community"), "_h"
    )
    stub_rows = cut_lineage(stubs(d.where("degree > 0")).join(labels, "id"))
    places = cut_lineage(with_global_index(stub_rows, ["community", "id", "_j"], "_s").select("_s", F.col("id").alias("end"), "community"))
    spans = places.groupBy("community").agg(F.min("_s").alias("_start"), F.count("*").alias("_n"))
    total = places.agg(F.count("*").alias("_t"))
    slots = expand_counts(drawn.select("id", "degree", "community"), "degree", "_j")
    # spans of the largest communities are broadcast; slots of the others are joined
    sized = attach(fact_join(slots, cut_lineage(spans), ["community"], "_n"), total)
    ids = [F.col("id"), F.col("_j")]
    inside = (keyed.uniform("aug-in", *ids, seed=seed) < p_intra) & F.col("_n").isNotNull()
    spot = F.when(inside, F.col("_start") + keyed.index_below(F.col("_n"), "aug-a", *ids, seed=seed)).otherwise(keyed.index_below(F.col("_t"), "aug-b", *ids, seed=seed))
    made = sized.withColumn("_s", spot).join(places.select("_s", "end"), "_s").select(F.col("end").alias("src"), (F.col("id") + first_id).alias("dst"))
    out_edges = simple.unionByName(graph.simple_edges(made)).distinct()
    return nodes.select("id").unionByName(new.select((F.col("id") + first_id).alias("id"))), out_edges


# --- the whole run ----------------------------------------------------------


def choose_model(stats: dict, power_law: float) -> str:
    """Model by topology; the inputs are one row of statistics."""
    n, density, clustering = stats["nodes"], stats["density"], stats["clustering_coefficient"]
    if n == 0:
        return "erdos_renyi"
    if n < 200:
        return "barabasi_albert" if power_law > 0.85 else "configuration"
    if power_law > 0.7:
        return "barabasi_albert"
    if clustering / max(density, 1e-6) > 3.0 and density < 0.3:
        return "watts_strogatz"
    if clustering > 0.15 and density < 0.5:
        return "stochastic_block"
    return "configuration"


def synthesize_graph(nodes: DataFrame, edges: DataFrame, n: int | None = None, model: str | None = None, connect: bool = True, seed: int = keyed.SEED) -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, model): a graph of n nodes that resembles the observed one."""
    spark = nodes.sparkSession
    simple = cut_lineage(graph.simple_edges(edges))
    stats = graph.graph_stats(nodes, simple, simple=simple).first().asDict()
    n = n or stats["nodes"]
    if model is None:
        model = choose_model(stats, graph.power_law_score(nodes, simple).first()[0])
    if model in ("configuration", "chung_lu"):
        sequence = scale_degree_sequence(graph.degrees(nodes, simple), n)
        use_chung_lu = model == "chung_lu" or stats["density"] > 0.3
        made = chung_lu(sequence, seed) if use_chung_lu else configuration_model(sequence, seed)
    elif model == "barabasi_albert":
        made = barabasi_albert(spark, n, max(1, round(stats["avg_degree"] / 2)), seed)
    elif model == "watts_strogatz":
        made = watts_strogatz(spark, n, *rewire_share(stats["avg_degree"], stats["clustering_coefficient"], n), seed)
    elif model == "stochastic_block":
        labels = graph.communities(nodes, simple)
        mix = graph.community_mixing(labels, simple).first()
        p_inter = min(max(mix.p_inter, 0.001), 0.95)
        made = stochastic_block(block_sizes(labels, n), min(max(mix.p_intra, 0.01), 0.95), p_inter, seed)
    elif model == "erdos_renyi":
        made = erdos_renyi(spark, n, stats["density"], seed)
    else:
        raise ValueError(f"unknown graph model: {model}")
    out_nodes = numbered_nodes(spark, n)
    made = cut_lineage(made)
    target = max(1, round(stats["edges"] * n / max(1, stats["nodes"])))
    made = cut_lineage(adjust_edge_count(out_nodes, made, target, seed))
    if connect and stats["connected_components"] == 1:
        made = cut_lineage(ensure_connected(out_nodes, made, seed))
    return out_nodes, made, model
