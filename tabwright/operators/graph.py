"""Graph statistics on edge tables.

``nodes(id)`` and ``edges(src, dst[, weight])``; an undirected edge is stored once with src < dst.  Iterative
work writes each round to the checkpoint folder, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import keyed
from tabwright.operators.indexing import with_global_index
from tabwright.operators.joins import HEAVY_SHARE, SPREAD, fact_join
from tabwright.operators.scalars import attach
from tabwright.session import cut_lineage, shuffle_partitions


def node_table(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions."""
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected, no loops, no repeats."""
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return ends.where("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree), isolated nodes included.  Counts combine map-side, so a hub is one row per task."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def size_stats(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """One row: nodes, edges, density, average, largest and smallest degree."""
    d = degrees(nodes, edges).agg(
        F.count("*").alias("nodes"),
        F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.coalesce(F.min("degree"), F.lit(0)).alias("min_degree"),
    )
    m = F.col("ends") / 2
    pairs = F.col("nodes") * (F.col("nodes") - 1.0) / (1.0 if directed else 2.0)
    return d.select(
        "nodes",
        m.cast("bigint").alias("edges"),
        F.coalesce(F.try_divide(m, pairs), F.lit(0.0)).alias("density"),
        F.coalesce(F.try_divide("ends", "nodes"), F.lit(0.0)).alias("avg_degree"),
        "max_degree",
        "min_degree",
    )


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle of a simple undirected graph, once.

    Edges point from the end of lower degree to the other (ties by id), so no node has more than sqrt(2m)
    outgoing edges, and a hub with a third of all edges opens no wedges of its own.  An edge u -> v takes along the ends of u's
    later edges, and those that v points to as well close a triangle, so a row per edge is moved and not one per wedge.
    """
    return _triangles(cut_lineage(simple_edges(edges)))


def _triangles(simple: DataFrame) -> DataFrame:
    """Triangles of stored edges that are simple already."""
    d = cut_lineage(degrees(node_table(simple), simple))
    ranked = simple.join(d.select(F.col("id").alias("src"), F.col("degree").alias("_ds")), "src").join(
        d.select(F.col("id").alias("dst"), F.col("degree").alias("_dd")), "dst"
    )
    low_first = F.struct("_ds", "src") < F.struct(F.col("_dd").alias("_ds"), F.col("dst").alias("src"))
    oriented = ranked.select(
        F.when(low_first, F.col("src")).otherwise(F.col("dst")).alias("u"),
        F.when(low_first, F.col("dst")).otherwise(F.col("src")).alias("v"),
        F.least("_ds", "_dd").alias("_du"),
        F.greatest("_ds", "_dd").alias("_dv"),
    )
    ends = F.array_sort(F.collect_list(F.struct("_dv", "v")))
    outward = cut_lineage(oriented.groupBy("u").agg(F.first("_du").alias("_degree"), F.transform(ends, lambda x: x["v"]).alias("_out")))
    later = outward.select("u", "_out", F.posexplode("_out").alias("_at", "v")).where(F.col("_at") + 1 < F.size("_out"))
    later = later.select(F.col("u").alias("a"), F.col("v").alias("b"), F.expr("slice(_out, _at + 2, size(_out) - _at - 1)").alias("_later"))
    # the ends of the edges to one node are no more than its degree; a hub points to few nodes, which are broadcast
    around = outward.select(F.col("u").alias("b"), "_out", "_degree")
    met = fact_join(later, around, ["b"], "_degree")
    return met.select("a", "b", F.explode(F.array_intersect("_later", "_out")).alias("c"))


def triangle_counts(edges: DataFrame) -> DataFrame:
    return _corners(triangles(edges))


def _corners(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def local_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering); nodes of degree below 2 have 0."""
    simple = cut_lineage(simple_edges(edges))
    return _local_clustering(nodes, simple)


def _local_clustering(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    d = degrees(nodes, simple).join(_corners(_triangles(simple)), "id", "left")
    k, t = F.col("degree"), F.coalesce("triangles", F.lit(0))
    return d.select("id", "degree", t.alias("triangles"), F.when(k > 1, t * 2.0 / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def directed_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, clustering) for a directed graph: triangles weighted by the directions of their sides (Fagiolo 2007)."""
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    sides = plain.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("s"))
    t = triangles(sides)

    def side(x, y, name):
        return sides.select(F.col("src").alias(f"_{name}x"), F.col("dst").alias(f"_{name}y"), F.col("s").alias(f"_{name}"))

    out = t
    for name, (x, y) in {"p": ("a", "b"), "q": ("b", "c"), "r": ("a", "c")}.items():
        s = side(x, y, name)
        out = out.join(s, (F.least(x, y) == F.col(f"_{name}x")) & (F.greatest(x, y) == F.col(f"_{name}y"))).drop(f"_{name}x", f"_{name}y")
    weighted = out.select(F.explode(F.array("a", "b", "c")).alias("id"), (F.col("_p") * F.col("_q") * F.col("_r")).alias("w"))
    sums = weighted.groupBy("id").agg(F.sum("w").alias("w"))
    total = degrees(nodes, plain).withColumnRenamed("degree", "total")
    mutual = degrees(nodes, sides.where("s = 2")).withColumnRenamed("degree", "mutual")
    joined = total.join(mutual, "id").join(sums, "id", "left")
    room = F.col("total") * (F.col("total") - 1) - 2 * F.col("mutual")
    return joined.select("id", F.when(room > 0, F.coalesce("w", F.lit(0)) / room).otherwise(0.0).alias("clustering"))


def average_clustering(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    return _average(directed_clustering(nodes, edges) if directed else local_clustering(nodes, edges))


def _average(local: DataFrame) -> DataFrame:
    return local.agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("clustering_coefficient"))


# --- components -------------------------------------------------------------


def _fingerprint(stars: DataFrame) -> tuple:
    r = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each (weakly) connected component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round links nodes to the smallest
    id in sight, through joins with one row per node, so no neighbourhood is ever collected.  Links run from the larger
    id to the smaller; the root of a large component ends most of them, so what belongs to such nodes is broadcast.
    """
    return _components(nodes, cut_lineage(simple_edges(edges)))


def _components(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """Components of stored edges that are simple already."""
    links = simple.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen, number = None, links.count()
    while True:
        # large star: the larger neighbours of a node go to the smallest id it sees, itself included
        ends = F.array(
            F.struct(F.col("src").alias("id"), F.col("dst").alias("low"), F.lit(0).alias("n")),
            F.struct(F.col("dst").alias("id"), F.col("dst").alias("low"), F.lit(1).alias("n")),
        )
        least = links.select(F.inline(ends)).groupBy(F.col("id").alias("dst")).agg(F.min("low").alias("_m"), F.sum("n").alias("_n")).where("_n > 0")
        large = fact_join(links, least, ["dst"], "_n", number).select("src", F.col("_m").alias("dst"))
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them
        low = large.groupBy("src").agg(F.min("dst").alias("_m"), F.count("*").alias("_n"))
        joined = fact_join(large, low, ["src"], "_n", number)
        pairs = F.array(F.struct("src", F.col("_m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("_m").alias("dst")))
        small = joined.select(F.inline(pairs)).where("src <> dst").distinct()
        links = cut_lineage(small)
        mark = _fingerprint(links)
        if mark == seen:
            break
        seen, number = mark, mark[0]
    roots = links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


# --- degree shape -----------------------------------------------------------


def degree_distribution(nodes: DataFrame, edges: DataFrame, first: int | None = None) -> DataFrame:
    """(degree, nodes), of the smallest so many degrees if asked."""
    counts = degrees(nodes, edges).groupBy("degree").agg(F.count("*").alias("nodes"))
    return counts if first is None else counts.orderBy("degree").limit(first)


def power_law_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: R-squared of ln(count) on ln(degree); 0 below five nodes or three distinct degrees."""
    counts = degrees(nodes, edges).groupBy("degree").agg(F.count("*").alias("n"))
    x, y = F.log(F.when(F.col("degree") > 0, F.col("degree"))), F.log("n")
    r = counts.agg(
        F.sum("n").alias("nodes"), F.count(x).alias("points"), F.count("*").alias("distinct_degrees"),
        F.corr(x, F.when(F.col("degree") > 0, y)).alias("r"),
    )
    usable = (F.col("nodes") >= 5) & (F.col("distinct_degrees") >= 3) & (F.col("points") >= 3) & F.col("r").isNotNull() & ~F.isnan("r")
    return r.select(F.when(usable, F.least(F.lit(1.0), F.col("r") * F.col("r"))).otherwise(0.0).alias("power_law_score"))


# --- communities ------------------------------------------------------------


def communities(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, community) by synchronous label propagation; the smallest of equally frequent labels wins.

    A node counts its own label once more, which keeps two-coloured structures from swapping for ever. The loop
    ends when the labels of an earlier round come back, the last one's included; a caller may bound the rounds.

    Edges are dealt by the node that tells its label once, so a round moves the labels and one vote per edge.  Hubs, fewer
    than HEAVY_SHARE, are broadcast as tellers, and their votes are counted in many parts.
    """
    spark = nodes.sparkSession
    n = shuffle_partitions(spark)
    ways = cut_lineage(both_ways(simple_edges(edges)))
    total = ways.count()
    hubs = ways.groupBy(F.col("dst").alias("_h")).agg(F.count("*").alias("_degree")).where(F.col("_degree") * HEAVY_SHARE > total)
    hubs = F.broadcast(cut_lineage(hubs.select("_h")))
    voters = ways.join(hubs.withColumn("_hub", F.lit(True)), F.col("src") == F.col("_h"), "left")
    part = F.when(F.col("_hub"), F.pmod(F.xxhash64("dst"), F.lit(SPREAD)).cast("int") + 1).otherwise(F.lit(0))
    voters = voters.select("src", "dst", part.alias("_part"))
    many = cut_lineage(voters.join(hubs, F.col("dst") == F.col("_h"), "left_semi"))
    few = voters.join(hubs, F.col("dst") == F.col("_h"), "left_anti").repartition(n, "dst").sortWithinPartitions("dst", "src")
    few = cut_lineage(few, keep_layout=True)
    labels = nodes.select("id", F.col("id").alias("community")).where("id IS NOT NULL")
    marks: set[tuple] = {_labels_mark(labels)}
    done = 0
    while rounds is None or done < rounds:
        tellers = labels.withColumnRenamed("id", "dst")
        told = few.join(tellers, "dst").select("src", "_part", "community")
        loud = F.broadcast(tellers.join(hubs, F.col("dst") == F.col("_h"), "left_semi"))
        told = told.unionByName(many.join(loud, "dst").select("src", "_part", "community"))
        own = labels.join(hubs.withColumn("_hub", F.lit(1)), F.col("id") == F.col("_h"), "left")
        cast = told.withColumnRenamed("src", "id").unionByName(own.select("id", F.coalesce("_hub", F.lit(0)).alias("_part"), "community"))
        votes = cast.repartition(n, "id", "_part").groupBy("id", "_part", "community").agg(F.count("*").alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("community")
        after = votes.where("_part = 0").groupBy("id", "_part").agg(best).select("id", "community")
        of_hubs = votes.where("_part > 0").groupBy("id", "community").agg(F.sum("n").alias("n"))
        labels = cut_lineage(after.unionByName(of_hubs.groupBy("id").agg(best)))
        done += 1
        mark = _labels_mark(labels)
        if mark in marks:
            break
        marks.add(mark)
    return labels


def _labels_mark(labels: DataFrame) -> tuple:
    return tuple(labels.agg(F.count("*"), F.sum(F.xxhash64("id", "community").cast("decimal(38,0)"))).first())


def community_mixing(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: communities, intra and inter edges, and the edge probabilities inside and between communities."""
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("_a"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    sides = edges.select("src", "dst").join(a, "src").join(b, "dst")
    counted = sides.agg(F.count_if(F.col("_a") == F.col("_b")).alias("intra_edges"), F.count_if(F.col("_a") != F.col("_b")).alias("inter_edges"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("k"))
    room = sizes.agg(
        F.count("*").alias("communities"), F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("intra_pairs")
    )
    both = attach(counted, room)
    inter_pairs = F.col("n") * (F.col("n") - 1) / 2 - F.col("intra_pairs")
    return both.select(
        "communities", "intra_edges", "inter_edges",
        F.coalesce(F.try_divide("intra_edges", "intra_pairs"), F.lit(0.0)).alias("p_intra"),
        F.coalesce(F.try_divide(F.col("inter_edges"), inter_pairs), F.lit(0.0)).alias("p_inter"),
    )


# --- whole profiles ---------------------------------------------------------


def graph_stats(nodes: DataFrame, edges: DataFrame, directed: bool = False, simple: DataFrame | None = None) -> DataFrame:
    """One row with every statistic the comparison needs; ``simple`` are the stored edges of :func:`simple_edges`, if there are."""
    simple = cut_lineage(simple_edges(edges)) if simple is None else simple
    found = _components(nodes, simple).agg(F.count_distinct("component").alias("connected_components"))
    local = directed_clustering(nodes, edges) if directed else _local_clustering(nodes, simple)
    row = attach(size_stats(nodes, edges, directed), _average(local))
    return attach(row, found)


COMPARED = ["nodes", "edges", "density", "avg_degree", "clustering_coefficient"]
STRUCTURAL = ["density", "avg_degree", "clustering_coefficient"]


def compare_stats(first: DataFrame, second: DataFrame, keep: list[str] = COMPARED) -> DataFrame:
    """(statistic, original, synthetic, ratio, match_score) plus an ``overall`` row with the mean score."""

    def long(row, name):
        cells = [F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias(name)) for c in keep]
        return row.select(F.inline(F.array(*cells)))

    joined = long(first, "original").join(F.broadcast(long(second, "synthetic")), "statistic")
    o, s = F.col("original"), F.col("synthetic")
    score = F.when(o > 0, F.lit(1.0) - F.abs(s - o) / F.greatest(o, s, F.lit(1.0))).otherwise(1.0)
    rows = joined.withColumn("ratio", F.coalesce(F.try_divide(s, o), F.lit(0.0))).withColumn("match_score", score)
    overall = rows.agg(F.avg("match_score").alias("match_score")).select(
        F.lit("overall").alias("statistic"), *[F.lit(None).cast("double").alias(c) for c in ("original", "synthetic", "ratio")], "match_score"
    )
    return rows.unionByName(overall)


def display_subset(nodes: DataFrame, edges: DataFrame, most: int = 150) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, edges) of the first nodes of the largest component; the smaller label breaks a tie."""
    labels = connected_components(nodes, edges)
    largest = component_sizes(labels).orderBy(F.desc("size"), "component").limit(1)
    members = labels.join(F.broadcast(largest.select("component")), "component", "left_semi").select("id")
    chosen = members.orderBy("id").limit(most)
    # At most ``most`` ids, a parameter: safe to broadcast.
    kept = edges.join(F.broadcast(chosen.withColumnRenamed("id", "src")), "src", "left_semi").join(
        F.broadcast(chosen.withColumnRenamed("id", "dst")), "dst", "left_semi"
    )
    return degrees(chosen, kept), kept


def node_id_pattern(nodes: DataFrame) -> DataFrame:
    """One row: the commonest prefix of ``prefix + number`` ids and the largest number seen."""
    text = F.col("id").cast("string")
    parts = nodes.select(F.regexp_extract(text, r"^(.*?)(\d+)$", 1).alias("prefix"), F.regexp_extract(text, r"^(.*?)(\d+)$", 2).alias("number")).where("number <> ''")
    counted = parts.groupBy("prefix").agg(F.count("*").alias("n"), F.max(F.col("number").try_cast("bigint")).alias("top"))
    return counted.agg(F.min_by("prefix", F.struct(-F.col("n"), F.col("prefix"))).alias("prefix"), F.max("top").alias("top"))


def new_node_ids(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``node`` to rows numbered by ``id``: the observed naming pattern continued."""
    sized = attach(rows, node_id_pattern(nodes))
    named = F.concat("prefix", (F.col("top") + 1 + F.col("id")).cast("string"))
    return sized.withColumn("node", F.coalesce(named, F.concat(F.lit("new_node_"), F.col("id").cast("string")))).drop("prefix", "top")


def attribute_catalogue(table: DataFrame, column: str = "attrs") -> DataFrame:
    """(attribute, value, n) of a map column."""
    rows = table.select(F.explode(column).alias("attribute", "value"))
    return rows.groupBy("attribute", "value").agg(F.count("*").alias("n"))


def draw_attributes(rows: DataFrame, observed: DataFrame, keys: list[str], column: str = "attrs", seed: int = keyed.SEED) -> DataFrame:
    """Add a map of attributes to rows, each attribute drawn on its own from its observed values.

    Observed values are numbered per attribute by splitting the global order at the attributes, and every draw
    is an equi-join on (attribute, number).
    """
    values = observed.select(*[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(observed.columns) if k != column], F.explode(column).alias("attribute", "value"))
    order = ["attribute", *[c for c in values.columns if c.startswith("_k")]]
    numbered = cut_lineage(with_global_index(cut_lineage(values), order, "_i"))
    spans = numbered.groupBy("attribute").agg(F.min("_i").alias("_start"), F.count("*").alias("_n"))
    names = spans.collect()  # one row per attribute name
    if not names:
        return rows.withColumn(column, F.create_map().cast("map<string,string>"))
    ids = [F.col(k) for k in keys]
    picks = F.array(
        *[
            F.struct(F.lit(s.attribute).alias("attribute"), (F.lit(s["_start"]) + keyed.index_below(s["_n"], f"attr:{s.attribute}", *ids, seed=seed)).alias("_i"))
            for s in names
        ]
    )
    drawn = rows.select(*keys, F.inline(picks)).join(numbered.select("attribute", "_i", "value"), ["attribute", "_i"])
    # One entry per attribute name and row.
    maps = drawn.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias(column))
    return rows.join(maps, keys, "left")

