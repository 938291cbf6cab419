"""Graphs over the whole line table.

The part graph joins every part of an order to the part of the next line.  The lines of ordinary orders meet in one window;
those of very long orders are numbered all together and shifted by one, so no group has more than ORDER_LINES lines.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabwright.operators import graph, graph_models
from tabwright.operators.indexing import with_global_index
from tabwright.operators.scalars import attach
from tabwright.plans.drift_queries import rounded
from tabwright.plans.registry import query, sql_digest, sql_index, sql_uniform, table
from tabwright.session import cut_lineage


#: Lines up to which an order is one group of a window; the lines of longer orders are numbered all together.
ORDER_LINES = 10_000


def _line_pairs(lines, most=ORDER_LINES):
    """(src, dst) of the parts of every two different lines that follow each other in an order, repeats included."""
    place = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = lines.select(*place).where("l_orderkey IS NOT NULL")
    long = cut_lineage(lines.groupBy("l_orderkey").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("l_orderkey"))
    some = not long.isEmpty()
    # fewer orders than one in ``most`` lines are long
    short = lines.join(F.broadcast(long), "l_orderkey", "left_anti") if some else lines
    # dealt by order once, for the distinct lines and for their order
    short = short.repartition("l_orderkey").distinct()
    pairs = short.select(F.col("l_partkey").alias("_a"), F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy(*place[1:])).alias("_b"))
    if some:
        rows = cut_lineage(lines.join(F.broadcast(long), "l_orderkey", "left_semi").distinct())
        numbered = cut_lineage(with_global_index(rows, place, "_i"))
        after = numbered.select((F.col("_i") - 1).alias("_i"), F.col("l_orderkey").alias("_o"), F.col("l_partkey").alias("_b"))
        joined = numbered.join(after, "_i").where("l_orderkey = _o")
        pairs = pairs.unionByName(joined.select(F.col("l_partkey").alias("_a"), "_b"))
    return pairs.where("_a <> _b").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"))


def part_graph(spark, folder):
    ends = _line_pairs(table(spark, folder, "lineitem"))
    edges = cut_lineage(ends.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    nodes = table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    return nodes, edges


EDGES = """(SELECT least(p, q) AS src, greatest(p, q) AS dst, count(*)::DOUBLE AS weight FROM (
    SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS q FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))
    WHERE q IS NOT NULL AND p <> q GROUP BY 1, 2)"""
WAYS = f"(SELECT src AS u, dst AS v FROM {EDGES} UNION ALL SELECT dst, src FROM {EDGES})"
DEGREES = f"(SELECT p_partkey AS id, coalesce(k, 0) AS degree FROM part LEFT JOIN (SELECT u, count(*) AS k FROM {WAYS} GROUP BY 1) ON u = p_partkey)"


@query("graph_edges", f"SELECT src, dst, weight FROM {EDGES}")
def graph_edges(spark, folder):
    return part_graph(spark, folder)[1]


_STATS = f"""(SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, sum(degree) / (count(*) * (count(*) - 1.0::DOUBLE)) AS density,
    sum(degree) / count(*) AS avg_degree, max(degree) AS max_degree, min(degree) AS min_degree FROM {DEGREES})"""


@query("graph_size_stats", f"SELECT * REPLACE (round(density, 9) AS density, round(avg_degree, 6) AS avg_degree) FROM {_STATS}")
def graph_size_stats(spark, folder):
    return rounded(graph.size_stats(*part_graph(spark, folder)), density=9, avg_degree=6)


@query("node_degrees", f"SELECT id, degree FROM {DEGREES}")
def node_degrees(spark, folder):
    return graph.degrees(*part_graph(spark, folder))


_LOCAL = f"""(WITH e AS MATERIALIZED (SELECT src, dst FROM {EDGES}), t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst),
    k AS (SELECT id, count(*) AS triangles FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY 1)
    SELECT d.id, degree, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN coalesce(triangles, 0) * 2::DOUBLE / (degree * (degree - 1)) ELSE 0 END AS clustering FROM {DEGREES} d LEFT JOIN k USING (id))"""


@query("local_clustering", f"SELECT id, degree, triangles, round(clustering, 9) AS clustering FROM {_LOCAL}")
def local_clustering(spark, folder):
    return rounded(graph.local_clustering(*part_graph(spark, folder)), clustering=9)


@query("average_clustering", f"SELECT round(avg(clustering), 9) AS clustering_coefficient FROM {_LOCAL}")
def average_clustering(spark, folder):
    return rounded(graph.average_clustering(*part_graph(spark, folder)), clustering_coefficient=9)


def party_graph(spark, folder):
    """Customers and their orders; customers get negative ids so that the two kinds do not meet."""
    orders = table(spark, folder, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("id")).unionByName(table(spark, folder, "customer").select((-F.col("c_custkey") - 1).alias("id")))
    return nodes, orders.select((-F.col("o_custkey") - 1).alias("src"), F.col("o_orderkey").alias("dst"))


_LABELS = "(SELECT o_orderkey AS id, -o_custkey - 1 AS component FROM orders UNION ALL SELECT -c_custkey - 1, -c_custkey - 1 FROM customer)"


@query("connected_components", f"SELECT id, component FROM {_LABELS}")
def connected_components(spark, folder):
    return graph.connected_components(*party_graph(spark, folder))


@query("component_sizes", f"SELECT component, count(*) AS size FROM {_LABELS} GROUP BY 1")
def component_sizes(spark, folder):
    return graph.component_sizes(graph.connected_components(*party_graph(spark, folder)))


@query("degree_distribution", f"SELECT degree, count(*) AS nodes FROM {DEGREES} GROUP BY 1")
def degree_distribution(spark, folder):
    return graph.degree_distribution(*part_graph(spark, folder))


@query("power_law_score", f"SELECT round(pow(corr(ln(degree), ln(n)), 2), 6) AS power_law_score FROM (SELECT degree, count(*) AS n FROM {DEGREES} WHERE degree > 0 GROUP BY 1)")
def power_law_score(spark, folder):
    return rounded(graph.power_law_score(*part_graph(spark, folder)), power_law_score=6)


@query(
    "label_propagation",
    # a node's own label counts once more: an edge to itself; thirty rounds, of which the last change nothing
    f"""WITH RECURSIVE w AS MATERIALIZED (SELECT u, v FROM {WAYS} UNION ALL SELECT p_partkey, p_partkey FROM part), l AS (
        SELECT 0 AS step, p_partkey AS id, p_partkey AS community FROM part
        UNION ALL
        SELECT step + 1, id, community FROM (
          SELECT step, id, community, row_number() OVER (PARTITION BY id ORDER BY n DESC, community) AS r FROM
            (SELECT l.step, w.u AS id, l.community, count(*) AS n FROM l JOIN w ON w.v = l.id WHERE l.step < 30 GROUP BY ALL)) WHERE r = 1)
      SELECT id, community FROM l WHERE step = 30""",
)
def label_propagation(spark, folder):
    return graph.communities(*part_graph(spark, folder))


@query(
    "community_mixing",
    f"""WITH l AS (SELECT p_partkey AS id, p_brand AS community FROM part), s AS (SELECT community, count(*)::DOUBLE AS k FROM l GROUP BY 1),
      m AS (SELECT count(*) FILTER (WHERE a.community = b.community) AS ie, count(*) FILTER (WHERE a.community <> b.community) AS oe FROM {EDGES} e JOIN l a ON a.id = src JOIN l b ON b.id = dst),
      r AS (SELECT count(*) AS communities, sum(k) AS n, sum(k * (k - 1) / 2) AS ip FROM s)
      SELECT communities, ie AS intra_edges, oe AS inter_edges, round(ie / ip, 9) AS p_intra, round(oe / (n * (n - 1) / 2 - ip), 9) AS p_inter FROM m, r""",
)
def community_mixing(spark, folder):
    _, edges = part_graph(spark, folder)
    labels = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return rounded(graph.community_mixing(labels, edges), p_intra=9, p_inter=9)


@query(
    "scaled_degree_sequence",
    f"""WITH o AS (SELECT degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS i FROM {DEGREES}), n AS (SELECT count(*) AS n0, count(*) * 3 // 2 AS n FROM part),
      r AS (SELECT id, greatest(1, least(n - 1, degree)) AS degree FROM (SELECT unnest(range((SELECT n FROM n))) AS id), n JOIN o ON i = id * n0 // n)
      SELECT id, degree + CASE WHEN id = 0 THEN (SELECT sum(degree) % 2 FROM r)::BIGINT ELSE 0 END AS degree FROM r""",
)
def scaled_degree_sequence(spark, folder):
    nodes, edges = part_graph(spark, folder)
    return graph_models.scale_degree_sequence(graph.degrees(nodes, edges), nodes.count() * 3 // 2)


_STUBS = f"(SELECT id, unnest(range(degree)) AS j FROM {DEGREES})"


@query(
    "configuration_model",
    f"""SELECT DISTINCT src, dst FROM (SELECT min(id) AS src, max(id) AS dst, count(*) AS k FROM (
        SELECT id, (row_number() OVER (ORDER BY {sql_digest('stub', 'id', 'j')}, id, j) - 1) // 2 AS p FROM {_STUBS}) GROUP BY p) WHERE k = 2 AND src <> dst""",
)
def configuration_model(spark, folder):
    nodes, edges = part_graph(spark, folder)
    return graph_models.configuration_model(graph.degrees(nodes, edges))


def _side_sql(tag, end):
    return f"""(SELECT id, row_number() OVER (ORDER BY {sql_digest(tag, 'id', 'j')}, id, j) AS i FROM
        (SELECT id, unnest(range(k)) AS j FROM (SELECT {end} AS id, count(*) AS k FROM {EDGES} GROUP BY 1)))"""


@query(
    "directed_configuration_model",
    f"SELECT DISTINCT a.id AS src, b.id AS dst FROM {_side_sql('out-stub', 'src')} a JOIN {_side_sql('in-stub', 'dst')} b USING (i) WHERE a.id <> b.id",
)
def directed_configuration_model(spark, folder):
    _, edges = part_graph(spark, folder)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return graph_models.directed_configuration_model(out.join(inn, "id", "full").na.fill(0, ["out_degree", "in_degree"]))


@query(
    "chung_lu_model",
    f"""WITH s AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY substr(sha256(concat_ws('|', id, j)), 1, 3), id, j) - 1 AS i FROM {_STUBS}), t AS (SELECT count(*) AS n FROM s),
      d AS (SELECT {sql_index('n', 'cl-a', 'e')} AS a, {sql_index('n', 'cl-b', 'e')} AS b FROM (SELECT unnest(range(((SELECT n FROM t) + 1) // 2)) AS e), t)
      SELECT DISTINCT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst FROM d JOIN s x ON x.i = a JOIN s y ON y.i = b WHERE x.id <> y.id""",
)
def chung_lu_model(spark, folder):
    nodes, edges = part_graph(spark, folder)
    return graph_models.chung_lu(graph.degrees(nodes, edges))


def _observed(spark, folder):
    nodes, edges = part_graph(spark, folder)
    return nodes, edges, graph.size_stats(nodes, edges).first()


@query(
    "preferential_attachment_model",
    f"""WITH RECURSIVE c AS (SELECT nodes AS n, round(avg_degree / 2)::BIGINT AS m FROM {_STATS}),
      h AS (SELECT e, 2 * e + 1 AS place FROM (SELECT unnest(range((SELECT n * m FROM c))) AS e) UNION ALL SELECT e, {sql_index('place', 'ba', 'place')} FROM h WHERE place % 2 = 1)
      SELECT DISTINCT least(e // m, place // (2 * m)) AS src, greatest(e // m, place // (2 * m)) AS dst FROM h, c WHERE place % 2 = 0 AND e // m <> place // (2 * m)""",
)
def preferential_attachment_model(spark, folder):
    _, _, stats = _observed(spark, folder)
    return graph_models.barabasi_albert(spark, stats.nodes, round(stats.avg_degree / 2))


@query(
    "random_graph_model",
    f"""WITH t AS (SELECT nodes * (nodes - 1) // 2 AS pairs, round(-(nodes * (nodes - 1) // 2) * ln(1 - density))::BIGINT AS m FROM {_STATS}),
      d AS (SELECT {sql_index('pairs', 'er', 'id')} AS k FROM (SELECT unnest(range((SELECT m FROM t))) AS id), t)
      SELECT DISTINCT k - i * (i - 1) // 2 AS src, i AS dst FROM (SELECT k, floor((sqrt(8::DOUBLE * k + 1) + 1) / 2)::BIGINT AS i FROM d)""",
)
def random_graph_model(spark, folder):
    _, _, stats = _observed(spark, folder)
    return graph_models.erdos_renyi(spark, stats.nodes, stats.density)


@query(
    "small_world_model",
    f"""WITH o AS (SELECT nodes AS n, greatest(2, round(avg_degree))::BIGINT AS d, (SELECT avg(clustering) FROM {_LOCAL}) AS c FROM {_STATS}),
      k AS (SELECT n, c, least(d + d % 2, n - 1 - (n - 1) % 2) AS k FROM o),
      b AS (SELECT *, CASE WHEN k > 2 AND c > 0 THEN greatest(0.01::DOUBLE, least(0.99::DOUBLE, 1 - c / (3 * (k - 2) / (4 * (k - 1))::DOUBLE))) ELSE 0.3 END AS beta FROM k),
      e AS (SELECT i, unnest(range(1, greatest(1, k // 2) + 1)) AS j, n, beta FROM (SELECT unnest(range(n)) AS i, n, k, beta FROM b)),
      t AS (SELECT i, {sql_index('n - 1', 'ws-to', 'i', 'j')} AS o, {sql_uniform('ws', 'i', 'j')} < beta AS moved, (i + j) % n AS near FROM e),
      f AS (SELECT i, CASE WHEN moved THEN o + (o >= i)::BIGINT ELSE near END AS x FROM t)
      SELECT DISTINCT least(i, x) AS src, greatest(i, x) AS dst FROM f WHERE i <> x""",
)
def small_world_model(spark, folder):
    nodes, edges, stats = _observed(spark, folder)
    clustering = graph.average_clustering(nodes, edges).first()[0]
    return graph_models.watts_strogatz(spark, stats.nodes, *graph_models.rewire_share(stats.avg_degree, clustering, stats.nodes))


@query("block_model")
def block_model(spark, folder):
    nodes, edges, stats = _observed(spark, folder)
    labels = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    mix = graph.community_mixing(labels, edges).first()
    return graph_models.stochastic_block(graph_models.block_sizes(labels, stats.nodes), mix.p_intra, mix.p_inter)


@query(
    "block_sizes",
    """WITH s AS (SELECT p_brand AS block, count(*) AS k FROM part GROUP BY 1), c AS (SELECT block, sum(k) OVER (ORDER BY block) AS high, k FROM s), t AS (SELECT count(*) AS n FROM part)
       SELECT block, round((high - k) * (n * 2) / n)::BIGINT AS start, round(high * (n * 2) / n)::BIGINT - round((high - k) * (n * 2) / n)::BIGINT AS size FROM c, t""",
)
def block_sizes(spark, folder):
    labels = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return graph_models.block_sizes(labels, labels.count() * 2)


@query("edge_count_adjusted", f"SELECT count(*) * 9 // 10 AS edges, true AS all_nodes_kept FROM {EDGES}")
def edge_count_adjusted(spark, folder):
    nodes, edges = part_graph(spark, folder)
    have = edges.count()
    less = graph_models.adjust_edge_count(nodes, edges, have * 9 // 10)
    kept = graph.node_table(less).agg(F.count("*").alias("k"))
    before = graph.node_table(edges).agg(F.count("*").alias("b"))
    return attach(attach(less.agg(F.count("*").alias("edges")), kept), before).select("edges", (F.col("k") == F.col("b")).alias("all_nodes_kept"))


@query("edge_count_raised", f"SELECT count(*) * 11 // 10 AS edges FROM {EDGES}")
def edge_count_raised(spark, folder):
    nodes, edges = part_graph(spark, folder)
    more = graph_models.adjust_edge_count(nodes, edges, edges.count() * 11 // 10)
    return more.distinct().agg(F.count("*").alias("edges"))


@query("bridged_components", "SELECT count(*) + (SELECT count(*) FROM customer) - 1 AS edges, 1::BIGINT AS components FROM orders")
def bridged_components(spark, folder):
    nodes, edges = party_graph(spark, folder)
    joined = graph_models.ensure_connected(nodes, edges)
    components = graph.connected_components(nodes, joined).agg(F.count_distinct("component").alias("components"))
    return attach(joined.agg(F.count("*").alias("edges")), components)


@query("triadic_closure", f"SELECT count(*) + count(*) // 20 AS edges FROM {EDGES}")
def triadic_closure(spark, folder):
    _, edges = part_graph(spark, folder)
    more = graph_models.close_triads(edges, edges.count() // 20)
    return more.distinct().agg(F.count("*").alias("edges"))


@query("augmented_graph")
def augmented_graph(spark, folder):
    nodes, edges = part_graph(spark, folder)
    labels = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    n = nodes.count()
    return graph_models.augment(nodes, edges, labels, n // 10, n)[1]


def attributed_parts(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), "p_brand", F.lit("kind"), "p_type").alias("attrs"))


@query(
    "attribute_catalogue",
    "SELECT 'brand' AS attribute, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'kind', p_type, count(*) FROM part GROUP BY 2",
)
def attribute_catalogue(spark, folder):
    return graph.attribute_catalogue(attributed_parts(spark, folder))


def _attribute_sql(name, column):
    return f"""(SELECT id, {column} AS {name} FROM (SELECT id, {sql_index('(SELECT count(*) FROM part)', f'attr:{name}', 'id')} AS spot FROM (SELECT p_partkey + 1000000 AS id FROM part))
        JOIN (SELECT {column}, row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS spot FROM part) USING (spot))"""


@query("drawn_attributes", f"SELECT id, brand, kind FROM {_attribute_sql('brand', 'p_brand')} JOIN {_attribute_sql('kind', 'p_type')} USING (id)")
def drawn_attributes(spark, folder):
    observed = attributed_parts(spark, folder)
    made = graph.draw_attributes(observed.select((F.col("id") + 1_000_000).alias("id")), observed, ["id"])
    return made.select("id", F.col("attrs")["brand"].alias("brand"), F.col("attrs")["kind"].alias("kind"))


@query("new_node_ids", "SELECT c_custkey AS id, 'Customer#' || ((SELECT max(substr(c_name, 10)::BIGINT) FROM customer) + 1 + c_custkey) AS node FROM customer")
def new_node_ids(spark, folder):
    rows = table(spark, folder, "customer")
    return graph.new_node_ids(rows.select(F.col("c_name").alias("id")), rows.select(F.col("c_custkey").alias("id")))


@query(
    "graph_comparison",
    f"""WITH a AS (SELECT * FROM {_STATS}), b AS (SELECT count(*) AS nodes, (SELECT count(*) FROM {EDGES} WHERE weight = 1) AS edges FROM part),
      v AS (SELECT 'nodes' AS statistic, a.nodes::DOUBLE AS o, b.nodes::DOUBLE AS s FROM a, b UNION ALL SELECT 'edges', a.edges, b.edges FROM a, b
        UNION ALL SELECT 'density', density, b.edges / (b.nodes * (b.nodes - 1) / 2) FROM a, b UNION ALL SELECT 'avg_degree', avg_degree, 2::DOUBLE * b.edges / b.nodes FROM a, b),
      r AS (SELECT statistic, o AS original, s AS synthetic, s / o AS ratio, 1 - abs(s - o) / greatest(o, s, 1) AS match_score FROM v)
      SELECT statistic, round(original, 6) AS original, round(synthetic, 6) AS synthetic, round(ratio, 6) AS ratio, round(match_score, 6) AS match_score FROM r
      UNION ALL SELECT 'overall', NULL, NULL, NULL, round(avg(match_score), 6) FROM r""",
)
def graph_comparison(spark, folder):
    nodes, edges = part_graph(spark, folder)
    keep = ["nodes", "edges", "density", "avg_degree"]
    out = graph.compare_stats(graph.size_stats(nodes, edges), graph.size_stats(nodes, edges.where("weight = 1")), keep)
    return rounded(out, original=6, synthetic=6, ratio=6, match_score=6)


_LARGEST = f"(SELECT component FROM (SELECT component, count(*) AS k FROM {_LABELS} GROUP BY 1) ORDER BY k DESC, component LIMIT 1)"


@query("display_nodes", f"""WITH c AS (SELECT id FROM {_LABELS} WHERE component = {_LARGEST} ORDER BY id LIMIT 10), e AS (SELECT -o_custkey - 1 AS src, o_orderkey AS dst FROM orders WHERE -o_custkey - 1 IN (SELECT id FROM c) AND o_orderkey IN (SELECT id FROM c))
    SELECT id, (SELECT count(*) FROM e WHERE src = id OR dst = id) AS degree FROM c""")
def display_nodes(spark, folder):
    return graph.display_subset(*party_graph(spark, folder), most=10)[0]


@query("synthetic_graph")
def synthetic_graph(spark, folder):
    nodes, edges = part_graph(spark, folder)
    return graph_models.synthesize_graph(nodes, edges)[1]


@query(
    "directed_clustering",
    f"""WITH d AS MATERIALIZED (SELECT CASE WHEN (src + dst) % 2 = 0 THEN src ELSE dst END AS src, CASE WHEN (src + dst) % 2 = 0 THEN dst ELSE src END AS dst FROM {EDGES}),
      e AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS s FROM d GROUP BY 1, 2),
      t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z, a.s * b.s * c.s AS w FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst),
      k AS (SELECT id, sum(w) AS w FROM (SELECT x AS id, w FROM t UNION ALL SELECT y, w FROM t UNION ALL SELECT z, w FROM t) GROUP BY 1),
      g AS (SELECT id, sum(s) AS total, sum((s = 2)::INT) AS mutual FROM (SELECT src AS id, s FROM e UNION ALL SELECT dst, s FROM e) GROUP BY 1)
      SELECT p_partkey AS id, round(CASE WHEN total * (total - 1) - 2 * mutual > 0 THEN coalesce(w, 0) / (total * (total - 1) - 2 * mutual)::DOUBLE ELSE 0 END, 9) AS clustering
      FROM part LEFT JOIN g ON g.id = p_partkey LEFT JOIN k ON k.id = p_partkey""",
)
def directed_clustering(spark, folder):
    nodes, edges = part_graph(spark, folder)
    turned = edges.select(F.when((F.col("src") + F.col("dst")) % 2 == 0, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when((F.col("src") + F.col("dst")) % 2 == 0, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    return rounded(graph.directed_clustering(nodes, turned), clustering=9)
