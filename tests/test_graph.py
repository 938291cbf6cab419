import json
import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators import graph
from tabwright.operators import graph_models as models
from tabwright.sources import graphs


def make(spark, pairs, extra=()):
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    nodes = graph.node_table(edges)
    if extra:
        nodes = nodes.union(spark.createDataFrame([(x,) for x in extra], "id bigint")).distinct()
    return nodes, edges


def random_pairs(n, m, seed=5):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def test_triangle(spark):
    nodes, edges = make(spark, [(1, 2), (1, 3), (2, 3)])
    s = graph.graph_stats(nodes, edges).first()
    assert (s.nodes, s.edges, s.density, s.clustering_coefficient, s.connected_components) == (3, 3, 1.0, 1.0, 1)


def test_clustering_and_components_against_brute_force(spark):
    pairs = random_pairs(60, 90) + [(100, 101), (101, 102)]
    # A hub with a third of all edges.
    pairs = sorted(set(pairs) | {(0, x) for x in range(1, 50)})
    nodes, edges = make(spark, pairs, [500])
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {500: 0.0}
    for v, ns in near.items():
        k = len(ns)
        links = sum(1 for a in ns for b in ns if a < b and b in near[a])
        expected[v] = 2 * links / (k * (k - 1)) if k > 1 else 0.0
    got = {r.id: r.clustering for r in graph.local_clustering(nodes, edges).collect()}
    assert got == pytest.approx(expected)
    label = {v: v for v in [*near, 500]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    assert {r.id: r.component for r in graph.connected_components(nodes, edges).collect()} == label


def test_components_of_a_long_path(spark):
    nodes, edges = make(spark, [(i, i + 1) for i in range(200)])
    assert graph.connected_components(nodes, edges).select("component").distinct().collect()[0][0] == 0


def test_directed_clustering_of_a_cycle(spark):
    nodes, edges = make(spark, [(1, 2), (2, 3), (3, 1)])
    assert {r.id: r.clustering for r in graph.directed_clustering(nodes, edges).collect()} == {1: 0.5, 2: 0.5, 3: 0.5}


def test_two_cliques_are_two_communities(spark):
    clique = lambda low: [(a, b) for a in range(low, low + 6) for b in range(a + 1, low + 6)]
    nodes, edges = make(spark, clique(0) + clique(10) + [(0, 10)])
    labels = {r.id: r.community for r in graph.communities(nodes, edges).collect()}
    assert len({labels[i] for i in range(6)}) == 1 and len({labels[i] for i in range(10, 16)}) == 1 and labels[1] != labels[11]


def is_simple(edges):
    rows = edges.collect()
    return len({(r.src, r.dst) for r in rows}) == len(rows) and all(r.src < r.dst for r in rows)


def test_models_are_simple_graphs(spark):
    nodes, edges = make(spark, random_pairs(80, 240))
    sequence = models.scale_degree_sequence(graph.degrees(nodes, edges), 100)
    assert sequence.count() == 100 and sequence.agg(F.sum("degree")).first()[0] % 2 == 0
    for made in (
        models.configuration_model(sequence), models.chung_lu(sequence), models.barabasi_albert(spark, 100, 3),
        models.erdos_renyi(spark, 100, 0.06), models.watts_strogatz(spark, 100, 6, 0.2),
    ):
        assert is_simple(made) and 150 <= made.count() <= 330


def test_pairs_are_decoded_exactly(spark):
    rows = spark.range(1000).select("id", *[c.alias(n) for c, n in zip(models._pair(F.col("id")), "ij")]).collect()
    assert {(r.i, r.j) for r in rows} == {(i, j) for i in range(46) for j in range(i) if i * (i - 1) // 2 + j < 1000}


def test_block_model_respects_probabilities(spark):
    sizes = spark.createDataFrame([("a", 0, 60), ("b", 60, 40)], "block string, start bigint, size bigint")
    rows = models.stochastic_block(sizes, 0.5, 0.02).collect()
    inside = sum(1 for r in rows if (r.src < 60) == (r.dst < 60))
    assert 1050 <= inside <= 1550 and 20 <= len(rows) - inside <= 80


def test_adjusting_and_bridging(spark):
    nodes, edges = make(spark, random_pairs(50, 150), [900, 901])
    m = edges.count()
    fewer = models.adjust_edge_count(nodes, edges, m - 40)
    assert fewer.count() == m - 40 and graph.node_table(fewer).count() == graph.node_table(edges).count()
    more = models.adjust_edge_count(nodes, edges, m + 30)
    assert more.count() == m + 30 and is_simple(more)
    joined = models.ensure_connected(nodes, edges)
    assert graph.connected_components(nodes, joined).select("component").distinct().count() == 1


def test_triads_close_wedges(spark):
    nodes, edges = make(spark, random_pairs(40, 80))
    before = graph.triangles(edges).count()
    after = models.close_triads(edges, 15)
    assert after.count() == edges.count() + 15 and graph.triangles(after).count() >= before + 15


def test_augmenting_adds_nodes(spark):
    nodes, edges = make(spark, random_pairs(40, 100))
    labels = nodes.select("id", (F.col("id") % 3).alias("community"))
    more_nodes, more_edges = models.augment(nodes, edges, labels, 10, 1000)
    assert more_nodes.count() == nodes.count() + 10 and is_simple(more_edges)
    assert more_edges.where("dst >= 1000").select("dst").distinct().count() == 10


def test_pipeline_keeps_size_and_connection(spark):
    nodes, edges = make(spark, random_pairs(60, 200))
    made_nodes, made, model = models.synthesize_graph(nodes, edges)
    assert model == "configuration" and made_nodes.count() == nodes.count() and is_simple(made)


def test_model_choice():
    stats = lambda n, d, c: {"nodes": n, "density": d, "clustering_coefficient": c}
    assert models.choose_model(stats(100, 0.1, 0.5), 0.9) == "barabasi_albert"
    assert models.choose_model(stats(100, 0.1, 0.5), 0.5) == "configuration"
    assert models.choose_model(stats(500, 0.01, 0.3), 0.1) == "watts_strogatz"
    assert models.choose_model(stats(500, 0.4, 0.5), 0.1) == "stochastic_block"
    assert models.choose_model(stats(500, 0.4, 0.1), 0.1) == "configuration"


GRAPHML = """<?xml version="1.0"?><graphml xmlns="http://wrong.example/ns">
<key id="d0" for="node" attr.name="title" attr.type="string"/><key id="d1" for="edge" attr.name="weight" attr.type="double"/>
<graph id="G" edgedefault="directed"><node id="a"><data key="d0">First</data></node><node id="b"><data key="d0">Second</data></node>
<edge source="b" target="a"><data key="d1">0.5</data></edge></graph></graphml>"""
GEXF = """<?xml version="1.0"?><gexf xmlns="http://www.gexf.net/1.2draft"><graph defaultedgetype="undirected">
<attributes class="node"><attribute id="0" title="kind" type="string"/></attributes>
<nodes><node id="a" label="A"><attvalues><attvalue for="0" value="x"/></attvalues></node><node id="b" label="B"/></nodes>
<edges><edge id="0" source="b" target="a" weight="2.0"/></edges></graph></gexf>"""


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges, directed = graphs.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert directed and {r.id: r.attrs["title"] for r in nodes.collect()} == {"a": "First", "b": "Second"}
    assert [(r.src, r.dst, r.weight) for r in edges.collect()] == [("b", "a", 0.5)]
    (tmp_path / "g.gexf").write_text(GEXF)
    nodes, edges, directed = graphs.read_gexf(spark, str(tmp_path / "g.gexf"))
    assert not directed and {r.id: r.attrs for r in nodes.collect()} == {"a": {"kind": "x"}, "b": {}}
    assert [(r.src, r.dst, r.weight) for r in edges.collect()] == [("a", "b", 2.0)]
    (tmp_path / "n.json").write_text(json.dumps({"nodes": [{"id": "x", "type": "t"}, {"id": "y"}], "links": [{"source": "y", "target": "x", "weight": 3}]}, indent=1))
    nodes, edges = graphs.read_node_link(spark, str(tmp_path / "n.json"))
    assert {r.id: r.attrs for r in nodes.collect()} == {"x": {"type": "t"}, "y": {}}
    assert [(r.src, r.dst, r.weight) for r in edges.collect()] == [("x", "y", 3.0)]
    (tmp_path / "a.json").write_text('{"p": ["q", {"id": "r"}], "q": ["p"], "lone": []}')
    nodes, edges = graphs.read_adjacency(spark, str(tmp_path / "a.json"))
    assert {r.id for r in nodes.collect()} == {"p", "q", "r", "lone"} and {(r.src, r.dst) for r in edges.collect()} == {("p", "q"), ("p", "r")}


def test_edge_list_rules(spark, tmp_path):
    (tmp_path / "h.csv").write_text("source,target,weight,note\n b , a ,0.5,x\na,b,0.9,y\na,c,heavy,z\n")
    _, edges = graphs.read_edge_list(spark, str(tmp_path / "h.csv"))
    assert {(r.src, r.dst, r.weight) for r in edges.collect()} == {("a", "b", 0.9), ("a", "c", 1.0)}
    (tmp_path / "n.csv").write_text("1,2\n2,3,4.5\n")
    nodes, edges = graphs.read_edge_list(spark, str(tmp_path / "n.csv"))
    assert nodes.count() == 3 and {(r.src, r.dst, r.weight) for r in edges.collect()} == {("1", "2", 1.0), ("2", "3", 4.5)}


def test_edge_targets_are_met(spark):
    """Dense graphs reach their target, stars give up protected edges, and regular graphs have low nodes."""
    pairs = [(a, b) for a in range(10) for b in range(a + 1, 10)]
    nodes = spark.range(10)
    dense = spark.createDataFrame(pairs[:40], "src long, dst long")
    full = models.adjust_edge_count(nodes, dense, 45)
    assert {tuple(r) for r in full.collect()} == set(pairs)
    assert models.adjust_edge_count(nodes, dense, 60).count() == 45
    star = spark.createDataFrame([(0, i) for i in range(1, 10)], "src long, dst long")
    assert models.adjust_edge_count(nodes, star, 5).count() == 5
    ring = spark.createDataFrame([(i, i + 1) for i in range(59)], "src long, dst long")
    more = models.adjust_edge_count(spark.range(60), ring, 200)
    assert more.distinct().count() == more.count() == 200 and more.where("src >= dst").count() == 0


def test_last_link_and_header_rule(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "weight": 1.0}, {"source": "b", "target": "a", "weight": 7.0}]}')
    _, edges = graphs.read_node_link(spark, str(tmp_path / "g.json"))
    assert [(r.src, r.dst, r.weight) for r in edges.collect()] == [("a", "b", 7.0)]
    (tmp_path / "e.csv").write_text("10.1,10.2\n\t\n10.2,10.3,4\n")
    _, edges = graphs.read_edge_list(spark, str(tmp_path / "e.csv"))
    assert {(r.src, r.dst, r.weight) for r in edges.collect()} == {("10.1", "10.2", 1.0), ("10.2", "10.3", 4.0)}


def test_written_xml_is_read_back(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b",), ('q"<x>',), ("lone",)], "id string")
    edges = spark.createDataFrame([("a & b", 'q"<x>', 2.5)], "src string, dst string, weight double")
    for kind, write, read in (("graphml", graphs.write_graphml, graphs.read_graphml), ("gexf", graphs.write_gexf, graphs.read_gexf)):
        write(nodes, edges, str(tmp_path / kind), directed=True)
        found, links, directed = read(spark, str(tmp_path / kind / "*"))
        assert directed and {r.id for r in found.collect()} == {"a & b", 'q"<x>', "lone"}
        assert [(r.src, r.dst, r.weight) for r in links.collect()] == [("a & b", 'q"<x>', 2.5)]


def test_labels_travel_until_none_changes(spark):
    nodes = spark.range(14)
    edges = nodes.where("id < 13").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.community for r in graph.communities(nodes, edges).collect()} == {0}


@pytest.mark.parametrize("folder_name", ["plain", "a b"])
def test_xml_elements_are_sought_in_their_own_files(spark, tmp_path, folder_name):
    path = str(tmp_path / folder_name)
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0)], "src string, dst string, weight double").repartition(2)
    graphs.write_graphml(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), edges, path)
    (tmp_path / "line").mkdir()
    (tmp_path / "line" / "g.graphml").write_text('<graphml><graph edgedefault="directed"><node id="x"/><edge source="y" target="x"/></graph></graphml>')
    rows = graphs._rows_of(spark, path + "/*", ["key", "node", "graph", "edge"])
    for tag, place in (("key", "keys"), ("graph", "graph"), ("node", "nodes"), ("edge", "edges")):
        files = rows(tag, "_id string").inputFiles()
        assert files and all(f"/{place}/" in f for f in files), tag
    got = graphs.read_graphml(spark, path + "/*")
    assert sorted(tuple(r) for r in got[1].select("src", "dst", "weight").collect()) == [("a", "b", 2.0), ("b", "c", 3.0)] and not got[2]
    nodes, edges, directed = graphs.read_graphml(spark, str(tmp_path / "line"))
    assert directed and [r.id for r in nodes.collect()] == ["x"] and [(r.src, r.dst) for r in edges.collect()] == [("y", "x")]
