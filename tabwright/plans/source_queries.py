"""Scans and sinks: the given tables written in a format and read back through the scan under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.plans.registry import query, table
from tabwright.plans.scratch import scratch_path
from tabwright.session import cut_lineage
from tabwright.sources import graphs, logs, tables


@query("csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_scan(spark, folder):
    path = scratch_path(spark, "orders") + ".csv"
    kept = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    tables.write_csv(kept, path)
    back = tables.read_table(spark, path)
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), *kept.columns[2:])


@query(
    "csv_table_set_scan",
    """SELECT 'nation' AS table_name, count(*) AS rows, 3 AS columns FROM nation UNION ALL
       SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'part', count(*), 6 FROM part""",
)
def csv_table_set_scan(spark, folder):
    base = scratch_path(spark, "set")
    for name in ("nation", "customer", "part"):
        tables.write_csv(table(spark, folder, name), f"{base}/{name}.csv")
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in tables.read_table_set(spark, base).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("head_preview", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 20")
def head_preview(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return tables.preview(rows, ["l_orderkey", "l_linenumber"], 20)


# Text order of the ends, as in the file readers.
EDGE_SQL = """SELECT least(s, d) AS src, greatest(s, d) AS dst, max(w) AS weight FROM (
    SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS d, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2"""


def supplier_part_edges(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    return rows.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "weight")


@query("edge_list_scan", EDGE_SQL)
def edge_list_scan(spark, folder):
    path = scratch_path(spark, "edges")
    graphs.write_edge_list(supplier_part_edges(spark, folder), path)
    return graphs.read_edge_list(spark, path)[1]


@query("node_link_scan", EDGE_SQL)
def node_link_scan(spark, folder):
    path = scratch_path(spark, "node-link")
    edges = graphs.canonical_edges(supplier_part_edges(spark, folder))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    graphs.write_node_link(nodes, edges, path)
    return graphs.read_node_link_parts(spark, path)[1]


@query("graphml_scan", EDGE_SQL)
def graphml_scan(spark, folder):
    path = scratch_path(spark, "graphml")
    edges = cut_lineage(graphs.canonical_edges(supplier_part_edges(spark, folder)))
    graphs.write_graphml(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges, path)
    return graphs.read_graphml(spark, path + "/*")[1].select("src", "dst", "weight")


@query("gexf_scan", EDGE_SQL)
def gexf_scan(spark, folder):
    path = scratch_path(spark, "gexf")
    edges = cut_lineage(graphs.canonical_edges(supplier_part_edges(spark, folder)))
    graphs.write_gexf(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges, path)
    return graphs.read_gexf(spark, path + "/*")[1].select("src", "dst", "weight")


@query(
    "adjacency_edges",
    """SELECT least(s, d) AS src, greatest(s, d) AS dst, 1.0::DOUBLE AS weight FROM (
        SELECT DISTINCT 's' || l_suppkey AS s, 'o' || l_orderkey AS d FROM lineitem) GROUP BY 1, 2""",
)
def adjacency_edges(spark, folder):
    # One adjacency object per order: its suppliers, a bounded handful of lines.
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("s")).distinct()
    documents = lines.groupBy("l_orderkey").agg(F.collect_list("s").alias("list")).select(
        F.to_json(F.create_map(F.concat(F.lit("o"), "l_orderkey"), "list")).alias("value")
    )
    return graphs.adjacency_edges(documents)


@query("log_line_scan", "SELECT count(*) AS lines, count(DISTINCT text) AS distinct_lines FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM conversations) WHERE regexp_matches(text, '\\S')")
def log_line_scan(spark, folder):
    path = scratch_path(spark, "lines")
    table(spark, folder, "conversations").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    lines = logs.read_lines(spark, path)
    return lines.agg(F.count("*").alias("lines"), F.count_distinct("line").alias("distinct_lines"))


@query("json_report_sink", "SELECT n_regionkey AS region, count(*) AS nations FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def json_report_sink(spark, folder):
    path = scratch_path(spark, "report")
    joined = table(spark, folder, "nation").join(table(spark, folder, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    report = joined.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"))
    tables.write_json_report(report, path)
    return spark.read.schema("region int, nations bigint").json(path)
