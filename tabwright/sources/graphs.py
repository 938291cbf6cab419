"""Graph files in and out: edge-list CSV, node-link and adjacency JSON, GraphML and GEXF."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_edges(rows: DataFrame, directed: bool = False, order: str | None = None) -> DataFrame:
    """One row per edge, undirected ends in text order; of repeated edges the last weight wins."""
    src, dst = F.col("src"), F.col("dst")
    ends = rows if directed else rows.withColumns({"src": F.least(src, dst), "dst": F.greatest(src, dst)})
    last = F.max_by("weight", order) if order else F.max("weight")
    return ends.groupBy("src", "dst").agg(last.alias("weight"))


def _ends_in_order(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def last_of_each(edges: DataFrame) -> DataFrame:
    """Of repeated links the last in the file, whose place is ``_at``.

    Two figures, so that the attributes are neither moved nor sorted for a caller that does not read them.
    """
    return edges.groupBy("src", "dst").agg(F.max_by("weight", "_at").alias("weight"), F.max_by("attrs", "_at").alias("attrs"))


def _rows_of(spark: SparkSession, path: str, tags: list[str]):
    """A reader of the elements of some tags, each in the files that have any: one plain pass saves one of the parser per tag.

    One row per file reaches the driver.  The text is cut at every "<", so a file of one line is read in small pieces too.
    """
    begins = {t: F.col("value").startswith(t) & F.col("value").rlike(rf"^{t}[\s/>]") for t in tags}
    pieces = spark.read.option("lineSep", "<").text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    found = pieces.groupBy("_file").agg(*[F.max(b).alias(t) for t, b in begins.items()]).collect()
    files = {t: [unquote(r["_file"]) for r in found if r[t]] for t in tags}
    plain = not any(set(f) & set("*?[]{}\\,%") for some in files.values() for f in some)

    def rows(tag: str, schema: str) -> DataFrame:
        if not files[tag]:
            return spark.createDataFrame([], schema)
        reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema)
        return reader.load(files[tag] if plain else path)

    return rows


def read_edge_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a CSV edge list.

    The first line is a header unless its first two cells are digits, points and hyphens.  Weight is the third cell where it is
    a number, else 1.0; further cells are ignored.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    first = lines.limit(1).collect()
    cells = [c.strip() for c in first[0].value.split(",")] if first else []
    number = [c.replace(".", "").replace("-", "").isdigit() for c in cells[:2]]
    headed = len(cells) >= 2 and not all(number)
    raw = spark.read.schema("a string, b string, c string").option("header", headed).option(
        "ignoreLeadingWhiteSpace", True
    ).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True).csv(path)
    rows = raw.select(
        F.trim("a").alias("src"),
        F.trim("b").alias("dst"),
        F.coalesce(F.col("c").try_cast("double"), F.lit(1.0)).alias("weight"),
        F.monotonically_increasing_id().alias("line_no"),
    ).where("src IS NOT NULL AND dst IS NOT NULL")
    edges = canonical_edges(rows, order="line_no")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes, edges


def _text_map(column, names: list[str], skip: set[str]):
    kept = [n for n in names if n not in skip]
    if not kept:
        return F.create_map().cast("map<string,string>")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"{column}.{n}").cast("string").alias("value")) for n in kept])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def read_node_link(spark: SparkSession, path: str, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, attrs), edges(src, dst, weight, attrs)) of one JSON object with nodes and links (or edges)."""
    doc = spark.read.option("multiLine", True).json(path)
    links = "links" if "links" in doc.columns else "edges"
    node_fields = doc.schema["nodes"].dataType.elementType.names
    link_fields = doc.schema[links].dataType.elementType.names
    # One enclosing object is one record: a single task parses the file.
    nodes = doc.select(F.explode("nodes").alias("n")).select(
        F.col("n.id").cast("string").alias("id"), _text_map("n", node_fields, {"id"}).alias("attrs")
    )
    weight = F.coalesce(F.col("l.weight").cast("double"), F.lit(1.0)) if "weight" in link_fields else F.lit(1.0)
    edges = doc.select(F.posexplode(links).alias("_at", "l")).select(
        "_at",
        F.col("l.source").cast("string").alias("src"),
        F.col("l.target").cast("string").alias("dst"),
        weight.alias("weight"),
        _text_map("l", link_fields, {"source", "target", "weight"}).alias("attrs"),
    )
    if not directed:
        edges = _ends_in_order(edges)
    return nodes, last_of_each(edges)


def adjacency_edges(documents: DataFrame, column: str = "value") -> DataFrame:
    """Edges of JSON objects ``{node: [neighbour, ...]}`` where a neighbour is an id or an object with id or target."""
    parsed = documents.select(F.from_json(column, "map<string,array<string>>").alias("m"))
    pairs = parsed.select(F.explode("m").alias("src", "list")).select("src", F.explode("list").alias("item"))
    named = F.coalesce(F.get_json_object("item", "$.id"), F.get_json_object("item", "$.target"), F.col("item"))
    return canonical_edges(pairs.select("src", named.alias("dst"), F.lit(1.0).alias("weight")))


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    whole = spark.read.option("wholetext", True).text(path)
    edges = adjacency_edges(whole)
    keys = whole.select(F.explode(F.map_keys(F.from_json("value", "map<string,array<string>>"))).alias("id"))
    nodes = keys.union(edges.select(F.explode(F.array("src", "dst")))).distinct()
    return nodes, edges


_DATA = "array<struct<_key:string,_VALUE:string>>"


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, directed) of GraphML through the built-in XML source, whatever namespace the file declares."""
    rows = _rows_of(spark, path, ["key", "node", "graph", "edge"])
    # One row per attribute name: as many as the file declares.
    keys = rows("key", "_id string, `_attr.name` string, _for string").select("_id", F.col("`_attr.name`").alias("name"))
    names = {r["_id"]: r["name"] for r in keys.collect()}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None

    def attrs(column):
        entries = F.coalesce(F.col(column), F.array().cast(_DATA))
        named = F.transform(
            entries,
            lambda d: F.struct((F.coalesce(lookup[d["_key"]], d["_key"]) if lookup is not None else d["_key"]).alias("key"), d["_VALUE"].alias("value")),
        )
        return F.map_from_entries(named)

    nodes = rows("node", f"_id string, data {_DATA}").select(F.col("_id").alias("id"), attrs("data").alias("attrs"))
    head = rows("graph", "_edgedefault string").limit(1).collect()
    directed = bool(head) and head[0]["_edgedefault"] == "directed"
    raw = rows("edge", f"_source string, _target string, data {_DATA}").select(
        F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs("data").alias("attrs")
    )
    weight = F.coalesce(F.col("attrs")["weight"].try_cast("double"), F.lit(1.0))
    edges = raw.select(F.monotonically_increasing_id().alias("_at"), "src", "dst", weight.alias("weight"), "attrs")
    if not directed:
        edges = _ends_in_order(edges)
    return nodes, last_of_each(edges), directed


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, directed) of GEXF; attribute values are keyed by their declared titles."""
    rows = _rows_of(spark, path, ["attribute", "node", "graph", "edge"])
    titles = {r["_id"]: r["_title"] for r in rows("attribute", "_id string, _title string").collect()}
    lookup = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair]) if titles else None
    values = "attvalues struct<attvalue:array<struct<_for:string,_value:string>>>"

    def attrs():
        entries = F.coalesce(F.col("attvalues.attvalue"), F.array().cast("array<struct<_for:string,_value:string>>"))
        return F.map_from_entries(
            F.transform(
                entries,
                lambda d: F.struct((F.coalesce(lookup[d["_for"]], d["_for"]) if lookup is not None else d["_for"]).alias("key"), d["_value"].alias("value")),
            )
        )

    nodes = rows("node", f"_id string, _label string, {values}").select(F.col("_id").alias("id"), attrs().alias("attrs"))
    head = rows("graph", "_defaultedgetype string").limit(1).collect()
    directed = bool(head) and head[0]["_defaultedgetype"] == "directed"
    edges = rows("edge", f"_source string, _target string, _weight string, {values}").select(
        F.monotonically_increasing_id().alias("_at"),
        F.col("_source").alias("src"),
        F.col("_target").alias("dst"),
        F.coalesce(F.col("_weight").try_cast("double"), F.lit(1.0)).alias("weight"),
        attrs().alias("attrs"),
    )
    if not directed:
        edges = _ends_in_order(edges)
    return nodes, last_of_each(edges), directed


def write_edge_list(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``source,target,weight`` with weight 1.0 where none is given."""
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    rows = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), weight.alias("weight"))
    rows.write.mode(mode).option("header", True).csv(path)


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Node and link objects as JSON lines in ``nodes`` and ``links`` folders.

    One enclosing JSON object would have to be built by a single task, so the two arrays are written as
    line-delimited parts that any number of tasks can produce.
    """
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    extra = ["attrs"] if "attrs" in edges.columns else []
    nodes.write.mode(mode).json(path.rstrip("/") + "/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), weight.alias("weight"), *extra).write.mode(
        mode
    ).json(path.rstrip("/") + "/links")


def read_node_link_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read back what :func:`write_node_link` wrote."""
    base = path.rstrip("/")
    edges = spark.read.schema(
        T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("weight", T.DoubleType())])
    ).json(base + "/links")
    return spark.read.json(base + "/nodes"), edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")


def _write_xml(rows: DataFrame, root: str, tag: str, path: str, mode: str) -> None:
    rows.write.format("xml").option("rootTag", root).option("rowTag", tag).mode(mode).save(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False, mode: str = "errorifexists") -> None:
    """GraphML in three folders of files: the graph and its keys, nodes, and edges; :func:`read_graphml` reads ``path/*``.

    A single document would have to be written by a single task.
    """
    spark, base = nodes.sparkSession, path.rstrip("/")
    kind = "directed" if directed else "undirected"
    _write_xml(spark.range(1).select(F.lit("G").alias("_id"), F.lit(kind).alias("_edgedefault")), "graphml", "graph", base + "/graph", mode)
    key = [F.lit(v).alias(k) for k, v in (("_id", "d1"), ("_for", "edge"), ("_attr.name", "weight"), ("_attr.type", "double"))]
    _write_xml(spark.range(1).select(*key), "graphml", "key", base + "/keys", mode)
    _write_xml(nodes.select(F.col("id").cast("string").alias("_id"), F.lit("").alias("desc")), "graphml", "node", base + "/nodes", mode)
    weight = F.struct(F.lit("d1").alias("_key"), F.coalesce(F.col("weight"), F.lit(1.0)).alias("_VALUE"))
    ends = [F.col(c).cast("string").alias(n) for c, n in (("src", "_source"), ("dst", "_target"))]
    _write_xml(edges.select(*ends, weight.alias("data")), "graphml", "edge", base + "/edges", mode)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False, mode: str = "errorifexists") -> None:
    """GEXF in the same way."""
    spark, base = nodes.sparkSession, path.rstrip("/")
    kind = "directed" if directed else "undirected"
    _write_xml(spark.range(1).select(F.lit(kind).alias("_defaultedgetype"), F.lit("").alias("meta")), "gexf", "graph", base + "/graph", mode)
    label = F.col("id").cast("string")
    _write_xml(nodes.select(label.alias("_id"), label.alias("_label"), F.lit("").alias("meta")), "gexf", "node", base + "/nodes", mode)
    ends = [F.col(c).cast("string").alias(n) for c, n in (("src", "_source"), ("dst", "_target"))]
    _write_xml(edges.select(*ends, F.coalesce(F.col("weight"), F.lit(1.0)).alias("_weight"), F.lit("").alias("meta")), "gexf", "edge", base + "/edges", mode)
