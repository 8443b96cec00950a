"""Graph documents: one JSON object with nodes and edges for each graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bramble.operators.graph import Graph
from bramble.operators.ranks import ranked

NODE = "struct<id: string, type: string, name: string, namespace: string, risk_score: double, is_source: boolean, is_sink: boolean, cves: array<string>>"
EDGE = "struct<source: string, target: string, relationship: string, weight: double, cve: string, cvss: double>"
DOCUMENT = f"nodes array<{NODE}>, edges array<{EDGE}>"


def _required(row: str, *names: str) -> Column:
    """The row, or an error that names a required field that is missing."""
    ok = F.col(row)
    for name in names:
        ok = F.when(F.col(f"{row}.{name}").isNotNull(), ok).otherwise(F.raise_error(F.lit(f"a graph document lacks the field {name}")))
    return ok


def tables(documents: DataFrame) -> Graph:
    """documents (graph_id, nodes, edges) as tables: types in lower case, defaults filled in, edges without source or target left out.

    Missing arrays are empty; a missing required field raises an error when the tables are read.
    """
    nodes = documents.select("graph_id", F.posexplode("nodes").alias("node_seq", "n")).withColumn("n", _required("n", "id", "type", "name", "namespace", "risk_score"))
    nodes = nodes.select("graph_id", F.col("node_seq").cast("long").alias("node_seq"), "n.id", F.lower("n.type").alias("type"), "n.name", "n.namespace", "n.risk_score", F.coalesce("n.is_source", F.lit(False)).alias("is_source"), F.coalesce("n.is_sink", F.lit(False)).alias("is_sink"), F.coalesce("n.cves", F.array().cast("array<string>")).alias("cves"))
    edges = documents.select("graph_id", F.posexplode("edges").alias("edge_seq", "e")).where("e.source is not null and e.target is not null").withColumn("e", _required("e", "relationship", "weight"))
    return Graph(nodes, edges.select("graph_id", F.col("edge_seq").cast("long").alias("edge_seq"), "e.*"))


def graph_of_file(root: str | None = None) -> Column:
    """The name of the file that is read, less its ending; with a root, its path below that."""
    if root is None:
        return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    below = F.substring_index(F.input_file_name(), root.rstrip("/") + "/", -1)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def require_own_names(spark: SparkSession, paths: str | list[str], root: str | None) -> None:
    """ValueError if two files would give graphs of one name."""
    files = spark.read.format("binaryFile").load(paths).select("path", graph_of_file(root).alias("graph_id"))
    again = files.groupBy("graph_id").agg(F.sort_array(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1).take(1)
    if again:
        raise ValueError(f"several files for the graph {again[0].graph_id!r}: {again[0].paths[:2]}; give a root to name graphs by their paths below it")


def read_graphs(spark: SparkSession, paths: str | list[str], root: str | None = None) -> Graph:
    """Graph documents from JSON files, one each; graph_id is the file's name, or, with a root, its path below that.

    Missing files and broken JSON raise, and so do files of one name.
    """
    require_own_names(spark, paths, root)
    found = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return tables(found.withColumn("graph_id", graph_of_file(root)))


def _rows() -> tuple[Column, Column]:
    """A node and an edge as they stand in a document."""
    return F.struct("id", "type", "name", "namespace", "risk_score", "is_source", "is_sink", "cves"), F.struct("source", "target", "relationship", "weight", "cve", "cvss")


def documents(graph: Graph) -> DataFrame:
    """(graph_id, document): each graph as one JSON object, as it is, before any cleaning."""
    node, edge = _rows()
    in_order = lambda seq, row: F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), row.alias("row")))), lambda x: x["row"])
    nodes = graph.nodes.groupBy("graph_id").agg(in_order("node_seq", node).alias("nodes"))
    edges = graph.edges.groupBy("graph_id").agg(in_order("edge_seq", edge).alias("edges"))
    both = nodes.join(edges, "graph_id", "full")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    return both.select("graph_id", F.to_json(F.struct(empty("nodes", NODE), empty("edges", EDGE)), {"ignoreNullFields": "false"}).alias("document"))


def document_parts(graph: Graph) -> DataFrame:
    """(graph_id, section, place, text): the documents of `documents` in parts, a row for each node, edge and bracket. In the order of section and place
    the texts of a graph are its document, line by line, so that no row holds a graph, however large it is."""
    parts = []
    for section, (table, seq, row) in enumerate(zip((graph.nodes, graph.edges), ("node_seq", "edge_seq"), _rows(), strict=True)):
        each = ranked(table.select("graph_id", F.col(seq).alias("seq"), F.to_json(row, {"ignoreNullFields": "false"}).alias("text")), ["graph_id"], [F.col("seq"), F.col("text")], "place")
        comma = F.when(F.col("place") > 1, ",").otherwise("")
        parts.append(each.select("graph_id", F.lit(2 * section + 1).alias("section"), "place", F.concat(comma, "text").alias("text")))
    ids = graph.nodes.select("graph_id").union(graph.edges.select("graph_id")).distinct()
    for section, text in ((0, '{"nodes":['), (2, '],"edges":['), (4, "]}")):
        parts.append(ids.select("graph_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("place"), F.lit(text).alias("text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_parts(graph: Graph, path: str) -> None:
    """document_parts under a folder for each graph's id, over many tasks; its files, in the order of their names, are its document."""
    order = ["graph_id", "section", "place"]
    document_parts(graph).repartitionByRange(*order).sortWithinPartitions(*order).select("graph_id", "text").write.partitionBy("graph_id").text(path)


def write_graphs(graph: Graph, path: str) -> None:
    """One line of JSON for each graph, under a folder for its id."""
    documents(graph).write.partitionBy("graph_id").text(path)


def write_result(result: DataFrame, path: str, form: str = "parquet") -> None:
    """A result table as Parquet or JSON, partitioned by graph."""
    result.write.partitionBy("graph_id").format(form).save(path)
