"""One JSON document for each graph, from the result tables.

report_bundle and display_bundle give a row a graph. report_parts and display_parts give the same documents in parts, a row for each path, cycle, node or bracket, so that no row
holds a graph, nor what one source reaches; in the order of section and place their texts are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bramble.operators import ranks
from bramble.operators.graph import Graph, counts, histograms, sources, stored
from bramble.operators.traverse import is_dag, ranked, weak_components, with_cycle_names


def _listed(table: DataFrame, order: list[str], row: Column, name: str) -> DataFrame:
    """(graph_id, name): a column of the table's rows of each graph as an array, in order."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], row.alias("row"))))
    return table.groupBy("graph_id").agg(rows["row"].alias(name))


def _struct(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])


def summary(graph: Graph, cycles: DataFrame | None = None) -> DataFrame:
    """(graph_id, graph_summary): counts, counts by type and relationship, whether it is acyclic, and its components. Graphs with cycles that are given are not searched for others."""
    all_ = counts(graph).join(histograms(graph), "graph_id").join(is_dag(graph, cycles), "graph_id").join(weak_components(graph), "graph_id")
    return all_.select("graph_id", _struct(total_nodes="nodes", total_edges="edges", node_types="node_types", relationship_types="relationship_types", source_nodes="sources", sink_nodes="sinks", is_dag="is_dag", weakly_connected_components="components").alias("graph_summary"))


def _blast(graph: Graph, blast: DataFrame, max_depth: int) -> DataFrame:
    """A row for each source, also for one that reaches nothing: its name, depth, nodes by hop and their number."""
    layers = blast.groupBy("graph_id", "source", "hop").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    layers = layers.groupBy("graph_id", "source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("hop").cast("string").alias("key"), F.col("nodes").alias("value"))))).alias("layers"), F.sum(F.size("nodes")).alias("n"))
    starts = sources(graph).select("graph_id", F.col("id").alias("source"), F.coalesce("name", "id").alias("source_name"), "node_seq")
    out = starts.join(layers, ["graph_id", "source"], "left")
    return out.select("graph_id", "node_seq", "source", "source_name", F.lit(max_depth).alias("max_depth"), F.coalesce("n", F.lit(0)).alias("total_affected"), F.coalesce("layers", F.create_map().cast("map<string, array<string>>")).alias("layers"))


_PATH = {"path_nodes": "path_nodes", "path_names": "path_names", "relationships": "relationships", "cves": "cves", "cvss_scores": "cvss", "hop_count": "hop_count", "total_risk": "total_risk", "severity": "severity"}


def _critical(graph: Graph, critical: DataFrame, simple_counts: DataFrame) -> DataFrame:
    """(graph_id, top_nodes, baseline)."""
    top = _listed(critical, ["rank"], _struct(**_TOP), "top_nodes")
    return graph.nodes.select("graph_id").distinct().join(top, "graph_id", "left").join(simple_counts.select("graph_id", F.col("paths").alias("baseline")), "graph_id", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0)))


def _document(parts: list[DataFrame], fields: dict[str, Column | str], generated_at: str) -> DataFrame:
    """The parts, one row a graph each, as one JSON object; arrays that a graph lacks are empty."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "graph_id", "left")
    arrays = {f.name: f.dataType for f in out.schema.fields if f.dataType.typeName() == "array"}
    out = out.withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in arrays.items()})
    made = F.struct(F.lit(generated_at).alias("generated_at"), F.col("graph_id"))
    return out.select("graph_id", F.to_json(_struct(metadata=made, **fields), {"ignoreNullFields": "false"}).alias("document"))


def _path_fixes(order: DataFrame, path_fixes: DataFrame) -> DataFrame:
    """(graph_id, path_index, fixes): the fixes of each ranked path, also of one without any."""
    fixes = path_fixes.groupBy("graph_id", "source", "sink").agg(F.sort_array(F.collect_list(F.struct("hop", "part", "text")))["text"].alias("fixes"))
    found = order.select("graph_id", "source", "sink", (F.col("rank") - 1).alias("path_index")).join(fixes, ["graph_id", "source", "sink"], "left")
    return found.withColumn("fixes", F.coalesce("fixes", F.array().cast("array<string>")))


def _cycle_fix() -> Column:
    return F.when(F.col("ring").isNull(), F.col("text")).otherwise(F.concat("ring", F.lit(" | cut "), "break_edge", F.lit(" | "), "text"))


_TOP = {"id": "id", "name": "name", "paths_eliminated": "eliminated"}
_EDGE = {c: c for c in ("source", "target", "relationship", "weight", "cve", "cvss")}


def _node() -> Column:
    return _struct(id="id", name=F.coalesce("name", "id"), type=F.coalesce("type", F.lit("unknown")), namespace=F.coalesce("namespace", F.lit("")), risk_score=F.coalesce("risk_score", F.lit(0.0)), is_source="is_source", is_sink="is_sink", cves="cves")


def _scored() -> Column:
    return _struct(**_PATH, categories="categories", advanced_score=F.round("score", 2))


def report_bundle(graph: Graph, paths: DataFrame, blast: DataFrame, cycles: DataFrame, critical: DataFrame, simple_counts: DataFrame, path_fixes: DataFrame, critical_fixes: DataFrame, cycle_fixes: DataFrame, generated_at: str, max_depth: int = 3) -> DataFrame:
    """(graph_id, document): metadata, summary, paths, blast radius, cycles, critical nodes and remediation; path_index counts paths from 0 by rising risk."""
    order = ranked(paths)
    fixes = _path_fixes(order, path_fixes)
    rings = with_cycle_names(graph, cycles)
    parts = [
        summary(graph, cycles),
        _listed(order, ["rank"], _struct(**_PATH), "attack_paths"),
        _blast_rows(graph, blast, max_depth, ["source", "max_depth", "layers", "total_affected"]),
        _listed(rings, ["cycle"], F.struct("cycle", "cycle_names"), "rings"),
        _critical(graph, critical, simple_counts),
        _listed(fixes, ["path_index"], F.struct("path_index", "fixes"), "path_fixes"),
        _listed(critical_fixes, ["rank", "part"], F.col("text"), "critical_fixes"),
        _listed(cycle_fixes, ["ring"], _cycle_fix(), "cycle_fixes"),
    ]
    fields = {
        "graph_summary": "graph_summary", "attack_paths": "attack_paths", "blast_radius": "blast",
        "cycles": _struct(cycles=F.col("rings")["cycle"], cycle_names=F.col("rings")["cycle_names"], total_cycles=F.size("rings")),
        "critical_nodes": _struct(top_nodes="top_nodes", total_paths_baseline="baseline"),
        "remediation": _struct(path_fixes="path_fixes", critical_node_fixes="critical_fixes", cycle_fixes="cycle_fixes"),
    }
    return _document(parts, fields, generated_at)


def _blast_rows(graph: Graph, blast: DataFrame, max_depth: int, columns: list[str]) -> DataFrame:
    """(graph_id, blast): rows of _blast in the order of sources. Maps have no order, so rows are put in place by number."""
    rows = _blast(graph, blast, max_depth).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node_seq", F.struct(*columns)))).alias("by_place"))
    return rows.select("graph_id", F.transform(F.sort_array(F.map_keys("by_place")), lambda k: F.element_at("by_place", k)).alias("blast"))


def display_bundle(graph: Graph, classes: DataFrame, blast: DataFrame, cycles: DataFrame, critical: DataFrame, simple_counts: DataFrame, generated_at: str, max_depth: int = 3) -> DataFrame:
    """(graph_id, document): nodes, edges, classified paths with scores of two digits, cycles, critical nodes, blast radius with names, metadata and summary."""
    parts = [
        summary(graph, cycles),
        _listed(graph.nodes, ["node_seq"], _node(), "nodes"),
        _listed(graph.edges, ["edge_seq"], _struct(**_EDGE), "edges"),
        _listed(ranked(classes), ["rank"], _scored(), "attack_paths"),
        _listed(with_cycle_names(graph, cycles), ["cycle"], _struct(node_ids="cycle", node_names="cycle_names"), "cycles"),
        _critical(graph, critical, simple_counts),
        _blast_rows(graph, blast, max_depth, ["source", "source_name", "max_depth", "total_affected", "layers"]),
    ]
    fields = {n: n for n in ("graph_summary", "nodes", "edges", "attack_paths", "cycles")}
    return _document(parts, fields | {"critical_node": _struct(baseline_paths="baseline", top_nodes="top_nodes"), "blast_radius": "blast"}, generated_at)


# Documents in parts


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _string(value: Column | str) -> Column:
    """A string as it stands in JSON."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _lines(placed: DataFrame, place: Column | str, text: Column) -> DataFrame:
    """(graph_id, place, text): rows of an array, each but the first of its graph with a comma before it; places count from 1."""
    placed = placed.select("graph_id", (F.col(place) if isinstance(place, str) else place).cast("long").alias("place"), text.alias("text"))
    return placed.withColumn("text", F.concat(F.when(F.col("place") > 1, ",").otherwise(""), "text"))


def _placed(table: DataFrame, *order: str) -> DataFrame:
    """table with each row's place in its graph. It is read twice, once for a sample of the order, so it should be a stored one if it is much work."""
    return ranks.ranked(table, ["graph_id"], [F.col(c) for c in order], "place")


def _blast_lines(graph: Graph, blast: DataFrame, max_depth: int, named: bool) -> DataFrame:
    """(graph_id, place, text): the blast radius of each source as lines for its head, each layer's brackets, each node and its end."""
    starts = sources(graph).select("graph_id", F.col("id").alias("source"), F.coalesce("name", "id").alias("source_name"), "node_seq")
    first = starts.groupBy("graph_id").agg(F.min("node_seq").alias("first"))
    sizes = blast.groupBy("graph_id", "source").agg(F.count("*").alias("n"))
    heads = starts.join(first, "graph_id").join(sizes, ["graph_id", "source"], "left")
    name = {"source_name": "source_name"} if named else {}
    head = _json(_struct(source="source", **name, max_depth=F.lit(max_depth), total_affected=F.coalesce("n", F.lit(0))))
    layers = blast.groupBy("graph_id", "source", "hop").agg(F.min("node").alias("least")).join(starts, ["graph_id", "source"])
    nodes = blast.join(layers, ["graph_id", "source", "hop"])
    comma = lambda when: F.when(when, ",").otherwise("")
    end = F.lit(max_depth + 1)
    # Lines of a source go by hop: 0 its head, then its layers, then its end; in a layer by step: its bracket, its nodes, its bracket.
    row = lambda df, hop, step, node, text: df.select("graph_id", "node_seq", hop.alias("hop"), F.lit(step).alias("step"), node.cast("string").alias("node"), text.alias("text"))
    none = F.lit(None)
    lines = row(heads, F.lit(0), 0, none, F.concat(comma(F.col("node_seq") > F.col("first")), F.left(head, F.length(head) - 1), F.lit(',"layers":{')))
    lines = lines.unionByName(row(layers, F.col("hop"), 0, none, F.concat(comma(F.col("hop") > 1), _string(F.col("hop").cast("string")), F.lit(":["))))
    lines = lines.unionByName(row(nodes, F.col("hop"), 1, F.col("node"), F.concat(comma(F.col("node") > F.col("least")), _string("node"))))
    lines = lines.unionByName(row(layers, F.col("hop"), 2, none, F.lit("]")))
    lines = lines.unionByName(row(starts, end, 0, none, F.lit("}}")))
    return _placed(stored(lines), "node_seq", "hop", "step", "node").select("graph_id", "place", "text")


def _sections(graphs: DataFrame, sections: list[Column | str | DataFrame]) -> DataFrame:
    """(graph_id, section, place, text): sections in their order. A column or a text is one row for each of the graphs, a table (graph_id, place, text) its rows."""
    single = [F.struct(F.lit(i).alias("section"), F.lit(0).cast("long").alias("place"), (F.lit(s) if isinstance(s, str) else s).alias("text")) for i, s in enumerate(sections) if not isinstance(s, DataFrame)]
    out = graphs.select("graph_id", F.inline(F.array(*single)))
    for i, s in enumerate(sections):
        if isinstance(s, DataFrame):
            out = out.unionByName(s.select("graph_id", F.lit(i).alias("section"), "place", "text"))
    return out


def _graphs(graph: Graph, cycles: DataFrame, simple_counts: DataFrame, generated_at: str) -> DataFrame:
    """(graph_id, begin, n_cycles, baseline): what stands once in a document; begin is its text up to the summary."""
    out = summary(graph, cycles).join(cycles.groupBy("graph_id").agg(F.count("*").alias("n_cycles")), "graph_id", "left").join(simple_counts.select("graph_id", F.col("paths").alias("baseline")), "graph_id", "left")
    begin = _json(F.struct(F.struct(F.lit(generated_at).alias("generated_at"), F.col("graph_id")).alias("metadata"), "graph_summary"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string").alias(c)
    return out.select("graph_id", F.left(begin, F.length(begin) - 1).alias("begin"), number("n_cycles"), number("baseline"))


def report_parts(graph: Graph, paths: DataFrame, blast: DataFrame, cycles: DataFrame, critical: DataFrame, simple_counts: DataFrame, path_fixes: DataFrame, critical_fixes: DataFrame, cycle_fixes: DataFrame, generated_at: str, max_depth: int = 3) -> DataFrame:
    """(graph_id, section, place, text): the documents of report_bundle in parts."""
    order, rings = ranked(paths), _placed(with_cycle_names(graph, cycles), "cycle")
    return _sections(_graphs(graph, cycles, simple_counts, generated_at), [
        F.concat("begin", F.lit(',"attack_paths":[')), _lines(order, "rank", _json(_struct(**_PATH))),
        '],"blast_radius":[', _blast_lines(graph, blast, max_depth, named=False),
        '],"cycles":{"cycles":[', _lines(rings, "place", _json(F.col("cycle"))),
        '],"cycle_names":[', _lines(rings, "place", _json(F.col("cycle_names"))),
        F.concat(F.lit('],"total_cycles":'), "n_cycles", F.lit('},"critical_nodes":{"top_nodes":[')), _lines(critical, "rank", _json(_struct(**_TOP))),
        F.concat(F.lit('],"total_paths_baseline":'), "baseline", F.lit('},"remediation":{"path_fixes":[')), _lines(_path_fixes(order, path_fixes), F.col("path_index") + 1, _json(F.struct("path_index", "fixes"))),
        '],"critical_node_fixes":[', _lines(_placed(critical_fixes, "rank", "part", "text"), "place", _string("text")),
        '],"cycle_fixes":[', _lines(_placed(cycle_fixes.withColumn("line", _cycle_fix()), "ring", "line"), "place", _string("line")),
        "]}}",
    ])


def display_parts(graph: Graph, classes: DataFrame, blast: DataFrame, cycles: DataFrame, critical: DataFrame, simple_counts: DataFrame, generated_at: str, max_depth: int = 3) -> DataFrame:
    """(graph_id, section, place, text): the documents of display_bundle in parts."""
    rings = _placed(with_cycle_names(graph, cycles), "cycle")
    return _sections(_graphs(graph, cycles, simple_counts, generated_at), [
        F.concat("begin", F.lit(',"nodes":[')), _lines(_placed(graph.nodes, "node_seq"), "place", _json(_node())),
        '],"edges":[', _lines(_placed(graph.edges, "edge_seq"), "place", _json(_struct(**_EDGE))),
        '],"attack_paths":[', _lines(ranked(classes), "rank", _json(_scored())),
        '],"cycles":[', _lines(rings, "place", _json(_struct(node_ids="cycle", node_names="cycle_names"))),
        F.concat(F.lit('],"critical_node":{"baseline_paths":'), "baseline", F.lit(',"top_nodes":[')), _lines(critical, "rank", _json(_struct(**_TOP))),
        ']},"blast_radius":[', _blast_lines(graph, blast, max_depth, named=True),
        "]}",
    ])
