"""Classes, scores and summaries of attack paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bramble.functions.scoring import advanced_score, classify
from bramble.operators.graph import Graph


def with_types(graph: Graph, paths: DataFrame) -> DataFrame:
    """paths with types, those of all nodes in order, and whether the last is a sink."""
    each = paths.select("graph_id", "source", "sink", F.posexplode("path_nodes").alias("at", "id"))
    types = each.join(graph.nodes.select("graph_id", "id", "type"), ["graph_id", "id"]).groupBy("graph_id", "source", "sink").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]).alias("types"))
    return paths.join(types, ["graph_id", "source", "sink"])


def classified(graph: Graph, paths: DataFrame) -> DataFrame:
    """Attack paths with their classes (sorted) and advanced score; a path ends in a sink by nature."""
    typed = with_types(graph, paths)
    return typed.withColumns({"categories": classify(F.col("relationships"), F.col("types"), F.lit(True)), "score": advanced_score(F.col("total_risk"), F.col("hop_count"), F.col("cvss"))})


def category_counts(classes: DataFrame) -> DataFrame:
    """Paths of each class in each graph, and over all graphs (graph_id null)."""
    each = classes.select("graph_id", F.explode("categories").alias("category"))
    return each.rollup("category", "graph_id").agg(F.count("*").alias("paths")).where("category is not null").select("graph_id", "category", "paths")


def risk_summary(graph: Graph, paths: DataFrame, cycles: DataFrame, simple_counts: DataFrame, critical: DataFrame) -> DataFrame:
    """One row a graph: paths by severity, cycles, simple paths, the most critical node, and a verdict."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    by_severity = paths.groupBy("graph_id").agg(*[count(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])
    rings = cycles.groupBy("graph_id").agg(F.count("*").alias("cycles"))
    top = critical.where("rank = 1").select("graph_id", F.col("id").alias("top_node"))
    out = graph.nodes.select("graph_id").distinct()
    for part in (by_severity, rings, simple_counts.withColumnRenamed("paths", "baseline"), top):
        out = out.join(part, "graph_id", "left")
    out = out.na.fill(0, ["critical", "high", "medium", "low", "cycles", "baseline"])
    verdict = F.when(F.col("critical") > 0, "immediate").when(F.col("high") > 0, "recommended").otherwise("acceptable")
    return out.select("graph_id", "critical", "high", "medium", "low", "cycles", "baseline", "top_node", verdict.alias("verdict"))


def highest_risk(paths: DataFrame) -> DataFrame:
    """The last path of each graph in ascending order of risk, source and sink."""
    last = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("total_risk"), F.desc("source_seq"), F.desc("sink_seq")))
    return paths.withColumn("__n", last).where("__n = 1").drop("__n")
