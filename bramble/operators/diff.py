"""What changed between snapshots of graphs, for any number of clusters in one job.

Changes are asked for between pairs (old_graph_id, new_graph_id), where a graph may be in several, or along a timeline, each snapshot against the one before it.
Along a timeline each key is looked at once: its rows in the order of snapshots have gaps, and a row after a gap was added there, one before a gap was removed in the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bramble.operators.graph import Graph


def consecutive(snapshots: DataFrame) -> DataFrame:
    """pairs of each snapshot (cluster, snapshot, graph_id) with the one before it."""
    before = F.lag("graph_id").over(Window.partitionBy("cluster").orderBy("snapshot"))
    return snapshots.select(before.alias("old_graph_id"), F.col("graph_id").alias("new_graph_id")).where("old_graph_id is not null")


def timeline(snapshots: DataFrame) -> DataFrame:
    """(cluster, place, last, graph_id, before): each snapshot (cluster, snapshot, graph_id) with its place from 0, the last one's place, and the graph before it. A row a snapshot."""
    order = Window.partitionBy("cluster").orderBy("snapshot")
    out = snapshots.select("cluster", "graph_id", (F.row_number().over(order) - 1).alias("place"), F.lag("graph_id").over(order).alias("before"))
    return out.withColumn("last", F.max("place").over(Window.partitionBy("cluster")))


def _along(table: DataFrame, line: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Changes along a timeline: one shuffle by cluster and key. A key has a row a snapshot at most."""
    rows = table.join(line.select("graph_id", "cluster", "place", "last"), "graph_id")
    order = Window.partitionBy("cluster", *on).orderBy("place")
    new = (F.col("place") > 0) & F.coalesce(F.lag("place").over(order) != F.col("place") - 1, F.lit(True))
    gone = (F.col("place") < F.col("last")) & F.coalesce(F.lead("place").over(order) != F.col("place") + 1, F.lit(True))
    rows = rows.withColumns({"__new": new, "__gone": gone})
    change = lambda flag, name, place: F.when(F.col(flag), F.struct(F.lit(name).alias("change"), place.alias("place")))
    both = F.filter(F.array(change("__new", "added", F.col("place")), change("__gone", "removed", F.col("place") + 1)), lambda c: c.isNotNull())
    found = rows.select("cluster", *keep, F.explode(both).alias("c")).select("cluster", *keep, "c.*")
    ids = line.select("cluster", "place", F.col("before").alias("old_graph_id"), F.col("graph_id").alias("new_graph_id"))
    return found.join(ids, ["cluster", "place"]).select("old_graph_id", "new_graph_id", "change", *keep)


def _changes(table: DataFrame, pairs: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    if "place" in pairs.columns:
        return _along(table, pairs, on, keep)
    side = lambda one, mark: pairs.join(table.withColumnRenamed("graph_id", one), one).withColumn("__side", F.lit(mark))
    both = side("old_graph_id", 1).unionByName(side("new_graph_id", 2))
    rest = [c for c in keep if c not in on]
    found = both.groupBy("old_graph_id", "new_graph_id", *on).agg(F.bit_or("__side").alias("__side"), F.first(F.struct(F.lit(0).alias("__"), *rest)).alias("__row"))
    change = F.when(F.col("__side") == 2, "added").otherwise("removed").alias("change")
    return found.where("__side != 3").select("old_graph_id", "new_graph_id", change, *[F.col(c) if c in on else F.col(f"__row.{c}") for c in keep])


def node_diff(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Ids on one side only, for pairs or a timeline; changed attributes are no change."""
    return _changes(graph.nodes.select("graph_id", "id", "name", "type"), pairs, ["id"], ["id", "name", "type"])


def edge_diff(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(source, target, relationship) on one side only, of built edges."""
    on = ["source", "target", "relationship"]
    return _changes(graph.edges.select("graph_id", *on), pairs, on, on)


def path_diff(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sources and sinks joined on one side only, with the path there; another route for the same two is no change."""
    return _changes(paths.select("graph_id", "source", "sink", "path_nodes", "total_risk", "severity"), pairs, ["source", "sink"], ["source", "sink", "path_nodes", "total_risk", "severity"])


def diff_counts(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    key = ["old_graph_id", "new_graph_id", "change"]
    parts = [d.select(*key, F.lit(kind).alias("kind")) for kind, d in (("nodes", nodes), ("edges", edges), ("paths", paths))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*key, "kind").agg(F.count("*").alias("n"))


def first_edges(edges: DataFrame, n: int = 10) -> DataFrame:
    """The first n changed edges of each pair and change, in order of their names."""
    order = Window.partitionBy("old_graph_id", "new_graph_id", "change").orderBy("source", "target", "relationship")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
