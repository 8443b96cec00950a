"""Graphs as a pair of tables, and the cleaning that turns raw tables into an attack graph.

Every table carries graph_id, so one job works on a whole fleet of graphs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NODES = "graph_id string, node_seq long, id string, type string, name string, namespace string, risk_score double, is_source boolean, is_sink boolean, cves array<string>"
EDGES = "graph_id string, edge_seq long, source string, target string, relationship string, weight double, cve string, cvss double"


#: Parts of identifiers that may be broadcast (some 10 MB); characters in one.
FEW_IDENTIFIERS, GRAM = 100_000, 3
#: Bytes of files or of a shuffle up to which a side of a join is broadcast while a table is stored; rows up to which a front is, which loops join with all edges.
SMALL, FEW_ROWS = 1 << 18, 100_000
#: Bytes of each of a side's shuffled parts up to which it is joined by hash while a table of graphs is stored, so that the other side need not be sorted.
HASHED = 1 << 24


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def shared_folder(spark: SparkSession) -> str:
    """The folder for what jobs write in between: the checkpoint folder that is set, or spark.checkpoint.dir, or, on one machine only, a temporary one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def _bytes(text: str) -> int:
    """The bytes of a size as Spark's settings give it; of one that isn't plain, SMALL."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", text.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found else SMALL


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when it ends; without that they stay until the driver's next full garbage collection, and loops leave dozens behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


@contextmanager
def _small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, joins broadcast sides of SMALL bytes at most: loops join in dozens of rounds, and all that they broadcast goes through the driver. Sides that are marked for it are broadcast still."""
    held = {}
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        set_, default = spark.conf.get(name, None), "10m" if name == "spark.sql.autoBroadcastJoinThreshold" else "0"  # the other one follows it
        if _bytes(set_ or default) > SMALL:
            held[name] = set_
            spark.conf.set(name, str(SMALL))
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def _hash_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark joins by hash where every part of a shuffled side has HASHED bytes at most, which it knows when the shuffle is done; larger sides are sorted and merged, as without it."""
    names = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")  # the first counts only if it is no smaller than the second
    held = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, str(HASHED))
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with _small_broadcasts(df.sparkSession):
        return df.checkpoint()


def _rounds(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rounds-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back, for loops.

    Unlike a checkpoint, which keeps its plan's estimates, it starts anew from the size of its files. Estimates of joins multiply, so over the rounds of a loop they would
    grow to numbers of millions of digits; and a small table is known to be small, so that Spark may broadcast it.
    """
    spark = df.sparkSession
    path = f"{_rounds(spark)}/{uuid.uuid4().hex}"
    with _small_broadcasts(spark), _hash_joins(spark), _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(front: DataFrame) -> DataFrame:
    """A stored table as it takes part in a join with a large one: sent to all tasks if it has FEW_ROWS rows at most, so that the large one need not move."""
    return F.broadcast(front) if front.count() <= FEW_ROWS else front


def discard(table: DataFrame) -> None:
    """Removes a table that `stored` gave, when nothing reads it any more."""
    spark, folder = table.sparkSession, _rounds(table.sparkSession).rstrip("/").rpartition("/")[2]
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if path.rpartition("/")[0].endswith(folder):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_rounds(spark: SparkSession) -> None:
    """Removes all that `stored` has written in this application; results that aren't written yet can't be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_rounds(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _one_each(rows: DataFrame, keys: list[str], by: str, pick: Callable[[Column, Column], Column], at_first: bool = False) -> DataFrame:
    """One row of rows for each of the keys: the one with the least or greatest `by`, at the least position if so asked.

    Tasks keep a row a key before any is moved, so a key with very many rows is no more than a row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col(by)).alias("__row"), F.min(by).alias("__at"))
    value = lambda c: F.col("__at") if at_first and c == by else F.col(f"__row.{c}")
    return found.select(*[F.col(c) if c in keys else value(c).alias(c) for c in rows.columns])


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each (graph, id): the last attributes, at the first position."""
    return _one_each(nodes, ["graph_id", "id"], "node_seq", F.max_by, at_first=True)


def _ends(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    ids = nodes.select("graph_id", "id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["graph_id", end], how)
    return edges


def attached_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    return _ends(edges, nodes, "left_semi").select(edges.columns)


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is missing or null."""
    ids = nodes.select("graph_id", "id").distinct()
    known = lambda end: ids.select("graph_id", F.col("id").alias(end), F.lit(True).alias(f"__{end}"))
    both = edges.join(known("source"), ["graph_id", "source"], "left").join(known("target"), ["graph_id", "target"], "left")
    return both.where("__source is null or __target is null").select(edges.columns)


def first_of_relationship(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target, relationship)."""
    return _one_each(edges, ["graph_id", "source", "target", "relationship"], "edge_seq", F.min_by)


def collapse(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target): the first of each relationship, then the last of those, at the position of the first."""
    return _one_each(first_of_relationship(edges), ["graph_id", "source", "target"], "edge_seq", F.max_by, at_first=True)


def build(raw: Graph, collapsed: bool = True) -> Graph:
    """The attack graph of raw tables: nodes upserted, dangling edges dropped, parallel edges collapsed (or, if asked, only deduplicated)."""
    nodes = upsert_nodes(raw.nodes)
    edges = attached_edges(raw.edges, nodes)
    return Graph(nodes, collapse(edges) if collapsed else first_of_relationship(edges))


def outline(raw: Graph) -> Graph:
    """What build gives, but of edges only graph_id, edge_seq, source and target, for work that reads no more: their rows are aggregated by hash and not sorted."""
    nodes = upsert_nodes(raw.nodes)
    edges = attached_edges(raw.edges.select("graph_id", "edge_seq", "source", "target"), nodes)
    return Graph(nodes, edges.groupBy("graph_id", "source", "target").agg(F.min("edge_seq").alias("edge_seq")))


def priced(raw: Graph) -> Graph:
    """What the search for ways from sources to sinks reads of build's graph: of nodes graph_id, node_seq, id and whether they are sources or sinks, of edges graph_id, edge_seq, source, target and weight.

    No value is a text, so rows are aggregated by hash and not sorted. Only sources of edges are looked up in the nodes, which are written once for that: edges
    to a missing node stay, but as no edge leaves it, it lies on no way to a sink.
    """
    last = lambda c: F.max_by(c, "node_seq").alias(c)
    nodes = stored(raw.nodes.groupBy("graph_id", "id").agg(F.min("node_seq").alias("first"), last("is_source"), last("is_sink")).withColumnRenamed("first", "node_seq"))
    edges = raw.edges.select("graph_id", "edge_seq", "source", "target", "relationship", "weight").where("target is not null")
    edges = edges.join(nodes.select("graph_id", F.col("id").alias("source")), ["graph_id", "source"], "left_semi")
    seq = F.min("edge_seq").alias("seq")
    edges = edges.groupBy("graph_id", "source", "target", "relationship").agg(F.min_by("weight", "edge_seq").alias("price"), seq).withColumnRenamed("seq", "edge_seq")
    edges = edges.groupBy("graph_id", "source", "target").agg(F.max_by("price", "edge_seq").alias("weight"), seq).withColumnRenamed("seq", "edge_seq")
    return Graph(nodes, edges)


def kept(graph: Graph) -> Graph:
    """The graph with its tables written once; loops read them in every round."""
    return Graph(stored(graph.nodes), stored(graph.edges))


def kept_build(raw: Graph) -> Graph:
    """kept(build(raw)), but edges look their ends up in the nodes that are written, so these are not made anew for either end."""
    nodes = stored(upsert_nodes(raw.nodes))
    return Graph(nodes, stored(collapse(attached_edges(raw.edges, nodes))))


@contextmanager
def dealt(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """Inside, df dealt by the keys and held by the executors, for loops that join it on just these keys in each round: it is shuffled once and not in every one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartition(parts, *keys).persist()
    held.count()
    try:
        yield held
    finally:
        held.unpersist()


def sources(graph: Graph) -> DataFrame:
    return graph.nodes.where("is_source")


def sinks(graph: Graph) -> DataFrame:
    return graph.nodes.where("is_sink")


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))


def _containing(identifiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, identifier, id): the ids that contain an identifier, in any case, by an index of runs of GRAM characters.

    Of an identifier's runs the rarest one in its graph is looked up, and only ids that have it are searched; a shorter identifier is a run of its own. Only
    runs that some identifier has are indexed.
    """
    low = F.lower("identifier")
    own = F.when(F.length(low) < GRAM, F.array(low)).otherwise(_grams(low, GRAM))
    wanted = stored(identifiers.select("graph_id", "identifier", F.explode(own).alias("gram")))
    grams = stored(wanted.select("graph_id", "gram").distinct())
    ids = nodes.select("graph_id", "id").distinct()
    every = F.concat(F.array(F.lit("")), *[_grams(F.lower("id"), n) for n in range(1, GRAM + 1)])
    index = stored(ids.select("graph_id", "id", F.explode(every).alias("gram")).join(F.broadcast(grams) if grams.count() <= FEW_IDENTIFIERS else grams, ["graph_id", "gram"], "left_semi"))
    counts = wanted.join(index.groupBy("graph_id", "gram").agg(F.count("*").alias("n")), ["graph_id", "gram"], "left")
    rarest = counts.groupBy("graph_id", "identifier").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("graph_id", "identifier", "r.gram")
    return rarest.join(index, ["graph_id", "gram"]).where(F.instr(F.lower("id"), low) > 0).select("graph_id", "identifier", "id")


def resolve(identifiers: DataFrame, nodes: DataFrame) -> DataFrame:
    """identifiers (graph_id, identifier) with node: an exact id, else the first node so named (in any case), else the only id that contains it (in any case), else null.

    The exact and named matches are equi-joins, and so is the last by an index of parts of ids; it takes only identifiers that the others leave.
    """
    wanted = identifiers.select("graph_id", "identifier").distinct()
    exact = wanted.join(nodes.select("graph_id", F.col("id").alias("identifier")).distinct(), ["graph_id", "identifier"]).withColumn("node", F.col("identifier"))
    rest = wanted.join(exact, ["graph_id", "identifier"], "left_anti")
    named = rest.withColumn("low", F.lower("identifier")).join(nodes.select("graph_id", F.lower("name").alias("low"), "node_seq", "id"), ["graph_id", "low"])
    named = named.groupBy("graph_id", "identifier").agg(F.min_by("id", "node_seq").alias("node"))
    rest = stored(rest.join(named, ["graph_id", "identifier"], "left_anti"))
    part = _containing(rest, nodes).groupBy("graph_id", "identifier").agg(F.count("*").alias("n"), F.min("id").alias("node")).where("n = 1").drop("n")
    found = exact.unionByName(named).unionByName(part)
    return wanted.join(found, ["graph_id", "identifier"], "left")


def type_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("graph_id", "type").agg(F.count("*").alias("n"))


def relationship_counts(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("graph_id", "relationship").agg(F.count("*").alias("n"))


def counts(graph: Graph) -> DataFrame:
    """(graph_id, nodes, edges, sources, sinks)."""
    nodes = graph.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count_if("is_source").alias("sources"), F.count_if("is_sink").alias("sinks"))
    edges = graph.edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
    return nodes.join(edges, "graph_id", "left").select("graph_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "sources", "sinks")


def histograms(graph: Graph) -> DataFrame:
    """(graph_id, node_types, relationship_types): maps of counts."""
    listed = lambda df, column: df.groupBy("graph_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(f"{column}s"))
    types, relationships = listed(type_counts(graph), "type"), listed(relationship_counts(graph), "relationship")
    empty = F.create_map().cast("map<string, bigint>")
    return types.join(relationships, "graph_id", "left").select("graph_id", F.col("types").alias("node_types"), F.coalesce("relationships", empty).alias("relationship_types"))


def connections(graph: Graph) -> DataFrame:
    """Each node's edges, out and in, with the name of the node at the other end."""
    names = graph.nodes.select("graph_id", F.col("id").alias("other"), F.coalesce("name", "id").alias("other_name"))
    out = graph.edges.select("graph_id", F.col("source").alias("node"), F.lit("out").alias("direction"), F.col("target").alias("other"), "relationship", "weight")
    into = graph.edges.select("graph_id", F.col("target").alias("node"), F.lit("in").alias("direction"), F.col("source").alias("other"), "relationship", "weight")
    return out.unionByName(into).join(names, ["graph_id", "other"], "left")


def degrees(graph: Graph) -> DataFrame:
    ends = graph.edges.select("graph_id", F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.edges.select("graph_id", F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("graph_id", "id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return graph.nodes.select("graph_id", "id").join(sums, ["graph_id", "id"], "left").na.fill(0, ["out_degree", "in_degree"])
