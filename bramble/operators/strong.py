"""Strongly connected components: chains contracted by pointer doubling, then forward-backward colouring.

A chain is a run of nodes with one edge in and one out. Pointers over chains double in each round, so a chain of n nodes is one edge after
log2(n) rounds; it lies in a component if both its ends do. What is left is coloured: a node's colour is the smallest id that reaches it, so a
component has one colour, and the node of that name lies in it if it reaches itself. The component is what reaches that node inside its colour. Components found
and edges between colours go, and the rest starts anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bramble.operators.components import looked_up
from bramble.operators.graph import stored

#: A round of trimming and contraction goes on while it leaves less than this share of the edges; chains are contracted if they are more than this share of them.
SHRINKS, CHAINS = 0.5, 0.1
#: Rounds of colouring that tell of long ways, for which edges are contracted again.
LONG = 12


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges less those whose source has no edge in, or whose target has none out."""
    into = edges.select("graph_id", F.col("v").alias("u")).distinct()
    out = edges.select("graph_id", F.col("u").alias("v")).distinct()
    return edges.join(into, ["graph_id", "u"], "left_semi").join(out, ["graph_id", "v"], "left_semi").select("graph_id", "u", "v")


def _links(edges: DataFrame) -> DataFrame:
    """(graph_id, node, from, to): nodes with one edge in and one out."""
    out = edges.groupBy("graph_id", F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min("v").alias("to")).where("n = 1").drop("n")
    into = edges.groupBy("graph_id", F.col("v").alias("node")).agg(F.count("*").alias("n"), F.min("u").alias("from")).where("n = 1").drop("n")
    return out.join(into, ["graph_id", "node"])


def _contracted(edges: DataFrame, links: DataFrame, count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with each chain as one (a loop if it comes back to where it began), the chains' nodes (graph_id, node, head, tail), and rings (graph_id, node, component) that are chains all round."""
    # `onward` and `back` tell whether a pointer may still stand on a chain's node; pointers that don't are many for one node, so they take no part in joins.
    at, span, before = links.select("graph_id", "node", "from", "to", F.col("node").alias("low"), F.lit(True).alias("onward"), F.lit(True).alias("back")), 1, None
    while True:
        keyed = at.select("*", F.when(F.col("onward"), F.col("to")).otherwise(F.col("node")).alias("ahead"), F.when(F.col("back"), F.col("from")).otherwise(F.col("node")).alias("behind"))
        ahead = at.select("graph_id", F.col("node").alias("ahead"), F.lit(True).alias("onward"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        behind = at.select("graph_id", F.col("node").alias("behind"), F.lit(True).alias("back"), F.col("from").alias("from2"))
        both = keyed.join(ahead, ["graph_id", "ahead", "onward"], "left").join(behind, ["graph_id", "behind", "back"], "left")
        at = stored(both.select("graph_id", "node", F.coalesce("from2", "from").alias("from"), F.coalesce("to2", "to").alias("to"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("to2").isNotNull().alias("onward"), F.col("from2").isNotNull().alias("back")))
        open_, span = at.where("onward").count(), 2 * span
        if not open_ or (open_ == before and span >= count):  # what stays open is rings, by now seen whole
            break
        before = open_
    rings = at.where("onward").select("graph_id", "node", F.col("low").alias("component"))
    members = at.where("not onward").select("graph_id", "node", F.col("from").alias("head"), F.col("to").alias("tail"))
    inner = links.select("graph_id", "node")
    kept = edges.join(inner.withColumnRenamed("node", "u"), ["graph_id", "u"], "left_anti")
    begun = kept.join(members.select("graph_id", F.col("node").alias("v"), "tail"), ["graph_id", "v"]).select("graph_id", "u", F.col("tail").alias("v"))
    plain = kept.join(inner.withColumnRenamed("node", "v"), ["graph_id", "v"], "left_anti").select("graph_id", "u", "v")
    return stored(plain.unionByName(begun).distinct()), members, rings


def _shrunk(edges: DataFrame, levels: list) -> DataFrame:
    """Trimmed and contracted edges, while that pays; each contraction adds what it took out to levels."""
    now = edges.count()
    while now:
        before = now
        edges = stored(_trimmed(edges))
        links = stored(_links(edges))
        count = links.count()
        if count > CHAINS * edges.count():
            edges, members, rings = _contracted(edges, links, count)
            loops = edges.where("u = v").select("graph_id", F.col("u").alias("node"))
            levels.append((members, rings, loops))
            edges = stored(edges.where("u != v"))
        now = edges.count()
        if now > SHRINKS * before:
            break
    return edges


def _coloured(edges: DataFrame) -> tuple[DataFrame, int]:
    """(graph_id, node, colour): the smallest id that reaches each node; and the rounds that it took."""
    ends = edges.select("graph_id", F.col("u").alias("node")).union(edges.select("graph_id", F.col("v").alias("node"))).distinct()
    front = stored(ends.withColumn("colour", F.col("node")))
    known, rounds, steps = front, 0, edges.select("graph_id", F.col("u").alias("node"), F.col("v").alias("next"))
    while True:
        new = front.join(steps, ["graph_id", "node"]).groupBy("graph_id", F.col("next").alias("node")).agg(F.min("colour").alias("colour")).alias("new")
        better = (F.col("new.graph_id") == F.col("old.graph_id")) & (F.col("new.node") == F.col("old.node")) & (F.col("old.colour") <= F.col("new.colour"))
        front = stored(new.join(known.alias("old"), better, "left_anti"))
        if front.isEmpty():
            return stored(known.groupBy("graph_id", "node").agg(F.min("colour").alias("colour"))), rounds
        known, rounds = known.unionByName(front), rounds + 1


def _reaching(edges: DataFrame) -> DataFrame:
    """(graph_id, node, colour): what reaches the node of its colour's name along edges (graph_id, u, v, colour), that node included if anything else does."""
    front = stored(edges.where("v = colour").select("graph_id", F.col("u").alias("node"), "colour").distinct())
    roots = front.select("graph_id", F.col("colour").alias("node"), "colour").distinct()
    found = front.unionByName(roots)
    while not front.isEmpty():
        new = front.withColumnRenamed("node", "v").join(edges, ["graph_id", "v", "colour"]).select("graph_id", F.col("u").alias("node"), "colour").distinct()
        front = stored(new.join(found, ["graph_id", "node", "colour"], "left_anti"))
        found = found.unionByName(front)
    return found.distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): the nodes that lie on a cycle, a self-loop being one, with the smallest id of their strongly connected component.

    edges has graph_id, source and target; other columns are not looked at, and repeated edges count once.
    """
    every = stored(edges.select("graph_id", F.col("source").alias("u"), F.col("target").alias("v")).distinct())
    selves = every.where("u = v").select("graph_id", F.col("u").alias("node"))
    levels, parts = [], []
    rest = _shrunk(every.where("u != v"), levels)
    while not rest.isEmpty():
        colours, rounds = _coloured(rest)
        own, other = (colours.select("graph_id", F.col("node").alias(end), F.col("colour").alias(f"of_{end}")) for end in ("u", "v"))
        inside = stored(rest.join(own, ["graph_id", "u"]).join(other, ["graph_id", "v"]).where("of_u = of_v").select("graph_id", "u", "v", F.col("of_u").alias("colour")))
        found = stored(_reaching(inside))
        parts.append(found.select("graph_id", "node", F.col("colour").alias("component")))
        # A colour's own node is done too, whether or not it is on a cycle.
        done = found.select("graph_id", "node").union(colours.where("node = colour").select("graph_id", "node")).distinct()
        for end in ("u", "v"):
            inside = inside.join(done.withColumnRenamed("node", end), ["graph_id", end], "left_anti")
        rest = stored(_trimmed(inside.select("graph_id", "u", "v")))
        if rounds > LONG:
            rest = _shrunk(rest, levels)
    found = selves.limit(0).withColumn("component", F.col("node"))
    for part in parts:
        found = found.unionByName(part)
    for members, rings, loops in reversed(levels):  # what was contracted last is settled first
        alone = loops.join(found, ["graph_id", "node"], "left_anti")
        found = stored(found.unionByName(alone.withColumn("component", F.col("node"))))
        head, tail = (found.select("graph_id", F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("head", "tail"))
        held = members.join(head, ["graph_id", "head"]).join(tail, ["graph_id", "tail"]).where("of_head = of_tail").select("graph_id", "node", F.col("of_head").alias("component"))
        found = stored(found.unionByName(held).unionByName(rings))
    found = found.unionByName(selves.join(found, ["graph_id", "node"], "left_anti").withColumn("component", F.col("node")))
    if not levels:
        return found
    found = stored(found)
    least = found.groupBy("graph_id", "component").agg(F.count("*").alias("n"), F.min("node").alias("least"))  # a chain's node may be smaller
    return looked_up(found, least, ["graph_id", "component"]).select("graph_id", "node", F.col("least").alias("component"))
