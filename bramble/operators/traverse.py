"""Traversals as frontier joins: reach, cheapest paths, simple paths, cycles, and what follows from them.

Each round joins the frontier with the edges on (graph_id, node) and cuts its lineage. All graphs and all
starts advance together, so the count of rounds is that of the longest traversal, not their sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from bramble.functions.scoring import severity
from bramble.operators import bitsets, ranks
from bramble.operators.components import connected_components
from bramble.operators.graph import Graph, dealt, sinks, small_side, sources, stored
from bramble.operators.strong import strong_components


def require_nodes(graph: Graph, wanted: DataFrame) -> None:
    """ValueError if a (graph_id, id) that was asked for does not exist."""
    missing = wanted.join(graph.nodes, ["graph_id", "id"], "left_anti").take(1)
    if missing:
        raise ValueError(f"no node {missing[0]['id']!r} in graph {missing[0]['graph_id']!r}")


def _search(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> bitsets.Search:
    steps = stored(edges.select("graph_id", F.col("source").alias("node"), F.col("target").alias("next")).where("node != next").distinct())
    return bitsets.search(steps, stored(bitsets.numbered(starts)), max_hops)


def reach(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(graph_id, start, node, hop): what each start (graph_id, start) reaches, itself at hop 0, with the least hops."""
    return _search(edges, starts, max_hops).reached()


def _blast_starts(graph: Graph, starts: DataFrame | None) -> DataFrame:
    if starts is None:
        starts = sources(graph)
    else:
        require_nodes(graph, starts)
    return starts.select("graph_id", F.col("id").alias("start"))


def blast_radius(graph: Graph, starts: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """(graph_id, source, hop, node) for hops 1 to max_depth. starts (graph_id, id) default to all sources; unknown ones raise ValueError."""
    found = reach(graph.edges, _blast_starts(graph, starts), max_depth)
    return found.where("hop > 0").select("graph_id", F.col("start").alias("source"), "hop", "node")


def blast_sizes(graph: Graph, starts: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """(graph_id, source, hop, nodes): the sizes of the layers of blast_radius, without a row for each node."""
    found = _search(graph.edges, _blast_starts(graph, starts), max_depth).counts()
    return found.where("hop > 0").select("graph_id", F.col("start").alias("source"), "hop", "nodes")


def blast_counts(layers: DataFrame) -> DataFrame:
    return layers.groupBy("graph_id", "source", "hop").agg(F.count("*").alias("nodes"))


def _hops(steps: DataFrame, starts: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(graph_id, node, left): the hops along steps (graph_id, node, next) to each node from its nearest start (graph_id, node)."""
    # All starts of a graph go as one: a node keeps its least hops.
    found = stored(starts.select("graph_id", "node").distinct().withColumn("left", F.lit(0)))
    front, hop = found, 0
    while cutoff is None or hop < cutoff:
        hop += 1
        new = small_side(front).join(steps, ["graph_id", "node"]).select("graph_id", F.col("next").alias("node")).distinct()
        front = stored(new.join(found, ["graph_id", "node"], "left_anti").withColumn("left", F.lit(hop)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return stored(found)


def hops_to_sinks(graph: Graph, cutoff: int | None = None) -> DataFrame:
    """(graph_id, node, left): the hops from each node to its nearest sink."""
    back = graph.edges.select("graph_id", F.col("target").alias("node"), F.col("source").alias("next"))
    return _hops(back, sinks(graph).select("graph_id", F.col("id").alias("node")), cutoff)


def cheapest_paths(graph: Graph, starts: DataFrame, towards: DataFrame | None = None) -> DataFrame:
    """(graph_id, start, node, cost, hops, path): the cheapest path from each start (graph_id, start) to each node it reaches, itself included.

    Label correcting: a round relaxes the edges of the labels that the last one found, keeps the best new label of each node, and drops
    those that an older label of the node beats; labels are written once and never again. Ties go to fewer hops, then to the
    smaller array of nodes. towards (graph_id, node) restricts the search to those nodes. Negative weights raise ValueError.
    """
    if not graph.edges.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    steps = graph.edges.select("graph_id", F.col("source").alias("node"), F.col("target").alias("next"), "weight").where("node != next")
    if towards is not None:
        steps = steps.join(towards.select("graph_id", F.col("node").alias("next")), ["graph_id", "next"], "left_semi")
    steps = stored(steps)
    keys = ["graph_id", "start", "node"]
    label = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("start").alias("path"))
    front = stored(starts.distinct().select("graph_id", "start", F.col("start").alias("node"), label.alias("label")))
    known, rounds = front, 0
    while True:
        longer = F.struct((F.col("label.cost") + F.col("weight")).alias("cost"), (F.col("label.hops") + 1).alias("hops"), F.concat("label.path", F.array("next")).alias("path"))
        new = front.join(steps, ["graph_id", "node"]).select("graph_id", "start", F.col("next").alias("node"), longer.alias("label"))
        new = new.groupBy(*keys).agg(F.min("label").alias("label")).alias("new")
        better = F.col("old.label") <= F.col("new.label")
        front = stored(new.join(known.alias("old"), [F.col(f"new.{k}") == F.col(f"old.{k}") for k in keys] + [better], "left_anti"))
        if front.isEmpty():
            break
        known, rounds = known.unionByName(front), rounds + 1
    if rounds > 1:  # a node's later labels are better
        known = known.groupBy(*keys).agg(F.min("label").alias("label"))
    return known.select(*keys, "label.*")


def _spread(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, node): what the nodes (graph_id, node) reach along steps (graph_id, node, next), all together."""
    front = stored(starts.select("graph_id", "node").distinct())
    found = front
    while not front.isEmpty():
        new = small_side(front).join(steps, ["graph_id", "node"]).select("graph_id", F.col("next").alias("node")).distinct()
        front = stored(new.join(found, ["graph_id", "node"], "left_anti"))
        found = found.unionByName(front)
    return found


def pointers_to(graph: Graph, ends: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, end, node, cost, hops, next, weight): the cheapest way from each node to each end (graph_id, end) that it reaches, as a pointer to the next node, with the weight of the edge (both null at the end itself).

    The search goes backwards from the ends, over nodes that the starts (graph_id, node) reach. Label correcting, as in cheapest_paths, but a label holds a pointer and no path: of equal
    cost and hops the smaller next node wins, and so, node by node, the smaller path. Negative weights raise ValueError.
    """
    if not graph.edges.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    steps = graph.edges.select("graph_id", F.col("source").alias("node"), F.col("target").alias("next"), "weight").where("node != next")
    with dealt(steps, "graph_id", "node") as steps:
        steps = stored(steps.join(_spread(steps, starts), ["graph_id", "node"], "left_semi"))
    keys = ["graph_id", "end", "node"]
    label = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("next"), F.lit(None).cast("double").alias("weight"))
    front = stored(ends.distinct().select("graph_id", "end", F.col("end").alias("node"), label.alias("label")))
    known, rounds = front, 0
    while True:
        longer = F.struct((F.col("label.cost") + F.col("weight")).alias("cost"), (F.col("label.hops") + 1).alias("hops"), F.col("next").alias("next"), F.col("weight").alias("weight"))
        new = small_side(front).withColumnRenamed("node", "next").join(steps, ["graph_id", "next"]).select("graph_id", "end", "node", longer.alias("label"))
        new = new.groupBy(*keys).agg(F.min("label").alias("label")).alias("new")
        better = F.col("old.label") <= F.col("new.label")
        front = stored(new.join(known.alias("old"), [F.col(f"new.{k}") == F.col(f"old.{k}") for k in keys] + [better], "left_anti"))
        if front.isEmpty():
            break
        known, rounds = known.unionByName(front), rounds + 1
    if rounds > 1:
        known = known.groupBy(*keys).agg(F.min("label").alias("label"))
    return known.select(*keys, "label.*")


def walked(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, end, start, at, node): the nodes in order of the path from each start (graph_id, node) to each end, by pointer doubling.

    In round k a pointer spans 2 ** k hops; the spans are kept, and then, from the longest down, each node found so far gives the one that is a span after it.
    So a path of n hops takes log2(n) rounds both ways, and only the starts' paths are written out.
    """
    keys = ["graph_id", "end", "node"]
    jump = stored(pointers.where("next is not null").select(*keys, "next"))
    most = pointers.join(starts.select("graph_id", "node").distinct(), ["graph_id", "node"], "left_semi").agg(F.max("hops")).first()[0] or 0
    jumps = []
    for _ in range(most.bit_length()):
        jumps.append(jump)
        after = jump.select("graph_id", "end", F.col("node").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(after, ["graph_id", "end", "next"]).select(*keys, F.col("far").alias("next")))
    found = pointers.join(starts.select("graph_id", "node").distinct(), ["graph_id", "node"], "left_semi").select("graph_id", "end", F.col("node").alias("start"), F.lit(0).alias("at"), "node")
    for k in reversed(range(len(jumps))):
        found = stored(found)
        ahead = found.join(jumps[k], keys).select("graph_id", "end", "start", (F.col("at") + (1 << k)).alias("at"), F.col("next").alias("node"))
        found = found.unionByName(ahead)
    return found


def _detailed(graph: Graph, each: DataFrame, ends: list[str]) -> DataFrame:
    """Paths from rows of their nodes (graph_id, *ends, at, source, target); target is null at the end. cost adds up the weights in order."""
    edges = graph.edges.select("graph_id", "source", "target", "weight", "relationship", "cve", "cvss")
    each = each.join(edges, ["graph_id", "source", "target"], "left")
    each = each.join(graph.nodes.select("graph_id", F.col("id").alias("source"), F.coalesce("name", "id").alias("name")), ["graph_id", "source"], "left")
    rows = F.sort_array(F.collect_list(F.struct("at", "source", "name", "weight", "relationship", "cve", "cvss"))).alias("rows")
    out = each.groupBy("graph_id", *ends).agg(rows)
    hops = F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0)))
    cost = F.aggregate(hops, F.lit(0.0), lambda a, h: a + h["weight"])
    return out.select("graph_id", *ends, cost.alias("cost"), (F.size("rows") - 1).alias("hops"), F.col("rows.source").alias("path"), F.col("rows.name").alias("path_names"), hops["relationship"].alias("relationships"), hops["cve"].alias("cves"), hops["cvss"].alias("cvss"))


def with_details(graph: Graph, found: DataFrame) -> DataFrame:
    """Paths (graph_id, start, node, path) with cost, hops, path_names and each hop's relationships, cves and cvss."""
    place = F.posexplode(F.arrays_zip(F.col("path").alias("source"), F.concat(F.slice("path", 2, F.size("path")), F.array(F.lit(None).cast("string"))).alias("target"))).alias("at", "e")
    return _detailed(graph, found.select("graph_id", "start", "node", place).select("*", "e.*").drop("e"), ["start", "node"])


def _shown() -> list[Column]:
    return [F.col("path").alias("path_nodes"), *map(F.col, ("path_names", "relationships", "cves", "cvss")), F.col("hops").alias("hop_count"), F.col("cost").alias("total_risk"), severity(F.col("cost")).alias("severity")]


def attack_paths(graph: Graph) -> DataFrame:
    """The cheapest path for each source and sink that it reaches, with names, details and severity; total_risk 0 where they are one node.

    The search starts from whichever is fewer in all graphs together, sources or sinks. Backwards, costs are compared as they add up from the sink; total_risk always adds up from the source.
    """
    ends = sinks(graph).select("graph_id", F.col("id").alias("node"), F.col("node_seq").alias("sink_seq"))
    from_ = sources(graph).select("graph_id", F.col("id").alias("start"), F.col("node_seq").alias("source_seq"))
    if ends.count() < from_.count():
        starts = from_.select("graph_id", F.col("start").alias("node"))
        found = walked(pointers_to(graph, ends.select("graph_id", F.col("node").alias("end")), starts), starts)
        then = found.select("graph_id", "end", "start", (F.col("at") - 1).alias("at"), F.col("node").alias("target"))
        each = found.withColumnRenamed("node", "source").join(then, ["graph_id", "end", "start", "at"], "left")
        found = _detailed(graph, each.withColumnRenamed("end", "node"), ["start", "node"])
    else:
        found = cheapest_paths(graph, from_.select("graph_id", "start"), hops_to_sinks(graph))
        found = with_details(graph, found.join(ends.select("graph_id", "node"), ["graph_id", "node"], "left_semi"))
    found = found.join(ends, ["graph_id", "node"]).join(from_, ["graph_id", "start"])
    return found.select("graph_id", F.col("start").alias("source"), F.col("node").alias("sink"), *_shown(), "source_seq", "sink_seq")


def attack_costs(graph: Graph) -> DataFrame:
    """(graph_id, source, sink, hop_count, total_risk, severity) of attack_paths, with no path written out: nodes need no names and edges no details (graph.priced has all that this reads)."""
    ends = sinks(graph).select("graph_id", F.col("id").alias("node"))
    from_ = sources(graph).select("graph_id", F.col("id").alias("start"))
    if ends.count() < from_.count():
        starts = from_.withColumnRenamed("start", "node")
        pointers = stored(pointers_to(graph, ends.withColumnRenamed("node", "end"), starts))
        each = walked(pointers, starts).join(pointers.select("graph_id", "end", "node", "weight"), ["graph_id", "end", "node"])
        rows = F.sort_array(F.collect_list(F.struct("at", "weight")))  # the end's weight is null and comes last
        hops = F.slice("rows", 1, F.size("rows") - 1)
        found = each.groupBy("graph_id", "start", F.col("end").alias("node")).agg(rows.alias("rows"))
        found = found.select("graph_id", "start", "node", F.aggregate(hops, F.lit(0.0), lambda a, h: a + h["weight"]).alias("cost"), (F.size("rows") - 1).alias("hops"))
    else:
        found = cheapest_paths(graph, from_, hops_to_sinks(graph)).join(ends, ["graph_id", "node"], "left_semi")
    return found.select("graph_id", F.col("start").alias("source"), F.col("node").alias("sink"), F.col("hops").alias("hop_count"), F.col("cost").alias("total_risk"), severity(F.col("cost")).alias("severity"))


def shortest_path(graph: Graph, pairs: DataFrame) -> DataFrame:
    """The cheapest path of each pair (graph_id, source, target) that has one; unknown nodes raise ValueError."""
    for end in ("source", "target"):
        require_nodes(graph, pairs.select("graph_id", F.col(end).alias("id")))
    found = cheapest_paths(graph, pairs.select("graph_id", F.col("source").alias("start")))
    hit = found.join(pairs.select("graph_id", F.col("source").alias("start"), F.col("target").alias("node")).distinct(), ["graph_id", "start", "node"])
    return with_details(graph, hit).select("graph_id", F.col("start").alias("source"), F.col("node").alias("target"), *_shown())


def ranked(paths: DataFrame) -> DataFrame:
    """Attack paths with their rank in the graph, by ranges over many tasks: ascending risk, then the order of sources and sinks."""
    return ranks.ranked(paths, ["graph_id"], [F.col("total_risk"), F.col("source_seq"), F.col("sink_seq")])


def path_hops(paths: DataFrame) -> DataFrame:
    """A row for each hop of each attack path: hop (from 1), from_node, to_node, relationship, cve, cvss."""
    each = F.posexplode(F.arrays_zip(F.slice("path_nodes", 1, F.greatest(F.size("path_nodes") - 1, F.lit(0))).alias("a"), F.slice("path_nodes", 2, F.size("path_nodes")).alias("b"), F.col("relationships").alias("r"), F.col("cves").alias("c"), F.col("cvss").alias("s")))
    return paths.select("graph_id", "source", "sink", each.alias("hop", "h")).select("graph_id", "source", "sink", (F.col("hop") + 1).alias("hop"), F.col("h.a").alias("from_node"), F.col("h.b").alias("to_node"), F.col("h.r").alias("relationship"), F.col("h.c").alias("cve"), F.col("h.s").alias("cvss"))


def _guarded(front: DataFrame, max_paths: int | None, hop: int) -> DataFrame:
    if max_paths is not None and front.count() > max_paths:
        raise RuntimeError(f"more than {max_paths} paths of {hop} edges")
    return front


def _endings(steps: DataFrame, front: DataFrame, ends: DataFrame, longest: int, max_paths: int | None) -> DataFrame:
    """(graph_id, node, sink, rest): the simple ways of 1 to `longest` edges from the nodes of front to ends (graph_id, node); rest is what follows the node.

    They grow backwards from the ends, over nodes that the front reaches in time.
    """
    away = _hops(steps, front, longest)
    back = stored(steps.select("graph_id", F.col("next").alias("node"), F.col("node").alias("prev")).join(away.select("graph_id", F.col("node").alias("prev"), F.col("left").alias("away")), ["graph_id", "prev"]))
    tails = ends.join(away, ["graph_id", "node"]).select("graph_id", "node", F.col("node").alias("sink"), F.array().cast("array<string>").alias("rest"))
    found = None
    for hop in range(1, longest + 1):
        new = tails.join(back.where(F.col("away") + hop <= longest), ["graph_id", "node"]).where(~F.array_contains("rest", F.col("prev")))
        tails = stored(new.select("graph_id", F.col("prev").alias("node"), "sink", F.concat(F.array("node"), "rest").alias("rest"), (F.col("away") == 0).alias("meets")))
        found = tails if found is None else found.unionByName(tails)
        if _guarded(tails, max_paths, hop).isEmpty():
            break
    return found.where("meets").drop("meets")


def simple_paths(graph: Graph, cutoff: int = 15, include_trivial: bool = True, max_paths: int | None = None) -> DataFrame:
    """(graph_id, source, sink, path_nodes): all paths from a source to a sink of at most `cutoff` edges that repeat no node.

    A path ends at its sink but may pass others on the way. Only prefixes that can still reach a sink in time are kept, and they grow to half the cutoff only: longer paths are prefixes of
    just that many edges that meet, on their last node, ways to a sink that share no other node with them. So a path of 15 edges has rows for its first 8 and its last 7, each shared
    with all paths that begin or end alike. More than max_paths prefixes or endings in a round raise RuntimeError; nothing is ever cut off silently.
    """
    left = hops_to_sinks(graph, cutoff)
    steps = graph.edges.select("graph_id", F.col("source").alias("node"), F.col("target").alias("next"))
    steps = stored(steps.where("node != next").join(left.select("graph_id", F.col("node").alias("next"), "left"), ["graph_id", "next"]))
    front = stored(sources(graph).select("graph_id", F.col("id").alias("node")).join(left, ["graph_id", "node"]).select("graph_id", F.col("node").alias("source"), "node", F.array("node").alias("path_nodes"), (F.col("left") == 0).alias("ends")))
    done, half = front.where("ends") if include_trivial else front.where("false"), (cutoff + 1) // 2
    for hop in range(1, half + 1):
        new = front.join(steps.where(F.col("left") + hop <= cutoff), ["graph_id", "node"]).where(~F.array_contains("path_nodes", F.col("next")))
        front = stored(new.select("graph_id", "source", F.col("next").alias("node"), F.concat("path_nodes", F.array("next")).alias("path_nodes"), (F.col("left") == 0).alias("ends")))
        if _guarded(front, max_paths, hop).isEmpty():
            break
        done = done.unionByName(front.where("ends"))
    done = done.select("graph_id", "source", F.col("node").alias("sink"), "path_nodes")
    if half == cutoff or front.isEmpty():
        return done
    endings = _endings(steps, front, left.where("left = 0").select("graph_id", "node"), cutoff - half, max_paths)
    met = front.join(endings, ["graph_id", "node"]).where(~F.arrays_overlap("path_nodes", "rest"))
    return done.unionByName(met.select("graph_id", "source", "sink", F.concat("path_nodes", "rest").alias("path_nodes")))


def path_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy("graph_id").agg(F.count("*").alias("paths"))


def _through(paths: DataFrame) -> DataFrame:
    return paths.select("graph_id", F.explode("path_nodes").alias("id")).groupBy("graph_id", "id").agg(F.count("*").alias("paths_through"))


@dataclass(frozen=True)
class PathTotals:
    """through (graph_id, id, paths_through): the simple paths on which each node lies; counts (graph_id, paths): those of each graph. Both without zeros."""

    through: DataFrame
    counts: DataFrame

    @staticmethod
    def of(paths: DataFrame) -> PathTotals:
        return PathTotals(_through(paths), path_counts(paths))


def _counted(n: str) -> Column:
    """A count of walks; one that is null, as it didn't fit in a long, raises."""
    return F.coalesce(n, F.raise_error(F.lit("more paths than a long can count")).cast("long"))


def _walks(steps: DataFrame, first: DataFrame, most: int, within: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, hops, n): the walks of so many hops, `most` at most, from the nodes of first to each node, along steps (graph_id, node, next).

    n is null if it doesn't fit in a long. Walks stay within nodes (graph_id, node), if given.
    """
    front = stored(first.select("graph_id", "node", F.lit(0).alias("hops"), F.lit(1).cast("long").alias("n")))
    found = front
    for hop in range(1, most + 1):
        # try_sum skips nulls, so what doesn't fit is carried on apart.
        new = small_side(front).join(steps, ["graph_id", "node"]).groupBy("graph_id", F.col("next").alias("node")).agg(F.when(F.count("*") == F.count("n"), F.try_sum("n")).alias("n"))
        if within is not None:
            new = new.join(within, ["graph_id", "node"], "left_semi")
        front = stored(new.select("graph_id", "node", F.lit(hop).alias("hops"), "n"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def path_totals(graph: Graph, cutoff: int = 15) -> PathTotals:
    """What PathTotals.of(simple_paths(graph, cutoff)) gives, with no path enumerated in graphs without a cycle on the way from sources to sinks.

    There every walk is a simple path, so the walks from sources to a node, by hops, times those from it to sinks, are the paths through it. A number that
    doesn't fit in a long raises (in ANSI mode). Only graphs with a cycle on the way are enumerated.
    """
    every = graph.edges.where("source != target").select("graph_id", F.col("source").alias("node"), F.col("target").alias("next"))
    ends = sinks(graph).select("graph_id", F.col("id").alias("node"))
    back = _walks(every.select("graph_id", F.col("next").alias("node"), F.col("node").alias("next")), ends, cutoff)
    left = stored(back.select("graph_id", "node").distinct())
    starts = sources(graph).select("graph_id", F.col("id").alias("node")).join(left, ["graph_id", "node"], "left_semi")
    forth = _walks(every, starts, cutoff + 1, within=left)
    # A cycle on the way makes walks of any length; graphs with walks of over cutoff edges are looked at closer, and in all others no walk repeats a node.
    long = stored(forth.where(F.col("hops") > cutoff).select("graph_id").distinct())
    cyclic = long
    if not long.isEmpty():
        on_way = stored(forth.join(long, "graph_id", "left_semi").select("graph_id", "node").distinct())
        steps = every.join(on_way, ["graph_id", "node"], "left_semi").join(on_way.withColumnRenamed("node", "next"), ["graph_id", "next"], "left_semi")
        cyclic = stored(strong_components(steps.select("graph_id", F.col("node").alias("source"), F.col("next").alias("target"))).select("graph_id").distinct())
    known = lambda df: df.join(cyclic, "graph_id", "left_anti").where(F.col("hops") <= cutoff).withColumn("n", _counted("n"))
    forth, back = known(forth), known(back)
    rest = back.select("graph_id", "node", F.col("hops").alias("more"), F.col("n").alias("m"))  # a row for each hop of a node at most
    through = forth.join(rest, ["graph_id", "node"]).where(F.col("hops") + F.col("more") <= cutoff).groupBy("graph_id", F.col("node").alias("id")).agg(F.sum(F.col("n") * F.col("m")).alias("paths_through"))
    counts = forth.join(ends, ["graph_id", "node"], "left_semi").groupBy("graph_id").agg(F.sum("n").alias("paths"))
    if cyclic.isEmpty():
        return PathTotals(through, counts)
    only = lambda df: df.join(cyclic, "graph_id", "left_semi").select(df.columns)
    others = PathTotals.of(simple_paths(Graph(only(graph.nodes), only(graph.edges)), cutoff))
    return PathTotals(through.unionByName(others.through), counts.unionByName(others.counts))


def critical_nodes(graph: Graph, paths: DataFrame | PathTotals, top_n: int = 5) -> DataFrame:
    """The top_n nodes of each graph, neither source nor sink, whose removal breaks most simple paths; ties in node order.

    Removing a node breaks the simple paths that contain it, so counting those replaces any work on altered graphs. paths are simple paths or their totals.
    """
    totals = paths if isinstance(paths, PathTotals) else PathTotals.of(paths)
    inner = graph.nodes.where("not is_source and not is_sink").select("graph_id", "id", "name", "node_seq")
    hit = totals.through.join(inner, ["graph_id", "id"])
    # Tasks keep top_n rows a graph before any is moved.
    hit = hit.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("paths_through"), "node_seq"))).where(F.col("rank") <= top_n)
    hit = hit.join(totals.counts, "graph_id")
    return hit.select("graph_id", "rank", "id", "name", F.col("paths_through").alias("eliminated"), F.col("paths").alias("baseline"), (F.col("paths_through") / F.greatest("paths", F.lit(1)) * 100).alias("percent"))


def amplified(graph: Graph, paths: DataFrame | PathTotals) -> DataFrame:
    """Each node's risk, amplified by the logarithm of the simple paths (or their totals) through it; not ranked."""
    totals = paths if isinstance(paths, PathTotals) else PathTotals.of(paths)
    all_ = graph.nodes.join(totals.through, ["graph_id", "id"], "left").withColumn("paths_through", F.coalesce("paths_through", F.lit(0)))
    risk = F.col("risk_score") * (1 + F.log2(1 + F.col("paths_through")))
    return all_.select("graph_id", "node_seq", F.col("id").alias("node_id"), "name", "type", F.col("risk_score").alias("base_risk"), "paths_through", risk.alias("amplified_risk"))


def node_risk(graph: Graph, paths: DataFrame | PathTotals, top_n: int | None = None) -> DataFrame:
    """amplified with each node's rank in its graph, ties in node order. A short list is cut off in the tasks; all ranks are found by ranges, so no task holds a graph."""
    all_, order = amplified(graph, paths), [F.desc("amplified_risk"), F.col("node_seq")]
    if top_n is None:
        out = ranks.ranked(all_, ["graph_id"], order)
    else:
        out = all_.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(*order))).where(F.col("rank") <= top_n)
    return out.select("graph_id", "rank", *[c for c in all_.columns if c not in ("graph_id", "node_seq")])


def is_dag(graph: Graph, known: DataFrame | None = None) -> DataFrame:
    """(graph_id, is_dag); a self-loop is a cycle. Graphs with known cycles (graph_id, ...) are not searched again."""
    if known is None:
        bad = strong_components(graph.edges).select("graph_id").distinct().withColumn("is_dag", F.lit(False))
    else:
        known = stored(known.select("graph_id").distinct())
        others = strong_components(graph.edges.join(known, "graph_id", "left_anti")).select("graph_id").distinct()
        bad = known.unionByName(others).withColumn("is_dag", F.lit(False))
    return graph.nodes.select("graph_id").distinct().join(bad, "graph_id", "left").withColumn("is_dag", F.coalesce("is_dag", F.lit(True)))


def weak_components(graph: Graph) -> DataFrame:
    """(graph_id, components): the count of undirected components; lone nodes count.

    Nodes go by a 64-bit hash while no two have the same one, else by graph and id.
    """
    short, long = (lambda end: F.xxhash64("graph_id", end)), (lambda end: F.struct("graph_id", F.col(end).alias("id")))
    total = graph.nodes.select(F.count("*"), F.count_distinct(short("id"))).first()
    mark = short if total[0] == total[1] else long
    found = connected_components(graph.edges.select(mark("source").alias("u"), mark("target").alias("v")), stored)
    nodes = graph.nodes.withColumn("node", mark("id")).join(found, "node", "left")
    return nodes.groupBy("graph_id").agg(F.count_distinct(F.coalesce("component", "node")).alias("components"))


def _with_names(graph: Graph, steps: DataFrame) -> DataFrame:
    """steps of _inside with name and next_name, those of their ends."""
    names = graph.nodes.select("graph_id", F.col("id").alias("node"), F.coalesce("name", "id").alias("name"))
    steps = steps.join(names, ["graph_id", "node"]).join(names.withColumnsRenamed({"node": "next", "name": "next_name"}), ["graph_id", "next"])
    return stored(steps)


def _inside(edges: DataFrame) -> DataFrame:
    """(graph_id, node, next, weight, relationship, place, next_place): edges whose ends are in one strongly connected component; places number the ids of a graph's nodes on cycles, in order."""
    found = strong_components(edges)
    places = bitsets.numbered(found.select("graph_id", F.col("node").alias("start")))
    known = stored(found.join(places.withColumnRenamed("start", "node"), ["graph_id", "node"]))
    ends = [known.select("graph_id", F.col("node").alias(end), F.col("component").alias(f"of_{end}"), F.col("place").alias(place)) for end, place in (("source", "place"), ("target", "next_place"))]
    both = edges.join(ends[0], ["graph_id", "source"]).join(ends[1], ["graph_id", "target"]).where("of_source = of_target")
    return stored(both.select("graph_id", F.col("source").alias("node"), F.col("target").alias("next"), "weight", "relationship", "place", "next_place"))


def _ways_back(steps: DataFrame) -> DataFrame:
    """(graph_id, node, word, bits): the starts to which each node has a way over nodes that come after the start, as bits by their places."""
    starts = stored(steps.where("place < next_place").select("graph_id", F.col("node").alias("start"), "place").distinct())
    back = stored(steps.select("graph_id", F.col("next").alias("node"), F.col("node").alias("next"), F.col("place").alias("to")))
    found = bitsets.search(back, starts, mask=bitsets.below(F.col("word"), F.col("to")))
    return stored(found.layers.where("hop > 0").groupBy(*bitsets.KEYS).agg(F.bit_or("bits").alias("back")))


def cycles(graph: Graph, max_len: int | None = None, max_cycles: int | None = None, detailed: bool = False) -> DataFrame:
    """(graph_id, cycle, risk, length): every elementary circuit once, from its smallest id on. detailed: besides cycle_names and top, the edge of break_edges (null if no weight counts).

    Paths grow inside strongly connected components, from each node over greater ids only, and only to nodes that have a way back to it, and end when they come back, so no
    circuit is found twice. Ways back are bit sets, a bit for each start. More than max_cycles open paths in a round raise RuntimeError. Details grow with the paths, edge by edge, so that
    no cycle is taken apart and looked up again; edges are detailed once. Where edges are parallel, break_edges merges their circuits, and these details don't.
    """
    steps = _inside(graph.edges)
    ways = _ways_back(steps)
    if detailed:
        steps = _with_names(graph, steps)
    at = F.lit(0)  # the place of the next edge

    def edge() -> Column:
        """The next edge, so that the heaviest is the greatest, and of equals the first; null if its weight doesn't count."""
        return F.when(F.col("weight") > -1, F.struct("weight", (-at).alias("at"), F.col("node").alias("source"), F.col("next").alias("target"), "relationship"))

    named = [F.array("name", "next_name").alias("cycle_names"), edge().alias("top")] if detailed else []

    def kept(grown: DataFrame) -> DataFrame:
        """What has come back to its start, and what still has a way back."""
        held = grown.withColumn("word", bitsets.word_of(F.col("at"))).join(ways, bitsets.KEYS, "left")
        return stored(held.where(F.col("closed") | (F.col("back").bitwiseAND(bitsets.bit_of(F.col("at"))) != 0)).select(grown.columns))

    loops = steps.where("place = next_place").select("graph_id", F.array("node").alias("cycle"), F.col("weight").alias("risk"), *([F.array("name").alias("cycle_names"), named[1]] if detailed else []))
    begin = steps.where("place < next_place").select("graph_id", F.col("place").alias("at"), F.col("next").alias("node"), F.array("node", "next").alias("cycle"), F.col("weight").alias("risk"), F.lit(False).alias("closed"), *named)
    done, front, length = loops, kept(begin), 2
    grows = steps.select("graph_id", "node", "next", "weight", "next_place", *(["next_name", "relationship"] if detailed else []))
    while not front.isEmpty() and (max_len is None or length <= max_len):
        if max_cycles is not None and front.count() > max_cycles:
            raise RuntimeError(f"more than {max_cycles} open paths of {length} nodes")
        more = front.drop("closed").join(grows, ["graph_id", "node"]).where("next_place >= at").withColumn("closed", F.col("next_place") == F.col("at"))
        more = more.where(F.col("closed") | ~F.array_contains("cycle", F.col("next")))
        longer = lambda c, end: F.when(F.col("closed"), F.col(c)).otherwise(F.concat(c, F.array(end))).alias(c)
        at = F.lit(length - 1)
        named = [longer("cycle_names", "next_name"), F.greatest("top", edge()).alias("top")] if detailed else []
        found = kept(more.select("graph_id", "at", F.col("next").alias("node"), longer("cycle", "next"), (F.col("risk") + F.col("weight")).alias("risk"), "closed", *named))
        done = done.unionByName(found.where("closed").select(done.columns))
        front = found.where("not closed")
        length += 1
    return done.select("graph_id", "cycle", "risk", F.size("cycle").alias("length"), *(["cycle_names", "top"] if detailed else []))


def with_cycle_names(graph: Graph, found: DataFrame) -> DataFrame:
    """Cycles with cycle_names, the names of their nodes; detailed ones have them."""
    if "cycle_names" in found.columns:
        return found
    each = found.select("graph_id", "cycle", F.posexplode("cycle").alias("at", "id")).join(graph.nodes.select("graph_id", "id", F.coalesce("name", "id").alias("name")), ["graph_id", "id"])
    names = each.groupBy("graph_id", "cycle").agg(F.sort_array(F.collect_list(F.struct("at", "name")))["name"].alias("cycle_names"))
    return found.join(names, ["graph_id", "cycle"])


def cycle_edges(found: DataFrame) -> DataFrame:
    """(graph_id, cycle, at, source, target) for each edge round each cycle."""
    pairs = F.arrays_zip(F.col("cycle").alias("s"), F.concat(F.slice("cycle", 2, F.size("cycle")), F.slice("cycle", 1, 1)).alias("t"))
    return found.select("graph_id", "cycle", F.posexplode(pairs).alias("at", "e")).select("graph_id", "cycle", "at", F.col("e.s").alias("source"), F.col("e.t").alias("target"))


def break_edges(graph: Graph, found: DataFrame) -> DataFrame:
    """The heaviest edge of each cycle, the first of equals; weights of -1 and less never count. Detailed cycles have it."""
    if "top" in found.columns:
        return found.where("top is not null").select("graph_id", "cycle", *[F.col(f"top.{c}").alias(c) for c in ("source", "target", "weight", "relationship")])
    edges = cycle_edges(found).join(graph.edges.select("graph_id", "source", "target", "weight", "relationship"), ["graph_id", "source", "target"]).where("weight > -1")
    top = edges.groupBy("graph_id", "cycle").agg(F.max_by(F.struct("source", "target", "weight", "relationship"), F.struct("weight", -F.col("at"))).alias("e"))
    return top.select("graph_id", "cycle", "e.*")


def paths_through(paths: DataFrame) -> DataFrame:
    """The attack paths that each node lies on: (graph_id, node, paths, least_risk)."""
    return paths.select("graph_id", F.explode("path_nodes").alias("node"), "total_risk").groupBy("graph_id", "node").agg(F.count("*").alias("paths"), F.min("total_risk").alias("least_risk"))


def edge_flags(graph: Graph, paths: DataFrame, found: DataFrame, critical: DataFrame) -> DataFrame:
    """Edges with on_path, on_cycle, and whether either end is among the critical nodes."""
    on_path = path_hops(paths).select("graph_id", F.col("from_node").alias("source"), F.col("to_node").alias("target")).distinct().withColumn("on_path", F.lit(True))
    on_cycle = cycle_edges(found).select("graph_id", "source", "target").distinct().withColumn("on_cycle", F.lit(True))
    top = critical.select("graph_id", "id").distinct()
    out = graph.edges.join(on_path, ["graph_id", "source", "target"], "left").join(on_cycle, ["graph_id", "source", "target"], "left")
    for end in ("source", "target"):
        out = out.join(top.select("graph_id", F.col("id").alias(end), F.lit(True).alias(f"__{end}")), ["graph_id", end], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select("graph_id", "source", "target", "relationship", flag("on_path").alias("on_path"), flag("on_cycle").alias("on_cycle"), (flag("__source") | flag("__target")).alias("critical"))
