"""Remediation and explanation as tables of lines, one row a line, with their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bramble.functions import rules
from bramble.operators.graph import Graph
from bramble.operators.traverse import break_edges, path_hops, with_cycle_names


def _fixed(number: Column, pattern: str = "0.0") -> Column:
    """A number with so many decimals; halves go to even."""
    return F.call_function("format_number", number, F.lit(pattern))


def _called(kind: Column, name: Column, nouns: dict[str, str]) -> Column:
    return F.concat(F.lower(rules.lookup(nouns, kind, F.coalesce(kind, F.lit("resource")))), F.lit(" '"), name, F.lit("'"))


def _named_hops(graph: Graph, paths: DataFrame) -> DataFrame:
    node = lambda end: graph.nodes.select("graph_id", F.col("id").alias(end), F.coalesce("name", "id").alias(f"{end}_name"), F.col("type").alias(f"{end}_type"))
    return path_hops(paths).join(node("from_node"), ["graph_id", "from_node"]).join(node("to_node"), ["graph_id", "to_node"])


def path_remediation(graph: Graph, paths: DataFrame, fixes: dict[str, str] = rules.FIXES, type_fixes: dict[str, str] = rules.TYPE_FIXES) -> DataFrame:
    """Lines of each hop: part 1 for its relationship, 2 for its CVE if it has one, 3 for the type it leads to if known."""
    hops = _named_hops(graph, paths)
    one = rules.lookup(fixes, F.col("relationship"), F.concat(F.lit("Review "), "relationship", F.lit(" from "), "from_node_name", F.lit(" to "), "to_node_name", F.lit(".")))
    one = F.concat("from_node_name", F.lit(" > "), "to_node_name", F.lit(": "), one)
    two = F.when(F.coalesce("cve", F.lit("")) != "", F.concat(F.lit("Patch "), "cve", F.lit(" (CVSS "), _fixed(F.coalesce("cvss", F.lit(0.0))), F.lit(").")))
    three = rules.lookup(type_fixes, F.col("to_node_type"), F.lit(None).cast("string"))
    lines = F.posexplode(F.array(one, two, three)).alias("part", "text")
    return hops.select("graph_id", "source", "sink", "hop", lines).where("text is not null").withColumn("part", F.col("part") + 1)


def critical_remediation(graph: Graph, critical: DataFrame, type_fixes: dict[str, str] = rules.TYPE_FIXES) -> DataFrame:
    """Lines for each critical node: part 1 with its counts, 2 for its type if known, 3 what to do first; one line for graphs without any."""
    rows = critical.join(graph.nodes.select("graph_id", "id", "type"), ["graph_id", "id"])
    one = F.concat(F.lit("Harden "), "type", F.lit(" "), "name", F.lit(": "), F.col("eliminated").cast("string"), F.lit(" of "), F.col("baseline").cast("string"), F.lit(" paths run through it."))
    two = rules.lookup(type_fixes, F.col("type"), F.lit(None).cast("string"))
    first = F.when(F.col("type").isin("rolebinding", "clusterrolebinding"), "delete the binding").when(F.col("type") == "serviceaccount", "restrict the account").when(F.col("type").isin("role", "clusterrole"), "scope down the role")
    three = F.concat(F.lit("First, "), first, F.lit(" "), "name", F.lit("."))
    lines = rows.select("graph_id", "rank", F.posexplode(F.array(one, two, three)).alias("part", "text")).where("text is not null").withColumn("part", F.col("part") + 1)
    none = graph.nodes.select("graph_id").distinct().join(critical, "graph_id", "left_anti")
    return lines.unionByName(none.select("graph_id", F.lit(0).alias("rank"), F.lit(0).alias("part"), F.lit("No single node breaks a path.").alias("text")))


def cycle_remediation(graph: Graph, found: DataFrame, fixes: dict[str, str] = rules.FIXES) -> DataFrame:
    """A row for each cycle: the ring of names, the edge to break, and the fix for its relationship; and one for each graph, without a ring, that says how many cycles there are."""
    if "top" in found.columns:  # detailed cycles have both
        edges = found.where("top is not null").select("graph_id", "cycle_names", "top.source", "top.target", "top.relationship")
    else:
        edges = break_edges(graph, found).join(with_cycle_names(graph, found.select("graph_id", "cycle")), ["graph_id", "cycle"])
    ring = F.concat(F.array_join("cycle_names", " > "), F.lit(" > "), F.element_at("cycle_names", 1))
    rows = edges.select("graph_id", ring.alias("ring"), F.concat("source", F.lit(" > "), "target").alias("break_edge"), rules.lookup(fixes, F.col("relationship"), F.concat(F.lit("Review "), "relationship", F.lit("."))).alias("text"))
    counts = graph.nodes.select("graph_id").distinct().join(found.groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id", "left")
    head = F.when(F.col("n").isNull(), "There is no cycle.").otherwise(F.concat(F.lit("Cycles to break: "), F.col("n").cast("string"), F.lit(".")))
    return rows.unionByName(counts.select("graph_id", F.lit(None).cast("string").alias("ring"), F.lit(None).cast("string").alias("break_edge"), head.alias("text")))


def path_explanation(graph: Graph, classes: DataFrame, verbs: dict[str, str] = rules.VERBS, nouns: dict[str, str] = rules.NOUNS) -> DataFrame:
    """Lines of each path: step 0 opens with its ends, length, severity and classes, then one for each hop (with its CVE, and its cvss if that is not zero), the last one closes with the total risk."""
    called = lambda end: _called(F.col(f"{end}_type"), F.col(f"{end}_name"), nouns)
    verb = rules.lookup(verbs, F.col("relationship"), F.concat(F.lit("leads by "), "relationship", F.lit(" to")))
    sentence = F.concat(F.lit("The "), called("from_node"), F.lit(" "), verb, F.lit(" the "), called("to_node"), F.lit("."))
    score = F.when(F.coalesce("cvss", F.lit(0.0)) != 0, F.concat(F.lit(" (CVSS "), _fixed(F.col("cvss")), F.lit(")"))).otherwise("")
    flaw = F.when(F.coalesce("cve", F.lit("")) != "", F.concat(F.lit(" It uses "), "cve", score, F.lit("."))).otherwise("")
    steps = _named_hops(graph, classes).select("graph_id", "source", "sink", F.col("hop").alias("step"), F.concat(sentence, flaw).alias("text"))
    first = _called(F.element_at("types", 1), F.element_at("path_names", 1), nouns)
    last = _called(F.element_at("types", -1), F.element_at("path_names", -1), nouns)
    opening = F.concat(F.lit("Whoever takes over the "), first, F.lit(" gets to the "), last, F.lit(", hops: "), F.col("hop_count").cast("string"), F.lit(". Severity "), "severity", F.lit("; "), F.array_join("categories", ", "), F.lit("."))
    closing = F.concat(F.lit("The risk adds up to "), _fixed(F.col("total_risk"), "0.00"), F.lit(", and the "), last, F.lit(" is lost."))
    line = lambda step, text: classes.select("graph_id", "source", "sink", step.cast("int").alias("step"), text.alias("text"))
    return line(F.lit(0), opening).unionByName(steps).unionByName(line(F.col("hop_count") + 1, closing))


def critical_explanation(graph: Graph, critical: DataFrame, nouns: dict[str, str] = rules.NOUNS) -> DataFrame:
    """One line a graph: the most critical node with its share of the paths, and the others by rank with theirs."""
    rows = critical.join(graph.nodes.select("graph_id", "id", "type"), ["graph_id", "id"])
    count = lambda c: F.col(c).cast("string")
    top = F.concat(F.lit("The "), _called(F.col("type"), F.col("name"), nouns), F.lit(" lies on "), count("eliminated"), F.lit(" of "), count("baseline"), F.lit(" paths ("), _fixed(F.col("percent")), F.lit("%)."))
    others = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", F.concat("name", F.lit(" ("), count("eliminated"), F.lit(")")).alias("text"))))), lambda x: x["text"]), ", ")
    found = rows.groupBy("graph_id").agg(F.max(F.when(F.col("rank") == 1, top)).alias("top"), others.alias("others"))
    out = graph.nodes.select("graph_id").distinct().join(found, "graph_id", "left")
    return out.select("graph_id", F.coalesce("top", F.lit("No single node stands out.")).alias("top"), F.coalesce("others", F.lit("")).alias("others"))
