"""Findings about roles and bindings: joins of typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bramble.operators.graph import Graph

BINDINGS, ROLES = ["rolebinding", "clusterrolebinding"], ["role", "clusterrole"]


def _typed(graph: Graph, end: str, kinds: list[str]) -> DataFrame:
    nodes = graph.nodes.where(F.col("type").isin(kinds)).select("graph_id", F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("risk_score").alias(f"{end}_risk"), F.col("node_seq").alias(f"{end}_seq"))
    return nodes


def cluster_admin(graph: Graph) -> DataFrame:
    """A HIGH finding for each binding of a cluster role whose name has `admin`, with all that points at the binding (perhaps nothing)."""
    edges = graph.edges.select("graph_id", "source", "target", "edge_seq")
    role = _typed(graph, "target", ["clusterrole"]).where(F.lower("target_name").contains("admin"))
    bound = edges.join(role, ["graph_id", "target"]).join(_typed(graph, "source", BINDINGS), ["graph_id", "source"]).select("graph_id", F.col("target").alias("role"), F.col("source").alias("binding"))
    into = edges.select("graph_id", F.col("target").alias("binding"), F.col("source").alias("subject"), F.col("edge_seq").alias("at"))
    found = bound.join(into, ["graph_id", "binding"], "left").groupBy("graph_id", "role", "binding").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("subject").isNotNull(), F.struct("at", "subject")))), lambda x: x["subject"]).alias("subjects"))
    return found.select("graph_id", F.lit("HIGH").alias("severity"), F.lit("cluster-admin").alias("category"), F.concat(F.array("role", "binding"), "subjects").alias("affected_nodes"))


def wildcard_roles(graph: Graph, risk: float = 5.0, targets: int = 2) -> DataFrame:
    """A MEDIUM finding for each role of enough risk with enough targets."""
    found = graph.edges.join(_typed(graph, "source", ROLES).where(F.col("source_risk") >= risk), ["graph_id", "source"])
    found = found.groupBy("graph_id", "source").agg(F.transform(F.sort_array(F.collect_list(F.struct("edge_seq", "target"))), lambda x: x["target"]).alias("targets")).where(F.size("targets") >= targets)
    return found.select("graph_id", F.lit("MEDIUM").alias("severity"), F.lit("wildcard-role").alias("category"), F.concat(F.array("source"), "targets").alias("affected_nodes"))


def escalation_chains(graph: Graph) -> DataFrame:
    """A HIGH finding for each service account -> binding -> cluster role."""
    edges = graph.edges.select("graph_id", "source", "target")
    up = edges.join(_typed(graph, "source", ["serviceaccount"]).select("graph_id", "source"), ["graph_id", "source"]).join(_typed(graph, "target", BINDINGS).select("graph_id", "target"), ["graph_id", "target"]).select("graph_id", F.col("source").alias("account"), F.col("target").alias("binding"))
    down = edges.join(_typed(graph, "target", ["clusterrole"]).select("graph_id", "target"), ["graph_id", "target"]).select("graph_id", F.col("source").alias("binding"), F.col("target").alias("role"))
    found = up.join(down, ["graph_id", "binding"])
    return found.select("graph_id", F.lit("HIGH").alias("severity"), F.lit("escalation-chain").alias("category"), F.array("account", "binding", "role").alias("affected_nodes"))


def default_accounts(graph: Graph) -> DataFrame:
    """A LOW finding for each pod that uses a service account named `default`."""
    found = graph.edges.join(_typed(graph, "target", ["serviceaccount"]).where("target_name = 'default'"), ["graph_id", "target"]).join(_typed(graph, "source", ["pod"]).select("graph_id", "source"), ["graph_id", "source"])
    return found.select("graph_id", F.lit("LOW").alias("severity"), F.lit("default-account").alias("category"), F.array("source", "target").alias("affected_nodes"))


def rbac_findings(graph: Graph) -> DataFrame:
    return cluster_admin(graph).unionByName(wildcard_roles(graph)).unionByName(escalation_chains(graph)).unionByName(default_accounts(graph))


def rbac_totals(graph: Graph) -> DataFrame:
    return rbac_findings(graph).groupBy("graph_id", "severity").agg(F.count("*").alias("findings"))
