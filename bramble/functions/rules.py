"""Lookup tables. All can be replaced by the caller's own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Default weight of an edge by relationship.
WEIGHTS = {
    "runs_as": 2.0,
    "binds_to": 3.0,
    "grants": 4.0,
    "accesses": 5.0,
    "mounts": 3.5,
    "exposes": 2.5,
    "connects_to": 2.0,
    "uses": 3.0,
    "escalates_to": 6.0,
    "has_secret": 4.5,
    "reads": 3.0,
    "writes": 4.0,
}
# Default risk of a node by type.
RISKS = {
    "pod": 3.0,
    "service": 2.0,
    "serviceaccount": 4.0,
    "role": 3.5,
    "clusterrole": 5.0,
    "rolebinding": 3.0,
    "clusterrolebinding": 5.5,
    "secret": 7.0,
    "configmap": 2.5,
    "namespace": 1.0,
    "database": 8.0,
    "node": 6.0,
    "ingress": 3.0,
}
# Relationships and node types that tell a path's class; names match exactly.
ESCALATION = (["escalates_to", "grants", "binds_to"], ["clusterrole", "role", "clusterrolebinding", "rolebinding"])
LATERAL = ["connects_to", "exposes", "uses"]
CREDENTIAL = ["mounts", "accesses", "has_secret", "reads"]
EXFILTRATION = ["database", "secret"]

#: What to do about a relationship, by its name.
FIXES = {
    "runs_as": "Give the workload an account of its own with only the rights that it needs.",
    "binds_to": "Take the subject out of the binding, or bind it to a narrower role.",
    "grants": "Drop the granted rights that no workload uses.",
    "escalates_to": "Forbid the verbs escalate, bind and impersonate here.",
    "mounts": "Mount the secret only where it is read, and read-only.",
    "accesses": "Restrict reading to named resources.",
    "reads": "Restrict reading to named resources.",
    "has_secret": "Move the credential to a vault and rotate it.",
    "uses": "Issue a dedicated, short-lived credential.",
    "connects_to": "Allow this connection only by a network policy.",
    "exposes": "Put the endpoint behind an authenticated ingress.",
    "writes": "Restrict writing to named resources, and check what is written on admission.",
}
#: What to do about a resource at the end of a hop, by its type.
TYPE_FIXES = {
    "pod": "Run the pod as non-root, without privileges and host namespaces.",
    "service": "Keep the service inside the cluster.",
    "serviceaccount": "Turn off automatic mounting of the account's token.",
    "role": "Scope the role down to single resources and verbs.",
    "clusterrole": "Replace the cluster-wide role by namespaced ones.",
    "rolebinding": "Delete the binding if nothing needs it.",
    "clusterrolebinding": "Delete the cluster-wide binding if nothing needs it.",
    "secret": "Encrypt the secret at rest and rotate it.",
    "configmap": "Keep credentials out of the config map.",
}
#: Verbs of the steps of an explained path, by relationship.
VERBS = {
    "runs_as": "runs as",
    "binds_to": "is a subject of",
    "grants": "gives the rights of",
    "escalates_to": "can turn into",
    "mounts": "mounts",
    "accesses": "gets into",
    "reads": "may read",
    "has_secret": "holds",
    "uses": "makes use of",
    "connects_to": "talks to",
    "exposes": "opens the way to",
    "writes": "may change",
}
#: What a node is called in an explanation, by its type; other types go by their own name.
NOUNS = {
    "pod": "pod",
    "service": "service",
    "serviceaccount": "service account",
    "role": "role",
    "clusterrole": "cluster role",
    "rolebinding": "role binding",
    "clusterrolebinding": "cluster role binding",
    "secret": "secret",
    "configmap": "config map",
    "database": "database",
    "node": "machine",
    "ingress": "ingress",
}


def lookup(table: dict, value: Column, default: Column) -> Column:
    """The table's entry for a value; the tables are small, so this is an expression, not a join."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, value), default)
