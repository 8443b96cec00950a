"""Severity, classes and scores of paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bramble.functions import rules


def severity(total_risk: Column) -> Column:
    """Above 20 CRITICAL, above 10 HIGH, above 5 MEDIUM, else LOW."""
    return F.when(total_risk > 20, "CRITICAL").when(total_risk > 10, "HIGH").when(total_risk > 5, "MEDIUM").otherwise("LOW")


def classify(relationships: Column, types: Column, last_is_sink: Column) -> Column:
    """The sorted classes of a path, by its hops' relationships and all its nodes' types."""
    has = lambda values, column: F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])), F.lit(False))
    pods = F.size(F.filter(types, lambda t: t == "pod"))
    found = F.array_compact(
        F.array(
            F.when(has(rules.CREDENTIAL, relationships) & F.array_contains(types, "secret"), "Credential Theft"),
            F.when(F.element_at(types, -1).isin(rules.EXFILTRATION) & last_is_sink, "Data Exfiltration"),
            F.when(has(rules.LATERAL, relationships) & (pods >= 2), "Lateral Movement"),
            F.when(has(rules.ESCALATION[0], relationships) & has(rules.ESCALATION[1], types), "Privilege Escalation"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("General Access"))).otherwise(found)


def advanced_score(total_risk: Column, hops: Column, cvss: Column) -> Column:
    """0.6 of the risk, 0.2 of the hops, 0.2 of the greatest known cvss."""
    return 0.6 * total_risk + 0.2 * hops + 0.2 * F.coalesce(F.array_max(cvss), F.lit(0.0))
