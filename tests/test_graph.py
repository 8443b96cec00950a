from __future__ import annotations

import itertools
import json
import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bramble.functions import rules
from bramble.functions.scoring import severity
from bramble.operators import advise, assess, bundles, diff, graph as g, rbac, traverse as t
from bramble.sources import graph_json, k8s

UNIT_NODES = [("A", "pod", "entry-pod", 3.0, 1, 0), ("B", "serviceaccount", "test-sa", 4.0, 0, 0), ("C", "role", "test-role", 5.0, 0, 0), ("D", "secret", "target-secret", 8.0, 0, 1), ("E", "rolebinding", "test-binding", 3.5, 0, 0), ("F", "service", "external-svc", 2.0, 1, 0), ("G", "serviceaccount", "svc-sa", 4.0, 0, 0)]
UNIT_EDGES = [("A", "B", "runs_as", 2.0), ("B", "C", "binds_to", 3.0), ("C", "D", "accesses", 5.0), ("B", "E", "binds_to", 2.5), ("E", "D", "grants", 4.0), ("F", "G", "exposes", 2.0), ("G", "D", "accesses", 6.0), ("C", "B", "escalates_to", 3.0, "CVE-TEST-001", 7.5)]


SUMMARY = {
    "total_nodes": 7, "total_edges": 8, "node_types": {"pod": 1, "role": 1, "rolebinding": 1, "secret": 1, "service": 1, "serviceaccount": 2}, "source_nodes": 2, "sink_nodes": 1, "is_dag": False, "weakly_connected_components": 1,
    "relationship_types": {"accesses": 2, "binds_to": 2, "escalates_to": 1, "exposes": 1, "grants": 1, "runs_as": 1},
}


def make(spark, nodes, edges, graph_id="u"):
    n = [(graph_id, i, x[0], x[1], x[2], "test", float(x[3]), bool(x[4]), bool(x[5]), []) for i, x in enumerate(nodes)]
    e = [(graph_id, i, x[0], x[1], x[2], float(x[3]), *(x[4:] or (None, None))) for i, x in enumerate(edges)]
    return g.Graph(spark.createDataFrame(n, g.NODES), spark.createDataFrame(e, g.EDGES))


@pytest.fixture(scope="module")
def unit(spark):
    return g.kept(g.build(make(spark, UNIT_NODES, UNIT_EDGES)))


@pytest.fixture(scope="module")
def unit_paths(unit):
    return g.cut_lineage(t.attack_paths(unit))


@pytest.fixture(scope="module")
def unit_simple(unit):
    return g.cut_lineage(t.simple_paths(unit))


def test_unit_counts(unit):
    assert tuple(g.counts(unit).first()) == ("u", 7, 8, 2, 1)
    assert not t.is_dag(unit).first().is_dag
    assert t.weak_components(unit).first().components == 1


def test_unit_blast(spark, unit):
    rows = t.blast_radius(unit, spark.createDataFrame([("u", "A")], "graph_id string, id string")).collect()
    assert {(r.hop, r.node) for r in rows} == {(1, "B"), (2, "C"), (2, "E"), (3, "D")}
    with pytest.raises(ValueError):
        t.blast_radius(unit, spark.createDataFrame([("u", "nobody")], "graph_id string, id string"))


def test_unit_paths(unit, unit_paths):
    got = {(r.source, r.sink): (r.path_nodes, r.total_risk, r.severity) for r in unit_paths.collect()}
    assert got == {("A", "D"): (["A", "B", "E", "D"], 8.5, "MEDIUM"), ("F", "D"): (["F", "G", "D"], 8.0, "MEDIUM")}
    assert [r.path_nodes[0] for r in t.ranked(unit_paths).orderBy("rank").collect()] == ["F", "A"]
    classes = {r.source: (r.categories, round(r.score, 6)) for r in assess.classified(unit, unit_paths).collect()}
    assert classes == {"A": (["Data Exfiltration", "Privilege Escalation"], 5.7), "F": (["Credential Theft", "Data Exfiltration"], 5.2)}
    assert assess.highest_risk(unit_paths).first().source == "A"


def test_unit_shortest(spark, unit):
    pair = lambda *p: spark.createDataFrame([("u", *p)], "graph_id string, source string, target string")
    assert t.shortest_path(unit, pair("D", "A")).count() == 0
    same = t.shortest_path(unit, pair("B", "B")).first()
    assert (same.hop_count, same.total_risk, same.severity) == (0, 0.0, "LOW")
    with pytest.raises(ValueError):
        t.shortest_path(unit, pair("A", "nobody"))


def test_unit_cycles(unit):
    found = t.cycles(unit)
    assert [(r.cycle, r.risk) for r in found.collect()] == [(["B", "C"], 6.0)]
    edge = t.break_edges(unit, found).first()
    assert (edge.source, edge.target) == ("B", "C")


def test_unit_chokepoints(unit, unit_simple):
    assert unit_simple.count() == 3
    got = {r.id: r.eliminated for r in t.critical_nodes(unit, unit_simple).collect()}
    assert got == {"B": 2, "C": 1, "E": 1, "G": 1}
    risk = {r.node_id: round(r.amplified_risk, 4) for r in t.node_risk(unit, unit_simple).collect()}
    assert risk == {"D": 24.0, "B": 10.3399, "C": 10.0, "G": 8.0, "A": 7.7549, "E": 7.0, "F": 4.0}


def test_unit_findings(unit):
    rows = rbac.rbac_findings(unit).collect()
    assert [(r.severity, r.affected_nodes) for r in rows] == [("MEDIUM", ["C", "D", "B"])]


def test_unit_advice(unit, unit_paths, unit_simple):
    fixes = advise.path_remediation(unit, unit_paths).where("source = 'A'").collect()
    assert {(r.hop, r.part) for r in fixes} == {(1, 1), (1, 3), (2, 1), (2, 3), (3, 1), (3, 3)}
    lines = advise.path_explanation(unit, assess.classified(unit, unit_paths)).where("source = 'F'").orderBy("step").collect()
    assert [r.text for r in lines] == [
        "Whoever takes over the service 'external-svc' gets to the secret 'target-secret', hops: 2. Severity MEDIUM; Credential Theft, Data Exfiltration.",
        "The service 'external-svc' opens the way to the service account 'svc-sa'.",
        "The service account 'svc-sa' gets into the secret 'target-secret'.",
        "The risk adds up to 8.00, and the secret 'target-secret' is lost.",
    ]
    critical = t.critical_nodes(unit, unit_simple)
    said = advise.critical_explanation(unit, critical).first()
    assert said.top == "The service account 'test-sa' lies on 2 of 3 paths (66.7%)." and said.others == "test-role (1), test-binding (1), svc-sa (1)"
    assert advise.critical_explanation(unit, critical.limit(0)).first().top == "No single node stands out."
    hardened = advise.critical_remediation(unit, critical).where("rank = 1").orderBy("part").collect()
    assert [r.text for r in hardened] == ["Harden serviceaccount test-sa: 2 of 3 paths run through it.", rules.TYPE_FIXES["serviceaccount"], "First, restrict the account test-sa."]
    rings = t.cycles(unit)
    assert {(r.ring, r.break_edge, r.text) for r in advise.cycle_remediation(unit, rings).collect()} == {("test-sa > test-role > test-sa", "B > C", rules.FIXES["binds_to"]), (None, None, "Cycles to break: 1.")}


def test_rule_keys():
    """The tables have the keys that their values must match."""
    assert set(rules.FIXES) == set(rules.VERBS) == set(rules.WEIGHTS)
    assert set(rules.TYPE_FIXES) == {"serviceaccount", "role", "clusterrole", "rolebinding", "clusterrolebinding", "secret", "pod", "service", "configmap"}
    assert set(rules.NOUNS) == set(rules.RISKS) - {"namespace"}


def test_flaws_and_names(spark):
    """CVEs with and without a score, unknown relationships and types, and names as they are written."""
    graph = g.kept(g.build(make(spark, [("a", "pod", "WebFront-7", 1, 1, 0), ("b", "Robot", "R2", 1, 0, 0), ("c", "configmap", "Map", 1, 0, 1)], [("a", "b", "befriends", 1, "CVE-1", None), ("b", "c", "writes", 1, "CVE-2", 9.85)])))
    paths = t.attack_paths(graph)
    lines = advise.path_explanation(graph, assess.classified(graph, paths)).orderBy("step").collect()
    assert lines[1].text == "The pod 'WebFront-7' leads by befriends to the robot 'R2'. It uses CVE-1."
    assert lines[2].text == "The robot 'R2' may change the config map 'Map'. It uses CVE-2 (CVSS 9.8)."
    fixes = {(r.hop, r.part): r.text for r in advise.path_remediation(graph, paths).collect()}
    assert fixes == {(1, 1): "WebFront-7 > R2: Review befriends from WebFront-7 to R2.", (1, 2): "Patch CVE-1 (CVSS 0.0).", (2, 1): f"R2 > Map: {rules.FIXES['writes']}", (2, 2): "Patch CVE-2 (CVSS 9.8).", (2, 3): rules.TYPE_FIXES["configmap"]}


def test_report_document(unit, unit_paths, unit_simple):
    rings, critical = t.cycles(unit), t.critical_nodes(unit, unit_simple)
    fixes = advise.path_remediation(unit, unit_paths)
    doc = json.loads(bundles.report_bundle(unit, unit_paths, t.blast_radius(unit), rings, critical, t.path_counts(unit_simple), fixes, advise.critical_remediation(unit, critical), advise.cycle_remediation(unit, rings), "now").first().document)
    assert list(doc) == ["metadata", "graph_summary", "attack_paths", "blast_radius", "cycles", "critical_nodes", "remediation"]
    assert doc["metadata"] == {"generated_at": "now", "graph_id": "u"}
    assert doc["graph_summary"] == SUMMARY
    assert doc["attack_paths"][1] == {"path_nodes": ["A", "B", "E", "D"], "path_names": ["entry-pod", "test-sa", "test-binding", "target-secret"], "relationships": ["runs_as", "binds_to", "grants"], "cves": [None] * 3, "cvss_scores": [None] * 3, "hop_count": 3, "total_risk": 8.5, "severity": "MEDIUM"}
    assert doc["blast_radius"] == [{"source": "A", "max_depth": 3, "layers": {"1": ["B"], "2": ["C", "E"], "3": ["D"]}, "total_affected": 4}, {"source": "F", "max_depth": 3, "layers": {"1": ["G"], "2": ["D"]}, "total_affected": 2}]
    assert doc["cycles"] == {"cycles": [["B", "C"]], "cycle_names": [["test-sa", "test-role"]], "total_cycles": 1}
    assert doc["critical_nodes"]["total_paths_baseline"] == 3 and doc["critical_nodes"]["top_nodes"][0] == {"id": "B", "name": "test-sa", "paths_eliminated": 2}
    remediation = doc["remediation"]
    assert [(x["path_index"], len(x["fixes"])) for x in remediation["path_fixes"]] == [(0, 4), (1, 6)]
    assert len(remediation["critical_node_fixes"]) == 12 and remediation["cycle_fixes"] == ["Cycles to break: 1.", f"test-sa > test-role > test-sa | cut B > C | {rules.FIXES['binds_to']}"]


def test_display_document(unit, unit_paths, unit_simple):
    doc = json.loads(bundles.display_bundle(unit, assess.classified(unit, unit_paths), t.blast_radius(unit), t.cycles(unit), t.critical_nodes(unit, unit_simple), t.path_counts(unit_simple), "now").first().document)
    assert list(doc) == ["metadata", "graph_summary", "nodes", "edges", "attack_paths", "cycles", "critical_node", "blast_radius"]
    assert doc["graph_summary"] == SUMMARY
    assert doc["nodes"][3] == {"id": "D", "name": "target-secret", "type": "secret", "namespace": "test", "risk_score": 8.0, "is_source": False, "is_sink": True, "cves": []}
    assert doc["edges"][-1] == {"source": "C", "target": "B", "relationship": "escalates_to", "weight": 3.0, "cve": "CVE-TEST-001", "cvss": 7.5} and doc["edges"][0]["cve"] is None
    assert [(x["path_names"][0], x["advanced_score"], x["categories"]) for x in doc["attack_paths"]] == [("external-svc", 5.2, ["Credential Theft", "Data Exfiltration"]), ("entry-pod", 5.7, ["Data Exfiltration", "Privilege Escalation"])]
    assert doc["cycles"] == [{"node_ids": ["B", "C"], "node_names": ["test-sa", "test-role"]}]
    assert doc["critical_node"]["baseline_paths"] == 3 and [x["id"] for x in doc["critical_node"]["top_nodes"]] == ["B", "C", "E", "G"]
    assert doc["blast_radius"][1] == {"source": "F", "source_name": "external-svc", "max_depth": 3, "total_affected": 2, "layers": {"1": ["G"], "2": ["D"]}}


def test_bare_documents(spark):
    """A graph without edges, sources and sinks has whole documents too."""
    graph = g.kept(g.build(make(spark, [("a", "pod", "a", 1, 0, 0)], [("a", "z", "uses", 1)])))
    simple, none = t.simple_paths(graph), t.attack_paths(graph)
    doc = json.loads(bundles.report_bundle(graph, none, t.blast_radius(graph), t.cycles(graph), t.critical_nodes(graph, simple), t.path_counts(simple), advise.path_remediation(graph, none), advise.critical_remediation(graph, t.critical_nodes(graph, simple)), advise.cycle_remediation(graph, t.cycles(graph)), "now").first().document)
    assert doc["attack_paths"] == doc["blast_radius"] == doc["remediation"]["path_fixes"] == [] and doc["graph_summary"]["is_dag"] is True
    assert doc["cycles"] == {"cycles": [], "cycle_names": [], "total_cycles": 0} and doc["critical_nodes"] == {"top_nodes": [], "total_paths_baseline": 0}
    assert doc["remediation"]["critical_node_fixes"] == ["No single node breaks a path."] and doc["remediation"]["cycle_fixes"] == ["There is no cycle."]


def _joined(parts) -> dict:
    rows = sorted(parts.collect(), key=lambda r: (r.graph_id, r.section, r.place))
    assert len({r[:3] for r in rows}) == len(rows)
    return {k: json.loads("".join(r.text for r in rows if r.graph_id == k)) for k in {r.graph_id for r in rows}}


def test_bundle_parts(spark, unit):
    """Report and display in parts are the documents of one row; a graph without edges has its brackets, and text that JSON escapes stays whole."""
    bare = make(spark, [("a", "pod", "a", 1, 1, 0)], [], "bare")
    odd = make(spark, [('q"\\', "pod", "", 1, 1, 0), ("\n", "secret", "t", 1, 0, 1)], [('q"\\', "\n", "uses", 1, "CVE-1", 9.8)], "odd")
    graph = g.kept(g.build(g.Graph(_union([unit.nodes, bare.nodes, odd.nodes]), _union([unit.edges, bare.edges, odd.edges]))))
    simple, paths, rings = g.stored(t.simple_paths(graph)), g.stored(t.attack_paths(graph)), g.stored(t.cycles(graph))
    critical, blast, counts = g.stored(t.critical_nodes(graph, simple)), g.stored(t.blast_radius(graph)), t.path_counts(simple)
    report = graph, paths, blast, rings, critical, counts, advise.path_remediation(graph, paths), advise.critical_remediation(graph, critical), advise.cycle_remediation(graph, rings), "now"
    whole = {r.graph_id: json.loads(r.document) for r in bundles.report_bundle(*report).collect()}
    assert set(whole) == {"u", "bare", "odd"} and _joined(bundles.report_parts(*report)) == whole
    display = graph, assess.classified(graph, paths), blast, rings, critical, counts, "now"
    whole = {r.graph_id: json.loads(r.document) for r in bundles.display_bundle(*display).collect()}
    assert _joined(bundles.display_parts(*display)) == whole


def test_wide_blast_parts(spark):
    """A source that reaches 3,000 nodes in one hop: each stands in a row of its own."""
    graph = g.kept(g.build(make(spark, [("s", "pod", "s", 1, 1, 0), *[(f"n{i}", "pod", "n", 1, 0, 0) for i in range(3000)]], [("s", f"n{i}", "uses", 1) for i in range(3000)])))
    lines = bundles._blast_lines(graph, g.stored(t.blast_radius(graph)), 3, named=True).orderBy("place").collect()
    assert len(lines) == 3004 and max(len(r.text) for r in lines) < 120
    assert json.loads("".join(r.text for r in lines)) == {"source": "s", "source_name": "s", "max_depth": 3, "total_affected": 3000, "layers": {"1": sorted(f"n{i}" for i in range(3000))}}


def test_names_of_files(spark, tmp_path):
    for folder in ("east", "west"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "graph.json").write_text(json.dumps({"nodes": [{"id": folder, "type": "pod", "name": "x", "namespace": "n", "risk_score": 1}]}))
    files = [str(tmp_path / f / "graph.json") for f in ("east", "west")]
    with pytest.raises(ValueError, match="several files"):
        graph_json.read_graphs(spark, files)
    got = graph_json.read_graphs(spark, files, root=str(tmp_path)).nodes.collect()
    assert {(r.graph_id, r.id) for r in got} == {("east/graph", "east"), ("west/graph", "west")}


def test_write_result(unit_paths, spark, tmp_path):
    for form in ("parquet", "json"):
        graph_json.write_result(unit_paths, f"{tmp_path}/{form}", form)
        again = spark.read.format(form).load(f"{tmp_path}/{form}").collect()
        assert sorted((r.graph_id, r.source, r.total_risk) for r in again) == [("u", "A", 8.5), ("u", "F", 8.0)]


def test_own_tables(spark):
    """A caller's own weights and risks take the place of the defaults."""
    item = spark.createDataFrame([("c", 0)], "graph_id string, seq long")
    parse = lambda kind, text: item.withColumn("item", F.from_json(F.lit(text), f"struct<{k8s.ITEMS[kind].replace('metadata struct', 'metadata: struct').replace('spec struct', 'spec: struct').replace('roleRef struct', 'roleRef: struct').replace('subjects array', 'subjects: array')}>"))
    dumps = {k: parse(k, "{}").where("false") for k in k8s.ITEMS} | {"pods": parse("pods", '{"metadata": {"name": "p"}, "spec": {"serviceAccountName": "s"}}')}
    raw = k8s.assemble(dumps, weights=rules.WEIGHTS | {"runs_as": 9.0}, risks=rules.RISKS | {"pod": 1.5, "serviceaccount": 2.5})
    assert {(r.id, r.risk_score) for r in raw.nodes.collect()} == {("pod:default/p", 1.5), ("serviceaccount:default/s", 2.5)}
    assert raw.edges.first().weight == 9.0


def test_collapse_order(spark):
    raw = make(spark, [("a", "pod", "a", 1, 1, 0), ("b", "pod", "b", 1, 0, 1), ("a", "secret", "a2", 2, 0, 0)], [("a", "b", "A", 1), ("a", "b", "B", 2), ("a", "b", "A", 3), ("a", "x", "A", 1), ("b", "b", "A", 4)])
    built = g.build(raw)
    assert [(r.source, r.relationship, r.weight, r.edge_seq) for r in built.edges.orderBy("edge_seq").collect()] == [("a", "B", 2.0, 0), ("b", "A", 4.0, 4)]
    node = built.nodes.where("id = 'a'").first()
    assert (node.type, node.name, node.node_seq) == ("secret", "a2", 0)
    assert g.dangling_edges(raw.edges, raw.nodes).count() == 1
    assert g.build(raw, collapsed=False).edges.count() == 3


def test_chain_cutoff(spark):
    for n, found in ((15, 1), (16, 0)):
        nodes = [(f"n{i:02}", "pod", "x", 1, i == 0, i == n) for i in range(n + 1)]
        graph = g.build(make(spark, nodes, [(f"n{i:02}", f"n{i + 1:02}", "uses", 1) for i in range(n)]))
        assert t.simple_paths(graph).count() == found


def test_trivial_and_through_sinks(spark):
    graph = g.build(make(spark, [("a", "pod", "a", 1, 1, 1), ("b", "pod", "b", 1, 0, 1), ("c", "pod", "c", 1, 0, 1)], [("a", "b", "uses", 1), ("b", "c", "uses", 1)]))
    assert {tuple(r.path_nodes) for r in t.simple_paths(graph).collect()} == {("a",), ("a", "b"), ("a", "b", "c")}
    assert t.simple_paths(graph, include_trivial=False).count() == 2
    assert {r.sink: r.total_risk for r in t.attack_paths(graph).collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_empty_and_bad(spark):
    graph = g.build(make(spark, [("a", "pod", "a", 1, 0, 0)], []))
    assert t.attack_paths(graph).count() == 0 and t.cycles(graph).count() == 0 and t.is_dag(graph).first().is_dag
    assert t.critical_nodes(graph, t.simple_paths(graph)).count() == 0
    bad = g.build(make(spark, [("a", "pod", "a", 1, 1, 1)], [("a", "a", "uses", -1)]))
    with pytest.raises(ValueError):
        t.attack_paths(bad)


def test_ties(spark):
    graph = g.build(make(spark, [("s", "pod", "s", 1, 1, 0), ("x", "pod", "x", 1, 0, 0), ("y", "pod", "y", 1, 0, 0), ("z", "secret", "z", 1, 0, 1)], [("s", "y", "uses", 1), ("s", "x", "uses", 1), ("x", "z", "uses", 1), ("y", "z", "uses", 1)]))
    assert t.attack_paths(graph).first().path_nodes == ["s", "x", "z"]


def test_severity(spark):
    rows = spark.createDataFrame([(5.0,), (5.01,), (10.0,), (20.0,), (20.01,)], "x double").select(severity(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL"]


def test_resolve(spark, unit):
    ids = spark.createDataFrame([("u", x) for x in ("A", "TEST-SA", "a", "zzz")], "graph_id string, identifier string")
    nodes = unit.nodes.withColumn("id", F.when(F.col("id") == "A", "A").otherwise(F.concat(F.lit("node-"), F.col("id"))))
    got = {r.identifier: r.node for r in g.resolve(ids, nodes).collect()}
    assert got == {"A": "A", "TEST-SA": "node-B", "a": "A", "zzz": None}


def test_resolve_parts(spark):
    """Parts of ids of any length and case, against a plain search; only a part that one id has is found."""
    rng = random.Random(11)
    ids = {k: sorted({"".join(rng.choice("abÄ:x-") for _ in range(rng.randint(1, 9))) for _ in range(12)}) for k in ("g", "h", "one")}
    ids["one"] = ["Only"]
    nodes = [(k, n, x) for k, own in ids.items() for n, x in enumerate(own)]
    asked = {(k, "".join(rng.choice("abÄä:x-") for _ in range(rng.randint(0, 5)))) for k in ids for _ in range(60)} | {("one", "NL"), ("one", ""), ("g", ""), ("g", "absent")}
    table = spark.createDataFrame(nodes, "graph_id string, node_seq long, id string").withColumn("name", F.lit(None).cast("string"))
    got = {(r.graph_id, r.identifier): r.node for r in g.resolve(spark.createDataFrame(sorted(asked), "graph_id string, identifier string"), table).collect()}
    hits = lambda k, x: [x] if x in ids[k] else [i for i in ids[k] if x.lower() in i.lower()]
    assert got == {(k, x): h[0] if len(h := hits(k, x)) == 1 else None for k, x in asked}


def test_admin_chain(spark):
    graph = g.build(make(spark, [("sa", "serviceaccount", "default", 4, 0, 0), ("b", "clusterrolebinding", "b", 3, 0, 0), ("r", "clusterrole", "Cluster-Admin", 9, 0, 0), ("b2", "rolebinding", "b2", 3, 0, 0), ("p", "pod", "p", 3, 0, 0)], [("sa", "b", "binds_to", 1), ("b", "r", "grants", 1), ("b2", "r", "grants", 1), ("p", "sa", "runs_as", 1)]))
    got = sorted((r.severity, r.category, tuple(r.affected_nodes)) for r in rbac.rbac_findings(graph).collect())
    assert got == [("HIGH", "cluster-admin", ("r", "b", "sa")), ("HIGH", "cluster-admin", ("r", "b2")), ("HIGH", "escalation-chain", ("sa", "b", "r")), ("LOW", "default-account", ("p", "sa"))]


def test_diff(spark):
    old = make(spark, [("s", "pod", "s", 1, 1, 0), ("t", "secret", "t", 1, 0, 1)], [("s", "t", "uses", 1)], "old")
    new = make(spark, [("s", "pod", "s", 9, 1, 0), ("t", "secret", "t", 1, 0, 1), ("n", "pod", "n", 1, 0, 0)], [("s", "n", "uses", 1), ("n", "t", "mounts", 1)], "new")
    graph = g.kept(g.build(g.Graph(old.nodes.unionByName(new.nodes), old.edges.unionByName(new.edges))))
    pairs = diff.consecutive(spark.createDataFrame([("c", 1, "old"), ("c", 2, "new")], "cluster string, snapshot int, graph_id string"))
    assert [(r.change, r.id) for r in diff.node_diff(graph, pairs).collect()] == [("added", "n")]
    assert sorted((r.change, r.source, r.target) for r in diff.edge_diff(graph, pairs).collect()) == [("added", "n", "t"), ("added", "s", "n"), ("removed", "s", "t")]
    assert diff.path_diff(t.attack_paths(graph), pairs).count() == 0
    assert diff.first_edges(diff.edge_diff(graph, pairs), 1).count() == 2


def test_timeline(spark):
    """Keys that come, go and come back, over clusters of several lengths: a timeline gives what its pairs do."""
    rng, parts, snapshots = random.Random(2), [], []
    for c in range(4):
        for n in range(rng.randint(1, 6)):
            names = [f"n{i}" for i in range(5) if rng.random() < 0.6]
            parts.append(make(spark, [(x, rng.choice(("pod", "secret")), x, 1, 0, 0) for x in names], [(a, b, rng.choice(("uses", "mounts")), 1) for a in names for b in names if rng.random() < 0.4], f"c{c}/{n}"))
            snapshots.append((f"c{c}", n, f"c{c}/{n}"))
    graph = g.kept(g.build(g.Graph(_union([p.nodes for p in parts]), _union([p.edges for p in parts]))))
    seen = spark.createDataFrame(snapshots, "cluster string, snapshot int, graph_id string")
    for f in (diff.node_diff, diff.edge_diff):
        along, pairs = (sorted(map(tuple, f(graph, x).collect())) for x in (diff.timeline(seen), diff.consecutive(seen)))
        assert along == pairs and along


def _brute(nodes, edges):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    simple, rings = [], []

    def walk(path, cost):
        for b, w in out.get(path[-1], []):
            if b not in path:
                simple.append(([*path, b], cost + w))
                walk([*path, b], cost + w)

    def ring(path):
        for b, _ in out.get(path[-1], []):
            if b == path[0]:
                rings.append(tuple(path))
            elif b > path[0] and b not in path:
                ring([*path, b])

    for n in nodes:
        walk([n], 0.0)
        ring([n])
    return simple, rings


def test_random_graphs(spark):
    """All random graphs go through the operators together, each against a plain search."""
    rng, nodes, edges, want = random.Random(4), [], [], {}
    for k in range(6):
        names = [f"n{i}" for i in range(rng.randint(3, 6))]
        arcs = [(a, b, float(rng.randint(1, 9))) for a, b in itertools.product(names, names) if rng.random() < 0.35]
        sources, sinks = {n for n in names if rng.random() < 0.4}, {n for n in names if rng.random() < 0.4}
        made = make(spark, [(n, "pod", n, 1.0, n in sources, n in sinks) for n in names], [(a, b, "uses", w) for a, b, w in arcs], f"g{k}")
        nodes.append(made.nodes)
        edges.append(made.edges)
        simple, rings = _brute(names, arcs)
        paths = [p for p in simple if p[0][0] in sources and p[0][-1] in sinks] + [([n], 0.0) for n in sources & sinks]
        want[f"g{k}"] = (paths, rings)
    graph = g.kept(g.build(g.Graph(nodes[0], edges[0]) if not nodes[1:] else g.Graph(_union(nodes), _union(edges))))
    got_paths = t.simple_paths(graph).collect()
    cheapest = {(r.graph_id, r.source, r.sink): r.total_risk for r in t.attack_paths(graph).collect()}
    got_rings = t.cycles(graph).collect()
    dag = {r.graph_id: r.is_dag for r in t.is_dag(graph).collect()}
    for k, (paths, rings) in want.items():
        assert sorted(r.path_nodes for r in got_paths if r.graph_id == k) == sorted(p for p, _ in paths)
        assert sorted(tuple(r.cycle) for r in got_rings if r.graph_id == k) == sorted(rings)
        assert dag[k] == (not rings)
        for p, _ in paths:
            assert math.isclose(cheapest[k, p[0], p[-1]], min(c for q, c in paths if q[0] == p[0] and q[-1] == p[-1]))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_documents(spark, tmp_path):
    doc = {"metadata": {"x": 1}, "nodes": [{"id": "a", "type": "Pod", "name": "a", "namespace": "n", "risk_score": 3, "is_source": True}, {"id": "b", "type": "secret", "name": "b", "namespace": "n", "risk_score": 7.5}], "edges": [{"comment": "x"}, {"source": "a", "target": "b", "relationship": "mounts", "weight": 2}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    graph = graph_json.read_graphs(spark, str(tmp_path / "one.json"))
    assert [tuple(r)[:4] for r in graph.nodes.orderBy("node_seq").collect()] == [("one", 0, "a", "pod"), ("one", 1, "b", "secret")]
    assert [(r.graph_id, r.edge_seq, r.cve) for r in graph.edges.collect()] == [("one", 1, None)]
    graph_json.write_graphs(graph, str(tmp_path / "out"))
    again = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert again["nodes"][0]["is_source"] is True and again["edges"][0]["weight"] == 2.0
    del doc["nodes"][0]["namespace"]
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="namespace"):
        graph_json.read_graphs(spark, str(tmp_path / "bad.json")).nodes.collect()


def test_document_parts(spark, tmp_path):
    """A graph of many edges in rows of bounded size, over several files, beside small ones; joined they are the whole documents."""
    large = g.Graph(spark.range(1).selectExpr("'big' as graph_id", "id as node_seq", "'a' as id", "'pod' as type", "cast(null as string) as name", "'n' as namespace", "1.5D as risk_score", "true as is_source", "false as is_sink", "array('CVE-1') as cves"),
                    spark.range(30_000).selectExpr("'big' as graph_id", "29999 - id as edge_seq", "'a' as source", "concat('b', id) as target", "'uses' as relationship", "id / 2 as weight", "cast(null as string) as cve", "cast(null as double) as cvss"))
    small = make(spark, UNIT_NODES, UNIT_EDGES)
    bare = g.Graph(make(spark, UNIT_NODES[:1], [], "bare").nodes, small.edges)
    graph = g.stored(_union([large.nodes, small.nodes, bare.nodes])), g.stored(_union([large.edges, small.edges]))
    graph = g.Graph(*graph)
    parts = g.stored(graph_json.document_parts(graph))
    assert parts.agg(F.max(F.length("text"))).first()[0] < 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    graph_json.write_parts(graph, str(tmp_path / "parts"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r.graph_id: json.loads(r.document) for r in graph_json.documents(graph).collect()}
    for k, document in want.items():
        files = sorted((tmp_path / "parts" / f"graph_id={k}").glob("part-*"))
        assert json.loads("".join(f.read_text() for f in files)) == document
        assert k != "big" or len(files) > 1


def test_dumps(spark, tmp_path):
    root = {"securityContext": {"privileged": True, "runAsUser": 0}}
    lists = {
        "pods": [{"metadata": {"name": "p", "namespace": "x"}, "spec": {"hostNetwork": True, "containers": [root, root], "volumes": [{"secret": {"secretName": "s"}}, {"secret": {"secretName": "s"}}, {}]}}, {"metadata": {}, "spec": {"serviceAccountName": "sa"}}],
        "services": [{"metadata": {"name": "v"}, "spec": {"type": "NodePort"}}],
        "serviceaccounts": [{"metadata": {"name": "sa", "namespace": "default"}}],
        "secrets": [], "configmaps": [],
        "rolebindings": [{"metadata": {"namespace": "x"}, "roleRef": {"kind": "Role", "name": "r"}, "subjects": [{"kind": "User", "name": "u"}, {"kind": "ServiceAccount", "name": "sa"}, {"kind": "Robot", "name": "z"}]}],
        "clusterrolebindings": [{"metadata": {}, "roleRef": {"kind": "ClusterRole", "name": "admin"}}],
    }
    for kind, items in lists.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "c1.json").write_text(json.dumps({"items": items}))
    raw = k8s.assemble(k8s.read_dumps(spark, {k: str(tmp_path / k) for k in lists}))
    nodes = {r.id: (r.type, r.risk_score, r.is_source, r.is_sink) for r in raw.nodes.collect()}
    assert nodes == {
        "pod:x/p": ("pod", 10.0, True, False), "pod:default/unknown": ("pod", 3.0, False, False), "service:default/v": ("service", 4.0, True, False), "serviceaccount:default/sa": ("serviceaccount", 4.0, False, False),
        "role:x/r": ("role", 3.5, False, False), "clusterrole:cluster/admin": ("clusterrole", 5.0, False, False), "user:cluster/u": ("user", 3.0, False, False), "serviceaccount:x/sa": ("serviceaccount", 4.0, False, False),
        "serviceaccount:x/default": ("serviceaccount", 4.0, False, False), "secret:x/s": ("secret", 7.0, False, True),
    }
    edges = [(r.source, r.target, r.relationship) for r in raw.edges.orderBy("edge_seq").collect()]
    assert edges == [("user:cluster/u", "role:x/r", "binds_to"), ("serviceaccount:x/sa", "role:x/r", "binds_to"), ("pod:x/p", "serviceaccount:x/default", "runs_as"), ("pod:default/unknown", "serviceaccount:default/sa", "runs_as"), ("pod:x/p", "secret:x/s", "mounts")]


def test_stored_removes_its_shuffle(spark):
    """A stored table's shuffle files go with the job that wrote it."""
    folder = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    files = lambda: {p for p in folder.rglob("shuffle_*.data")}
    table = spark.range(0, 1000, 1, 4).withColumn("k", F.col("id") % 7)
    before = files()
    got = g.stored(table.groupBy("k").count())
    for _ in range(50):  # they go in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert got.count() == 7 and not left
