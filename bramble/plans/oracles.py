"""DuckDB SQL for the registered queries. Each builds on the same named tables as its query does."""

from __future__ import annotations

from bramble.functions import rules
from bramble.sources.views import EVENT_TYPES

_TYPES = ", ".join(f"('{n}', {s}, '{t}', {r}, {a}, {b})" for n, s, t, r, a, b in EVENT_TYPES)


def _events(snapshots: bool = False) -> str:
    graph = "CAST(user_id AS VARCHAR)" + (" || '/' || lpad(CAST((day(ts) - 1) // 3 AS VARCHAR), 2, '0')" if snapshots else "")
    return f"""
types(id, node_seq, type, risk_score, is_source, is_sink) AS (VALUES {_TYPES}),
rows_ AS (SELECT {graph} AS graph_id, event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
nodes AS (SELECT DISTINCT r.graph_id, CAST(t.node_seq AS BIGINT) AS node_seq, t.id, t.type, {_name("t.id")} AS name, CAST(t.risk_score AS DOUBLE) AS risk_score, t.is_source, t.is_sink FROM rows_ r JOIN types t ON r.event_type = t.id),
raw AS (SELECT * FROM (SELECT graph_id, event_id AS edge_seq, event_type AS source, lead(event_type) OVER (PARTITION BY graph_id ORDER BY ts, event_id) AS target,
  CASE WHEN value < 5 THEN 'uses' WHEN value < 20 THEN 'grants' ELSE 'mounts' END AS relationship, value AS weight, 'CVE-' || k AS cve, CASE WHEN k >= 50 THEN CAST(k AS DOUBLE) / 10 END AS cvss FROM rows_) WHERE target IS NOT NULL),
firsts AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY graph_id, source, target, relationship ORDER BY edge_seq) = 1),
edges AS (SELECT * EXCLUDE (edge_seq, first_seq), first_seq AS edge_seq FROM (SELECT *, min(edge_seq) OVER (PARTITION BY graph_id, source, target) AS first_seq FROM firsts QUALIFY row_number() OVER (PARTITION BY graph_id, source, target ORDER BY edge_seq DESC) = 1))"""


def _name(id_: str) -> str:
    return f"(upper({id_}[1:1]) || {id_}[2:] || '-X')"


def _names(ids: str, by: str = ">") -> str:
    return f"array_to_string(list_transform({ids}, lambda x: {_name('x')}), '{by}')"


def _values(name: str, table: dict[str, str]) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in table.items())
    return f"\n{name}(key, text) AS (VALUES {rows})"


E = _events()
H = _events(snapshots=True)
WALK = """
walk AS (SELECT graph_id, id AS start, id AS node, [id] AS path, CAST([] AS VARCHAR[]) AS rels, CAST([] AS VARCHAR[]) AS cves, CAST([] AS DOUBLE[]) AS cvss, 0 AS hops, CAST(0 AS DOUBLE) AS cost FROM nodes WHERE is_source
  UNION ALL SELECT w.graph_id, w.start, e.target, list_append(w.path, e.target), list_append(w.rels, e.relationship), list_append(w.cves, e.cve), list_append(w.cvss, e.cvss), w.hops + 1, w.cost + e.weight
  FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.source = w.node WHERE NOT list_contains(w.path, e.target) AND w.hops < 15),
simple AS (SELECT w.*, n.node_seq AS sink_seq FROM walk w JOIN nodes n ON n.graph_id = w.graph_id AND n.id = w.node AND n.is_sink),
cheapest AS (SELECT s.*, s.start AS source, s.node AS sink, f.node_seq AS source_seq, CASE WHEN cost > 20 THEN 'CRITICAL' WHEN cost > 10 THEN 'HIGH' WHEN cost > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM simple s JOIN nodes f ON f.graph_id = s.graph_id AND f.id = s.start QUALIFY row_number() OVER (PARTITION BY s.graph_id, s.start, s.node ORDER BY cost, hops, path) = 1)"""
RINGS = """
ring AS (SELECT graph_id, source AS start, target AS node, CASE WHEN source = target THEN [source] ELSE [source, target] END AS cycle, weight AS risk, source = target AS closed FROM edges WHERE source <= target
  UNION ALL SELECT r.graph_id, r.start, e.target, CASE WHEN e.target = r.start THEN r.cycle ELSE list_append(r.cycle, e.target) END, r.risk + e.weight, e.target = r.start
  FROM ring r JOIN edges e ON e.graph_id = r.graph_id AND e.source = r.node WHERE NOT r.closed AND e.target >= r.start AND (e.target = r.start OR NOT list_contains(r.cycle, e.target))),
cycles AS (SELECT graph_id, cycle, risk, len(cycle) AS length FROM ring WHERE closed)"""
THROUGH = """
counts AS (SELECT graph_id, count(*) AS baseline FROM simple GROUP BY 1),
through AS (SELECT graph_id, id, count(*) AS n FROM (SELECT graph_id, unnest(path) AS id FROM simple) GROUP BY 1, 2),
critical AS (SELECT n.graph_id, row_number() OVER (PARTITION BY n.graph_id ORDER BY t.n DESC, n.node_seq) AS rank, n.id, n.name, n.type, t.n AS eliminated, c.baseline
  FROM through t JOIN nodes n USING (graph_id, id) JOIN counts c USING (graph_id) WHERE NOT n.is_source AND NOT n.is_sink QUALIFY rank <= 5)"""
HOPS = """
hops AS (SELECT graph_id, source, sink, hop, path[hop] AS from_node, path[hop + 1] AS to_node, rels[hop] AS relationship, cves[hop] AS cve, cvss[hop] AS cvss FROM (SELECT *, unnest(range(1, hops + 1)) AS hop FROM cheapest WHERE hops > 0))"""
CLASSES = """
typed AS (SELECT c.*, list_transform(c.path, lambda p: t.m[p]) AS kinds FROM cheapest c, (SELECT map(list(id), list(type)) AS m FROM types) t),
classes AS (SELECT *, CASE WHEN len(found) = 0 THEN ['General Access'] ELSE found END AS categories, 0.6 * cost + 0.2 * hops + 0.2 * coalesce(list_max(cvss), 0.0) AS score FROM (SELECT *, list_filter([
  CASE WHEN list_has_any(rels, ['mounts', 'accesses', 'has_secret', 'reads']) AND list_contains(kinds, 'secret') THEN 'Credential Theft' END,
  CASE WHEN kinds[-1] IN ('database', 'secret') THEN 'Data Exfiltration' END,
  CASE WHEN list_has_any(rels, ['connects_to', 'exposes', 'uses']) AND len(list_filter(kinds, lambda k: k = 'pod')) >= 2 THEN 'Lateral Movement' END,
  CASE WHEN list_has_any(rels, ['escalates_to', 'grants', 'binds_to']) AND list_has_any(kinds, ['clusterrole', 'role', 'clusterrolebinding', 'rolebinding']) THEN 'Privilege Escalation' END], lambda x: x IS NOT NULL) AS found FROM typed))"""
DIFFS = """
pairs AS (SELECT * FROM (SELECT lag(graph_id) OVER (PARTITION BY u ORDER BY graph_id) AS old_graph_id, graph_id AS new_graph_id FROM (SELECT DISTINCT split_part(graph_id, '/', 1) AS u, graph_id FROM rows_)) WHERE old_graph_id IS NOT NULL)"""
S = """
nodes AS (SELECT 0 * 1000000000000 + c_custkey AS node_seq, 'customer:' || c_custkey AS id, 'pod' AS type, c_name AS name, 3.0::DOUBLE AS risk_score, c_acctbal < 0 AS is_source, false AS is_sink FROM customer
  UNION ALL SELECT 1 * 1000000000000 + o_orderkey, 'order:' || o_orderkey, 'serviceaccount', CASE WHEN o_orderpriority = '5-LOW' THEN 'default' ELSE 'order-' || o_orderkey END, 4.0, false, false FROM orders
  UNION ALL SELECT 2 * 1000000000000 + p_partkey, 'part:' || p_partkey, CASE WHEN p_size <= 2 THEN 'clusterrolebinding' ELSE 'role' END, p_name, CAST(p_size AS DOUBLE) / 10 + 1, false, false FROM part
  UNION ALL SELECT 3 * 1000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'clusterrole', CASE WHEN s_nationkey < 5 THEN 'Admin-' || s_suppkey ELSE 'ops-' || s_suppkey END, 5.0, false, false FROM supplier
  UNION ALL SELECT 4 * 1000000000000 + n_nationkey, 'nation:' || n_nationkey, 'namespace', n_name, 1.0, false, false FROM nation
  UNION ALL SELECT 5 * 1000000000000 + r_regionkey, 'region:' || r_regionkey, 'database', r_name, 8.0, false, true FROM region),
lines AS (SELECT *, l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS seq FROM lineitem),
edges AS (SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, 'runs_as' AS relationship, 1 + o_totalprice / 100000 AS weight, o_orderkey AS edge_seq FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'binds_to', arg_min(l_quantity / 10, seq), 1000000000000 + min(seq) FROM lines WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'grants', arg_min(1 + l_quantity / 25, seq), 2000000000000 + min(seq) FROM lines WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'accesses', 5.0, 3000000000000 + s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'reads', 3.0, 4000000000000 + n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region))"""
RBAC = """
admin AS (SELECT r.id AS role, b.id AS binding FROM edges e JOIN nodes r ON r.id = e.target AND r.type = 'clusterrole' AND contains(lower(r.name), 'admin') JOIN nodes b ON b.id = e.source AND b.type IN ('rolebinding', 'clusterrolebinding')),
f_admin AS (SELECT 'HIGH' AS severity, 'cluster-admin' AS category, role || '>' || binding || coalesce('>' || string_agg(e.source, '>' ORDER BY e.edge_seq, e.source), '') AS affected_nodes FROM admin LEFT JOIN edges e ON e.target = admin.binding GROUP BY role, binding),
f_wild AS (SELECT 'MEDIUM' AS severity, 'wildcard-role' AS category, n.id || '>' || string_agg(e.target, '>' ORDER BY e.edge_seq, e.target) AS affected_nodes FROM edges e JOIN nodes n ON n.id = e.source WHERE n.type IN ('role', 'clusterrole') AND n.risk_score >= 5 GROUP BY n.id HAVING count(*) >= 2),
f_chain AS (SELECT 'HIGH' AS severity, 'escalation-chain' AS category, a.id || '>' || b.id || '>' || r.id AS affected_nodes FROM edges x JOIN edges y ON x.target = y.source JOIN nodes a ON a.id = x.source AND a.type = 'serviceaccount' JOIN nodes b ON b.id = x.target AND b.type IN ('rolebinding', 'clusterrolebinding') JOIN nodes r ON r.id = y.target AND r.type = 'clusterrole'),
f_default AS (SELECT 'LOW' AS severity, 'default-account' AS category, p.id || '>' || s.id AS affected_nodes FROM edges e JOIN nodes s ON s.id = e.target AND s.type = 'serviceaccount' AND s.name = 'default' JOIN nodes p ON p.id = e.source AND p.type = 'pod')"""
K = """
spaces AS (SELECT 1),
boxes AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS privileged, count(*) FILTER (o_orderpriority = '1-URGENT') AS root FROM orders GROUP BY 1),
pods AS (SELECT c_custkey AS seq, 'ns-' || c_nationkey AS ns, 'pod-' || c_custkey AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) ELSE 'default' END AS account, 'part-' || (c_custkey % 50) AS secret, c_acctbal < 0 AS is_source, least(3.0 + 3 * coalesce(privileged, 0) + 2 * coalesce(root, 0), 10.0)::DOUBLE AS risk FROM customer LEFT JOIN boxes ON o_custkey = c_custkey),
n_pods AS (SELECT 'pod:' || ns || '/' || name AS id, 'pod' AS type, name, ns AS namespace, risk AS risk_score, is_source, false AS is_sink FROM pods),
n_services AS (SELECT 'service:' || namespace || '/' || name AS id, 'service' AS type, name, namespace, CASE WHEN out_ THEN 4.0 ELSE 2.0 END::DOUBLE AS risk_score, out_ AS is_source, false AS is_sink FROM (SELECT CASE WHEN s_suppkey % 10 <> 0 THEN 'svc-' || s_suppkey ELSE 'unknown' END AS name, CASE WHEN s_nationkey > 2 THEN 'ns-' || s_nationkey ELSE 'default' END AS namespace, s_suppkey % 3 < 2 AS out_, s_suppkey AS seq FROM supplier) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
a_accounts AS (SELECT 'serviceaccount:ns-' || c_nationkey || '/' || lower(c_mktsegment) AS id, 'serviceaccount' AS type, lower(c_mktsegment) AS name, 'ns-' || c_nationkey AS namespace, 4.0::DOUBLE AS risk_score, false AS is_source, false AS is_sink FROM customer),
n_accounts AS (SELECT DISTINCT * FROM a_accounts),
n_secrets AS (SELECT 'secret:ns-1/part-' || p_partkey AS id, 'secret' AS type, 'part-' || p_partkey AS name, 'ns-1' AS namespace, 7.0::DOUBLE AS risk_score, false AS is_source, true AS is_sink FROM part),
n_maps AS (SELECT 'configmap:default/map-' || p_partkey AS id, 'configmap' AS type, 'map-' || p_partkey AS name, 'default' AS namespace, 2.5::DOUBLE AS risk_score, false AS is_source, false AS is_sink FROM part),
known AS (SELECT * FROM n_pods UNION ALL SELECT * FROM n_services UNION ALL SELECT * FROM n_accounts UNION ALL SELECT * FROM n_secrets UNION ALL SELECT * FROM n_maps),
subjects AS (SELECT 'serviceaccount:ns-' || s_nationkey || '/machinery' AS source, 'role:ns-' || s_nationkey || '/role-' || (s_suppkey % 7) AS target FROM supplier
  UNION SELECT 'user:cluster/user-' || (s_suppkey % 11), 'role:ns-' || s_nationkey || '/role-' || (s_suppkey % 7) FROM supplier
  UNION SELECT 'serviceaccount:ns-' || (l_partkey % 25) || '/default', 'clusterrole:cluster/admin-' || l_suppkey FROM lineitem WHERE l_linenumber > 1
  UNION SELECT 'group:cluster/ops', 'clusterrole:cluster/admin-' || l_suppkey FROM lineitem WHERE l_linenumber > 1),
runs AS (SELECT DISTINCT 'pod:' || ns || '/' || name AS source, 'serviceaccount:' || ns || '/' || account AS target FROM pods),
mounted AS (SELECT DISTINCT 'pod:' || ns || '/' || name AS source, 'secret:' || ns || '/' || secret AS target FROM pods),
named AS (SELECT 'role:ns-' || s_nationkey || '/role-' || (s_suppkey % 7) AS id, 3.5 AS risk_score, false AS is_sink FROM supplier UNION SELECT 'clusterrole:cluster/admin-' || l_suppkey, 5.0, false FROM lineitem
  UNION SELECT source, CASE WHEN source LIKE 'serviceaccount:%' THEN 4.0 ELSE 3.0 END, false FROM subjects UNION SELECT target, 4.0, false FROM runs UNION SELECT target, 7.0, true FROM mounted),
implicit AS (SELECT id, split_part(id, ':', 1) AS type, split_part(id, '/', 2) AS name, risk_score::DOUBLE AS risk_score, is_sink FROM named WHERE id NOT IN (SELECT id FROM known))"""


def _e(select: str, *more: str, base: str = E) -> str:
    return f"WITH RECURSIVE {','.join([base, *more])}\n{select}"


_STAGES = "".join(f", h{n} AS (SELECT h.source, e.target AS node, min(h.cost + e.weight) AS cost FROM h{n - 1} h JOIN edges e ON e.source = h.node GROUP BY 1, 2)" for n in range(2, 6))
# A node and an edge of a graph document.
_NODE = "{'id': id, 'type': type, 'name': name, 'namespace': 'events', 'risk_score': risk_score, 'is_source': is_source, 'is_sink': is_sink, 'cves': CAST([] AS VARCHAR[])}"
_EDGE = "{'source': source, 'target': target, 'relationship': relationship, 'weight': weight, 'cve': cve, 'cvss': cvss}"
# Walks of the supply graph by stage: w0 from its sources, v0 to its sinks; each node has one stage.
_WALKS = (
    ", w0 AS (SELECT id AS node, CAST(1 AS BIGINT) AS n FROM nodes WHERE is_source)" + "".join(f", w{k} AS (SELECT e.target AS node, CAST(sum(w.n) AS BIGINT) AS n FROM w{k - 1} w JOIN edges e ON e.source = w.node GROUP BY 1)" for k in range(1, 6))
    + ", v0 AS (SELECT id AS node, CAST(1 AS BIGINT) AS n FROM nodes WHERE is_sink)" + "".join(f", v{k} AS (SELECT e.source AS node, CAST(sum(v.n) AS BIGINT) AS n FROM v{k - 1} v JOIN edges e ON e.target = v.node GROUP BY 1)" for k in range(1, 6))
    + ", through AS (" + " UNION ALL ".join(f"SELECT w.node AS id, w.n * v.n AS n FROM w{k} w JOIN v{5 - k} v ON v.node = w.node" for k in range(6)) + "), total AS (SELECT CAST(sum(n) AS BIGINT) AS baseline FROM w5)"
)
_path = "array_to_string(path, '>')"
ORACLES = {
    "first_edges": _e("SELECT graph_id, edge_seq, source, target, relationship, weight FROM firsts"),
    "collapse_edges": _e("SELECT graph_id, edge_seq, source, target, relationship, weight, cve, cvss FROM edges"),
    "upsert_nodes": """WITH seen AS (SELECT CAST(o_custkey AS VARCHAR) AS graph_id, o_orderkey AS node_seq, o_orderpriority AS id, o_totalprice AS risk_score FROM orders)
SELECT graph_id, min_seq AS node_seq, id, risk_score FROM (SELECT *, min(node_seq) OVER (PARTITION BY graph_id, id) AS min_seq FROM seen QUALIFY row_number() OVER (PARTITION BY graph_id, id ORDER BY node_seq DESC) = 1)""",
    "dangling_edges": _e("SELECT r.graph_id, r.edge_seq, r.source, r.target FROM raw r WHERE r.source = 'error' OR r.target = 'error'"),
    "source_nodes": _e("SELECT graph_id, id FROM nodes WHERE is_source"),
    "sink_nodes": _e("SELECT graph_id, id FROM nodes WHERE is_sink"),
    "node_names": _e("SELECT e.graph_id, e.source, coalesce(n.name, e.source) AS source_name, e.target FROM edges e LEFT JOIN nodes n ON n.graph_id = e.graph_id AND n.id = e.source"),
    "resolve_nodes": f"""WITH {S}, wanted AS (SELECT 'nation:' || n_nationkey AS identifier FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT upper(r_name) FROM region UNION SELECT 'ation:1' UNION SELECT 'GION:4' UNION SELECT 'nowhere'),
hit AS (SELECT w.identifier, n.id, n.node_seq, CASE WHEN n.id = w.identifier THEN 1 WHEN lower(n.name) = lower(w.identifier) THEN 2 ELSE 3 END AS class FROM wanted w JOIN nodes n ON n.id = w.identifier OR lower(n.name) = lower(w.identifier) OR contains(lower(n.id), lower(w.identifier))),
best AS (SELECT identifier, min(class) AS class FROM hit GROUP BY 1)
SELECT w.identifier, CASE WHEN b.class = 3 AND count(h.id) > 1 THEN NULL ELSE min_by(h.id, h.node_seq) END AS node FROM wanted w LEFT JOIN best b USING (identifier) LEFT JOIN hit h ON h.identifier = w.identifier AND h.class = b.class GROUP BY w.identifier, b.class""",
    "graph_summary": _e("SELECT n.graph_id, count(*) AS nodes, coalesce(any_value(e.n), 0) AS edges, count(*) FILTER (is_source) AS sources, count(*) FILTER (is_sink) AS sinks FROM nodes n LEFT JOIN (SELECT graph_id, count(*) AS n FROM edges GROUP BY 1) e USING (graph_id) GROUP BY 1"),
    "node_type_counts": _e("SELECT graph_id, type, count(*) AS n FROM nodes GROUP BY 1, 2"),
    "relationship_counts": _e("SELECT graph_id, relationship, count(*) AS n FROM edges GROUP BY 1, 2"),
    "is_dag": _e("SELECT DISTINCT n.graph_id, c.graph_id IS NULL AS is_dag FROM nodes n LEFT JOIN (SELECT DISTINCT graph_id FROM cycles) c USING (graph_id)", RINGS, base=H),
    "weak_components": _e(
        "SELECT graph_id, count(DISTINCT least_) AS components FROM (SELECT graph_id, a, min(b) AS least_ FROM joined GROUP BY 1, 2) GROUP BY 1",
        """
joined AS (SELECT graph_id, id AS a, id AS b FROM nodes UNION SELECT j.graph_id, j.a, CASE WHEN e.source = j.b THEN e.target ELSE e.source END FROM joined j JOIN edges e ON e.graph_id = j.graph_id AND (e.source = j.b OR e.target = j.b))""",
        base=H,
    ),
    "strong_components": _e("""SELECT graph_id, a AS node, min(b) AS component FROM (SELECT f.graph_id, f.a, f.b FROM ways f JOIN ways r ON r.graph_id = f.graph_id AND r.a = f.b AND r.b = f.a) GROUP BY 1, 2""", """
ways AS (SELECT graph_id, source AS a, target AS b FROM edges UNION SELECT w.graph_id, w.a, e.target FROM ways w JOIN edges e ON e.graph_id = w.graph_id AND e.source = w.b)""", base=H),
    "node_listing": _e("SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY type, node_seq) AS place, id, type, is_source, is_sink FROM nodes"),
    "node_connections": _e("SELECT graph_id, source AS node, 'out' AS direction, target AS other, " + _name("target") + " AS other_name, relationship, weight FROM edges UNION ALL SELECT graph_id, target, 'in', source, " + _name("source") + ", relationship, weight FROM edges"),
    "node_degrees": _e("SELECT n.graph_id, n.id, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.source = n.id) AS out_degree, (SELECT count(*) FROM edges e WHERE e.graph_id = n.graph_id AND e.target = n.id) AS in_degree FROM nodes n"),
    "edge_flags": _e(
        """SELECT e.graph_id, e.source, e.target, e.relationship, EXISTS (SELECT 1 FROM hops h WHERE h.graph_id = e.graph_id AND h.from_node = e.source AND h.to_node = e.target) AS on_path,
EXISTS (SELECT 1 FROM ring_edges r WHERE r.graph_id = e.graph_id AND r.a = e.source AND r.b = e.target) AS on_cycle, EXISTS (SELECT 1 FROM critical c WHERE c.graph_id = e.graph_id AND c.id IN (e.source, e.target)) AS critical FROM edges e""",
        WALK, HOPS, RINGS, THROUGH, "\nring_edges AS (SELECT DISTINCT graph_id, cycle[i] AS a, cycle[i % length + 1] AS b FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM cycles))",
    ),
    "blast_radius": _e("SELECT graph_id, start AS source, min(hops) AS hop, node FROM walk GROUP BY 1, 2, 4 HAVING min(hops) BETWEEN 1 AND 3", WALK),
    "blast_radius_counts": _e("SELECT graph_id, source, hop, count(*) AS nodes FROM (SELECT graph_id, start AS source, node, min(hops) AS hop FROM walk GROUP BY 1, 2, 3) WHERE hop BETWEEN 1 AND 3 GROUP BY 1, 2, 3", WALK),
    "blast_radius_supply": f"""WITH {S}, h1 AS (SELECT DISTINCT n.id AS source, e.target AS node FROM nodes n JOIN edges e ON e.source = n.id WHERE n.is_source), h2 AS (SELECT DISTINCT h1.source, e.target AS node FROM h1 JOIN edges e ON e.source = h1.node), h3 AS (SELECT DISTINCT h2.source, e.target AS node FROM h2 JOIN edges e ON e.source = h2.node)
SELECT source, 1 AS hop, count(*) AS nodes FROM h1 GROUP BY 1 UNION ALL SELECT source, 2, count(*) FROM h2 GROUP BY 1 UNION ALL SELECT source, 3, count(*) FROM h3 GROUP BY 1""",
    "reachable": _e("SELECT graph_id, start, node, min(hops) AS hop FROM walk GROUP BY 1, 2, 3", WALK),
    "shortest_path": _e(f"SELECT graph_id, source, sink AS target, {_path} AS path_nodes, {_names('path')} AS path_names, hops AS hop_count, cost AS total_risk, severity FROM cheapest", WALK),
    "attack_paths": _e(f"SELECT graph_id, source, sink, {_path} AS path_nodes, {_names('path')} AS path_names, array_to_string(rels, '>') AS relationships, hops AS hop_count, cost AS total_risk, severity FROM cheapest", WALK),
    "attack_paths_supply": f"""WITH {S}, h1 AS (SELECT n.id AS source, e.target AS node, min(0.0::DOUBLE + e.weight) AS cost FROM nodes n JOIN edges e ON e.source = n.id WHERE n.is_source GROUP BY 1, 2){_STAGES}
SELECT source, node AS sink, 5 AS hop_count, cost AS total_risk, CASE WHEN cost > 20 THEN 'CRITICAL' WHEN cost > 10 THEN 'HIGH' WHEN cost > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM h5""",
    "ranked_paths": _e(f"SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY cost, source_seq, sink_seq) AS rank, {_path} AS path_nodes, cost AS total_risk FROM cheapest", WALK),
    "path_hops": _e("SELECT graph_id, source, sink, hop, from_node, to_node, relationship, cve, cvss FROM hops", WALK, HOPS),
    "simple_paths": _e(f"SELECT graph_id, start AS source, node AS sink, {_path} AS path_nodes FROM simple", WALK),
    "simple_path_counts": _e("SELECT graph_id, count(*) AS paths FROM simple GROUP BY 1", WALK),
    "critical_nodes": _e("SELECT graph_id, rank, id, eliminated, baseline, round(eliminated / greatest(baseline, 1) * 100, 6) AS percent FROM critical", WALK, THROUGH),
    "node_risk": _e("SELECT n.graph_id, row_number() OVER (PARTITION BY n.graph_id ORDER BY n.risk_score * (1 + log2(1 + coalesce(t.n, 0))) DESC, n.node_seq) AS rank, n.id AS node_id, n.risk_score AS base_risk, coalesce(t.n, 0) AS paths_through, round(n.risk_score * (1 + log2(1 + coalesce(t.n, 0))), 6) AS amplified_risk FROM nodes n LEFT JOIN through t USING (graph_id, id)", WALK, THROUGH),
    "simple_path_counts_supply": f"WITH {S}{_WALKS} SELECT 'supply' AS graph_id, baseline AS paths FROM total",
    "critical_nodes_supply": f"WITH {S}{_WALKS} SELECT row_number() OVER (ORDER BY t.n DESC, m.node_seq) AS rank, m.id, t.n AS eliminated, baseline, round(t.n / greatest(baseline, 1) * 100, 6) AS percent FROM through t JOIN nodes m USING (id), total WHERE NOT m.is_source AND NOT m.is_sink QUALIFY rank <= 5",
    "node_risk_supply": f"WITH {S}{_WALKS} SELECT m.id AS node_id, m.risk_score AS base_risk, coalesce(t.n, 0) AS paths_through, round(m.risk_score * (1 + log2(1 + coalesce(t.n, 0))), 6) AS amplified_risk FROM nodes m LEFT JOIN through t USING (id)",
    "top_node_risk": _e("SELECT graph_id, rank, node_id, round(risk, 2) AS amplified_risk FROM (SELECT n.graph_id, n.id AS node_id, n.risk_score * (1 + log2(1 + coalesce(t.n, 0))) AS risk, row_number() OVER (PARTITION BY n.graph_id ORDER BY n.risk_score * (1 + log2(1 + coalesce(t.n, 0))) DESC, n.node_seq) AS rank FROM nodes n LEFT JOIN through t USING (graph_id, id)) WHERE rank <= 2", WALK, THROUGH),
    "cycles": _e(f"SELECT graph_id, array_to_string(cycle, '>') AS cycle, {_names('cycle')} AS cycle_names, length FROM cycles", RINGS),
    "cycle_risk": _e("SELECT graph_id, array_to_string(cycle, '>') AS cycle, round(risk, 6) AS risk FROM cycles", RINGS),
    "cycle_break_edge": _e(
        "SELECT graph_id, cycle, source, target, weight, relationship FROM (SELECT r.graph_id, array_to_string(r.cycle, '>') AS cycle, e.source, e.target, e.weight, e.relationship, row_number() OVER (PARTITION BY r.graph_id, r.cycle ORDER BY e.weight DESC, r.i) AS n FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM cycles) r JOIN edges e ON e.graph_id = r.graph_id AND e.source = r.cycle[r.i] AND e.target = r.cycle[r.i % r.length + 1]) WHERE n = 1",
        RINGS,
    ),
    "paths_through": _e("SELECT graph_id, node, count(*) AS paths, min(cost) AS least_risk FROM (SELECT graph_id, unnest(path) AS node, cost FROM cheapest) GROUP BY 1, 2", WALK),
    "severity": _e("SELECT graph_id, severity, count(*) AS paths FROM cheapest GROUP BY 1, 2", WALK),
    "classify_paths": _e(f"SELECT graph_id, {_path} AS path_nodes, array_to_string(categories, ', ') AS categories FROM classes", WALK, CLASSES),
    "advanced_score": _e(f"SELECT graph_id, {_path} AS path_nodes, round(score, 6) AS score FROM classes", WALK, CLASSES),
    "category_counts": _e("SELECT graph_id, category, count(*) AS paths FROM (SELECT graph_id, unnest(categories) AS category FROM classes) GROUP BY ROLLUP (category, graph_id) HAVING category IS NOT NULL", WALK, CLASSES),
    "risk_summary": _e(
        """SELECT *, CASE WHEN critical > 0 THEN 'immediate' WHEN high > 0 THEN 'recommended' ELSE 'acceptable' END AS verdict FROM (SELECT g.graph_id, coalesce(s.critical, 0) AS critical, coalesce(s.high, 0) AS high, coalesce(s.medium, 0) AS medium, coalesce(s.low, 0) AS low, coalesce(r.n, 0) AS cycles, coalesce(c.baseline, 0) AS baseline, t.id AS top_node
FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN (SELECT graph_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM cheapest GROUP BY 1) s USING (graph_id)
LEFT JOIN (SELECT graph_id, count(*) AS n FROM cycles GROUP BY 1) r USING (graph_id) LEFT JOIN counts c USING (graph_id) LEFT JOIN (SELECT graph_id, id FROM critical WHERE rank = 1) t USING (graph_id))""",
        WALK, RINGS, THROUGH,
    ),
    "cluster_admin": f"WITH {S},{RBAC} SELECT severity, category, affected_nodes FROM f_admin",
    "wildcard_roles": f"WITH {S},{RBAC} SELECT severity, category, affected_nodes FROM f_wild",
    "escalation_chains": f"WITH {S},{RBAC} SELECT severity, category, affected_nodes FROM f_chain",
    "default_sa": f"WITH {S},{RBAC} SELECT severity, category, affected_nodes FROM f_default",
    "rbac_totals": f"WITH {S},{RBAC} SELECT severity, count(*) AS findings FROM (SELECT * FROM f_admin UNION ALL SELECT * FROM f_wild UNION ALL SELECT * FROM f_chain UNION ALL SELECT * FROM f_default) GROUP BY 1",
    "node_diff": _e("SELECT old_graph_id, new_graph_id, 'added' AS change, n.id, n.name, n.type FROM pairs JOIN nodes n ON n.graph_id = new_graph_id WHERE NOT EXISTS (SELECT 1 FROM nodes o WHERE o.graph_id = old_graph_id AND o.id = n.id) UNION ALL SELECT old_graph_id, new_graph_id, 'removed', n.id, n.name, n.type FROM pairs JOIN nodes n ON n.graph_id = old_graph_id WHERE NOT EXISTS (SELECT 1 FROM nodes o WHERE o.graph_id = new_graph_id AND o.id = n.id)", DIFFS, base=H),
    "edge_diff": _e("SELECT old_graph_id, new_graph_id, 'added' AS change, n.source, n.target, n.relationship FROM pairs JOIN edges n ON n.graph_id = new_graph_id WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.graph_id = old_graph_id AND o.source = n.source AND o.target = n.target AND o.relationship = n.relationship) UNION ALL SELECT old_graph_id, new_graph_id, 'removed', n.source, n.target, n.relationship FROM pairs JOIN edges n ON n.graph_id = old_graph_id WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.graph_id = new_graph_id AND o.source = n.source AND o.target = n.target AND o.relationship = n.relationship)", DIFFS, base=H),
    "path_diff": _e("SELECT old_graph_id, new_graph_id, 'added' AS change, n.source, n.sink, array_to_string(n.path, '>') AS path_nodes, n.cost AS total_risk, n.severity FROM pairs JOIN cheapest n ON n.graph_id = new_graph_id WHERE NOT EXISTS (SELECT 1 FROM cheapest o WHERE o.graph_id = old_graph_id AND o.source = n.source AND o.sink = n.sink) UNION ALL SELECT old_graph_id, new_graph_id, 'removed', n.source, n.sink, array_to_string(n.path, '>'), n.cost, n.severity FROM pairs JOIN cheapest n ON n.graph_id = old_graph_id WHERE NOT EXISTS (SELECT 1 FROM cheapest o WHERE o.graph_id = new_graph_id AND o.source = n.source AND o.sink = n.sink)", DIFFS, WALK, base=H),
    "critical_remediation": _e(
        """SELECT graph_id, rank, part, text FROM (SELECT c.graph_id, c.rank, unnest([1, 2, 3]) AS part, unnest(['Harden ' || c.type || ' ' || c.name || ': ' || eliminated || ' of ' || baseline || ' paths run through it.', f.text,
  CASE WHEN c.type IN ('rolebinding', 'clusterrolebinding') THEN 'First, delete the binding ' WHEN c.type = 'serviceaccount' THEN 'First, restrict the account ' WHEN c.type IN ('role', 'clusterrole') THEN 'First, scope down the role ' END || c.name || '.']) AS text FROM critical c LEFT JOIN type_fixes f ON f.key = c.type) WHERE text IS NOT NULL
UNION ALL SELECT DISTINCT graph_id, 0, 0, 'No single node breaks a path.' FROM nodes WHERE graph_id NOT IN (SELECT graph_id FROM critical)""",
        WALK, THROUGH, _values("type_fixes", rules.TYPE_FIXES),
    ),
    "cycle_remediation": _e(
        f"""SELECT graph_id, ring, break_edge, coalesce(f.text, 'Review ' || relationship || '.') AS text FROM (SELECT r.graph_id, {_names("r.cycle", " > ")} || ' > ' || {_name("r.cycle[1]")} AS ring, e.source || ' > ' || e.target AS break_edge, e.relationship, row_number() OVER (PARTITION BY r.graph_id, r.cycle ORDER BY e.weight DESC, r.i) AS n
  FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM cycles) r JOIN edges e ON e.graph_id = r.graph_id AND e.source = r.cycle[r.i] AND e.target = r.cycle[r.i % r.length + 1]) b LEFT JOIN fixes f ON f.key = b.relationship WHERE n = 1
UNION ALL SELECT g.graph_id, NULL, NULL, CASE WHEN count(c.cycle) = 0 THEN 'There is no cycle.' ELSE 'Cycles to break: ' || count(c.cycle) || '.' END FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN cycles c USING (graph_id) GROUP BY 1""",
        RINGS, _values("fixes", rules.FIXES),
    ),
    "path_remediation": _e(
        f"""SELECT graph_id, source, sink, hop, part, text FROM (SELECT h.graph_id, h.source, h.sink, h.hop, unnest([1, 2, 3]) AS part, unnest([{_name("h.from_node")} || ' > ' || {_name("h.to_node")} || ': ' || coalesce(f.text, 'Review ' || relationship || ' from ' || {_name("h.from_node")} || ' to ' || {_name("h.to_node")} || '.'),
  CASE WHEN coalesce(cve, '') <> '' THEN 'Patch ' || cve || ' (CVSS ' || printf('%.1f', coalesce(cvss, 0)) || ').' END, k.text]) AS text FROM hops h JOIN types t ON t.id = h.to_node LEFT JOIN fixes f ON f.key = h.relationship LEFT JOIN type_fixes k ON k.key = t.type) WHERE text IS NOT NULL""",
        WALK, HOPS, _values("fixes", rules.FIXES), _values("type_fixes", rules.TYPE_FIXES),
    ),
    "path_explanation": _e(
        """SELECT graph_id, source, sink, 0 AS step, 'Whoever takes over the ' || a.called || ' gets to the ' || z.called || ', hops: ' || hops || '. Severity ' || severity || '; ' || array_to_string(categories, ', ') || '.' AS text FROM classes JOIN called a ON a.id = path[1] JOIN called z ON z.id = path[-1]
UNION ALL SELECT graph_id, source, sink, hop, 'The ' || a.called || ' ' || coalesce(v.text, 'leads by ' || relationship || ' to') || ' the ' || z.called || '.' || CASE WHEN coalesce(cve, '') <> '' THEN ' It uses ' || cve || CASE WHEN coalesce(cvss, 0) <> 0 THEN ' (CVSS ' || printf('%.1f', cvss) || ')' ELSE '' END || '.' ELSE '' END
  FROM hops JOIN called a ON a.id = from_node JOIN called z ON z.id = to_node LEFT JOIN verbs v ON v.key = relationship
UNION ALL SELECT graph_id, source, sink, hops + 1, 'The risk adds up to ' || printf('%.2f', cost) || ', and the ' || z.called || ' is lost.' FROM cheapest JOIN called z ON z.id = sink""",
        WALK, HOPS, CLASSES, _values("verbs", rules.VERBS), _values("nouns", rules.NOUNS), f"\ncalled AS (SELECT id, coalesce(n.text, type) || ' ' || chr(39) || {_name('id')} || chr(39) AS called FROM types LEFT JOIN nouns n ON n.key = type)",
    ),
    "critical_explanation": _e(
        """SELECT g.graph_id, coalesce(max('The ' || coalesce(n.text, type) || ' ' || chr(39) || name || chr(39) || ' lies on ' || eliminated || ' of ' || baseline || ' paths (' || printf('%.1f', eliminated / greatest(baseline, 1) * 100) || '%).') FILTER (rank = 1), 'No single node stands out.') AS top, coalesce(string_agg(name || ' (' || eliminated || ')', ', ' ORDER BY rank) FILTER (rank > 1), '') AS others
FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN critical USING (graph_id) LEFT JOIN nouns n ON n.key = type GROUP BY 1""",
        WALK, THROUGH, _values("nouns", rules.NOUNS),
    ),
    "highest_risk_path": _e(f"SELECT graph_id, {_path} AS path_nodes, cost AS total_risk FROM cheapest QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY cost DESC, source_seq DESC, sink_seq DESC) = 1", WALK),
    "graph_document": _e(f"SELECT graph_id, CAST(to_json({{'nodes': n.rows, 'edges': coalesce(e.rows, [])}}) AS VARCHAR) AS document FROM (SELECT graph_id, list({_NODE} ORDER BY node_seq) AS rows FROM nodes GROUP BY 1) n LEFT JOIN (SELECT graph_id, list({_EDGE} ORDER BY edge_seq) AS rows FROM raw GROUP BY 1) e USING (graph_id)"),
    "graph_document_parts": _e(f"""SELECT graph_id, 1 AS section, place, CASE WHEN place > 1 THEN ',' ELSE '' END || CAST(to_json({_NODE}) AS VARCHAR) AS text FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY node_seq) AS place FROM nodes)
UNION ALL SELECT graph_id, 3, place, CASE WHEN place > 1 THEN ',' ELSE '' END || CAST(to_json({_EDGE}) AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY edge_seq) AS place FROM raw)
UNION ALL SELECT graph_id, section, CAST(0 AS BIGINT), text FROM (SELECT DISTINCT graph_id FROM nodes), (VALUES (0, '{{"nodes":['), (2, '],"edges":['), (4, ']}}')) v(section, text)"""),
    "pod_nodes": f"WITH {K} SELECT id, name, namespace, risk_score, is_source, is_sink FROM n_pods",
    "service_nodes": f"WITH {K} SELECT 'service:' || namespace || '/' || name AS id, name, namespace, CASE WHEN out_ THEN 4.0 ELSE 2.0 END::DOUBLE AS risk_score, out_ AS is_source, false AS is_sink FROM (SELECT CASE WHEN s_suppkey % 10 <> 0 THEN 'svc-' || s_suppkey ELSE 'unknown' END AS name, CASE WHEN s_nationkey > 2 THEN 'ns-' || s_nationkey ELSE 'default' END AS namespace, s_suppkey % 3 < 2 AS out_ FROM supplier)",
    "serviceaccount_nodes": f"WITH {K} SELECT id, name, namespace, risk_score, is_source, is_sink FROM a_accounts",
    "secret_nodes": f"WITH {K} SELECT id, name, namespace, risk_score, is_source, is_sink FROM n_secrets",
    "configmap_nodes": f"WITH {K} SELECT id, name, namespace, risk_score, is_source, is_sink FROM n_maps",
    "rbac_edges": f"WITH {K} SELECT source, target, 'binds_to' AS relationship, 3.0::DOUBLE AS weight FROM subjects",
    "pod_sa_edges": f"WITH {K} SELECT source, target, 'runs_as' AS relationship, 2.0::DOUBLE AS weight FROM runs",
    "pod_secret_edges": f"WITH {K} SELECT source, target, 'mounts' AS relationship, 3.5::DOUBLE AS weight FROM mounted",
    "implicit_nodes": f"WITH {K} SELECT id, type, name, risk_score, is_sink FROM implicit",
    "assembled_nodes": f"WITH {K} SELECT id, type, risk_score, is_source, is_sink FROM known UNION ALL SELECT id, type, risk_score, false, is_sink FROM implicit",
    "assembled_edges": f"WITH {K} SELECT source, target, 'binds_to' AS relationship FROM subjects UNION ALL SELECT source, target, 'runs_as' FROM runs UNION ALL SELECT source, target, 'mounts' FROM mounted",
}
ORACLES["diff_counts"] = _e(
    " UNION ALL ".join(
        f"SELECT old_graph_id, new_graph_id, '{change}' AS change, '{kind}' AS kind, count(*) AS n FROM pairs JOIN {table} n ON n.graph_id = {own} WHERE NOT EXISTS (SELECT 1 FROM {table} o WHERE o.graph_id = {other} AND {same}) GROUP BY 1, 2"
        for kind, table, same in (("nodes", "nodes", "o.id = n.id"), ("edges", "edges", "o.source = n.source AND o.target = n.target AND o.relationship = n.relationship"), ("paths", "cheapest", "o.source = n.source AND o.sink = n.sink"))
        for change, own, other in (("added", "new_graph_id", "old_graph_id"), ("removed", "old_graph_id", "new_graph_id"))
    ),
    DIFFS,
    WALK,
    base=H,
)
