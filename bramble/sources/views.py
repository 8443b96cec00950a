"""Graphs over the driver's tables: event transitions (E), a supply chain (S), and list dumps (K)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bramble.operators.graph import Graph

#: Of each event type: place, node type, risk, source, sink.
EVENT_TYPES = [("signup", 0, "pod", 3.0, True, False), ("view", 1, "pod", 2.0, False, False), ("click", 2, "serviceaccount", 4.0, False, False), ("error", 3, "clusterrole", 6.0, False, False), ("purchase", 4, "secret", 7.0, False, True)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, at: int, kind: str):
    out = None
    for row in EVENT_TYPES:
        out = F.when(F.col(column) == row[0], row[at]) if out is None else out.when(F.col(column) == row[0], row[at])
    return out.cast(kind)


def snapshot(ts: str = "ts") -> Column:
    """The number of an event's snapshot: three days each."""
    return F.lpad(F.floor((F.dayofmonth(ts) - 1) / 3).cast("string"), 2, "0")


def event_graphs(spark: SparkSession, sf_dir: str, snapshots: bool = False) -> Graph:
    """A raw graph for each user: event types as nodes, each event's step to the next as an edge. snapshots: one for each three days."""
    events = _table(spark, sf_dir, "events")
    graph_id = F.col("user_id").cast("string")
    if snapshots:
        graph_id = F.concat(graph_id, F.lit("/"), snapshot())
    rows = events.withColumn("graph_id", graph_id)
    nodes = rows.select("graph_id", F.col("event_type").alias("id")).distinct()
    name = F.concat(F.upper(F.left("id", F.lit(1))), F.substr("id", F.lit(2)), F.lit("-X"))
    nodes = nodes.select("graph_id", _case("id", 1, "long").alias("node_seq"), "id", _case("id", 2, "string").alias("type"), name.alias("name"), F.lit("events").alias("namespace"), _case("id", 3, "double").alias("risk_score"), _case("id", 4, "boolean").alias("is_source"), _case("id", 5, "boolean").alias("is_sink"), F.array().cast("array<string>").alias("cves"))
    then = Window.partitionBy("graph_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    edges = rows.withColumns({"target": F.lead("event_type").over(then), "k": k}).where("target is not null")
    relationship = F.when(F.col("value") < 5, "uses").when(F.col("value") < 20, "grants").otherwise("mounts")
    edges = edges.select("graph_id", F.col("event_id").alias("edge_seq"), F.col("event_type").alias("source"), "target", relationship.alias("relationship"), F.col("value").alias("weight"), F.concat(F.lit("CVE-"), F.col("k").cast("string")).alias("cve"), F.when(F.col("k") >= 50, F.col("k") / 10).alias("cvss"))
    return Graph(nodes, edges)


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """One raw graph: customer -> order -> part -> supplier -> nation -> region."""
    t = lambda name: _table(spark, sf_dir, name)
    node = lambda df, stage, kind, key, type_, name, risk, source=F.lit(False), sink=False: df.select(F.lit("supply").alias("graph_id"), (F.lit(stage).cast("long") * 10**12 + F.col(key)).alias("node_seq"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), type_.alias("type"), name.alias("name"), F.lit("supply").alias("namespace"), risk.cast("double").alias("risk_score"), source.alias("is_source"), F.lit(sink).alias("is_sink"), F.array().cast("array<string>").alias("cves"))
    named = lambda kind, key: F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
    nodes = node(t("customer"), 0, "customer", "c_custkey", F.lit("pod"), F.col("c_name"), F.lit(3.0), F.col("c_acctbal") < 0)
    nodes = nodes.unionByName(node(t("orders"), 1, "order", "o_orderkey", F.lit("serviceaccount"), F.when(F.col("o_orderpriority") == "5-LOW", "default").otherwise(named("order", "o_orderkey")), F.lit(4.0)))
    nodes = nodes.unionByName(node(t("part"), 2, "part", "p_partkey", F.when(F.col("p_size") <= 2, "clusterrolebinding").otherwise("role"), F.col("p_name"), F.col("p_size") / 10 + 1))
    nodes = nodes.unionByName(node(t("supplier"), 3, "supplier", "s_suppkey", F.lit("clusterrole"), F.when(F.col("s_nationkey") < 5, named("Admin", "s_suppkey")).otherwise(named("ops", "s_suppkey")), F.lit(5.0)))
    nodes = nodes.unionByName(node(t("nation"), 4, "nation", "n_nationkey", F.lit("namespace"), F.col("n_name"), F.lit(1.0)))
    nodes = nodes.unionByName(node(t("region"), 5, "region", "r_regionkey", F.lit("database"), F.col("r_name"), F.lit(8.0), sink=True))
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edge = lambda df, stage, seq, source, target, rel, weight: df.select(F.lit("supply").alias("graph_id"), (F.lit(stage).cast("long") * 10**12 + seq).alias("edge_seq"), source.alias("source"), target.alias("target"), F.lit(rel).alias("relationship"), weight.cast("double").alias("weight"), F.lit(None).cast("string").alias("cve"), F.lit(None).cast("double").alias("cvss"))
    line = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")  # lines of one place have one weight
    edges = edge(t("orders"), 0, F.col("o_orderkey"), ref("customer", "o_custkey"), ref("order", "o_orderkey"), "runs_as", 1 + F.col("o_totalprice") / 100000)
    edges = edges.unionByName(edge(t("lineitem"), 1, line, ref("order", "l_orderkey"), ref("part", "l_partkey"), "binds_to", F.col("l_quantity") / 10))
    edges = edges.unionByName(edge(t("lineitem"), 2, line, ref("part", "l_partkey"), ref("supplier", "l_suppkey"), "grants", 1 + F.col("l_quantity") / 25))
    edges = edges.unionByName(edge(t("supplier"), 3, F.col("s_suppkey"), ref("supplier", "s_suppkey"), ref("nation", "s_nationkey"), "accesses", F.lit(5.0)))
    edges = edges.unionByName(edge(t("nation"), 4, F.col("n_nationkey"), ref("nation", "n_nationkey"), ref("region", "n_regionkey"), "reads", F.lit(3.0)))
    return Graph(nodes, edges)


def list_dumps(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """(graph_id, seq, item) for each kind of Kubernetes object, from customers, orders, suppliers, parts and line items."""
    t = lambda name: _table(spark, sf_dir, name)
    meta = lambda name, ns: F.struct(name.alias("name"), ns.alias("namespace")).alias("metadata")
    named = lambda kind, value: F.concat(F.lit(f"{kind}-"), value.cast("string"))
    item = lambda df, seq, *fields: df.select(F.lit("fleet").alias("graph_id"), F.col(seq).cast("long").alias("seq"), F.struct(*fields).alias("item"))
    none = F.lit(None).cast("string")
    security = F.struct((F.col("o_orderstatus") == "F").alias("privileged"), F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1000).cast("long").alias("runAsUser"))
    boxes = t("orders").groupBy("o_custkey").agg(F.collect_list(F.struct(security.alias("securityContext"))).alias("containers"))
    pods = t("customer").join(boxes, F.col("c_custkey") == F.col("o_custkey"), "left")
    volumes = F.array(F.struct(F.struct(named("part", F.col("c_custkey") % 50).alias("secretName")).alias("secret")), F.struct(F.struct(named("part", F.col("c_custkey") % 50).alias("secretName")).alias("secret")), F.struct(F.struct(none.alias("secretName")).alias("secret")))
    account = F.when(F.col("c_mktsegment") != "BUILDING", F.lower("c_mktsegment"))
    space = lambda key: named("ns", F.col(key))
    bound = t("lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    subject = lambda kind, name, ns: F.struct(F.lit(kind).alias("kind"), name.alias("name"), ns.alias("namespace"))
    return {
        "pods": item(pods, "c_custkey", meta(named("pod", F.col("c_custkey")), space("c_nationkey")), F.struct((F.col("c_acctbal") < 0).alias("hostNetwork"), account.alias("serviceAccountName"), "containers", volumes.alias("volumes")).alias("spec")),
        "services": item(t("supplier"), "s_suppkey", meta(F.when(F.col("s_suppkey") % 10 != 0, named("svc", F.col("s_suppkey"))), F.when(F.col("s_nationkey") > 2, space("s_nationkey"))), F.struct(F.when(F.col("s_suppkey") % 3 == 0, "NodePort").when(F.col("s_suppkey") % 3 == 1, "LoadBalancer").alias("type")).alias("spec")),
        "serviceaccounts": item(t("customer"), "c_custkey", meta(F.lower("c_mktsegment"), space("c_nationkey"))),
        "secrets": item(t("part"), "p_partkey", meta(named("part", F.col("p_partkey")), F.lit("ns-1"))),
        "configmaps": item(t("part"), "p_partkey", meta(named("map", F.col("p_partkey")), none)),
        "rolebindings": item(t("supplier"), "s_suppkey", meta(named("rb", F.col("s_suppkey")), space("s_nationkey")), F.struct(F.lit("Role").alias("kind"), named("role", F.col("s_suppkey") % 7).alias("name")).alias("roleRef"), F.array(subject("ServiceAccount", F.lit("machinery"), none), subject("User", named("user", F.col("s_suppkey") % 11), none), subject("Robot", F.lit("r"), none)).alias("subjects")),
        "clusterrolebindings": item(bound, "seq", meta(named("crb", F.col("seq")), none), F.struct(F.lit("ClusterRole").alias("kind"), named("admin", F.col("l_suppkey")).alias("name")).alias("roleRef"), F.when(F.col("l_linenumber") > 1, F.array(subject("ServiceAccount", F.lit("default"), named("ns", F.col("l_partkey") % 25)), subject("Group", F.lit("ops"), none))).alias("subjects")),
    }
