"""Nodes and edges from Kubernetes list dumps that lie in files (kubectl get ... -o json)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bramble.functions import rules
from bramble.operators.graph import Graph
from bramble.sources.graph_json import graph_of_file, require_own_names

Table = dict[str, float]

META = "metadata struct<name: string, namespace: string>"
#: The fields read of each kind of item.
ITEMS = {
    "pods": f"{META}, spec struct<hostNetwork: boolean, serviceAccountName: string, containers: array<struct<securityContext: struct<privileged: boolean, runAsUser: bigint>>>, volumes: array<struct<secret: struct<secretName: string>>>>",
    "services": f"{META}, spec struct<type: string>",
    "serviceaccounts": META,
    "secrets": META,
    "configmaps": META,
    "rolebindings": f"{META}, roleRef struct<kind: string, name: string>, subjects array<struct<kind: string, name: string, namespace: string>>",
    "clusterrolebindings": f"{META}, roleRef struct<kind: string, name: string>, subjects array<struct<kind: string, name: string, namespace: string>>",
}
NODE_KINDS = ["pods", "services", "serviceaccounts", "secrets", "configmaps"]


def read_dumps(spark: SparkSession, paths: dict[str, str], roots: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """(graph_id, seq, item) for each kind; a file is one cluster's dump. Files without items have no rows.

    graph_id is the file's name, or, where roots has one for the kind, its path below that: one cluster's files of all kinds must
    agree in it, as in pods/east.json and secrets/east.json. Several files of one kind and one name raise ValueError.
    """
    out = {}
    for kind, path in paths.items():
        root = (roots or {}).get(kind)
        require_own_names(spark, path, root)
        lists = spark.read.schema(f"items array<struct<{ITEMS[kind].replace('metadata struct', 'metadata: struct').replace('spec struct', 'spec: struct').replace('roleRef struct', 'roleRef: struct').replace('subjects array', 'subjects: array')}>>")
        lists = lists.option("multiLine", True).option("mode", "FAILFAST").json(path)
        out[kind] = lists.select(graph_of_file(root).alias("graph_id"), F.posexplode("items").alias("seq", "item")).withColumn("seq", F.col("seq").cast("long"))
    return out


def node_id(kind: Column, namespace: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(F.coalesce(namespace, F.lit("")) == "", F.lit("cluster")).otherwise(namespace), F.lit("/"), name)


def _nodes(items: DataFrame, kind: str, risk: Column, source: Column | None = None, sink: bool = False) -> DataFrame:
    name, ns = F.coalesce("item.metadata.name", F.lit("unknown")), F.coalesce("item.metadata.namespace", F.lit("default"))
    return items.select("graph_id", F.col("seq").alias("node_seq"), node_id(F.lit(kind), ns, name).alias("id"), F.lit(kind).alias("type"), name.alias("name"), ns.alias("namespace"), risk.cast("double").alias("risk_score"), F.lit(False).alias("is_source") if source is None else source.alias("is_source"), F.lit(sink).alias("is_sink"), F.array().cast("array<string>").alias("cves"))


def pod_nodes(pods: DataFrame, risks: Table = rules.RISKS) -> DataFrame:
    """Pods; risk rises by 3 for each privileged container and 2 for each that runs as root, up to 10. Pods on the host's network are sources."""
    count = lambda test: F.coalesce(F.size(F.filter("item.spec.containers", lambda c: F.coalesce(test(c["securityContext"]), F.lit(False)))), F.lit(0))
    containers = F.col("item.spec.containers").isNotNull()
    risk = F.lit(risks["pod"]) + F.when(containers, 3 * count(lambda s: s["privileged"]) + 2 * count(lambda s: s["runAsUser"] == 0)).otherwise(0)
    return _nodes(pods, "pod", F.least(risk, F.lit(10.0)), F.coalesce("item.spec.hostNetwork", F.lit(False)))


def service_nodes(services: DataFrame, risks: Table = rules.RISKS) -> DataFrame:
    """Services; those that are reachable from outside are sources, with 2 more risk."""
    outside = F.coalesce("item.spec.type", F.lit("ClusterIP")).isin("LoadBalancer", "NodePort")
    return _nodes(services, "service", risks["service"] + F.when(outside, 2.0).otherwise(0.0), outside)


def serviceaccount_nodes(accounts: DataFrame, risks: Table = rules.RISKS) -> DataFrame:
    return _nodes(accounts, "serviceaccount", F.lit(risks["serviceaccount"]))


def secret_nodes(secrets: DataFrame, risks: Table = rules.RISKS) -> DataFrame:
    return _nodes(secrets, "secret", F.lit(risks["secret"]), sink=True)


def configmap_nodes(maps: DataFrame, risks: Table = rules.RISKS) -> DataFrame:
    return _nodes(maps, "configmap", F.lit(risks["configmap"]))


EXTRACT = {"pods": pod_nodes, "services": service_nodes, "serviceaccounts": serviceaccount_nodes, "secrets": secret_nodes, "configmaps": configmap_nodes}


def _bindings(rolebindings: DataFrame, clusterrolebindings: DataFrame) -> DataFrame:
    both = rolebindings.withColumn("dump", F.lit(0)).unionByName(clusterrolebindings.withColumn("dump", F.lit(1)))
    kind = F.lower(F.coalesce("item.roleRef.kind", F.lit("Role")))
    ns = F.coalesce("item.metadata.namespace", F.lit("cluster"))
    role_ns = F.when(kind == "role", ns).otherwise(F.lit("cluster"))
    name = F.coalesce("item.roleRef.name", F.lit("unknown"))
    return both.select("graph_id", "dump", "seq", ns.alias("ns"), kind.alias("kind"), role_ns.alias("role_ns"), name.alias("role_name"), node_id(kind, role_ns, name).alias("role"), "item.subjects")


def _subjects(bindings: DataFrame) -> DataFrame:
    rows = bindings.select("graph_id", "dump", "seq", "ns", "role", F.posexplode("subjects").alias("at", "s"))
    kind = F.lower(F.coalesce("s.kind", F.lit("")))
    ns, name = F.coalesce("s.namespace", "ns"), F.coalesce("s.name", F.lit("unknown"))
    id_ = F.when(kind == "serviceaccount", node_id(kind, ns, name)).otherwise(node_id(kind, F.lit("cluster"), name))
    return rows.where(kind.isin("serviceaccount", "user", "group")).select("graph_id", "dump", "seq", "at", "role", id_.alias("subject"), kind.alias("kind"), name.alias("name"), ns.alias("namespace"))


def _distinct_edges(rows: DataFrame, relationship: str, order: list[str], weights: Table) -> DataFrame:
    """(graph_id, order, source, target, relationship, weight), the first place of each."""
    first = rows.groupBy("graph_id", "source", "target").agg(F.min(F.struct(*order)).alias("place"))
    return first.select("graph_id", "place", "source", "target", F.lit(relationship).alias("relationship"), F.lit(weights[relationship]).alias("weight"))


def rbac_edges(rolebindings: DataFrame, clusterrolebindings: DataFrame, weights: Table = rules.WEIGHTS) -> DataFrame:
    """subject -> role for each subject of each binding, once."""
    rows = _subjects(_bindings(rolebindings, clusterrolebindings))
    return _distinct_edges(rows.select("graph_id", "dump", "seq", "at", F.col("subject").alias("source"), F.col("role").alias("target")), "binds_to", ["dump", "seq", "at"], weights)


def _pod(pods: DataFrame) -> DataFrame:
    ns = F.coalesce("item.metadata.namespace", F.lit("default"))
    return pods.select("graph_id", F.lit(0).alias("dump"), "seq", ns.alias("ns"), node_id(F.lit("pod"), ns, F.coalesce("item.metadata.name", F.lit("unknown"))).alias("source"), "item.spec")


def _accounts(pods: DataFrame) -> DataFrame:
    name = F.coalesce("spec.serviceAccountName", F.lit("default"))
    return _pod(pods).select("graph_id", "dump", "seq", F.lit(0).alias("at"), "source", name.alias("name"), F.col("ns").alias("namespace"), node_id(F.lit("serviceaccount"), F.col("ns"), name).alias("target"))


def _mounted(pods: DataFrame) -> DataFrame:
    rows = _pod(pods).select("graph_id", "dump", "seq", "ns", "source", F.posexplode("spec.volumes").alias("at", "v")).withColumn("name", F.col("v.secret.secretName")).where("name != ''")
    return rows.select("graph_id", "dump", "seq", "at", "source", "name", F.col("ns").alias("namespace"), node_id(F.lit("secret"), F.col("ns"), F.col("name")).alias("target"))


def pod_sa_edges(pods: DataFrame, weights: Table = rules.WEIGHTS) -> DataFrame:
    """pod -> its service account (`default` if it names none)."""
    return _distinct_edges(_accounts(pods), "runs_as", ["dump", "seq", "at"], weights)


def pod_secret_edges(pods: DataFrame, weights: Table = rules.WEIGHTS) -> DataFrame:
    """pod -> each secret it mounts, once."""
    return _distinct_edges(_mounted(pods), "mounts", ["dump", "seq", "at"], weights)


def extracted_nodes(dumps: dict[str, DataFrame], risks: Table = rules.RISKS) -> DataFrame:
    """Nodes of the five dumps; of an id that comes twice, the last. stage and seq give their order."""
    all_ = reduce(DataFrame.unionByName, [EXTRACT[k](dumps[k], risks).withColumn("stage", F.lit(i)) for i, k in enumerate(NODE_KINDS)])
    last = F.row_number().over(Window.partitionBy("graph_id", "id").orderBy(F.desc("stage"), F.desc("node_seq")))
    return all_.withColumn("__n", last).where("__n = 1").drop("__n")


def implicit_nodes(dumps: dict[str, DataFrame], known: DataFrame, risks: Table = rules.RISKS) -> DataFrame:
    """Nodes that only bindings and pods name: roles (even of a binding without subjects), subjects, service accounts, secrets."""
    bindings = _bindings(dumps["rolebindings"], dumps["clusterrolebindings"])
    risk = lambda kind, other: rules.lookup(risks, kind, F.lit(other))
    place = lambda stage, *c: F.struct(F.lit(stage).alias("stage"), *[x.alias(n) for x, n in zip(c, ("dump", "seq", "at"), strict=True)])
    role = bindings.select("graph_id", place(5, F.col("dump"), F.col("seq"), F.lit(-1)).alias("place"), F.col("role").alias("id"), F.col("kind").alias("type"), F.col("role_name").alias("name"), F.col("role_ns").alias("namespace"), risk(F.col("kind"), 4.0).alias("risk_score"), F.lit(False).alias("is_sink"))
    subject = _subjects(bindings).select("graph_id", place(5, F.col("dump"), F.col("seq"), F.col("at")).alias("place"), F.col("subject").alias("id"), F.col("kind").alias("type"), "name", "namespace", risk(F.col("kind"), 3.0).alias("risk_score"), F.lit(False).alias("is_sink"))
    other = lambda rows, stage, kind, sink: rows.select("graph_id", place(stage, F.col("dump"), F.col("seq"), F.col("at")).alias("place"), F.col("target").alias("id"), F.lit(kind).alias("type"), "name", "namespace", F.lit(risks[kind]).alias("risk_score"), F.lit(sink).alias("is_sink"))
    all_ = reduce(DataFrame.unionByName, [role, subject, other(_accounts(dumps["pods"]), 6, "serviceaccount", False), other(_mounted(dumps["pods"]), 7, "secret", True)])
    # An id may be named by very many rows (a group in every binding), so tasks keep the least seq of equal ones, by hash, before any is moved, and only then known ids go.
    values, parts = ["type", "name", "namespace", "risk_score", "is_sink"], ["stage", "dump", "at"]
    least = all_.select("graph_id", "id", *values, "place.*").groupBy("graph_id", "id", *values, *parts).agg(F.min("seq").alias("seq"))
    place_ = F.struct("stage", "dump", "seq", "at").alias("place")
    first = least.select("graph_id", "id", place_, *values).groupBy("graph_id", "id").agg(F.min_by(F.struct("place", *values), "place").alias("n"))
    return first.join(known.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_anti").select("graph_id", "id", "n.*")


def _number(stage: Column, dump: Column, seq: Column, at: Column) -> Column:
    """One long in the order of (stage, dump, seq, at), so that no graph is numbered in one task; numbers have gaps."""
    fits = stage.between(0, 7) & dump.between(0, 1) & seq.between(0, (1 << 40) - 1) & at.between(-1, (1 << 18) - 2)
    packed = F.shiftleft((stage * 2 + dump).cast("long"), 58) + F.shiftleft(seq.cast("long"), 18) + at + 1
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("a dump has more items than can be numbered")).cast("long"))


def assemble(dumps: dict[str, DataFrame], weights: Table = rules.WEIGHTS, risks: Table = rules.RISKS) -> Graph:
    """The raw graph of all dumps: nodes by stage and place, then role, account and secret edges in that order; node_seq and edge_seq ascend, with gaps."""
    found = extracted_nodes(dumps, risks)
    more = implicit_nodes(dumps, found, risks)
    place = _number(F.col("place.stage"), F.col("place.dump"), F.col("place.seq"), F.col("place.at"))
    more = more.withColumns({"node_seq": place, "is_source": F.lit(False), "cves": F.array().cast("array<string>")})
    found = found.withColumn("node_seq", _number(F.col("stage"), F.lit(0), F.col("node_seq"), F.lit(0)))
    columns = ["graph_id", "node_seq", "id", "type", "name", "namespace", "risk_score", "is_source", "is_sink", "cves"]
    nodes = found.select(columns).unionByName(more.select(columns))
    parts = [rbac_edges(dumps["rolebindings"], dumps["clusterrolebindings"], weights), pod_sa_edges(dumps["pods"], weights), pod_secret_edges(dumps["pods"], weights)]
    edges = reduce(DataFrame.unionByName, [e.withColumn("stage", F.lit(i)) for i, e in enumerate(parts)])
    edges = edges.withColumns({"edge_seq": _number(F.col("stage"), F.col("place.dump"), F.col("place.seq"), F.col("place.at")), "cve": F.lit(None).cast("string"), "cvss": F.lit(None).cast("double")})
    return Graph(nodes, edges.select("graph_id", "edge_seq", "source", "target", "relationship", "weight", "cve", "cvss"))
