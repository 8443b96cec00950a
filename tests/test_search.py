"""Searches by bit sets and pointers, components, path counts and ranks, each against a plain version."""

from __future__ import annotations

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from bramble.operators import advise, bitsets, graph as g, ranks, strong, traverse as t
from tests.test_graph import make


def _random(rng, nodes, arcs, graph_id, acyclic=False):
    names = [f"{rng.randrange(100):02d}n{i}" for i in range(nodes)]
    pairs = [(a, b) for a, b in itertools.product(range(nodes), repeat=2) if (a < b if acyclic else True)]
    chosen = rng.sample(pairs, min(arcs, len(pairs)))
    return names, [(names[a], names[b], "uses", rng.choice((0, 1, 2, 3))) for a, b in chosen], graph_id


@pytest.fixture(scope="module")
def many(spark):
    """Random graphs, some acyclic, with about a third of the nodes sources and a few sinks."""
    rng, parts, plain = random.Random(9), [], {}
    for k in range(14):
        names, arcs, graph_id = _random(rng, rng.randint(3, 9), rng.randint(2, 16), f"g{k}", k % 2 == 0)
        sources, sinks = {n for n in names if rng.random() < 0.4}, set(rng.sample(names, 1))
        plain[graph_id] = (names, arcs, sources, sinks)
        parts.append(make(spark, [(n, "pod", n, 1, n in sources, n in sinks) for n in names], arcs, graph_id))
    nodes, edges = parts[0].nodes, parts[0].edges
    for p in parts[1:]:
        nodes, edges = nodes.unionByName(p.nodes), edges.unionByName(p.edges)
    return g.kept(g.build(g.Graph(nodes, edges))), plain


def _hops(names, arcs, start):
    found, front = {start: 0}, [start]
    while front:
        front = [b for b in dict.fromkeys(b for a, b, *_ in arcs if a in front) if b not in found and not found.update({b: found[front[0]] + 1})]
    return found


def test_reach(many):
    graph, plain = many
    starts = graph.nodes.select("graph_id", F.col("id").alias("start"))
    got = sorted((r.graph_id, r.start, r.node, r.hop) for r in t.reach(graph.edges, starts).collect())
    assert got == sorted((k, s, n, h) for k, (names, arcs, *_) in plain.items() for s in names for n, h in _hops(names, arcs, s).items())
    short = sorted((r.graph_id, r.start, r.node, r.hop) for r in t.reach(graph.edges, starts, 1).collect())
    assert short == [r for r in got if r[3] <= 1]
    sizes = {(r.graph_id, r.source, r.hop): r.nodes for r in t.blast_sizes(graph).collect()}
    rows = [(r.graph_id, r.source, r.hop) for r in t.blast_radius(graph).collect()]
    assert sizes == {k: rows.count(k) for k in set(rows)}


def test_state_rows(spark):
    """200 starts that meet at one hub: the state has a row for each node and word of 64 starts, not one for each start."""
    edges = [("u", f"s{i:03d}", "hub") for i in range(200)] + [("u", "hub" if i == 0 else f"c{i - 1}", f"c{i}") for i in range(20)]
    steps = spark.createDataFrame(edges, "graph_id string, node string, next string")
    starts = bitsets.numbered(spark.createDataFrame([("u", f"s{i:03d}") for i in range(200)], "graph_id string, start string"))
    found = bitsets.search(steps, starts)
    assert found.layers.count() == 200 + 21 * 4 and found.reached().count() == 200 * 22
    assert {(r.hop, r.nodes) for r in found.counts().collect()} == {(h, 1) for h in range(22)}


def test_strong(many):
    graph, plain = many
    want = []
    for k, (names, arcs, *_) in plain.items():
        on = {n: {m for b in {b for a, b, *_ in arcs if a == n} for m in _hops(names, arcs, b)} for n in names}
        want += [(k, n, min(m for m in names if m in on[n] and n in on[m])) for n in names if n in on[n]]
    assert sorted(tuple(r) for r in strong.strong_components(graph.edges).collect()) == sorted(want)


def test_long_chain(spark, monkeypatch):
    """A chain of 10,000 nodes with a ring at its end, a ring apart, and a ladder: rounds grow with the logarithm."""
    rounds, stored = [0], strong.stored
    monkeypatch.setattr(strong, "stored", lambda df: (rounds.__setitem__(0, rounds[0] + 1), stored(df))[1])
    arcs = [(f"{i:05d}", f"{i + 1:05d}") for i in range(10_000)] + [("10000", "r000")] + [(f"r{i:03d}", f"r{(i + 1) % 100:03d}") for i in range(100)]
    arcs += [(f"x{i:03d}", f"x{(i + 1) % 300:03d}") for i in range(300)] + [("a", "a"), ("a", "b")]
    got = strong.strong_components(spark.createDataFrame([("u", a, b) for a, b in arcs], "graph_id string, source string, target string")).collect()
    assert {(r.node, r.component) for r in got} == {(f"r{i:03d}", "r000") for i in range(100)} | {(f"x{i:03d}", "x000") for i in range(300)} | {("a", "a")}
    assert rounds[0] < 40


def test_backward_paths(many, monkeypatch):
    """From the sinks, the paths are those that a search from the sources finds, ties included."""
    graph, _ = many
    assert g.sinks(graph).count() < g.sources(graph).count()
    rows = lambda df: sorted((r.graph_id, r.source, r.sink, r.path_nodes, r.relationships, r.hop_count, r.total_risk, r.severity) for r in df.collect())
    from_sinks = rows(t.attack_paths(graph))
    forth = t.cheapest_paths(graph, g.sources(graph).select("graph_id", F.col("id").alias("start")))
    forth = forth.join(g.sinks(graph).select("graph_id", F.col("id").alias("node")), ["graph_id", "node"], "left_semi")
    assert [(a, b, c, d, round(x, 9)) for a, b, c, d, _, _, x, _ in from_sinks] == sorted((r.graph_id, r.start, r.node, r.path, round(r.cost, 9)) for r in forth.collect())
    assert all(h == len(p) - 1 == len(rel) for _, _, _, p, rel, h, _, _ in from_sinks)


def test_long_path(spark):
    """A path of 100 hops by pointers: as many as doubling needs, and each node once."""
    graph = g.kept(g.build(make(spark, [(f"n{i:03d}", "pod", "x", 1, i < 2, i == 100) for i in range(101)], [(f"n{i:03d}", f"n{i + 1:03d}", "uses", 1) for i in range(100)])))
    got = {r.source: r for r in t.attack_paths(graph).collect()}
    assert got["n000"].path_nodes == [f"n{i:03d}" for i in range(101)] and got["n001"].hop_count == 99 and got["n000"].total_risk == 100.0


def _plain_paths(names, arcs, sources, sinks, cutoff):
    out, open_ = [], [(s,) for s in names if s in sources]
    while open_:
        path = open_.pop()
        if path[-1] in sinks:
            out.append(path)
        if len(path) <= cutoff:
            open_ += [(*path, b) for b in {b for a, b, *_ in arcs if a == path[-1]} if b not in path]
    return out


@pytest.mark.parametrize("cutoff", [15, 5, 4, 1, 0])
def test_simple_paths(many, cutoff):
    """Prefixes and endings that meet give each path once, whatever its length against the cutoff."""
    graph, plain = many
    want = [(k, p[0], p[-1], list(p)) for k, v in plain.items() for p in _plain_paths(*v, cutoff)]
    assert sorted((r.graph_id, r.source, r.sink, r.path_nodes) for r in t.simple_paths(graph, cutoff).collect()) == sorted(want)
    apart = t.simple_paths(graph, cutoff, include_trivial=False).collect()
    assert sorted((r.graph_id, r.path_nodes) for r in apart) == sorted((k, p) for k, _, _, p in want if len(p) > 1)


def test_paths_meet(spark, monkeypatch):
    """All ways over 7 inner nodes that are joined both ways: prefixes end at half of the cutoff, so fewer rows are kept than there are prefixes or paths."""
    inner = [f"m{i}" for i in range(7)]
    arcs = [("s", m, "uses", 1) for m in inner] + [(a, b, "uses", 1) for a, b in itertools.permutations(inner, 2)] + [(m, "t", "uses", 1) for m in inner]
    graph = g.kept(g.build(make(spark, [("s", "pod", "s", 1, 1, 0), *[(m, "pod", m, 1, 0, 0) for m in inner], ("t", "secret", "t", 1, 0, 1)], arcs)))
    kept, stored = [], t.stored
    monkeypatch.setattr(t, "stored", lambda df: (kept.append(out := stored(df)), out)[1])
    found = t.simple_paths(graph, 8)
    arranged = [math.perm(7, k) for k in range(8)]
    assert found.count() == sum(arranged[1:]) and found.select("path_nodes").distinct().count() == sum(arranged[1:])
    rows = sum(df.count() for df in kept if {"path_nodes", "rest"} & set(df.columns))
    assert rows < 2 * sum(arranged[:5]) + sum(arranged[:5]) < sum(arranged[1:]) / 3
    with pytest.raises(RuntimeError):
        t.simple_paths(graph, 8, max_paths=800)


@pytest.mark.parametrize("cutoff", [15, 2])
def test_path_totals(many, cutoff):
    graph, _ = many
    paths = g.stored(t.simple_paths(graph, cutoff))
    want, got = t.PathTotals.of(paths), t.path_totals(graph, cutoff)
    assert sorted(tuple(r) for r in got.through.collect()) == sorted(tuple(r) for r in want.through.collect())
    assert sorted(tuple(r) for r in got.counts.collect()) == sorted(tuple(r) for r in want.counts.collect())
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    if cutoff == 2:
        assert rows(t.critical_nodes(graph, got)) == rows(t.critical_nodes(graph, paths)) and rows(t.node_risk(graph, got)) == rows(t.node_risk(graph, paths))


def test_many_paths_uncounted(spark):
    """A ladder of 14 steps with 3 ways each has 3 ** 14 paths, which are counted without a row for each."""
    nodes = [("s", "pod", "s", 1, 1, 0)] + [(f"{i:02d}{c}", "pod", "x", 1, 0, 0) for i in range(13) for c in "abc"] + [("t", "secret", "t", 1, 0, 1)]
    layers = [["s"], *[[f"{i:02d}{c}" for c in "abc"] for i in range(13)], ["t"]]
    arcs = [(a, b, "uses", 1) for x, y in itertools.pairwise(layers) for a in x for b in y]
    totals = t.path_totals(g.kept(g.build(make(spark, nodes, arcs))))
    assert totals.counts.first().paths == 3**13 and {r.id: r.paths_through for r in totals.through.collect()}["05b"] == 3**12


def test_ranked(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(40), i) for i in range(500)] + [("hot", rng.randrange(5), 1000 + i) for i in range(500)] + [(None, 1, 5000)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(7)
    got = {r.i: r["rank"] for r in ranks.ranked(df, ["k"], [F.desc("x"), F.col("i")]).collect()}
    want = {i: n + 1 for k in ("a", "b", "hot", None) for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])))}
    assert got == want
    assert sorted(r.n for r in ranks.ranked(df, [], [F.col("i")], "n").collect()) == list(range(1, 1002)) and ranks.ranked(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_discard(spark, tmp_path):
    """Only tables that loops have stored are removed, one by one or all."""
    spark.range(3).write.parquet(str(tmp_path / "own"))
    one, two = g.stored(spark.range(5)), g.stored(spark.range(6))
    folders = [f.rpartition("/")[0].removeprefix("file:").replace("//", "/") for f in (one.inputFiles()[0], two.inputFiles()[0])]
    assert all(map(os.path.isdir, folders))
    g.discard(one)
    g.discard(spark.read.parquet(str(tmp_path / "own")))
    assert [os.path.isdir(f) for f in folders] == [False, True] and two.count() == 6 and spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_totals_without_components(spark, monkeypatch):
    """Where no walk is longer than the cutoff, no components are looked for; a count beyond a long raises."""
    monkeypatch.setattr(t, "strong_components", lambda edges: pytest.fail("components"))
    graph = lambda wide: g.kept(g.build(make(spark, [("s", "pod", "s", 1, 1, 0)] + [(f"{i:02d}-{c}", "pod", "x", 1, 0, 0) for i in range(14) for c in range(wide)] + [("t", "secret", "t", 1, 0, 1)], [(a, b, "uses", 1) for x, y in itertools.pairwise([["s"], *[[f"{i:02d}-{c}" for c in range(wide)] for i in range(14)], ["t"]]) for a in x for b in y])))
    totals = t.path_totals(graph(2))
    assert totals.counts.first().paths == 2**14 and {r.id: r.paths_through for r in totals.through.collect()}["05-1"] == 2**13
    with pytest.raises(Exception, match="long"):
        t.path_totals(graph(24)).counts.collect()


def test_outline(spark, sf_dir):
    """The ends and places of the edges that build gives."""
    from bramble.sources import views

    columns = ["graph_id", "edge_seq", "source", "target"]
    for raw in (views.event_graphs(spark, sf_dir), views.supply_graph(spark, sf_dir)):
        assert sorted(map(tuple, g.outline(raw).edges.select(columns).collect())) == sorted(map(tuple, g.build(raw).edges.select(columns).collect()))


def test_small_broadcasts(spark, tmp_path):
    """While a table is stored, sides of over SMALL bytes are not broadcast, whatever the session allows; its settings come back."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    for i in "ab":
        spark.range(200_000).selectExpr("id", "hash(id) as x").write.parquet(str(tmp_path / i))
    both = lambda: spark.read.parquet(str(tmp_path / "a")).join(spark.read.parquet(str(tmp_path / "b")), "id")._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(name)
    assert "BroadcastHashJoin" in both()
    with g._small_broadcasts(spark):
        assert "BroadcastHashJoin" not in both()
    assert spark.conf.get(name) == before and spark.conf.get(name, None) is None
    try:
        for value in ("-1", "64k"):
            spark.conf.set(name, value)
            with g._small_broadcasts(spark):
                assert spark.conf.get(name) == value
            assert spark.conf.get(name) == value
    finally:
        spark.conf.unset(name)


def test_implicit_before_join(spark, sf_dir):
    """Rows that name an id are aggregated before they meet the known ids, so that no task sorts all rows of a group that every binding names."""
    from bramble.sources import k8s, views

    dumps = views.list_dumps(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = k8s.implicit_nodes(dumps, k8s.extracted_nodes(dumps))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 <= plan.index("Join LeftAnti") < plan.index("Aggregate")


def test_attack_costs(spark, monkeypatch):
    """Costs without paths are those of the attack paths, from priced tables with a repeated node, parallel edges and edges to and from missing nodes; steps are shuffled once for all rounds."""
    nodes = [("s", "pod", "s", 1, 1, 0), ("r", "pod", "r", 1, 1, 0), ("m", "pod", "m", 1, 0, 1), ("e", "pod", "e", 1, 0, 1), ("m", "pod", "m", 1, 0, 0)]
    edges = [("s", "m", "uses", 3), ("s", "m", "uses", 1), ("s", "m", "grants", 4), ("m", "e", "uses", 0.1), ("r", "gone", "uses", 0), ("gone", "e", "uses", 0), ("r", "s", "uses", 0.2), ("e", "e", "uses", 0)]
    raw = make(spark, nodes, edges)
    columns = ["graph_id", "source", "sink", "hop_count", "total_risk", "severity"]
    calls, real = [], t.dealt
    monkeypatch.setattr(t, "dealt", lambda df, *keys: calls.append(keys) or real(df, *keys))
    want = {("u", "s", "e", 2, 0.0 + 4 + 0.1, "LOW"), ("u", "r", "e", 3, 0.0 + 0.2 + 4 + 0.1, "LOW")}
    assert {tuple(r) for r in t.attack_costs(g.priced(raw)).collect()} == want and calls == [("graph_id", "node")]
    assert {tuple(r) for r in t.attack_paths(g.build(raw)).select(columns).collect()} == want


def test_detailed_cycles(spark, monkeypatch):
    """Details that grow with cycles are those that are looked up after: the first of equal edges is cut, weights of -1 and less and unknown ones don't count; then nothing is looked up again, nor a graph with cycles searched for more."""
    arcs = [("a", "b", "uses", 2), ("b", "c", "grants", 2), ("c", "a", "mounts", 1), ("b", "a", "uses", -1), ("c", "c", "uses", -2), ("c", "b", "uses", 3), ("d", "d", "uses", 5), ("a", "d", "uses", 9)]
    graph = make(spark, [(n, "pod", None if n == "b" else n.upper(), 1, 0, 0) for n in "abcd"], arcs)
    line = make(spark, [("x", "pod", "x", 1, 0, 0), ("y", "pod", "y", 1, 0, 0)], [("x", "y", "uses", 1)], "line")
    graph = g.kept(g.Graph(graph.nodes.unionByName(line.nodes), graph.edges.withColumn("weight", F.when(F.col("edge_seq") != 3, F.col("weight"))).unionByName(line.edges)))
    plain, detailed = g.stored(t.cycles(graph)), g.stored(t.cycles(graph, detailed=True))
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    want = [rows(plain), rows(t.with_cycle_names(graph, plain)), rows(t.break_edges(graph, plain)), rows(advise.cycle_remediation(graph, plain)), rows(t.is_dag(graph))]
    searched = []
    monkeypatch.setattr(t, "cycle_edges", None)
    monkeypatch.setattr(t, "strong_components", lambda edges: searched.append({r.graph_id for r in edges.collect()}) or strong.strong_components(edges))
    assert len(want[0]) == 5 and len(want[2]) == 4
    assert [rows(detailed.drop("cycle_names", "top")), rows(detailed.drop("top")), rows(t.break_edges(graph, detailed)), rows(advise.cycle_remediation(graph, detailed)), rows(t.is_dag(graph, detailed))] == want
    assert searched == [{"line"}]
