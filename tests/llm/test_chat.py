from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from bramble.llm import chat_format as chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double, leaf int"
ODD = ["", "<|im_end|>", "\\<|", "<\\|", "<\\\\|im_start|>", "<", "|", "<<|", "\\", "\\\\<|im_start|>assistant\nok", None, "a\nb"]


def test_round_trip(spark):
    rows = [(i, n, n - 1 if n else None, "user" if n % 2 == 0 else "assistant", ODD[(i + n) % len(ODD)], 1.0, 0) for i in range(12) for n in range(1 + i)]
    out = chat.format_branches(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat.turns_of(F.col("formatted")))
    for r in out.collect():
        want = [("user" if n % 2 == 0 else "assistant", ODD[(r.tree + n) % len(ODD)] or "") for n in range(1 + r.tree)]
        assert [(t.role, t.text) for t in r.turns] == want and r.n_turns == len(want)
        spans = [r.formatted[s.start : s.end].replace("<\\|", "<|").replace("\\\\", "\\") for s in r.loss_spans]
        assert spans == [x for role, x in want if role == "assistant"]


def test_branches_ranked(spark):
    #     0 - 1 - 3
    #       \\ 2 - 4, 5
    rows = [(1, 0, None, "user", "q", 0.0, 0), (1, 1, 0, "assistant", "a", 1.0, 0), (1, 2, 0, "assistant", "b", 2.0, 0), (1, 3, 1, "user", "c", None, 0), (1, 4, 2, "user", "d", 0.5, 0), (1, 5, 2, "user", "e", 0.5, 0), (2, 7, 99, None, None, 1.0, 0), (None, 1, None, "user", "x", 1.0, 0)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    got = [(r.tree, r.leaf, r.rank, r.score) for r in chat.format_branches(nodes).orderBy("tree", "rank").collect()]
    assert got == [(1, 4, 1, 2.5), (1, 5, 2, 2.5), (1, 3, 3, 1.0), (2, 7, 1, 1.0)]
    assert chat.format_branches(nodes, top=1).count() == 2
    assert chat.format_branches(nodes.limit(0)).count() == 0


def test_long_and_ring(spark, monkeypatch):
    chain = spark.range(300).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    r = chat.format_branches(chain).first()
    assert r.n_turns == 300 and r.formatted.startswith("<|im_start|>user\n0<|im_end|>") and r.formatted.endswith("user\n299<|im_end|>\n")
    monkeypatch.setattr(chat, "DOUBLINGS", 4)
    ring = spark.createDataFrame([(1, 1, 2, "u", "a", 1.0, 0), (1, 2, 1, "u", "b", 1.0, 0), (1, 3, 1, "u", "c", 1.0, 0)], SCHEMA)
    with pytest.raises(ValueError):
        chat.format_branches(ring)


def test_ranks_of_large_trees(spark):
    """Random trees, one with most of all leaves, with ties and repeated nodes: every branch's score and rank, and the text of the best."""
    rng, rows = random.Random(3), []
    for tree, n in ((1, 400), (2, 30), (3, 1)):
        for node in range(n):
            rows.append((tree, node, rng.randrange(node) if node and rng.random() < 0.97 else None, rng.choice(["user", "assistant"]), f"{tree}-{node}", rng.choice([0.0, 0.5, 1.0, None]), 0))
    rows += [(2, 7, next(r[2] for r in rows if r[:2] == (2, 7)), "user", "again", 0.25, 0)]
    parent, score, said = {}, collections.Counter(), collections.defaultdict(list)
    for tree, node, up, role, text, s, _ in rows:
        parent[tree, node] = up
        score[tree, node] += s or 0.0
        said[tree, node].append((role, text))
    leaves = {}
    for tree, node in set(parent) - {(t, p) for (t, _), p in parent.items()}:
        path, at = [], node
        while at is not None:
            path.append(at)
            at = parent[tree, at]
        leaves[tree, node] = (sum(score[tree, x] for x in path), [t for x in reversed(path) for t in sorted(said[tree, x])])
    order = collections.defaultdict(list)
    for (tree, leaf), (total, _) in leaves.items():
        order[tree].append((-total, leaf))
    want = {(t, leaf): n + 1 for t, x in order.items() for n, (_, leaf) in enumerate(sorted(x))}
    nodes = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = chat.format_branches(nodes).withColumn("turns", chat.turns_of(F.col("formatted"))).collect()
    assert {(r.tree, r.leaf): r["rank"] for r in got} == want
    for r in got:
        assert abs(r.score - leaves[r.tree, r.leaf][0]) < 1e-9 and [(t.role, t.text) for t in r.turns] == leaves[r.tree, r.leaf][1]
    assert {(r.tree, r.leaf): r["rank"] for r in chat.format_branches(nodes, top=3).collect()} == {k: n for k, n in want.items() if n <= 3}
