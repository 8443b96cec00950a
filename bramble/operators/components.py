"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from bramble.operators.graph import cut_lineage

#: A node with more than this share of all edges is a hub, so there are at most 2 / HUB hubs; and with fewer edges than FEW none is.
HUB, FEW = 1e-4, 256


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """rows joined with found, which has a row for each value of the keys, n being the rows that have it.

    Values of more than HUB of the rows, of which there are at most 1 / HUB, are sent to all tasks; so no key is hot.
    """
    found = cut(found)
    most = max(FEW, int(HUB * (found.agg(F.sum("n")).first()[0] or 0)))
    hot, rest = found.where(F.col("n") > most).drop("n"), found.where(F.col("n") <= most).drop("n")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, n), a row for each u. The few u with over `most` edges are looked up in all tasks, and their edges are dealt by v, so no key is hot."""
    hubs = least.where(F.col("n") > most).select("u", F.col("m").alias("hub"))
    edges = edges.join(F.broadcast(hubs), "u", "left").withColumn("key", F.when(F.col("hub").isNull(), F.col("u")).otherwise(F.col("v")))  # 2 / HUB rows at most
    return edges.join(least.select(F.col("u").alias("key"), "m"), "key", "left").select("u", "v", F.coalesce("hub", "m").alias("m"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, most).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int = 60) -> DataFrame:
    """(node, component) for each end of the edges (u, v); component is the smallest node that u reaches.

    Each round is two joins on a node, of which one side has a row a node; hubs are joined apart.
    The count of rounds grows with the logarithm of the diameter. `cut` cuts the lineage of a round.
    """
    edges = cut(edges.where("u != v").select("u", "v").distinct())
    before = _mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        most = max(FEW, int(HUB * before[0]))  # the large star has each edge twice, and so has 2 / HUB hubs at most
        edges = cut(_small_star(_large_star(edges, most), most))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
