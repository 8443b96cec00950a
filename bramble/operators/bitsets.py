"""Searches from many starts at once: a row of the state stands for up to 64 starts, one bit each.

The starts of a graph are numbered; start number p is bit p % 64 of word p // 64. A round joins the newest bits with the edges, merges what arrives at
a node by bit_or, and takes away the bits that the node has already. So a search has at most nodes x starts / 64 rows for each graph, where
a row for each pair of start and node would be 64 times as many, and starts that travel together move together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bramble.operators.graph import stored
from bramble.operators.ranks import ranked

BITS = 64
KEYS = ["graph_id", "node", "word"]


def word_of(place: Column) -> Column:
    return F.shiftright(place, 6)


def bit_of(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(BITS - 1)).cast("int"))


@dataclass(frozen=True)
class Search:
    """starts (graph_id, start, place) and layers (graph_id, node, word, bits, hop): the starts that reach a node with so many hops and no fewer."""

    starts: DataFrame
    layers: DataFrame

    def _each(self) -> DataFrame:
        """(graph_id, node, hop, place): a row for each bit."""
        bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("shiftrightunsigned", F.col("bits"), b).bitwiseAND(F.lit(1)) == 1)
        return self.layers.select("graph_id", "node", "hop", F.explode(F.transform(bits, lambda b: F.col("word") * BITS + b)).alias("place"))

    def reached(self) -> DataFrame:
        """(graph_id, start, node, hop)."""
        return self._each().join(self.starts, ["graph_id", "place"]).select("graph_id", "start", "node", "hop")

    def counts(self) -> DataFrame:
        """(graph_id, start, hop, nodes): counted before names are looked up."""
        return self._each().groupBy("graph_id", "place", "hop").agg(F.count("*").alias("nodes")).join(self.starts, ["graph_id", "place"]).select("graph_id", "start", "hop", "nodes")


def numbered(starts: DataFrame) -> DataFrame:
    """(graph_id, start, place): the distinct starts of each graph numbered from 0, in order, over many tasks."""
    return ranked(starts.select("graph_id", "start").distinct(), ["graph_id"], [F.col("start")], "place").withColumn("place", F.col("place") - 1)


def below(word: Column, place: Column) -> Column:
    """The bits of a word that stand for starts numbered below a place."""
    own = word_of(place)
    return F.when(word < own, F.lit(-1).cast("long")).when(word > own, F.lit(0).cast("long")).otherwise(bit_of(place) - 1)


def search(steps: DataFrame, starts: DataFrame, max_hops: int | None = None, mask: Column | None = None) -> Search:
    """From starts (graph_id, start, place) along steps (graph_id, node, next), without repeats; the starts themselves are at hop 0.

    mask, over word and columns that steps may have besides, has the bits that may take a step.
    """
    first = starts.select("graph_id", F.col("start").alias("node"), word_of(F.col("place")).alias("word"), bit_of(F.col("place")).alias("bits"))
    first = first.groupBy(*KEYS).agg(F.bit_or("bits").alias("bits"))
    front = stored(first.withColumn("hop", F.lit(0)))
    layers, hop = front, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        bits = F.col("bits") if mask is None else F.col("bits").bitwiseAND(mask)
        moved = front.join(steps, ["graph_id", "node"]).select("graph_id", F.col("next").alias("node"), "word", bits.alias("bits")).where("bits != 0")
        arrived = moved.groupBy(*KEYS).agg(F.bit_or("bits").alias("bits"))
        seen = layers.groupBy(*KEYS).agg(F.bit_or("bits").alias("seen"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        front = stored(arrived.join(seen, KEYS, "left").select(*KEYS, fresh.alias("bits")).where("bits != 0").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        layers = layers.unionByName(front)
    return Search(starts, layers)
