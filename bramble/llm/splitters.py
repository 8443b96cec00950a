"""Ranges of about equal weight over sorted keys, from sampled splitters.

Splitters come in two levels, so that their number can follow the data: a few outer ones, quantiles of a
long column, are literals and cut the keys into blocks; the inner ones of each block are a row of a table that records are
joined with by block. Inner splitters may be structs, which also divide a long that very many records share.
A range's number has its block in the upper 32 bits, so numbers ascend with the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from bramble.llm.common import cut_lineage

#: Outer splitters at most; samples for each range; inner splitters that are looked through one by one.
BLOCKS, SAMPLES, CHUNK = 256, 16, 64
#: Ranges up to which tables of a row a range may be broadcast (some 60 MB).
FEW_RANGES = 2_000_000


def boundaries(values: DataFrame, column: str, ranges: int) -> list[int]:
    """At most ranges - 1 distinct inner quantiles of a column of longs, for few ranges."""
    if ranges < 2:
        return []
    found = values.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("q")).first().q
    return sorted(set(found or []))


def _at_most(sorted_: Column, value: Column) -> Column:
    return F.size(F.filter(sorted_, lambda b: b <= value))


@dataclass
class Ranges:
    """What range_of needs; count is that of the ranges asked for."""

    outer: list[int]
    inner: DataFrame
    count: int

    def small(self, df: DataFrame) -> DataFrame:
        """Marks a table of a few rows a range for broadcast while there are few ranges; else Spark joins it by shuffling."""
        return F.broadcast(df) if self.count <= FEW_RANGES else df

    def block_of(self, first: Column) -> Column:
        return _at_most(F.array(*[F.lit(b) for b in self.outer]), first) if self.outer else F.lit(0)

    def with_range(self, df: DataFrame, first: Column, key: Column, name: str = "__r") -> DataFrame:
        """df with the number of each record's range, by its first long and its whole key."""
        df = df.withColumn("__block", self.block_of(first)).join(self.small(self.inner), "__block", "left")
        chunk = _at_most(F.transform("__bounds", lambda c: c[0]), key)
        within = F.when(F.col("__bounds").isNull() | (chunk == 0), 0).otherwise((chunk - 1) * CHUNK + _at_most(F.get("__bounds", chunk - 1), key))
        return df.withColumn(name, F.shiftleft(F.col("__block").cast("long"), 32) + within).drop("__block", "__bounds")


def ranges(records: DataFrame, first: str, key: Column, weight: str, total: int, count: int) -> Ranges:
    """About `count` ranges of equal weight; records have a long `first`, which the key begins with, and a weight.

    Each record is drawn by itself, with a chance in proportion to its weight; the sample is written out once.
    """
    chance = F.col(weight) * F.lit(SAMPLES * count / max(total, 1))
    drawn = records.select(F.col(first).alias("__first"), key.alias("__key"), chance.alias("__chance"))
    drawn = cut_lineage(drawn.where(F.rand(1) < F.col("__chance")).drop("__chance"))
    found = Ranges(boundaries(drawn, "__first", min(BLOCKS, count // SAMPLES)), drawn, count)
    # A key that is drawn very often is one row with its number.
    keys = drawn.groupBy("__first", "__key").agg(F.count("*").alias("n")).withColumn("__block", found.block_of(F.col("__first")))
    upto = F.sum("n").over(Window.partitionBy("__block").orderBy("__key"))
    full = F.floor(F.col("__upto") / SAMPLES) > F.floor((F.col("__upto") - F.col("n")) / SAMPLES)
    bounds = keys.withColumn("__upto", upto).where(full).groupBy("__block").agg(F.sort_array(F.collect_list("__key")).alias("all"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / CHUNK).cast("int")), lambda i: F.slice("all", i * CHUNK + 1, F.lit(CHUNK)))
    found.inner = cut_lineage(bounds.select("__block", chunks.alias("__bounds")))
    return found


def running(df: DataFrame, group: list[str], range_: str, order: list[str], value: str, name: str) -> DataFrame:
    """df (some rows a range) with the sum of a column over all rows before, in each group; no task sees more than a block's rows."""
    block = F.shiftright(F.col(range_), 32)
    df = df.withColumn("__b", block)
    up = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "__b").agg(F.sum(value).alias("__sum"))  # BLOCKS rows a group at most
    sums = sums.select(*group, "__b", F.coalesce(F.sum("__sum").over(up(group or [F.lit(0)], ["__b"])), F.lit(0)).alias("__earlier"))
    inside = F.coalesce(F.sum(value).over(up([*group, "__b"], [F.col(c).asc_nulls_first() for c in order])), F.lit(0))
    return df.withColumn(name, inside).join(F.broadcast(sums), [*group, "__b"]).withColumn(name, F.col(name) + F.col("__earlier")).drop("__b", "__earlier")
