"""Ranks in large groups, by ranges of the sort key that many tasks sort apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bramble.operators.graph import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in its group.

    Rows are range-partitioned and sorted by group and order; a row's place is the number of its group's rows in earlier partitions
    and before it in its own. So no task holds a group, only a share of all rows. Rows equal in group and order are told apart by
    their place in a task; add a column to the order where that matters, and where very many rows may be equal.
    """
    keys = [F.col(c) for c in group] + order
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    laid = cut_lineage(laid.withColumn("__part", F.shiftright("__at", _ROW_BITS)))
    own = ["__part", *(f"__g{i}" for i in range(len(group)))]
    named = {c: f"__g{i}" for i, c in enumerate(group)}
    each = laid.groupBy("__part", *[F.col(c).alias(n) for c, n in named.items()]).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*(own[1:] or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    each = each.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n").withColumnRenamed("__part", "__p")
    same = F.col("__part") == F.col("__p")
    for c, n in named.items():
        same &= F.col(c).eqNullSafe(F.col(n))
    out = laid.join(each if group else F.broadcast(each), same)  # without groups each has a row a partition
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).select(*df.columns, name)
