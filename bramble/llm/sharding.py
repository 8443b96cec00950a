"""Sharding by sampled splitters: near-equal bytes, equal texts together, built of DataFrame operations only.

Records are ordered by a hash of their text. A sample weighted by size gives the boundaries of many small
ranges, whose number follows the bytes; exact sums of each range then tell which are overfull. A text
whose copies alone overfill a range is divided by its documents, any other overfull range by
its texts. The pieces of a text stay in one shard, unless its copies exceed a shard's share: the few texts
that take a large part of a share are placed first, largest first, where least is; all else
fills the shards up in the order of the pieces. A slot is the piece's first slot plus the place in the piece, so that no task ever
sorts a whole shard.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

from bramble.llm import splitters
from bramble.llm.common import cut_lineage, key, without

#: Ranges for each shard at least; bytes and rows of a range at most; parts of a share from which a text's copies are placed first.
RANGES, BYTES, ROWS, PARTS = 256, 1 << 26, 1_000_000, 64


def placed_first(groups: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """The shard of each (text, bytes), largest first where least is, and the bytes of each shard then."""
    loads, found = [0] * shards, {}
    for size, text in sorted(((b, h) for h, b in groups), reverse=True):
        found[text] = min(range(shards), key=lambda s: (loads[s], s))
        loads[found[text]] += size
    return found, loads


def filled_up(loads: list[int], rest: int) -> list[float]:
    """How much of the rest lies before each shard's part of it, if all are filled to one level as far as may be."""
    low = sorted(loads)
    level = min((rest + sum(low[:n])) / n for n in range(1, len(low) + 1))
    room = [max(0.0, level - x) for x in loads]
    return [sum(room[:s]) for s in range(len(room))]


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, law, shard, slot and grown_shard.

    The law is `bytes`: the sum of size (UTF-8 bytes of the text plus 1) is nearly equal in all
    shards; slots are gapless from 0. Equal texts share a shard unless their bytes exceed a shard's share
    (all bytes over the number of shards). grown_shard is null under this law.

    Null texts count as empty. Rows without an id, with an equal id, or repeated are rows like any other: each gets its
    own slot. An empty table gives an empty table. Input columns named like the new ones are replaced.
    """
    docs = without(docs, ("size", "law", "shard", "slot", "grown_shard"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__h": F.xxhash64(text), "__doc": key(id_col), "size": F.octet_length(text).cast("long") + 1})
    light = cut_lineage(rows.select("__h", "__doc", "size"))
    total, count = light.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = max(1, shards * RANGES, -(-total // BYTES), -(-count // ROWS))
    target, share = max(1, total // n), total / shards
    found = splitters.ranges(light, "__h", F.struct("__h"), "size", total, n)

    light = cut_lineage(found.with_range(light, F.col("__h"), F.struct("__h")))
    full = light.groupBy("__r").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(1.5 * target))
    groups = cut_lineage(light.join(found.small(full.select("__r")), "__r").groupBy("__r", "__h").agg(F.sum("size").alias("bytes")))
    heavy = groups.where(F.col("bytes") > target)  # fewer rows than ranges, as each has a range's bytes
    large = heavy.where((F.col("bytes") > share / PARTS) & (F.col("bytes") <= share)).select("__h", "bytes").collect()  # fewer than shards * PARTS rows
    first, loads = placed_first([tuple(r) for r in large], shards)
    spread = F.from_json(F.lit(json.dumps([{"h": h, "s": s} for h, s in first.items()])), "array<struct<h: long, s: int>>")
    fixed = light.sparkSession.range(1).select(F.explode(spread).alias("x")).select(F.col("x.h").alias("__h"), F.col("x.s").alias("__first"))
    heavy = heavy.select("__h", F.ceil(F.col("bytes") / target).cast("int").alias("__parts"), (F.col("bytes") <= share).alias("__whole"))
    heavy = cut_lineage(heavy.join(F.broadcast(fixed), "__h", "left"))
    rest = cut_lineage(groups.where(F.col("bytes") <= target).groupBy("__r").agg(F.ceil(F.sum("bytes") / target).cast("int").alias("__split")))

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(found.small(heavy), "__h", "left").join(found.small(rest), "__r", "left")
        by_doc = F.pmod(F.xxhash64(F.lit("part"), "__doc"), F.col("__parts")).cast("int")
        by_text = F.pmod(F.xxhash64(F.lit("part"), "__h"), F.coalesce("__split", F.lit(1))).cast("int")
        return df.withColumns({"__at": F.when(F.col("__parts").isNotNull(), F.col("__h")), "__sub": F.coalesce(by_doc, by_text)}).drop("__parts", "__split")

    piece = ["__r", "__at", "__sub"]
    sums = placed(light).groupBy(*piece, "__whole", "__first").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    sums = cut_lineage(sums.withColumn("__unit", F.when(F.coalesce("__whole", F.lit(False)), -1).otherwise(F.col("__sub"))))  # -1: all pieces of a text
    units = sums.where("__first is null").groupBy("__r", "__at", "__unit").agg(F.sum("bytes").alias("bytes"))
    units = splitters.running(units, [], "__r", ["__r", "__at", "__unit"], "bytes", "before")
    starts = filled_up(loads, total - sum(b for _, b in large))
    middle = F.col("before") + F.col("bytes") / 2
    units = units.select("__r", "__at", "__unit", (F.size(F.filter(F.array(*[F.lit(float(s)) for s in starts]), lambda s: s <= middle)) - 1).alias("__filled"))
    same = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sums = sums.select("__r", same("__at"), "__sub", "__unit", "n", "__first").join(units.select("__r", same("__at"), "__unit", "__filled"), ["__r", "__at", "__unit"], "left")
    sums = sums.withColumn("shard", F.coalesce("__first", "__filled"))
    sums = cut_lineage(splitters.running(sums, ["shard"], "__r", piece, "n", "__from").select(*piece, "shard", "__from"))

    out = placed(found.with_range(rows, F.col("__h"), F.struct("__h"))).drop("__whole", "__first").withColumn("__at", same("__at"))
    out = out.join(found.small(sums), piece)
    order = Window.partitionBy(*piece).orderBy("__doc", "__h")
    out = out.withColumns({"slot": F.col("__from") + F.row_number().over(order) - 1, "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.drop("__h", "__doc", "__r", "__at", "__sub", "__from")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
