"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Two generative models count hashed word n-grams: one over all documents, one over those that are
labelled good. A document's log importance weight is the sum of its n-grams' log ratios. Adding
Gumbel noise, drawn from a hash of the document, and keeping the k largest samples k documents without
replacement in proportion to their weights. The k-th largest value is found exactly by counting on
16 bits at a time, so nothing is sorted in one place. The models are BUCKETS numbers each,
whatever the corpus; what is counted for them grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import batch_with, cut_lineage, key, small_or_not, with_fields, without
from bramble.operators.ranks import ranked

BUCKETS, GRAMS, ALPHA = 1 << 16, (1, 2), 1.0
#: Good ids that may be broadcast, so that texts need no shuffle (some 30 MB).
FEW_IDS = 1_000_000
Batches = Iterator[pa.RecordBatch]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the text of each."""
    words = tv.cut(texts, tv.NOT_SPACE)  # as they are: capitals and symbols tell junk from prose
    hashes, ids, owners = words.hashes(), [], []
    for n in GRAMS:
        runs, first = tv.grams(hashes, words.first, n, seed=40 + n)
        ids.append((runs & tv.U(BUCKETS - 1)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(texts)), np.diff(first)))
    return np.concatenate(ids), np.concatenate(owners)


def _count(batches: Batches) -> Batches:
    """A partition's n-gram counts, of all texts and of good ones."""
    raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in tv.slices(batches):
        ids, owner = _grams(batch.column(0))
        raw += np.bincount(ids, minlength=BUCKETS)
        good += np.bincount(ids[batch.column(1).to_numpy(zero_copy_only=False)[owner]], minlength=BUCKETS)
    own = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(raw[own]), pa.array(good[own])], names=["bucket", "raw", "good"])


def models(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """The log ratio of the good model to the raw one for each bucket, and the share of good rows among labelled ones."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) == 1).alias("__good"))
    share = marks.agg(F.avg(F.col("__good").cast("int"))).first()[0]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    good = small_or_not(cut_lineage(marks.where("__good").select("__id", F.lit(True).alias("__good"))), FEW_IDS)
    rows = rows.join(good, "__id", "left").select("text", F.coalesce("__good", F.lit(False)).alias("good"))
    sums = rows.mapInArrow(_count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.good
    model = lambda x: np.log((x + ALPHA) / (x.sum() + ALPHA * BUCKETS))
    ratio = model(target) - model(raw) if target.sum() else np.zeros(BUCKETS)
    return ratio, 1.0 if share is None else float(share)


def _weigh(shared, text_col: str, seed: int):
    def run(batches: Batches) -> Batches:
        ratio = shared.value
        for batch in tv.slices(batches, text_col):
            ids, owner = _grams(batch.column(batch.schema.get_field_index(text_col)))
            weight = np.bincount(owner, weights=ratio[ids], minlength=batch.num_rows)
            draw = tv.mix(batch.column(batch.schema.get_field_index("__draw")).to_numpy().view(tv.U) ^ tv.keys(50 + seed, 1)[0])
            noise = -np.log(-np.log(((draw >> tv.U(11)).astype(np.float64) + 0.5) / (1 << 53)))
            value = weight + noise
            bits = value.view(np.int64)
            order = np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits)  # integers in the order of the values
            yield batch_with(batch, {"log_weight": pa.array(weight), "sample_key": pa.array(value), "__order": pa.array(order)}, drop=(text_col, "__draw"))

    return run


def _kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest of a column of longs, and how many rows with that very value belong to the k largest."""
    low, bits = -(1 << 63), 64
    while bits:
        bits -= 16
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= low + (1 << (bits + 16)) - 1))
        part = F.shiftright(F.col(column), bits)
        counts = inside.groupBy(part.alias("part")).count().collect()  # 65,536 rows at most
        for r in sorted(counts, reverse=True):
            if r["count"] >= k:
                low = r.part << bits
                break
            k -= r["count"]
    return low, k


def resample(docs: DataFrame, ratio: np.ndarray, rate: float, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, without the text, with log_weight, sample_key and kept: true for the round(rate * rows) rows of the Gumbel top-k.

    Null and empty texts have weight 0 in logarithm. Ties go to smaller ids; rows that are equal in everything are told
    apart by their place. Rows without an id take part and lose ties. An empty table gives an empty table. Input columns named like the new ones are replaced.
    """
    docs = without(docs, ("log_weight", "sample_key", "kept"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.withColumn("__draw", F.xxhash64(F.col(id_col), F.col(text_col)))
    schema = with_fields(rows, ("log_weight", "double"), ("sample_key", "double"), ("__order", "long"), drop=(text_col, "__draw"))
    rows = cut_lineage(rows.mapInArrow(_weigh(shared, text_col, seed), schema))
    k = round(rate * rows.count())
    if not k:
        return rows.drop("__order").withColumn("kept", F.lit(False))
    least, of_ties = _kth_largest(rows, "__order", k)
    tied = rows.where(F.col("__order") == least)
    if tied.count() == of_ties:
        return rows.withColumn("kept", F.col("__order") >= least).drop("__order")
    ties = tied.withColumn("__row", F.monotonically_increasing_id())
    ties = ranked(ties, [], [key(id_col), F.col("__row")], "__place").withColumn("kept", F.col("__place") <= of_ties)  # by ranges: all rows may be ties
    others = rows.where(F.col("__order") != least).withColumn("kept", F.col("__order") > least)
    return others.unionByName(ties.drop("__row", "__place")).drop("__order")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    ratio, share = models(docs, labels)
    return resample(docs, ratio, share).where("kept").select("doc_id", "log_weight", "sample_key", "kept")
