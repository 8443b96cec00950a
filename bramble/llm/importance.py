"""Importance resampling towards a target distribution, with bit-sliced sums of gains.

Features are runs of words, hashed into BUCKETS by their CRC-32. What a bucket gains is the scaled logarithm of its share among the target's
features over its share among the corpus's, a whole number. A document's weight is the floored mean of its features' gains.
The sum is taken bit by bit: bit j of a document's bucket counts is a plane of BUCKETS bits, and so is bit k of the positive gains,
and of the negative ones. The plane of j AND that of k has a one for each bucket that adds 2 ** (j + k), so popcounts times powers of
two give the exact sum, with no number per bucket and document in between.

Bucket counts are BUCKETS numbers, counted over all documents; their gains are sent to all tasks. Gumbel noise from a hash of seed and id turns
the highest scores into a draw without replacement; they are ranked over many tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import batch_with, cut_lineage, key, table, with_fields, without
from bramble.operators.ranks import ranked

BUCKETS = 10_000
#: Words that a document needs to be drawn; percent of such documents that are.
LEAST_WORDS, PERCENT = 20, 10
Batches = Iterator[pa.RecordBatch]
_WORD = 64


def _crc_table() -> np.ndarray:
    """What CRC-32 adds for each byte, by its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after so many bytes each from these starts."""
    order = np.argsort(-lengths, kind="stable")
    state, starts, lengths = state[order], starts[order], lengths[order]
    for at in range(int(lengths[0]) if len(lengths) else 0):
        n = np.searchsorted(-lengths, -at, side="left")  # those with more bytes than that
        own = state[:n]
        state[:n] = _CRC[(own ^ data[starts[:n] + at]) & 0xFF] ^ (own >> 8)
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: pa.Array, grams: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature of each text, the text that each belongs to, and each text's count of words."""
    words = tv.cut(texts, tv.ALNUM, lower=True)
    lengths, owner = words.ends - words.starts, words.text_of_word()
    state, found, owners = np.full(len(lengths), 0xFFFFFFFF, dtype=np.uint32), [], []
    for n in range(1, grams[1] + 1):
        if n > 1:  # a run of n words is one of n - 1, a space and the next word
            state = state[:-1]
            state = _CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8)
        state = _fed(state, words.data, words.starts[n - 1 :], lengths[n - 1 :])
        if n >= grams[0]:
            inside = owner[n - 1 :] == owner[: len(state)]
            found.append((~state[inside]).astype(np.int64) % buckets)
            owners.append(owner[: len(state)][inside])
    return np.concatenate(found), np.concatenate(owners), words.counts


def _count(grams: tuple[int, int], buckets: int) -> Callable[[Batches], Batches]:
    """A partition's features in each bucket."""

    def run(batches: Batches) -> Batches:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in tv.slices(batches):
            counts += np.bincount(features(batch.column(0), grams, buckets)[0], minlength=buckets)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds."""
    out = np.zeros(buckets, dtype=np.int64)
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(grams, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: a thousand logarithms of its smoothed share in the target over that in the corpus, floored."""
    all_, wanted, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_ + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def planes_of(values: np.ndarray) -> np.ndarray:
    """The bits of whole numbers from 0 on: a row of 64-bit words for each power of two, a bit in it for each number."""
    bits, width = int(values.max(initial=0)).bit_length(), -(-len(values) // _WORD)
    out = np.zeros((bits, width * _WORD), dtype=np.uint8)
    for k in range(bits):
        out[k, : len(values)] = (values >> k) & 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def bit_sums(owner: np.ndarray, bucket: np.ndarray, texts: int, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Of each text, the sum of the gains of its features, from planes of its bucket counts and of the gains."""
    width, total = plus.shape[1], np.zeros(texts, dtype=np.int64)
    cell, n = np.unique(owner * (width * _WORD) + bucket, return_counts=True)
    for j in range(int(n.max(initial=0)).bit_length()):
        some = cell[(n >> j) & 1 == 1]
        row, at = np.unique(some // (width * _WORD), return_inverse=True)  # texts that have that bit anywhere
        count = np.zeros(len(row) * width, dtype=np.uint64)
        inside = some % (width * _WORD)
        np.bitwise_or.at(count, at * width + inside // _WORD, np.uint64(1) << (inside % _WORD).astype(np.uint64))
        count = count.reshape(len(row), width)
        for sign, planes in ((1, plus), (-1, minus)):
            for k, plane in enumerate(planes):
                total[row] += sign * (np.bitwise_count(count & plane).sum(axis=1, dtype=np.int64) << (j + k))
    return total


def _noise(seed: int, id_: int | None) -> int:
    """Gumbel noise from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(shared, grams: tuple[int, int], buckets: int, seed: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        gain = shared.value
        plus, minus = (np.ascontiguousarray(planes_of(np.maximum(x, 0))) for x in (gain, -gain))
        for batch in tv.slices(batches, "__text"):
            bucket, owner, words = features(batch.column(batch.schema.get_field_index("__text")), grams, buckets)
            n = np.bincount(owner, minlength=batch.num_rows)
            weight = bit_sums(owner, bucket, batch.num_rows, plus, minus) // np.maximum(n, 1)  # floors go down
            noise = np.array([_noise(seed, x) for x in batch.column(batch.schema.get_field_index("__id")).to_pylist()], dtype=np.int64)
            yield batch_with(batch, {"n_features": pa.array(n, pa.int64()), "weight": pa.array(weight), "score": pa.array(weight + noise), "__words": pa.array(words, pa.int64())}, drop=("__text", "__id"))

    return run


NEW = ("n_features", "weight", "score", "rank")


def resample_to(docs: DataFrame, target: DataFrame, grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """docs, without the text, with n_features, weight, score and rank; the drawn rows are those with a rank.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; features are all runs of grams[0] to grams[1] consecutive words,
    joined by a space, repeats counted. Of the N rows with at least least_words words, floor(percent * N / 100) with the highest scores are
    drawn, ties by the smaller id; ranks go 1, 2, 3 in that order.

    Null and empty texts have no features, weight 0, and are drawn only if least_words is 0. Rows without an id draw the noise of an empty id and lose ties. Repeated rows
    have equal scores and take a rank each, in no fixed order. An empty table gives an empty table; an empty target has only smoothed shares. Other columns stay; those named like
    the new ones are replaced.
    """
    docs = without(docs, NEW)
    gain = gains(bucket_counts(docs, grams, buckets, text_col), bucket_counts(target, grams, buckets, target_text))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__text": F.col(text_col)}).drop(text_col)
    schema = with_fields(rows, ("n_features", "long"), ("weight", "long"), ("score", "long"), ("__words", "long"), drop=("__text", "__id"))
    scored = cut_lineage(rows.mapInArrow(_score(shared, grams, buckets, seed), schema)).withColumn("__row", F.monotonically_increasing_id())
    fit = scored.where(F.col("__words") >= least_words)
    k = percent * fit.count() // 100
    # Rows of one id have all but equal keys, so the row's own number divides them among ranges.
    order = [F.desc("score"), key(id_col), F.desc("n_features"), F.col("__row")]
    drawn = ranked(fit.select(id_col, "score", "n_features", "__row"), [], order).where(F.col("rank") <= k).select("__row", "rank")
    return scored.join(drawn, "__row", "left").drop("__row", "__words")


def op13_importance_resample(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample_to(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *NEW)
