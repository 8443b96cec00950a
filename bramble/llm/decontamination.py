"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are all word n-grams of test items, however common. One pass finds their places in documents and cuts out
the passages around them, and Spark joins the seeds to the items that have them. Around each shared seed lies a stretch that
holds any leak with this seed in it; stretches that overlap are one. Each is aligned with the item word by word, which scores
copies with words put in, left out or replaced. Only stretches with fewer of the item's words than a leak needs are not aligned.
A copy of which no run of n words is left has no seed and isn't found. An item of fewer than n words says nothing inside a longer
text: it is leaked by documents that are that item and nothing else, which an exact join on all their words finds.

Rarity is not used to leave seeds out, as edited copies may hold on to the common ones only; the words of a stretch travel to
an item once for all seeds in it, and no join gathers a group, so that Spark can split a seed or item that very many passages share.

What tasks need to know of the seeds is a bit for each hash cell, at most MOST_CELLS / 8 bytes; the
joins are exact, so a full filter costs time only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import LAST, cut_lineage, key, released

SEED, MOST_CELLS, BLOCK = 3, 1 << 27, 1 << 17
MATCH, MISMATCH, GAP = 2, -1, -1
#: A leak's score, as a share of what the whole item would have, or else its score in words.
SHARE, WORDS = 0.5, 25
#: Pairs aligned at once, and cells of one row of them.
PAIRS, CELLS = 512, 1 << 17
Batches = Iterator[pa.RecordBatch]


def _items(n: int):
    def run(batches: Batches) -> Batches:
        for batch in tv.slices(batches):
            words = tv.cut(batch.column(0), tv.ALNUM, lower=True)
            hashes = words.hashes()
            runs, first = tv.grams(hashes, words.first, n, seed=31)
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x.view(np.int64))) for o, x in ((words.first, hashes), (first, runs))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["item", "words", "seeds"])

    return run


def _bits(cells: int):
    """The cells of a partition's seeds, in blocks."""

    def run(batches: Batches) -> Batches:
        flags = np.zeros(cells, dtype=bool)
        for batch in batches:
            flags[tv.mix(batch.column(0).to_numpy().view(tv.U)) & tv.U(cells - 1)] = True
        for b in range(-(-cells // BLOCK)):
            part = flags[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())], names=["block", "bits"])

    return run


def _filter(seeds: DataFrame, n: int) -> tuple[bytes, int]:
    """One bit for each cell, set where a seed falls; the tasks' blocks are joined here, MOST_CELLS / 8 bytes at most."""
    cells = min(MOST_CELLS, max(BLOCK, 1 << (8192 * n).bit_length()))
    out = np.zeros(cells // 8, dtype=np.uint8)
    for row in seeds.select("hash").coalesce(8).mapInArrow(_bits(cells), "block long, bits binary").toLocalIterator():
        out[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] |= np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    return out.tobytes(), cells


def _known(runs: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    at = (tv.mix(runs) & tv.U(cells - 1)).astype(np.int64)
    return np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)


def _passages(n: int, shared, cells: int, reach: int):
    """Passages with seeds: the words from `reach` before to `reach` after, passages that touch being one."""

    def run(batches: Batches) -> Batches:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in tv.slices(batches):
            words = tv.cut(batch.column(0), tv.ALNUM, lower=True)
            hashes = words.hashes()
            runs, first = tv.grams(hashes, words.first, n, seed=31)
            hit = _known(runs, bits, cells)
            if not len(hit):
                continue
            text = np.searchsorted(first, hit, side="right") - 1
            place = hit - first[text]
            new = np.r_[True, (text[1:] != text[:-1]) | (place[1:] - place[:-1] > 2 * reach)]
            begin, end = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(hit)]
            low = np.maximum(place[begin] - reach, 0)
            high = np.minimum(place[end - 1] + n + reach, words.counts[text[begin]])
            at = words.first[text[begin]]
            offsets = np.r_[0, np.cumsum(high - low)]
            own = hashes[np.repeat(at + low - offsets[:-1], high - low) + np.arange(offsets[-1])]
            seeds = pa.StructArray.from_arrays([pa.array(place), pa.array(runs[hit].view(np.int64))], names=["place", "hash"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(text[begin])), pa.array(low), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(own.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.r_[begin, len(hit)].astype(np.int32)), seeds)],
                names=["id", "low", "words", "seeds"],
            )

    return run


def _short(n: int):
    """The words of texts of fewer than n words."""

    def run(batches: Batches) -> Batches:
        for batch in tv.slices(batches):
            words = tv.cut(batch.column(0), tv.ALNUM, lower=True)
            some = np.flatnonzero((words.counts > 0) & (words.counts < n))
            if len(some):
                hashes = words.hashes()
                own = [hashes[words.first[t] : words.first[t + 1]].view(np.int64) for t in some.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(some)), pa.array(own, pa.list_(pa.int64()))], names=["id", "words"])

    return run


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best local alignment of each passage with its item: score, first and last word in the passage.

    All pairs advance together, a passage word at a time; along the item, gaps are a running maximum.
    """
    rows, width, n = max(map(len, passages)), max(map(len, items)), len(items)
    a, b = np.zeros((n, rows), dtype=np.int64), np.zeros((n, width), dtype=np.int64)
    for i, (p, q) in enumerate(zip(passages, items, strict=True)):
        a[i, : len(p)], b[i, : len(q)] = p, q
    long_a, long_b = np.array([len(p) for p in passages]), np.arange(width)[None, :] < np.array([len(q) for q in items])[:, None]
    shift = np.arange(width, dtype=np.int32) * -GAP
    h, from_ = np.zeros((n, width + 1), dtype=np.int32), np.zeros((n, width + 1), dtype=np.int64)
    best, first, last = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(rows):
        fit = np.where((a[:, i : i + 1] == b) & long_b & (i < long_a)[:, None], MATCH, MISMATCH).astype(np.int32)
        diagonal, above = h[:, :-1] + fit, h[:, 1:] + GAP
        begun = np.where(h[:, :-1] > 0, from_[:, :-1], i)
        score, start = np.where(above > diagonal, above, diagonal), np.where(above > diagonal, from_[:, 1:], begun)
        # A score and its start travel together: the running maximum is taken of both in one number.
        packed = (np.maximum(score, 0) + shift).astype(np.int64) * (1 << 32) + np.where(score > 0, (1 << 31) - start, 0)
        packed = np.maximum.accumulate(packed, axis=1)
        value = (packed >> 32).astype(np.int32) - shift
        h[:, 1:], from_[:, 1:] = np.maximum(value, 0), (1 << 31) - (packed & ((1 << 32) - 1))
        at = h[:, 1:].argmax(axis=1)
        top = h[np.arange(n), 1 + at]
        better = (top > best) & (i < long_a)
        best[better], first[better], last[better] = top[better], from_[np.arange(n), 1 + at][better], i
    return best, first, last


def _aligned(batches: Batches) -> Batches:
    for batch in batches:
        at = batch.schema.get_field_index
        words, items = (batch.column(at(c)) for c in ("words", "item_words"))
        base, least = (batch.column(at(c)).to_numpy() for c in ("low", "least"))
        pairs = [(words[i].values.to_numpy(), items[i].values.to_numpy()) for i in range(batch.num_rows)]
        # No alignment has more matches than either side has words of the other.
        able = [i for i, (p, q) in enumerate(pairs) if MATCH * min(np.isin(p, q).sum(), np.isin(q, p).sum()) >= least[i]]
        order = sorted(able, key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
        score, first, last = (np.zeros(len(pairs), dtype=np.int64) for _ in range(3))
        while order:
            n = max(1, min(PAIRS, CELLS // max(1, max(len(pairs[i][1]) for i in order[:PAIRS]))))
            now, order = order[:n], order[n:]
            score[now], first[now], last[now] = align([pairs[i][0] for i in now], [pairs[i][1] for i in now])
        out = {"id": batch.column(at("id")), "item": batch.column(at("item")), "need": batch.column(at("need")), "points": pa.array(score), "first_word": pa.array(base + first), "last_word": pa.array(base + last)}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def leaks(docs: DataFrame, items: DataFrame, n: int = SEED, share: float = SHARE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, score, first_word, last_word) for each document and item of which a passage is a copy, as it is or edited.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. score is the alignment's share of what the whole
    item would score; a leak has `share` of it, or what `words` words in a row would score. The words are the passage's first and last, counted from 0.

    An item of fewer than n words is leaked only by documents of exactly its words. Null or empty texts and items match nothing. Rows without an id or with an equal id are one
    document each id; repeated items are one. Either table may be empty: then so is the result. Other columns are not looked at.
    """
    context = docs.sparkSession.sparkContext
    tests = items.where(F.col(item_col).isNotNull()).select(F.col(item_text).alias("text"), F.col(item_col).cast("long").alias("item")).distinct()
    tests = cut_lineage(tests.mapInArrow(_items(n), "item long, words array<long>, seeds array<long>"))
    seeds = cut_lineage(tests.select("item", F.posexplode("seeds").alias("at", "hash")))
    longest, total = tests.agg(F.max(F.size("words"))).first()[0] or 0, seeds.count()
    texts = docs.select(F.col(text_col).alias("text"), key(id_col).alias("id"))
    bits, cells = _filter(seeds, total)
    # The most that lies to one side of a seed: an item's words, and two more put in for each that matches.
    passages = cut_lineage(texts.mapInArrow(released(_passages(n, context.broadcast(bits), cells, 3 * longest)), "id long, low long, words array<long>, seeds array<struct<place: long, hash: long>>"))
    passages = passages.withColumn("passage", F.monotonically_increasing_id())
    votes = passages.select("passage", F.explode("seeds").alias("s")).select("passage", "s.*").join(seeds.join(tests.select("item", F.size("words").cast("long").alias("need")), "item"), "hash")
    least = F.least(share * MATCH * F.col("need"), F.lit(float(MATCH * words)))
    # The best alignment's ends don't score below 0, and what is put in costs no more than is left over for a leak.
    spare, before, after = F.greatest(F.floor(MATCH * F.col("need") - least), F.lit(0)), F.col("at").cast("long"), F.col("need") - F.col("at") - n
    votes = votes.select("passage", "item", "need", least.alias("least"), (F.col("place") - before - F.least(MATCH * before, spare)).alias("low"), (F.col("place") + n + after + F.least(MATCH * after, spare)).alias("high"))
    by_place = Window.partitionBy("passage", "item").orderBy("low", "high")
    votes = votes.withColumn("new", F.coalesce(F.col("low") > F.max("high").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("long"))
    votes = votes.withColumn("stretch", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = votes.groupBy("passage", "item", "need", "least", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = pairs.join(tests.select("item", F.col("words").alias("item_words")), "item").join(passages.select("passage", "id", F.col("low").alias("begin"), "words"), "passage")
    low = F.greatest("low", "begin")
    pairs = pairs.select("id", "item", F.slice("words", (low - F.col("begin") + 1).cast("int"), (F.col("high") - low).cast("int")).alias("words"), "item_words", low.alias("low"), "need", "least")
    done = pairs.mapInArrow(released(_aligned), "id long, item long, need long, points long, first_word long, last_word long")
    done = done.where((F.col("points") >= share * MATCH * F.col("need")) | (F.col("points") >= MATCH * words))
    best = done.groupBy("id", "item").agg(F.max(F.struct("points", (-F.col("first_word")).alias("f"), "last_word", "need")).alias("b"))
    best = best.select("id", "item", (F.col("b.points") / (MATCH * F.col("b.need"))).alias("score"), (-F.col("b.f")).alias("first_word"), F.col("b.last_word").alias("last_word"))
    short = tests.where(F.size("words").between(1, n - 1)).select("item", "words")
    if not short.isEmpty():
        same = texts.where(F.length("text") > 0).mapInArrow(_short(n), "id long, words array<long>").join(short, "words").distinct()
        best = best.unionByName(same.select("id", "item", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("first_word"), (F.size("words") - 1).cast("long").alias("last_word")))
    return best.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), F.col("item").alias(item_col), "score", "first_word", "last_word")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs.select("doc_id", "text"), items.select("item_id", "text"))
