"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

The sketch has BINS coordinates. In round r each element of a set is hashed to one bin with a
value that starts with r, and a bin keeps its smallest value; a document stops after the round
that fills all its bins. After BINS rounds, round BINS + i throws every element into bin i, so
each coordinate fills with certainty. Two sets agree in a coordinate with the probability of
their Jaccard similarity, and the estimate concentrates as with independent coordinates
(Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017).

Bands of four coordinates are the bucket keys; at a similarity of 0.8 a pair misses all 32
bands with probability (1 - 0.8 ** 4) ** 32, under 1e-7. Equal sets are one class before any
banding, so groups of copies never meet in a bucket. In a bucket, members are first compared with
one of them, not with each other: in large buckets in blocks, each of which has that one's set once. Buckets that still hold different components are then
compared completely: small ones pair by pair, large ones in blocks, where one matrix product counts all intersections and only a spanning forest
of the links comes out. Every comparison is exact on the full sets, so no candidate is dropped and
none is trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import LAST, cut_lineage, key, released, small_or_not
from bramble.operators.components import FEW, HUB, connected_components

BINS, BAND = 128, 4
FULL = np.iinfo(np.uint64).max
#: Ids that may be broadcast to pick the documents whose sets are needed (some 30 MB).
FEW_IDS = 1_000_000
#: Members of a bucket that is compared pair by pair; members and set elements of a block of a larger one.
FEW_MEMBERS, BLOCK_MEMBERS, BLOCK_ELEMENTS = 32, 1024, 1_000_000
#: Members that are compared with one set at once.
RAY_MEMBERS = 64


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed k-word shingles of each text, one text's after another's, and where each text's begin."""
    words = tv.cut(texts, tv.NOT_SPACE, lower=True)
    hashes = words.hashes()
    runs, first = tv.grams(hashes, words.first, k)
    counts = words.counts
    parts = []
    for t in range(len(counts)):
        if counts[t] >= k:
            x = np.sort(runs[first[t] : first[t + 1]])
            parts.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif counts[t]:
            whole = hashes[words.first[t] : words.first[t + 1]]
            parts.append(tv.mix(np.array([np.sum(whole * tv.keys(4, k)[: len(whole)]) + tv.U(counts[t])], dtype=tv.U)))
        else:
            parts.append(np.zeros(0, dtype=tv.U))
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=tv.U), np.r_[0, np.cumsum(sizes)]


def sketches(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BINS values for each set; of empty sets, all FULL."""
    n, sizes = len(first) - 1, np.diff(first)
    out = np.full(n * BINS, FULL, dtype=tv.U)
    owner = np.repeat(np.arange(n), sizes)
    for r in range(2 * BINS):
        if not len(owner):
            break
        h = tv.mix(elements ^ tv.keys(7, 2 * BINS)[r])
        at = owner * BINS + ((h >> tv.U(57)).astype(np.int64) if r < BINS else r - BINS)
        np.minimum.at(out, at, (tv.U(r) << tv.U(56)) | (h & tv.U((1 << 56) - 1)))
        open_ = (out.reshape(n, BINS) == FULL).any(axis=1) & (sizes > 0)
        go = open_[owner]
        elements, owner = elements[go], owner[go]
    return out.reshape(n, BINS)


def _bands(rows: np.ndarray) -> np.ndarray:
    parts = rows.reshape(len(rows), BINS // BAND, BAND)
    out = np.broadcast_to(tv.keys(8, BINS)[: BINS // BAND], parts.shape[:2]).copy()
    for j in range(BAND):
        out += tv.mix(parts[:, :, j]) * tv.keys(9, BAND)[j]
    return tv.mix(out)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches):
            elements, first = shingle_sets(batch.column(0), k)
            sizes = np.diff(first)
            bands = _bands(sketches(elements, first))
            marks = []
            for seed in (11, 12):  # of a set: sums over its elements
                total = np.r_[tv.U(0), np.cumsum(tv.mix(elements ^ tv.keys(seed, 1)[0]), dtype=tv.U)]
                marks.append(tv.mix(total[first[1:]] - total[first[:-1]] + sizes.astype(tv.U)).view(np.int64))
            some = sizes > 0
            offsets = np.r_[0, np.cumsum(np.where(some, bands.shape[1], 0))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sizes), *map(pa.array, marks), lists], names=["id", "doc", "n", "f1", "f2", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches):
            elements, first = shingle_sets(batch.column(0), k)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["doc", "elements"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    one, two = (sets.select(F.col("doc").alias(c), F.col("elements").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(one, "u").join(two, "v").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def _sizes_fit(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with this symmetric matrix."""
    todo, out = np.ones(len(link), dtype=bool), []
    for root in range(len(link)):
        if not todo[root]:
            continue
        todo[root], queue = False, [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(link[at] & todo)
            todo[new] = False
            queue += new.tolist()
            out += [(at, x) for x in new.tolist()]
    return out


def _compare_rays(percent: int):
    """Links between one set, the hub, and the others of a block."""

    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_id, hubs, others = keys[0].as_py(), [], []  # RAY_MEMBERS documents or so; one that is given several times has several sets
        for batch in batches:
            for doc, own in zip(batch.column(3).to_pylist(), (x.values.to_numpy() for x in batch.column(4)), strict=True):
                (hubs if doc == hub_id else others).append((doc, np.sort(own)))

        def links(hub: np.ndarray, own: np.ndarray) -> bool:
            at = np.minimum(np.searchsorted(hub, own), max(len(hub) - 1, 0))
            both = int((hub[at] == own).sum())  # sets have each element once, in order
            return 100 * both >= percent * (len(hub) + len(own) - both)

        ends = np.array([doc for doc, own in others if any(links(hub, own) for _, hub in hubs)], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ends, hub_id)), pa.array(np.maximum(ends, hub_id))], names=["u", "v"])

    return run


def _compare_blocks(percent: int):
    """Links between two blocks of a bucket (or within one), as a spanning forest."""

    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        rep, side = (table.column(c).to_numpy() for c in ("rep", "side"))
        lists = table.column("elements").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        _, column, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(rep)), sizes)
        shared = count[column] > 1  # others are in no intersection
        number = np.cumsum(count > 1) - 1
        row, column = row[shared], number[column[shared]]
        both, width = np.zeros((len(rep), len(rep)), dtype=np.int64), 4096
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [low, low + width])
            part = np.zeros((len(rep), width), dtype=np.float32)
            part[row[a:b], column[a:b] - low] = 1
            both += (part @ part.T).astype(np.int64)  # at most 4096 at a time, which float32 holds exactly
        link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        if keys[1].as_py() != keys[2].as_py():
            link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, False)
        edges = np.array(_forest(link), dtype=np.int64).reshape(-1, 2)
        u, v = rep[edges[:, 0]], rep[edges[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    A text's set is its distinct k-word shingles over words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased;
    with fewer words, the whole sequence. Texts are linked if 100 * intersection >= percent * union;
    component_id is the smallest id that links reach, and kept marks the row that has it.

    Null texts and texts without words have no shingles and no links. Rows without an id have no
    component_id unless they are linked with others and come last; they count as one document, and so do rows
    with an equal id, which share their links. An empty table gives an empty table; other columns
    are not looked at.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), key(id_col).alias("doc"))
    base = cut_lineage(texts.mapInArrow(released(_sketch(k)), "id long, doc long, n long, f1 long, f2 long, bands array<long>"))
    # Sets with very many copies, at most 1 / HUB of them, are looked up in all tasks and their copies dealt by document, so no set is a hot key.
    some = base.where("n > 0")
    most = max(FEW, int(HUB * some.count()))
    classes = some.groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    placed = some.join(F.broadcast(classes.where(F.col("copies") > most).select("f1", "f2", F.col("rep").alias("hub"))), ["f1", "f2"], "left")
    placed = placed.withColumn("f1", F.when(F.col("hub").isNull(), F.col("f1")).otherwise(F.xxhash64("doc"))).join(classes.drop("copies"), ["f1", "f2"], "left").withColumn("rep", F.coalesce("hub", "rep"))
    placed = cut_lineage(placed.select("doc", "rep", "n", F.when(F.col("doc") == F.col("rep"), F.col("bands")).alias("bands")))

    rows = placed.where("doc = rep").select("rep", "n", F.explode("bands").alias("key"))
    first = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("e"), F.min(F.struct("rep", "n")).alias("c")).where("m > 1")
    rows = cut_lineage(rows.join(first, "key").select("key", "rep", "n", "m", "e", F.col("c.rep").alias("r2"), F.col("c.n").alias("n2")))
    wanted = small_or_not(cut_lineage(rows.select(F.col("rep").alias("doc")).distinct()), FEW_IDS)
    sets = texts.select("text", "doc").join(wanted, "doc", "left_semi").select("text", "doc").mapInArrow(released(_sets(k)), "doc long, elements array<long>")
    if not base.groupBy("doc").count().where("count > 1").isEmpty():
        sets = sets.distinct()  # a document that is given very often has each of its sets once
    sets = cut_lineage(sets)

    def linked(pairs: DataFrame) -> DataFrame:
        fit = pairs.where(_sizes_fit("n", "n2", percent)).select(F.least("rep", "r2").alias("u"), F.greatest("rep", "r2").alias("v"))
        return _linked(fit.where("u != v").distinct(), sets, percent)

    rays = rows.where(F.col("m") > RAY_MEMBERS).where(_sizes_fit("n", "n2", percent)).where("rep != r2").groupBy(F.col("r2").alias("hub"), F.col("rep").alias("doc")).agg(F.max("m").alias("m"))
    blocks = F.ceil(F.col("m") / RAY_MEMBERS).cast("int")
    rays = rays.select("hub", blocks.alias("blocks"), F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("block"), "doc")
    hubs = rays.select("hub", "blocks", "block", F.col("hub").alias("doc")).distinct()
    rays = rays.unionByName(hubs).join(sets, "doc").select("hub", "blocks", "block", "doc", "elements")
    rays = rays.groupBy("hub", "blocks", "block").applyInArrow(_compare_rays(percent), "u long, v long")
    links = cut_lineage(linked(rows.where(F.col("m") <= RAY_MEMBERS)).unionByName(rays))
    label = connected_components(links, cut_lineage).withColumnRenamed("node", "rep")
    rows = rows.drop("r2", "n2").join(label, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    rows = cut_lineage(rows)
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rows = cut_lineage(rows.join(mixed, "key", "left_semi"))

    small = rows.where(F.col("m") <= FEW_MEMBERS)
    other = small.select("key", F.col("rep").alias("r2"), F.col("n").alias("n2"), F.col("comp").alias("c2"))
    blocks = F.greatest(F.ceil(F.col("e") / BLOCK_ELEMENTS), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("int")
    large = rows.where(F.col("m") > FEW_MEMBERS).select("key", "rep", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    large = large.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "rep", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b"), (F.col("own") > F.col("j")).cast("int").alias("side"))
    large = large.join(sets.select(F.col("doc").alias("rep"), "elements"), "rep").groupBy("key", "a", "b").applyInArrow(_compare_blocks(percent), "u long, v long")
    more = cut_lineage(linked(small.join(other, "key").where("rep < r2 and comp != c2")).unionByName(large))
    placed = placed.select("doc", "rep").join(label, "rep", "left").select("doc", F.coalesce("component", "rep").alias("component"))
    if not more.isEmpty():
        # What the first links joined is one node from here on.
        for end in ("u", "v"):
            more = more.join(label.select(F.col("rep").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        last = connected_components(more, cut_lineage).select(F.col("node").alias("component"), F.col("component").alias("last"))
        placed = placed.join(small_or_not(cut_lineage(last), FEW_IDS), "component", "left").select("doc", F.coalesce("last", "component").alias("component"))

    found = placed.groupBy("doc").agg(F.min("component").alias("component"))
    out = base.select("id", "doc", "n").join(found, "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(component == LAST, None).otherwise(component).alias("component_id"), (component == F.col("doc")).alias("kept"))


def op4_near_dup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=2, percent=80)
