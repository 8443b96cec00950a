"""Substring dedup: a merged count-min sketch picks the windows to group exactly.

A window is `window` consecutive words. Pass 1 lets each partition count, in a count-min
sketch, one anchor for each window: the smallest hash among the shorter runs inside it
(neighbouring windows share their anchor, so there are far fewer anchors than windows, and
equal windows have equal anchors). An anchor's count is at least that of each window it
stands for, so the merged sketch overestimates window counts. Pass 2 emits only windows
whose estimate is two or more, and Spark groups them by a 96-bit hash. No repeated window
can be lost: a crowded sketch lets more windows through, never fewer.

The sketch grows with the corpus, so it never fills. Up to MOST_CELLS its bits "counted twice" are sent to all tasks (16 MB).
A larger one is cut into slices by anchor: each reduce task merges what the partitions counted for its
slice and returns the anchors estimated repeated, which documents look up by a join; none of it passes the driver. A window with
very many copies is combined in each task before the shuffle, so it is a few rows wherever it goes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import LAST, batch_with, cut_lineage, released, with_fields, without

#: Bound on a sketch that is sent to all tasks, in cells of both rows together; cells of a slice of a larger one.
MOST_CELLS, SLICE_CELLS = 1 << 27, 1 << 23
ROWS = 2
#: Cells in a block, the unit in which partition sketches are merged.
BLOCK = 1 << 17
#: Candidate windows that a task holds before it sends the first of each kind.
COMBINE = 1_000_000
Batches = Iterator[pa.RecordBatch]


def _anchors(runs: np.ndarray, width: int) -> np.ndarray:
    """The position of the leftmost smallest value in each stretch of `width` values."""
    at, have = np.arange(len(runs)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(runs[right] < runs[left], right, left)
        have += step
    return at


class _Windows:
    """The windows of a batch of texts: word hashes, the first window of each text, and each window's anchor."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.words = tv.cut(texts, tv.NOT_SPACE)
        self.hashes = self.words.hashes()
        run = (window + 1) // 2
        per_text = np.maximum(self.words.counts - window + 1, 0)
        self.first = np.zeros(len(per_text) + 1, dtype=np.int64)
        np.cumsum(per_text, out=self.first[1:])
        runs, first_run = tv.grams(self.hashes, self.words.first, run, seed=3)
        if self.first[-1]:
            at = _anchors(runs, window - run + 1)
            where = np.repeat(first_run[:-1] - self.first[:-1], per_text) + np.arange(self.first[-1])
            self.anchor_at = at[where]
            self.anchors = runs[self.anchor_at]
        else:
            self.anchor_at, self.anchors = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=tv.U)


def _cells(values: np.ndarray, cells: int) -> list[np.ndarray]:
    """A cell of each sketch row; the rows lie one after another."""
    width = cells // ROWS
    return [(tv.mix(values ^ tv.U(0xA5A5 + 7919 * r)) & tv.U(width - 1)).astype(np.int64) + r * width for r in range(ROWS)]


def _sketch(window: int, cells: int) -> Callable[[Batches], Batches]:
    """Counts a partition's anchors and gives its sketch in blocks: the bits of cells counted once, and twice or more."""

    def count(batches: Batches) -> Batches:
        once, twice = np.zeros(cells // 8, dtype=np.uint8), np.zeros(cells // 8, dtype=np.uint8)
        for batch in tv.slices(batches):
            w = _Windows(batch.column(0), window)
            if not len(w.anchors):
                continue
            values = w.anchors[np.r_[True, w.anchor_at[1:] != w.anchor_at[:-1]]]  # a place counts once: its windows are neighbours
            for at in _cells(values, cells):
                hit, n = np.unique(at, return_counts=True)
                byte, bit = hit >> 3, np.uint8(128) >> (hit & 7).astype(np.uint8)
                again = (n > 1) | ((once[byte] & bit) > 0)
                np.bitwise_or.at(twice, byte[again], bit[again])
                np.bitwise_or.at(once, byte, bit)
        for b in range(cells // BLOCK):
            part = slice(b * BLOCK // 8, (b + 1) * BLOCK // 8)
            if once[part].any():
                bits = zlib.compress(once[part].tobytes() + twice[part].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([bits], pa.binary())], names=["block", "bits"])

    return count


def _merge(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partitions' counts of one block; what is left is the bits of cells counted twice or more."""
    once = twice = None
    for batch in batches:
        for bits in batch.column(1):
            both = np.frombuffer(zlib.decompress(bits.as_py()), dtype=np.uint8)
            one, two = np.split(both, 2)
            if once is None:
                once, twice = one.copy(), two.copy()
            else:
                twice |= two | (once & one)
                once |= one
    yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()]), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["block", "bits"])


def _estimated_twice(values: np.ndarray, sketch: np.ndarray, cells: int) -> np.ndarray:
    found = np.ones(len(values), dtype=bool)
    for at in _cells(values, cells):
        found &= (sketch[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found


def _sliced(window: int, slices: int) -> Callable[[Batches], Batches]:
    """A partition's anchors with their slice, each once for what the task has just read, and whether it was there again."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        anchors, n = np.unique(np.concatenate(parts), return_counts=True)
        at = (tv.mix(anchors ^ tv.U(0x51CE)) % tv.U(slices)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(anchors.view(np.int64)), pa.array(n > 1)], names=["slice", "anchor", "again"])

    def find(batches: Batches) -> Batches:
        parts, held = [], 0
        for batch in tv.slices(batches):
            w = _Windows(batch.column(0), window)
            if len(w.anchors):
                parts.append(w.anchors[np.r_[True, w.anchor_at[1:] != w.anchor_at[:-1]]])
                held += len(parts[-1])
            if held > COMBINE:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    return find


def _slice_estimates(cells: int) -> Callable[[tuple, Batches], Batches]:
    """Merges the partitions' counts of one slice of the sketch; what is left is its anchors estimated twice or more."""

    def run(keys: tuple, batches: Batches) -> Batches:
        once, twice, seen = np.zeros(cells, dtype=bool), np.zeros(cells, dtype=bool), []
        for batch in batches:
            anchors, again = batch.column(1).to_numpy().view(tv.U), batch.column(2).to_numpy(zero_copy_only=False)
            for at in _cells(anchors, cells):
                hit, n = np.unique(at, return_counts=True)
                twice[hit[(n > 1) | once[hit]]] = True
                twice[at[again]] = True
                once[hit] = True
            seen.append(np.unique(anchors))
        own = np.unique(np.concatenate(seen))
        found = np.ones(len(own), dtype=bool)
        for at in _cells(own, cells):
            found &= twice[at]
        yield pa.RecordBatch.from_arrays([pa.array(own[found].view(np.int64))], names=["anchor"])

    return run


def _anchors_of(window: int) -> Callable[[Batches], Batches]:
    """(doc, anchor) for the distinct anchors of each text."""

    def run(batches: Batches) -> Batches:
        for batch in tv.slices(batches):
            w = _Windows(batch.column(0), window)
            text = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
            if len(text):
                new = np.r_[True, (w.anchor_at[1:] != w.anchor_at[:-1]) | (text[1:] != text[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(text[new])), pa.array(w.anchors[new].view(np.int64))], names=["doc", "anchor"])

    return run


Estimate = Callable[[pa.RecordBatch, _Windows], np.ndarray]


def _by_sketch(cells: int, shared) -> Estimate:
    return lambda batch, w: _estimated_twice(w.anchors, np.frombuffer(shared.value, dtype=np.uint8), cells)


def _by_list(batch: pa.RecordBatch, w: _Windows) -> np.ndarray:
    """Windows whose anchors the column __hot has, a list for each text."""
    found, lists = np.zeros(len(w.anchors), dtype=bool), batch.column(batch.schema.get_field_index("__hot"))
    for t in range(batch.num_rows):
        if (own := lists[t].values) is not None:
            some = slice(w.first[t], w.first[t + 1])
            found[some] = np.isin(w.anchors[some], own.to_numpy().view(tv.U))
    return found


def _first_of_each(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each window: its smallest document."""
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(h1[order], kind="stable")]
    h1, h2, doc = h1[order], h2[order], doc[order]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]  # windows with equal h1 but not h2 may give a row more
    return h1[new], h2[new], doc[new]


def _candidates(window: int, estimated: Estimate) -> Callable[[Batches], Batches]:
    """Windows estimated repeated, each once for its smallest document in what the task has just read."""

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h1, h2, doc = _first_of_each(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array((h2 >> tv.U(32)).astype(np.uint32).view(np.int32)), pa.array(doc)], names=["h1", "h2", "doc"])

    def find(batches: Batches) -> Batches:
        parts, held = [], 0
        for batch in tv.slices(batches):
            w = _Windows(batch.column(0), window)
            hit = np.flatnonzero(estimated(batch, w))
            if not len(hit):
                continue
            doc = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(w.first))[hit]
            h1, h2 = (tv.grams(w.hashes, w.words.first, window, seed=s)[0][hit] for s in (5, 6))
            parts.append(_first_of_each(h1, h2, doc))
            held += len(parts[-1][0])
            if held > COMBINE:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    return find


def _covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Flags for the words that windows with these starts cover."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:n]) > 0


def _cut_out(raw: np.ndarray, begin: int, end: int, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text of bytes begin to end less each run of words that goes, with the white space after it."""
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    at, parts = begin, []
    for low, high in edges.reshape(-1, 2).tolist():
        parts.append(raw[at : starts[low]].tobytes())
        at = int(starts[high]) if high < len(starts) else end
    return b"".join([*parts, raw[at:end].tobytes()])


def _apply(window: int, estimated: Estimate, drop: tuple[str, ...], layout: bool) -> Callable[[Batches], Batches]:
    """Removes from each text what windows cover that start earlier elsewhere."""

    def remove(batches: Batches) -> Batches:
        for batch in tv.slices(batches, "__text"):
            texts, firsts = (batch.column(batch.schema.get_field_index(c)) for c in ("__text", "__firsts"))
            w = _Windows(texts, window)
            hit = estimated(batch, w)
            h1 = tv.grams(w.hashes, w.words.first, window, seed=5)[0].view(np.int64) if hit.any() else np.zeros(0, dtype=np.int64)
            counts, removed, kept = w.words.counts, [], []
            _, offsets = tv.buffers(texts)
            for t in range(batch.num_rows):
                low, high = w.first[t], w.first[t + 1]
                at = np.flatnonzero(hit[low:high])
                n = int(counts[t])
                if len(at):
                    own = h1[low + at]
                    first_here = np.zeros(len(own), dtype=bool)
                    first_here[np.unique(own, return_index=True)[1]] = True
                    mine = firsts[t].values
                    first = first_here & np.isin(own, mine.to_numpy() if mine is not None else np.zeros(0, dtype=np.int64))
                    at = at[~first]
                gone = _covered(at, window, n) if len(at) else np.zeros(n, dtype=bool)
                removed.append(int(gone.sum()))
                if layout:
                    kept.append(_cut_out(w.words.data, offsets[t], offsets[t + 1], w.words.starts[w.words.first[t] : w.words.first[t + 1]], gone).decode())
                else:
                    kept.append(w.words.kept(t, ~gone).decode() if len(at) else b" ".join((texts[t].as_py() or "").encode().split()).decode())
            columns = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            yield batch_with(batch, columns, drop)

    return remove


def _doc_key(id_col: str, text_col: str) -> Column:
    """The id; without one, a number after most ids by the text, so that rows without an id are documents of their own."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(text_col), F.lit(1 << 60)))


def _hot_anchors(texts: DataFrame, window: int, slices: int, cells: int) -> DataFrame:
    """(doc, __hot): the anchors of each document that a sketch of so many slices estimates repeated."""
    counted = texts.select("text").mapInArrow(released(_sliced(window, slices)), "slice long, anchor long, again boolean")
    repeated = counted.groupBy("slice").applyInArrow(_slice_estimates(cells), "anchor long")
    own = texts.mapInArrow(released(_anchors_of(window)), "doc long, anchor long")
    return cut_lineage(own.join(repeated, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("__hot")))


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", most_cells: int = MOST_CELLS, slice_cells: int = SLICE_CELLS, layout: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept_text: each word goes that a window covers which also starts earlier.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Earlier is a smaller id, or an earlier start in the
    same document. Windows are judged on the input. kept_text has the kept words joined by one space, or, with layout,
    is the text as it was, less each run of removed words with the white space after it.

    Null texts have no words. Rows without an id come after the others, each as a document of its own, in the order of a hash of their
    texts. Rows with an equal id, or without one and with an equal text, count
    as one document given several times: a window that is first in one is first in each that has it.
    Texts of fewer words than a window lose none; an empty table gives an empty table. All columns
    of docs stay, but for those named like the new ones, which are replaced.
    """
    docs = without(docs, ("n_words", "n_removed", "kept_text"))
    texts = docs.select(F.col(text_col).alias("text"), _doc_key(id_col, text_col).alias("doc")).where("length(text) > 1")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = 4 * max(1, size // 36)  # words of six bytes, an anchor for six of them, four cells for each
    joined = docs.withColumns({"__text": F.col(text_col), "__doc": _doc_key(id_col, text_col)})
    if wanted <= most_cells:
        cells = max(BLOCK * ROWS, 1 << wanted.bit_length())
        estimated, mine = _by_sketch(cells, docs.sparkSession.sparkContext.broadcast(_merged(texts, window, cells))), ("__doc", "__text", "__firsts")
    else:
        hot = _hot_anchors(texts, window, -(-wanted // slice_cells), 2 * slice_cells)
        estimated, mine = _by_list, ("__doc", "__text", "__firsts", "__hot")
        texts = texts.join(hot, "doc").select("text", "doc", "__hot")
        joined = joined.join(hot.withColumnRenamed("doc", "__doc"), "__doc", "left")

    found = texts.mapInArrow(released(_candidates(window, estimated)), "h1 long, h2 int, doc long")
    firsts = found.groupBy("h1", "h2").agg(F.min("doc").alias("doc")).groupBy("doc").agg(F.collect_list("h1").alias("__firsts"))
    joined = joined.join(firsts.withColumnRenamed("doc", "__doc"), "__doc", "left")
    schema = with_fields(joined, ("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), drop=mine)
    return joined.mapInArrow(released(_apply(window, estimated, mine, layout)), schema)


def _merged(texts: DataFrame, window: int, cells: int) -> bytes:
    """The bits "counted twice" of the whole sketch: cells / 8 bytes, at most 16 MB."""
    blocks = texts.select("text").mapInArrow(released(_sketch(window, cells)), "block long, bits binary").groupBy("block").applyInArrow(_merge, "block long, bits binary")
    merged = bytearray(cells // 8)
    for row in blocks.toLocalIterator():
        bits = zlib.decompress(row.bits)
        merged[row.block * BLOCK // 8 : row.block * BLOCK // 8 + len(bits)] = bits
    return bytes(merged)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
