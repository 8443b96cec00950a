"""Alignment of two tokenizers' tokens by byte offsets, with an identity map as fast path.

Byte offsets where tokens of A and B both end cut a text into groups; all tokens of A in a group are linked with all of B there. A pair of ids counts
the documents, corpus-wide, that hold it linked.

Most groups hold one token of each, with equal bytes. For these an array computed once gives the id in B of the same bytes for each id of A, so
their documents are counted in a vector as long as A's vocabulary. Only what other groups link is counted as pairs, which a task combines before
Spark shuffles them. What is linked in each document is written out, so that each text is encoded once; a second pass over that looks the counts up: of the identity map in that vector; of frequent pairs in a table of at most FEW_PAIRS that
is sent to all tasks; all other pairs by a join, in which a pair has fewer rows than the frequent ones, so no key is hot.

Both tokenizers part at a single space between other characters, so texts are cut there, and a task remembers the alignment of the pieces that recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import batch_with, cut_lineage, table, with_fields, without
from bramble.llm.packing import Encoder
from bramble.operators.graph import discard, stored

#: Pairs whose counts are sent to all tasks (some 10 MB).
FEW_PAIRS = 500_000
#: Pieces of text whose alignment a task remembers; pairs that a task holds before it sends their counts; pieces encoded at once.
KEPT, COMBINE, TOGETHER = 500_000, 2_000_000, 4096
Batches = Iterator[pa.RecordBatch]


class Flat:
    """Lists of numbers, one after another, that grow in place."""

    def __init__(self) -> None:
        self.values, self.ends, self.used, self.n = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64), 0, 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + len(lengths) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[self.used : self.used + len(values)] = values
        self.ends[self.n + 1 : self.n + len(lengths) + 1] = self.used + np.cumsum(lengths)
        self.used, self.n = self.used + len(values), self.n + len(lengths)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists with these numbers, one after another, and the length of each."""
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        before = np.cumsum(lengths) - lengths
        return self.values[np.repeat(starts - before, lengths) + np.arange(lengths.sum())], lengths


def safe_spaces(data: np.ndarray) -> np.ndarray:
    """The places of single spaces between other characters, where neither tokenizer has a token across.

    Bytes up to a space, and what may be (part of) white space beyond ASCII, don't count as other characters; a text that isn't cut there is only longer in one piece.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 2) & (at < len(data) - 2)]
    odd_lead = lambda a, b: ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A)))
    before = (data[at - 1] > 0x20) & ~odd_lead(data[at - 2], data[at - 1]) & ~odd_lead(data[at - 3], data[at - 2])
    return at[before & (data[at + 1] > 0x20) & ~odd_lead(data[at + 1], data[at + 2])]


class Aligner:
    """What is remembered of pieces: their tokens' groups, and what is linked in them."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = self._bytes_a(), [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.long_a, self.long_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        # The identity map: B's id of the same bytes, its byte tokens last; -1 without one.
        same = {self.bytes_b[i]: i for i in sorted(range(len(self.bytes_b)), key=self.b.is_byte, reverse=True) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([same.get(x, -1) for x in self.bytes_a], dtype=np.int64)
        self.step = len(self.bytes_b)  # a pair is one number: A's id times this, plus B's
        self.marks = np.array([f"{i}{m}" for n, ends in ((len(self.bytes_a), ",|"), (self.step, ",;")) for i in range(n) for m in ends], dtype=object)
        self._forget()

    def _bytes_a(self) -> list[bytes]:
        # Byte-level tokens write bytes that are no visible Latin-1 characters as characters from U+0100 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
        size = self.a.tokenizer.get_vocab_size()
        special = set(self.a.special)
        names = (self.a.tokenizer.id_to_token(i) for i in range(size))
        return [t.encode() if t in special else bytes(byte_of[c] for c in t) for t in names]

    def _bytes_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        self.own, self.pairs, self.sizes = Flat(), Flat(), np.zeros((0, 5), dtype=np.int64)

    def _together(self, pieces: list[str], raw: bytes, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """The ids in A and in B of pieces that are cut at safe spaces, one after another, and how many are each piece's; None if they don't give back the bytes."""
        text, out = "".join(pieces), []
        for ids, known, long in ((self.a.fast(text), self.bytes_a, self.long_a), (self.b.encode(text[1:], num_threads=1), self.bytes_b, self.long_b)):
            if b"".join(map(known.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, dtype=np.int64)
            out.append((ids, np.diff(np.searchsorted(np.cumsum(long[ids]), ends) + 1, prepend=0)))
        return out

    def _ids(self, pieces: list[str]) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The pieces in some order, which of them don't come back from their tokens, and their ids in A and in B with how many are each piece's."""
        joint, each = [], []
        for p in pieces:
            whole = len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()
            (joint if whole and self.a._plain(p) else each).append(p)
        order, bad, parts = [], [], []
        for low in range(0, len(joint), TOGETHER):
            some = joint[low : low + TOGETHER]
            raw = [p.encode() for p in some]
            found = self._together(some, b"".join(raw), np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))))
            if found is None:
                each += some
            else:
                order, parts = order + some, [*parts, found]
                bad.append(np.zeros(len(some), dtype=np.int64))
        rest = iter(self.a.tokenizer.encode_batch_fast([p for p in each if not self.a._plain(p)], add_special_tokens=False))
        for p in each:
            ids_a, ids_b, raw = self.a.fast(p) if self.a._plain(p) else next(rest).ids, self.b.encode(p[1:], num_threads=1), p.encode()
            good = b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw
            parts.append([(np.array(ids if good else [], dtype=np.int64), np.array([len(ids) if good else 0])) for ids in (ids_a, ids_b)])
            bad.append(np.array([not good], dtype=np.int64))
        return order + each, np.concatenate(bad), [tuple(np.concatenate([x[side][k] for x in parts]) for k in (0, 1)) for side in (0, 1)]

    def _learn(self, pieces: list[str]) -> None:
        """sizes gets of each piece its tokens in A and B, groups, links, and 1 if either's bytes are not its own."""
        pieces, bad, ((a, n_a), (b, n_b)) = self._ids(pieces)
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)  # pieces end there too
        in_a, in_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)  # each token's group
        size_a, size_b = np.bincount(in_a, minlength=len(both)), np.bincount(in_b, minlength=len(both))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        piece = np.repeat(np.arange(len(pieces)), n_a)[first_a]
        one = (size_a == 1) & (size_b == 1)
        one[one] = self.same[a[first_a[one]]] == b[first_b[one]]
        groups = np.bincount(piece, minlength=len(pieces))
        per_piece = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, np.cumsum(groups)]])
        links = size_a * size_b
        self.own.add(a[first_a[one]], per_piece(one))
        odd = ~one[in_a]  # A's tokens in other groups, each with all of B's there
        many = size_b[in_a[odd]]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.repeat(a[odd] * self.step, many) + b[np.repeat(first_b[in_a[odd]], many) + inside]
        self.pairs.add(pairs, per_piece(np.where(one, 0, links)))
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, groups, per_piece(links), bad], axis=1)])
        # Each id with the mark after it: a comma, or what ends its side of the group.
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[first_a + size_a - 1] = last_b[first_b + size_b - 1] = 1
        marked = np.zeros(len(a) + len(b), dtype=np.int64)
        marked[np.arange(len(a)) + first_b[in_a]] = 2 * a + last_a
        marked[np.arange(len(b)) + (first_a + size_a)[in_b]] = 2 * (len(self.bytes_a) + b) + last_b
        parts, at = self.marks[marked].tolist(), 0
        for p, n in zip(pieces, (n_a + n_b).tolist(), strict=True):
            self.known[p] = len(self.said)
            self.said.append("".join(parts[at : at + n]))
            at += n

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of each text its sizes and groups; the text and id in A of each identical group, and the text and pair of each other link."""
        texts = texts.cast(pa.large_string()).fill_null("")
        some = pc.greater(pc.binary_length(texts), 0)
        texts = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
        raw, offsets = tv.buffers(texts)
        cuts = np.union1d(safe_spaces(raw), offsets)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if len(self.known) > KEPT:
            self._forget()
        place = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        if len(new := np.flatnonzero(place < 0)):
            self._learn([names[i] for i in new.tolist()])
            place = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))
        at = place[pieces.indices.to_numpy()]
        first = np.searchsorted(cuts, offsets)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        upto = np.zeros((len(at) + 1, 5), dtype=np.int64)
        np.cumsum(self.sizes[at], axis=0, out=upto[1:])
        sizes = upto[first[1:]] - upto[first[:-1]]
        good = sizes[:, 4] == 0
        sizes[~good] = 0
        said, own_at = self.said, at.tolist()
        groups = ["".join([said[i] for i in own_at[x:y]])[:-1] if ok else "" for x, y, ok in zip(first[:-1].tolist(), first[1:].tolist(), good.tolist(), strict=True)]
        at, of = at[good[of]], of[good[of]]
        own, pairs = self.own.take(at), self.pairs.take(at)
        return sizes[:, :4], groups, (np.repeat(of, own[1]), own[0]), (np.repeat(of, pairs[1]), pairs[0])


#: The aligner of this worker, kept between batches.
_aligner: tuple[tuple[str, str], Aligner] | None = None


def aligner(paths: tuple[str, str]) -> Aligner:
    global _aligner
    if _aligner is None or _aligner[0] != paths:
        _aligner = (paths, Aligner(*paths))
    return _aligner[1]


def _distinct(of: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (text, value) once, and how often it is there; values are below `values`."""
    both, n = np.unique(of * values + value, return_counts=True)
    return both // values, both % values, n


def _align(paths: tuple[str, str]) -> Callable[[Batches], Batches]:
    """Each document's sizes, groups, and what is linked in it: identical ids and other pairs, each once with how often it is there, and which pairs count as such."""

    def lists(doc: np.ndarray, n: int, values: np.ndarray, type_: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values, type_))

    def run(batches: Batches) -> Batches:
        know = aligner(paths)
        vocabulary = len(know.bytes_a)
        for batch in tv.slices(batches, "__text"):
            n = batch.num_rows
            sizes, groups, own, pairs = know.align(batch.column(batch.schema.get_field_index("__text")))
            doc, id_, times = _distinct(*own, vocabulary)
            other, pair, often = _distinct(*pairs, vocabulary * know.step)
            a = pair // know.step
            twice = know.same[a] == pair % know.step  # what the map has too counts there, if the document is counted there
            twice[twice] = np.isin(other[twice] * vocabulary + a[twice], doc * vocabulary + id_)
            said = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
            new = dict(zip(("n_a", "n_b", "n_groups", "n_links"), (pa.array(c, pa.int64()) for c in sizes.T), strict=True)) | {"groups_sha256": pa.array(said, pa.string())}
            new |= {"__ids": lists(doc, n, id_, pa.int32()), "__times": lists(doc, n, times, pa.int32())}
            new |= {"__codes": lists(other, n, pair, pa.int64()), "__often": lists(other, n, often, pa.int32()), "__counts": lists(other, n, ~twice, pa.bool_())}
            yield batch_with(batch, new, drop=("__text",))

    return run


def _count(vocabulary: int) -> Callable[[Batches], Batches]:
    """A partition's documents of each identical id (in a vector) and of each other pair."""

    def out(own: bool, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), own)), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["own", "code", "n"])

    def run(batches: Batches) -> Batches:
        vector, held = np.zeros(vocabulary, dtype=np.int64), (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for batch in batches:
            ids, codes, counts = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            vector += np.bincount(ids, minlength=vocabulary)
            codes = codes[counts]
            both, place = np.unique(np.concatenate([held[0], codes]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([held[1], np.ones(len(codes))]), minlength=len(both)).astype(np.int64)
            held = (both, n)
            if len(both) > COMBINE:
                yield out(False, *held)
                held = (held[0][:0], held[1][:0])
        yield out(False, *held)
        some = np.flatnonzero(vector)
        yield out(True, some, vector[some])

    return run


def _look_up(step: int, shared) -> Callable[[Batches], Batches]:
    """What the vectors and the frequent pairs add to each document; the other pairs as a list."""

    def run(batches: Batches) -> Batches:
        total, best, same, codes, counts = shared.value
        for batch in batches:
            n = batch.num_rows
            ids, times, pairs, often = (batch.column(batch.schema.get_field_index(c)) for c in ("__ids", "__times", "__codes", "__often"))
            of_id, of_pair = (np.repeat(np.arange(n), pc.list_value_length(c).to_numpy()) for c in (ids, pairs))
            ids, times, pairs, often = (c.flatten().to_numpy().astype(np.int64) for c in (ids, times, pairs, often))
            a = pairs // step
            at = np.minimum(np.searchsorted(codes, pairs), max(len(codes) - 1, 0))
            frequent = codes[at] == pairs if len(codes) else np.zeros(len(a), dtype=bool)
            mapped = same[a] == pairs % step
            known = mapped | frequent
            count = np.concatenate([total[ids], np.where(mapped, total[a], counts[at] if len(codes) else 0)[known]])
            doc, id_, times = np.concatenate([of_id, of_pair[known]]), np.concatenate([ids, a[known]]), np.concatenate([times, often[known]])
            n_best, count_sum = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            np.add.at(count_sum, doc, times * count)
            np.add.at(n_best, doc, np.where(count == best[id_], times, 0))
            offsets = pa.array(np.searchsorted(of_pair[~known], np.arange(n + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pairs[~known], pa.int64()), pa.array(often[~known], pa.int64())], names=["code", "times"]))
            yield batch_with(batch, {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "__rest": lists}, drop=LINKED)

    return run


NEW = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: What is linked in each document, in a table between the passes.
LINKED = {"__ids": "array<int>", "__times": "array<int>", "__codes": "array<long>", "__often": "array<int>", "__counts": "array<boolean>"}


def _aligned(docs: DataFrame, paths: tuple[str, str], text_col: str) -> DataFrame:
    """docs, without the text, with sizes, groups and LINKED: written out, so that each text is encoded once."""
    rows = docs.withColumn("__text", F.col(text_col)).drop(text_col)
    fields = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), *LINKED.items()]
    return stored(rows.mapInArrow(_align(paths), with_fields(rows, *fields, drop=("__text",))))


def _pair_counts(aligned: DataFrame, vocabulary: int) -> DataFrame:
    counted = aligned.select("__ids", "__codes", "__counts").mapInArrow(_count(vocabulary), "own boolean, code long, n long")
    return cut_lineage(counted.groupBy("own", "code").agg(F.sum("n").alias("n")))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """(own, code, n): the documents that hold a pair linked. own rows are of ids in A that stand for their identical token in B, code being that id;
    the others' code is A's id times B's number of ids plus B's id, and leaves out documents that an own row counts for the same pair."""
    aligned = _aligned(docs.select(text_col), (path_a, path_b), text_col)
    counts = _pair_counts(aligned, len(aligner((path_a, path_b)).same))
    discard(aligned)
    return counts


def align_tokens(docs: DataFrame, path_a: str, path_b: str, few_pairs: int = FEW_PAIRS, text_col: str = "text") -> DataFrame:
    """docs, without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A, a byte-level BPE file, encodes a space and the text; B, a sentencepiece model that adds that space itself, the text; special tokens' strings are plain text. n_links are the
    pairs of token occurrences in one group, count_sum adds up the counts of their pairs of ids, and n_best those links whose count is the highest of their id in A, ties included.
    groups_sha256 is of `a1,a2|b1;a3|b2,b3`, the groups' ids in order.

    Null and empty texts, and those whose tokens in A or B don't give back the space and the text, have no tokens: zeros and an empty string. Repeated rows and rows
    without an id are documents each; ids are not looked at. An empty table gives an empty table. Other columns stay; those named like the new ones are replaced.
    Paths must be readable by executors.
    """
    spark, paths = docs.sparkSession, (path_a, path_b)
    docs = without(docs, NEW)
    same, step = aligner(paths).same, aligner(paths).step
    aligned = _aligned(docs, paths, text_col)
    counts = _pair_counts(aligned, len(same))
    split = counts.where("not own").select("code", F.expr(f"code div {step}").alias("a"), "n")
    vector = {r.code: r.n for r in counts.where("own").collect()}  # A's vocabulary at most
    mapped = dict(enumerate(same.tolist()))
    identical = spark.createDataFrame([(a * step + b,) for a, b in mapped.items() if b >= 0] or [(-1,)], "code long")
    more = {r.code // step: r.n for r in split.join(F.broadcast(identical), "code", "left_semi").collect()}  # as many
    total = np.zeros(len(same), dtype=np.int64)
    for a in {*vector, *more}:
        total[a] = vector.get(a, 0) + more.get(a, 0)
    best = total.copy()
    for r in split.groupBy("a").agg(F.max("n").alias("n")).collect():  # as many
        best[r.a] = max(best[r.a], r.n)
    # Frequent pairs: by powers of two, so many that they fit.
    sizes = {r.bits: r.n for r in split.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    bits, fit = 64, 0
    while bits > 0 and fit + sizes.get(bits, 0) <= few_pairs:
        fit, bits = fit + sizes.get(bits, 0), bits - 1
    frequent = F.col("n") >= F.lit(1 << bits)
    found = split.where(frequent).select("code", "n").toArrow() if bits else split.select("code", "n").toArrow()  # few_pairs rows at most
    codes, n = (found.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    shared = spark.sparkContext.broadcast((total, best, same, codes[order], n[order]))
    fields = [("n_best", "long"), ("count_sum", "long"), ("__rest", "array<struct<code: long, times: long>>")]
    out = cut_lineage(aligned.mapInArrow(_look_up(step, shared), with_fields(aligned, *fields, drop=LINKED))).withColumn("__row", F.monotonically_increasing_id())
    discard(aligned)
    if not bits:
        return out.drop("__rest", "__row")
    highest = spark.createDataFrame([(a, int(x)) for a, x in enumerate(best)], "a long, best long")
    rest = out.select("__row", F.explode("__rest").alias("r")).select("__row", "r.*").join(split.where(~frequent), "code").join(F.broadcast(highest), "a")
    rest = rest.groupBy("__row").agg(F.sum(F.col("times") * F.col("n")).alias("__sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("__best"))
    out = out.drop("__rest").join(rest, "__row", "left")
    return out.withColumns({"count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("__best", F.lit(0))}).drop("__row", "__sum", "__best")


def op12_token_align(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", *NEW)
