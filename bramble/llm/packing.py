"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A hash deals documents into groups of about GROUP bytes of text, so a group is a fair sample and
fits in a task however large the corpus is; repeated rows are dealt by their place too. In a group, documents longer than a sequence give
full sequences first; what is left of each, and all shorter documents, are placed longest
first into the first sequence with room. The tournament tree holds the most room below each
of its nodes, so the first fit is found by one walk down. A sequence that stays far from full
is cut at powers of two, lengths at which no padding is due.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bramble.llm.common import give_back, key
from bramble.llm.textvec import slices

#: Bytes of text in a group.
GROUP = 6_000_000
#: Chunks of text whose ids a task remembers.
KEPT_CHUNKS = 100_000
#: Pieces in a batch that a task gives back (2 MB of ids at most).
PIECES = 256
#: Room that a sequence may have left before it is cut at powers of two.
ROOM = 32


def _ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of a byte-level BPE whose ids follow the order of its merges, and that splits by the usual pattern; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        return None
    # Bytes that are no visible Latin-1 characters are written as characters from U+0100 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(visible))}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Encoder:
    """Ids of texts as the tokenizer gives them (its special strings included), with a memory for chunks that recur.

    The tokenizer never joins a space or line feed to what stands before it, unless that is white space too, so a text may be cut
    there; the ids of the chunks, one after another, are the ids of the text. Chunks of characters below U+0250, whose classes no
    Unicode version changes, are encoded by a faster library with the same vocabulary, if it has the form for that. Texts
    that can't be cut so, and those that hold a special string, are encoded whole.
    """

    #: The split pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [x["content"] for x in json.load(file).get("added_tokens", [])]
        self.fast = None
        if ranks := _ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.used = np.zeros(1 << 20, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), 0

    def _plain(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or max(text) < "\u0250")

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.known), len(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[first + 1 : first + n + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.known.update(zip(chunks, range(first, first + n), strict=True))

    def _learn(self, chunks: list[str]) -> None:
        # Chunks that begin with a space or line feed, and don't end with white space, are encoded as one text: its ids part where they do.
        plain, each = [], []
        for c in chunks:
            (plain if c[:1] in (" ", "\n") and not c[-1].isspace() and self._plain(c) else each).append(c)
        if plain:
            ids = np.array(self.fast("".join(plain)), dtype=np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(c.encode()) for c in plain])) + 1
            self._add(plain, ids, np.diff(ends, prepend=0))
        if each:
            rest = iter(self.tokenizer.encode_batch_fast([c for c in each if not self._plain(c)], add_special_tokens=False))
            ids = [self.fast(c) if self._plain(c) else next(rest).ids for c in each]
            self._add(each, np.fromiter(chain.from_iterable(ids), dtype=np.uint32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))

    def encode(self, texts: pa.Array, last: int | None) -> list[np.ndarray]:
        """The ids of each text (null: none), with `last` after them."""
        texts = texts.cast(pa.large_string()).fill_null("")
        special = pc.match_substring(texts, "\0")
        for x in self.special:
            special = pc.or_(special, pc.match_substring(texts, x))
        cut = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(cut, "\0")
        found = lists.flatten().dictionary_encode()
        at, chunks, bounds = found.indices.to_numpy(), found.dictionary.to_pylist(), lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        # White space at the end of a chunk that isn't a text's last one belongs together with what follows.
        loose = np.array([c[-1:].isspace() for c in chunks], dtype=bool)[at]
        loose[bounds[1:] - 1] = False
        whole = special.to_numpy(zero_copy_only=False) | (np.add.reduceat(loose, bounds[:-1]) > 0 if len(texts) else np.zeros(0, dtype=bool))
        used = np.zeros(len(chunks), dtype=bool)
        used[at[np.repeat(~whole, np.diff(bounds))]] = True
        if len(self.known) > KEPT_CHUNKS:
            self._forget()
        place = np.fromiter(map(self.known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero((place < 0) & used)
        if len(new):
            names = [chunks[i] for i in new.tolist()]
            self._learn(names)
            place[new] = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))
        place = np.maximum(place, 0)[at]
        starts = self.ends[place]
        lengths = np.where(np.repeat(whole, np.diff(bounds)), 0, self.ends[place + 1] - starts)
        before = np.r_[0, np.cumsum(lengths)]
        ids = self.flat[np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])]
        parts = before[bounds]
        tail = np.array([] if last is None else [last], dtype=np.uint32)
        out = []
        for i, odd in enumerate(whole.tolist()):
            own = ids[parts[i] : parts[i + 1]]
            if odd:
                text = texts[i].as_py()
                own = np.array(self.fast(text) if self._plain(text) and not any(x in text for x in self.special) else self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            out.append(np.concatenate([own, tail]))
        return out


class Tournament:
    """Bins of equal size; each inner node has the most room of the bins below it."""

    def __init__(self, bins: int, size: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """The first bin with room for so much, which it takes."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return bin_


def first_fit_decreasing(lengths: list[int], size: int) -> list[int]:
    """The bin of each length, none above size."""
    tree, out = Tournament(max(1, len(lengths)), size), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        out[i] = tree.place(lengths[i])
    return out


def pack(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents with so many tokens."""
    pieces, rest = [], []
    sequence = 0
    for d, n in enumerate(lengths):
        full = n // size
        for i in range(full):
            pieces.append((d, i * size, size, sequence, 0))
            sequence += 1
        if n % size:
            rest.append((d, full * size, n % size))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for b, piece in zip(first_fit_decreasing([n for _, _, n in rest], size), rest, strict=True):
        bins.setdefault(b, []).append(piece)
    for _, held in sorted(bins.items()):
        left = sum(n for _, _, n in held)
        target = size if size - left <= ROOM else 1 << (left.bit_length() - 1)
        offset = 0
        for d, start, n in held:
            while n:
                part = min(n, target - offset)
                pieces.append((d, start, part, sequence, offset))
                d, start, n, offset, left = d, start + part, n - part, offset + part, left - part
                if offset == target and left:
                    sequence, offset, target = sequence + 1, 0, 1 << (left.bit_length() - 1)
        sequence += 1
    return pieces


def _group(path: str, size: int, last: int | None) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _encoder
        if _encoder is None or _encoder[0] != path:
            _encoder = (path, Encoder(path))
        docs: list[tuple] = []
        for batch in slices(batches, "__text", 1_000_000):
            at = batch.schema.get_field_index
            ids = _encoder[1].encode(batch.column(at("__text")), last)
            docs += zip(batch.column(at("__doc")).to_pylist(), batch.column(at("__id")).to_pylist(), ids, strict=True)
        docs.sort(key=lambda d: (d[0], len(d[2]), d[2].tobytes()))
        base = keys[0].as_py() << 32
        pieces = pack([len(d[2]) for d in docs], size)
        for low in range(0, len(pieces), PIECES):
            d, start, length, sequence, offset = (list(x) for x in zip(*pieces[low : low + PIECES], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs[i][1] for i in d], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([docs[i][2][a : a + n].astype("<u4").tobytes() for i, a, n in zip(d, start, length, strict=True)], pa.binary()),
                 pa.array([len(docs[i][2]) for i in d], pa.int64()), pa.array([base + s for s in sequence], pa.int64()), pa.array(offset, pa.int64())],
                names=["__id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
        del docs, pieces
        give_back()  # workers live on between groups and stages

    return run


#: The encoder of this worker, kept between groups.
_encoder: tuple[str, Encoder] | None = None


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, last: int | None = 1, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) for each piece of each document.

    ids are the piece's tokens, little-endian unsigned 32-bit integers. Each token of a document (its
    text's, and `last`, unless that is None) is in exactly one piece. A document that fits in a sequence is cut only in a sequence
    that has over ROOM tokens of room left. sequence_id is unique over all groups; offsets are gapless in a sequence.

    `tokenizer` is a path that executors can read. Null texts are empty: they are `last` alone. Rows without an id or with an equal one are
    documents like any other. An empty table gives an empty table; other columns are not looked at. Rows are dealt by their place too, so docs
    must be a stored table or a checkpoint, which gives them in the same order when a lost task is run again.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-total // group))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), key(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    # The place tells repeated rows apart; a group's number is drawn once, before rows move.
    rows = rows.withColumn("__group", F.pmod(F.xxhash64(F.lit("pack"), "__doc", F.monotonically_increasing_id()), F.lit(groups)))
    out = rows.groupBy("__group").applyInArrow(_group(tokenizer, size, last), "__id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("__id", id_col)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
