"""Words and rolling hashes of many texts at once, with numpy over the Arrow buffers.

A batch of texts is one byte buffer plus offsets, so cutting words, hashing them and
hashing k-grams are a few array operations however many texts there are. Word classes are
byte tables: all separators used here are ASCII, so UTF-8 never needs decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Bytes that belong to words: all but ASCII white space; and all but ASCII other than a-z and 0-9.
NOT_SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_keys: dict[int, np.ndarray] = {}


def keys(seed: int, n: int) -> np.ndarray:
    """At least n odd 64-bit multipliers, the same on every machine."""
    have = _keys.get(seed)
    if have is None or len(have) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = mix((np.arange(size, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed) * U(0xD1342543DE82EF95)) | U(1)
        _keys[seed] = have
    return have


@dataclass
class Words:
    """The words of a batch: raw bytes, each word's start and end byte, and each text's first word (one more entry at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a multilinear sum with a key for each place."""
        if not len(self.starts):
            return np.zeros(0, dtype=U)
        lengths = self.ends - self.starts
        at = np.zeros(len(lengths), dtype=np.int64)
        np.cumsum(lengths[:-1], out=at[1:])
        place = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
        values = self.data[np.repeat(self.starts, lengths) + place].astype(U) + U(1)
        values *= keys(seed, int(lengths.max()))[place]
        return mix(np.add.reduceat(values, at) + lengths.astype(U))

    def kept(self, text: int, keep: np.ndarray) -> bytes:
        """The words of one text that keep (a flag for each) names, joined by one space."""
        low = self.first[text]
        s, e = self.starts[low : low + len(keep)], self.ends[low : low + len(keep)]
        raw = self.data
        return b" ".join([raw[a:b].tobytes() for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def cut(texts: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> Words:
    """The words of all texts: the longest runs of bytes that the table has."""
    raw, offsets = buffers(texts)
    if lower:
        raw = _LOWER[raw]
    inside = word_bytes[raw]
    n = len(raw)
    begins, ends = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    begins[:n], ends[1:] = inside, inside
    begins[1:n] &= ~inside[:-1]
    ends[1:n] &= ~inside[1:]
    for edge in (offsets[:-1], offsets[1:]):  # a word never goes on into the next text
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] |= inside[edge]
        ends[edge] |= inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(raw, starts, stops, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and of each text the first of them (no run crosses texts).

    The run that starts at word i of text t has number i - t * (k - 1) less what short texts lack;
    `first` gives where each text's runs begin, so run r of text t starts at its word r - first[t].
    """
    n = len(hashes) - k + 1
    counts = np.maximum(np.diff(first) - k + 1, 0)
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    if n <= 0 or not out[-1]:
        return np.zeros(0, dtype=U), out
    key = keys(seed, k)
    rolled = hashes[:n] * key[0]
    for j in range(1, k):
        rolled += hashes[j : j + n] * key[j]
    valid = np.repeat(first[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mix(rolled[valid]), out


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of text (a longer text is a piece of its own), so memory stays bounded."""
    for batch in batches:
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
