"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the vector of its hashed form plus those of its hashed character n-grams (with marks
for the word's ends), so inflected forms of a known stem are known too. Two gated
recurrent units read each window forwards and backwards, attention pools their states, and
a document's score is that of its worst window. All windows of WINDOW words overlap by half and cover
the whole text.

Labels are of documents, not of windows: training takes the worst window of each document, as the network
sees it at the time, for the document's label, and looks again after each round. The vectors start from
log-odds of words and n-grams among the training documents. Training uses at most TRAIN documents
(clean, toxic), the first by a hash of their ids, and of each at most TRAIN_WORDS words: from a longer one,
stretches spread evenly over all of it. It runs in one task, never on the driver, over that bounded sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import batch_with, released, with_fields, without

WINDOW, STRIDE = 32, 16
TRAIN, TRAIN_WORDS = (4000, 2000), 2048
#: Bytes of a word in training; longer ones are no words of any language.
TRAIN_WORD = 200
WORD_BITS, GRAM_BITS, WIDTH, HIDDEN = 15, 16, 8, 8
GRAMS = (3, 5)
#: Rounds, steps of each, windows of a step (a quarter of them bad).
ROUNDS, STEPS, BATCH = 6, 100, 128
#: Documents in which a bucket's log-odds are drawn halfway towards 0; step sizes of the vectors and of all else.
DOUBT, VECTOR_STEP, STEP = 2, 0.02, 0.01
#: Windows that a worker scores at once.
BLOCK = 2048
#: Bytes of text, and distinct words, that are hashed at once; windows that are numbered at once.
SLICE, WORDS, SOME = 500_000, 50_000, 20_000
f4 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return f4(0.5) * (np.tanh(f4(0.5) * x) + f4(1))


class Inputs:
    """The windows of a batch of texts over its distinct words: each word's hash bucket and n-gram buckets.

    Texts are read a slice at a time, and n-grams hashed some words at a time, so what is in between stays small.
    """

    def __init__(self, texts: pa.Array) -> None:
        hashes, counts, new, lengths, raw, known = [], [], [], [], [], np.zeros(0, dtype=tv.U)
        for part in tv.slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), most=SLICE):
            words = tv.cut(part.column(0), tv.ALNUM, lower=True)
            h = words.hashes()
            hashes.append(h)
            counts.append(words.counts)
            own, where = np.unique(h, return_index=True)
            where = where[~np.isin(own, known)]
            known = np.union1d(known, own)
            start, n = words.starts[where], (words.ends - words.starts)[where]
            new.append(h[where])
            lengths.append(n)
            raw.append(words.data[np.repeat(start - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(int(n.sum()))])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        distinct, lengths, raw = join(new, tv.U), join(lengths, np.int64), join(raw, np.uint8)
        self.counts = join(counts, np.int64)
        self.first = np.r_[0, np.cumsum(self.counts)]
        order = np.argsort(distinct)
        self.word = order[np.searchsorted(known, join(hashes, tv.U))].astype(np.int32)
        self.buckets = (distinct >> tv.U(64 - WORD_BITS)).astype(np.int32)
        at, grams, sizes = np.r_[0, np.cumsum(lengths)], [], []
        for low in range(0, len(lengths), WORDS):
            some = slice(low, low + WORDS)
            g, n = self._grams(raw[at[low] : at[min(low + WORDS, len(lengths))]], lengths[some])
            grams.append(g)
            sizes.append(n)
        self.grams, self.sizes = join(grams, np.int32), join(sizes, np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]

    @staticmethod
    def _grams(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the n-grams of words, a word's after another's, and how many each has."""
        sizes = lengths + 2
        base = np.r_[0, np.cumsum(sizes)]
        codes = np.zeros(base[-1] + max(GRAMS), dtype=tv.U)
        inner = np.arange(len(raw)) + np.repeat(base[:-1] + 1 - np.r_[0, np.cumsum(lengths)][:-1], lengths)
        codes[inner] = raw.astype(tv.U) + tv.U(3)
        codes[base[:-1]], codes[base[1:] - 1] = 1, 2
        each = [np.maximum(sizes - k + 1, 0) for k in GRAMS]
        total = sum(each)
        start = np.r_[0, np.cumsum(total)][:-1]
        out = np.zeros(int(total.sum()), dtype=np.int32)
        for k, n in zip(GRAMS, each, strict=True):
            count = np.arange(int(n.sum())) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
            at = np.repeat(base[:-1], n) + count
            h = codes[at] * tv.keys(21 + k, k)[0]
            for j in range(1, k):
                h += codes[at + j] * tv.keys(21 + k, k)[j]
            out[np.repeat(start, n) + count] = tv.mix(h) >> tv.U(64 - GRAM_BITS)
            start = start + n
        return out, total

    def grams_of(self, ids: np.ndarray) -> np.ndarray:
        """The n-gram buckets of some words, one word's after another's."""
        n, start = self.sizes[ids], self.starts[ids]
        return self.grams[np.repeat(start - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(int(n.sum()))]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all windows (0 stands for no word, so numbers are one more), and each window's text."""
        per_text = np.where(self.counts > 0, np.maximum(-(-(self.counts - WINDOW) // STRIDE), 0) + 1, 0)
        text = np.repeat(np.arange(len(self.counts)), per_text)
        number = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(per_text)][:-1], per_text)
        out = np.zeros((len(text), WINDOW), dtype=np.int32)
        for low in range(0, len(text), SOME):
            some = slice(low, low + SOME)
            place = number[some, None] * STRIDE + np.arange(WINDOW)
            inside = place < self.counts[text[some]][:, None]
            out[some][inside] = self.word[(self.first[text[some]][:, None] + place)[inside]] + 1
        return out, text


class Network:
    """Parameters, forward and backward passes. Arrays are time first: (WINDOW, windows, ...)."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(f4)
        self.words = (0.05 * rng.standard_normal((1 << WORD_BITS, WIDTH))).astype(f4)
        self.grams = (0.05 * rng.standard_normal((1 << GRAM_BITS, WIDTH))).astype(f4)
        self.p = {"out": normal(2 * HIDDEN), "bias": np.zeros(1, f4), "att": normal(2 * HIDDEN, HIDDEN), "att_b": np.zeros(HIDDEN, f4), "att_v": normal(HIDDEN)}
        for d in "fb":
            self.p |= {f"x{d}": normal(WIDTH, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, f4), f"h{d}": normal(HIDDEN, 3 * HIDDEN)}

    def vectors(self, inputs: Inputs) -> np.ndarray:
        """A row for each distinct word, after one of zeros for no word."""
        out = np.zeros((len(inputs.buckets) + 1, WIDTH), dtype=f4)
        for low in range(0, len(inputs.buckets), WORDS):
            ids = np.arange(low, min(low + WORDS, len(inputs.buckets)))
            out[1 + ids] = self.of_words(inputs.buckets[ids], inputs.grams_of(ids), inputs.sizes[ids])
        return out

    def of_words(self, buckets: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The vectors of words with these buckets, n-grams and counts of n-grams (every word has one at least)."""
        return self.words[buckets] + np.add.reduceat(self.grams[grams], np.r_[0, np.cumsum(sizes)][:-1], axis=0)

    def _gru(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time for projected inputs (time, windows, 3 * HIDDEN), backwards for d = b."""
        H, u = HIDDEN, self.p[f"h{d}"]
        uzr, un = np.ascontiguousarray(u[:, : 2 * H]), np.ascontiguousarray(u[:, 2 * H :])
        h, out, held = np.zeros((x.shape[1], H), dtype=f4), np.empty((*x.shape[:2], H), dtype=f4), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            zr = _sigmoid(x[t, :, : 2 * H] + h @ uzr)
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(x[t, :, 2 * H :] + (r * h) @ un)
            if keep:
                held.append((t, h, z, r, n))
            h = n + z * (h - n)
            out[t] = h
        return out, held

    def forward(self, vectors: np.ndarray, windows: np.ndarray, keep: bool = False):
        p, at = self.p, windows.T
        states, held = [], []
        for d in "fb":
            s, k = self._gru((vectors @ p[f"x{d}"] + p[f"b{d}"])[at], d, keep)
            states.append(s)
            held.append(k)
        h = np.concatenate(states, axis=2)
        a = np.tanh(h @ p["att"] + p["att_b"])
        e = np.where(at > 0, a @ p["att_v"], f4(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        c = np.einsum("tb,tbh->bh", w, h)
        logit = c @ p["out"] + p["bias"]
        return (logit, (at, held, h, a, w, c)) if keep else logit

    def gradients(self, vectors: np.ndarray, kept: tuple, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the parameters, and of the vectors of words."""
        p, H = self.p, HIDDEN
        at, held, h, a, w, c = kept
        g = {"out": c.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dc = dlogit[:, None] * p["out"]
        dw = np.einsum("bh,tbh->tb", dc, h)
        de = w * (dw - (w * dw).sum(axis=0))
        g["att_v"] = np.einsum("tb,tba->a", de, a)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("tbh,tba->ha", h, da), da.sum(axis=(0, 1))
        dh_all = w[:, :, None] * dc + da @ p["att"].T
        dvectors = np.zeros_like(vectors)
        for i, d in enumerate("fb"):
            u = p[f"h{d}"]
            uzr, un = u[:, : 2 * H], u[:, 2 * H :]
            du, dx = np.zeros_like(u), np.empty((*at.shape, 3 * H), dtype=f4)
            dh = np.zeros((at.shape[1], H), dtype=f4)
            for t, before, z, r, n in reversed(held[i]):
                dh = dh + dh_all[t, :, i * H : (i + 1) * H]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                drh = dn @ un.T
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                du[:, 2 * H :] += (r * before).T @ dn
                du[:, : 2 * H] += before.T @ dzr
                dx[t] = np.concatenate([dzr, dn], axis=1)
                dh = dh * z + drh * r + dzr @ uzr.T
            g[f"h{d}"], g[f"b{d}"] = du, dx.sum(axis=(0, 1))
            each = np.zeros((len(vectors), 3 * H), dtype=f4)
            np.add.at(each, at.ravel(), dx.reshape(-1, 3 * H))
            g[f"x{d}"] = vectors.T @ each
            dvectors += each @ p[f"x{d}"].T
        return g, dvectors

    def scores(self, inputs: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows, their texts and their logits."""
        windows, text = inputs.windows()
        vectors = self.vectors(inputs)
        parts = [self.forward(vectors, windows[i : i + BLOCK]) for i in range(0, len(windows), BLOCK)]
        return windows, text, np.concatenate(parts) if parts else np.zeros(0, dtype=f4)


def _log_odds(inputs: Inputs, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the bad class, for each word and n-gram bucket by the documents that have it, drawn towards 0 where few have it."""
    sizes = (1 << WORD_BITS, 1 << GRAM_BITS)
    bad, all_ = [np.zeros(x) for x in sizes], [np.zeros(x) for x in sizes]
    for d, label in enumerate(labels):
        words = np.unique(inputs.word[inputs.first[d] : inputs.first[d + 1]])
        for i, found in enumerate((inputs.buckets[words], inputs.grams_of(words))):
            own = np.unique(found)
            all_[i][own] += 1
            bad[i][own] += label
    n_bad, n, out = labels.sum(), len(labels), []
    for b, a in zip(bad, all_, strict=True):
        odds = np.log((b + 0.5) / (n_bad + 1)) - np.log((a - b + 0.5) / (n - n_bad + 1))
        out.append(np.maximum(np.where(a > 0, odds * a / (a + DOUBT), 0), -0.5).astype(f4))
    return out[0], out[1]


def train(texts: list[str], labels: list[int], seed: int = 1) -> Network:
    """A network for labels 1 (bad) and 0; without texts of both classes, it is as it starts."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, dtype=f4)
    inputs = Inputs(pa.array(texts, pa.string()))
    if len(set(y[inputs.counts > 0])) < 2:
        net.p["bias"][:] = -3
        return net
    by_word, by_gram = _log_odds(inputs, y)
    net.words[:, 0] += f4(0.5) * by_word
    net.grams[:, 0] += f4(0.15) * by_gram

    windows, text = inputs.windows()
    vectors = net.vectors(inputs)
    logits = vectors[:, 0][windows].max(axis=1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    seen_words, seen_grams, step = np.full(1 << WORD_BITS, 1e-3, f4), np.full(1 << GRAM_BITS, 1e-3, f4), 0
    for round_ in range(ROUNDS):
        if round_:
            logits = np.concatenate([net.forward(vectors, windows[i : i + BLOCK]) for i in range(0, len(windows), BLOCK)])
        order = np.lexsort((-logits, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        worst = [order[(rank < 1 + (y[text[order]] == 0)) & (y[text[order]] == c)] for c in (0, 1)]
        for _ in range(STEPS):
            at = np.concatenate([rng.choice(w, n) for w, n in zip(worst, (BATCH * 3 // 4, BATCH // 4), strict=True)])
            own, back = np.unique(np.r_[0, windows[at].ravel()], return_inverse=True)
            used = vectors[own]
            logit, kept = net.forward(used, back[1:].reshape(windows[at].shape), keep=True)
            g, dv = net.gradients(used, kept, (_sigmoid(logit) - y[text[at]]) / len(at))
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (STEP * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(f4)
            ids, dv = own[1:] - 1, dv[1:]
            buckets, flat, n = inputs.buckets[ids], inputs.grams_of(ids), inputs.sizes[ids]
            _step(net.words, seen_words, buckets, dv)
            _step(net.grams, seen_grams, flat, np.repeat(dv, n, axis=0))
            vectors[own[1:]] = net.of_words(buckets, flat, n)
        vectors = net.vectors(inputs)
    return net


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """A step of Adagrad on the rows of a table."""
    own, back = np.unique(rows, return_inverse=True)
    total = np.zeros((len(own), table.shape[1]), dtype=f4)
    np.add.at(total, back, gradient)
    seen[own] += (total * total).mean(axis=1)
    table[own] -= f4(VECTOR_STEP) * total / np.sqrt(seen[own])[:, None]


def _score(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in tv.slices(batches, text_col, SLICE):
            inputs = Inputs(batch.column(batch.schema.get_field_index(text_col)))
            _, text, logits = net.scores(inputs)
            worst = np.full(batch.num_rows, net.p["bias"][0] - 5, dtype=f4)
            np.maximum.at(worst, text, logits)
            yield batch_with(batch, {"score": pa.array(_sigmoid(worst).astype(np.float64))})

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows with only as many words of each text as training looks at."""
    for batch in tv.slices(batches):
        words, texts = tv.cut(batch.column(2), tv.ALNUM, lower=True), []
        sizes = words.ends - words.starts
        for t, n in enumerate(words.counts.tolist()):
            keep = sizes[words.first[t] : words.first[t + 1]] <= TRAIN_WORD
            if n > TRAIN_WORDS:
                stretches = np.zeros(-(-n // WINDOW), dtype=bool)
                stretches[np.linspace(0, len(stretches) - 1, TRAIN_WORDS // WINDOW).astype(int)] = True
                keep &= np.repeat(stretches, WINDOW)[:n]
            texts.append(words.kept(t, keep).decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["__id", "y", "text"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The network of all rows, pickled."""
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
    net = train([r[2] for r in rows], [r[1] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["network"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network trained on a bounded sample of labelled rows that are not held out.

    An id with several labels counts as toxic if one says so; of several texts with one id, the smallest
    is taken. Rows without an id, a label or a text don't train.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    known = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("__id")).join(marks, "__id").dropDuplicates(["__id"])
    draw = [known.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in enumerate(TRAIN)]
    ids = draw[0].unionByName(draw[1])
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.length("text") > 0).join(F.broadcast(ids), "__id")  # sum(TRAIN) ids at most
    rows = rows.groupBy("__id", "y").agg(F.min("text").alias("text")).mapInArrow(released(_excerpts), "__id long, y int, text string")
    found = rows.repartition(1).mapInArrow(released(_trained), "network binary").collect()  # one row
    return pickle.loads(found[0].network) if found else train([], [])


def score_toxicity(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """docs with score, 0 to 1: higher where the worst window is likelier toxic.

    Null and empty texts, and texts without words, get the lowest score. Each row is scored by its text
    alone, so ids, repeated rows and other columns play no part; a column named score is replaced.
    An empty table gives an empty table.
    """
    docs = without(docs, ("score",))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return docs.mapInArrow(released(_score(shared, text_col)), with_fields(docs, ("score", "double")))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    out = score_toxicity(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
