"""Operators on documents against plain versions, over a table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bramble.llm import decontamination, fingerprint, license_scan, near_dup, packing, quality, sharding, splitters, substring_dedup, textvec, toxicity
from bramble.llm.substring_dedup import dedup_substrings
from bramble.operators import graph

SCHEMA = "doc_id long, text string, lang string, score double, n_words int, kept boolean, size int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base, passage = words(rng, 120), words(rng, 45)
    out = {0: None, 1: "", 2: "   \n\t ", 3: "one", 4: "Two words", 5: "two WORDS"}
    for i in range(10, 50):  # near copies, more than fit in a small bucket
        out[i] = " ".join([*base[:60], f"x{i}", *base[61:]])
    for i in range(50, 56):
        out[i] = " ".join(base)
    for i in range(60, 70):
        out[i] = " ".join([*words(rng, 30), *passage, *words(rng, 20)])
    out[70] = " ".join(words(rng, 40_000, 3000))
    out[71] = "é é  ﬁ 你好 <|endoftext|> " * 3
    out[72] = " ".join(["ha"] * 60)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, x, "en", 0.5, 1, True, 2) for i, x in texts.items()], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substrings(docs, texts):
    seen, want = set(), {}
    for i, text in sorted(texts.items()):
        w, gone = split(text), set()
        for at in range(len(w) - 19):
            if (window := tuple(w[at : at + 20])) in seen:
                gone.update(range(at, at + 20))
            seen.add(window)
        want[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    for cells in (substring_dedup.MOST_CELLS, 0):  # one sketch for all tasks; slices
        got = dedup_substrings(docs, most_cells=cells, slice_cells=1 << 12)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == want
    assert set(docs.columns) < set(got.columns)
    assert dedup_substrings(docs.limit(0)).count() == 0 and dedup_substrings(docs.limit(0), most_cells=0).count() == 0


def test_substrings_odd_rows(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(25)) for c in "to")
    rows = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (None, other), (None, other), (None, other + " and more"), (None, None)], "doc_id long, text string")
    for cells in (substring_dedup.MOST_CELLS, 0):
        got = collections.Counter((r.doc_id, r.n_removed) for r in dedup_substrings(rows, most_cells=cells, slice_cells=1 << 12).where("text not like 'o%'").collect())
        assert got == {(None, 25): 1, (7, 0): 2, (9, 25): 1}
    # Of the texts without an id, the one whose key is smaller keeps the passage; equal ones are one document.
    odd = sorted(r.n_removed for r in dedup_substrings(rows).where("text like 'o%'").collect())
    assert odd in ([0, 0, 25], [0, 25, 25])


def test_substrings_layout(spark):
    text = "\n".join(" ".join(f"a{i}" for i in range(n, n + 10)) for n in range(0, 30, 10))
    rows = spark.createDataFrame([(1, text), (2, f"Head\n\n {text}\nmiddle \t {text}"), (3, f"{text} tail\n"), (4, " as\tit  is ")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in dedup_substrings(rows, layout=True).collect()}
    assert got == {1: text, 2: "Head\n\n middle \t ", 3: "tail\n", 4: " as\tit  is "}


def test_sliced_sketch_stays_sparse():
    """The share of distinct windows that pass a slice doesn't grow with the number of slices."""
    rng, shares = np.random.default_rng(4), []
    for slices in (2, 20):
        passed = total = 0
        anchors = np.unique(rng.integers(0, 1 << 63, slices * (1 << 12) // 3).astype(np.uint64))
        at = textvec.mix(anchors ^ np.uint64(0x51CE)) % np.uint64(slices)
        for s in range(slices):
            own = anchors[at == s]
            batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), dtype=np.int64)), pa.array(own.view(np.int64)), pa.array(np.zeros(len(own), dtype=bool))], names=["slice", "anchor", "again"])
            passed += next(substring_dedup._slice_estimates(1 << 13)((), iter([batch]))).num_rows
            total += len(own)
        shares.append(passed / total)
    assert max(shares) < 0.12 and abs(shares[0] - shares[1]) < 0.02


def test_near_dup(docs, texts):
    sets = {}
    for i, text in texts.items():
        w = split((text or "").lower())
        sets[i] = {tuple(w[a : a + 2]) for a in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, k=2).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_near_dup_hard_bucket(spark, monkeypatch):
    """Copies that are each a little too far from most others; some links are there, in blocks smaller than the group."""
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(near_dup, "FEW_MEMBERS", 8)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = {}
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(100), rng.choice((2, 5, 7, 8))):
            w[at] = f"e{i}-{at}"
        rows[i] = " ".join(w)
    sets = {i: set(zip(x.split(), x.split()[1:])) for i, x in rows.items()}
    label = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    assert len(set(label.values())) > 3
    got = near_dup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), k=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == label


def test_near_dup_at_the_limit():
    """Two sets right at the limit, with so many elements in common that float32 rounds a hundred times their number."""
    n = 671_089
    elements = np.arange(2 * n)
    for missing, want in ((0, [(1, 2)]), (1, [])):
        lists = pa.array([elements[: n - missing], elements])
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 1]), lists], names=["rep", "side", "elements"])
        found = next(near_dup._compare_blocks(50)((None, pa.scalar(0), pa.scalar(0)), iter([batch])))
        assert list(zip(*found.to_pydict().values(), strict=True)) == want


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 62, 600).astype(np.uint64)])
    two = near_dup.sketches(np.concatenate([a, b, a[:1]]), np.array([0, 3000, 6000, 6001]))
    assert (two != near_dup.FULL).all()
    assert abs((two[0] == two[1]).mean() - 2400 / 3600) < 0.15


def test_fingerprints(docs, texts):
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert got[0] == got[1] == got[2] and got[4] == got[5] and got[50] == got[55] and got[10] != got[11]
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_canonical(spark):
    acute, dot, wide = chr(0x301), chr(0x323), chr(0xFF21) + chr(0xFF22)
    pairs = [(unicodedata.normalize("NFC", x), unicodedata.normalize("NFD", x)) for x in (chr(0xE9), chr(0xC9) + "cole", chr(0x1ED1), chr(0x1EA1) + acute)]
    pairs += [("a" + acute + dot, "a" + dot + acute), (chr(0x212B), "A" + chr(0x30A)), (wide, "ab"), ("Stra" + chr(0xDF) + "e", "STRASSE"), ("a" + chr(0xA0) + " b", " A B "), ("q" + acute, "Q" + acute)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(fingerprint.canonical(F.col("a")).alias("a"), fingerprint.canonical(F.col("b")).alias("b")).collect()
    assert [ascii(r.a) for r in rows] == [ascii(r.b) for r in rows]
    assert rows[9].a == "q" + acute and rows[4].a == "a" + dot + acute


def test_clash(spark):
    rows = spark.createDataFrame([("f", "one"), ("f", "ONE "), ("g", "one"), ("g", "two")], "fp string, text string")
    assert [r.fp for r in fingerprint.clashes(rows).collect()] == ["g"]
    assert fingerprint.clashes(rows.where("fp = 'f'")) is None


def test_next(docs, texts):
    order = sorted(texts, reverse=True)
    want = {i: texts[order[(n + 1) % len(order)]] or "" for n, i in enumerate(order)}
    assert {r.doc_id: r.next_text for r in fingerprint.with_next(docs).collect()} == want


def test_next_over_ranges(spark, monkeypatch):
    """Ranges by bytes, in two levels of splitters; an id and a row that are repeated very often make several ranges."""
    monkeypatch.setattr(fingerprint, "BYTES", 40)
    monkeypatch.setattr(splitters, "BLOCKS", 5)
    for least in (1, 60):
        monkeypatch.setattr(fingerprint, "LEAST", least)
        rows = spark.range(0, 900, 3, 4).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
        got = {r.doc_id: r.next_text for r in fingerprint.with_next(rows).collect()}
        assert got == {i: str(i - 3 if i else 897) for i in range(0, 900, 3)}
    many = spark.createDataFrame([*((5, f"x{i % 7}") for i in range(200)), *((None, "none") for _ in range(100)), (3, "three"), (9, "nine")], "doc_id long, text string").repartition(3)
    many = graph.cut_lineage(many)
    got = collections.Counter((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(many).collect())
    assert sum(got.values()) == 302 and got[None, "none", "none"] == 99 and got[None, "none", "nine"] == 1 and got[3, "three", "none"] == 1
    steps = collections.Counter((a, b) for (i, a, b), n in got.items() if i == 5 and a != b)
    assert len(steps) == 7 and sum(n for (i, a, b), n in got.items() if i == 5 and a == b) == 200 - 7


def test_ranges_follow_bytes(spark, monkeypatch):
    monkeypatch.setattr(splitters, "BLOCKS", 8)
    seen = []
    for n in (2000, 20_000):
        rows = graph.cut_lineage(spark.range(n).select(F.xxhash64("id").alias("h"), F.lit(100).alias("size")))
        found = splitters.ranges(rows, "h", F.struct("h"), "size", 100 * n, n // 50)
        each = found.with_range(rows, F.col("h"), F.struct("h")).groupBy("__r").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("z")).orderBy("__r").collect()
        assert all(a.z < b.a for a, b in zip(each, each[1:]))
        assert max(r.n for r in each) < 50 * 8
        seen.append(len(each))
    assert seen[1] > 7 * seen[0]


def test_shards(docs, texts):
    rows = sharding.shard_by_bytes(docs, shards=4).collect()
    assert len(rows) == len(texts)
    slots, shard_of = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        shard_of[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_shards_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard_by_bytes(rows).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("s")).collect()
    assert len(got) == 16 and max(r.b for r in got) < 1.05 * min(r.b for r in got) and all(r.s == r.n - 1 for r in got)


def test_shards_keep_copies_together(spark, monkeypatch):
    """Only a text whose copies exceed a shard's share is split; large groups, repeated rows and rows without an id are not."""
    monkeypatch.setattr(splitters, "BLOCKS", 8)
    text = F.when(F.col("id") < 400, "a" * 90).when(F.col("id") < 600, "b" * 90).when(F.col("id") < 700, "c" * 90).otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 3), F.lit("y" * 60)))
    rows = spark.range(6000).select(F.when(F.col("id") % 5 > 0, F.floor(F.col("id") / 2)).alias("doc_id"), text.alias("text"), F.lit(1).alias("shard"))
    got = sharding.shard_by_bytes(graph.cut_lineage(rows), shards=4).collect()
    assert len(got) == 6000
    total, at = collections.Counter(), collections.defaultdict(set)
    for r in got:
        total[r.shard] += r["size"]
        at[r.text].add(r.shard)
    assert all(len(s) == 1 for s in at.values()) and max(total.values()) < 1.06 * min(total.values())
    assert sharding.filled_up([0, 10, 4], 3) == [0, 3, 3] and sharding.filled_up([1, 1], 4) == [0, 2]


def test_licenses(docs, spark):
    assert license_scan.scan_licenses(docs).where("n_base > 0").count() == 0
    cases = [
        (1, "ALL Rights-Reserved. cc by, cc  BY", "cc-by,reserved"), (2, "all rights not reserved", ""), (3, None, ""), (4, "GNU General Public License", "gpl"), (5, "Released under the very MIT License", "mit"),
        (6, "permission is hereby granted free of charge to some person who gets a copy of this software and associated documentation files", "mit"), (7, "all rights all rights reserved", "reserved"),
        (8, "Licensed under CC BY 4.0", "cc-by"), (9, "Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"), (10, "This work is licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
        (11, "Licensed under the GNU Lesser General Public License version 3", "gpl,lgpl-3.0"), (12, "licensed under a creative commons attribution noncommercial 4.0 international license; released under the MIT license", "cc-by-nc,mit"),
        (13, "of this and the terms of the copy of this or without any of the conditions " * 50, ""), (14, "This work is licensed under CC BY 4.0. This work is licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), (8, "Licensed under CC BY 4.0", "cc-by"),
    ]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert {i: got[i].labels for i, _, _ in cases} == {i: x for i, _, x in cases}
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (3, 0, 5) and got[7].first_word == 2 and got[3].n_words == 0 and got[6].n_base == 0


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    pieces, sequences = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in packing.pack_documents(docs, path, group=50_000).collect():
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id][r.start] = ids
        sequences[r.sequence_id][r.offset] = r.length
    for i, text in texts.items():
        assert [x for _, p in sorted(pieces[i].items()) for x in p] == [*plain.encode(text or "", add_special_tokens=False).ids, 1]
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held.items()):
            assert offset == at
            at += length
        assert at <= 2048 and (at & (at - 1) == 0 or 2048 - at <= packing.ROOM)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_encoder_edges():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    bits = [" ", "  ", "\n", "\t", "a", "b", "\u00e9", "\u4e16", "'s", "1", "<|", "<|endoftext|>", "\x1c", "\u3000", ".", "\x00", "\xa0", "\u01c6", "\ud7ff"]
    rng = random.Random(9)
    odd = ["", None, " ", "\n", "trail ", "don't  stop", "x<|endoftext|>", *("".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000))]
    encoder = packing.Encoder(path)
    for texts in (odd, odd[::-1]):
        got = encoder.encode(pa.array(texts), None)
        assert [x.tolist() for x in got] == [plain.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_packing_repeated_rows(spark):
    """Rows that are equal in everything are dealt over the groups, and each gets its own pieces."""
    import public_tokenizers

    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("the same words again and again").alias("text"), F.lit(1).alias("start"))
    got = packing.pack_documents(rows, public_tokenizers.path("byte_bpe_50k.json"), group=20_000).select("doc_id", "sequence_id", "offset", "length").collect()
    assert len({r.sequence_id >> 32 for r in got}) == 6 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.length for r in got) == 4000 * 7


def test_first_fit_decreasing():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    room, want = [], {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (at == len(room))
        room[at] -= lengths[i]
        want[i] = at
    assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(300)]


def test_leaks(spark, texts):
    rng = random.Random(7)
    items = {i: words(rng, 40, 5000) for i in range(12)}
    rows = {100: None, 101: ""}
    for i, item in items.items():
        rows[i] = " ".join([*words(rng, 60, 5000), *item, *words(rng, 60, 5000)])
        edited = [w for n, w in enumerate(item) if n % 9 != 4]
        edited[10] = "changed"
        rows[20 + i] = " ".join([*words(rng, 30, 5000), *edited, *words(rng, 30, 5000)])
        rows[40 + i] = " ".join(words(rng, 150, 5000))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    tests = spark.createDataFrame([*((i, " ".join(x).upper()) for i, x in items.items()), (50, None), (51, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, tests).collect()}
    assert set(got) == {(d + i, i) for i in items for d in (0, 20)}
    assert all(got[i, i].score == 1.0 and (got[i, i].first_word, got[i, i].last_word) == (60, 99) for i in items)
    assert decontamination.leaks(docs.limit(0), tests).count() == 0 and decontamination.leaks(docs, tests.limit(0)).count() == 0


def test_leaks_by_brute_force(spark):
    """Copies of which few seeds are left, several times and beside exact ones, against an alignment of every document with every item."""
    rng = random.Random(8)
    names = ("edited twice", "edited and exact", "25 words", "stretched", "common", "free")
    items = {i: words(rng, 60 if i == 2 else 40, 5000) for i in range(len(names))}
    items[4][:3] = ["as", "it", "were"]
    edited = lambda w, step: [f"x{rng.randrange(5000)}" if n % step == step - 1 else x for n, x in enumerate(w)]
    wide = items[3][:6] + [x for n in range(6, 40, 2) for x in (*items[3][n : n + 2], "in", "put")]
    # Copies of item 5 stay below the limits.
    copies = [edited(items[0], 4), edited(items[0], 4), edited(items[0], 4), items[1], edited(items[1], 4), items[2], items[2], items[2][:25], items[2][20:45], items[2][30:55], wide, wide, items[3]]
    copies += [edited(items[4], 4)] * 2 + [items[5][:10] + edited(items[5][10:], 2), items[5][:15], items[5][:3]]
    copies += [["as", "it", "were", *words(rng, 20, 5000), "as", "it", "were"] for _ in range(8)]
    rows = {i: [*words(rng, 50, 5000), *w, *words(rng, 90, 5000)] for i, w in enumerate(copies)}

    def best(x, y):
        top, above = 0, [0] * (len(y) + 1)
        for a in x:
            row = [0]
            for j, b in enumerate(y):
                row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
            top, above = max(top, *row), row
        return top

    points = {(d, i): best(x, y) for d, x in rows.items() for i, y in items.items()}
    want = {(d, i): p / (2 * len(items[i])) for (d, i), p in points.items() if p >= min(len(items[i]), 50)}
    assert len(want) == 15
    tables = [spark.createDataFrame([(i, " ".join(x)) for i, x in t.items()], f"{c} long, text string") for t, c in ((rows, "doc_id"), (items, "item_id"))]
    assert {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(*tables).collect()} == want


def test_alignment():
    rng = np.random.default_rng(0)
    a, b = ([rng.integers(1, 6, rng.integers(1, n)) for _ in range(40)] for n in (30, 20))

    def best(x, y):
        h = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x[i] == y[j] else -1), h[i + 1, j] - 1, h[i, j + 1] - 1)
        return h.max()

    assert decontamination.align(a, b)[0].tolist() == [best(x, y) for x, y in zip(a, b, strict=True)]


def test_quality(spark, docs):
    rng = random.Random(3)
    good = {i: " ".join(words(rng, 60, 300)) for i in range(60)}
    bad = {i: " ".join(f"{w}%%%" for w in words(rng, 60, 300)) for i in range(60, 90)}
    rows = spark.createDataFrame([*(good | bad).items(), (95, None), (96, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 90, 2)], "doc_id long, quality int")
    ratio, share = quality.models(rows, labels)
    got = quality.resample(rows, ratio, 0.6)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert abs(share - 30 / 45) < 1e-9 and len(kept) == round(0.6 * 92) and len(kept & set(bad)) <= 1
    keys = sorted(((r.sample_key, r.doc_id) for r in got.collect()), reverse=True)
    assert kept == {i for _, i in keys[: len(kept)]}
    same = spark.createDataFrame([(1, "x")] * 5, "doc_id long, text string")
    assert quality.resample(same, ratio, 0.4).where("kept").count() == 2
    assert quality.resample(rows.limit(0), ratio, 0.5).count() == 0 and quality.resample(docs, ratio, 0.5).count() == docs.count()


def test_toxicity(spark, docs):
    rng = random.Random(6)
    bad = ["vilstem", "gromstem"]
    rows, marks = [], []
    for i in range(700):
        w = words(rng, rng.randint(20, 150), 800)
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["a", "en", "isch", "ung", "os"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 4 == 0)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    net = toxicity.fit(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, net).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)
    odd = toxicity.score_toxicity(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(docs.limit(0), net).count() == 0
    assert toxicity.fit(table.limit(0), labels).p["bias"][0] == -3


def test_gradients():
    """The backward pass against differences."""
    rng = np.random.default_rng(1)
    net = toxicity.Network()
    vectors = rng.standard_normal((6, toxicity.WIDTH)).astype(np.float32)
    vectors[0] = 0
    windows = rng.integers(1, 6, (3, toxicity.WINDOW))
    windows[0, 20:] = 0
    logit, kept = net.forward(vectors, windows, keep=True)
    found, by_vector = net.gradients(vectors, kept, np.ones(3, dtype=np.float32))

    def slope(array, at):
        old, e = array[at], np.float32(1e-2)
        array[at] = old + e
        up = net.forward(vectors, windows).sum()
        array[at] = old - e
        down = net.forward(vectors, windows).sum()
        array[at] = old
        return (up - down) / (2 * e)

    for name, at in (("hf", (2, 3)), ("hb", (1, 20)), ("xf", (0, 9)), ("xb", (3, 17)), ("att", (2, 2)), ("att_v", (1,)), ("out", (4,)), ("bf", (5,))):
        assert abs(slope(net.p[name], at) - found[name][at]) < 2e-2 + 0.05 * abs(found[name][at])
    assert abs(slope(vectors, (2, 1)) - by_vector[2, 1]) < 2e-2 + 0.05 * abs(by_vector[2, 1])


def test_words():
    texts = ["a b", None, "", "ab", "x\x0by z", " a  b ", "Ab"]
    found = textvec.cut(pa.array(texts), textvec.NOT_SPACE)
    assert found.counts.tolist() == [2, 0, 0, 1, 2, 2, 1]
    hashes, first = textvec.grams(found.hashes(), found.first, 2)
    assert first.tolist() == [0, 1, 1, 1, 1, 2, 3, 3] and hashes[0] == hashes[2] != hashes[1]
    assert hashlib.sha256(found.kept(5, np.array([False, True]))).hexdigest() == hashlib.sha256(b"b").hexdigest()
