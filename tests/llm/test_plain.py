"""Registered queries against plain versions, or their SQL, over whole small tables; odd rows; helpers."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import sys
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bramble.llm import decontamination, fingerprint, license_scan, near_dup, quality, registry, textvec, toxicity
from bramble.operators import graph
from bramble.operators.components import connected_components

TABLES = ("documents", "conversations", "labels", "benchmark")


@pytest.fixture(scope="module")
def tables(sf_dir):
    return {t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist() for t in TABLES}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = db.sql(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(columns).collect()))) == sorted(map(repr, want))


def _fold(text):
    return " ".join(unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()).casefold().split())


def test_op3_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab \néßﬁ世\U0001d400") for _ in range(rng.randrange(40)))) for i in range(0, 120, 2)]
    rows += [(1, None), (3, ""), (5, rows[0][1]), (7, rows[4][1] + " "), (9, "aaa"), (8, "aaa"), (10, "AAA")]
    rows = sorted(dict(rows).items(), reverse=True)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op3_fingerprint"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    digests = collections.defaultdict(set)
    for n, (i, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == float(_fold(text) == _fold(edited)) and got[i].near_next == float(_fold(text) == _fold(after))
        digests[_fold(text)].add(got[i].fingerprint)
        digests[_fold(edited)].add(got[i].edited_fingerprint)
    assert all(len(x) == 1 for x in digests.values()) and len({min(x) for x in digests.values()}) == len(digests)


def test_canonical_of_all_characters(spark):
    """Each character, its four normal forms, and marks in any order have one canonical form; what normalisation tells apart stays apart."""
    texts, rng = [], random.Random(3)
    marks = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c)] + ["゙", "ְ", "᷎"]
    some = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    some = [c for c in some if unicodedata.normalize("NFKD", c) != c and ord(c) < 0x3400 or rng.random() < 0.02]
    for c in some:
        texts += [(c, unicodedata.normalize(f, c)) for f in ("NFC", "NFD", "NFKC", "NFKD")]
    for _ in range(2000):
        text = "".join(rng.choice("aEoạ가ก") + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(3))
        texts += [(text, unicodedata.normalize(f, text)) for f in ("NFC", "NFKD")]
    canon = lambda c: fingerprint.canonical(F.col(c)).alias(c)
    got = spark.createDataFrame(texts, "a string, b string").select(F.col("a").alias("t"), canon("a"), canon("b")).collect()
    assert [ascii(r.t) for r in got if r.a != r.b] == []
    forms = collections.defaultdict(set)
    for r in got:
        forms[r.a].add(_fold(r.t))
    assert [ascii(k) for k, v in forms.items() if len(v) > 1] == []


def test_op5_base_columns(spark):
    rng = random.Random(6)
    bits = ["cc", "by", "CC-BY", "general", "public", "license", "General Public", "all", "rights", "reserved", "All Rights Reserved", "x", "é", "general public license", "3"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(300)] + [(1, rng.choice(bits)), (None, "cc by"), (None, None), (500, "cc by " * 30_000)]
    got = license_scan.scan_licenses(spark.createDataFrame([(i, n, x, "k") for n, (i, x) in enumerate(rows)], "doc_id long, n int, text string, score string")).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), rows[r.n][1] or ""))
        places = sorted((p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_longest_in_order():
    rng = random.Random(1)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        places = license_scan.in_order(a, b)
        assert len(places) == longest(a, b) and all(a[i] == b[j] for i, j in places) and places == sorted(places) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:]))


def test_op6_weights(spark):
    """Log weights against n-gram models that are counted one by one."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(30)))) for i in range(80)] + [(None, "v1 v2"), (None, None), (3, "v7")]
    good = {i for i in range(0, 80, 5)}
    labels = [(i, int(i in good)) for i in range(0, 80, 2)] + [(i, 1) for i in good if i % 2] + [(None, 1), (4, None)]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ratio, _ = quality.models(table, marks)

    def buckets(text):
        ids, _ = quality._grams(pa.array([text or ""]))
        words = (text or "").split()
        assert len(ids) == len(words) + max(0, len(words) - 1)
        return ids.tolist()

    raw, target = collections.Counter(), collections.Counter()
    for i, text in rows:
        raw.update(buckets(text))
        if i in good:
            target.update(buckets(text))
    model = lambda c, b: math.log((c[b] + quality.ALPHA) / (sum(c.values()) + quality.ALPHA * quality.BUCKETS))
    for r in quality.resample(table.withColumn("t", F.col("text")), ratio, 0.5).collect():
        assert abs(r.log_weight - sum(model(target, b) - model(raw, b) for b in buckets(r.t))) < 1e-6


def test_op9_plain_forward(spark):
    """A document's score against the recurrences written out word by word, over all its windows."""
    net = toxicity.Network(seed=3)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "béta", "Gamma", "delta7"]) for _ in range(n)) for n in (1, 31, 32, 33, 70)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def gru(vectors, d):
        H, h, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), []
        for v in vectors:
            x = v @ net.p[f"x{d}"] + net.p[f"b{d}"]
            u = net.p[f"h{d}"]
            z, r = sigmoid(x[:H] + h @ u[:, :H]), sigmoid(x[H : 2 * H] + h @ u[:, H : 2 * H])
            n = np.tanh(x[2 * H :] + (r * h) @ u[:, 2 * H :])
            h = (1 - z) * n + z * h
            out.append(h)
        return np.array(out)

    def score(text):
        words, best = text.split(), -np.inf
        inputs = toxicity.Inputs(pa.array([text]))
        vectors = net.vectors(inputs)[1 + inputs.word]
        for low in range(0, max(1, math.ceil((len(words) - toxicity.WINDOW) / toxicity.STRIDE) * toxicity.STRIDE + 1), toxicity.STRIDE):
            own = vectors[low : low + toxicity.WINDOW]
            pad = np.zeros((toxicity.WINDOW - len(own), toxicity.WIDTH))
            both = np.concatenate([own, pad])
            h = np.concatenate([gru(both, "f"), gru(both[::-1], "b")[::-1]], axis=1)[: len(own)]
            e = np.tanh(h @ net.p["att"] + net.p["att_b"]) @ net.p["att_v"]
            w = np.exp(e - e.max())
            best = max(best, (w / w.sum()) @ h @ net.p["out"] + net.p["bias"][0])
        return sigmoid(best)

    rows = spark.createDataFrame([*enumerate(texts), (9, texts[4]), (9, texts[4])], "doc_id long, text string")
    for r in toxicity.score_toxicity(rows, net).collect():
        assert abs(r.score - score(texts[min(r.doc_id, 4)])) < 1e-4


def test_training_excerpts():
    text = " ".join(f"w{i}" for i in range(9000)) + " " + "x" * 500
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 1]), pa.array([text, "Short one"])], names=["__id", "y", "text"])
    got = next(toxicity._excerpts(iter([batch]))).column("text").to_pylist()
    words = got[0].split()
    assert toxicity.TRAIN_WORDS - toxicity.WINDOW <= len(words) <= toxicity.TRAIN_WORDS and words[0] == "w0" and words[-1] > "w89" and got[1] == "short one"


def test_components_with_hubs(spark):
    rng = random.Random(7)
    edges = [(i, 9999) for i in range(1000, 1900)] + [(5, i) for i in range(2000, 2600)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)] + [(i, i + 1) for i in range(4000, 4300)]
    label = {n: n for e in edges for n in e}
    while True:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    found = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4), graph.cut_lineage)
    got = {r.node: r.component for r in found.collect()}
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_rays(spark, monkeypatch):
    """Large buckets whose members are compared with one set in blocks."""
    monkeypatch.setattr(near_dup, "RAY_MEMBERS", 8)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(f"e{i}" if n == rng.randrange(120) else w for n, w in enumerate(base))) for i in range(150)]
    got = near_dup.near_duplicates(spark.createDataFrame([*rows, (None, rows[3][1]), (200, None), (7, rows[7][1])], "doc_id long, text string"), k=2).collect()
    assert {r.component_id for r in got if r.n_shingles} == {0} and [r.component_id for r in got if not r.n_shingles] == [200]
    assert sum(r.kept for r in got if r.n_shingles) == 1


@pytest.mark.parametrize("few", [near_dup.FEW, 2])
def test_near_dup_repeated_ids(spark, monkeypatch, few):
    """Rows of one id, equal or not, are one document that shares its links; two ids that are given very often don't multiply; sets with many copies or few."""
    monkeypatch.setattr(near_dup, "FEW", few)
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abc")
    rows = [(5, a + " x")] * 300 + [(4, a + " y")] * 300 + [(5, b)] * 3 + [(9, b), (10, c), (11, c + " z")]
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=2).collect())
    assert got == {(5, 4, False): 303, (4, 4, True): 300, (9, 4, False): 1, (10, 10, True): 1, (11, 10, False): 1}


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "Yes"), (2, "yes it is"), (3, "yes!"), (None, "yes"), (4, "it is"), (5, None), (1, "yes")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "It is."), (3, ""), (4, "no"), (1, "yes")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.score, r.last_word) for r in decontamination.leaks(docs, items).collect())
    assert got == [(0, 1, 1.0, 0), (1, 1, 1.0, 0), (3, 1, 1.0, 0), (4, 2, 1.0, 1)]


def test_leaks_odd_rows(spark):
    rng = random.Random(3)
    item = " ".join(f"q{rng.randrange(900)}" for _ in range(40))
    long = " ".join(f"p{rng.randrange(900)}" for _ in range(30_000))
    docs = spark.createDataFrame([(None, item, 1), (None, "nothing", 2), (6, item, 3), (6, item, 3), (7, f"{long} {item} {long}", 4), (8, None, 5)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (2, "some other words that nobody says", "z")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.score, r.first_word) for r in decontamination.leaks(docs, items).collect())
    assert got == [(0, 1, 1.0, 0), (6, 1, 1.0, 0), (7, 1, 1.0, 30_000)]


def test_word_grams():
    texts = ["a b c", "", None, "a", "b c a b"]
    words = textvec.cut(pa.array(texts), textvec.NOT_SPACE)
    runs, first = textvec.grams(words.hashes(), words.first, 2)
    assert np.diff(first).tolist() == [2, 0, 0, 0, 3] and runs[0] == runs[4] and runs[1] == runs[2]
