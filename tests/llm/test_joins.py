"""The Jaccard join, token alignment and importance resampling against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bramble.llm import importance, jaccard_join, token_align

SCHEMA = "doc_id long, text string, n_words int, score double, rank int, n_a string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('docs')}/docs"
    spark.createDataFrame([(i, x, 1, 0.5, 7, "a") for i, x in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "Beta", "gamma,", "naïve", "x1-y2", "don't", "Zürich", "thanedble", "erinerous"]) + str(rng.randrange(40))
    base, line = [word() for _ in range(90)], [word() for _ in range(14)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Two words"), (5, "two WORDS"), (6, "A b c d"), (7, "a B C d"), (8, "a b c d e")]
    for i in range(10, 60):  # near copies, each a little off
        w = list(base)
        for at in rng.sample(range(90), rng.choice((1, 2, 3))):
            w[at] = f"q{i}-{at}"
        out.append((i, " ".join(w)))
    out += [(i, " ".join(base)) for i in range(60, 66)]
    out += [(i, " ".join([*(word() for _ in range(20)), *line, *(word() for _ in range(9))])) for i in range(70, 90)]
    out += [(90, " ".join(word() for _ in range(8000))), (91, "é ｆ 你好 　 <|endoftext|>  two  spaces\nand ▁ no"), (92, "<s> </s> <unk> <0x41> <|endoftext|> a"), (93, " lead and trail "), (94, "ha " * 200)]
    return [(i * 3, x) for i, x in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    return frame(spark, rows, tmp_path_factory)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, percent=80):
    sets = [(i, shingles(x)) for i, x in rows]
    label = [math.inf if i is None else i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])]
    for _ in range(len(rows)):
        before = list(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return sorted((-1 if i is None else i, len(s), -1 if x == math.inf else x) for (i, s), x in zip(sets, label, strict=True))


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


@pytest.mark.parametrize("few", [32, 4])  # with 4, groups that hubs leave mixed are compared in blocks
def test_jaccard(docs, rows, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW_MEMBERS", few)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 8)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 3 if few == 32 else 1)
    got = jaccard_join.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and found(got) == components(rows)


def test_jaccard_chain(spark, tmp_path_factory):
    """Texts that are alike only with their neighbours, and groups that share many shingles without a link."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 80])) for i in range(40)]
    rows += [(100 + i, " ".join([*words[:60], *(f"v{i}-{j}" for j in range(30))])) for i in range(40)]
    assert found(jaccard_join.jaccard_components(frame(spark, rows, tmp_path_factory))) == components(rows)


def test_jaccard_odd_rows(spark, docs, tmp_path_factory):
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "to")
    rows = [(None, text), (7, text), (7, text), (9, text + " tail"), (None, other), (None, other), (7, other), (None, None), (8, "")]
    got = found(jaccard_join.jaccard_components(frame(spark, rows, tmp_path_factory)))
    assert got == components(rows)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_fragments(docs, rows):
    """The number of fragments changes nothing, and partial overlaps add up to the whole."""
    for fragments in (1, 40):
        assert found(jaccard_join.jaccard_components(docs, fragments=fragments)) == components(rows)
    sets = {1: np.arange(0, 100), 2: np.arange(5, 105), 3: np.arange(60, 160)}
    total = collections.Counter()
    for fragment in range(4):
        own = [(n, x[x % 4 == fragment]) for n, x in sets.items()]
        batch = pa.RecordBatch.from_arrays([pa.array([1] * 3), pa.array([0] * 3), pa.array([n for n, _ in own]), pa.array([100] * 3), pa.array([fragment] * 3), pa.array([x.tolist() for _, x in own], pa.list_(pa.int64()))], names=["u", "block", "node", "n", "fragment", "tokens"])
        for row in next(jaccard_join._partial(80)((pa.scalar(1),), iter([batch]))).to_pylist():
            total[row["v"]] += row["both"]
    assert total == {2: 95}  # 3 misses too many in each fragment


def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    of_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    done, counts = [], collections.Counter()
    for i, text in rows:
        groups = []
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [[(x, f(x)) for x in side] for side, f in zip(ids, (of_a, of_b), strict=True)]
        if text and all(b"".join(x for _, x in p) == (" " + text).encode() for p in parts):
            ends = [np.cumsum([len(x) for _, x in p]).tolist() for p in parts]
            low = [0, 0]
            for end in sorted(set(ends[0]) & set(ends[1])):
                high = [e.index(end) + 1 for e in ends]
                groups.append(tuple(ids[s][low[s] : high[s]] for s in (0, 1)))
                low = high
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        done.append((i, groups, links))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    said = lambda gs: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs).encode()).hexdigest() if gs else ""
    return {i: (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(s), sum(counts[p] == best[p[0]] for p in s), sum(counts[p] for p in s), said(g)) for i, g, s in done}


@pytest.mark.parametrize("few", [token_align.FEW_PAIRS, 50, 0])
def test_alignment(docs, rows, few):
    import public_tokenizers as P

    got = token_align.align_tokens(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), few_pairs=few)
    assert {r.doc_id: tuple(r[c] for c in token_align.NEW) for r in got.collect()} == plain_alignment(rows)
    assert {"score", "rank"} < set(got.columns) and got.schema["n_a"].dataType.typeName() == "long"
    assert token_align.align_tokens(docs.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_alignment_encodes_once(docs, rows, tmp_path):
    """Each text is read, and so encoded, in one pass alone."""
    import public_tokenizers as P

    at = str(tmp_path / "read")

    def note(batches):
        for b in batches:
            with open(at, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    some = docs.select("doc_id", "text").mapInArrow(note, "doc_id long, text string")
    token_align.align_tokens(some, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    assert len(open(at).read()) == len(rows)


def test_alignment_pieces():
    """Texts that are cut and remembered piece by piece give what whole texts do, however the pieces come."""
    import public_tokenizers as P

    rng = random.Random(8)
    parts = ["a", "Zürich", "naïve", "don't", "12,5", "...", "  ", "\n", "\t", " ", "你好", "x" * 40, "—", "▁", " ", "end."]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    know = token_align.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    want = plain_alignment(list(enumerate(texts)))
    for size in (300, 7):
        at = 0
        while at < len(texts):
            sizes, groups, _, _ = know.align(pa.array(texts[at : at + size]))
            for i, (own, said) in enumerate(zip(sizes.tolist(), groups, strict=True)):
                assert (*own, hashlib.sha256(said.encode()).hexdigest() if said else "") == (*want[at + i][:4], want[at + i][6])
            at += size


def plain_draw(rows, target, grams=(1, 1), buckets=10_000, least=20, percent=10):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))

    def features(x):
        w = words(x)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]

    have, want = (collections.Counter(f for x in texts for f in features(x)) for texts in ([x for _, x in rows], target))
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for n, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("grams", "percent"), [((1, 1), 10), ((1, 3), 55)])
def test_resample(spark, docs, rows, grams, percent):
    target = ["alpha1 alpha2 Beta3 zurich", None, "", "naïve3 naïve3"]
    table = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample_to(docs, table, grams=grams, percent=percent)
    assert sorted((tuple(r[c] for c in ("doc_id", *importance.NEW)) for r in got.collect()), key=str) == plain_draw(rows, target, grams, percent=percent)
    assert got.schema["score"].dataType.typeName() == "long" and "n_words" in got.columns
    assert importance.resample_to(docs.limit(0), table).count() == 0
    assert importance.resample_to(docs, table.limit(0)).where("rank is not null").count() == sum(1 for _, x in rows if x and len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOW))) >= 20) // 10


def test_resample_odd_rows(spark, tmp_path_factory):
    """Repeated rows take a rank each; rows without an id come after equal scores."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 6 + [(None, text)] * 3 + [(None, None), (8, text + " more")]
    got = importance.resample_to(frame(spark, rows, tmp_path_factory), spark.createDataFrame([("w1",)], "text string"), percent=60)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 7))
    want = collections.Counter((r[0], r[1], r[2], r[3]) for r in plain_draw(rows, ["w1"], percent=60))
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got.collect()) == want


def test_bit_sums():
    rng = np.random.default_rng(1)
    gain = rng.integers(-9000, 9000, 1000)
    owner, bucket = np.sort(rng.integers(0, 50, 20_000)), rng.integers(0, 1000, 20_000) ** 2 // 1000
    got = importance.bit_sums(owner, bucket, 52, importance.planes_of(np.maximum(gain, 0)), importance.planes_of(np.maximum(-gain, 0)))
    want = np.zeros(52, dtype=np.int64)
    np.add.at(want, owner, gain[bucket])
    assert (got == want).all()
