"""Stages of the pipeline on rows whose ids are null or repeated."""

from __future__ import annotations

import collections
import random
import re

import corpus_pipeline


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int")


def _left(found):
    return collections.Counter((r.doc_id, r.text) for r in found.collect())


def test_near_dup_odd_ids(spark, sf_dir):
    rng = random.Random(4)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(6))
    rows = [(9, a), (3, a), (None, a), (None, b), (None, b), (None, c), (5, d), (5, d), (5, e), (8, f), (None, None), (None, None), (6, "")]
    got = corpus_pipeline.near_dup(spark, _rows(spark, [(i, x, 1) for i, x in rows]).repartition(3), sf_dir)
    assert got.columns == ["doc_id", "text", "n_chars"]
    assert _left(got) == collections.Counter([(3, a), (None, b), (None, c), (5, d), (5, e), (8, f), (None, None), (None, None), (6, "")])


def test_decontamination_odd_ids(spark, tmp_path):
    rng = random.Random(5)
    item, *clean = (" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(4))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, clean[0] + " " + item), (None, clean[1]), (7, item), (7, clean[2]), (None, None)]
    got = corpus_pipeline.decontamination(spark, _rows(spark, [(i, x, 1) for i, x in rows]).repartition(3), str(tmp_path))
    assert got.columns == ["doc_id", "text", "n_chars"]
    assert _left(got) == collections.Counter([(None, clean[1]), (7, clean[2]), (None, None)])


def _near(texts, k=5):
    """The smallest id of each text's group, by brute force."""
    sets = {}
    for i, text in texts.items():
        w = (text or "").lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in texts}
    for _ in range(6):
        for a in texts:
            for b in texts:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def _without_repeats(texts):
    """Texts less the words of windows that start earlier elsewhere, and the white space after them."""
    seen, out = set(), {}
    for i in sorted(texts):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i] or "")]
        words, gone = [texts[i][a:b] for a, b in spans], set()
        for at in range(len(words) - 19):
            if (window := tuple(words[at : at + 20])) in seen:
                gone.update(range(at, at + 20))
            seen.add(window)
        if gone and len(gone) == len(words):
            continue
        ends = [a for a, _ in spans[1:]] + [len(texts[i] or "")]
        out[i] = texts[i] if not gone else texts[i][: spans[0][0]] + "".join(texts[i][spans[n][0] : ends[n]] for n in range(len(words)) if n not in gone)
    return out


def _points(x, y):
    top, above = 0, [0] * (len(y) + 1)
    for a in x:
        row = [0]
        for j, b in enumerate(y):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        top, above = max(top, *row), row
    return top


def test_whole_run(spark, tmp_path):
    """run() against plain versions of all stages but the first, which has no toxic labels to learn from and keeps all."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))
    items = {1: say(40).replace(".", ""), 2: say(25).replace(".", "")}
    passage, copy = say(60), say(200)
    texts = {i: say(rng.randrange(1, 150)) for i in range(0, 60, 2)} | {1: None, 3: "", 5: copy, 7: copy, 9: copy.upper(), 11: copy + " more", 13: say(50) + "\n\n" + passage + "\n\n" + say(50), 15: say(30) + passage, 17: passage}
    texts |= {19: say(70) + " " + items[1] + " " + say(70), 21: say(20) + " " + " ".join(w for n, w in enumerate(items[2].split()) if n % 9 != 4) + " " + say(9)}
    spark.createDataFrame([(i, x, "en", len(x or "")) for i, x in texts.items()], "doc_id long, text string, lang string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    label = _near(texts)
    assert label[7] == label[9] == label[11] == 5
    kept = _without_repeats({i: x for i, x in texts.items() if label[i] == i})
    assert 17 not in kept and kept[13] == texts[13] and len(kept[15].split()) < len(texts[15].split())
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").lower())
    leaked = {i for i, x in kept.items() for q in items.values() if _points(cut(x), cut(q)) >= min(0.5 * 2 * len(cut(q)), 50)}
    assert leaked == {19, 21}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in kept.items() if i not in leaked}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = collections.Counter()
    for r in rows:
        assert r.doc_tokens == want[r.doc_id]
        lengths[r.doc_id] += r.length
    assert lengths == want


def test_toxicity_stage(spark, tmp_path):
    """The stage keeps the rows that a network of its own training scores below the limit, odd rows among them."""
    rng = random.Random(12)
    rows, marks = [(None, None, 1.5), (None, "", 1.5), (3, None, 2.5)], []
    for i in range(500):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = "grumpfel" + rng.choice(["a", "en", "os"])
        rows.append((i, " ".join(w), 0.5))
        marks.append((i, int(i % 5 == 0)))
    rows += [rows[10], rows[10]]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    found = collections.Counter((r.doc_id, r.text, r.score) for r in got.collect())
    bad = {x for _, x, _ in rows if x and "grumpfel" in x}
    assert sum(n for (_, x, _), n in found.items() if x in bad) <= 0.1 * len(bad)
    assert sum(n for (_, x, _), n in found.items() if x not in bad) >= 0.97 * sum(x not in bad for _, x, _ in rows)
    assert all(found[r] for r in rows[:3]) and corpus_pipeline.toxicity(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_stages(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars int, pipeline_extra string, component_id int, kept_text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, empty, sf_dir)
        assert got.count() == 0 and (name == "packing" or got.columns == empty.columns)


def test_tasks_give_memory_back():
    """What a task's function held and freed does not stay with the worker."""
    import re

    from bramble.llm.common import released

    own = lambda: sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
    pins = []

    def run(batches):
        held = [bytes(2000) for _ in range(100_000)]
        pins.append(held[-1])  # the heap's last piece stays in use, so its top can't shrink
        yield from batches

    before = own()
    assert list(released(run)(iter([1, 2]))) == [1, 2]
    assert own() - before < 50
    list(run(iter([1])))
    assert own() - before > 150  # without it
