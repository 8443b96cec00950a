"""Licence labels: notices as they are written, and a plain alignment of planted, edited and rival notices."""

from __future__ import annotations

import random

from bramble.llm import license_scan as ls

CASES = [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("All rights reserved.", "reserved"), ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"), ("licensed under the lesser general public license version 2.1", "gpl,lgpl-2.1"), ("Licensed under the GNU Lesser General Public License version 2", "gpl,lgpl-2.0"),
    ("MIT License", "mit"), ("BSD 3-Clause License", "bsd-3-clause"), ("Mozilla Public License Version 2.0", "mpl-2.0"), ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"), ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"), ("Licensed under the Apache License, Version 2.0 or the MIT license", "apache-2.0,mit"), ("GNU Affero General Public License v3", "agpl-3.0,gpl"),
    ("GNU General Public License version 2.0", "gpl,gpl-2.0"), ("licensed under the license version 2", ""), ("the general public license of version 9", "gpl"), ("mit was a license", ""), ("Licensed under the Apache License Version 2.0. " * 3 + "Released under the MIT License.", "apache-2.0,mit"),
]


def test_written_notices(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)] + [(90, None), (91, "")]
    got = {r.doc_id: r for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].labels for i in range(len(CASES))} == {i: want for i, (_, want) in enumerate(CASES)}
    assert all(got[i].score == (1.0 if want else 0.0) for i, (_, want) in enumerate(CASES)) and got[90].labels == got[91].labels == ""


def plain(words: list[str]) -> tuple[set[str], float]:
    """The labels of one passage and the largest share: every template aligned with all of it."""
    labels, score, spans = set(), 0.0, []
    for phrase, label in ls.PHRASES.items():
        own = phrase.split()
        if any(words[i : i + len(own)] == own for i in range(len(words))):
            labels.add(label)
            score = 1.0
    for family, label, text in ls.NAMES:
        own = text.split()
        spans += [(len(own), 1.0, label, family, i, i + len(own) - 1, i, i + len(own) - 1) for i in range(len(words)) if words[i : i + len(own)] == own]
    for family, label, text, telling in ls.NOTICES:
        own, needed = text.split(), set(telling.split())
        places = ls.in_order(own, words)
        told = [j for i, j in places if own[i] in needed] or [j for _, j in places]
        if len(places) < ls.ENOUGH * len(own) or not needed <= {own[i] for i, _ in places}:
            continue
        if places[-1][1] - places[0][1] + 1 - len(places) > ls.OTHERS * len(own) + ls.FEW_OTHERS:
            continue
        spans.append((len(places), len(places) / len(own), label, family, places[0][1], places[-1][1], min(told), max(told)))
    for group in (3, None):  # rivals of a family, then of all
        kept = []
        for x in spans:
            top = max(y for y in spans if group is None or y[3] == x[3])
            if x[2] == top[2] or x[6] < top[4] or x[7] > top[5]:
                kept.append(x)
        spans = kept
    return labels | {x[2] for x in spans}, max([score, *(x[1] for x in spans)])


def test_planted_notices(spark):
    """Notices with some words replaced, far apart in other words: labels and scores are those of the plain alignment, and an untouched telling word always tells."""
    rng, rows, want = random.Random(6), [], {}
    long = [n for n in ls.NOTICES if len(n[2].split()) >= 8]
    other = lambda n: [f"zz{rng.randrange(10**6)}" for _ in range(n)]
    for i in range(150):
        words, labels, score = other(rng.randint(0, 30)), set(), 0.0
        for family, label, text, telling in rng.sample(long, rng.choice((1, 1, 2))):
            own = text.split()
            free = [p for p, w in enumerate(own) if w not in telling.split()]
            for p in rng.sample(free, rng.randint(0, len(own) // 8)):
                own[p] = other(1)[0]
            found, best = plain(own)
            assert label in found, (label, own)
            labels, score = labels | found, max(score, best)
            words += own + other(40)
        rows.append((i, " ".join(words)))
        want[i] = (",".join(sorted(labels)), round(score, 9))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_equal_rivals(spark):
    """Of two families' notices on one stretch, with as many words each, one stays if its rival's telling words lie inside it; neither is lost for good."""
    notices = [("a", "one", "red green blue license", "red"), ("b", "two", "red green grey license", "red")]
    got = {r.doc_id: r.labels for r in ls.scan_licenses(spark.createDataFrame([(1, "red green blue grey license"), (2, "red green blue license"), (3, "red green grey license")], "doc_id long, text string"), notices=notices).collect()}
    assert got == {1: "two", 2: "one", 3: "two"}
