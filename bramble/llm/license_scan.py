"""License scans by diagonal voting.

Rolling k-gram hashes of a document's words are joined to the places that templates have them.
A match votes for its diagonal, the document's place less the template's. Votes are counted for
each diagonal; neighbouring diagonals, between which words were put in or left out, are merged,
and a span with enough of the template's grams is aligned with it word by word: it counts if enough of the
template's words stand there in order, its telling words (a version, a restriction) among them. Where templates of one
family claim the same stretch, the one with most words there wins. A short phrase counts where all its
grams stand on one diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bramble.llm import textvec as tv
from bramble.llm.common import batch_with, cut_lineage, with_fields, without

#: Phrases that must stand word for word, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
_CC = "this work is licensed under a creative commons attribution {}4 0 international license"
_GPL = "licensed under the {}general public license version {}"
_GNU = [(f"{name}-{v.replace(' ', '.')}" + (".0" if " " not in v else ""), kind, v) for name, kind, versions in (("gpl", "gnu ", ("2", "3")), ("lgpl", "gnu lesser ", ("2", "2 1", "3")), ("agpl", "gnu affero ", ("3",))) for v in versions]
_CC_KINDS = (("", ""), ("-sa", "sharealike "), ("-sa", "share alike "), ("-nc", "noncommercial "), ("-nc", "non commercial "), ("-nd", "noderivatives "), ("-nc-sa", "noncommercial sharealike "), ("-nc-nd", "noncommercial noderivatives "))
#: Licence notices and openings of licence texts, which may be edited: (family, label, words, telling words). The telling words hold the family's own name.
NOTICES = [
    ("apache", "apache-2.0", "licensed under the apache license version 2 0", "apache 2"),
    ("mit", "mit", "released under the mit license", "mit"),
    ("mit", "mit", "licensed under the mit license", "mit"),
    ("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    *[("gpl", label, _GPL.format(kind, v), f"{kind.removeprefix('gnu ')}general public {v}") for label, kind, v in _GNU],
    ("gpl", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public"),
    ("gpl", "lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general public"),
    *[("cc", f"cc-by{label}", _CC.format(words), f"creative commons {words.replace('non commercial', 'commercial')}") for label, words in _CC_KINDS],
    *[("cc", f"cc-by{label}", f"licensed under cc by{label.replace('-', ' ')} 4 0", f"cc by{label.replace('-', ' ')}") for label in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd")],
    ("cc", "cc0", "released into the public domain under cc0 1 0", "cc0"),
    ("mpl", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2"),
    ("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
]
#: Names of licences, which must stand word for word: (family, label, words).
NAMES = [
    ("mit", "mit", "mit license"), ("apache", "apache-2.0", "apache license 2 0"), ("apache", "apache-2.0", "apache license version 2 0"), ("isc", "isc", "isc license"),
    ("mpl", "mpl-2.0", "mozilla public license 2 0"), ("mpl", "mpl-2.0", "mozilla public license version 2 0"),
    *[("bsd", f"bsd-{n}-clause", f"bsd {n} clause license") for n in (2, 3)],
    *[("gpl", label, f"{kind}general public license version {v}") for label, kind, v in _GNU],
    *[("gpl", label, f"{kind}general public license v{v}") for label, kind, v in _GNU],
]
#: Licences' tags, which stand after "SPDX-License-Identifier:", and the families of their labels; tags and labels are the same but for cc-by-4.0 and cc0-1.0.
TAGS = {
    "apache": ["apache-2.0"], "mit": ["mit"], "bsd": ["bsd-2-clause", "bsd-3-clause"], "isc": ["isc"], "mpl": ["mpl-2.0"],
    "gpl": ["gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"], "cc": ["cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "cc0-1.0"],
}


def _named() -> list[tuple[str, str, str]]:
    tags = [(family, tag.removesuffix("-4.0").removesuffix("-1.0"), f"spdx license identifier {tag.replace('-', ' ').replace('.', ' ')}") for family, own in TAGS.items() for tag in own]
    return [*NAMES, *tags]


NAMES = _named()
#: Words of a gram; how far merged diagonals may lie apart; share of a notice's grams, then of its words, that must stand in a span.
GRAM, NEAR, VOTES, ENOUGH = 2, 3, 0.4, 0.6
#: Other words inside a span, as a share of the template's, and so many more.
OTHERS, FEW_OTHERS = 0.5, 3
#: Words between matches that still belong to one passage, and before and after it.
GAP, EDGE = 8, 6


def _gram_hashes(texts: list[str]) -> tuple[tv.Words, np.ndarray, np.ndarray]:
    words = tv.cut(pa.array(texts, pa.string()), tv.ALNUM, lower=True)
    return words, *tv.grams(words.hashes(), words.first, GRAM)


def _templates(phrases: dict[str, str], notices: list[tuple[str, str, str, str]], names: list[tuple[str, str, str]]) -> list[tuple]:
    """A row for each gram of each template, which is of a phrase, a notice or a name."""
    rows = []
    kinds = [*(("phrase", "", label, text, "") for text, label in phrases.items()), *(("notice", *n) for n in notices), *(("name", *n, "") for n in names)]
    for t, (kind, family, label, text, telling) in enumerate(kinds):
        _, hashes, _ = _gram_hashes([text])
        own = text.split()
        if len(own) < GRAM or len(hashes) != len(own) - GRAM + 1 or not set(telling.split()) <= set(own):
            raise ValueError(f"a template needs {GRAM} lower-case words at least, its telling words among them: {text!r}")
        rows += [(t, family, label, kind, len(hashes), p, int(h.view(np.int64)), " ".join(own[p : p + GRAM])) for p, h in enumerate(hashes)]
    return rows


def _hits(known: np.ndarray, text_col: str):
    """Each text's words counted, the places of known grams, and the passages round them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.slices(batches, text_col):
            words = tv.cut(batch.column(batch.schema.get_field_index(text_col)), tv.ALNUM, lower=True)
            hashes, first = tv.grams(words.hashes(), words.first, GRAM)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
            text = np.searchsorted(first, at, side="right") - 1
            place = at - first[text]
            say = lambda i: words.data[words.starts[i] : words.ends[i]].tobytes().decode(errors="replace")
            grams = [" ".join(say(i + j) for j in range(GRAM)) for i in (words.first[text] + place).tolist()]
            begins = np.r_[True, (text[1:] != text[:-1]) | (np.diff(place) > GAP)][: len(at)]
            new = np.flatnonzero(begins)
            passage = np.cumsum(begins) - 1
            passage -= np.searchsorted(text[new], text)  # counted in each text
            hits = pa.StructArray.from_arrays([pa.array(place, pa.int64()), pa.array(passage, pa.int32()), pa.array(hashes[at].view(np.int64)), pa.array(grams, pa.string())], names=["place", "passage", "hash", "gram"])
            low = np.maximum(place[new] - EDGE, 0)
            high = np.minimum(place[np.r_[new[1:], len(at)] - 1] + GRAM + EDGE, words.counts[text[new]]) if len(at) else low
            said = [[say(i) for i in range(a, b)] for a, b in zip((words.first[text[new]] + low).tolist(), (words.first[text[new]] + high).tolist(), strict=True)]
            passages = pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(said, pa.list_(pa.string()))], names=["low", "words"])
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)), x) for of, x in ((text, hits), (text[new], passages))]
            yield batch_with(batch, {"n_words": pa.array(words.counts, pa.int64()), "__hits": lists[0], "__passages": lists[1]}, drop=(text_col,))

    return run


def in_order(template: list[str], words: list[str]) -> list[tuple[int, int]]:
    """The places (in the template, in the words) of a longest common subsequence."""
    best = np.zeros((len(template) + 1, len(words) + 1), dtype=np.int32)
    same = np.array(template, dtype=object)[:, None] == np.array(words, dtype=object)[None, :]
    for i in range(len(template) - 1, -1, -1):
        take = np.where(same[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    i = j = 0
    out = []
    while i < len(template) and j < len(words):
        if same[i, j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i, j + 1]:
            j += 1
        else:
            i += 1
    return out


def _verified(notices: list[tuple[str, str, str, str]], phrases: int):
    """Of each span, how many of its template's words stand there in order, and where, and where its telling words are; none if one of these isn't among them, or too many other words are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, template, begin, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                family, label, text, telling = notices[template - phrases]
                own, needed = text.split(), set(telling.split())
                places = in_order(own, words)
                told = [j for i, j in places if own[i] in needed]
                if len(places) < ENOUGH * len(own) or not needed <= {own[i] for i, _ in places}:
                    continue
                start, stop = places[0][1], places[-1][1]
                if stop - start + 1 - len(places) > OTHERS * len(own) + FEW_OTHERS:
                    continue
                told = told or [start, stop]
                rows.append((row, family, label, begin + start, begin + stop, begin + min(told), begin + max(told), len(places), len(places) / len(own)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["row", "family", "label", "start", "stop", "from", "to", "n", "share"])

    return run


def _settled(spans: DataFrame, group: list[str]) -> DataFrame:
    """Spans less those that give way on their stretch, a chain of spans that overlap: to the one with most words there, all whose telling words lie inside that one.

    So of rivals in one family the fuller stays, and a name that belongs to another family's notice goes, but two licences that are named side by side both stay.
    """
    line = Window.partitionBy("row", *group).orderBy("start", "stop", "label")
    apart = F.coalesce((F.col("start") > F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    spans = spans.withColumn("__apart", apart).withColumn("__stretch", F.sum("__apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("__best", F.max(F.struct("n", "share", "label", "start", "stop")).over(Window.partitionBy("row", *group, "__stretch")))
    inside = (F.col("from") >= F.col("__best.start")) & (F.col("to") <= F.col("__best.stop")) & (F.col("label") != F.col("__best.label"))
    return spans.where(~inside).drop("__apart", "__stretch", "__best")


NEW = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, str, str]] = NOTICES, names: list[tuple[str, str, str]] = NAMES, text_col: str = "text") -> DataFrame:
    """docs, without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. n_base counts the places where a phrase's words
    stand one after another; first_word and last_word are the smallest and largest start (null if there are none). labels has the
    phrases' labels and those of notices of which a span holds ENOUGH words; both lists are distinct, sorted and joined by commas.
    score is the largest share of a template found, 1 for a phrase, 0 if no label.

    Null and empty texts have no words and no labels. Repeated rows are judged each by itself; ids are not looked at. An
    empty table gives an empty table. Input columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, NEW)
    rows = _templates(phrases, notices, names)
    templates = F.broadcast(spark.createDataFrame(rows, "template int, family string, label string, kind string, need int, at int, hash long, gram string"))  # the fixed values above
    known = np.unique(np.array([r[6] for r in rows], dtype=np.int64).view(tv.U))
    schema = with_fields(docs, ("n_words", "long"), ("__hits", "array<struct<place: long, passage: int, hash: long, gram: string>>"), ("__passages", "array<struct<low: long, words: array<string>>>"), drop=(text_col,))
    found = cut_lineage(docs.mapInArrow(_hits(known, text_col), schema)).withColumn("__row", F.monotonically_increasing_id())

    votes = found.select(F.col("__row").alias("row"), F.explode("__hits").alias("h")).select("row", "h.*").join(templates, ["hash", "gram"])
    diagonals = votes.groupBy("row", "passage", "template", "family", "label", "kind", "need", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"))
    whole = diagonals.where("kind != 'notice' and size(places) = need").withColumn("start", F.col("diagonal"))
    exact = whole.where("kind = 'phrase'").select("row", "label", F.lit(True).alias("base"), "start", F.lit(1.0).alias("share"))
    stop, n = (F.col("start") + F.col("need")).alias("stop"), (F.col("need") + GRAM - 1).cast("long").alias("n")
    named = whole.where("kind = 'name'").select("row", "family", "label", "start", stop, F.col("start").alias("from"), (F.col("start") + F.col("need")).alias("to"), n, F.lit(1.0).alias("share"))
    line = Window.partitionBy("row", "passage", "template").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= NEAR, 0).otherwise(1)
    runs = diagonals.where("kind = 'notice'").withColumn("step", step).withColumn("run", F.sum("step").over(line))
    spans = runs.groupBy("row", "passage", "template", "need", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"))
    spans = spans.where(F.col("n") >= VOTES * F.col("need")).select("row", "passage", "template", (F.col("low") - 1).alias("low"), (F.col("high") + F.col("need") + GRAM).alias("high"))
    passages = found.select(F.col("__row").alias("row"), F.posexplode("__passages").alias("passage", "p")).select("row", "passage", F.col("p.low").alias("begin"), "p.words")
    first = F.greatest(F.col("low"), F.col("begin"))
    words = F.slice("words", (first - F.col("begin") + 1).cast("int"), F.greatest(F.col("high") - first, F.lit(0)).cast("int"))
    pairs = spans.join(passages, ["row", "passage"]).select("row", "template", first.alias("begin"), words.alias("words"))
    spans = pairs.mapInArrow(_verified(notices, len(phrases)), "row long, family string, label string, start long, stop long, from long, to long, n long, share double")
    best = _settled(_settled(spans.unionByName(named), ["family"]), [])
    best = best.select("row", "label", F.lit(False).alias("base"), "start", "share")
    text_of = lambda labels: F.array_join(F.sort_array(labels), ",")
    marks = exact.unionByName(best).groupBy("row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        text_of(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"), text_of(F.collect_set("label")).alias("labels"), F.max("share").alias("score"))
    out = found.drop("__hits", "__passages").join(marks.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")
    empty = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", *NEW)
