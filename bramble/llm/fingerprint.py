"""Document fingerprints: canonical exact digests, built of DataFrame operations only.

The canonical form of a text is Unicode-normalised (compatibility decomposition, marks in canonical order),
case-folded, and has its white space folded to single spaces. Its fingerprint is a 128-bit xxhash in
hexadecimal. Where a bucket of equal fingerprints holds texts whose canonical bytes differ, the fingerprint is
lengthened by a SHA-256 of them, so that equal fingerprints mean equal bytes.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from bramble.llm import splitters
from bramble.llm.common import cut_lineage, key, small_or_not

#: Fingerprints of more than one document that may be broadcast (some 30 MB).
FEW_BUCKETS = 200_000
#: Ranges of ids at least, and bytes of text in a range.
LEAST, BYTES = 1024, 1 << 26

_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_HANGUL = range(0xAC00, 0xD7A4)
_IOTA = chr(0x345)  # a mark that folds to a letter; it stays a mark, so that marks in another order are the same
_BETWEEN = chr(0x1F)


def _characters() -> list[str]:
    return [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c not in _HANGUL]


def _form(c: str) -> str:
    """A character decomposed (compatibility forms too) with its case folded, or a space for white space."""
    if ord(c) in _SPACES:
        return " "
    apart = unicodedata.normalize("NFKD", c)
    return "".join(x if x == _IOTA else unicodedata.normalize("NFKD", x.casefold()) for x in apart)


@lru_cache
def _forms() -> tuple[str, str, str]:
    """The characters that have another form, but for Hangul syllables, in order; those forms, set apart; and characters that may bring marks out of order."""
    pairs = [(c, _form(c)) for c in _characters()]
    other = [(c, f) for c, f in pairs if f != c]
    marked = "".join(c for c, f in pairs if unicodedata.combining(c) or sum(unicodedata.combining(x) > 0 for x in f) > 1)
    return "".join(c for c, _ in other), _BETWEEN.join(f for _, f in other), marked


@lru_cache
def _mark_classes() -> tuple[str, str, str]:
    """All combining marks (those of class 0 are letters in this respect), for each a character that ascends with its class, and a pattern's class of them."""
    marks = [c for c in _characters() if unicodedata.combining(c)]
    starts = [c for c in marks if chr(ord(c) - 1) not in marks]
    ends = [c for c in marks if chr(ord(c) + 1) not in marks]
    ranges = "".join(f"\\x{{{ord(a):X}}}-\\x{{{ord(z):X}}}" for a, z in zip(starts, ends, strict=True))
    return "".join(marks), "".join(chr(0x100 + unicodedata.combining(c)) for c in marks), ranges


@lru_cache
def _syllables() -> tuple[str, list[str]]:
    """All Hangul syllables, those without a third letter last (translate deletes what it has no letter for), and their first, second and third letters."""
    apart = {c: unicodedata.normalize("NFD", c) for c in map(chr, _HANGUL)}
    order = sorted(apart, key=lambda c: -len(apart[c]))
    return "".join(order), ["".join(apart[c][i] for c in order if len(apart[c]) > i) for i in range(3)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _replaced(text: Column, distinct: Column) -> Column:
    """Each of the text's distinct characters that has another form is replaced by it, all over the text."""
    known, forms, _ = _forms()
    forms = F.split(F.lit(forms), _BETWEEN)
    order, letters = _syllables()
    is_syllable = lambda c: c.between(chr(_HANGUL[0]), chr(_HANGUL[-1]))
    hangul = lambda c: F.concat(*[F.translate(c, order, x) for x in letters])
    special = F.filter(distinct, lambda c: (F.translate(c, known, "") == "") | is_syllable(c))
    return F.aggregate(special, text, lambda t, c: F.replace(t, c, F.when(is_syllable(c), hangul(c)).otherwise(F.get(forms, F.instr(F.lit(known), c) - 1))))


def _in_order(text: Column) -> Column:
    """Runs of marks sorted by class, in their own order within one."""
    marks, classes, ranges = _mark_classes()
    runs = F.regexp_extract_all(text, F.lit(f"([{ranges}]+|[^{ranges}]+)"), F.lit(1))

    def sorted_run(run: Column) -> Column:
        each = F.transform(F.split(run, ""), lambda c, i: F.struct(F.translate(c, marks, classes).alias("class"), i.alias("at"), c.alias("mark")))
        return F.array_join(F.transform(F.array_sort(each), lambda x: x["mark"]), "")

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{ranges}]{{2}}"), sorted_run(r)).otherwise(r)), "")


def _plain(text: Column) -> Column:
    """A text that isn't ASCII alone with all its other characters decomposed, folded and, if there may be two marks in a row, in order."""
    marked = _forms()[2]
    distinct = F.filter(F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), "")), lambda c: c != "")

    def formed(chars: Column) -> Column:
        odd = F.exists(chars, lambda c: F.translate(c, marked, "") == "")
        return _let(_replaced(text, chars), lambda t: F.when(odd, _in_order(t)).otherwise(t))

    return _let(distinct, formed)


def canonical(text: Column) -> Column:
    """Decomposed, case-folded, white space as single spaces; null is empty. ASCII texts, most by far, only change case and white space."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), _plain(text)).otherwise(text))
    for space in "\t\n\x0b\x0c\r":
        low = F.replace(low, F.lit(space), F.lit(" "))
    return _let(low, lambda t: F.trim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)))


def digest(canon: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))])


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text; texts have equal ones if and only if their canonical bytes are equal.

    Null texts count as empty, and all empty or blank texts share one fingerprint. Repeated rows and
    other columns stay; a column of the new one's name is replaced. An empty table gives an empty table.
    """
    return fingerprinting(docs, text_col, out_col)(docs)


def fingerprinting(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> Callable[[DataFrame], DataFrame]:
    """What adds fingerprints to docs, or to rows of it: they are lengthened where two of all texts of docs clash."""
    clashing = clashes(docs.select(digest(canonical(F.col(text_col))).alias("fp"), F.col(text_col).alias("text")))
    return lambda rows: _lengthened(rows.withColumn(out_col, digest(canonical(F.col(text_col)))), clashing, text_col, out_col)


def _lengthened(found: DataFrame, clashing: DataFrame | None, text_col: str, out_col: str) -> DataFrame:
    if clashing is None:
        return found
    longer = F.concat(F.col(out_col), F.lit("-"), F.sha2(canonical(F.col(text_col)), 256))
    return found.join(clashing.withColumnRenamed("fp", "__fp"), F.col(out_col) == F.col("__fp"), "left").withColumn(out_col, F.when(F.col("__fp").isNotNull(), longer).otherwise(F.col(out_col))).drop("__fp")


def clashes(texts: DataFrame) -> DataFrame | None:
    """Fingerprints (of columns fp, text) whose texts differ in their canonical bytes; None if there are none, as nearly always.

    Each task keeps a bucket's least and greatest bytes, so a bucket of very many copies is a row a task. Where all texts of a bucket
    have one hash as they are, they are compared as they are; the canonical form is made again only in other buckets.
    """
    raw = F.xxhash64("text")
    crowded = texts.groupBy("fp").agg(F.count("*").alias("n"), F.min(raw).alias("a"), F.max(raw).alias("z")).where("n > 1")
    crowded = small_or_not(cut_lineage(crowded.select("fp", (F.col("a") != F.col("z")).alias("differ"))), FEW_BUCKETS)
    form = F.when(F.col("differ"), canonical(F.col("text"))).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    ends = texts.join(crowded, "fp").select("fp", form.alias("c")).groupBy("fp").agg(F.min("c").alias("a"), F.max("c").alias("z"))
    found = cut_lineage(ends.where("a != z").select("fp"))
    return None if found.isEmpty() else found


def with_next(docs: DataFrame, also: tuple[str, ...] = (), derived: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with next_text, the text of the document with the next smaller id (after the last: the first), and next_c of each column c in `also`.

    derived adds columns to docs that `also` may name; they are made for each row once, after the few rows that two ranges need are picked.

    Ids are cut into ranges of about BYTES at sampled splitters; each range gets a copy of the row that follows
    its last one, so that the order is never sorted in one task. Rows of an equal id follow by a hash of their texts, equal rows
    by their place, so that one id or one row that is repeated very often still makes several ranges. Rows without an id
    have the largest key. The table is read several times: it must be a stored one or a checkpoint.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__doc": key(id_col), "__h": F.xxhash64(text), "__s": F.monotonically_increasing_id()})
    bytes_ = F.octet_length(text) + 1
    total = docs.agg(F.coalesce(F.sum(bytes_), F.lit(0))).first()[0]
    order_key = F.struct("__doc", F.bitwise_not("__h").alias("h"), F.bitwise_not("__s").alias("s"))
    found = splitters.ranges(rows.withColumn("__w", bytes_).select("__doc", "__h", "__s", "__w"), "__doc", order_key, "__w", total, max(LEAST, -(-total // BYTES)))
    rows = found.with_range(rows, F.col("__doc"), order_key)
    block = F.shiftright("__r", 32).alias("__b")
    heads = cut_lineage(rows.select("__r", "__doc", "__h", "__s").groupBy("__r").agg(F.max(order_key).alias("top")))  # a row a range
    up = F.lead("__r").over(Window.partitionBy("__b").orderBy("__r"))
    blocks = heads.groupBy(block).agg(F.min("__r").alias("__low"))  # splitters.BLOCKS rows at most
    over = Window.orderBy("__b")
    blocks = blocks.select("__b", F.coalesce(F.lead("__low").over(over), F.min("__low").over(over)).alias("__next"))
    heads = heads.select("*", block).withColumn("__up", up).join(F.broadcast(blocks), "__b")
    heads = heads.select(F.col("top.__doc").alias("__doc"), F.bitwise_not("top.h").alias("__h"), F.bitwise_not("top.s").alias("__s"), F.coalesce("__up", "__next").alias("__to"))
    copies = rows.drop("__r").join(found.small(cut_lineage(heads)), ["__doc", "__h", "__s"]).withColumnRenamed("__to", "__r").withColumn("__copy", F.lit(1))
    derived = derived or (lambda df: df)
    both = derived(rows.withColumn("__copy", F.lit(0))).unionByName(derived(copies))
    order = Window.partitionBy("__r").orderBy("__copy", F.desc("__doc"), "__h", "__s")
    named = {"next_text": F.lead(F.coalesce(text_col, F.lit(""))).over(order)} | {f"next_{c}": F.lead(c).over(order) for c in also}
    return both.withColumns(named).where("__copy = 0").drop("__doc", "__h", "__s", "__r", "__copy")


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = with_next(docs, also=("fingerprint",), derived=fingerprinting(docs)).withColumn("text", F.coalesce("text", F.lit("")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    docs = docs.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.left("text", n - cut), F.left("next_text", cut))})
    docs = docs.withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))
    # Documents' fingerprints are equal only if their bytes are; an edited text's bytes are compared where its fingerprint is equal.
    near_edited = F.when(F.col("fingerprint") == F.col("edited_fingerprint"), (canonical(F.col("text")) == canonical(F.col("edited"))).cast("double")).otherwise(0.0)
    near_next = (F.col("fingerprint") == F.col("next_fingerprint")).cast("double")
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), near_next.alias("near_next"))
