"""A corpus pipeline: each stage applies one operator to all that the stage before it kept.

Toxic documents go, then all but one of each group of near-duplicates, then passages that stand
elsewhere already (and documents of which nothing is left), then documents with leaked test items;
what remains is packed into training sequences.

All stages take documents (doc_id, text, n_chars and any other columns, which stay but for the last stage). Ids may be null or repeated: toxicity
and packing judge each row by itself; near_dup and decontamination number the rows of their input, so of rows that are equal, with or without an id, one
stays, and each leaking row goes; for substring_dedup rows of one id are one document given several times, and rows without an id come after all others.
Documents without words, null texts among them, are never toxic, never copies and never leaks, and stay. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bramble.llm.common import cut_lineage, shared_folder, small_or_not, table
from bramble.llm.decontamination import leaks
from bramble.llm.near_dup import near_duplicates
from bramble.llm.packing import pack_documents
from bramble.llm.substring_dedup import dedup_substrings
from bramble.llm.toxicity import fit, score_toxicity

#: Score from which a document is toxic; ids that may be broadcast to drop documents (some 30 MB).
TOXIC, FEW_IDS = 0.7, 1_000_000
#: A stage's own key of each row of its input: ids may be null or repeated.
ROW = "pipeline_row"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _with_row(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with ROW, written out so that each use reads the same keys."""
    path = f"{_folder(spark)}/rows"
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _drop(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(small_or_not(cut_lineage(gone.select(ROW).distinct()), FEW_IDS), ROW, "left_anti").drop(ROW)


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names renamed, and what brings all its columns back under their own names."""
    other = {n: f"__aside_{n}" for n in names if n in docs.columns}
    return docs.withColumnsRenamed(other), [F.col(other.get(c, c)).alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _aside(docs, "score")
    return score_toxicity(rows, fit(docs, table(spark, sf_dir, "labels"))).where(F.col("score") < TOXIC).select(back)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays (one without an id only if none has any)."""
    rows = _with_row(spark, docs)
    found = near_duplicates(rows, k=5, percent=80, id_col=ROW).select(ROW, "component_id")
    found = cut_lineage(found.join(rows.select(ROW, "doc_id"), ROW))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", ROW)).alias("first")).select(f"first.{ROW}")
    return _drop(rows, found.join(first, ROW, "left_anti"))  # no join by component: one may hold a third of all rows


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that loses passages keeps its line breaks elsewhere."""
    rows, back = _aside(docs, "n_words", "n_removed", "kept_text")
    out = dedup_substrings(rows, layout=True).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _with_row(spark, docs)
    return _drop(rows, leaks(rows, table(spark, sf_dir, "benchmark"), id_col=ROW))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_dup", near_dup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express a recurrent network or a tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and go when the next one's are written."""
    folder, docs = _folder(spark), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
