"""What the operators share: reading tables, ids as keys, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bramble.operators.graph import cut_lineage, shared_folder  # noqa: F401

#: The key of rows without an id: they come after all others.
LAST = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """Marks a checkpointed table for broadcast if it has at most so many (narrow) rows; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops input columns whose names an operator's own columns take."""
    return df.drop(*[c for c in names if c in df.columns])


def with_fields(df: DataFrame, *fields: tuple[str, str], drop: Iterable[str] = ()) -> T.StructType:
    """The schema of df (less `drop`) with more fields."""
    kept = [f for f in df.schema.fields if f.name not in set(drop)]
    return T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])


def batch_with(batch: pa.RecordBatch, columns: dict[str, pa.Array], drop: Iterable[str] = ()) -> pa.RecordBatch:
    """The batch less `drop` with more columns."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in set(drop)]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), *columns.values()], names=[*(n for n, _ in kept), *columns])


def give_back() -> None:
    """Gives free memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives free memory back when it ends: workers live on, idle ones too, beside those of the next stage."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return mapped
