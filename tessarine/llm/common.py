"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.session import materialize

#: Fixed value: a word is a maximal run of characters other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"

PIECE_BYTES = 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, lineage cut, survives lost executors."""
    return materialize(df, name)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of 8 MB for jobs run inside: a batch is held several times over, in the JVM and in Python."""
    held = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, "8m")
    try:
        yield
    finally:
        if held:
            spark.conf.set(BATCH_BYTES, held)
        else:
            spark.conf.unset(BATCH_BYTES)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: a generator keeps the optimiser from copying it into lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """128-bit identity of a row: rows equal in id and text share it."""
    absent = F.lit("\u0000")
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), absent), F.coalesce(text, absent)))


def in_training(doc_id: Column, folds: int) -> Column:
    """Whether a row may be learned from: crc32(doc_id as text) mod `folds` is not 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 2, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased; bytes.split cuts at the same six spaces as WORD."""
    return (text or "").encode().lower().split()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds a few MB of text, or a single row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for at, size in enumerate(sizes):
            if at > start and held + size > PIECE_BYTES:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def per_process(key: tuple, make):
    """What `make` returns, kept while the Python worker lives: Spark reuses workers between tasks.

    Task functions travel by value and so have no globals of their own that outlive a task.
    """
    kept = sys.modules.setdefault("_tessarine_kept", types.ModuleType("_tessarine_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
