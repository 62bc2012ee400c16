"""Shared pieces of the operators: reading tables, hash folds, bounded samples, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions.hashing import uniform

# Python workers see at most this much text at once, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20


# Rows of one Arrow batch where rows hold whole texts.
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside; a lower setting stays as it is.

    A batch lies whole in the JVM's Arrow buffers and in the Python worker, before any slice is cut.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % modulus


def sample_by_id(rows: DataFrame, bound: int, tag: str) -> DataFrame:
    """At most ``bound`` rows with a non-null ``doc_id``, chosen by a hash of the id.

    One count gives the rate, a filter takes the rows where they lie, and a limit holds the bound
    even where ids repeat. Nothing is sorted and no task gathers more than the bound.
    """
    rows = rows.where(F.col("doc_id").isNotNull())
    total = rows.count()
    rate = min(1.0, bound * 0.9 / max(total, 1))
    return rows.where(uniform(tag, "doc_id") < F.lit(rate)).limit(bound)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``most`` bytes of text, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])
        pa.default_memory_pool().release_unused()


# Ids up to this number go to every task (16 bytes for each number of an id); beyond it Spark shuffles both sides.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str, on: list[str]) -> DataFrame:
    """``rows`` whose key ``on`` is (``left_semi``) or is not (``left_anti``) in the stored table ``ids``.

    The ids are counted first. A bounded number of them is broadcast, so that whole texts stay where they
    lie; more are joined by a shuffle, with the same rows. A null key is in no table of ids.
    """
    ids = ids.select(*on)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
