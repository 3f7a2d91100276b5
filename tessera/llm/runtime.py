"""Helpers shared by the text operators: cutting lineage, bounded broadcasts, joins with hot keys, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tessera.sources.storage import new_folder, written

__all__ = ["BROADCAST_ROWS", "bounded_broadcast", "cut", "cut_narrow", "id_remainder", "join_sized", "new_folder", "plus", "release", "rows_per_task", "ship"]

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
#: Largest number of narrow rows (an id and a number) that is broadcast; 16 MB at most.
BROADCAST_ROWS = 1_000_000
#: A key with more rows than this is hot: its rows are joined where they lie, and not sent to one task.
HOT_ROWS = 512
#: Files of a narrow table for each core, and the fewest at which they are bounded.
NARROW_FILES, NARROW_LEAST = 2, 16
ARROW_DEFAULT = "67108864b"


def ship(spark: SparkSession) -> None:
    """Let Python workers started from this driver import the package (clusters install it instead).

    Also lowers the session's Arrow batches from Spark's default of 64 MB to 8 MB: a batch of long texts is held by the
    executor and its Python worker at once. A value that the session has set stays.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == ARROW_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends here, and a lost executor costs no recompute."""
    return written(df, name)


def cut_narrow(df: DataFrame, name: str) -> DataFrame:
    """cut, for tables of narrow rows from a shuffle: its last stage has a few tasks for each core, and so few files.

    Each task goes through its shuffle partitions one after another, so none holds more than before. Where Spark hasn't joined
    small partitions itself, a file for each one costs far more than its rows.
    """
    return cut(df.coalesce(max(NARROW_LEAST, NARROW_FILES * df.sparkSession.sparkContext.defaultParallelism)), name)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when the counted rows are within BROADCAST_ROWS; otherwise leave a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_sized(rows: DataFrame, sized: DataFrame, key: str, n: str, how: str = "inner", most: int = HOT_ROWS) -> DataFrame:
    """rows joined with sized (written; one row for each key, n: how many of rows have it), inner or left, without a hot task.

    Keys of more than `most` rows, of which there are at most a `most`-th of the rows, are broadcast within the bound of
    BROADCAST_ROWS; the rest is shuffled by the key. rows is evaluated twice where there are hot keys. Null keys are for
    the caller to set apart.
    """
    hot = sized.filter(F.col(n) > most)
    count = hot.count()
    if not count:
        return rows.join(sized, key, how)
    where_they_lie = rows.join(bounded_broadcast(hot, count), key)
    rest = rows.join(bounded_broadcast(hot.select(key), count), key, "left_anti")
    return where_they_lie.unionByName(rest.join(sized.filter(F.col(n) <= most), key, how))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def rows_per_task(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of the column (always one row at least), to bound memory."""
    values = batch.column(batch.schema.get_field_index(column))
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(values).fill_null(0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def plus(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with more columns, given as name=type."""
    return StructType([*df.schema.fields, *(StructField(k, _parse_datatype_string(v)) for k, v in columns.items())])


def release() -> None:
    """Give memory that a finished Python task has freed back to the system, as workers are reused for later stages.

    What outlives a task (modules) is set apart, so the next tasks' collections don't go through it.
    """
    gc.collect()
    gc.freeze()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
