"""Helpers that the operators of this subpackage share: checkpoints, Arrow text chunks, bounded id filters."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the bitmap in might_hold(): 2**16 words of 64 bits, 1 MB at most whatever the input.
BITMAP_WORDS = 1 << 16


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="harrow-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: later reads survive lost executors and don't compute df again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n, at = len(col), col.offset
    offsets = np.frombuffer(col.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(col: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows with about `most` bytes; a longer text is a run of its own."""
    buf, offs = text_buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(fn, schema), after which the worker gives its memory back: it outlives the task, beside the JVM of the next stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def _marked(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, Column]:
    """df with helper columns, and whether a row's key may be among wanted's single column."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_WORDS * 64))
    name = wanted.columns[0]
    words = (
        wanted.where(F.col(name).isNotNull())
        .select(bit(F.col(name)).alias("__b"))
        .groupBy(F.shiftrightunsigned("__b", 6).alias("__w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(__b % 64))")).alias("__m"))
    )
    df = df.withColumn("__b", bit(F.col(key))).withColumn("__w", F.shiftrightunsigned("__b", 6)).join(F.broadcast(words), "__w", "left")
    return df, F.expr("coalesce(getbit(__m, int(__b % 64)) = 1, false)")


def might_hold(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of df whose key may be among wanted's single column: all that are, and few others.

    wanted becomes a bitmap of a fixed size (BITMAP_WORDS rows), so what is broadcast doesn't grow with the data. Rows
    that pass by chance are for the join that follows.
    """
    marked, may = _marked(df, key, wanted)
    return marked.where(may).select(*df.columns)


def parted(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """might_hold(), and the rows that surely aren't among wanted's."""
    marked, may = _marked(df, key, wanted)
    return marked.where(may).select(*df.columns), marked.where(~may).select(*df.columns)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of df whose key isn't among gone's single column; null keys stay. Only rows that the bitmap can't clear are shuffled."""
    marked, may = _marked(df, key, gone)
    rest = might_hold(df, key, gone)
    name = gone.columns[0]
    gone = gone.select(F.col(name).alias("__gone")).distinct()
    return marked.where(~may).select(*df.columns).union(rest.join(gone, rest[key] == F.col("__gone"), "left_anti").select(*df.columns))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file: $HARROW_TOKENIZERS, else the installed package of such files."""
    if folder := os.environ.get("HARROW_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
