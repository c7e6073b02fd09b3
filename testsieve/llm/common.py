"""Plumbing that the operators of this folder share: cutting lineage, byte views of text columns, words as numpy arrays."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the numpy kernels take at once. Rows are never split: one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of a batch that goes to a Python worker, so that a few very long texts don't meet thousands of others.
BATCH_ROWS = 1000

_BASE = 0x9E3779B97F4A7C15 | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a run in one JVM, where all share any folder, may leave it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not _local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


#: Paths of this thread's tables that cut() wrote and nobody dropped yet, in order.
_HELD = threading.local()


def held() -> list[str]:
    if not hasattr(_HELD, "paths"):
        _HELD.paths = []
    return _HELD.paths


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes what cut() wrote since held() was `mark` long, but for the given frames; nothing else may read it any more."""
    kept = [df._cut_path for df in keep]
    for path in [p for p in held()[mark:] if p not in kept]:
        _delete(spark, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: a lost executor costs a reread, not the whole lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    held().append(path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, now and not at its next half-hourly turn."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote; the frame must not be used afterwards."""
    _delete(df.sparkSession, df._cut_path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in held():
        held().remove(path)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (its bytes, the offset of each row and the end); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes each, or of a single row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()

#: Bytes of words for the scans: digits, ASCII letters and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

#: Bytes of words that white space alone ends.
INK_BYTE = np.ones(256, bool)
INK_BYTE[[32, 9, 10, 11, 12, 13]] = False


def fold_case(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of the Latin-1 supplement in lower case; lengths stay."""
    out = LOWER[data]
    if len(out) > 1:
        second = out[1:]
        second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and the number of words before each row's begin (rows + 1 values).

    A word never reaches over the end of its row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = table[data]
    begins = np.empty(len(data), bool)
    begins[0] = ink[0]
    np.logical_and(ink[1:], ~ink[:-1], out=begins[1:])
    ends = np.empty(len(data), bool)
    ends[-1] = ink[-1]
    np.logical_and(ink[:-1], ~ink[1:], out=ends[:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ink[inner]
    ends[inner - 1] = ink[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the word stands."""
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gather(flat_offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the slices that begin at flat_offsets and are `lengths` long, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(flat_offsets - before, lengths) + np.arange(total)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A stored table, or some of its columns. A table of a few splits, fewer than there are cores, is dealt out, so that the
    Python kernels use them all; any other is read where it lies and nothing of it moves."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = min(spark.sparkContext.defaultParallelism, 32)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    name = f"_{base}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def with_batch_rows(df: DataFrame) -> DataFrame:
    """df, after bounding the rows of an Arrow batch for the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df
