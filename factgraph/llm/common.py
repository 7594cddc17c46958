"""Shared pieces: intermediate tables in the shared folder, and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: words are maximal runs of other bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Text is hashed in slices of about this many bytes, so that a batch of long texts needs no more memory.
SLICE_BYTES = 1 << 18

#: Bytes at which an Arrow batch on its way to a Python worker is full; a row is never split.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "factgraph-checkpoints")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factgraph_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what ``stage_table`` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_factgraph_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Gives memory that is free in this worker back to the system; a worker lives on for many tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows of this session reach Python workers in batches of about BATCH_BYTES, or of a smaller limit that it has.

    Spark's own limit is 10,000 rows of any length: all texts of a task at once, in the executor's vectors, in the worker and in its answer.
    """
    limit = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of ``mapInArrow``, with ``trim`` at its end."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fraction_filter(column: str, fraction: float, seed: int = 17):
    """A deterministic sample by hash: the same rows however the table is split."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 20)) < F.lit(max(1, int(min(1.0, fraction) * (1 << 20))))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; ``x`` is changed in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, the multiplier of the rolling hash, and its inverse modulo 2**64.
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(MULTIPLIER, 1 << 16), _powers(INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(MULTIPLIER, 2 * n), _powers(INVERSE, 2 * n)
    return _UP[:n], _DOWN[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hashes of data[start:end] (uint8), equal for equal bytes wherever they stand."""
    up, down = _tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], dtype=np.uint64, out=prefix[1:])
    out = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(out ^ (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """(first index, texts) of consecutive slices of about ``most`` bytes; one text is never split."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def encoded(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
