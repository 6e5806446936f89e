"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds what a Python worker holds besides its Arrow batch.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row, neither null; a null value differs from every other."""
    values = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return tuple(F.xxhash64(F.lit(salt), *values) for salt in (1, 2))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a fresh temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: The folder of the tables that one run of an operator needs for itself alone.
_parts: ContextVar[str | None] = ContextVar("parts", default=None)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{_parts.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_result(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written to the shared folder; the tables written on the way are removed once it is there."""
    parts = f"{shared_dir(spark)}/{name}-parts-{uuid.uuid4().hex}"
    token = _parts.set(parts)
    try:
        try:
            out = make()
        finally:
            _parts.reset(token)
        return written(out, name)
    finally:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(parts)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, with batches of about BATCH_BYTES.

    The bound is a setting of the session, read when the rows are asked for: it is set there, unless the session has one.
    What run() has freed goes back to the system when a task ends.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    conf = df.sparkSession.conf
    if _BATCH_SETTING not in conf.getAll:
        conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(tidy, schema)


def released() -> None:
    """Gives what a Python worker has freed back to the system: workers are kept between tasks, beside others that need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def joined_bytes(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, each followed by sep, and where each begins (and the end)."""
    data = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + len(sep) for x in texts], out=starts[1:])
    return data, starts


_ODD = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix64(np.arange(901, 903, dtype=np.uint64)) | np.uint64(1)
#: Masks of the low 0 to 8 bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_SPAN = 1 << 12


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros beyond the end; one place more than the data has."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each data[s:e], by its bytes alone, eight bytes a round; a row for each hash. Spans of over LONG_SPAN bytes are hashed one by one."""
    size = ends - starts
    out = np.empty((2, len(starts)), np.uint64)
    out[0] = mix64(size.astype(np.uint64) + np.uint64(_ODD))
    out[1] = mix64(size.astype(np.uint64) * np.uint64(_ODD) + np.uint64(1))
    eight = eight_bytes(data)
    long = size > LONG_SPAN
    left, at = np.flatnonzero((size > 0) & ~long), 0
    while len(left):
        rest = size[left] - at
        word = eight[starts[left] + at] & _LOW[np.minimum(rest, 8)]
        for k in range(2):
            out[k, left] = mix64((out[k, left] ^ word) * _FACTORS[k] + np.uint64(k))
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(long):
        out[:, i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; is_word has 256 booleans."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = is_word[data]
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash of each data[s:e], by its bytes alone."""
    return span_keys(data, starts, ends)[0]
