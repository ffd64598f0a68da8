"""What the operators of this subpackage share: tables, written stages and byte-level word arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..deploy import Stages, input_bytes, ship

__all__ = ["Stages", "input_bytes"]

#: Rows and bytes of text of one batch that are taken apart at once: very long texts must not meet by thousands in a worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Limits of the batches that Spark sends, where the session names none: they lie in the executor's and the worker's memory at once.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def session(spark: SparkSession) -> SparkSession:
    """The session, with this package on its workers, and with limits of Arrow batches unless it has its own."""
    named = spark.conf.getAll
    for key, value in LIMITS.items():
        if key not in named:
            spark.conf.set(key, value)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches: Iterable[pa.RecordBatch], column: int, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices (no copies) of batches: at most so many rows, and so many bytes in a string or binary column, one row at least."""
    for batch in batches:
        offs = flat(batch.column(column))[1]
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def release() -> None:
    """Gives the memory that a worker has freed back to the system, as workers stay and serve other steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run):
    """run(batches) with release() at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, compressed, with their number before them."""
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def loosen(raw: bytes, kind) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(raw[8:], size, asbytes=True), kind) if size else np.zeros(0, kind)


# ---------------------------------------------------------------- text as bytes

#: The six ASCII white space characters that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0x9FB21C651E98DF25)
    x = x ^ (x >> U(28))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for n positions at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a)
    return _POWERS["up"], _POWERS["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets (n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the index of each row's first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offs[(offs > 0) & (offs < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_pieces(column: pa.Array, most: int):
    """Parts of a string column of at most so many bytes, one row at least: row range, bytes and offsets."""
    data, offs = flat(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
