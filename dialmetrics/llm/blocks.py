"""Blocks of documents, for jobs in which documents ask for something and get it back.

A block is a run of rows of about a given size, packed into one row (Arrow,
compressed). It is numbered by partition and place, so that a job can cut the
same blocks from the same table again; requests and answers are packed too.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame


def give_back() -> None:
    """Return to the system what finished work held; workers live on and share the executor with those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):    # no such call here: nothing to return
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A map over batches that gives its memory back when it ends."""
    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return inner


def frugal_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group that gives its memory back after each group; for groups of megabytes."""
    @wraps(work)
    def inner(table: pa.Table) -> pa.Table:     # Spark counts the arguments
        try:
            return work(table)
        finally:
            give_back()
    return inner


def frugal_pair(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``frugal_group`` for two groups that meet."""
    @wraps(work)
    def inner(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            give_back()
    return inner


def release(rows: DataFrame) -> None:
    """Have Spark remove the shuffle files of steps that are stored by now: it does when the driver's JVM collects garbage."""
    gc.collect()    # tables of Python's that nothing but a cycle holds
    rows.sparkSession.sparkContext._jvm.System.gc()


def pack(items: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items), 1)


def unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def unpack_array(packed: bytes) -> pa.Array:
    """``unpack`` as one Arrow array, without an object for each item."""
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.frombuffer(raw, np.uint32, n, 4), out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw).slice(4 + 4 * n)])


def joined(items: pa.Array, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, each the ``items`` of the places up to its end in ``at``, joined."""
    found = items.take(pa.array(at))
    offsets = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, 4 * found.offset)
    cuts = pa.py_buffer(np.ascontiguousarray(offsets[np.r_[0, ends]]))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, cuts, found.buffers()[2]])


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[int, pa.Table]]:
    """Numbered runs of rows of about ``size`` bytes of text, however the batches are cut."""
    first = TaskContext.get().partitionId() << 32
    held, total, n = [], 0, 0
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        for i, k in enumerate(lengths.tolist()):
            total += k
            if total >= size:
                held.append(batch.slice(start, i + 1 - start))
                yield first + n, pa.Table.from_batches(held)
                held, total, n, start = [], 0, n + 1, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield first + n, pa.Table.from_batches(held)


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def pack_numbers(x: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane: high bytes of small numbers cost next to nothing."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack_numbers(packed: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()
