"""The shared folder, as the library has it, and what bounds the memory of Python workers."""

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from presswire.sources.scratch import new_path, written

__all__ = ["bounded_batches", "new_path", "trimmed", "written"]

#: Bytes of rows that go to a Python worker at once. The default of 64 MB, doubled as buffers grow, is held by every task in the JVM and in Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """``spark``, with Arrow batches of at most about ``BATCH_BYTES`` from here on; a session with smaller ones keeps them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives memory that it has freed back to the system, as workers are kept for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only in glibc
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped
