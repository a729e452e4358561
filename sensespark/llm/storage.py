"""Shared work folder, written tables and file access for the operators."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensespark.sources.store import fresh_path, materialise, work_dir

__all__ = ["BROADCAST_ROWS", "fresh_path", "handing_back", "materialise", "open_filesystem", "read_table", "short_batches", "within", "work_dir"]

#: Rows of a few numbers each that may be broadcast: some ten MB.
BROADCAST_ROWS = 1 << 18
#: Rows with whole texts that go to a Python worker at a time.
BATCH = 1024
#: Seconds without a partition after which a worker forgets what it keeps for the next one.
IDLE = 1.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows, which are counted; as it is else."""
    return F.broadcast(df) if df.count() <= rows else df


def open_filesystem(path: str):
    """(filesystem, path in it) of a URI or local path, for use on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that are run within send Python workers at most ``BATCH`` rows at a time.

    Batches are held by the executor and by the worker, outside the heap; with
    whole texts Spark's 10,000 rows are tens of MB in each.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)
    spark.conf.set(key, str(min(int(given), BATCH) if int(given) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def handing_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` whose worker returns freed memory when a partition ends.

    Workers stay idle for a minute after a task, beside the tasks of other
    steps; without this each keeps some 100 MB that it has no use for.
    ``forget`` drops what is kept from one partition to the next; it is called
    once no partition has come for ``IDLE`` seconds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _busy()
        yield from work(batches)
        _release()
        if forget is not None:
            _when_idle(forget)

    return run


_WAITING: list[threading.Timer] = []


def _busy() -> None:
    while _WAITING:
        _WAITING.pop().cancel()


def _when_idle(forget: Callable[[], None]) -> None:
    def drop() -> None:
        forget()
        _release()

    _busy()
    _WAITING.append(threading.Timer(IDLE, drop))
    _WAITING[-1].daemon = True
    _WAITING[-1].start()


def _release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
