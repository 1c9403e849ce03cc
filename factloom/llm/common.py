"""Helpers shared by the corpus operators: shared-folder tables and Arrow batch plumbing."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte table that lower-cases A-Z only; every other byte, so also all of UTF-8's, stays.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Paths of the written tables, by the identity of the DataFrame that reads them.
_written: dict[int, tuple[DataFrame, str]] = {}


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Bytes of an Arrow batch on its way to a Python worker, while materialise() runs.
ARROW_BATCH = "8m"
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    It cuts the lineage, fixes what depends on task order (running ids) and survives lost executors: a
    committed file comes from exactly one attempt of its task. Files go by release(), or when the driver ends.
    settings: Spark's, that hold while the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"
    with _settings(spark, {_SETTING: ARROW_BATCH} | (settings or {})):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _written:
        atexit.unregister(_sweep)
        atexit.register(_sweep)  # after the session's own, so that it runs before
    _written[id(out)] = out, path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise() returned and that nothing reads any more."""
    for df in tables:
        _, path = _written.pop(id(df))
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    try:
        release(*[df for df, _ in _written.values()])
    except Exception:  # the session has ended before the interpreter
        _written.clear()


#: What workers keep between tasks, by the name of the operator, with how to forget it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    """Say that workers keep something for an operator."""
    _kept[name] = forget


def only(name: str = "") -> None:
    """Forget, in this worker, what it keeps for other operators than `name`: workers outlive stages."""
    for other, forget in _kept.items():
        if other != name:
            forget()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: nothing to trim by hand
        return None


def trim() -> None:
    """Give memory that is free in this worker back to the system: workers outlive stages, and an executor's are several."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a batch's texts; null counts as empty."""
    col = batch.column(column).cast(pa.large_binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most `limit` text bytes each (a longer row stands alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(size):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()
