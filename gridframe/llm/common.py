"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Entries that a memo of words or pieces holds before it starts anew, and bytes of an entry's text; together they bound a worker's memory.
MEMO_ENTRIES, MEMO_ENTRY_BYTES = 500_000, 256
#: Rows that a task turns into Python objects at once; bounds a worker's memory whatever the Arrow batch size.
SLICE_ROWS = 256

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, as in tests, a temporary one, but only on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/gridframe"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _save(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``. Spark deletes the shuffle files of the job as soon as the table is there."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor costs no recomputation of it.

    For tables that a returned DataFrame reads later; those that an operator is done with itself belong in ``scratch``.
    """
    return _save(df, shared_folder(df.sparkSession))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Like ``written``, for tables that are deleted when the block ends; what leaves the block must be ``written`` itself."""
    base, count = shared_folder(spark), iter(range(1 << 30))
    try:
        yield lambda df: _save(df, f"{base}/{next(count)}")
    finally:
        remove(spark, base)


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text, which decides the folds; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


_memos: dict[str, object] = {}


def memo(name: str, make: Callable[[], T]) -> T:
    """The worker's memo of that name. Workers are reused, so it outlives a task; another name's memo takes its place, so a worker holds one."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = make()
    return _memos[name]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]
