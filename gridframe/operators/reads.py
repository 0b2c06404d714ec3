"""From loads to read operations: page windows, order, fusion under caps, interleaving and groups.

A batch has at most ``MAX_BATCH_CHUNKS`` chunks (``planning.over_batch_cap`` rejects larger ones), and batches are the
parallel axis. Fusion under caps follows its rows in order and holds one open read; crops are read by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import grid as g

#: Limits and defaults of the planner.
MAX_BATCH_CHUNKS = 16384
PAGE_BYTES = 4096
MAX_READ_BYTES = 4 << 20
MAX_READ_CHUNKS = 512

BATCH_FILE = ["batch_id", "path"]
T = TypeVar("T")


def align(loads: DataFrame, page: int = PAGE_BYTES) -> DataFrame:
    """Adds the page window of each load, begin and size, and the load's place in it. ``loads(offset, nbytes)``."""
    begin = g.page_begin(F.col("offset"), page)
    return loads.withColumns({"win_offset": begin, "win_nbytes": g.page_end(F.col("offset") + F.col("nbytes"), page) - begin, "offset_in_read": F.col("offset") - begin})


def sort_rank(windows: DataFrame) -> DataFrame:
    """Adds read_rank, from 0: order by path, window and chunk within a batch."""
    order = Window.partitionBy("batch_id").orderBy("path", "win_offset", "slot")
    return windows.withColumn("read_rank", (F.row_number().over(order) - 1).cast("long"))


def fuse_touching(windows: DataFrame) -> DataFrame:
    """Windows of a file that overlap or touch become one read, without caps: gaps and islands."""
    order = Window.partitionBy(*BATCH_FILE).orderBy("win_offset", "slot")
    reach = F.max(F.col("win_offset") + F.col("win_nbytes")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = windows.withColumn("_opens", (reach.isNull() | (F.col("win_offset") > reach)).cast("int"))
    islands = opens.withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.max(F.col("win_offset") + F.col("win_nbytes"))
    return islands.groupBy(*BATCH_FILE, "island").agg(F.min("win_offset").alias("file_offset"), (end - F.min("win_offset")).alias("nbytes"), F.count("*").alias("n_chunks")).drop("island")


def fuse(windows: Iterable[tuple[int, int, T]], max_bytes: int, max_chunks: int) -> Iterator[tuple[int, int, list[T]]]:
    """Reads (begin, bytes, items) from windows (begin, bytes, item) in order of begin, greedily.

    A window joins the open read if it begins inside it or where it ends, and neither cap breaks; else it opens one. A
    lone window above the cap stays whole.
    """
    begin = end = 0
    items: list[T] = []
    for at, size, item in windows:
        far = max(end, at + size)
        if items and (at > end or len(items) >= max_chunks or far - begin > max_bytes):
            yield begin, end - begin, items
            items = []
        if not items:
            begin, far = at, at + size
        end = far
        items.append(item)
    if items:
        yield begin, end - begin, items


def fuse_capped(windows: DataFrame, max_bytes: int = MAX_READ_BYTES, max_chunks: int = MAX_READ_CHUNKS) -> DataFrame:
    """(batch_id, path, read_no, file_offset, nbytes, slots): ``fuse`` within each batch's file; ``slots`` lists a read's chunks in order."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["batch_id", "path", "read_no", "file_offset", "nbytes", "slots"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch, path), rows in groupby(stream(batches), lambda r: r[:2]):
            reads = list(fuse(((at, size, slot) for *_, at, slot, size in rows), max_bytes, max_chunks))
            out = [(batch, path, k, at, size, slots) for k, (at, size, slots) in enumerate(reads)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = windows.select(F.col("batch_id").cast("long"), "path", "win_offset", F.col("slot").cast("long"), "win_nbytes")
    ordered = rows.repartition(*BATCH_FILE).sortWithinPartitions(*BATCH_FILE, "win_offset", "slot")
    return ordered.mapInArrow(run, "batch_id long, path string, read_no long, file_offset long, nbytes long, slots array<long>")


def chunk_reads(windows: DataFrame, reads: DataFrame) -> DataFrame:
    """Each chunk with its read and its place in it."""
    members = reads.select(*BATCH_FILE, "read_no", "file_offset", F.explode("slots").alias("slot"))
    return windows.join(members, [*BATCH_FILE, "slot"]).withColumn("offset_in_read", F.col("offset") - F.col("file_offset"))


def interleave(reads: DataFrame) -> DataFrame:
    """Adds read_op_idx, from 0: one read of each file in turn, files in order of path, within a batch."""
    order = Window.partitionBy("batch_id").orderBy("read_no", "path")
    return reads.withColumn("read_op_idx", (F.row_number().over(order) - 1).cast("long"))


def group_chunks(ordered_reads: DataFrame, chunk_bytes: DataFrame) -> DataFrame:
    """(batch_id, read_op_idx, first_chunk, n_chunks, total_decompressed, nbytes): chunks of a read, as ranges of the batch's chunks.

    ``chunk_bytes(batch_id, path, slot, decompressed)``.
    """
    members = ordered_reads.select(*BATCH_FILE, "read_op_idx", "nbytes", F.explode("slots").alias("slot")).join(chunk_bytes, [*BATCH_FILE, "slot"])
    groups = members.groupBy("batch_id", "read_op_idx").agg(F.first("nbytes").alias("nbytes"), F.count("*").alias("n_chunks"), F.sum("decompressed").alias("total_decompressed"))
    before = Window.partitionBy("batch_id").orderBy("read_op_idx").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("first_chunk", F.coalesce(F.sum("n_chunks").over(before), F.lit(0)))
