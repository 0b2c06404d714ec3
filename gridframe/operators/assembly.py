"""From chunks and cells to crops: clip chunks to the box, join cells by place, subtract the box's origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions import grid as g


def _box(axis: int, end: str) -> Column:
    return F.element_at("aabb", axis + 1)[end]


def _places(chunks: DataFrame, rank: int) -> DataFrame:
    """Every place of every chunk inside the box: its coordinate in the array as ``at``."""
    own = [c for c in ("sample_seq", "batch_id", "sample_idx", "aabb") if c in chunks.columns]
    clip = g.clip(F.col("aabb"), F.col("chunk_coord"), F.col("inner"))
    return g.explode_ranges(chunks.select(*own, clip.alias("clip")), "clip", rank, "at").drop("clip")


def crop_rows(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of each sample's chunks, clipped, at places relative to the box. ``rows(y, values)``: a dense array's rows.

    A chunk meets a row of the array once and takes a slice of it; cells become rows of their own at the very end.
    """
    clip = g.clip(F.col("aabb"), F.col("chunk_coord"), F.col("inner"))
    own = chunks.select("batch_id", "sample_idx", "aabb", clip.alias("clip")).withColumn("y", F.explode(F.sequence(F.col("clip")[0]["beg"], F.col("clip")[0]["end"] - 1)))
    first, end = F.col("clip")[1]["beg"], F.col("clip")[1]["end"]
    part = F.slice("values", (first + 1).cast("int"), (end - first).cast("int"))
    slices = own.join(rows, "y").select("batch_id", "sample_idx", (F.col("y") - _box(0, "beg")).alias("y"), (first - _box(1, "beg")).alias("x0"), part.alias("part"))
    cells = slices.select("batch_id", "sample_idx", "y", "x0", F.posexplode("part").alias("dx", "value"))
    return cells.select("batch_id", "sample_idx", "y", (F.col("x0") + F.col("dx")).alias("x"), "value")


def fill_cells(chunks: DataFrame, fill: Column) -> DataFrame:
    """The box's places with one value; nothing is read."""
    return _places(chunks, 2).withColumns({"y": F.col("at")[0] - _box(0, "beg"), "x": F.col("at")[1] - _box(1, "beg"), "value": fill})


def sparse_cells(chunks: DataFrame, cells: DataFrame, fill: float) -> DataFrame:
    """The box's places joined to ``cells(y, x, value)``; absent cells, and so absent chunks and shards, take ``fill``."""
    at = _places(chunks, 2).select("sample_seq", F.col("at")[0].alias("ay"), F.col("at")[1].alias("ax"), _box(0, "beg").alias("y0"), _box(1, "beg").alias("x0"))
    found = at.join(cells.select(F.col("y").alias("ay"), F.col("x").alias("ax"), "value"), ["ay", "ax"], "left")
    return found.select("sample_seq", (F.col("ay") - F.col("y0")).alias("y"), (F.col("ax") - F.col("x0")).alias("x"), F.coalesce("value", F.lit(fill).cast("float")).alias("value"))


def rank1_cells(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """Crops of a rank-1 array of ``cells(x, value)``."""
    places = _places(chunks, 1).select("sample_seq", F.col("at")[0].alias("ax"), (F.col("at")[0] - _box(0, "beg")).alias("x"))
    return places.join(cells.select(F.col("x").alias("ax"), "value"), "ax").drop("ax")


def block_cells(blocks: DataFrame, shape: list[int]) -> DataFrame:
    """Dense float32 blocks (batch_id, sample_idx, data) as one row a cell."""
    cells = blocks.select("batch_id", "sample_idx", F.posexplode("data").alias("place", "value"))
    at = g.unravel(F.col("place").cast("long"), shape)
    return cells.select("batch_id", "sample_idx", at[0].alias("y"), at[1].alias("x"), "value")
