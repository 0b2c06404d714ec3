"""From samples to chunk plans: validation, shard and chunk enumeration, and the joins that turn chunks into loads or fills.

Joins are on keys computed from the box, never on ranges, so they shuffle by key; a table of array metadata is joined
as it comes, and Spark broadcasts it only where its size allows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import grid as g


def validate_samples(samples: DataFrame, meta: DataFrame, sample_shape: list[int]) -> DataFrame:
    """``samples(sample_seq, uri, aabb)`` with a status, OK or the first rule that fails.

    INVAL: no uri, or another extent than asked for, or outside the array. RANK: another rank than asked for, or than
    the array's. NOTFOUND: no such array, or what ``meta``, if it has a status, says of it. DTYPE: an element type that
    can't be cast. All columns of ``meta`` stay, its status as meta_status.
    """
    rank = len(sample_shape)
    meta = meta.withColumnRenamed("status", "meta_status") if "status" in meta.columns else meta.withColumn("meta_status", F.lit("OK"))
    joined = samples.join(meta, "uri", "left")
    status = (
        F.when(F.col("uri").isNull(), "INVAL")
        .when(F.size("aabb") != rank, "RANK")
        .when(~reduce(and_, [b["end"] - b["beg"] == s for (b,), s in zip(g.axes(rank, F.col("aabb")), sample_shape, strict=True)]), "INVAL")
        .when(F.col("shape").isNull(), F.coalesce(F.nullif("meta_status", F.lit("OK")), F.lit("NOTFOUND")))
        .when(F.size("shape") != rank, "RANK")
        .when(~g.castable(F.col("dtype")), "DTYPE")
        .when(~g.inside(F.col("aabb"), F.col("shape"), rank), "INVAL")
        .otherwise("OK")
    )
    return joined.withColumn("status", status)


def array_facts(meta: DataFrame) -> DataFrame:
    """Adds what follows from an array's metadata alone, once for each array rather than for each sample: ips and chunk_nbytes."""
    return meta.withColumns({"ips": g.inner_per_shard(F.col("shard"), F.col("inner")), "chunk_nbytes": g.chunk_bytes(F.col("dtype"), F.col("inner"))})


def enforce_limits(ranged: DataFrame, max_shards: int, max_chunk_bytes: int, rank: int | None = None) -> DataFrame:
    """Checked samples with ranges: INVAL beyond the shards that a sample may touch, BUDGET beyond the bytes of a decoded chunk."""
    size = F.col("chunk_nbytes") if "chunk_nbytes" in ranged.columns else g.chunk_bytes(F.col("dtype"), F.col("inner"))
    status = (
        F.when(F.col("status") != "OK", F.col("status"))
        .when((size == 0) | (size > max_chunk_bytes), "BUDGET")
        .when(g.product(g.extents(F.col("shards"), rank), rank) > max_shards, "INVAL")
        .otherwise("OK")
    )
    return ranged.withColumn("status", status)


def over_batch_cap(ranged: DataFrame, max_chunks: int, rank: int | None = None) -> DataFrame:
    """Checked samples with batch_id: all of a batch are BUDGET if its good samples have more chunks than that together."""
    own = F.when(F.col("status") == "OK", g.product(g.extents(F.col("chunks"), rank), rank)).otherwise(0)
    total = F.sum(own).over(Window.partitionBy("batch_id"))
    return ranged.withColumn("status", F.when((F.col("status") == "OK") & (total > max_chunks), "BUDGET").otherwise(F.col("status")))


def first_error(validated: DataFrame) -> DataFrame:
    """One row: how many samples come before the first bad one, and its status; all and OK if none is bad."""
    bad = F.col("status") != "OK"
    return validated.agg(
        F.coalesce(F.min(F.when(bad, F.col("sample_seq"))), F.count("*")).cast("long").alias("n_good"),
        F.coalesce(F.min_by("status", F.when(bad, F.col("sample_seq"))), F.lit("OK")).alias("status"),
    )


def sample_ranges(samples: DataFrame, rank: int | None = None) -> DataFrame:
    """Adds chunks and shards, the half-open ranges a sample touches, and ips, chunks per shard on each axis."""
    samples = samples if "ips" in samples.columns else samples.withColumn("ips", g.inner_per_shard(F.col("shard"), F.col("inner")))
    return samples.withColumn("chunks", g.chunk_range(F.col("aabb"), F.col("inner"), rank)).withColumn("shards", g.chunk_range(F.col("chunks"), F.col("ips"), rank))


def per_axis(ranged: DataFrame, *columns: Column) -> DataFrame:
    """A row for each axis, numbered from 0."""
    return ranged.select("sample_seq", F.posexplode(F.arrays_zip(*columns)).alias("axis", "a"))


def sample_shards(ranged: DataFrame, rank: int) -> DataFrame:
    """A row for each shard of a sample, numbered in row-major order."""
    rows = g.explode_ranges(ranged, "shards", rank, "shard_coord")
    place = g.row_major(F.zip_with("shard_coord", g.begins(F.col("shards")), lambda c, b: c - b), g.extents(F.col("shards")), rank)
    return rows.withColumn("ordinal", place.cast("int"))


def sample_chunks(ranged: DataFrame, rank: int) -> DataFrame:
    """A row for each chunk of a sample: its shard, its slot there, and its place in the sample's own grid."""
    chunk = F.col("chunk_coord")
    placed = g.axes(rank, chunk, F.col("ips"), F.col("chunks"))
    return g.explode_ranges(ranged, "chunks", rank, "chunk_coord").withColumns(
        {
            "shard_coord": F.array(*[g.div(c, n) for c, n, _ in placed]),
            "slot": g.row_major(F.array(*[c % n for c, n, _ in placed]), F.col("ips"), rank),
            "chunk_d": F.array(*[c - r["beg"] for c, _, r in placed]),
        }
    )


def load_or_fill(chunks: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks joined to their index entries; ``is_fill`` where the shard is missing or the slot is empty."""
    return chunks.join(index, keys, "left").withColumn("is_fill", F.col("offset").isNull() | F.coalesce("is_empty", F.lit(True)))


def seal_batches(samples: DataFrame, batch: int, total: Column | int) -> DataFrame:
    """batch_id and sample_idx from a dense sample_seq; the ragged tail goes."""
    n = F.lit(total) if isinstance(total, int) else total
    return samples.withColumn("batch_id", g.div(F.col("sample_seq"), batch)).withColumn("sample_idx", F.col("sample_seq") % batch).where(F.col("batch_id") < g.div(n, batch))


def ready_prefix(ready: DataFrame) -> DataFrame:
    """One row: how many samples from 0 on are there without a gap. ``ready(sample_seq)``, any order."""
    # A sample opens a gap if its predecessor is missing: a join by key, where a window would sort all rows in one task.
    seqs = ready.select("sample_seq").distinct()
    heads = seqs.join(seqs.select((F.col("sample_seq") + 1).alias("sample_seq")), "sample_seq", "left_anti")
    ends = seqs.join(seqs.select((F.col("sample_seq") - 1).alias("sample_seq")), "sample_seq", "left_anti")
    has_zero = heads.agg(F.coalesce(F.max(F.when(F.col("sample_seq") == 0, 1)), F.lit(0)).alias("z"))
    return ends.agg(F.coalesce(F.min("sample_seq"), F.lit(-1)).alias("last")).join(F.broadcast(has_zero)).select(F.when(F.col("z") == 1, F.col("last") + 1).otherwise(0).cast("long").alias("prefix_length"))


def running(df: DataFrame, keys: list[str], order: str, block: int, amounts: dict[str, Column]) -> DataFrame:
    """Adds exclusive running sums per ``keys`` in order of the whole number ``order``.

    A window over a key that a third of all rows have would run in one task, so sums run in blocks of the order, and
    each block starts from the blocks before it, which are one row each.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / block)).withColumns({f"_{k}": v for k, v in amounts.items()})
    per_block = df.groupBy(*keys, "_block").agg(*[F.sum(f"_{k}").alias(f"_base_{k}") for k in amounts])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = per_block.select(*keys, "_block", *[F.coalesce(F.sum(f"_base_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in amounts])
    own = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumns({f"_own_{k}": F.coalesce(F.sum(f"_{k}").over(own), F.lit(0)) for k in amounts})
    joined = summed.join(base, [*keys, "_block"])
    return joined.withColumns({k: (F.col(f"_base_{k}") + F.col(f"_own_{k}")).cast("long") for k in amounts}).drop("_block", *[f"{p}{k}" for k in amounts for p in ("_", "_own_", "_base_")])
