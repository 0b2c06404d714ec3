"""Column functions over boxes, grids and byte ranges; everything here is evaluated by the JVM.

A box is ``array<struct<beg: bigint, end: bigint>>``, half open; shapes are ``array<bigint>``; both in storage order.
Where a rank is given, a function is plain arithmetic on that many axes, which runs compiled; without, arrays may differ in rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an element.
DTYPE_BYTES = {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "float16": 2, "float32": 4, "float64": 8}
#: Element types that an output can be cast from.
CASTABLE = ("uint8", "uint16", "int16", "uint32", "int32", "float16", "float32")
#: Fixed value: largest chunk in bytes that the format allows.
MAX_CHUNK_BYTES = (1 << 32) - 1


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division of numbers that are not negative."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def axes(rank: int, *arrays: Column) -> list[tuple[Column, ...]]:
    """What each axis has in the arrays; null where an array is too short."""
    return [tuple(F.get(a, F.lit(k)) for a in arrays) for k in range(rank)]


def product(values: Column, rank: int | None = None) -> Column:
    if rank:
        return reduce(mul, [x for (x,) in axes(rank, values)])
    return F.aggregate(values, F.lit(1).cast("long"), lambda a, x: a * x)


def row_major(coord: Column, extent: Column, rank: int | None = None) -> Column:
    """Place of a coordinate in row-major order."""
    if rank:
        return reduce(lambda a, x: a * x[1] + x[0], axes(rank, coord, extent), F.lit(0).cast("long"))
    return F.aggregate(F.arrays_zip(coord.alias("c"), extent.alias("e")), F.lit(0).cast("long"), lambda a, x: a * x["e"] + x["c"])


def unravel(place: Column, extent: Sequence[int]) -> list[Column]:
    """The coordinate at a place in row-major order; plain arithmetic, which runs compiled for each cell."""
    return [div(place, math.prod(extent[k + 1 :])) % n for k, n in enumerate(extent)]


def strides(shape: Column) -> Column:
    """Row-major strides in elements."""
    return F.transform(F.sequence(F.lit(1), F.size(shape)), lambda k: product(F.slice(shape, k + 1, F.size(shape))))


def chunk_range(box: Column, inner: Column, rank: int | None = None) -> Column:
    """The half-open range of chunks that a box touches, on each axis."""
    one = lambda b, s: F.struct(div(b["beg"], s).alias("beg"), (div(b["end"] - 1, s) + 1).alias("end"))
    return F.array(*[one(b, s) for b, s in axes(rank, box, inner)]) if rank else F.zip_with(box, inner, one)


def inner_per_shard(shard: Column, inner: Column) -> Column:
    return F.zip_with(shard, inner, div)


def extents(ranges: Column, rank: int | None = None) -> Column:
    if rank:
        return F.array(*[r["end"] - r["beg"] for (r,) in axes(rank, ranges)])
    return F.transform(ranges, lambda r: r["end"] - r["beg"])


def begins(ranges: Column) -> Column:
    return F.transform(ranges, lambda r: r["beg"])


def explode_ranges(df: DataFrame, ranges: str | Column, rank: int, out: str) -> DataFrame:
    """A row for each coordinate of half-open ranges, as the array ``out``: one generator an axis, which runs compiled."""
    ranges = F.col(ranges) if isinstance(ranges, str) else ranges
    df = df.withColumn("_ranges", ranges)
    for k in range(rank):
        r = F.col("_ranges")[k]
        df = df.withColumn(f"_at{k}", F.explode(F.when(r["beg"] < r["end"], F.sequence(r["beg"], r["end"] - 1))))
    return df.withColumn(out, F.array(*[F.col(f"_at{k}") for k in range(rank)])).drop("_ranges", *[f"_at{k}" for k in range(rank)])


def inside(box: Column, shape: Column, rank: int | None = None) -> Column:
    """Whether a box lies within an array and is not empty on any axis."""
    one = lambda b, s: (b["beg"] >= 0) & (b["end"] > b["beg"]) & (b["end"] <= s)
    return reduce(and_, [one(b, s) for b, s in axes(rank, box, shape)]) if rank else F.forall(F.zip_with(box, shape, one), lambda x: x)


def clip(box: Column, chunk: Column, inner: Column) -> Column:
    """The part of a box that lies in a chunk, on each axis, in the array's coordinates."""
    own = F.zip_with(chunk, inner, lambda c, s: F.struct((c * s).alias("beg"), ((c + 1) * s).alias("end")))
    return F.zip_with(box, own, lambda b, c: F.struct(F.greatest(b["beg"], c["beg"]).alias("beg"), F.least(b["end"], c["end"]).alias("end")))


def box_text(box: Column) -> Column:
    """``[b,e)x[b,e)``."""
    return F.array_join(F.transform(box, lambda b: F.concat(F.lit("["), b["beg"].cast("string"), F.lit(","), b["end"].cast("string"), F.lit(")"))), "x")


def chunk_bytes(dtype: Column, inner: Column) -> Column:
    """Bytes of a chunk; 0 if unknown or beyond what the format allows."""
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DTYPE_BYTES.items() for x in pair]), dtype), F.lit(0)) * product(inner)
    return F.when(size > MAX_CHUNK_BYTES, F.lit(0)).otherwise(size).cast("long")


def castable(dtype: Column) -> Column:
    return dtype.isin(*CASTABLE)


def page_begin(offset: Column, page: int) -> Column:
    return div(offset, page) * page


def page_end(end: Column, page: int) -> Column:
    return div(end + (page - 1), page) * page


def shard_path(uri: Column, coord: Column) -> Column:
    """``uri/c/i/j``, without doubling a slash."""
    return F.concat_ws("/", F.rtrim(uri, F.lit("/")), F.lit("c"), F.array_join(F.transform(coord, lambda c: c.cast("string")), "/"))


def log2_bucket(ns: Column, buckets: int = 48) -> Column:
    """floor(log2 ns) by counting bits, 0 for 0 and 1; the last bucket takes the rest."""
    return F.least(F.lit(buckets - 1), F.length(F.bin(F.greatest(ns, F.lit(1)))) - 1)


def bfloat16(value: Column) -> Column:
    """A whole number as the nearest bfloat16, ties to even, after rounding to float32."""
    x = value.cast("float").cast("double")
    magnitude = F.abs(x)
    unit = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(magnitude, F.lit(1.0)))) - 7), F.lit(1.0))
    return (F.rint(x / unit) * unit).cast("float")


def cycle(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
