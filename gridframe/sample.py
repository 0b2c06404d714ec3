"""Samples: a uri and a box of half-open ranges."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SAMPLES = "sample_seq bigint, uri string, aabb array<struct<beg:bigint,end:bigint>>"


class Box(NamedTuple):
    """One sample as it is pushed; ``Sample`` makes it from slices or pairs."""

    uri: str
    aabb: tuple[tuple[int, int], ...]


def bounds(axis: slice | tuple[int, int]) -> tuple[int, int]:
    """Begin and end of an axis. Slices need an end and no step; their begin may be missing."""
    match axis:
        case slice(start=begin, stop=int(end), step=None | 1):
            return int(begin or 0), end
        case slice():
            raise ValueError("a slice has an end, and no step but 1")
        case (begin, end):
            return int(begin), int(end)
    raise TypeError("an axis is a slice or a pair")


def Sample(uri: str, aabb: Iterable[slice | tuple[int, int]]) -> Box:  # noqa: N802
    return Box(uri, tuple(map(bounds, aabb)))


def samples_df(spark: SparkSession, samples: Iterable[Box], first: int = 0) -> DataFrame:
    """Samples numbered in their order from ``first``."""
    return spark.createDataFrame([(first + k, s.uri, list(s.aabb)) for k, s in enumerate(samples)], SAMPLES)
