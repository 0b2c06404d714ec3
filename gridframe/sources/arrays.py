"""Which arrays there are to sample from, and samples drawn from them: plate scans, manifests, array tables, random crops."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gridframe.sources import zarr

#: Groups in which arrays are numbered side by side.
NUMBER_GROUPS = 1024


@F.pandas_udf(ArrayType(StringType()))
def _folders(paths: pd.Series) -> pd.Series:
    def below(path: str) -> list[str]:
        try:
            with os.scandir(zarr.local(path)) as found:
                return sorted(f"{path.rstrip('/')}/{e.name}" for e in found if e.is_dir())
        except (FileNotFoundError, NotADirectoryError):
            return []

    return paths.map(below)


def scan_plate(spark: SparkSession, store_root: str, plate: str, level: str = "0") -> DataFrame:
    """(uri) of the level arrays of a plate, row/column/field/level below it, relative to ``store_root``.

    Each round lists the folders found by the one before, spread over tasks. A plate that is not there has none.
    """
    root = zarr.local(store_root).rstrip("/")
    at = spark.createDataFrame([(f"{root}/{plate}",)], "path string")
    for _ in range(3):
        at = at.select(F.explode(_folders("path")).alias("path")).repartition("path")
    levels = at.select(F.explode(_folders("path")).alias("path")).where(F.element_at(F.split("path", "/"), -1) == level)
    return levels.select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("uri"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(uri) of a JSON manifest's dataset.uris below its dataset.store_root."""
    schema = "dataset struct<store_root:string,uris:array<string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    listed = rows.select(F.rtrim("dataset.store_root", F.lit("/")).alias("root"), F.explode("dataset.uris").alias("uri"))
    return listed.select(F.concat_ws("/", "root", "uri").alias("uri"))


def array_table(meta: DataFrame, sample_shape: Sequence[int]) -> DataFrame:
    """(uri, shape) of ``meta``'s readable arrays of the samples' rank that are large enough on every axis, other rows dropped."""
    want = F.array(*[F.lit(int(n)).cast("long") for n in sample_shape])
    fits = F.forall(F.zip_with("shape", want, lambda have, least: have >= least), lambda x: x)
    return meta.where((F.col("status") == "OK") & (F.size("shape") == len(sample_shape)) & fits).select("uri", "shape")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds numbers 0, 1, ... in an order that depends on the keys alone. Groups are numbered side by side, then shifted by those before."""
    own = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(NUMBER_GROUPS)))
    counts = own.groupBy("_group").agg(F.count("*").alias("_n"))  # NUMBER_GROUPS rows at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_group", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_group").orderBy(key)) - 1
    return own.withColumn("_nth", nth).join(F.broadcast(shifts), "_group").withColumn(out, (F.col("_nth") + F.col("_before")).cast("long")).drop("_group", "_nth", "_before")


def uniform(seed: int, what: Column | str, number: Column, below: Column) -> Column:
    """A whole number below ``below``, from 60 bits of the MD5 of seed, ``what`` and number: the same on every engine."""
    what = F.lit(what) if isinstance(what, str) else what
    text = F.concat_ws(":", F.lit(str(seed)), what, number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % below


def random_crops(table: DataFrame, count: int, sample_shape: Sequence[int], seed: int = 0) -> DataFrame:
    """``count`` samples (sample_seq, uri, aabb): an array of ``array_table`` each, and a box of the shape inside it, evenly drawn.

    Arrays count in the order of ``numbered``. No arrays give no samples.
    """
    arrays = numbered(table.select("uri", "shape"), "uri", "array_no")
    size = table.agg(F.count("*").alias("arrays"))  # one row
    seq = table.sparkSession.range(count).select(F.col("id").alias("sample_seq")).join(F.broadcast(size.where("arrays > 0")))
    drawn = seq.withColumn("array_no", uniform(seed, "array", F.col("sample_seq"), F.col("arrays"))).join(arrays, "array_no")
    axes = []
    for k, n in enumerate(map(int, sample_shape)):
        begin = uniform(seed, str(k), F.col("sample_seq"), F.col("shape")[k] - n + 1)
        axes.append(F.struct(begin.alias("beg"), (begin + n).alias("end")))
    return drawn.select("sample_seq", "uri", F.array(*axes).alias("aabb"))


def touch_arrays(docs: DataFrame, root: str) -> DataFrame:
    """Writes ``docs(uri, json)`` as metadata documents below ``root``, in tasks; (written) rows."""
    base = zarr.local(root).rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, text in zip(b["uri"], b["json"], strict=True):
                os.makedirs(f"{base}/{uri}", exist_ok=True)
                with open(f"{base}/{uri}/zarr.json", "w", encoding="utf-8") as f:
                    f.write(text)
            yield pd.DataFrame({"written": b["uri"]})

    return docs.select("uri", "json").mapInPandas(run, "written string")
