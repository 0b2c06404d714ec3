"""Sharded chunked arrays on a POSIX path that all machines see: metadata, shard indexes, crops, and a writer.

Metadata and index scans run once for each distinct key, as rows with a status; a missing shard is a fill, a missing
array or broken bytes are errors of the samples that need them. Crops are read where their rows are: the windows of a
sample's chunks are aligned and fused to reads under the limits, and each read is one seek.
"""

from __future__ import annotations

import json
import math
import os
import struct
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from typing import BinaryIO, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.config import Limits
from gridframe.functions import grid as g
from gridframe.operators import planning, reads
from gridframe.sources import codecs

META = "uri string, dtype string, rank int, shape array<bigint>, inner array<bigint>, shard array<bigint>, sharded boolean, codec string, index_at_end boolean, fill_value binary, fill_f32 float, status string"
INDEX = "uri string, shard_coord array<bigint>, index_status string, entries array<struct<offset:bigint,nbytes:bigint>>"
CROPS = "batch_id bigint, sample_idx bigint, data array<float>, status string, n_chunks bigint, n_loads bigint, n_reads bigint, bytes_read bigint, read_ns bigint"
#: The empty slot's mark, and the limits on an array's rank.
EMPTY, MAX_RANK = (1 << 64) - 1, 31
#: Bytes of samples that a task works on at a time, one sample at least, and bytes that the plan of a chunk counts for.
SLICE_BYTES, CHUNK_BYTES = 32 << 20, 512


def local(path: str) -> str:
    """The path that machines open; other schemes than file: are refused rather than taken for local folders."""
    scheme, found, rest = path.partition("://")
    if found and scheme != "file":
        raise ValueError(f"array stores are POSIX paths; {scheme}:// is not supported")
    return rest if found else path.removeprefix("file:")


def scratch_store(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names; a temporary one only on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return f"{local(base or tempfile.gettempdir())}/gridframe/{uuid.uuid4().hex}"


def metadata_json(shape: Column, inner: Column, shard: Column, dtype: Column, codec: Column, index_location: Column | str, fill: Column) -> Column:
    """A metadata document. ``fill`` is JSON text."""
    listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
    text = lambda s: F.lit(s)
    own = F.when(codec == "zstd", ',{"name":"zstd","configuration":{"level":3,"checksum":false}}').when(codec == "blosc_zstd", ',{"name":"blosc","configuration":{"cname":"zstd","clevel":3,"shuffle":"shuffle"}}').otherwise("")
    where = F.lit(index_location) if isinstance(index_location, str) else index_location
    return F.concat(
        text('{"zarr_format":3,"node_type":"array","shape":'), listed(shape), text(',"data_type":"'), dtype, text('","chunk_grid":{"name":"regular","configuration":{"chunk_shape":'), listed(shard),
        text('}},"chunk_key_encoding":{"name":"default","configuration":{"separator":"/"}},"fill_value":'), fill,
        text(',"codecs":[{"name":"sharding_indexed","configuration":{"chunk_shape":'), listed(inner), text(',"codecs":[{"name":"bytes","configuration":{"endian":"little"}}'), own,
        text('],"index_codecs":[{"name":"bytes","configuration":{"endian":"little"}},{"name":"crc32c"}],"index_location":"'), where, text('"}}]}'),
    )


def numpy_type(dtype: str) -> np.dtype:
    return np.dtype(dtype).newbyteorder("<")


def _fill(value: object, dtype: str) -> np.ndarray:
    """The fill as one element; integers must be integer literals in range, floats numbers or the three special strings."""
    t = numpy_type(dtype)
    if t.kind in "iu":
        if isinstance(value, bool) or not isinstance(value, int) or not np.iinfo(t).min <= value <= np.iinfo(t).max:
            raise ValueError("fill_value")
    elif isinstance(value, str):
        special = {"NaN": math.nan, "Infinity": math.inf}
        if value.lstrip("+-") not in special or len(value) - len(value.lstrip("+-")) > 1:
            raise ValueError("fill_value")
        value = special[value.lstrip("+-")] * (-1 if value[0] == "-" else 1)
    elif isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError("fill_value")
    with np.errstate(over="ignore"):
        return np.array([value]).astype(t)


def _dims(values: object, least: int = 0) -> list[int]:
    if not isinstance(values, list) or not 1 <= len(values) <= MAX_RANK or any(isinstance(v, bool) or not isinstance(v, int) or v < least for v in values):
        raise ValueError("shape")
    return values


def _codec(listed: list) -> str:
    """The one compressor after ``bytes``; others are rejected rather than ignored."""
    names = [c["name"] for c in listed if c["name"] != "bytes"]
    if any(c["name"] == "bytes" and c.get("configuration", {}).get("endian", "little") != "little" for c in listed) or len(names) > 1:
        raise ValueError("codecs")
    if not names:
        return "none"
    if names[0] == "blosc":
        kind = next(c for c in listed if c["name"] == "blosc")["configuration"]["cname"]
        if kind not in ("zstd", "lz4", "lz4hc"):
            raise ValueError("cname")
        return "blosc_zstd" if kind == "zstd" else "blosc_lz4"
    if names[0] != "zstd":
        raise ValueError("codecs")
    return "zstd"


def parse_document(text: str) -> dict:
    """The fields of a metadata document; ValueError, KeyError or TypeError if it breaks a rule."""
    doc = json.loads(text)
    if doc["node_type"] != "array" or doc["zarr_format"] != 3 or isinstance(doc["zarr_format"], float):
        raise ValueError("not an array of format 3")
    if doc.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/") != "/":
        raise ValueError("chunk keys")
    shape, dtype = _dims(doc["shape"]), doc["data_type"]
    if dtype not in g.DTYPE_BYTES:
        raise ValueError("data_type")
    fill = _fill(doc.get("fill_value", 0), dtype)
    outer = _dims(doc["chunk_grid"]["configuration"]["chunk_shape"], 1)
    sharding = next((c["configuration"] for c in doc["codecs"] if c["name"] == "sharding_indexed"), None)
    if sharding and len(doc["codecs"]) > 1:
        raise ValueError("codecs beside sharding")
    inner = _dims(sharding["chunk_shape"], 1) if sharding else outer
    if not len(shape) == len(outer) == len(inner) or any(o % i for o, i in zip(outer, inner, strict=True)):
        raise ValueError("chunk_shape")
    return {
        "dtype": dtype, "rank": len(shape), "shape": shape, "inner": inner, "shard": outer, "sharded": bool(sharding), "codec": _codec((sharding or doc)["codecs"]),
        "index_at_end": not sharding or sharding.get("index_location", "end") != "start", "fill_value": fill.tobytes(), "fill_f32": float(fill.astype(np.float32)[0]), "status": "OK",
    }


_NOTHING = dict.fromkeys(("dtype", "rank", "shape", "inner", "shard", "sharded", "codec", "index_at_end", "fill_value", "fill_f32"))
_META_TYPE = pa.schema(
    [("uri", pa.string()), ("dtype", pa.string()), ("rank", pa.int32()), ("shape", pa.list_(pa.int64())), ("inner", pa.list_(pa.int64())), ("shard", pa.list_(pa.int64())), ("sharded", pa.bool_()), ("codec", pa.string()),
     ("index_at_end", pa.bool_()), ("fill_value", pa.binary()), ("fill_f32", pa.float32()), ("status", pa.string())]
)


def _parsed(text: str | None) -> dict:
    if text is None:
        return _NOTHING | {"status": "NOTFOUND"}
    try:
        return parse_document(text)
    except (ValueError, KeyError, TypeError, AttributeError, OverflowError):
        return _NOTHING | {"status": "DECODE"}


def parse_metadata(docs: DataFrame) -> DataFrame:
    """Rows of ``META`` for ``docs(uri, json)``; a null document is NOTFOUND, a broken one DECODE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"uri": u} | _parsed(t) for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_META_TYPE)

    return docs.select("uri", "json").mapInArrow(run, META)


def scan_metadata(uris: DataFrame) -> DataFrame:
    """Rows of ``META`` for each distinct uri, from ``<uri>/zarr.json``."""

    @F.pandas_udf("string")
    def read(paths: pd.Series) -> pd.Series:
        def one(p: str) -> str | None:
            try:
                with open(f"{local(p)}/zarr.json", encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
            except (OSError, UnicodeDecodeError):
                return ""

        return paths.map(one)

    return parse_metadata(uris.select("uri").distinct().select("uri", read("uri").alias("json")))


def decode_index(data: bytes, n: int) -> np.ndarray:
    """n pairs (offset, nbytes) as unsigned 64-bit integers; DecodeError for a wrong length or checksum, or half a mark."""
    if len(data) != 16 * n + 4 or codecs.crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise codecs.DecodeError("shard index")
    pairs = np.frombuffer(data[:-4], "<u8").reshape(n, 2)
    if ((pairs == EMPTY).sum(1) == 1).any():
        raise codecs.DecodeError("half an empty slot")
    return pairs


def index_rows(docs: DataFrame) -> DataFrame:
    """(key, index_status, entries) for ``docs(key, n, index)``, an index of n slots as bytes: OK, or DECODE without entries. Empty slots are null."""
    kind = pa.schema([("key", pa.string()), ("index_status", pa.string()), ("entries", _ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"key": r["key"]} | _decoded(r["index"], r["n"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return docs.select("key", F.col("n").cast("long"), "index").mapInArrow(run, "key string, index_status string, entries array<struct<offset:bigint,nbytes:bigint>>")


_ENTRIES = pa.list_(pa.struct([("offset", pa.int64()), ("nbytes", pa.int64())]))


def _decoded(data: bytes, n: int) -> dict:
    try:
        pairs = decode_index(data, n)
    except codecs.DecodeError:
        return {"index_status": "DECODE", "entries": None}
    return {"index_status": "OK", "entries": [None if o == EMPTY else {"offset": o, "nbytes": b} for o, b in pairs.tolist()]}


def index_bytes(files: DataFrame) -> DataFrame:
    """(key, n, index) for ``files(key, entries)``: each file's index as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_pylist()
            index = [encode_index(e and (e["offset"], e["nbytes"]) for e in entries) for entries in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, own), pa.int64()), pa.array(index, pa.binary())], ["key", "n", "index"])

    return files.select("key", "entries").mapInArrow(run, "key string, n long, index binary")


def encode_index(entries: Iterable[tuple[int, int] | None]) -> bytes:
    """The inverse of ``decode_index``; none is an empty slot."""
    table = np.array([(EMPTY, EMPTY) if e is None else e for e in entries], "<u8").tobytes()
    return table + struct.pack("<I", codecs.crc32c(table))


def shard_file(uri: str, coord: Iterable[int]) -> str:
    return f"{local(uri).rstrip('/')}/c/{'/'.join(map(str, coord))}"


def scan_indexes(shards: DataFrame) -> DataFrame:
    """Rows of ``INDEX`` for ``shards(uri, shard_coord, ips, sharded, index_at_end)``, one for each distinct shard, read once.

    The status is NOTFOUND for a missing file, DECODE for a broken index, IO for a failed read, else OK with an entry
    for each slot, null where it is empty.
    """
    kind = pa.schema([("uri", pa.string()), ("shard_coord", pa.list_(pa.int64())), ("index_status", pa.string()), ("entries", _ENTRIES)])

    def scan(path: str, n: int, sharded: bool, at_end: bool) -> dict:
        try:
            size = os.stat(path).st_size
            if not sharded:
                return {"index_status": "OK", "entries": [{"offset": 0, "nbytes": size}]} if size else {"index_status": "DECODE", "entries": None}
            with open(path, "rb") as f:
                f.seek(max(0, size - 16 * n - 4) if at_end else 0)
                return _decoded(f.read(16 * n + 4), n)
        except (FileNotFoundError, NotADirectoryError):
            return {"index_status": "NOTFOUND", "entries": None}
        except OSError:
            return {"index_status": "IO", "entries": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = [{k: r[k] for k in ("uri", "shard_coord")} | scan(shard_file(r["uri"], r["shard_coord"]), math.prod(r["ips"]), r["sharded"], r["index_at_end"]) for r in b.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return shards.select("uri", "shard_coord", "ips", "sharded", "index_at_end").distinct().mapInArrow(run, INDEX)


def check_samples(samples: DataFrame, shape: list[int], limits: Limits, meta: DataFrame) -> DataFrame:
    """``samples(sample_seq, batch_id, sample_idx, uri, aabb)`` with their array's metadata, ranges, and a status."""
    rank = len(shape)
    checked = planning.validate_samples(samples, planning.array_facts(meta), shape)
    codec = F.when((F.col("status") == "OK") & (F.col("codec") == "blosc_lz4"), "DECODE").otherwise(F.col("status"))
    ranged = planning.sample_ranges(checked.withColumn("status", codec), rank)
    limited = planning.enforce_limits(ranged, limits.max_shards_per_sample, limits.max_chunk_uncompressed_bytes, rank)
    return planning.over_batch_cap(limited.drop("chunk_nbytes"), limits.max_batch_chunks, rank)


def plan_crops(samples: DataFrame, shape: list[int], limits: Limits = Limits(), meta: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Chunk plans: a row for each chunk of each good sample, a load with its place in its shard's file or a fill, and one for each bad sample.

    ``status`` is the sample's, or DECODE or IO for a chunk whose shard has a broken index.
    """
    meta = scan_metadata(samples) if meta is None else meta
    checked = check_samples(samples, shape, limits, meta)
    good = F.col("status") == "OK"
    one = F.array_repeat(F.struct(F.lit(0).cast("long").alias("beg"), F.lit(1).cast("long").alias("end")), len(shape))
    chunks = planning.sample_chunks(checked.withColumn("chunks", F.when(good, F.col("chunks")).otherwise(one)), len(shape))
    index = scan_indexes(chunks.where(good))
    entry = F.when(good & (F.col("index_status") == "OK"), F.get("entries", F.col("slot").cast("int")))
    placed = chunks.join(index, ["uri", "shard_coord"], "left").withColumns({"offset": entry["offset"], "nbytes": entry["nbytes"]})
    status = F.when(good & F.col("index_status").isin("DECODE", "IO"), F.col("index_status")).otherwise(F.col("status"))
    return placed.withColumns({"is_fill": good & F.col("offset").isNull(), "status": status}).drop("entries", "index_status")


def sample_statuses(plan: DataFrame) -> DataFrame:
    """(sample_seq, status) of each sample of a chunk plan: OK, or its worst chunk's."""
    bad = F.max(F.when(F.col("status") != "OK", F.col("status")))
    return plan.groupBy("sample_seq").agg(F.coalesce(bad, F.lit("OK")).alias("status"))


def read_crops(samples: DataFrame, shape: list[int], dtype: str = "float32", limits: Limits = Limits(), meta: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Rows of ``CROPS``: dense crops, values cast to float32 and for bfloat16 rounded to it, and what reading them took.

    A bad sample has no data but a status; so has one whose chunks turn out to be cut short (IO) or broken (DECODE). A
    sample's chunks, bounded by its box, travel as one row; a task reads, decodes and scatters them.
    """
    plan = plan_crops(samples, shape, limits, meta)
    fields = F.struct("chunk_coord", "shard_coord", "offset", "nbytes", "is_fill")
    bad = F.max(F.when(F.col("status") != "OK", F.col("status")))
    firsts = [F.first(c).alias(c) for c in ("uri", "aabb", "inner", "dtype", "codec", "fill_value")]
    rows = plan.groupBy("batch_id", "sample_idx").agg(*firsts, F.coalesce(bad, F.lit("OK")).alias("status"), F.collect_list(fields).alias("chunks"))
    crop = _Crops(tuple(shape), dtype, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with _Files() as files:
                for part in crop.slices(b):
                    yield crop(part, files)

    return rows.sortWithinPartitions("uri", "aabb").mapInArrow(run, CROPS)


class _Files(dict):
    """Open files by path, at most 64."""

    def __enter__(self) -> _Files:
        return self

    def __exit__(self, *_) -> None:
        for f in self.values():
            f.close()

    def __missing__(self, path: str) -> BinaryIO:
        if len(self) >= 64:
            self.pop(next(iter(self))).close()
        self[path] = f = open(path, "rb")  # noqa: SIM115
        return f


@dataclass(frozen=True)
class _Crops:
    """Reads a slice of samples as a batch of ``CROPS``. What several of them need is read and decoded once.

    A read counts for the first sample that needs it; the time is shared out evenly.
    """

    shape: tuple[int, ...]
    dtype: str
    limits: Limits

    def slices(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Neighbouring samples, one at least; those after the first take ``SLICE_BYTES`` at most."""
        weight = np.cumsum(4 * math.prod(self.shape) + CHUNK_BYTES * rows.column("chunks").value_lengths().to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(weight // SLICE_BYTES)) + 1).tolist(), rows.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield rows.slice(a, b - a)

    def __call__(self, rows: pa.RecordBatch, files: _Files) -> pa.RecordBatch:
        start = time.monotonic_ns()
        status = np.array(rows.column("status").to_pylist(), object)
        was_good = np.flatnonzero(status == "OK")
        good = rows.take(pa.array(was_good))
        chunks = good.column("chunks")
        n_chunks, of = chunks.value_lengths().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(good)), chunks.value_lengths())
        flat = chunks.flatten()
        load = np.flatnonzero(~flat.field("is_fill").to_numpy(zero_copy_only=False))
        loads = _Loads(of[load], *[self.table(flat.field(k))[load] for k in ("chunk_coord", "shard_coord")], *[flat.field(k).fill_null(0).to_numpy()[load] for k in ("offset", "nbytes")])
        begins = self.table(good.column("aabb"), "beg")
        box, own = np.empty((len(good), *self.shape), np.float32), np.full(len(good), "OK", object)
        took = np.zeros((2, len(good)), np.int64)
        uri = good.column("uri").dictionary_encode().indices.to_numpy()
        order = np.argsort(uri, kind="stable")
        of_uri = np.argsort(uri[loads.sample], kind="stable")
        cuts, load_cuts = (np.searchsorted(u, np.arange(uri.max(initial=-1) + 2)) for u in (uri[order], uri[loads.sample][of_uri]))
        for k in range(len(cuts) - 1):
            mine = order[cuts[k] : cuts[k + 1]]
            array = good.slice(mine[0], 1).select(["uri", "inner", "dtype", "codec", "fill_value"]).to_pylist()[0]
            box[mine] = np.frombuffer(array["fill_value"], numpy_type(array["dtype"]))[0].astype(np.float32)
            self.load(box, own, took, array, begins, loads.take(of_uri[load_cuts[k] : load_cuts[k + 1]]), files)
        status[was_good] = own
        box = codecs.to_bfloat16(box) if self.dtype == "bfloat16" else box
        counts = np.zeros((5, len(status)), np.int64)
        counts[:4, was_good] = n_chunks, np.bincount(loads.sample, minlength=len(good)), *took
        counts[4, was_good] = (time.monotonic_ns() - start) // max(1, len(good))
        full = status == "OK"
        ends = np.concatenate([[0], np.cumsum(full * math.prod(self.shape))]).astype(np.int32)
        values = (box if (own == "OK").all() else box[own == "OK"]).ravel()
        data = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~full))
        return pa.RecordBatch.from_arrays([rows.column("batch_id"), rows.column("sample_idx"), data, pa.array(status, pa.string()), *map(pa.array, counts)], [f.split()[0] for f in CROPS.split(", ")])

    def table(self, listed: pa.ListArray, field: str | None = None) -> np.ndarray:
        """A row for each list of as many whole numbers as the sample has axes."""
        flat = listed.flatten()
        return (flat.field(field) if field else flat).to_numpy().reshape(-1, len(self.shape))

    def load(self, box: np.ndarray, status: np.ndarray, took: np.ndarray, array: dict, begins: np.ndarray, loads: _Loads, files: _Files) -> None:
        """Scatters the chunks of one array into the boxes of the samples that need them, or notes why it can't."""
        inner, t = array["inner"], numpy_type(array["dtype"])
        size = t.itemsize * math.prod(inner)
        loads = loads.take(np.lexsort((loads.nbytes, loads.offset, *loads.shard.T[::-1])))
        begin, first = begins[loads.sample], loads.chunk * inner
        low, high = np.maximum(begin, first), np.minimum(begin + self.shape, first + inner)
        slices = lambda at: [map(slice, a, b) for a, b in zip((low - at).T.tolist(), (high - at).T.tolist(), strict=True)]
        source, target = list(zip(*slices(first), strict=True)), list(zip(loads.sample.tolist(), *slices(begin), strict=True))

        def failed(users: slice, why: str) -> None:
            mine = loads.sample[users]
            status[mine] = np.where(status[mine] == "OK", why, status[mine])

        for path, at, n, chunks in self.reads(array["uri"], loads):
            try:
                files[path].seek(at)
                data = files[path].read(n)
            except OSError:
                failed(slice(chunks[0][0].start, chunks[-1][0].stop), "IO")
                continue
            took[:, loads.sample[chunks[0][0].start]] += 1, len(data)
            for users, offset, nbytes in chunks:
                if len(data) < offset - at + nbytes:
                    failed(users, "IO")
                    continue
                try:
                    block = np.frombuffer(codecs.decode(data[offset - at : offset - at + nbytes], array["codec"], size), t).reshape(inner)
                except codecs.DecodeError:
                    failed(users, "DECODE")
                    continue
                for k in range(users.start, users.stop):
                    box[target[k]] = block[source[k]]

    def reads(self, uri: str, loads: _Loads) -> Iterator[tuple[str, int, int, list[tuple[slice, int, int]]]]:
        """Each file's distinct chunks, aligned and fused, with the loads that need them; ``planned reads`` and reads that are done are the same."""
        page = self.limits.page_alignment
        key = np.column_stack([loads.shard, loads.offset, loads.nbytes])
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else []
        ends = [*starts[1:], len(key)]
        chunks = zip(loads.shard[starts].tolist(), map(slice, map(int, starts), map(int, ends)), loads.offset[starts].tolist(), loads.nbytes[starts].tolist(), strict=True) if len(key) else ()
        for coord, own in groupby(chunks, lambda c: c[0]):
            windows = ((o // page * page, -(-(o + n) // page) * page - o // page * page, (users, o, n)) for _, users, o, n in own)
            for begin, size, fused in reads.fuse(windows, self.limits.max_read_op_bytes, self.limits.max_chunks_per_read):
                yield shard_file(uri, coord), begin, size, fused


class _Loads(NamedTuple):
    """Chunks that samples need, a row each: the sample's place, the chunk's and its shard's coordinates, and where its bytes are."""

    sample: np.ndarray
    chunk: np.ndarray
    shard: np.ndarray
    offset: np.ndarray
    nbytes: np.ndarray

    def take(self, rows: np.ndarray) -> _Loads:
        return _Loads(*(column[rows] for column in self))


def write_array(rows: DataFrame, root: str, shape: Sequence[int], inner: Sequence[int], shard: Sequence[int], dtype: str, codec: str, fill: float = 0, index_location: str = "end") -> None:
    """An array of any rank as sharded files below ``root``, from ``rows(at, values)``: the last axis' values at the other axes' coordinates.

    ``at`` is an array of whole numbers, or for rank 2 a column ``row``. Rows that are missing, and what is missing at
    a row's end, are the fill; where a row repeats, one of them is taken. A shard is one task's group and is bounded by
    its shape. Chunks that hold the fill alone stay empty slots.
    """
    path, t, rank = local(root), numpy_type(dtype), len(shape)
    per, width = [s // i for s, i in zip(shard, inner, strict=True)], shard[-1]
    at = F.array("row").cast("array<bigint>") if "row" in rows.columns else F.col("at").cast("array<bigint>")
    lead = F.array(*[g.div(F.col("at")[k], int(shard[k])) for k in range(rank - 1)])
    spread = rows.select(at.alias("at"), "values").withColumn("last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-shape[-1] // width) - 1).cast("long"))))
    parts = spread.select(F.concat(lead, F.array("last")).alias("shard"), "at", F.slice("values", (F.col("last") * width + 1).cast("int"), F.lit(width)).alias("part"))

    def save(group: pd.DataFrame) -> pd.DataFrame:
        coord = [int(x) for x in group["shard"].iloc[0]]
        block = np.full(shard, fill, t)
        for where, values in zip(group["at"], group["part"], strict=True):
            place = tuple(int(w) - c * s for w, c, s in zip(where, coord, shard, strict=False))
            block[place][: len(values)] = np.asarray(values).astype(t)
        body, entries, size = [], [], 0
        for slot in np.ndindex(*per):
            chunk = np.ascontiguousarray(block[tuple(slice(k * n, (k + 1) * n) for k, n in zip(slot, inner, strict=True))])
            if (chunk == np.array(fill, t)).all():
                entries.append(None)
                continue
            packed = codecs.encode(chunk.tobytes(), codec, t.itemsize)
            entries.append((size, len(packed)))
            body.append(packed)
            size += len(packed)
        if index_location == "start":
            head = 16 * len(entries) + 4
            entries = [e and (e[0] + head, e[1]) for e in entries]
        index = encode_index(entries)
        target = shard_file(path, coord)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{os.path.dirname(target)}/.{coord[-1]}.{uuid.uuid4().hex}"  # a task that runs twice replaces its file whole
        with open(part, "wb") as f:
            f.writelines([index, *body] if index_location == "start" else [*body, index])
        os.replace(part, target)
        return pd.DataFrame({"shards": [1]})

    parts.groupBy("shard").applyInPandas(save, "shards bigint").count()
    spark = rows.sparkSession
    arr = lambda v: F.array(*[F.lit(int(x)).cast("long") for x in v])
    doc = spark.range(1).select(metadata_json(arr(shape), arr(inner), arr(shard), F.lit(dtype), F.lit(codec), index_location, F.lit(json.dumps(fill)))).collect()[0][0]
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/zarr.json", "w", encoding="utf-8") as f:
        f.write(doc)
