"""Codecs, metadata, indexes and crops of the array store."""

import json
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridframe.config import BudgetExceeded, Config, DecodeError, Dtype, DtypeMismatch, InvalidArgument, Limits, NotFound, PoolStarved, RankMismatch, ShutdownError, StorageError
from gridframe.operators import reads
from gridframe.pipeline import Pipeline
from gridframe.sample import Sample
from gridframe.sources import arrays, codecs, zarr


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([1, 2, 4, 8]), st.integers(1, 700), st.booleans())
def test_blosc_round_trip(data, size, block, bits):
    data = data[: len(data) // size * size] or bytes(size)
    assert codecs.blosc_decode(codecs.blosc_encode(data * 3, size, block, bits)) == data * 3


def test_codec_errors():
    assert codecs.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(codecs.DecodeError):
        codecs.decode(b"abc", "none", 4)
    with pytest.raises(codecs.DecodeError):
        codecs.decode(b"abc", "zstd", 4)
    good = bytearray(codecs.blosc_encode(bytes(range(200)) * 20, 2))
    for at, value in ((3, 0), (2, 0), (16, 255)):
        broken = bytearray(good)
        broken[at] = value
        with pytest.raises(codecs.DecodeError):
            codecs.blosc_decode(bytes(broken))


def document(**changes):
    doc = {
        "zarr_format": 3, "node_type": "array", "shape": [4, 8], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 8]}}, "fill_value": 0,
        "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 4], "codecs": [{"name": "bytes"}, {"name": "zstd"}], "index_location": "end"}}],
    }
    return json.dumps(doc | changes)


def test_metadata_rules():
    assert zarr.parse_document(document())["codec"] == "zstd"
    plain = zarr.parse_document(document(codecs=[]))
    assert (plain["sharded"], plain["codec"], plain["inner"]) == (False, "none", [4, 8])
    assert np.isnan(zarr.parse_document(document(data_type="float32", fill_value="NaN"))["fill_f32"])
    for bad in ({"node_type": "group"}, {"shape": []}, {"data_type": "bool"}, {"fill_value": 1.5}, {"shape": [4]}, {"codecs": [{"name": "gzip"}]}, {"fill_value": 70000}):
        with pytest.raises((ValueError, KeyError, TypeError)):
            zarr.parse_document(document(**bad))


def test_index_rules():
    body = struct.pack("<4Q", 0, 5, zarr.EMPTY, zarr.EMPTY)
    data = body + struct.pack("<I", codecs.crc32c(body))
    assert zarr.decode_index(data, 2)[0].tolist() == [0, 5]
    half = struct.pack("<2Q", 0, zarr.EMPTY)
    for wrong, n in ((data[:-1], 2), (data, 1), (data[:-1] + b"x", 2), (half + struct.pack("<I", codecs.crc32c(half)), 1)):
        with pytest.raises(codecs.DecodeError):
            zarr.decode_index(wrong, n)


@pytest.fixture(scope="module", params=["none", "zstd", "blosc_zstd"])
def store(request, spark, tmp_path_factory):
    root = f"{tmp_path_factory.mktemp('store')}/a"
    full = (np.arange(20 * 12).reshape(20, 12) % 251).astype(np.uint16)
    full[8:12, :] = 0  # whole chunks of the fill
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(full)], "row bigint, values array<double>")
    zarr.write_array(rows, root, full.shape, (4, 4), (8, 8), "uint16", request.param)
    return root, full


def test_crops_equal_slices(spark, store):
    root, full = store
    boxes = [(0, 0), (3, 2), (8, 5), (15, 7), (11, 1)]
    with Pipeline(spark, Config((5, 5), 2)) as p:
        p.push(Sample(root, (slice(y, y + 5), (x, x + 5))) for y, x in boxes)
        batches = list(p.batches())
        assert [b.batch_id for b in batches] == [0, 1]  # the fifth sample is a ragged tail
        for b in batches:
            for k, data in enumerate(b.data):
                y, x = boxes[2 * b.batch_id + k]
                assert (data == full[y : y + 5, x : x + 5]).all()
        with pytest.raises(PoolStarved):
            p.pop()
        assert not p.pending


def test_errors_come_in_order(spark, store):
    root, _ = store
    for samples, error in (([Sample(root, ((0, 5), (0, 5))), Sample(root, ((18, 23), (0, 5))), Sample("/none", ((0, 5), (0, 5)))], InvalidArgument), ([Sample("/none", ((0, 5), (0, 5)))], NotFound)):
        p = Pipeline(spark, Config((5, 5), 1))
        p.push(samples)
        with pytest.raises(error):
            p.batches_df()
    assert p.batches_df("collect").count() == 0


def plain_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (codecs.CRC32C if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_checksums_by_halves(data):
    assert codecs.crc32c(data) == plain_crc32c(data)


def grid(spark, root, shape, inner, shard, dtype="uint16", codec="zstd", **options):
    """An array that counts from 1, so that nothing is the fill."""
    full = (1 + np.arange(int(np.prod(shape)))).reshape(shape).astype(dtype)
    rows = spark.createDataFrame([([*map(int, at)], [float(v) for v in full[at]]) for at in np.ndindex(*shape[:-1])], "at array<bigint>, values array<double>")
    zarr.write_array(rows, root, shape, inner, shard, dtype, codec, **options)
    return full


@pytest.mark.parametrize("where", ["start", "end"])
def test_rank_three(spark, tmp_path, where):
    root = f"file://{tmp_path}/a"
    full = grid(spark, root, (5, 6, 7), (2, 3, 4), (4, 3, 8), codec="blosc_zstd", index_location=where)
    with Pipeline(spark, Config((2, 3, 4), 1)) as p:
        p.push([Sample(root, ((y, y + 2), (1, 4), (x, x + 4))) for y in (0, 1, 3) for x in (0, 3)])
        for k, b in enumerate(p.batches()):
            y, x = (0, 0, 1, 1, 3, 3)[k], (0, 3)[k % 2]
            assert (b.data[0] == full[y : y + 2, 1:4, x : x + 4]).all()
    assert k == 5


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    """A row of 16 values in 4 chunks and 2 shards."""
    root = f"{tmp_path_factory.mktemp('shards')}/a"
    return root, grid(spark, root, (1, 16), (1, 4), (1, 8), codec="none")


def crop(root, x=0, n=4):
    return Sample(root, ((0, 1), (x, x + n)))


def test_a_broken_index_is_an_error_not_a_fill(spark, tmp_path):
    root = f"{tmp_path}/a"
    grid(spark, root, (1, 24), (1, 4), (1, 8))
    with open(f"{root}/c/0/0", "r+b") as f:
        f.seek(-1, 2)
        f.write(b"!")
    (tmp_path / "a/c/0/2").unlink()
    with Pipeline(spark, Config((1, 4), 1)) as p:
        p.push([crop(root, 8), crop(root, 16), crop(root, 0), crop(root, 8)])
        assert (p.pop().data > 0).all() and (p.pop().data == 0).all()  # a missing shard is a fill
        for _ in range(2):
            with pytest.raises(DecodeError):
                p.pop()
        with pytest.raises(ShutdownError):
            p.push([crop(root, 8)])
    p = Pipeline(spark, Config((1, 4), 1))
    p.push([crop(root, 8), crop(root, 0)])
    assert {r["sample_seq"]: r["status"] for r in p.statuses().collect()} == {0: "OK", 1: "DECODE"}
    with pytest.raises(DecodeError):
        p.batches_df()
    assert p.batches_df("collect").count() == 1


def test_a_shard_that_ends_early_and_a_broken_chunk(spark, tmp_path):
    for name, codec, change, error in (("cut", "none", lambda b, n: b[:n], StorageError), ("bad", "zstd", lambda b, n: b"?" * n + b[n:], DecodeError)):
        root = f"{tmp_path}/{name}"
        grid(spark, root, (1, 8), (1, 4), (1, 8), codec=codec, index_location="start")
        file = tmp_path / name / "c/0/0"
        head, body = file.read_bytes()[:36], file.read_bytes()[36:]
        file.write_bytes(head + change(body, 4))
        with Pipeline(spark, Config((1, 4), 1)) as p:
            p.push([crop(root)])
            with pytest.raises(error):
                p.pop()


def test_limits(spark, shards, tmp_path):
    root, _ = shards
    many = f"{tmp_path}/many"
    grid(spark, many, (32, 32), (8, 8), (8, 8))
    cases = [
        ({"max_chunk_uncompressed_bytes": 7}, crop(root), BudgetExceeded), ({"max_chunk_uncompressed_bytes": 8}, crop(root), None),
        ({"max_batch_chunks": 1}, crop(root), BudgetExceeded), ({"max_batch_chunks": 2}, crop(root), None),
    ]
    for limits, sample, error in cases:
        p = Pipeline(spark, Config((1, 4), 2, **limits))
        p.push([sample, sample])
        with pytest.raises(error) if error else p:
            p.pop()
    for cap, error in ((4, InvalidArgument), (8, InvalidArgument), (16, None)):  # 4 x 4 shards
        p = Pipeline(spark, Config((32, 32), 1, max_shards_per_sample=cap))
        p.push([Sample(many, ((0, 32), (0, 32)))])
        with pytest.raises(error) if error else p:
            p.pop()


def test_statuses_of_samples(spark, shards, tmp_path):
    root, _ = shards
    wide = f"{tmp_path}/wide"
    grid(spark, wide, (1, 4), (1, 4), (1, 4), dtype="int64", codec="none")
    for sample, error in ((Sample(root, ((0, 4),)), RankMismatch), (crop(wide), DtypeMismatch), (crop(root, 13), InvalidArgument), (crop(root, 0, 5), InvalidArgument), (crop("/no/such"), NotFound)):
        with Pipeline(spark, Config((1, 4), 1)) as p:
            p.push([sample])
            for _ in range(2):
                with pytest.raises(error):
                    p.pop()


def test_iterables_are_pulled_as_batches_are_popped(spark, shards):
    root, full = shards
    pulled = []

    def forever():
        k = 0
        while True:
            pulled.append(k)
            yield crop(root, k % 13)
            k += 1

    with Pipeline(spark, Config((1, 4), 2, lookahead_samples=5)) as p:
        p.push(forever())
        assert not pulled and p.pending
        seen = [(b.batch_id, b.data[:, 0, 0].tolist()) for b in p.batches(3)]
        assert seen == [(k, [float(full[0, 2 * k]), float(full[0, 2 * k + 1])]) for k in range(3)]
        assert p.pop().batch_id == 3 and len(pulled) < 15 and p.pending
    with pytest.raises(ShutdownError):
        p.pop()


def test_pushes_chain_and_tails_wait(spark, shards):
    root, _ = shards
    with Pipeline(spark, Config((1, 4), 2)) as p:
        p.push([crop(root)])
        with pytest.raises(PoolStarved):
            p.pop()
        p.push(crop(root) for _ in range(4))
        assert [b.batch_id for b in p.batches(2)] == [0, 1]
        assert list(p.batches()) == [] and not p.pending  # one sample is left, short of a batch
        with pytest.raises(ValueError):
            p.push(spark.range(1))


def test_frames_are_batches_too(spark, shards):
    root, full = shards
    frame = spark.createDataFrame([(k, root, [(0, 1), (k, k + 4)]) for k in range(5)], "sample_seq bigint, uri string, aabb array<struct<beg:bigint,end:bigint>>")
    with Pipeline(spark, Config((1, 4), 2)) as p:
        p.push(frame)
        p.push(frame, 5)
        assert p.samples().agg({"sample_seq": "max"}).collect()[0][0] == 9
        assert [b.data[0, 0, 0] for b in p.batches()] == [full[0, (2 * k) % 5] for k in range(5)]
        assert p.batches_df().count() == 10 and not p.pending


def test_batches_tell_what_they_are(spark, shards):
    root, _ = shards
    with Pipeline(spark, Config.default((1, 4), 1, "bf16")) as p:
        p.push([crop(root), crop(root)])
        with p.pop() as b:
            assert (b.info.shape, b.info.dtype, b.info.batch_id) == ((1, 1, 4), Dtype.BF16, 0)
            assert "Batch(batch_id=0" in repr(b) and np.from_dlpack(b).shape == (1, 1, 4)
        with pytest.raises(ShutdownError):
            b.data  # noqa: B018
        s = p.stats()
        assert (s.batches_emitted, s.chunks_planned, s.chunks_to_load, s.reads_issued) == (1, 1, 1, 1)
        assert s.read.count == 1 and s.read.output_bytes == 8 and s.pop_wait.ms > 0
        p.stats_reset()
        assert p.stats().batches_emitted == 0


def test_a_pop_that_takes_too_long(spark, shards):
    root, _ = shards
    with Pipeline(spark, Config((1, 4), 1, pop_timeout_s=0.001)) as p:
        p.push([crop(root)])
        with pytest.raises(PoolStarved):
            p.pop()
        assert p._late.result().batch_id == 0


@pytest.mark.parametrize("limits, n_reads", [(Limits(page_alignment=1), 1), (Limits(page_alignment=1, max_chunks_per_read=1), 2), (Limits(page_alignment=1, max_read_op_bytes=8), 2)])
def test_reads_that_are_planned_are_done(spark, shards, limits, n_reads):
    """Two chunks of eight bytes side by side in one shard; both shards hold two."""
    root, full = shards
    frame = spark.createDataFrame([(0, 0, 0, root, [(0, 1), (0, 16)])], "sample_seq bigint, batch_id bigint, sample_idx bigint, uri string, aabb array<struct<beg:bigint,end:bigint>>")
    row = zarr.read_crops(frame, [1, 16], limits=limits).collect()[0]
    assert row["data"] == full[0].tolist() and (row["n_loads"], row["n_reads"], row["bytes_read"]) == (4, 2 * n_reads, 32)
    loads = zarr.plan_crops(frame, [1, 16], limits).selectExpr("batch_id", "concat_ws('/', uri, shard_coord[1]) path", "slot", "offset", "nbytes")
    assert reads.fuse_capped(reads.align(loads, limits.page_alignment), limits.max_read_op_bytes, limits.max_chunks_per_read).count() == 2 * n_reads


def test_samples_share_reads(spark, shards):
    """400 samples over two shards of four chunks: a task reads a shard once, and not once for each sample."""
    root, full = shards
    frame = spark.range(400).selectExpr("id sample_seq", "id div 8 batch_id", "id % 8 sample_idx", f"'{root}' uri", "array(named_struct('beg', 0L, 'end', 1L), named_struct('beg', id % 13, 'end', id % 13 + 4)) aabb")
    rows = zarr.read_crops(frame, [1, 4]).collect()
    assert len(rows) == 400
    for r in rows:
        x = (r["batch_id"] * 8 + r["sample_idx"]) % 13
        assert r["data"] == full[0, x : x + 4].tolist() and r["n_loads"] == r["n_chunks"] == (x + 3) // 4 - x // 4 + 1
    assert 2 <= sum(r["n_reads"] for r in rows) <= 2 * 4  # as many partitions at most


def test_samples_of_several_arrays_and_faults(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    want = {a: grid(spark, a, (4, 16), (2, 4), (2, 8)).astype("float32"), b: grid(spark, b, (4, 16), (4, 2), (4, 4), dtype="int32", codec="blosc_zstd", fill=7).astype("float32")}
    with open(f"{a}/c/1/1", "r+b") as f:  # the chunk of rows 2 to 3, columns 8 to 11
        f.write(b"????")
    (tmp_path / "b/c/0/1").unlink()
    want[b][:, 4:8] = 7
    boxes = [(u, y, x) for y in range(3) for x in range(13) for u in (a, b, "/none")]
    frame = spark.createDataFrame([(k, k // 8, k % 8, u, [(y, y + 2), (x, x + 4)]) for k, (u, y, x) in enumerate(boxes)], "sample_seq bigint, batch_id bigint, sample_idx bigint, uri string, aabb array<struct<beg:bigint,end:bigint>>")
    got = {r["batch_id"] * 8 + r["sample_idx"]: r for r in zarr.read_crops(frame, [2, 4]).collect()}
    for k, (u, y, x) in enumerate(boxes):
        status = "NOTFOUND" if u == "/none" else "DECODE" if u == a and y > 0 and 4 < x < 12 else "OK"
        assert got[k]["status"] == status
        assert got[k]["data"] == (want[u][y : y + 2, x : x + 4].ravel().tolist() if status == "OK" else None)
    assert len(got) == len(boxes)


def test_slices_of_samples_are_bounded(monkeypatch):
    monkeypatch.setattr(zarr, "SLICE_BYTES", 4 * zarr.CHUNK_BYTES)
    rows = pa.RecordBatch.from_pydict({"chunks": [[0] * n for n in (1, 1, 1, 1, 9, 1, 1, 0, 0)]})
    slices = [s.column("chunks").value_lengths().to_pylist() for s in zarr._Crops((1, 4), "float32", Limits()).slices(rows)]
    assert sum(slices, []) == [1, 1, 1, 1, 9, 1, 1, 0, 0] and all(sum(s[1:]) <= 4 for s in slices)
    assert list(zarr._Crops((1, 4), "float32", Limits()).slices(rows.slice(0, 0))) == []


def test_arrays_to_sample_from(spark, tmp_path):
    for k, shape in enumerate([(4, 8), (3, 8), (9, 9), (4, 8, 2)]):
        rank = len(shape)
        doc = json.loads(document(shape=list(shape), chunk_grid={"name": "regular", "configuration": {"chunk_shape": [4] * rank}}))
        doc["codecs"][0]["configuration"]["chunk_shape"] = [2] * rank
        folder = tmp_path / f"plate/A/{k}/f/0"
        folder.mkdir(parents=True)
        (folder / "zarr.json").write_text(json.dumps(doc))
    (tmp_path / "plate/A/0/f/1").mkdir()
    uris = arrays.scan_plate(spark, str(tmp_path), "plate")
    assert sorted(r["uri"] for r in uris.collect()) == [f"plate/A/{k}/f/0" for k in range(4)]
    assert arrays.scan_plate(spark, str(tmp_path), "none").count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"dataset": {"store_root": str(tmp_path), "uris": [f"plate/A/{k}/f/0" for k in range(4)]}, "sampling": {}}, indent=1))
    listed = arrays.read_manifest(spark, str(tmp_path / "m.json"))
    table = arrays.array_table(zarr.scan_metadata(listed), (4, 8)).cache()
    assert sorted(r["uri"][-5] for r in table.collect()) == ["0", "2"]
    crops = arrays.random_crops(table, 200, (4, 8), seed=3).collect()
    assert sorted(r["sample_seq"] for r in crops) == list(range(200))
    begins = {(r["uri"][-5], *(a["beg"] for a in r["aabb"])) for r in crops}
    assert begins == {("0", 0, 0)} | {("2", y, x) for y in range(6) for x in range(2)}
    assert all(a["end"] - a["beg"] == n for r in crops for a, n in zip(r["aabb"], (4, 8), strict=True))
    assert crops == arrays.random_crops(table, 200, (4, 8), seed=3).collect() != arrays.random_crops(table, 200, (4, 8), seed=4).collect()
    assert arrays.random_crops(table.limit(0), 5, (4, 8)).count() == 0


def test_paths():
    assert zarr.local("file:///a/b") == zarr.local("file:/a/b") == zarr.local("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        zarr.local("s3://bucket/key")


def test_config_rules():
    for bad in ({"sample_shape": ()}, {"samples_per_batch": 0}, {"dtype": "f64"}, {"dtype": 7}, {"lookahead_samples": 1}, {"page_alignment": 0}, {"pop_timeout_s": 0}):
        with pytest.raises(ValueError):
            Config(**({"sample_shape": (2,), "samples_per_batch": 2} | bad))
    assert Config((2,), 2, "bfloat16").dtype is Dtype.coerce("BF16") is Dtype.coerce(1) and Config.default((2, 3), 4).lookahead_samples == 32
    assert "batch_bytes                   48" in Config((2, 3), 2).describe()
    for bad in (slice(0, 4, 2), slice(1, None)):
        with pytest.raises(ValueError):
            Sample("u", (bad,))
    with pytest.raises(TypeError):
        Sample("u", (5,))
    assert Sample("u", (slice(None, 4), [1, 3])).aabb == ((0, 4), (1, 3))
