"""Planner operators on hand-made inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridframe.functions import documents as D
from gridframe.functions import grid as g
from gridframe.operators import planning, reads, stats
from gridframe.sources.codecs import to_bfloat16

P = 4096


def windows(spark, loads):
    frame = spark.createDataFrame([(0, path, slot, offset, n) for path, slot, offset, n in loads], "batch_id bigint, path string, slot bigint, offset bigint, nbytes bigint")
    return reads.align(frame, P)


def fused(spark, loads, max_bytes=1 << 22, max_chunks=512):
    out = reads.interleave(reads.fuse_capped(windows(spark, loads), max_bytes, max_chunks)).orderBy("read_op_idx").collect()
    return [(r["path"], r["file_offset"], r["nbytes"], r["slots"]) for r in out]


def test_page_straddle(spark):
    loads = [("a", k, o, 32) for k, o in enumerate((4090, 4146, 8392, 16378))]
    assert fused(spark, loads) == [("a", 0, 20480, [0, 1, 2, 3])]
    w = windows(spark, loads)
    chunks = reads.chunk_reads(w, reads.fuse_capped(w)).orderBy("slot").collect()
    assert [c["offset_in_read"] for c in chunks] == [4090, 4146, 8392, 16378]


def test_gap_blocks_and_order(spark):
    assert [x[1:3] for x in fused(spark, [("a", k, o * P, 32) for k, o in enumerate((0, 4, 5, 8))])] == [(0, P), (4 * P, 2 * P), (8 * P, P)]
    assert fused(spark, [("a", k, o * P, 32) for k, o in enumerate((0, 2, 1, 3))]) == [("a", 0, 4 * P, [0, 2, 1, 3])]


def test_caps(spark):
    six = [("a", k, k * P, P) for k in range(6)]
    assert [x[3] for x in fused(spark, six, max_bytes=2 * P)] == [[0, 1], [2, 3], [4, 5]]
    assert [len(x[3]) for x in fused(spark, [("a", k, k * P, P) for k in range(517)], max_bytes=1 << 30)] == [512, 5]
    assert fused(spark, [("a", 0, 0, 10 * P)], max_bytes=P) == [("a", 0, 10 * P, [0])]


def test_interleave(spark):
    loads = [("A", 0, 0, P), ("A", 1, 4096, P), ("A", 2, 16384, P), ("B", 3, 0, P), ("B", 4, 8192, P)]
    assert [x[:3] for x in fused(spark, loads)] == [("A", 0, 8192), ("B", 0, 4096), ("A", 16384, 4096), ("B", 8192, 4096)]


def fold(loads, max_bytes, max_chunks):
    """The rule, read by read."""
    out = []
    for o, slot, n in sorted((x // P * P, slot, -(-(x + n) // P) * P - x // P * P) for slot, x, n in loads):
        if out and o <= out[-1][0] + out[-1][1] and len(out[-1][2]) < max_chunks and max(o + n, sum(out[-1][:2])) - out[-1][0] <= max_bytes:
            out[-1] = (out[-1][0], max(o + n, sum(out[-1][:2])) - out[-1][0], [*out[-1][2], slot])
        else:
            out.append((o, n, [slot]))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40000), st.integers(1, 9000)), min_size=1, max_size=25), st.integers(1, 5), st.integers(1, 6))
def test_fuse_matches_a_plain_loop(spark, loads, pages, chunks):
    got = fused(spark, [("a", k, o, n) for k, (o, n) in enumerate(loads)], pages * P, chunks)
    assert [x[1:] for x in got] == fold([(k, o, n) for k, (o, n) in enumerate(loads)], pages * P, chunks)


def test_single_chunk_geometry(spark):
    row = spark.sql("SELECT 0L AS sample_seq, array(named_struct('beg', 2L, 'end', 4L), named_struct('beg', 0L, 'end', 4L)) AS aabb, array(2L, 4L) AS inner, array(4L, 8L) AS shard")
    chunk = planning.sample_chunks(planning.sample_ranges(row), 2).collect()
    assert [(c["chunk_coord"], c["shard_coord"], c["slot"], c["chunk_d"]) for c in chunk] == [([1, 0], [0, 0], 2, [0, 0])]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.integers(1, 6)), min_size=1, max_size=4))
def test_chunks_cover_the_box_once(spark, axes):
    box = [{"beg": b, "end": b + n} for b, n, _ in axes]
    row = spark.createDataFrame([(0, box, [s for *_, s in axes], [2 * s for *_, s in axes])], "sample_seq bigint, aabb array<struct<beg:bigint,end:bigint>>, inner array<bigint>, shard array<bigint>")
    clipped = planning.sample_chunks(planning.sample_ranges(row), len(axes)).select(g.product(g.extents(g.clip(F.col("aabb"), F.col("chunk_coord"), F.col("inner")))).alias("n"))
    assert clipped.agg(F.sum("n")).collect()[0][0] == int(np.prod([n for _, n, _ in axes]))


def test_arithmetic_on_a_known_rank(spark):
    """The compiled forms give what the general ones give."""
    row = spark.sql("SELECT array(named_struct('beg', 5L, 'end', 9L), named_struct('beg', 0L, 'end', 4L), named_struct('beg', 7L, 'end', 8L)) AS box, array(2L, 4L, 3L) AS inner, array(9L, 4L, 8L) AS shape")
    box, inner, shape = F.col("box"), F.col("inner"), F.col("shape")
    forms = lambda r: [g.product(inner, r), g.row_major(inner, shape, r), g.chunk_range(box, inner, r), g.extents(box, r), g.inside(box, shape, r), g.inside(box, inner, r)]
    assert list(row.select(*forms(3)).collect()[0]) == list(row.select(*forms(None)).collect()[0])
    places = spark.range(24).select("id", *g.unravel(F.col("id"), [2, 3, 4])).collect()
    assert [tuple(p[1:]) for p in places] == [(k // 12, k // 4 % 3, k % 4) for k in range(24)]


def test_ready_prefix(spark):
    for seqs, want in (([0, 1, 2, 4], 3), ([1, 2], 0), ([], 0), ([0], 1), ([0, 0, 1], 2)):
        assert planning.ready_prefix(spark.createDataFrame([(s,) for s in seqs], "sample_seq bigint")).collect()[0][0] == want


def test_bfloat16_of_whole_numbers(spark):
    values = [0, 1, -1, 255, 256, 257, 258, 259, 65535, 16777217, -2147483647, 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(g.bfloat16(F.col("v"))).collect()]
    assert got == to_bfloat16(np.array(values, np.float64).astype(np.float32)).tolist()


def test_ratios_guard_zero(spark):
    row = spark.sql("SELECT 10 AS bytes, 0 AS samples, 4 AS chunks, 2 AS batches, 5 AS wall_ms, 10 AS stage_ms")
    assert stats.throughput(row).collect()[0].asDict() == {"bytes_per_sample": 0.0, "bytes_per_s": 2000.0, "stage_concurrency": 2.0, "chunks_per_batch": 2.0}


@pytest.mark.parametrize("block", [1, 3, 100])
def test_running_sums_by_blocks(spark, block):
    rows = [("a", k, k % 5) for k in range(20)] + [("b", 7, 1)]
    frame = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r["k"], r["o"]): r["s"] for r in planning.running(frame, ["k"], "o", block, {"s": F.col("v")}).collect()}
    assert got == {("a", k): sum(j % 5 for j in range(k)) for k in range(20)} | {("b", 7): 0}


def test_steps_into_documents(spark):
    text = '{"a":[{"n":"x","v":1},{"n":"y","v":2.5,"t":true},{"n":1,"v":"2"}],"b c":{"it\'s":9223372036854775808},"e":[]}'
    doc = F.parse_json(F.lit(text))
    one = spark.range(1)
    whole = lambda *steps: tuple(one.select(D.as_whole(D.resolve(doc, *steps)).alias("r")).collect()[0]["r"])
    each = (D.Key("a"), D.Each())
    assert whole(D.Key("a"), D.Index(0), D.Key("v")) == (1, "OK")
    assert whole(*each, D.Where((D.Key("n"),), "y"), D.Key("v")) == (None, "RANGE")
    assert whole(*each, D.Where((D.Key("n"),), 1), D.Key("v")) == (None, "TYPE")
    assert whole(D.Key("b c"), D.Key("it's")) == (None, "RANGE")
    assert whole(D.Key("a"), D.Index(7)) == whole(D.Key("e"), D.Each()) == whole(D.Key("a"), D.Key("v")) == (None, "NOT_FOUND")
    row = one.select(D.as_number(D.resolve(doc, D.Key("a"), D.Index(1), D.Key("v"))).alias("x"), D.as_truth(D.resolve(doc, *each, D.Where((D.Key("t"),), True), D.Key("t"))).alias("t"), F.size(D.results(doc, *each, D.Key("v"))).alias("n")).collect()[0]
    assert (row["x"]["value"], row["t"]["value"], row["n"]) == (2.5, True, 3)
