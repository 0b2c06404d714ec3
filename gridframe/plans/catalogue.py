"""The catalogue: every operator as a query over the test tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.config import Config
from gridframe.functions import documents as D
from gridframe.functions import grid as g
from gridframe.operators import assembly, planning, reads, results, stats
from gridframe.pipeline import Pipeline
from gridframe.plans import lenses as L
from gridframe.sources import arrays, codecs, zarr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PAGE_CAP, CHUNK_CAP = 65536, 8
#: Chunks that a batch may have in the query of the cap, so that some batches pass it.
BATCH_CAP = 16


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_samples(body: str) -> str:
    return f"WITH {L.SAMPLES_SQL} {body}"


def with_index(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {L.INDEX_SQL}{more} {body}"


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.sample_ranges(L.samples(spark, sf_dir).join(L.embedding_meta(spark, sf_dir), "uri"))


def _box(k: int, end: str):
    return F.element_at("aabb", k)[end]


# ---- crops ----------------------------------------------------------------------------------------------------------


@query(
    with_samples(
        f"""SELECT seq // {L.BATCH} AS batch_id, seq % {L.BATCH} AS sample_idx, y, x, e.embedding[x0 + x + 1] AS value
        FROM smp, range({L.BOX[0]}) AS a(y), range({L.BOX[1]}) AS b(x), embeddings e WHERE e.vec_id = y0 + y
        AND seq // {L.BATCH} < (SELECT count(*) FROM smp) // {L.BATCH}"""
    )
)
def crop_batches_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: samples, chunks, cells, clip, batches."""
    rows = L.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").alias("values"))
    return assembly.crop_rows(planning.sample_chunks(_sealed(spark, sf_dir), 2), rows)


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.seal_batches(_ranged(spark, sf_dir), L.BATCH, L.table(spark, sf_dir, "orders").count())


@query(with_samples("SELECT seq, axis, cb AS chunk_beg, ce AS chunk_end FROM ranges"))
def chunk_range(spark, sf_dir):
    rows = planning.per_axis(_ranged(spark, sf_dir), F.col("chunks").alias("c"))
    return rows.select(F.col("sample_seq").alias("seq"), "axis", F.col("a.c.beg").alias("chunk_beg"), F.col("a.c.end").alias("chunk_end"))


@query(with_samples("SELECT seq, axis, cb // ips AS shard_beg, (ce - 1) // ips + 1 AS shard_end FROM ranges"))
def shard_range(spark, sf_dir):
    rows = planning.per_axis(_ranged(spark, sf_dir), F.col("shards").alias("c"))
    return rows.select(F.col("sample_seq").alias("seq"), "axis", F.col("a.c.beg").alias("shard_beg"), F.col("a.c.end").alias("shard_end"))


@query(
    with_samples(
        """SELECT seq, sy AS shard_y, sx AS shard_x, CAST((sy - cy0 // 4) * ((cx1 - 1) // 2 + 1 - cx0 // 2) + sx - cx0 // 2 AS INTEGER) AS ordinal
        FROM grid, LATERAL (SELECT unnest(range(cy0 // 4, (cy1 - 1) // 4 + 1)) AS sy), LATERAL (SELECT unnest(range(cx0 // 2, (cx1 - 1) // 2 + 1)) AS sx)"""
    )
)
def sample_shards(spark, sf_dir):
    c = F.col("shard_coord")
    return planning.sample_shards(_ranged(spark, sf_dir), 2).select(F.col("sample_seq").alias("seq"), c[0].alias("shard_y"), c[1].alias("shard_x"), "ordinal")


@query(with_samples("SELECT seq, cy // 4 AS shard_y, cx // 2 AS shard_x, cy AS chunk_y, cx AS chunk_x, (cy % 4) * 2 + cx % 2 AS slot, cy - cy0 AS d_y, cx - cx0 AS d_x FROM chunks"))
def sample_chunks(spark, sf_dir):
    rows = planning.sample_chunks(_ranged(spark, sf_dir), 2)
    pairs = {"shard": "shard_coord", "chunk": "chunk_coord", "d": "chunk_d"}
    return rows.select(F.col("sample_seq").alias("seq"), "slot", *[F.col(c)[k].alias(f"{n}_{a}") for n, c in pairs.items() for k, a in enumerate("yx")])


@query(
    with_samples(
        f"""SELECT seq, axis, inner_ AS chunk_shape, ce - cb AS grid_extent, beg - cb * inner_ AS lo_relative, "end" - beg AS extent,
        CASE axis WHEN 0 THEN {L.INNER[1]} ELSE 1 END AS src_stride, CASE axis WHEN 0 THEN {L.BOX[1]} ELSE 1 END AS dst_stride FROM ranges"""
    )
)
def sample_plan_dims(spark, sf_dir):
    rows = planning.per_axis(
        _ranged(spark, sf_dir), F.col("chunks").alias("c"), F.col("inner").alias("s"), F.col("aabb").alias("b"),
        g.strides(F.col("inner")).alias("src"), g.strides(g.extents(F.col("aabb"))).alias("dst"),
    )
    return rows.select(
        F.col("sample_seq").alias("seq"), "axis", F.col("a.s").cast("int").alias("chunk_shape"), F.expr("a.c.end - a.c.beg").alias("grid_extent"),
        F.expr("a.b.beg - a.c.beg * a.s").alias("lo_relative"), F.expr("a.b.end - a.b.beg").alias("extent"), F.col("a.src").cast("int").alias("src_stride"), F.col("a.dst").cast("int").alias("dst_stride"),
    )


@query(with_samples("SELECT seq, cy AS chunk_y, cx AS chunk_x, greatest(y0, cy * 16) AS lo_y, least(y1, cy * 16 + 16) AS hi_y, greatest(x0, cx * 16) AS lo_x, least(x1, cx * 16 + 16) AS hi_x, (least(y1, cy * 16 + 16) - greatest(y0, cy * 16)) * (least(x1, cx * 16 + 16) - greatest(x0, cx * 16)) AS elements FROM chunks"))
def chunk_box_clip(spark, sf_dir):
    rows = planning.sample_chunks(_ranged(spark, sf_dir), 2).withColumn("clip", g.clip(F.col("aabb"), F.col("chunk_coord"), F.col("inner")))
    c, k = F.col("clip"), F.col("chunk_coord")
    return rows.select(
        F.col("sample_seq").alias("seq"), k[0].alias("chunk_y"), k[1].alias("chunk_x"), c[0]["beg"].alias("lo_y"), c[0]["end"].alias("hi_y"),
        c[1]["beg"].alias("lo_x"), c[1]["end"].alias("hi_x"), g.product(g.extents(c)).alias("elements"),
    )


@query(with_samples(f"SELECT seq // {L.BATCH} AS batch_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM smp WHERE seq // {L.BATCH} < (SELECT count(*) FROM smp) // {L.BATCH} GROUP BY 1"))
def batch_seal_drop_last(spark, sf_dir):
    s = L.samples(spark, sf_dir)
    sealed = planning.seal_batches(s, L.BATCH, L.table(spark, sf_dir, "orders").count())
    return sealed.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("sample_seq").alias("first_seq"), F.max("sample_seq").alias("last_seq"))


@query(
    with_samples(
        f"""SELECT c.seq, CASE WHEN n > {BATCH_CAP} THEN 'BUDGET' ELSE 'OK' END AS status
        FROM (SELECT seq, count(*) AS own FROM chunks WHERE seq // {L.BATCH} < (SELECT count(*) FROM smp) // {L.BATCH} GROUP BY 1) c
        JOIN (SELECT seq // {L.BATCH} AS batch_id, count(*) AS n FROM chunks GROUP BY 1) b ON c.seq // {L.BATCH} = batch_id"""
    )
)
def batch_chunk_cap(spark, sf_dir):
    ranged = _sealed(spark, sf_dir).withColumn("status", F.lit("OK"))
    return planning.over_batch_cap(ranged, BATCH_CAP).select(F.col("sample_seq").alias("seq"), "status")


@query(
    with_samples(
        """SELECT seq, CASE WHEN ((cy1 - 1) // 4 + 1 - cy0 // 4) * ((cx1 - 1) // 2 + 1 - cx0 // 2) > 1 THEN 'INVAL' ELSE 'OK' END AS status FROM grid"""
    )
)
def max_shards_guard(spark, sf_dir):
    """Samples that touch more than one shard, where one is allowed."""
    ranged = _ranged(spark, sf_dir).withColumn("status", F.lit("OK"))
    return planning.enforce_limits(ranged, 1, 1 << 20).select(F.col("sample_seq").alias("seq"), "status")


@query(with_samples("SELECT DISTINCT uri, cy // 4 AS shard_y, cx // 2 AS shard_x FROM chunks JOIN smp USING (seq)"))
def distinct_keys(spark, sf_dir):
    c = F.col("shard_coord")
    return planning.sample_shards(_ranged(spark, sf_dir), 2).select("uri", c[0].alias("shard_y"), c[1].alias("shard_x")).distinct()


@query(with_samples("SELECT seq, '[' || y0 || ',' || (y0 + 4) || ')x[' || x0 || ',' || (x0 + 5) || ')' AS box, uri || '/c/' || (y0 // 64) || '/' || (x0 // 32) AS path FROM smp"))
def box_text_and_path(spark, sf_dir):
    r = _ranged(spark, sf_dir)
    return r.select(F.col("sample_seq").alias("seq"), g.box_text(F.col("aabb")).alias("box"), g.shard_path(F.col("uri"), g.begins(F.col("shards"))).alias("path"))


@query(with_samples("SELECT seq // 8 AS batch_id, seq % 8 AS sample_idx, y, x, CAST(0 AS FLOAT) AS value FROM smp, range(4) AS a(y), range(5) AS b(x) WHERE seq // 8 < (SELECT count(*) FROM smp) // 8"))
def bypass_decode_fill(spark, sf_dir):
    """All chunks taken as fills: the same shapes without reading any cell."""
    chunks = planning.sample_chunks(_sealed(spark, sf_dir), 2)
    return assembly.fill_cells(chunks, F.lit(0.0).cast("float")).select("batch_id", "sample_idx", "y", "x", "value")


# ---- sparse and rank-1 arrays ---------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT count(*) AS n FROM orders), smp AS (SELECT o_orderkey AS seq, (o_orderkey * 7919) % (n - 4 + 1) AS o0, (o_orderkey * 104729) % (7 - 3 + 1) AS l0 FROM orders, n),
    cells AS (SELECT l_orderkey AS o, l_linenumber - 1 AS l, max(CAST(l_quantity AS INTEGER)) AS v FROM lineitem GROUP BY 1, 2)
    SELECT seq, y, x, CAST(coalesce(v, 0) AS FLOAT) AS value FROM smp CROSS JOIN range(4) AS a(y) CROSS JOIN range(3) AS b(x) LEFT JOIN cells ON o = o0 + y AND l = l0 + x"""
)
def assemble_lin_fill(spark, sf_dir):
    """A sparse array of order by line: absent cells, chunks and shards are fills."""
    orders = L.table(spark, sf_dir, "orders")
    cells = L.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("y"), (F.col("l_linenumber") - 1).cast("long").alias("x")).agg(F.max(F.col("l_quantity").cast("int")).cast("float").alias("value"))
    samples = spark.sql(
        "SELECT o_orderkey AS sample_seq, array(named_struct('beg', y, 'end', y + 4), named_struct('beg', x, 'end', x + 3)) AS aabb, array(100L, 4L) AS inner, array(400L, 8L) AS shard "
        "FROM (SELECT o_orderkey, (o_orderkey * 7919) % ((SELECT count(*) FROM {orders}) - 3) AS y, (o_orderkey * 104729) % 5 AS x FROM {orders})",
        orders=orders,
    )
    chunks = planning.sample_chunks(planning.sample_ranges(samples), 2)
    return assembly.sparse_cells(chunks, cells, 0.0).select(F.col("sample_seq").alias("seq"), "y", "x", "value")


@query(
    """WITH n AS (SELECT count(*) AS n FROM events), smp AS (SELECT o_orderkey AS seq, (o_orderkey * 7919) % (n - 6 + 1) AS e0 FROM orders, n)
    SELECT seq, x, CAST(CAST(round(value * 100) AS INTEGER) AS FLOAT) AS value FROM smp CROSS JOIN range(6) AS a(x) JOIN events ON event_id = e0 + x"""
)
def assemble_evt_rank1(spark, sf_dir):
    events = L.table(spark, sf_dir, "events")
    cells = events.select(F.col("event_id").alias("x"), F.round(F.col("value") * 100).cast("int").cast("float").alias("value"))
    samples = spark.sql(
        "SELECT o_orderkey AS sample_seq, array(named_struct('beg', x, 'end', x + 6)) AS aabb, array(256L) AS inner, array(1024L) AS shard FROM (SELECT o_orderkey, (o_orderkey * 7919) % ((SELECT count(*) FROM {events}) - 5) AS x FROM {orders})",
        orders=L.table(spark, sf_dir, "orders"), events=events,
    )
    return assembly.rank1_cells(planning.sample_chunks(planning.sample_ranges(samples), 1), cells).select(F.col("sample_seq").alias("seq"), "x", "value")


@query(
    """WITH v AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * 977 + event_id AS v FROM events), u AS (SELECT event_id, v, CAST(CAST(v AS FLOAT) AS BIGINT) AS f FROM v),
    s AS (SELECT *, CAST(greatest(1, 2 ** (length(bin(greatest(abs(f), 1))) - 8)) AS BIGINT) AS unit FROM u), q AS (SELECT *, abs(f) // unit AS q, abs(f) % unit AS r FROM s)
    SELECT event_id, v, CAST(sign(f) * unit * CASE WHEN 2 * r > unit OR (2 * r = unit AND q % 2 = 1) THEN q + 1 ELSE q END AS FLOAT) AS bf16 FROM q"""
)
def cast_bf16_int(spark, sf_dir):
    v = (F.round(F.col("value") * 100).cast("long") * 977 + F.col("event_id")).alias("v")
    return L.table(spark, sf_dir, "events").select("event_id", v).select("event_id", "v", g.bfloat16(F.col("v")).alias("bf16"))


# ---- metadata -------------------------------------------------------------------------------------------------------

DTYPES, CODECS = list(g.DTYPE_BYTES), ["zstd", "blosc_zstd", "none"]
_NATION = f"""m AS (SELECT k, n_name, [1 + k % 3, 2 + k % 4, 4] AS inner_, [1 + k % 2, 2, 1 + k % 3] AS f, {DTYPES}[k % {len(DTYPES)} + 1] AS dtype,
    {list(g.DTYPE_BYTES.values())}[k % {len(DTYPES)} + 1] AS bpe, {CODECS}[k % 3 + 1] AS codec FROM (SELECT *, CAST(n_nationkey AS BIGINT) AS k FROM nation))"""


def _geometry(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    rows = L.table(spark, sf_dir, "nation").select(
        k.alias("k"), F.array(1 + k % 3, 2 + k % 4, F.lit(4).cast("long")).alias("inner"), F.array(1 + k % 2, F.lit(2).cast("long"), 1 + k % 3).alias("f"),
        g.cycle(DTYPES, k).alias("dtype"), g.cycle(CODECS, k).alias("codec"),
    )
    return rows.withColumn("shard", F.zip_with("inner", "f", lambda a, b: a * b)).withColumn("shape", F.transform("shard", lambda s: s * 2))


@query(f"WITH {_NATION} SELECT k, f[1] AS ips_0, f[2] AS ips_1, f[3] AS ips_2, f[1] * f[2] * f[3] AS total, CAST(bpe * inner_[1] * inner_[2] * inner_[3] AS BIGINT) AS chunk_bytes FROM m")
def inner_per_shard(spark, sf_dir):
    ips = g.inner_per_shard(F.col("shard"), F.col("inner"))
    return _geometry(spark, sf_dir).select("k", *[ips[i].alias(f"ips_{i}") for i in range(3)], g.product(ips).alias("total"), g.chunk_bytes(F.col("dtype"), F.col("inner")).alias("chunk_bytes"))


def _documents(spark, sf_dir):
    """Metadata documents made from the table."""
    return _geometry(spark, sf_dir).select(F.concat(F.lit("a/"), F.col("k").cast("string")).alias("uri"), zarr.metadata_json(F.col("shape"), F.col("inner"), F.col("shard"), F.col("dtype"), F.col("codec"), F.when(F.col("k") % 2 == 0, "end").otherwise("start"), (F.col("k") % 7).cast("string")).alias("json"))


@query(
    f"""WITH {_NATION} SELECT 'a/' || k AS uri, dtype, 3 AS rank, 2 * inner_[1] * f[1] AS shape_0, inner_[2] AS inner_1, inner_[3] * f[3] AS shard_2, true AS sharded, codec,
    k % 2 = 0 AS index_at_end, CAST(k % 7 AS FLOAT) AS fill_f32, 'OK' AS status FROM m"""
)
def array_meta_parse(spark, sf_dir):
    """Metadata documents made from the table, then parsed."""
    m = zarr.parse_metadata(_documents(spark, sf_dir))
    return m.select("uri", "dtype", "rank", F.col("shape")[0].alias("shape_0"), F.col("inner")[1].alias("inner_1"), F.col("shard")[2].alias("shard_2"), "sharded", "codec", "index_at_end", "fill_f32", "status")


@query("SELECT * FROM (VALUES ('uint8', '7', CAST(7 AS FLOAT), 'OK'), ('int16', '-1', CAST(-1 AS FLOAT), 'OK'), ('float32', '\"NaN\"', CAST('NaN' AS FLOAT), 'OK'), ('float64', '\"-Infinity\"', CAST('-Infinity' AS FLOAT), 'OK'), ('float16', '0.1', CAST(0.0999755859375 AS FLOAT), 'OK'), ('uint8', '-1', NULL, 'DECODE'), ('uint8', '256', NULL, 'DECODE'), ('int32', '1.5', NULL, 'DECODE'), ('float32', '\"x\"', NULL, 'DECODE')) AS t(dtype, fill, fill_f32, status)")
def fill_value_decode(spark, sf_dir):
    cases = [("uint8", "7"), ("int16", "-1"), ("float32", '"NaN"'), ("float64", '"-Infinity"'), ("float16", "0.1"), ("uint8", "-1"), ("uint8", "256"), ("int32", "1.5"), ("float32", '"x"')]
    rows = spark.createDataFrame(cases, "dtype string, fill string")
    one = F.array(F.lit(1).cast("long"))
    docs = rows.select(F.concat_ws(" ", "dtype", "fill").alias("uri"), zarr.metadata_json(one, one, one, F.col("dtype"), F.lit("none"), F.lit("end"), F.col("fill")).alias("json"))
    return zarr.parse_metadata(docs).select(F.split("uri", " ")[0].alias("dtype"), F.split("uri", " ")[1].alias("fill"), "fill_f32", "status")


@query(f"WITH {_NATION} SELECT k, dtype, dtype IN {g.CASTABLE} AS ok FROM m")
def castable_dtypes(spark, sf_dir):
    return _geometry(spark, sf_dir).select("k", "dtype", g.castable(F.col("dtype")).alias("ok"))


@query(f"WITH {_NATION} SELECT k, CASE WHEN bpe * inner_[1] * inner_[2] * inner_[3] > 64 THEN 'BUDGET' ELSE 'OK' END AS status FROM m")
def chunk_cap(spark, sf_dir):
    """Decoded chunks of more bytes than allowed."""
    one = F.array_repeat(F.struct(F.lit(0).cast("long").alias("beg"), F.lit(1).cast("long").alias("end")), 3)
    ranged = _geometry(spark, sf_dir).withColumns({"status": F.lit("OK"), "shards": one})
    return planning.enforce_limits(ranged, 1, 64).select("k", "status")


@query(f"WITH {_NATION} SELECT 'a/' || k AS uri, 2 * inner_[1] * f[1] AS shape_0, 2 * inner_[3] * f[3] AS shape_2 FROM m WHERE 2 * inner_[1] * f[1] >= 4 AND 2 * inner_[2] * f[2] >= 10 AND 2 * inner_[3] * f[3] >= 9")
def array_table(spark, sf_dir):
    """Arrays that boxes of 4 x 10 x 9 fit into."""
    found = arrays.array_table(zarr.parse_metadata(_documents(spark, sf_dir)), (4, 10, 9))
    return found.select("uri", F.col("shape")[0].alias("shape_0"), F.col("shape")[2].alias("shape_2"))


@query("SELECT 'plate/' || n_regionkey || '/' || n_nationkey || '/' || (n_nationkey % 2) || '/0' AS uri FROM nation")
def plate_manifest(spark, sf_dir):
    """A plate laid out as folders, with other levels beside the one that is looked for, then scanned."""
    root, n = zarr.scratch_store(spark), L.table(spark, sf_dir, "nation")
    uri = F.concat_ws("/", F.lit("plate"), "n_regionkey", "n_nationkey", F.col("n_nationkey") % 2, "level")
    docs = n.withColumn("level", F.explode(F.array(F.lit("0"), F.lit("1")))).select(uri.alias("uri"), F.lit("{}").alias("json"))
    arrays.touch_arrays(docs, root).count()
    return arrays.scan_plate(spark, root, "plate")


@query(
    """WITH n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT o_orderkey AS seq, CAST('0x' || substr(md5('7:0:' || o_orderkey), 1, 15) AS BIGINT) AS a,
        CAST('0x' || substr(md5('7:1:' || o_orderkey), 1, 15) AS BIGINT) AS b FROM orders)
    SELECT seq, a % (n - 4 + 1) AS beg_y, b % (64 - 5 + 1) AS beg_x FROM r, n WHERE seq < (SELECT count(*) FROM orders)"""
)
def seeded_crops(spark, sf_dir):
    """As many crops as there are orders, drawn from the embedding array."""
    one = L.embedding_meta(spark, sf_dir).where("uri = 'emb/0'").withColumn("status", F.lit("OK"))
    crops = arrays.random_crops(arrays.array_table(one, L.BOX), L.table(spark, sf_dir, "orders").count(), L.BOX, seed=7)
    return crops.select(F.col("sample_seq").alias("seq"), _box(1, "beg").alias("beg_y"), _box(2, "beg").alias("beg_x"))


@query(f"WITH {_NATION} SELECT k, codec, dtype FROM m")
def codec_cycle(spark, sf_dir):
    return _geometry(spark, sf_dir).select("k", "codec", "dtype")


# ---- errors ---------------------------------------------------------------------------------------------------------


def _validated(spark, sf_dir):
    return planning.validate_samples(L.faulty_samples(spark, sf_dir), L.faulty_meta(spark, sf_dir), list(L.BOX))


@query(f"SELECT o_orderkey AS seq, {L.FAULTS_SQL} AS status FROM orders")
def push_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select(F.col("sample_seq").alias("seq"), "status")


@query(f"WITH s AS (SELECT o_orderkey AS seq, {L.FAULTS_SQL} AS status FROM orders) SELECT min(seq) AS n_good, arg_min(status, seq) AS status FROM s WHERE status <> 'OK'")
def first_error_prefix(spark, sf_dir):
    return planning.first_error(_validated(spark, sf_dir))


@query(f"SELECT {L.FAULTS_SQL} AS status, count(*) AS n FROM orders GROUP BY 1")
def status_reduce(spark, sf_dir):
    return _validated(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT min(o_orderkey) AS prefix_length FROM orders WHERE o_orderkey % 1000 = 777")
def ready_prefix(spark, sf_dir):
    """Samples that are there, with gaps."""
    return planning.ready_prefix(L.samples(spark, sf_dir).where("sample_seq % 1000 <> 777"))


# ---- shard index and reads ------------------------------------------------------------------------------------------


INDEX_SLOTS = 512


@query(with_index(f"""SELECT path || '#' || (slot // {INDEX_SLOTS}) AS shard, slot % {INDEX_SLOTS} AS slot, CASE WHEN is_empty THEN NULL ELSE "offset" END AS "offset", CASE WHEN is_empty THEN NULL ELSE nbytes END AS nbytes, 'OK' AS status FROM idx"""))
def shard_index_layout(spark, sf_dir):
    """Indexes of up to 512 slots, encoded to bytes and decoded again."""
    shard = F.concat_ws("#", "path", g.div(F.col("slot"), INDEX_SLOTS))
    entry = F.struct("slot", F.when(~F.col("is_empty"), F.struct("offset", "nbytes")).alias("entry"))
    files = L.shard_index(spark, sf_dir).groupBy(shard.alias("key")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias("entries"))
    decoded = zarr.index_rows(zarr.index_bytes(files))
    slots = decoded.select(F.col("key").alias("shard"), F.posexplode("entries").alias("slot", "entry"), F.col("index_status").alias("status"))
    return slots.select("shard", F.col("slot").cast("long"), "entry.offset", "entry.nbytes", "status")


def _damage(shards: DataFrame, root: str, how: str) -> DataFrame:
    """Removes the files of ``shards(shard_coord)`` below ``root``, or flips their last byte, in the index's checksum."""

    @F.pandas_udf("boolean")
    def one(coords: pd.Series) -> pd.Series:
        for coord in coords:
            path = zarr.shard_file(root, coord)
            if not os.path.exists(path):
                continue
            if how == "remove":
                os.remove(path)
            else:
                with open(path, "r+b") as f:
                    f.seek(-1, os.SEEK_END)
                    last = f.read(1)[0]
                    f.seek(-1, os.SEEK_END)
                    f.write(bytes([last ^ 255]))
        return coords.map(lambda _: True)

    return shards.select(one("shard_coord").alias("done")).where("done")


@query(
    with_samples(
        """SELECT seq, CASE WHEN bool_or(((cy // 4) * 2 + cx // 2) % 3 = 1) THEN 'DECODE' ELSE 'OK' END AS status
        FROM chunks WHERE seq // 8 < (SELECT count(*) FROM smp) // 8 GROUP BY 1"""
    )
)
def broken_shards(spark, sf_dir):
    """Statuses of samples over a store in which the index of every third shard has a wrong checksum and every other third shard is missing."""
    root = f"{_store(spark, sf_dir)}/emb"
    samples = L.samples(spark, sf_dir).withColumn("uri", F.lit(root))
    shards = spark.range(-(-L.table(spark, sf_dir, "embeddings").count() // L.SHARD[0]) * 2).select(F.array(g.div(F.col("id"), 2), F.col("id") % 2).alias("shard_coord"))
    place = F.col("shard_coord")[0] * 2 + F.col("shard_coord")[1]
    _damage(shards.where(place % 3 == 1), root, "flip").count()
    _damage(shards.where(place % 3 == 2), root, "remove").count()
    pipeline = Pipeline(spark, Config(L.BOX, L.BATCH))
    pipeline.push(samples, L.table(spark, sf_dir, "orders").count())
    return pipeline.statuses().select(F.col("sample_seq").alias("seq"), "status")


def _planned(spark, sf_dir):
    """Each slot of each file as a chunk, joined to the index, from which whole files are missing."""
    index = L.shard_index(spark, sf_dir)
    there = index.where(~F.col("path").isin(*L.MISSING_SHARDS))
    return planning.load_or_fill(index.select("path", "slot"), there.drop("batch_id"), ["path", "slot"])


@query(with_index(f"SELECT path AS source, count(*) FILTER (NOT is_empty AND path NOT IN {L.MISSING_SHARDS}) AS n_load, count(*) FILTER (is_empty OR path IN {L.MISSING_SHARDS}) AS n_fill FROM idx GROUP BY 1"))
def shard_join_fill(spark, sf_dir):
    return _planned(spark, sf_dir).groupBy(F.col("path").alias("source")).agg(F.count_if(~F.col("is_fill")).alias("n_load"), F.count_if("is_fill").alias("n_fill"))


@query(with_index(f"SELECT DISTINCT path AS source FROM idx WHERE path IN {L.MISSING_SHARDS}"))
def missing_shard_anti(spark, sf_dir):
    index = L.shard_index(spark, sf_dir)
    there = index.where(~F.col("path").isin(*L.MISSING_SHARDS)).select("path").distinct()
    return index.select("path").distinct().join(there, "path", "left_anti").select(F.col("path").alias("source"))


def _windows(spark, sf_dir):
    return reads.align(L.loads(spark, sf_dir))


def _fused(spark, sf_dir):
    return reads.fuse_capped(_windows(spark, sf_dir), PAGE_CAP, CHUNK_CAP)


@query(with_index('SELECT path, slot, wo AS win_offset, wn AS win_nbytes, "offset" - wo AS offset_in_read FROM win'))
def page_align(spark, sf_dir):
    return _windows(spark, sf_dir).select("path", "slot", "win_offset", "win_nbytes", "offset_in_read")


@query(with_index("SELECT batch_id, path, slot, row_number() OVER (PARTITION BY batch_id ORDER BY path, wo, slot) - 1 AS read_rank FROM win"))
def read_sort(spark, sf_dir):
    return reads.sort_rank(_windows(spark, sf_dir)).select("batch_id", "path", "slot", "read_rank")


@query(
    with_index(
        "SELECT batch_id, path, min(wo) AS file_offset, max(wo + wn) - min(wo) AS nbytes, count(*) AS n_chunks FROM g GROUP BY batch_id, path, island",
        """, o AS (SELECT *, max(wo + wn) OVER (PARTITION BY batch_id, path ORDER BY wo, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM win),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR wo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id, path ORDER BY wo, slot) AS island FROM o)""",
    )
)
def fuse_uncapped(spark, sf_dir):
    return reads.fuse_touching(_windows(spark, sf_dir))


_FUSE = f""", num AS (SELECT *, row_number() OVER (PARTITION BY batch_id, path ORDER BY wo, slot) AS rn FROM win),
walk AS (SELECT batch_id, path, slot, "offset", rn, 0 AS read_no, wo AS lo, wo + wn AS hi, 1 AS cnt FROM num WHERE rn = 1
  UNION ALL SELECT n.batch_id, n.path, n.slot, n."offset", n.rn, CASE WHEN ok THEN w.read_no ELSE w.read_no + 1 END, CASE WHEN ok THEN w.lo ELSE n.wo END,
    CASE WHEN ok THEN greatest(w.hi, n.wo + n.wn) ELSE n.wo + n.wn END, CASE WHEN ok THEN w.cnt + 1 ELSE 1 END
  FROM walk w JOIN num n ON n.batch_id = w.batch_id AND n.path = w.path AND n.rn = w.rn + 1,
    LATERAL (SELECT n.wo <= w.hi AND w.cnt < {CHUNK_CAP} AND greatest(w.hi, n.wo + n.wn) - w.lo <= {PAGE_CAP} AS ok)),
fused AS (SELECT batch_id, path, CAST(read_no AS BIGINT) AS read_no, min(lo) AS file_offset, max(hi) - min(lo) AS nbytes, count(*) AS n_chunks FROM walk GROUP BY batch_id, path, read_no),
ordered AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY read_no, path) - 1 AS read_op_idx FROM fused),
member AS (SELECT o.batch_id, o.read_op_idx, o.nbytes, w.slot, w.path, n.nbytes AS dec FROM ordered o JOIN walk w USING (batch_id, path, read_no) JOIN num n USING (batch_id, path, slot)),
grp AS (SELECT batch_id, read_op_idx, min(nbytes) AS nbytes, count(*) AS n_chunks, CAST(sum(4 * dec) AS BIGINT) AS total FROM member GROUP BY 1, 2)"""


@query(with_index("SELECT batch_id, path, read_no, file_offset, nbytes, n_chunks FROM fused", _FUSE))
def fuse_capped(spark, sf_dir):
    return _fused(spark, sf_dir).select("batch_id", "path", "read_no", "file_offset", "nbytes", F.size("slots").cast("long").alias("n_chunks"))


@query(with_index('SELECT w.batch_id, w.path, w.slot, f.read_no, w."offset" - f.file_offset AS offset_in_read FROM walk w JOIN fused f USING (batch_id, path, read_no)', _FUSE))
def fuse_offsets(spark, sf_dir):
    return reads.chunk_reads(_windows(spark, sf_dir), _fused(spark, sf_dir)).select("batch_id", "path", "slot", "read_no", "offset_in_read")


@query(with_index("SELECT batch_id, read_op_idx, path, file_offset FROM ordered", _FUSE))
def interleave_reads(spark, sf_dir):
    return reads.interleave(_fused(spark, sf_dir)).select("batch_id", "read_op_idx", "path", "file_offset")


@query(with_index("SELECT (SELECT count(*) FROM idx) AS planned, (SELECT count(*) FROM lds) AS to_load, (SELECT count(*) FROM fused) AS loads_issued", _FUSE))
def load_counters(spark, sf_dir):
    planned = _planned(spark, sf_dir).agg(F.count("*").alias("planned"), F.count_if(~F.col("is_fill")).alias("to_load"))
    issued = _fused(spark, sf_dir).agg(F.count("*").alias("loads_issued"))
    one = F.lit(1).alias("k")
    return planned.select("*", one).join(issued.select("*", one), "k").drop("k")  # one row each


def _groups(spark, sf_dir):
    decompressed = L.loads(spark, sf_dir).select("batch_id", "path", "slot", (F.col("nbytes") * 4).alias("decompressed"))
    return reads.group_chunks(reads.interleave(_fused(spark, sf_dir)), decompressed)


@query(with_index("SELECT batch_id, read_op_idx, CAST(coalesce(sum(n_chunks) OVER (PARTITION BY batch_id ORDER BY read_op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_chunk, n_chunks, total AS total_decompressed FROM grp", _FUSE))
def group_by_read(spark, sf_dir):
    return _groups(spark, sf_dir).select("batch_id", "read_op_idx", "first_chunk", "n_chunks", "total_decompressed")


@query("""WITH d AS (SELECT doc_id, 512 + octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, b AS block, least(512, n - b * 512) AS nbytes FROM d, LATERAL (SELECT unnest(range(CAST((n + 511) // 512 AS BIGINT))) AS b)""")
def blosc_blocks(spark, sf_dir):
    """Blocks of compressed chunks as their headers tell them; the last one may be short. A chunk has a text's size and one block more."""
    docs = L.table(spark, sf_dir, "documents").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sizes = [own for _, own in codecs.blosc_blocks(codecs.blosc_encode(bytes(512 + n), 1, 512))]
                rows = {"doc_id": [doc] * len(sizes), "block": list(range(len(sizes))), "nbytes": sizes}
                yield pa.RecordBatch.from_pydict(rows, pa.schema([(k, pa.int64()) for k in rows]))

    return docs.select("doc_id", F.octet_length("text").alias("n")).mapInArrow(run, "doc_id long, block long, nbytes long")


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) // 4 AS n FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, list_aggregate(list_transform(range(4 * n), lambda j: substr(h, CAST(((j % 4) * n + j // 4) * 2 + 1 AS BIGINT), 2)), 'string_agg', '') AS head, substr(h, 8 * n + 1) AS tail FROM d)
    SELECT doc_id, sha256(unhex(coalesce(head, '') || tail)) AS plain_sha256 FROM u""")
def byte_unshuffle(spark, sf_dir):
    """Whole texts' bytes as elements of four bytes: byte b of element e comes from b * n + e."""
    unshuffled = F.pandas_udf(lambda texts: texts.map(lambda t: codecs.unshuffle(t.encode(), 4)), "binary")
    docs = L.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(unshuffled("text"), 256).alias("plain_sha256"))


# ---- measurements and the rest --------------------------------------------------------------------------------------


_LAT = "lat AS (SELECT event_type AS kind, CAST(round(value * 1000000) AS BIGINT) AS ns FROM events), bkt AS (SELECT kind, CAST(least(47, length(bin(greatest(ns, 1))) - 1) AS INTEGER) AS bucket, ns FROM lat)"


def _latencies(spark, sf_dir):
    return L.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.round(F.col("value") * 1000000).cast("long").alias("ns"))


@query(f"WITH {_LAT} SELECT kind, bucket, count(*) AS n FROM bkt GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    return stats.histogram(_latencies(spark, sf_dir))


@query(
    f"""WITH {_LAT}, h AS (SELECT kind, bucket, count(*) AS n FROM bkt GROUP BY 1, 2), mx AS (SELECT kind, max(ns) AS top, count(*) AS total FROM lat GROUP BY 1),
    c AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS cum FROM h), q AS (SELECT unnest([0.5, 0.9, 0.99]) AS q),
    f AS (SELECT kind, q, min(bucket) AS bucket FROM c JOIN mx USING (kind), q WHERE cum >= q * total GROUP BY 1, 2)
    SELECT kind, CAST(q AS DOUBLE) AS q, CAST(least(top, CASE WHEN bucket = 0 THEN 0 ELSE floor(2 ** (bucket + 0.5)) END) AS BIGINT) AS est FROM f JOIN mx USING (kind)"""
)
def latency_percentiles(spark, sf_dir):
    return stats.percentiles(_latencies(spark, sf_dir), [0.5, 0.9, 0.99])


@query(f"WITH {_LAT} SELECT kind, CAST(sum(ns) AS BIGINT) AS total_ns, min(ns) AS best_ns, count(*) AS n FROM lat GROUP BY 1")
def stage_metrics(spark, sf_dir):
    return stats.metrics(_latencies(spark, sf_dir))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": (-?[0-9]+)', 1) AS BIGINT) AS k FROM events WHERE CAST(regexp_extract(props, '\"k\": (-?[0-9]+)', 1) AS BIGINT) >= 50")
def json_query(spark, sf_dir):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return L.table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id * 3 END AS value, CASE event_id % 4 WHEN 3 THEN 'TYPE' ELSE 'OK' END AS status,
    CAST(event_id % 4 AS BIGINT) AS place, CASE WHEN event_id % 2 = 0 THEN 'NOT_FOUND' ELSE 'RANGE' END AS large FROM events""")
def json_steps(spark, sf_dir):
    """Documents made from the table, in which the element with a certain name is looked for, and numbers beyond 64 bits."""
    event = F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 4 < 3, (F.col("event_id") * 3).cast("string")).otherwise(F.concat(F.lit('"'), event, F.lit('"')))
    large = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(',"big":1'), F.repeat(F.lit("0"), F.lit(25)))).otherwise("")
    text = F.concat(F.lit('{"list":[{"name":"other","v":0},{"name":"it","v":'), value, F.lit("}],"), F.lit('"at":['), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (k * 1).cast("string")), ","), F.lit("]"), large, F.lit("}"))
    doc = L.table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("doc"))
    found = D.as_whole(D.resolve(F.col("doc"), D.Key("list"), D.Each(), D.Where((D.Key("name"),), "it"), D.Key("v")))
    place = D.as_whole(D.resolve(F.get(F.array(*[D.resolve(F.col("doc"), D.Key("at"), D.Index(k)) for k in range(4)]), (F.col("event_id") % 4).cast("int"))))
    return doc.select("event_id", found["value"].alias("value"), found["status"].alias("status"), place["value"].alias("place"), D.as_whole(D.resolve(F.col("doc"), D.Key("big")))["status"].alias("large"))


@query("""WITH r AS (SELECT event_type AS scenario, CAST(count(*) AS DOUBLE) AS n, CAST(max(event_id) AS DOUBLE) AS top, count(*) % 3 AS calls FROM events GROUP BY 1),
    m AS (SELECT 'a/' || scenario AS p, * FROM r UNION ALL SELECT scenario AS p, * FROM r)
    SELECT p || '/wall' AS name, 'ms' AS unit, top AS value, 'smaller' AS better FROM m
    UNION ALL SELECT p || '/io.ms_avg', 'ms', n / 2, 'smaller' FROM m UNION ALL SELECT p || '/assemble.ms_avg', 'ms', top / calls, 'smaller' FROM m WHERE calls > 0
    UNION ALL SELECT p || '/throughput', 'MB/s', n, 'bigger' FROM m""")
def merged_metrics(spark, sf_dir):
    """A run for each kind of event, on a runner with a name and on one without, as one table of metrics."""
    events = L.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("scenario")).agg(F.count("*").cast("double").alias("n"), F.max("event_id").cast("double").alias("top"))
    stage = lambda name, ms, count: F.struct(F.lit(name).alias("name"), ms.alias("ms"), count.cast("long").alias("count"))
    stages = F.array(stage("io", F.col("n"), F.lit(2)), stage("assemble", F.col("top"), F.col("n") % 3), stage("untracked", F.col("n"), F.lit(1)))
    runs = events.select("scenario", F.create_map(F.lit("wall"), F.col("top"), F.lit("other"), F.col("n")).alias("timings_ms"), stages.alias("stages"), F.col("n").alias("throughput_mb_s"))
    return results.merged([results.metric_rows(runs.withColumn("runner", F.lit(r))) for r in ("a", " ")])


@query(with_samples("SELECT seq // 2 + CASE WHEN seq % 2 = 1 THEN (SELECT count(*) FROM smp WHERE seq % 2 = 0) ELSE 0 END AS seq, uri, y0 AS beg_y FROM smp"))
def union_pushes(spark, sf_dir):
    """Two pushes, each numbered for itself; the pipeline's numbers go on."""
    pipeline, s = Pipeline(spark, Config(L.BOX, L.BATCH)), L.samples(spark, sf_dir)
    for k in (0, 1):
        pipeline.push(s.where(F.col("sample_seq") % 2 == k).withColumn("sample_seq", g.div(F.col("sample_seq"), 2)))
    return pipeline.samples().select(F.col("sample_seq").alias("seq"), "uri", _box(1, "beg").alias("beg_y"))


@query(with_samples("SELECT seq, y0 AS beg_y, x0 AS beg_x, y0 >= 0 AND y0 + 4 <= n AND x0 >= 0 AND x0 + 5 <= 64 AS inside FROM smp, n"))
def random_crops(spark, sf_dir):
    """Crops spread over the array, all inside."""
    return _ranged(spark, sf_dir).select(F.col("sample_seq").alias("seq"), _box(1, "beg").alias("beg_y"), _box(2, "beg").alias("beg_x"), g.inside(F.col("aabb"), F.col("shape")).alias("inside"))


def _store(spark, sf_dir):
    """The embedding array as a sharded store; a new one each time."""
    root, emb = zarr.scratch_store(spark), L.table(spark, sf_dir, "embeddings")
    rows = emb.select(F.col("vec_id").alias("row"), F.col("embedding").alias("values"))
    zarr.write_array(rows, f"{root}/emb", (emb.count(), L.WIDTH), L.INNER, L.SHARD, "float32", "blosc_zstd")
    return root


@query(ORACLE_SQL["crop_batches_emb"])
def zarr_roundtrip(spark, sf_dir):
    """The flagship by the physical path: the array is written as a sharded store and crops are read from its bytes."""
    samples = L.samples(spark, sf_dir).withColumn("uri", F.lit(f"{_store(spark, sf_dir)}/emb"))
    sealed = planning.seal_batches(samples, L.BATCH, L.table(spark, sf_dir, "orders").count())
    blocks = zarr.read_crops(sealed, list(L.BOX)).where("status = 'OK'")
    return assembly.block_cells(blocks, list(L.BOX)).select("batch_id", "sample_idx", "y", "x", "value")
