"""The test tables seen as arrays, shard indexes, samples and measurements, for Spark and as the same SQL for DuckDB.

Sizes come from the data. Every lens covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.operators.planning import running

#: The box that samples ask for, chunk and shard shapes of the embedding array, and samples to a batch.
BOX, INNER, SHARD, WIDTH, BATCH, URIS = (4, 5), (16, 16), (64, 32), 64, 8, 4
#: Documents planned together in the shard-index lens.
PLAN_DOCS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(*values: int):
    return F.array(*[F.lit(v).cast("long") for v in values])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_seq, uri, aabb over the embedding array: one box per order, spread by multiplication."""
    (h, w), emb = BOX, table(spark, sf_dir, "embeddings")
    return spark.sql(
        f"""SELECT o_orderkey AS sample_seq, concat('emb/', o_custkey % {URIS}) AS uri,
                   array(named_struct('beg', y, 'end', y + {h}), named_struct('beg', x, 'end', x + {w})) AS aabb
            FROM (SELECT o_orderkey, o_custkey, (o_orderkey * 7919) % ((SELECT count(*) FROM {{emb}}) - {h} + 1) AS y,
                         (o_orderkey * 104729) % ({WIDTH} - {w} + 1) AS x FROM {{orders}})""",
        emb=emb,
        orders=table(spark, sf_dir, "orders"),
    )


SAMPLES_SQL = f"""n AS (SELECT count(*) AS n FROM embeddings),
smp AS (SELECT o_orderkey AS seq, 'emb/' || (o_custkey % {URIS}) AS uri, (o_orderkey * 7919) % (n - {BOX[0]} + 1) AS y0,
               (o_orderkey * 104729) % ({WIDTH} - {BOX[1]} + 1) AS x0 FROM orders, n),
axes AS (SELECT seq, 0 AS axis, y0 AS beg, y0 + {BOX[0]} AS "end", {INNER[0]} AS inner_, {SHARD[0] // INNER[0]} AS ips FROM smp
         UNION ALL SELECT seq, 1, x0, x0 + {BOX[1]}, {INNER[1]}, {SHARD[1] // INNER[1]} FROM smp),
ranges AS (SELECT *, beg // inner_ AS cb, ("end" - 1) // inner_ + 1 AS ce FROM axes),
grid AS (SELECT y.seq, y.cb AS cy0, y.ce AS cy1, x.cb AS cx0, x.ce AS cx1, y.beg AS y0, y."end" AS y1, x.beg AS x0, x."end" AS x1
         FROM ranges y JOIN ranges x ON y.seq = x.seq AND y.axis = 0 AND x.axis = 1),
chunks AS (SELECT g.*, cy, cx FROM grid g, LATERAL (SELECT unnest(range(cy0, cy1)) AS cy), LATERAL (SELECT unnest(range(cx0, cx1)) AS cx))"""


def embedding_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the embedding array, under each of its uris."""
    return spark.sql(
        f"""SELECT concat('emb/', k) AS uri, 'float32' AS dtype, array((SELECT count(*) FROM {{emb}}), {WIDTH}L) AS shape,
                   array({INNER[0]}L, {INNER[1]}L) AS inner, array({SHARD[0]}L, {SHARD[1]}L) AS shard
            FROM (SELECT explode(sequence(0, {URIS - 1})) AS k)""",
        emb=table(spark, sf_dir, "embeddings"),
    )


def faulty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a fault by the remainder of their number by 16."""
    kind = F.col("sample_seq") % 16
    a, b = F.element_at("aabb", 1), F.element_at("aabb", 2)
    moved = lambda d, e: F.array(F.struct((a["beg"] + d).alias("beg"), (a["end"] + e).alias("end")), b)
    aabb = (
        F.when(kind == 1, F.array(a))
        .when(kind == 2, moved(F.lit(0), F.lit(1)))
        .when(kind == 3, moved(-1 - a["beg"], -1 - a["beg"]))
        .when(kind == 4, moved(F.lit(1 << 40), F.lit(1 << 40)))
        .otherwise(F.col("aabb"))
    )
    uri = F.when(kind == 5, "none").when(kind == 6, "wide").otherwise(F.col("uri"))
    return samples(spark, sf_dir).withColumn("aabb", aabb).withColumn("uri", uri)


def faulty_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding array's metadata and an array of 64-bit integers of the same shape."""
    meta = embedding_meta(spark, sf_dir)
    return meta.unionByName(meta.where("uri = 'emb/0'").withColumns({"uri": F.lit("wide"), "dtype": F.lit("int64")}))


FAULTS_SQL = "CASE o_orderkey % 16 WHEN 1 THEN 'RANK' WHEN 2 THEN 'INVAL' WHEN 3 THEN 'INVAL' WHEN 4 THEN 'INVAL' WHEN 5 THEN 'NOTFOUND' WHEN 6 THEN 'DTYPE' ELSE 'OK' END"


def shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one file per source: batch_id, path, slot, offset, nbytes, is_empty.

    A slot is the document's place in its source; a gap of 8192 bytes follows every document that 7 divides.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.col("n_chars").alias("nbytes"))
    gap = F.when(F.col("doc_id") % 7 == 0, 8192).otherwise(0)
    summed = running(docs, ["path"], "doc_id", 1 << 14, {"slot": F.lit(1), "offset": F.col("nbytes") + gap})
    return summed.select(F.expr(f"doc_id div {PLAN_DOCS}").alias("batch_id"), "path", "slot", "offset", "nbytes", (F.col("doc_id") % 11 == 0).alias("is_empty"))


MISSING_SHARDS = ("src3", "src17")


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that are read: not empty, and of a file that is there."""
    return shard_index(spark, sf_dir).where(~F.col("is_empty") & ~F.col("path").isin(*MISSING_SHARDS))


INDEX_SQL = f"""idx AS (SELECT doc_id // {PLAN_DOCS} AS batch_id, source AS path, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS slot,
    CAST(coalesce(sum(n_chars + CASE WHEN doc_id % 7 = 0 THEN 8192 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    n_chars AS nbytes, doc_id % 11 = 0 AS is_empty FROM documents),
lds AS (SELECT * FROM idx WHERE NOT is_empty AND path NOT IN {MISSING_SHARDS}),
win AS (SELECT *, ("offset" // 4096) * 4096 AS wo, (("offset" + nbytes + 4095) // 4096) * 4096 - ("offset" // 4096) * 4096 AS wn FROM lds)"""
