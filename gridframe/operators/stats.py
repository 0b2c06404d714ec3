"""Measurements: histograms of latency, percentiles from them, stage metrics and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import grid as g


def histogram(latencies: DataFrame, buckets: int = 48) -> DataFrame:
    """(kind, bucket, n) for ``latencies(kind, ns)``, by powers of two."""
    return latencies.select("kind", g.log2_bucket(F.col("ns"), buckets).alias("bucket")).groupBy("kind", "bucket").agg(F.count("*").alias("n"))


def percentiles(latencies: DataFrame, quantiles: list[float], buckets: int = 48) -> DataFrame:
    """(kind, q, est): the middle, on a log scale, of the first bucket that reaches the quantile, at most the largest value.

    Windows and joins run over histograms, at most ``buckets`` rows of a kind.
    """
    h = histogram(latencies, buckets)
    top = latencies.groupBy("kind").agg(F.max("ns").alias("top"), F.count("*").alias("total"))
    cum = h.withColumn("cum", F.sum("n").over(Window.partitionBy("kind").orderBy("bucket")))
    asked = cum.join(top, "kind").withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles]))).where(F.col("cum") >= F.col("q") * F.col("total"))
    first = asked.groupBy("kind", "q").agg(F.min("bucket").alias("bucket"), F.first("top").alias("top"))
    middle = F.when(F.col("bucket") == 0, 0).otherwise(F.floor(F.pow(F.lit(2.0), F.col("bucket") + 0.5)))
    return first.select("kind", "q", F.least("top", middle).cast("long").alias("est"))


def metrics(measured: DataFrame) -> DataFrame:
    return measured.groupBy("kind").agg(F.sum("ns").alias("total_ns"), F.min("ns").alias("best_ns"), F.count("*").alias("n"))


def throughput(total: DataFrame) -> DataFrame:
    """Ratios of one row of totals (bytes, samples, chunks, batches, wall_ms, stage_ms), 0 where the divisor is."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return total.select(ratio("bytes", "samples").alias("bytes_per_sample"), (ratio("bytes", "wall_ms") * 1000).alias("bytes_per_s"), ratio("stage_ms", "wall_ms").alias("stage_concurrency"), ratio("chunks", "batches").alias("chunks_per_batch"))
