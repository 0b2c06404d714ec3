"""Results of measured runs as rows of metrics, to be charted over time, and several such tables as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is reported of a run, by name.
TIMINGS = ("init", "time_to_first_batch", "wall")
STAGES = ("io", "input_transfer", "decompress", "assemble", "decompress.parse")


def metric_rows(runs: DataFrame) -> DataFrame:
    """(name, unit, value, better) for ``runs(runner, scenario, timings_ms map, stages array of (name, ms, count), throughput_mb_s)``.

    Names are runner/scenario/metric, without a blank runner. Timings and stages that are not there, and stages that
    never ran, give no row.
    """
    prefix = F.concat_ws("/", F.nullif(F.trim("runner"), F.lit("")), "scenario")
    timings = F.filter(F.map_entries("timings_ms"), lambda e: e["key"].isin(*TIMINGS))
    stages = F.filter("stages", lambda s: s["name"].isin(*STAGES) & (s["count"] > 0))

    def rows(name, unit: str, value, better: str):  # noqa: ANN001, ANN202
        return F.struct(name.alias("name"), F.lit(unit).alias("unit"), value.cast("double").alias("value"), F.lit(better).alias("better"))

    found = F.concat(
        F.transform(timings, lambda e: rows(e["key"], "ms", e["value"], "smaller")),
        F.transform(stages, lambda s: rows(F.concat(s["name"], F.lit(".ms_avg")), "ms", s["ms"] / s["count"], "smaller")),
        F.filter(F.array(rows(F.lit("throughput"), "MB/s", F.col("throughput_mb_s"), "bigger")), lambda m: m["value"].isNotNull()),
    )
    each = runs.select(prefix.alias("prefix"), F.explode(found).alias("m"))
    return each.select(F.concat_ws("/", "prefix", "m.name").alias("name"), "m.unit", "m.value", "m.better")


def merged(tables: list[DataFrame]) -> DataFrame:
    """One table of metrics from several, rows kept as they are."""
    return reduce(DataFrame.unionByName, tables)
