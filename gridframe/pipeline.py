"""The front door: push samples, get batches as arrays or as a DataFrame.

DataFrames that are pushed stay distributed: ``plan``, ``statuses`` and ``batches_df`` are lazy plans over all of them.
Iterables are pulled a window at a time, so they may be endless; a window is planned and read by Spark as one job.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain, islice
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridframe.config import BY_STATUS, Config, Dtype, PoolStarved, ShutdownError
from gridframe.operators import planning
from gridframe.sample import Box, samples_df
from gridframe.sources import zarr


@dataclass(frozen=True)
class BatchInfo:
    shape: tuple[int, ...]
    dtype: Dtype
    batch_id: int


class Batch:
    """A dense batch of shape (samples, *sample_shape). The array hands itself on by DLPack; leaving the block lets it go.

    NumPy has no bfloat16: such batches are float32 arrays of values that bfloat16 holds exactly.
    """

    def __init__(self, batch_id: int, data: np.ndarray, dtype: Dtype):
        self._data: np.ndarray | None = data
        self.info = BatchInfo(data.shape, dtype, batch_id)

    @property
    def batch_id(self) -> int:
        return self.info.batch_id

    @property
    def data(self) -> np.ndarray:
        if self._data is None:
            raise ShutdownError("the batch is released")
        return self._data

    def release(self) -> None:
        self._data = None

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def __dlpack__(self, **options: Any) -> Any:
        return self.data.__dlpack__(**options)

    def __dlpack_device__(self) -> tuple[int, int]:
        return self.data.__dlpack_device__()

    def __repr__(self) -> str:
        state = "released" if self._data is None else "ready"
        return f"Batch(batch_id={self.batch_id}, shape={self.info.shape}, dtype={self.info.dtype.name}, {state})"


@dataclass(frozen=True)
class Metric:
    """Calls, their time together and the best one, and bytes in and out."""

    name: str
    count: int = 0
    ms: float = 0.0
    best_ms: float = 0.0
    input_bytes: int = 0
    output_bytes: int = 0

    def add(self, ms: float, input_bytes: int = 0, output_bytes: int = 0) -> Metric:
        best = ms if not self.count else min(self.best_ms, ms)
        return Metric(self.name, self.count + 1, self.ms + ms, best, self.input_bytes + input_bytes, self.output_bytes + output_bytes)


@dataclass(frozen=True)
class Stats:
    """What a pipeline has done: reads of samples in tasks, waits of pops, and counts."""

    read: Metric = Metric("read")
    pop_wait: Metric = Metric("pop_wait")
    batches_emitted: int = 0
    chunks_planned: int = 0
    chunks_to_load: int = 0
    reads_issued: int = 0


class Pipeline:
    """Samples in, batches out, in order of pushing.

    A bad sample raises its error when its batch is popped. That ends the pipeline: later pops raise the same error.
    """

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self._closed = False
        self._failed: Exception | None = None
        self._sources: deque[Iterator[Box] | DataFrame] = deque()
        self._frames: list[DataFrame] = []  # all that was pushed as DataFrames, numbered
        self._framed = 0
        self._kind: bool | None = None  # whether DataFrames are pushed
        self._waiting: list[Box] = []  # pulled, but short of a batch
        self._next = 0  # the number of the first sample that no job has taken
        self._rows: Iterator[Row] | None = None
        self._open: list[Row] = []  # of the batch that is coming
        self._stats, self._emitted = Stats(), 0
        self._worker = ThreadPoolExecutor(1)
        self._late: Future | None = None

    def __enter__(self) -> Pipeline:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _check_open(self) -> None:
        if self._closed:
            raise ShutdownError("the pipeline is closed")

    def push(self, samples: Iterable[Box] | DataFrame, count: int | None = None) -> None:
        """An iterable, also an endless one, or a DataFrame (sample_seq dense from 0, uri, aabb) of ``count`` rows.

        Numbers go on where the last push ended. Nothing is pulled from an iterable before batches are popped. Pushes
        of one pipeline are either iterables or DataFrames.
        """
        self._check_open()
        if self._failed:
            raise ShutdownError("the pipeline has failed")
        framed = isinstance(samples, DataFrame)
        if self._kind is not None and framed != self._kind:
            raise ValueError("a pipeline takes iterables or DataFrames, not both")
        self._kind = framed
        if not framed:
            self._sources.append(iter(samples))
            return
        self._frames.append(samples.withColumn("sample_seq", F.col("sample_seq") + self._framed))
        self._framed += samples.count() if count is None else count
        self._rows = None

    @property
    def pending(self) -> bool:
        """Whether samples that were pushed may still become part of a batch, as far as is known without pulling more."""
        size = self.config.samples_per_batch
        if self._frames:
            return self._framed // size > self._emitted
        return bool(self._sources) or len(self._waiting) >= size or self._emitted * size < self._next

    # ---- DataFrames

    def samples(self) -> DataFrame:
        """All samples that were pushed as DataFrames, and those pulled from finite iterables so far as none was popped."""
        if self._frames:
            return reduce(DataFrame.unionByName, self._frames)
        if self._next or self._rows is not None:
            raise ValueError("samples of an iterable are gone once batches are popped")
        while self._sources:
            self._waiting += self._sources.popleft()
        return samples_df(self.spark, self._waiting)

    def _sealed(self) -> DataFrame:
        samples = self.samples()
        return planning.seal_batches(samples, self.config.samples_per_batch, self._framed if self._frames else len(self._waiting))

    def plan(self) -> DataFrame:
        """Chunk plans of whole batches: loads and fills with their geometry, and each sample's or chunk's status."""
        return zarr.plan_crops(self._sealed(), list(self.config.sample_shape), self.config.limits)

    def statuses(self) -> DataFrame:
        """(sample_seq, status) of the samples of whole batches, without reading chunks."""
        return zarr.sample_statuses(self.plan())

    def batches_df(self, on_error: str = "fail") -> DataFrame:
        """(batch_id, sample_idx, data). ``on_error``: fail raises the first bad sample's error; collect leaves bad samples out."""
        if on_error == "fail":
            bad = self.statuses().where("status <> 'OK'").orderBy("sample_seq").limit(1).collect()
            if bad:
                raise BY_STATUS[bad[0]["status"]](f"sample {bad[0]['sample_seq']}: {bad[0]['status']}")
        crops = self._crops(self._sealed())
        if on_error == "fail":  # what only reading finds out
            data = F.when(F.col("status") == "OK", F.col("data")).otherwise(F.raise_error(F.concat(F.lit("a sample failed: "), F.col("status"))))
            return crops.select("batch_id", "sample_idx", data.alias("data"))
        return crops.where("status = 'OK'").select("batch_id", "sample_idx", "data")

    def _crops(self, sealed: DataFrame) -> DataFrame:
        return zarr.read_crops(sealed, list(self.config.sample_shape), self.config.dtype.numpy_name, self.config.limits)

    # ---- batches

    def _window(self) -> Iterator[Row] | None:
        """Rows of the next window's crops, in order; none if no whole batch is left."""
        size = self.config.samples_per_batch
        if self._frames:
            if self._next:
                return None
            self._next = self._framed
            sealed = self._sealed()
        else:
            want = self.config.lookahead_samples // size * size
            while self._sources and len(self._waiting) < want:
                self._waiting += islice(self._sources[0], want - len(self._waiting))
                source = self._sources.popleft()
                if (ahead := next(source, None)) is not None:
                    self._sources.appendleft(chain([ahead], source))
            whole = len(self._waiting) // size * size
            if not whole:
                return None
            window, self._waiting = self._waiting[:whole], self._waiting[whole:]
            rows = samples_df(self.spark, window, self._next)
            self._next += whole
            sealed = planning.seal_batches(rows, size, self._next)
        return self._crops(sealed).orderBy("batch_id", "sample_idx").toLocalIterator(prefetchPartitions=True)

    def _pull(self) -> Batch:
        size = self.config.samples_per_batch
        while len(self._open) < size:
            if self._rows is None:
                self._rows = self._window()
                if self._rows is None:
                    raise PoolStarved("no whole batch is left")
            row = next(self._rows, None)
            if row is None:
                self._rows = None
                continue
            if row["status"] != "OK":
                raise BY_STATUS[row["status"]](f"sample {row['batch_id'] * size + row['sample_idx']}: {row['status']}")
            self._count(row)
            self._open.append(row)
        own, self._open = self._open, []
        data = np.stack([np.array(r["data"], np.float32).reshape(self.config.sample_shape) for r in own])
        return Batch(own[0]["batch_id"], data, self.config.dtype)

    def _count(self, row: Row) -> None:
        s = self._stats
        self._stats = replace(
            s,
            read=s.read.add(row["read_ns"] / 1e6, row["bytes_read"], len(row["data"]) * self.config.dtype.bytes),
            chunks_planned=s.chunks_planned + row["n_chunks"],
            chunks_to_load=s.chunks_to_load + row["n_loads"],
            reads_issued=s.reads_issued + row["n_reads"],
        )

    def pop(self) -> Batch:
        """The next batch. PoolStarved: none is left, or none came within the time; then a later pop may get it."""
        self._check_open()
        if self._failed:
            raise self._failed
        start = time.monotonic()
        self._late = self._late or self._worker.submit(self._pull)
        try:
            batch = self._late.result(self.config.pop_timeout_s)
        except FutureTimeout:
            raise PoolStarved(f"no batch within {self.config.pop_timeout_s} s") from None
        except PoolStarved:
            self._late = None
            raise
        except Exception as e:
            self._failed = e
            raise
        self._late = None
        self._emitted += 1
        s = self._stats
        self._stats = replace(s, pop_wait=s.pop_wait.add((time.monotonic() - start) * 1000), batches_emitted=s.batches_emitted + 1)
        return batch

    def batches(self, n: int | None = None) -> Iterator[Batch]:
        """The next ``n`` batches, or all that are left; the ragged tail is held back. Goes on where the last pop ended."""
        while n is None or n > 0:
            try:
                yield self.pop()
            except PoolStarved:
                if n is None and self._late is None:
                    return
                raise
            n = None if n is None else n - 1

    def stats(self) -> Stats:
        return self._stats

    def stats_reset(self) -> None:
        self._stats = Stats()

    def close(self) -> None:
        """Ends the pipeline; what was not popped is dropped, and endless sources are left alone."""
        self._closed, self._rows = True, None
        self._sources.clear()
        self._worker.shutdown(wait=False, cancel_futures=True)
