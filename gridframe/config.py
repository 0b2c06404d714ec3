"""Configuration, status codes and the errors they raise."""

from __future__ import annotations

import enum
import math
from collections.abc import Sequence
from dataclasses import dataclass, fields


class Status(enum.IntEnum):
    """The outcomes of a request."""

    OK = 0
    AGAIN = 1
    INVAL = 2
    NOTFOUND = 3
    DTYPE = 4
    RANK = 5
    IO = 6
    DECODE = 7
    CUDA = 8
    OOM = 9
    BUDGET = 10
    SHUTDOWN = 11


class GridError(Exception):
    """Base of all errors that carry a status."""

    status = Status.INVAL


def _error(name: str, status: Status, doc: str, base: type = GridError) -> type:
    return type(name, (base,), {"status": status, "__doc__": doc})


TryAgain = _error("TryAgain", Status.AGAIN, "Nothing is ready yet.")
InvalidArgument = _error("InvalidArgument", Status.INVAL, "A request breaks a rule.")
NotFound = _error("NotFound", Status.NOTFOUND, "There is no such array.")
DtypeMismatch = _error("DtypeMismatch", Status.DTYPE, "The element type can't be cast.")
RankMismatch = _error("RankMismatch", Status.RANK, "The box has another rank than the array.")
StorageError = _error("StorageError", Status.IO, "A read failed.")
DecodeError = _error("DecodeError", Status.DECODE, "Bytes don't follow their format.")
BudgetExceeded = _error("BudgetExceeded", Status.BUDGET, "A declared limit would be passed.")
ShutdownError = _error("ShutdownError", Status.SHUTDOWN, "The pipeline is closed.")
PoolStarved = _error("PoolStarved", Status.AGAIN, "No batch within the time given.", TryAgain)

BY_STATUS = {"INVAL": InvalidArgument, "NOTFOUND": NotFound, "DTYPE": DtypeMismatch, "RANK": RankMismatch, "IO": StorageError, "DECODE": DecodeError, "BUDGET": BudgetExceeded}


class Dtype(enum.IntEnum):
    """Output types."""

    F32 = 0
    BF16 = 1

    @classmethod
    def coerce(cls, value: Dtype | str | int) -> Dtype:
        """By name, number or itself."""
        if isinstance(value, str):
            if value.lower() not in _NAMES:
                raise ValueError(f"unknown dtype {value!r}: one of {', '.join(_NAMES)}")
            return _NAMES[value.lower()]
        return cls(value)

    @property
    def numpy_name(self) -> str:
        return "bfloat16" if self is Dtype.BF16 else "float32"

    @property
    def bytes(self) -> int:
        return 2 if self is Dtype.BF16 else 4


#: Accepted names of output types.
_NAMES = {"f32": Dtype.F32, "float32": Dtype.F32, "bf16": Dtype.BF16, "bfloat16": Dtype.BF16}


@dataclass(frozen=True)
class Limits:
    """What a plan may ask for. A sample or batch beyond it gets a status; reads are cut to it."""

    max_shards_per_sample: int = 64
    max_chunk_uncompressed_bytes: int = 2 << 20
    max_batch_chunks: int = 16384
    max_read_op_bytes: int = 4 << 20
    max_chunks_per_read: int = 512
    page_alignment: int = 4096


#: The largest value of each limit.
_TOPS = {
    "max_shards_per_sample": 2**31,
    "max_chunk_uncompressed_bytes": 2**32 - 1,
    "max_batch_chunks": 16384,
    "max_read_op_bytes": 2**32 - 1,
    "max_chunks_per_read": 65535,
    "page_alignment": 2**30,
}


@dataclass(frozen=True)
class Config:
    """What a pipeline delivers, and its limits. Settings of GPU, NUMA, threads and caches have no meaning on Spark and are left out.

    ``lookahead_samples`` is how many samples of a pushed iterable are planned and read together, in whole batches.
    ``pop_timeout_s`` bounds how long a pop waits for its batch; none waits for ever.
    """

    sample_shape: tuple[int, ...]
    samples_per_batch: int
    dtype: Dtype | str | int = Dtype.F32
    lookahead_samples: int | None = None
    max_chunk_uncompressed_bytes: int = Limits.max_chunk_uncompressed_bytes
    max_read_op_bytes: int = Limits.max_read_op_bytes
    max_chunks_per_read: int = Limits.max_chunks_per_read
    max_shards_per_sample: int = Limits.max_shards_per_sample
    max_batch_chunks: int = Limits.max_batch_chunks
    page_alignment: int = Limits.page_alignment
    pop_timeout_s: float | None = None

    def __post_init__(self):
        set_ = lambda name, value: object.__setattr__(self, name, value)
        set_("sample_shape", tuple(self.sample_shape))
        if not 1 <= len(self.sample_shape) <= 31 or min(self.sample_shape) < 1:
            raise ValueError("sample_shape has 1 to 31 positive sizes")
        if self.samples_per_batch < 1:
            raise ValueError("samples_per_batch is at least 1")
        set_("dtype", Dtype.coerce(self.dtype))
        if self.lookahead_samples is None:
            set_("lookahead_samples", 2 * self.samples_per_batch)
        if self.lookahead_samples < self.samples_per_batch:
            raise ValueError("lookahead_samples covers at least one batch")
        for name, top in _TOPS.items():
            if not 1 <= getattr(self, name) <= top:
                raise ValueError(f"{name} lies between 1 and {top}")
        if self.pop_timeout_s is not None and self.pop_timeout_s <= 0:
            raise ValueError("pop_timeout_s is positive, or none")

    @classmethod
    def default(cls, sample_shape: Sequence[int], samples_per_batch: int, dtype: Dtype | str | int = Dtype.F32) -> Config:
        """All limits at their defaults, and a lookahead that keeps eight batches together."""
        return cls(tuple(sample_shape), samples_per_batch, dtype, lookahead_samples=8 * samples_per_batch)

    @property
    def limits(self) -> Limits:
        return Limits(**{name: getattr(self, name) for name in _TOPS})

    def batch_bytes(self) -> int:
        return self.samples_per_batch * math.prod(self.sample_shape) * self.dtype.bytes

    def describe(self) -> str:
        """One line a setting, with the bytes of a batch and of a window of samples."""
        rows = {f.name: getattr(self, f.name) for f in fields(self)}
        rows |= {"dtype": self.dtype.name, "batch_bytes": self.batch_bytes(), "window_batches": self.lookahead_samples // self.samples_per_batch}
        return "\n".join(f"{k:<30}{v}" for k, v in rows.items())
