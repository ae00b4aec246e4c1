"""Memory that workers give back.

Workers outlive their tasks, and both allocators, Arrow's and the C library's,
keep what a task has freed. Without this a worker stays as large as the largest
task that it ever had, in all later stages.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def giving_back(step: Callable) -> Callable:
    """`step`, a function over Arrow batches, that leaves nothing behind when its batches end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def lean(work: Callable[[], Any]) -> Any:
    """The result of `work`; what else it needed is given back."""
    out = work()
    give_back()
    return out
