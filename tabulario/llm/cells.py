"""Counts of hashed tokens over a whole corpus in a fixed number of counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Counters, the same number at any size of the corpus.
CELLS = 1 << 20
_STEP = 1 << 14
COUNTS = "lo long, counts binary"


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def counting(tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Callable:
    """A function over Arrow batches that gives the counters of their tokens, in slices (COUNTS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.uint64)
        for batch in batches:
            for some in tokens(batch):
                total += np.bincount(cell_of(some), minlength=CELLS).astype(np.uint64)
        for lo in range(0, CELLS, _STEP):
            part = total[lo : lo + _STEP]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["lo", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lo, total = None, None
    for batch in batches:
        for at, blob in zip(batch.column("lo").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(blob, dtype=np.uint64)
            lo, total = at, part if total is None else total + part
    if lo is not None:
        yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["lo", "counts"])


def added_up(parts: DataFrame) -> np.ndarray:
    """The counters of all tasks together: CELLS numbers, whatever the corpus."""
    counts = np.zeros(CELLS, dtype=np.uint64)
    for row in parts.groupBy("lo").applyInArrow(_added, COUNTS).collect():  # one row for each slice of the counters
        part = np.frombuffer(row["counts"], dtype=np.uint64)
        counts[row["lo"] : row["lo"] + len(part)] = part
    return counts


def cell_counts(rows: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often the tokens that `tokens` finds in batches of `rows` fall on each counter.

    Tasks send the counters that they touched in slices, which are added up on
    the executors.
    """
    return added_up(rows.mapInArrow(counting(tokens), COUNTS))
