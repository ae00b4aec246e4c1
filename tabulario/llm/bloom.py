"""A Bloom filter of what occurs more than once, made without moving the rows.

Every hash sets PROBES bits. A filter has two planes: bits set at least once and
bits set at least twice. Tasks send the bits that their rows set as short
sorted lists per slice of SLICE bits, slices are merged on the executors, and
only the second plane goes to the driver and out again. A hash that occurs
twice has all its bits in the second plane; of the others few have.

The plane is at most MOST_BITS long. More rows than that plane serves are
treated in rounds: round r has the hashes of class r, each with a plane of its
own, so the rate of false finds and the size of the broadcast stay the same at
any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.llm.texts import mixed

PROBES = 3
BITS_PER_ROW = 16
MOST_BITS = 1 << 29
SLICE = 1 << 16
FLUSH_ROWS = 1 << 20


def _class(h: np.ndarray, rounds: int) -> np.ndarray:
    return (mixed(h, 90) >> np.uint64(1)) % np.uint64(rounds)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions per hash, one column each."""
    return np.stack([mixed(h, 91 + p) & np.uint64(bits - 1) for p in range(PROBES)], axis=1)


def _lists(bits: int, round_: int, rounds: int) -> Callable:
    def of(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        h = h[_class(h, rounds) == round_] if rounds > 1 else h
        if not len(h):
            return
        distinct, times = np.unique(h, return_counts=True)
        at = _bits(distinct, bits)
        again = np.unique(at[times > 1])
        at.sort(axis=1)
        own = np.concatenate([at[:, :1].ravel(), *[at[at[:, p] != at[:, p - 1], p] for p in range(1, PROBES)]])
        at, times = np.unique(own, return_counts=True)
        twice = np.isin(at, again) | (times > 1)
        slices = (at // np.uint64(SLICE)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True])
        low = (at % np.uint64(SLICE)).astype(np.uint16)
        rows = [(int(slices[a]), low[a:b].tobytes(), low[a:b][twice[a:b]].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "once", "twice"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH_ROWS:
                yield from of(np.concatenate(held))
                held, n = [], 0
        if held:
            yield from of(np.concatenate(held))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice; the lists come in batches and add up in a fixed number of counters."""
    counts, slice_ = np.zeros(SLICE, dtype=np.uint8), None
    for batch in batches:
        for name, add in (("once", 1), ("twice", 2)):
            for blob in batch.column(name).to_pylist():
                at = np.frombuffer(blob, dtype=np.uint16)
                counts[at] = np.minimum(counts[at] + np.uint8(add), 2)
        if batch.num_rows:
            slice_ = batch.column("slice")[0].as_py()
    if slice_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])


def _plane(hashes: DataFrame, bits: int, round_: int, rounds: int) -> np.ndarray:
    lists = hashes.mapInArrow(_lists(bits, round_, rounds), "slice long, once binary, twice binary")
    merged = lists.groupBy("slice").applyInArrow(_merge, "slice long, bits binary")
    plane = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.collect():  # at most MOST_BITS / 8 bytes in all
        plane[row["slice"] * (SLICE // 8) : (row["slice"] + 1) * (SLICE // 8)] = np.frombuffer(row["bits"], dtype=np.uint8)
    return plane


class Filter:
    """One round's plane on its way to the workers."""

    def __init__(self, plane: Broadcast, bits: int, round_: int, rounds: int):
        self.plane, self.bits, self.round, self.rounds = plane, bits, round_, rounds

    def state(self, h: np.ndarray) -> np.ndarray:
        """For each hash 1 if it may occur again, 0 if it occurs once, -1 if it belongs to another round."""
        held, at = self.plane.value, _bits(h, self.bits)
        maybe = ((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1).astype(np.int32)
        return np.where(_class(h, self.rounds) == self.round, maybe, -1).astype(np.int32) if self.rounds > 1 else maybe

    def column(self, column: str) -> Column:
        """`state` of a long column without nulls."""

        @F.pandas_udf("int")
        def state(h):
            import pandas as pd

            return pd.Series(self.state(h.to_numpy().view(np.uint64)))

        # Otherwise the test would be inferred for the other side of a later join as well.
        return state.asNondeterministic()(F.col(column))

    def before(self, column: str, step: Callable) -> Callable:
        """`step`, a function over Arrow batches, on the rows whose hash occurs once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return step(b.filter(pa.array(self.state(b.column(column).to_numpy(zero_copy_only=False).view(np.uint64)) == 0)) for b in batches)

        return run


def filters(hashes: DataFrame, column: str, n: int, most_bits: int = MOST_BITS) -> list[Filter]:
    """Filters of what occurs more than once among the `n` longs of a column, one for each round.

    `hashes` is read once a round, so it should be cheap to read.
    """
    bits = min(most_bits, 1 << max(16, (n * BITS_PER_ROW).bit_length()))
    rounds = max(1, -(-n * BITS_PER_ROW // (2 * bits)))
    context = hashes.sparkSession.sparkContext
    return [Filter(context.broadcast(_plane(hashes.select(column), bits, r, rounds)), bits, r, rounds) for r in range(rounds)]


def where_state(rows: DataFrame, found: list[Filter], column: str, state: int) -> DataFrame:
    """The rows in the given state, from one pass for each round."""
    return reduce(DataFrame.unionByName, [rows.where(f.column(column) == state) for f in found])


def split_repeated(rows: DataFrame, hashes: DataFrame, column: str, n: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may occur again, rows whose hash occurs once).

    `column` is a long without nulls in `rows`; `hashes` has that column for the
    same `n` rows. The first frame has every repeated hash and a few others.
    """
    found = filters(hashes, column, n, most_bits)
    return where_state(rows, found, column, 1), where_state(rows, found, column, 0)
