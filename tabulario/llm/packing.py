"""Best-two-fit packing of documents into sequences of fixed capacity.

Tokenising gives every task its pieces and their rank among the task's pieces of
the same length. How many pieces there are of each length, at most `capacity`
figures, is all that packing needs: bins are filled greedily with the longest
piece that fits, then the shortest one is replaced by the two unpacked ones that
fill its place more tightly, and a bin is repeated as often as its lengths
last, which gives the same bins as packing one by one. The resulting plan is a
table by length and rank; pieces look their places up there, so they are never
gathered, sorted or grouped by length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulario.llm.memory import giving_back
from tabulario.llm.texts import pieces
from tabulario.llm.vocab import ByteLevel
from tabulario.llm.workspace import Workspace

CAPACITY = 2048
END_ID = 0
# Ranks are kept below this, so length and rank make one number.
_RANKS = 1 << 44
_CODECS: dict[tuple, ByteLevel] = {}
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _rank long"


def _codec(*key: str | None) -> ByteLevel:
    if key not in _CODECS:
        _CODECS[key] = ByteLevel(*key)
    return _CODECS[key]


def _cut(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of n ids; only the first may be shorter than the capacity if there are several."""
    first = n if n <= capacity else n % capacity or capacity
    return [0, *range(first, n, capacity)]


def _tokenised(codec_key: tuple, capacity: int, end_id: int) -> Callable:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, ranks, task = _codec(*codec_key), [0] * (capacity + 1), TaskContext.get().partitionId()
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = codec.ids(text or "") + end
                    n = len(ids) // 4
                    starts = _cut(n, capacity)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), task, ranks[b - a]))
                        ranks[b - a] += 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _PIECE.replace(" long", "").replace(" int", "").split(", "))

    return run


def _best_two(lengths: list[int], left: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (over, room]; of equal sums the one with the longest."""
    best, found = over, None
    for i in range(bisect_right(lengths, room - 1) - 1, -1, -1):
        a = lengths[i]
        if 2 * a <= best:
            break
        if not left[a]:
            continue
        j = min(bisect_right(lengths, room - a) - 1, i)
        while j >= 0 and (left[lengths[j]] < 1 + (i == j)):
            j -= 1
        if j >= 0 and a + lengths[j] > best:
            best, found = a + lengths[j], (a, lengths[j])
            if best == room:
                break
    return found


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """([(length, first rank, first sequence, offset)], number of sequences) for so many pieces of each length.

    Ranks from an entry's first one up to the next entry of its length go to
    consecutive sequences from the entry's, at its offset.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    taken = dict.fromkeys(lengths, 0)
    plan, sequence = [], 0
    while lengths:
        room, bin_ = capacity, []
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if n > room:
                at = bisect_right(lengths, room, 0, at) - 1
                continue
            k = min(left[n], room // n)
            left[n] -= k
            room -= k * n
            bin_ += [n] * k
            at -= 1
        if room and len(bin_) > 1:
            smallest = bin_[-1]
            two = _best_two(lengths, left, room + smallest, smallest)
            if two:
                left[smallest] += 1
                bin_[-1:] = two
                for n in two:
                    left[n] -= 1
        used = {n: bin_.count(n) for n in set(bin_)}
        times = 1 + min(left[n] // k for n, k in used.items())
        offset = 0
        for n in bin_:
            plan.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        for n, k in used.items():
            left[n] -= k * (times - 1)
        sequence += times
        if any(not left[n] for n in used):
            lengths = [n for n in lengths if left[n]]
    return plan, sequence


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `docs` has doc_id and text; a null text counts as empty and so is one
    piece of `end_id` alone. `tokenizer` is a byte-level BPE file, `ranks` and
    `pattern` the same vocabulary as a rank file. Rows are packed one by one, so
    repeated rows or ids each have their own pieces. No documents give no rows.
    """
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # Written once: a task that runs again would replace its whole file, so ranks and rows stay together.
    parts = work.keep(rows.mapInArrow(giving_back(_tokenised((tokenizer, ranks, pattern), capacity, end_id)), _PIECE), "pieces")
    by_task = parts.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = work.keep(by_task.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))), "by_task")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = packing_plan(counts, capacity)
    plan.sort()
    key = np.array([n * _RANKS + r for n, r, _, _ in plan], dtype=np.int64)
    first = np.array([s for _, _, s, _ in plan], dtype=np.int64)
    offset = np.array([o for _, _, _, o in plan], dtype=np.int64)
    table = docs.sparkSession.sparkContext.broadcast((key, first, offset))  # bounded by the capacity, not by the documents

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        keys, firsts, offsets = table.value
        wanted = length.to_numpy() * _RANKS + rank.to_numpy()
        at = np.searchsorted(keys, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + wanted - keys[at], "offset": offsets[at]})

    ranked = parts.join(by_task.drop("_n"), ["_task", "length"])
    placed = ranked.withColumn("_at", place("length", F.col("_before") + F.col("_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
