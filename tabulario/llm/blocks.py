"""Which hashes of a corpus occur more than once, asked by blocks of documents.

Documents are dealt to blocks of some hundred. A block sends its distinct
hashes once, cut into buckets by their upper bits, and gets a bit for each of
them back: whether it also occurs elsewhere, in another block or again in its
own. So a hash that very many documents share costs a block one entry, and
buckets hold as many entries as a fixed number of blocks sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.memory import giving_back

# Documents in a block and blocks to a bucket, on average.
BLOCK_ROWS = 1024
BUCKET_BLOCKS = 8
SENT = "block long, bucket long, low binary, high binary, again binary"
ANSWER = "block long, bucket long, mask binary"


def block_count(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def bucket_count(blocks: int) -> int:
    return max(1, -(-blocks // BUCKET_BLOCKS))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """`docs` (doc_id, text, ...) with a `block`, all rows of a block in one partition."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(parts, "block")


def distinct(low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order that puts equal hashes side by side, and which places in it begin a new one."""
    order = np.argsort(low, kind="stable")
    same = low[order][1:] == low[order][:-1]
    if high is not None and len(low):
        alike = high[order][1:] == high[order][:-1]
        if (same & ~alike).any():
            order = np.lexsort((high, low))
            same, alike = low[order][1:] == low[order][:-1], high[order][1:] == high[order][:-1]
        same &= alike
    return order, np.r_[np.ones(min(1, len(low)), dtype=bool), ~same]


class Sent:
    """Distinct hashes of a block in buckets; `place` is where each of the given hashes stands among them."""

    def __init__(self, low: np.ndarray, high: np.ndarray | None, buckets: int):
        order, first = distinct(low, high)
        self.place = np.empty(len(low), dtype=np.int64)
        self.place[order] = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        self.low = low[order][at]
        self.high = high[order][at] if high is not None else None
        self.again = np.diff(np.r_[at, len(low)]) > 1
        # Upper bits, in proportion: hashes of a bucket stay together in the order.
        self.bucket = ((self.low >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.cut = np.searchsorted(self.bucket, np.arange(buckets + 1, dtype=np.uint64))

    def rows(self, block: int) -> pa.Table:
        full = [(b, x, y) for b, (x, y) in enumerate(zip(self.cut[:-1], self.cut[1:], strict=True)) if y > x]
        return pa.table({
            "block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array([b for b, _, _ in full], pa.int64()),
            "low": pa.array([self.low[x:y].tobytes() for _, x, y in full], pa.binary()),
            "high": pa.array([b"" if self.high is None else self.high[x:y].tobytes() for _, x, y in full], pa.binary()),
            "again": pa.array([np.packbits(self.again[x:y]).tobytes() for _, x, y in full], pa.binary()),
        })

    def answered(self, buckets: list[int], masks: list[bytes]) -> np.ndarray:
        """For each of the given hashes whether it occurs more than once."""
        repeated = np.zeros(len(self.low), dtype=bool)
        for b, mask in zip(buckets, masks, strict=True):
            x, y = self.cut[b], self.cut[b + 1]
            repeated[x:y] = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=int(y - x)).astype(bool)
        return repeated[self.place]


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    low = [np.frombuffer(r["low"], dtype=np.uint64) for r in rows]
    high = [np.frombuffer(r["high"], dtype=np.uint64) for r in rows]
    ends = np.cumsum([len(x) for x in low])
    again = np.concatenate([np.unpackbits(np.frombuffer(r["again"], dtype=np.uint8), count=len(x)) for r, x in zip(rows, low, strict=True)]).astype(bool)
    low = np.concatenate(low)
    order, first = distinct(low, np.concatenate(high) if len(rows[0]["high"]) else None)
    group = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    repeated = np.empty(len(low), dtype=bool)
    repeated[order] = ((np.diff(np.r_[at, len(low)]) > 1) | np.logical_or.reduceat(again[order], at))[group]
    out = [(r["block"], r["bucket"], np.packbits(m).tobytes()) for r, m in zip(rows, np.split(repeated, ends[:-1]), strict=True) if m.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["block", "bucket", "mask"],
    )


def repeated(sent: DataFrame) -> DataFrame:
    """Rows (block, bucket, mask) for what blocks sent; no row where nothing is repeated."""
    return sent.groupBy("bucket").applyInArrow(giving_back(_answers), ANSWER)
