"""Document fingerprints from closed syncmers.

A substring of K code points is a closed syncmer if the smallest of its inner
substrings of S code points, by hash, is its first or its last one. That is a
property of the substring alone, so equal passages have equal anchors whatever
stands around them, and no K - S + 1 substrings in a row are without one. The
fingerprint lists, in order of their first places, the distinct anchor hashes
below a fixed bound, one in RATE, and in any case the ANCHORS smallest ones. So it
grows with the text, and a passage that two texts share keeps its anchors in both,
however long they are. Two fingerprints are alike by the anchors that match in
place, that is in the same order in both, among those of both together that
both would list.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.texts import mixed, window_hashes

K = 16
S = 6
ANCHORS = 64
RATE = 16
BOUND = (1 << 32) // RATE
_PART = 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _syncmers(codes: np.ndarray) -> np.ndarray:
    """Hashes of the closed syncmers, in place order."""
    points = codes.astype(np.uint64) + np.uint64(1)
    inner = window_hashes(points, S)
    span = K - S + 1
    n = len(points) - K + 1
    least, width = inner, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:n], least[span - width : span - width + n])
    at = np.flatnonzero((least == inner[:n]) | (least == inner[span - 1 : span - 1 + n]))
    return window_hashes(points, K)[at]


def anchors(text: str) -> np.ndarray:
    """The distinct anchor hashes (32 bits) below BOUND, or the ANCHORS smallest, in order of their first places.

    A text of fewer than K code points is its own only anchor; an empty one has none.
    """
    if not text:
        return np.empty(0, dtype=np.uint32)
    if len(text) < K:
        return np.array([short_hash(text)], dtype=np.uint32)
    codes = _codes(text)
    found = [_syncmers(codes[lo : lo + _PART + K - 1]) for lo in range(0, max(1, len(codes) - K + 1), _PART)]
    h = np.concatenate(found) if len(found) > 1 else found[0]
    h = (h >> np.uint64(32)).astype(np.uint32)
    distinct, place = np.unique(h, return_index=True)
    keep = max(ANCHORS, int(np.searchsorted(distinct, BOUND)))
    return distinct[:keep][np.argsort(place[:keep])]


def _known(marks: np.ndarray) -> int:
    """Up to which hash a fingerprint lists all anchors of its text."""
    return max(int(marks.max()), BOUND - 1) if len(marks) >= ANCHORS else 0xFFFFFFFF


def short_hash(text: str) -> int:
    """A 32-bit hash of a short text."""
    h = np.uint64(len(text))
    for c in _codes(text):
        h = mixed(np.array([h ^ np.uint64(c)], dtype=np.uint64))[0]
    return int(h >> np.uint64(32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest anchors of both that match in the same order; 1 for two empty fingerprints, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if np.array_equal(a, b):
        return 1.0
    known = min(_known(a), _known(b))
    both = np.union1d(a, b)
    both = both[both <= known]
    shared = np.intersect1d(np.intersect1d(a, b), both)
    if not len(shared):
        return 0.0
    place = {int(x): i for i, x in enumerate(b)}
    wanted = set(shared.tolist())
    tails: list[int] = []
    for x in a.tolist():
        if x in wanted:
            p = place[x]
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
    return len(tails) / len(both)


def as_text(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split(" ")[0] for f in _OUT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block and document id; each is held against the one that follows in its block."""
    last, rows = None, []
    for batch in batches:
        for block, borrowed, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            same = last is not None and last[0] == block
            marks = last[4] if same and last[3] == text else anchors(text)
            if same and not last[1]:
                _, _, own_id, own, own_marks = last
                n = len(own) // 4
                edited = own[: len(own) - n] + text[:n]
                new = anchors(edited) if edited != own else own_marks
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((own_id, len(own), digest, as_text(own_marks), as_text(new), likeness(own_marks, new), likeness(own_marks, marks)))
            last = (block, borrowed, doc_id, text, marks)
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text) with its fingerprint and that of its edited text.

    The edited text ends in the beginning of the next document instead of its
    own last quarter; the next one of the last is the first, and a single
    document is its own. A null text counts as empty, a null id comes first,
    rows with the same id follow each other by their texts. No documents give no rows.

    Texts move once, to blocks of consecutive ids; the first document of a
    block also goes to the block before, so that each block is complete.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    starts = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).groupBy(F.spark_partition_id().alias("p"))
    starts = starts.agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("p").collect()  # one row per block
    bounds = sorted({r["first"] for r in starts if r["first"] is not None})
    if any(r["nulls"] for r in starts):
        bounds = [None, *bounds]
    if not bounds:
        return spark.createDataFrame([], _OUT)
    known = [b for b in bounds if b is not None]
    edge = np.array(known, dtype=np.int64)
    shift, blocks = len(bounds) - len(known), len(bounds)

    @F.pandas_udf("array<int>")
    def places(value, null):
        import pandas as pd

        value, null = value.to_numpy(), null.to_numpy()
        own = np.where(null, 0, np.searchsorted(edge, value, side="right") - 1 + shift)
        opens = null.copy()
        if len(edge):
            at = np.clip(np.searchsorted(edge, value), 0, len(edge) - 1)
            opens |= ~null & (edge[at] == value)
        return pd.Series([[int(o), int((o - 1) % blocks)] if e else [int(o)] for o, e in zip(own, opens, strict=True)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.posexplode(places(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())).alias("borrowed", "block"), "doc_id", "text")
    rows = rows.select("block", (F.col("borrowed") == 1).alias("borrowed"), "doc_id", "text")
    moved = rows.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int"))
    order = ["block", "borrowed", F.col("doc_id").asc_nulls_first(), "text"]
    return moved.sortWithinPartitions(*order).mapInArrow(_against_next, _OUT)
