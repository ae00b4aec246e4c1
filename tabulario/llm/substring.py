"""Removal of repeated passages by difference-cover anchors.

A window is WIDTH consecutive words of a document. Anchors are shorter windows at
places that are cover residues modulo PERIOD. Any two places have a common
shift below PERIOD that brings both to a cover place, so two equal windows have
an anchor in common, at the same distance from their starts; a window without a
repeated anchor is not repeated. The windows around repeated anchors are then
compared as a whole, by 128 bits of hash. Texts move once, to blocks, and are
read there three times; only hashes go further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulario.llm.blocks import SENT, Sent, block_count, bucket_count, in_blocks, repeated
from tabulario.llm.memory import lean
from tabulario.llm.texts import STEPS, Words

WIDTH = 35
# A perfect difference set, every residue but 0 is the difference of one pair of them.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


class _Block:
    """Words, anchors and candidate windows of the texts of a block."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, width: int, buckets: int):
        column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.words, self.width, self.buckets = Words(column), width, buckets
        first = self.words.first
        self.place = np.arange(len(self.words.hash)) - np.repeat(first[:-1], np.diff(first))
        self.rest = np.repeat(first[1:], np.diff(first)) - np.arange(len(self.words.hash))
        anchor = width - PERIOD + 1
        h, fits = self.words.windows(anchor)
        long = self.place + self.rest >= width
        self.anchor_at = np.flatnonzero(fits & long & np.isin(self.place % PERIOD, COVER))
        self.anchors = Sent(h[self.anchor_at], None, buckets)

    def candidates(self, answer: tuple[list[int], list[bytes]]) -> Sent:
        """Windows that begin at most PERIOD - 1 words before a repeated anchor."""
        n = len(self.words.hash)
        total = np.zeros(n + PERIOD + 1, dtype=np.int32)
        total[1 + self.anchor_at[self.anchors.answered(*answer)]] = 1
        np.cumsum(total, out=total)
        near = total[PERIOD : PERIOD + n] - total[:n] > 0
        self.window_at = np.flatnonzero(near & (self.rest >= self.width))
        low, high = (self.words.windows(self.width, base)[0][self.window_at] for base in STEPS)
        return Sent(low, high, self.buckets)

    def removed(self, first: tuple[list[int], list[bytes]], second: tuple[list[int], list[bytes]]) -> np.ndarray:
        """Words covered by a repeated window."""
        windows = self.candidates(first)
        starts = self.window_at[windows.answered(*second)]
        n = len(self.words.hash)
        depth = np.zeros(n + 1, dtype=np.int32)
        depth[starts] += 1
        np.subtract.at(depth, starts + self.width, 1)
        return np.cumsum(depth[:n]) > 0

    def kept(self, removed: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(words, removed words, kept words joined by a space) of each text."""
        w = self.words
        stay = np.flatnonzero(~removed)
        size = (w.ends - w.starts)[stay] + 1
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(w.starts[stay] - (ends - size), size)
        out = w.data[np.minimum(source, max(0, len(w.data) - 1))] if total else np.empty(0, dtype=np.uint8)
        out[ends - 1] = 32
        cut = np.searchsorted(stay, w.first)
        at = np.r_[0, ends][cut]
        for i in range(len(w.first) - 1):
            a, b = int(at[i]), int(at[i + 1])
            words = int(w.first[i + 1] - w.first[i])
            yield words, words - int(cut[i + 1] - cut[i]), out[a : b - 1].tobytes() if b > a else b""


def _answer(masks: pa.Table, step: int) -> tuple[list[int], list[bytes]]:
    own = masks.filter(pa.compute.equal(masks.column("step"), step))
    return own.column("bucket").to_pylist(), own.column("mask").to_pylist()


def _send_anchors(width: int, buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return lean(lambda: _Block(table.column("text"), width, buckets).anchors.rows(key[0].as_py()))

    return run


def _send_windows(width: int, buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        return lean(lambda: _Block(table.column("text"), width, buckets).candidates(_answer(masks, 1)).rows(key[0].as_py()))

    return run


def _finish(width: int, buckets: int, of_rows: Callable) -> Callable:
    def rest(table: pa.Table, masks: pa.Table) -> pa.Table:
        block = _Block(table.column("text"), width, buckets)
        results = block.kept(block.removed(_answer(masks, 1), _answer(masks, 2)))
        return of_rows(table, results)

    def run(key: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        return lean(lambda: rest(table, masks))

    return run


def _digests(table: pa.Table, results: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in results]
    n, gone, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def _texts(table: pa.Table, results: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    texts = table.column("text").to_pylist()
    gone = []
    for i, (_, n, kept) in enumerate(results):
        gone.append(n)
        if n:
            texts[i] = kept.decode()
    return pa.table({"doc": table.column("doc"), "text": pa.array(texts, pa.string()), "gone": pa.array(gone, pa.int64())})


def _over_blocks(rows: DataFrame, n: int, width: int, of_rows: Callable, schema: str | T.StructType) -> DataFrame:
    """The three rounds over `rows` (doc_id, text, ...): anchors, windows, removal."""
    blocks = block_count(n)
    buckets = bucket_count(blocks)
    texts = in_blocks(rows, blocks)
    sent = texts.groupBy("block").applyInArrow(_send_anchors(width, buckets), SENT)
    anchors = repeated(sent).withColumn("step", F.lit(1))
    sent = texts.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_send_windows(width, buckets), SENT)
    masks = anchors.unionByName(repeated(sent).withColumn("step", F.lit(2)))
    return texts.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(_finish(width, buckets, of_rows), schema)


def removed_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    Words are runs without white space (space, 9 to 13), unchanged. A word goes
    if a window of `width` words that covers it also starts at any other place
    of the corpus; every such place loses its words, so repeated rows lose all
    but short texts. A null text has no words; no documents give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return _over_blocks(rows, docs.count(), width, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` with repeated passages taken out of `text`.

    A text that loses words becomes its kept words joined by one space, and
    `n_chars`, if there is such a column, its new length; all else stays, columns
    of any name included. A null text has no words and stays null; repeated rows
    lose what they share with each other; no documents give no rows.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*rest).alias("doc"))
    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.StringType()), T.StructField("gone", T.LongType())])
    out = _over_blocks(rows, docs.count(), width, _texts, schema)
    columns = {c: F.col(f"doc.`{c}`") for c in rest} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*[columns[c].alias(c) for c in docs.columns])
