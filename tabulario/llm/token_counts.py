"""Token counts by a two-tier lookup, with no shuffle of the texts' units.

The first tier are the units that are whole pieces of the model, with their
token counts: a compact table, bounded by the model, that goes out to the
workers. Each unit is looked up there, then in a table that the worker keeps of
what it met before; the rest goes to the library. Texts are read once and no unit
leaves its task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.texts import pieces
from tabulario.llm.vocab import PieceCounts, whole_pieces

_HELD: dict[tuple[str, str], PieceCounts] = {}


def _counter(path: str, frequent: Broadcast, call: str) -> PieceCounts:
    """The worker's tables for one call of the operator."""
    key = (path, call)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = PieceCounts(path, frequent.value)
    return _HELD[key]


def _counts(path: str, frequent: Broadcast, call: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _counter(path, frequent, call)
        for whole in batches:
            for batch in pieces(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                n = model.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.compute.binary_length(batch.column("text")).fill_null(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    `model` is the path of a SentencePiece BPE model on every machine. A null
    text counts as empty and has no tokens. Texts of any length are counted
    whole; no documents give no rows.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(whole_pieces(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_counts(model, frequent, uuid.uuid4().hex, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
