"""Toxic passages as maximal scoring segments of word log-odds.

Words and their beginnings, which stand for the inflected forms of a stem, get
the log-odds of the toxic against the clean labelled documents, with a Dirichlet
prior from the counts of the whole corpus and less a multiple of their standard
error, so what is seen too rarely weighs nothing. A word scores as the one of
them that says most; a constant drift makes ordinary text score downwards. One scan finds all maximal scoring segments of a
text. Their scores are set against the scores that clean text reaches by chance,
which have an extreme-value distribution, and what stands out is turned into a
probability on labelled documents that had no part in the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.llm.cells import CELLS, cell_counts, cell_of
from tabulario.llm.texts import Words, pieces
from tabulario.llm.workspace import Workspace

# Labelled rows that the model is fitted on at most, by order of a hash of the id.
TRAINING_ROWS = 40_000
FOLDS = 5
# Fold 0 is held out; the last one turns segment scores into probabilities, the others give the weights.
CALIBRATION_FOLD = 4
# Weight of the prior, as a share of the labelled words.
PRIOR = 0.03
DEVIATIONS = 2.0
DRIFT = 1.0
# Segments with fewer than so many chance counterparts in a text of its length are significant.
CHANCE = 0.05
# Scores of clean words are counted in steps of 1/BINS up to MOST.
BINS, MOST = 10, 40

# Bytes of a word's beginnings.
STEMS = (4, 5, 6)

_LETTER = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cells of each word and of its beginnings, one row each; first word of each text).

    Words are runs of letters and digits, in lower case.
    """
    words = Words(texts, lower=True, separator=~_LETTER, prefixes=STEMS)
    return cell_of(words.hash).T, words.first


def _word_scores(scores: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Score of each word: the strongest of the word and its beginnings, less the drift."""
    found = scores[cells]
    return np.take_along_axis(found, np.abs(found).argmax(axis=1)[:, None], axis=1)[:, 0] - np.float32(DRIFT)


def _rows(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int32).reshape(-1, 1 + len(STEMS))


def _corpus_words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in pieces(batch, "text"):
        yield _words(part.column("text"))[0].ravel().astype(np.uint64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint and in order, in one scan.

    A segment is maximal if no part of it beats the whole and nothing longer
    has that property. Runs of positive scores come in one by one; each either
    stands alone or joins the earlier ones that it lifts.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(np.r_[False, up, False].astype(np.int8)))
    total = np.r_[0.0, np.cumsum(scores, dtype=np.float64)]
    held: list[tuple[int, int, float, float]] = []
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        low, high = float(total[start]), float(total[end])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j -= 1
            if j < 0 or held[j][3] >= high:
                held.append((start, end, low, high))
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, high - low) for a, b, low, high in held]


@dataclass(frozen=True)
class Model:
    """Word scores by cell, the extreme-value law of clean text, and the step to a probability."""

    scores: np.ndarray
    rate: float
    scale: float
    coefficients: np.ndarray

    def evidence(self, found: list[tuple[int, int, float]], words: int) -> tuple[float, float, float]:
        """(of the best segment, of all significant ones, their number) in natural logarithms of odds against chance."""
        if not found:
            return 0.0, 0.0, 0.0
        excess = [self.rate * s - np.log(self.scale * max(1, words)) for _, _, s in found]
        significant = [e for e in excess if e > -np.log(CHANCE)]
        best = max(excess)
        # -log of the chance that a clean text of this length has a segment as good as the best one.
        surprise = best if best > 30 else -np.log(-np.expm1(-np.exp(-best)))
        return float(surprise), float(sum(significant)), float(len(significant))

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = _design(features)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.coefficients, -30, 30)))


def _design(features: np.ndarray) -> np.ndarray:
    best, total, number = features.T
    return np.column_stack([np.ones(len(features)), np.minimum(best, 50.0) / 10.0, np.log1p(total), np.log1p(number)])


def log_odds(toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Scores of words from their counts in toxic and clean documents and in the whole corpus."""
    weight = max(1.0, PRIOR * (toxic.sum() + clean.sum()))
    prior = np.maximum(weight * corpus / max(1.0, corpus.sum()), 1e-6)
    a, b = toxic + prior, clean + prior
    n, m = toxic.sum() + weight, clean.sum() + weight
    delta = np.log(a / np.maximum(n - a, 1e-9)) - np.log(b / np.maximum(m - b, 1e-9))
    sure = np.maximum(np.abs(delta) - DEVIATIONS * np.sqrt(1.0 / a + 1.0 / b), 0.0)
    return np.sign(delta) * sure


def _rate(scores: np.ndarray, times: np.ndarray) -> float:
    """The positive solution of E[exp(rate * score)] = 1 over the scores of clean words and how often they occur."""
    if not (scores > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda r: float(np.log(np.average(np.exp(np.minimum(r * scores, 700.0)), weights=times)))
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.1)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word cells of the labelled texts."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            cells, first = _words(batch.column("text"))
            blobs = [np.ascontiguousarray(cells[a:b], dtype=np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), pa.array(blobs, pa.binary())], ["toxic", "fold", "cells"])


def _sampled_words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield _rows(b"".join(batch.column(0).to_pylist())).ravel().astype(np.uint64)


def _segment_scores(scores: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, bins = [], [], []
            for blob in batch.column("cells").to_pylist():
                own = _word_scores(scores, _rows(blob))
                sizes.append(len(own))
                found.append([s for _, _, s in segments(own)])
                bins.append(np.bincount(np.clip(np.rint(own * BINS), -MOST * BINS, MOST * BINS).astype(np.int64) + MOST * BINS, minlength=2 * MOST * BINS + 1))
            kept = [np.flatnonzero(b) for b in bins]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(kept, pa.list_(pa.int64())), pa.array([b[k] for b, k in zip(bins, kept, strict=True)], pa.list_(pa.int64()))],
                ["toxic", "words", "found", "bin", "times"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most `training_rows` rows of `labels` (doc_id, toxic) outside fold 0; the prior counts all of `docs`."""
    corpus = cell_counts(docs.select("text"), _corpus_words).astype(np.float64)
    labelled = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), fold_of(F.col("doc_id")).cast("int").alias("fold"))
    work = Workspace(docs.sparkSession)
    sample = work.keep(rows.mapInArrow(_sample, "toxic int, fold int, cells binary"), "sample")
    learned = sample.where(F.col("fold") != CALIBRATION_FOLD)
    toxic, clean = (cell_counts(learned.where(F.col("toxic") == y).select("cells"), _sampled_words).astype(np.float64) for y in (1, 0))
    scores = log_odds(toxic, clean, corpus).astype(np.float32)
    rest = sample.where(F.col("fold") == CALIBRATION_FOLD).select("toxic", "cells")
    seen = rest.mapInArrow(_segment_scores(scores), "toxic int, words long, found array<double>, bin array<bigint>, times array<bigint>").collect()  # at most `training_rows` rows
    work.drop("sample")
    times = np.zeros(2 * MOST * BINS + 1)
    for r in seen:
        if not r["toxic"]:
            times[np.array(r["bin"], dtype=np.int64)] += r["times"]
    values = (np.flatnonzero(times) - MOST * BINS) / BINS
    rate = _rate(values, times[times > 0])
    # Maximum likelihood of the scale of an extreme-value law with a known rate, on clean texts.
    best = [(r["words"], max(r["found"], default=0.0)) for r in seen if not r["toxic"] and r["words"]]
    scale = len(best) / max(1e-9, sum(n * np.exp(-rate * s) for n, s in best)) if best else 1.0
    model = Model(scores, rate, max(scale, 1e-9), np.zeros(4))
    y = np.array([r["toxic"] for r in seen], dtype=np.float64)
    x = np.array([model.evidence([(0, 0, s) for s in r["found"]], r["words"]) for r in seen]).reshape(-1, 3)
    fitted = _logistic(_design(x), y) if len(set(y.tolist())) == 2 else np.array([-2.0, 1.0, 1.0, 1.0])
    return Model(scores, rate, model.scale, fitted)


def _scored(model, threshold: float, spans: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                cells, first = _words(batch.column("text"))
                scores = _word_scores(m.scores, cells)
                found = [segments(scores[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                sizes = np.diff(first)
                p = m.probability(np.array([m.evidence(f, int(n)) for f, n in zip(found, sizes, strict=True)]).reshape(-1, 3))
                own = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
                names = [n for n in batch.schema.names if n != "text"]
                out = [*own, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                if spans:
                    limit = [np.log(m.scale * max(1, int(n)) / CHANCE) / m.rate for n in sizes]
                    out.append(pa.array([[(a, b, s) for a, b, s in f if s > t] for f, t in zip(found, limit, strict=True)], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(out, [*names, "score", "predicted", *["passages"] * spans])

    return run


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.5, passages: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted and, if asked for, passages.

    Passages are the significant segments (first word, end, score), words being
    runs of letters and digits. Texts are read whole; null and empty ones have no
    segment and get the score of that. A null id counts as held out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), F.col("text"))
    more = ", passages array<struct<first:bigint,end:bigint,score:double>>" if passages else ""
    return rows.mapInArrow(_scored(held, threshold, passages), f"doc_id long, held_out boolean, score double, predicted int{more}")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns, whatever their names.

    Null texts are scored as empty ones; repeated rows are judged alike and all
    stay or go; no documents give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def predicted(text):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(text, type=pa.string())], ["text"])
        return pd.concat([b.column("predicted").to_pandas() for b in _scored(held, threshold, False)([batch])], ignore_index=True)

    return docs.where(predicted("text") == 0)
