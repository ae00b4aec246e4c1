import zlib

import numpy as np
import pytest

from tabulario.llm import toxicity

HELD_OUT_DIR = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "idiot"), (None, "idiot idiot"), (5, "word " * 50_000), (5, "word " * 50_000), (2**60 + 1, "fine")]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{HELD_OUT_DIR}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    toxic, clean = [g.score for g, y in held if y], [g.score for g, y in held if not y]
    assert np.mean([[a > b or 0.5 * (a == b) for b in clean] for a in toxic]) > 0.85
    assert np.mean([g.predicted == y for g, y in held]) > 0.93


def test_edge_rows(documents, clashing, fitted):
    model = fitted[2]
    got = toxicity.toxicity(clashing(documents(*EDGES)), model, passages=True).collect()
    assert [r.doc_id for r in got] == [i for i, _ in EDGES]
    empty = [r for r in got if r.doc_id in (1, 2, 3)]
    assert len({r.score for r in empty}) == 1 and not any(r.predicted or r.passages for r in empty)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    docs = clashing(documents(*EDGES))
    stay = toxicity.without_toxic(docs, model)
    assert stay.columns == docs.columns
    assert stay.count() == sum(1 - r.predicted for r in got)


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(), labels)
    assert toxicity.toxicity(documents(), model).count() == 0
    assert [r.predicted for r in toxicity.toxicity(documents((1, "a")), model).collect()] == [0]
    one_class = spark.createDataFrame([(1, 1), (2, None), (None, 1), (1, 1)], "doc_id bigint, toxic int")
    toxicity.fit(documents((1, "a b"), (2, None)), one_class)


def brute_segments(scores):
    """Best segment first, then the same on both sides of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2]):
                best = (a, b, s)
    if best is None:
        return []
    a, b, _ = best
    left = brute_segments(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*left, best, *right]


@pytest.mark.parametrize("seed", range(40))
def test_segments(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(-0.3, 1.5, rng.integers(0, 30))
    got, want = toxicity.segments(scores), brute_segments(scores.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_rare_words_weigh_nothing():
    toxic, clean, corpus = (np.array(x, dtype=float) for x in ([300, 3] + [500] * 20, [2, 0] + [6000] * 20, [700, 4] + [10_000] * 20))
    scores = toxicity.log_odds(toxic, clean, corpus)
    assert scores[0] > 2 and scores[1] == 0 and (abs(scores[2:]) < 0.5).all()


def test_rate_is_the_root():
    values, times = np.array([-1.0, 2.0]), np.array([9.0, 1.0])
    r = toxicity._rate(values, times)
    assert abs(0.9 * np.exp(-r) + 0.1 * np.exp(2 * r) - 1) < 1e-6
