import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from llm.tables import read
from tabulario.llm import blocks, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def passages(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = [prose(n) for n in (34, 35, 36, 60, 200)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "  \n\t "), (None, prose(50)), (5, "same " * 100), (6, "x" * 5000)]
    for i in range(10, 60):
        text = prose(rng.integers(1, 120)) + rng.choice([" ", "\n", "\t\x0b "])
        for _ in range(rng.integers(0, 3)):
            text += shared[rng.integers(0, len(shared))] + " " + prose(rng.integers(0, 40)) + " "
        rows.append((i, text))
    return rows + [(61, rows[20][1]), (61, rows[20][1]), (62, prose(35)), (63, prose(3000))]


@pytest.mark.parametrize("seed, block_rows", [(0, 1024), (1, 5), (2, 1)])
def test_against_brute_force(documents, clashing, monkeypatch, seed, block_rows):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block_rows)
    rows = passages(seed)
    got = substring.removed_words(clashing(documents(*rows)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((r[:4] for r in brute(rows)), key=repr)


def test_whole_table(spark):
    docs = read(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in substring.removed_words(docs).collect()), key=repr) == sorted((r[:4] for r in brute(rows)), key=repr)


def test_texts_that_stay(documents, clashing):
    rows = passages(4)
    docs = clashing(documents(*rows))
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    want = sorted(((i, k if gone else None) for i, _, gone, _, k in brute(rows)), key=repr)
    texts = {(i, t) for i, t in rows}
    have = [(r.doc_id, None if (r.doc_id, r.text) in texts else r.text) for r in got.collect()]
    assert sorted(have, key=repr) == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got.collect())


def test_empty(documents):
    assert substring.removed_words(documents()).count() == 0
    assert substring.without_repeats(documents()).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
