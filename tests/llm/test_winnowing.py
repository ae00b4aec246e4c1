import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.tables import read
from tabulario.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(winnowing.UPPER, winnowing.LOWER)
ITEMS = "item_id bigint, text string"
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        listed = sorted({str(i) for i in found if i is not None})
        out.append((doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


PASSAGE = "One two three four five six seven eight nine ten eleven twelve"


def test_edge_cases(spark, documents, clashing):
    items = [(10, PASSAGE), (2, PASSAGE.lower()), (3, "Short item"), (3, "again UNDER the same id, with some words of its own here"), (4, None), (5, " -- "), (6, "Ñandú été"), (None, "nobody knows"), (7, "x " * 30)]
    rows = [
        (1, None), (2, ""), (3, "..."), (4, f"before {PASSAGE} after"), (5, "one two three four five six seven eight nine"), (None, "a short,item! here"), (None, "a short,item! here"),
        (6, "short-item short item, short"), (7, "Ñandú été ñandú été"), (8, "nobody   knows"), (9, "x " * 500), (9, "x " * 500), (9, "another text"), (10, "ten eleven " + PASSAGE + " one " + PASSAGE[4:]),
        (11, "y" * 50_000), (12, " ".join(map(str, range(30_000))) + " " + PASSAGE),
    ]
    got = winnowing.contaminated(clashing(documents(*rows)), clashing(spark.createDataFrame(items, ITEMS)))
    assert result(got) == brute(rows, items)
    assert result(winnowing.contaminated(documents(*rows), spark.createDataFrame(items, ITEMS), round_windows=3)) == brute(rows, items)


def test_nothing_to_find(spark, documents):
    rows = [(1, PASSAGE), (2, None)]
    for items in ([], [(1, None)], [(1, "?")]):
        assert result(winnowing.contaminated(documents(*rows), spark.createDataFrame(items, ITEMS))) == brute(rows, [])
    assert winnowing.contaminated(documents(), spark.createDataFrame([(1, PASSAGE)], ITEMS)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, documents, seed):
    """Few different words, so that grams repeat and hashes tie."""
    rng = np.random.default_rng(seed)
    vocabulary = ["ab", "Cd", "ef", "é", "7"]
    items = [(int(i), " ".join(rng.choice(vocabulary, rng.choice([2, 9, 10, 11, 25])))) for i in range(12)]
    rows = []
    for i in range(40):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30)))]
        if i % 2:
            w = words(items[rng.integers(0, 12)][1])
            lo = int(rng.integers(0, max(1, len(w) - 8)))
            parts.append(" ".join(w[lo : lo + int(rng.integers(8, 20))]))
        rows.append((i, " / ".join(parts)))
    want = brute(rows, items)
    assert result(winnowing.contaminated(documents(*rows), spark.createDataFrame(items, ITEMS))) == want
    assert Counter(r[-1] for r in want)[True] > 3


def test_whole_table(spark):
    docs, items = read(spark, "documents"), read(spark, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(winnowing.contaminated(docs, items)) == want


def test_main_path_is_native(spark, documents):
    plan = winnowing.contaminated(documents((1, PASSAGE)), spark.createDataFrame([(1, PASSAGE)], ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equal_windows_have_equal_fingerprints(spark):
    """Whatever stands around a window, the same gram of it is chosen."""
    inner = "the quick brown fox jumps over the lazy dog again".split()
    texts = [" ".join(a + inner + b) for a in ([], ["x"], ["the", "lazy", "dog"]) for b in ([], ["the", "quick"])]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", winnowing._hashed(F.col("text")).alias("h"))
    rows = winnowing._windows(winnowing._with_grams(df, [10]), [10]).where(F.col("f").isNotNull()).select("k", "f", *winnowing._identity([10])).collect()
    first = next((r.w1, r.w2, r.f) for r in rows if r.k == 0)
    assert all(any((r.w1, r.w2, r.f) == first for r in rows if r.k == k) for k in range(len(texts)))
