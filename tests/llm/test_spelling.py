import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm.tables import read
from tabulario.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def vocabulary(rows):
    """Word counts, one run at a time."""
    seen = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    """Near words through all results of one deletion."""
    without = {}
    for w in counts:
        for i in range(len(w)):
            without.setdefault((w[:i] + w[i + 1 :]), set()).add((w, i))
    out, forms = {}, {}
    for w in counts:
        near = {v for i in range(len(w)) for v, j in without[w[:i] + w[i + 1 :]] if i == j and v != w}
        near |= {v for v, _ in without.get(w, ())} | {w[:i] + w[i + 1 :] for i in range(len(w)) if w[:i] + w[i + 1 :] in counts}
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
        out[w] = len(near)
    rows = set()
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, counts[w], out[w], counts[forms[w]] if forms[w] else None))
    return rows


def result(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(seed, words, letters="abéß"):
    """Texts over few letters, so that most words have near ones."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list(letters), rng.integers(4, 9))) for _ in range(words)]
    weight = rng.geometric(0.3, words).astype(float)
    return [(i, " ".join(rng.choice(pool, 60, p=weight / weight.sum()))) for i in range(40)]


@pytest.mark.parametrize("bucket_words", [1 << 15, 16, 3])
def test_against_brute_force(documents, bucket_words):
    rows = made_up(bucket_words, 300)
    want = brute(vocabulary(rows))
    assert len(want) > 100 and any(r[1] for r in want)
    assert result(spelling.spelling_variants(documents(*rows), bucket_words)) == want


def test_whole_table(spark):
    docs = read(spark, "documents")
    assert result(spelling.spelling_variants(docs)) == brute(vocabulary((r.doc_id, r.text) for r in docs.collect()))


def test_index_finds_all_with_one_error():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(5, 8))) for _ in range(400)})
    counts = dict.fromkeys(words, 3)
    alphabet = np.array([ord(c) for c in "abc"], dtype=np.uint32)
    index = spelling.Index(*spelling._symbols(words, alphabet))
    for w in words[:50]:
        found = set()
        for m in (len(w), len(w) - 1):
            text, length = spelling._symbols([w], alphabet)
            _, y, _ = spelling._with_one_error(index, text, np.zeros(1, dtype=np.int64), length, np.array([m // 2]), np.array([m < len(w)]))
            found |= {words[i] for i in y}
        near = {r[0] for r in brute(counts) if r[0] == w}
        assert near == {w} and w not in found
        # What shares the last half is found by this index; a plain edit-distance table is the check.
        want = {v for v in words if v != w and _one_edit(w, v) and w[len(w) - min(len(w), len(v)) // 2 :] == v[len(v) - min(len(w), len(v)) // 2 :]}
        assert want <= found and all(_one_edit(w, v) for v in found)


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_edge_cases(documents, clashing, spark):
    long = "x" * 5000
    rows = [
        (1, None), (2, ""), (3, " .,- 12345"), (4, "color color color colour colour colour colour colour colour"), (None, "Éclat éclat Éclat Éclat"),
        (5, f"{long} {long} {long} {long}y {long}y {long}y {long}y {long}y {long}y {long}y"), (6, "abcd abcd abcd abcde abcde"), (6, "abcde"),
        (7, "tie-ab" + " tieaa tieaa tieaa tieab tieab tieab tieac tieac tieac" * 3 + " tiea× tiea× tiea×"),
    ]
    want = brute(vocabulary(rows))
    assert {"color", "colour", "tieaa", long, long + "y"} <= {r[0] for r in want}
    assert result(spelling.spelling_variants(clashing(documents(*rows)))) == want
    assert result(spelling.spelling_variants(documents())) == set()
    assert result(spelling.spelling_variants(documents((1, "ab cd"), (2, None)))) == set()


def test_repeated_rows_count_each_time(documents):
    rows = [(1, "repeat repeats")] * 3
    assert result(spelling.spelling_variants(documents(*rows))) == brute(vocabulary(rows))


def test_chains_of_forms(documents):
    """Every form is twice as frequent, so roots are several steps away."""
    rows, word = [], "aaaaaaaaaa"
    for i in range(6):
        rows += [(1000 + 10 * i + k, " ".join([word] * (3 * 2**i))) for k in range(2)]
        word = word[:i] + "b" + word[i + 1 :]
    want = brute(vocabulary(rows))
    assert result(spelling.spelling_variants(documents(*rows), 4)) == want
    assert any(r[1] and r[1] != r[2] for r in want)
