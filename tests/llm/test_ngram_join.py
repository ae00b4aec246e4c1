import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm.tables import read
from tabulario.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), doc_id) if x is not None), default=None)
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


def corpus(seed, families=12, members=14, words=120):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(600)] + ["É", "a", "The"])
    rows = [(None, "null id here it is"), (1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "one two three four"), (6, " \n"), (7, "x " * 4000), (8, "x " * 3000), (9, "one two")]
    common = list(rng.choice(vocabulary, 40))
    i = 100
    for f in range(families):
        base = list(rng.choice(vocabulary, words))
        if f % 3 == 0:
            base[:40] = common
        for m in range(members):
            copy = list(base)
            for _ in range(rng.integers(0, 6)):
                copy[rng.integers(0, len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                base = copy  # families drift, so that links chain
            rows.append((i, " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
            i += int(rng.integers(1, 5))
    return rows + [(rows[20][0], rows[20][1]), (rows[30][0], "another text under a known id"), (10**12, rows[40][1])]


@pytest.mark.parametrize("seed, tile", [(0, 1024), (1, 4)])
def test_against_brute_force(documents, clashing, monkeypatch, seed, tile):
    """With small tiles every family is cut into many pairs of them."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "PART_NODES", 16 * tile)
    rows = corpus(seed)
    got = ngram_join.join_components(clashing(documents(*rows)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_whole_table(spark):
    docs = read(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in ngram_join.join_components(docs).collect()) == sorted(brute(rows))


def test_one_of_each(documents, clashing):
    rows = corpus(5)
    docs = clashing(documents(*rows))
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    want = brute(rows)
    empty = [(i, t) for i, t in rows if not shingles(t)]
    assert sorted((x for x in kept if not shingles(x[1])), key=repr) == sorted(empty, key=repr)
    full = [x for x in kept if shingles(x[1])]
    assert len(full) == len({(c, i if i is None else 0) for (i, n, c) in want if n})  # components have distinct names here
    assert Counter(i for i, _ in full).most_common(1)[0][1] <= 2
    assert set(full) <= set(rows)


def test_empty(documents):
    assert ngram_join.join_components(documents()).count() == 0
    assert ngram_join.one_of_each(documents()).count() == 0


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 3, ngram_join.CELLS).astype(np.uint8)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**48, rng.integers(1, 60), dtype=np.uint64))
        b = a.copy()
        b[: len(b) // 14] = rng.integers(0, 2**48, len(b) // 14, dtype=np.uint64)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * len(np.union1d(a, b)):
            for p, q in zip(ngram_join._prefixes(a, classes, 85), ngram_join._prefixes(b, classes, 85)):
                assert len(np.intersect1d(p, q))


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(2)
    for few, columns in ((8, 4096), (2, 3), (1, 1)):
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        for m in (1, 2, 7, 30):
            sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30), dtype=np.uint64)) for _ in range(m)]
            got = ngram_join._shared(np.repeat(np.arange(m), [len(s) for s in sets]), np.concatenate(sets), m)
            for i in range(m):
                assert [int(got[i, j]) for j in range(m) if j != i] == [len(np.intersect1d(sets[i], sets[j])) for j in range(m) if j != i]


def test_links_of_a_group_against_all_pairs():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 3, ngram_join.CELLS).astype(np.uint8)
    base = rng.integers(0, 2**48, 100, dtype=np.uint64)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.integers(0, 100, rng.integers(0, 14))] = rng.integers(0, 2**48, dtype=np.uint64)
        sets.append(np.unique(own))
    sides = np.arange(40) % 2
    for side in (np.zeros(40, dtype=int), sides):
        got = ngram_join.linked(sets, side, classes, 85)
        for i in range(40):
            for j in range(40):
                both = len(np.intersect1d(sets[i], sets[j]))
                want = i != j and 100 * both >= 85 * len(np.union1d(sets[i], sets[j])) and (not side.any() or side[i] != side[j])
                assert got[i, j] == want
    links = ngram_join.linked(sets, np.zeros(40, dtype=int), classes, 85)
    label = ngram_join._spanning(links)
    for i in range(40):
        reached, edge = {i}, {i}
        while edge:
            edge = {int(j) for x in edge for j in np.flatnonzero(links[x])} - reached
            reached |= edge
        assert label[i] == min(reached)


def test_lengthened_prefixes_of_linked_sets_share_enough():
    """The number that a node has to share is reached by all linked sets, of whatever sizes."""
    rng = np.random.default_rng(7)
    classes = rng.integers(0, 3, ngram_join.CELLS).astype(np.uint8)
    linked = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**48, rng.integers(1, 200), dtype=np.uint64))
        b = np.concatenate([a[rng.random(len(a)) < rng.choice([0.88, 0.95, 1.0])], rng.integers(0, 2**48, rng.integers(0, 1 + len(a) // 8), dtype=np.uint64)])
        b = np.unique(b) if len(b) else a
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * len(np.union1d(a, b)):
            linked += 1
            p, q = (next(ngram_join._prefixes(x, classes, 85, ngram_join._more(len(x), 85))) for x in (a, b))
            shared = len(np.intersect1d(p, q))
            assert shared >= ngram_join._needed(len(a), 85) and shared >= ngram_join._needed(len(b), 85)
    assert linked > 100


def test_buckets_of_keys_are_of_one_size():
    class Classes:
        value = np.zeros(1 << 20, dtype=np.uint8)

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 48, 400, dtype=np.uint64)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"node": list(range(300)), "tokens": [ngram_join._packed(s) for s in sets]})
    blocks = [b.append_column("row", pa.array([1], pa.int64())) for b in ngram_join._postings(Classes, 80)(iter([batch]))]
    sent = [len(r["keys"]) for b in ngram_join._sent(16)(iter(blocks)) for r in b.to_pylist()]
    # Prefixes take the smallest keys; without names spread evenly the first buckets of a corpus hold all.
    assert len(sent) == 16 and max(sent) < 1.3 * sum(sent) / 16
