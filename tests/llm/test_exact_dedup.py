import hashlib
from collections import defaultdict

import pytest

from tabulario.llm import bloom, exact_dedup

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c " * 50_000), (7, "c " * 50_000), (8, "B"), (None, "b"), (3, "a"), (9, "b ")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_bits", [bloom.MOST_BITS, 1 << 16])
def test_groups(documents, clashing, most_bits):
    rows = ROWS + [(i, f"text {i % 4000}") for i in range(100, 9000)]
    got = exact_dedup.duplicate_groups(clashing(documents(*rows)), most_bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_rounds_when_the_filter_is_full(documents):
    rows = [(i, f"text {i % 7000}") for i in range(20_000)]
    got = exact_dedup.duplicate_groups(documents(*rows), 1 << 16)
    assert sum(r.kept for r in got.collect()) == 7000


def test_rows_that_stay(documents, clashing):
    docs = clashing(documents(*ROWS))
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, "b"), (3, "a"), (5, ""), (7, "c " * 50_000), (8, "B"), (9, "b ")]


def test_empty(documents):
    assert exact_dedup.duplicate_groups(documents()).count() == 0
    assert exact_dedup.drop_duplicates(documents()).count() == 0


def test_only_possible_repeats_are_split_off(spark):
    rows = spark.range(50_000).selectExpr("xxhash64(id % 49000) as h")
    again, single = bloom.split_repeated(rows, rows, "h", 50_000)
    assert again.count() + single.count() == 50_000
    assert single.select("h").distinct().count() == single.count()
    assert 2000 <= again.count() <= 3000
