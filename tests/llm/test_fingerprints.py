import hashlib

import numpy as np

from tabulario.llm import fingerprints as fp
from llm.tables import read


def plain_anchors(text):
    """By the definition, one substring at a time; only the hash is the library's."""
    if not text:
        return []
    if len(text) < fp.K:
        return [fp.short_hash(text)]
    points = np.array([ord(c) for c in text], dtype=np.uint64) + np.uint64(1)
    inner, whole = fp.window_hashes(points, fp.S).tolist(), fp.window_hashes(points, fp.K).tolist()
    span = fp.K - fp.S + 1
    first = {}
    for i, h in enumerate(whole):
        least = min(inner[i : i + span])
        if least in (inner[i], inner[i + span - 1]):
            first.setdefault(h >> 32, i)
    low = sorted(first)
    kept = set(low[:64]) | {h for h in low if h < 2**32 // 16}
    return sorted(kept, key=first.get)


def plain_likeness(a, b):
    """Longest common subsequence over all that both lists are complete for."""
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    known = min(max(max(x), 2**32 // 16 - 1) if len(x) >= 64 else 2**32 for x in (a, b))
    both = {h for h in (*a, *b) if h <= known}
    x, y = [h for h in a if h <= known], [h for h in b if h <= known]
    row = [0] * (len(y) + 1)
    for h in x:
        new = [0]
        for j, k in enumerate(y):
            new.append(row[j] + 1 if h == k else max(row[j + 1], new[j]))
        row = new
    return row[-1] / len(both) if both else 0.0


def as_hex(marks):
    return "".join(f"{h:08x}" for h in marks)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        own, following = texts[k], texts[(k + 1) % len(texts)]
        n = len(own) // 4
        edited = own[: len(own) - n] + following[:n]
        a, b, c = plain_anchors(own), plain_anchors(edited), plain_anchors(following)
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), as_hex(a), as_hex(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=repr)


def test_edge_rows(documents, clashing):
    rows = [(5, "short"), (2, ""), (3, None), (9, "é" * 5000), (None, "no id"), (7, "x" * 16), (7, "tie of an id"), (7, "x" * 16), (2**60 + 1, "big id"), (-4, "negative id, first of all"), (40, "end " * 9)]
    got = fp.fingerprints(clashing(documents(*rows)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_whole_table(spark):
    docs = read(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in fp.fingerprints(docs).collect()), key=repr)
    assert got == brute(rows)
    assert np.mean([r[5] for r in got]) > 0.4 and np.mean([r[6] for r in got]) < 0.1


def test_one_and_none(documents):
    assert fp.fingerprints(documents()).count() == 0
    [row] = fp.fingerprints(documents((1, "the only one is its own next one"))).collect()
    assert row.near_next == 1.0


def test_syncmers_have_their_least_inner_substring_at_an_edge():
    codes = fp._codes("the quick brown fox jumps over the lazy dog and runs away from it all")
    inner = fp.window_hashes(codes.astype(np.uint64) + np.uint64(1), fp.S)
    whole = fp.window_hashes(codes.astype(np.uint64) + np.uint64(1), fp.K)
    span = fp.K - fp.S + 1
    want = [whole[i] for i in range(len(whole)) if min(inner[i : i + span]) in (inner[i], inner[i + span - 1])]
    assert fp._syncmers(codes).tolist() == want


def test_anchors_do_not_depend_on_the_surroundings():
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh "), 300))
    a, b = (set(fp._syncmers(fp._codes(x + passage + y)).tolist()) for x, y in (("one ", " two"), ("something else", "")))
    assert set(fp._syncmers(fp._codes(passage)).tolist()) <= a & b


def test_order_counts():
    a = np.arange(10, 50, dtype=np.uint32)
    assert fp.likeness(a, a) == 1.0
    assert fp.likeness(a, a[::-1].copy()) == 1 / 40
    assert fp.likeness(a, np.concatenate([a[20:], a[:20]])) == 0.5


def test_a_shared_passage_shows_in_texts_of_any_length():
    rng = np.random.default_rng(8)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(3000)])
    for _ in range(4):
        passage = " ".join(rng.choice(words, 400))
        a, b = (" ".join(rng.choice(words, 10_000)) + " " + passage + " " + " ".join(rng.choice(words, 10_000)) for _ in range(2))
        assert len(fp.anchors(a)) > 500
        assert 0.003 < fp.likeness(fp.anchors(a), fp.anchors(b)) < 0.1
