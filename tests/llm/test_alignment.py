import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm.tables import read
from tabulario.llm import alignment, vocab
from tabulario.llm.queries import BYTE_BPE, PIECE_MODEL

A = Tokenizer.from_file(BYTE_BPE[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
DECODED = {c: bytes([b]) for c, b in alignment.byte_level_bytes().items()}
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain_groups(text):
    """Groups of (A ids, B ids) by the libraries and sets of offsets."""
    if not text:
        return []
    whole = (" " + text).encode()
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_bytes = [b"".join(DECODED[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
    both, out, low = sorted(set(ends[0]) & set(ends[1])), [], 0
    for high in both:
        out.append(tuple([k for k, e in zip(ids, at) if low < e <= high] for ids, at in zip((a, b), ends)))
        low = high
    return out


def brute(rows):
    made = [(i, plain_groups(t)) for i, t in rows]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in made]
    held = Counter(pair for c in linked for pair in c)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (i, groups), c in zip(made, linked):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()),
            sum(k for p, k in c.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in c.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


TEXTS = [
    None, "", " ", "a", "two  spaces   three ", "line\n\nbreak\t x", "<|endoftext|> <s> </s> <0x0A> <unk>", "▁ mark▁", "日本語 😀 é", "a\x00b", "same words", "same words",
    "x" * 3000, "=" * 777 + "-" * 333, "Ünïcödé wörds, naïve café", "word " * 2000, "unbelievably antidisestablishmentarianism 1234567890",
]


@pytest.mark.parametrize("table_pairs", [1 << 20, 20, 0])
def test_against_the_libraries(documents, clashing, table_pairs):
    rows = list(enumerate(TEXTS))
    assert result(alignment.token_links(clashing(documents(*rows)), BYTE_BPE, PIECE_MODEL, table_pairs)) == brute(rows)


def test_whole_table(spark):
    docs = read(spark, "documents")
    assert result(alignment.token_links(docs, BYTE_BPE, PIECE_MODEL)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_null_ids(documents):
    assert alignment.token_links(documents(), BYTE_BPE, PIECE_MODEL).count() == 0
    rows = [(None, "a b"), (None, "a b"), (1, None)]
    assert result(alignment.token_links(documents(*rows), BYTE_BPE, PIECE_MODEL)) == brute(rows)


def test_runs_and_irregular_groups():
    rng = np.random.default_rng(5)
    for _ in range(1000):
        n = int(rng.integers(1, 200))
        one = [k for k in range(1, n) if rng.random() < rng.choice([0.1, 0.5, 0.98])]
        two = one if rng.random() < 0.3 else [k for k in range(1, n) if (k in one) ^ (rng.random() < rng.choice([0.02, 0.3]))]
        a, b = [*one, n], [*two, n]
        starts_a, starts_b, lengths = alignment.one_to_one(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32))
        left, right = alignment.borders(starts_a, lengths), alignment.borders(starts_b, lengths)
        ends = sorted(set(a) & set(b))
        assert [a[i - 1] for i in left[1:]] == [b[j - 1] for j in right[1:]] == ends and left[0] == right[0] == 0
        assert [int(x) for x in lengths] and lengths.sum() <= len(ends)


def test_large_groups_are_laid_out_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 10)
    rng = np.random.default_rng(6)
    for _ in range(100):
        sizes = rng.integers(1, 8, (rng.integers(1, 12), 2))
        left, right = (np.r_[0, np.cumsum(sizes[:, k])] for k in (0, 1))
        a, b = rng.integers(0, 5, left[-1]).astype(np.uint32), rng.integers(0, 5, right[-1]).astype(np.uint32)
        code, n = alignment.links(a, b, left, right, 100)
        want = Counter(int(x) * 100 + int(y) for p, q, r, s in zip(left, left[1:], right, right[1:]) for x in a[p:q] for y in b[r:s])
        assert dict(zip(code.tolist(), n.tolist())) == dict(want)


def test_held_pairs_go_on(monkeypatch, documents):
    monkeypatch.setattr(alignment, "HELD", 8)
    rows = [(i, t) for i, t in enumerate(TEXTS[:8] * 3)]
    parts = alignment._documents_of
    import pyarrow as pa

    blobs = [np.array(x, dtype=np.uint64).tobytes() for x in ([1, 2, 3], [2, 3], list(range(20)), [], [3])]
    out = Counter()
    for batch in parts(iter([pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["pairs"]) for x in blobs])):
        out.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
    assert out == Counter(k for x in ([1, 2, 3], [2, 3], list(range(20)), [], [3]) for k in x) and rows


def test_units_longer_than_the_tables_keep(monkeypatch):
    monkeypatch.setattr(vocab, "MOST_LETTERS", 3)
    monkeypatch.setattr(vocab, "MOST_UNITS", 4)
    pair = (vocab.ByteLevel(*BYTE_BPE, literal=True), vocab.PieceIds(PIECE_MODEL))
    for text in ("abcd abcd ab ab c d e f abcdefgh", " lead", "x  y z ", "ab"):
        assert np.frombuffer(pair[0].ids(text), dtype=np.uint32).tolist() == A.encode(text, add_special_tokens=False).ids
        assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in pair[1].ids([text, "", text])] == [B.encode(text), [], B.encode(text)]
    assert all(len(u) <= 3 for p in pair for u in p.known)


def test_units_are_learnt_together_as_alone():
    pair = alignment._Pair(BYTE_BPE, PIECE_MODEL)
    units = ["the", "\nnew", "word\n", "x\n\ny", "é1", "...", "don't", "A" * 300, "\t", "12345", "\r\nz"]
    together = pair._learnt(list(units))
    for u in units:
        a, b = (np.frombuffer(ids, dtype=np.uint32).tolist() for ids in together[u])
        assert a == A.encode(" " + u, add_special_tokens=False).ids and b == B.encode(u)
    assert "A" * 300 not in pair.known and len(pair.known) == len(units) - 1


def test_texts_of_units_in_any_order():
    pair = alignment._Pair(BYTE_BPE, PIECE_MODEL)
    rng = np.random.default_rng(9)
    parts = ["a", "the", "\n", "foo\n", "\nbar", "é", "x.y", "  ", " ", "I'm", "2024", "ñandú"]
    for _ in range(300):
        texts = [" ".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(4)]
        for text, (a, b) in zip(texts, pair.tokens(texts)):
            want = plain_groups(text)
            assert a.tolist() == [k for x, _ in want for k in x] and b.tolist() == [k for _, y in want for k in y], repr(text)
            if len(a):
                runs = pair.stretches(a, b)
                left, right = alignment.borders(runs[0], runs[2]), alignment.borders(runs[1], runs[2])
                assert alignment.text_of(a, b, left, right).decode() == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
