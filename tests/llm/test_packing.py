import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tabulario.llm import packing
from tabulario.llm.queries import BYTE_BPE
from tabulario.llm.vocab import ByteLevel

TEXTS = [
    "", None, " ", "a", " a", "a ", "Hello world, it's  two\n\n spaces\t.", "<|endoftext|> x<|endoftext|>", "naïve — “quoted” … ça", "日本語 テキスト 😀 x", "don't'll 12ab  ",
    "x" * 9000, "word " * 5000, "\x1c \x1d a", "a b c", "<| x",
]


def expected(texts, capacity=2048):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = []
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return out


def check_layout(rows, capacity=2048):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces(documents, clashing):
    rows = packing.pack(clashing(documents(*enumerate(TEXTS))), *BYTE_BPE).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(TEXTS)
    check_layout(rows)


def test_without_rank_file(documents):
    rows = packing.pack(documents(*enumerate(TEXTS)), BYTE_BPE[0]).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected(TEXTS)


def test_whole_table(spark):
    from llm.tables import SF, read

    docs = read(spark, "documents")
    rows = packing.pack(docs, *BYTE_BPE).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == [(sorted(texts)[i], *x) for i, *x in expected([texts[i] for i in sorted(texts)])]
    assert check_layout(rows) <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1


def test_empty_and_repeated_rows(documents):
    assert packing.pack(documents(), *BYTE_BPE).count() == 0
    rows = packing.pack(documents((1, "a"), (1, "a"), (None, "a")), *BYTE_BPE).collect()
    assert len(rows) == 3 and check_layout(rows) == 1


def one_by_one(counts, capacity):
    """The method on single bins, as it is described."""
    left, bins = Counter({k: v for k, v in counts.items() if v}), []
    while left:
        room, bin_ = capacity, []
        while fit := [n for n in left if n <= room]:
            bin_.append(max(fit))
            room -= bin_[-1]
            left -= Counter([bin_[-1]])
        if room and len(bin_) > 1:
            small = bin_[-1]
            pairs = [(a + b, a, b) for a in left for b in left if a >= b and small < a + b <= room + small and left[a] >= 1 + (a == b)]
            if pairs:
                _, a, b = max(pairs)
                bin_[-1:] = [a, b]
                left += Counter([small])
                left -= Counter([a, b])
        bins.append(sorted(bin_))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_the_method_bin_by_bin(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 41, 150).tolist())
    plan, n = packing.packing_plan(counts, 40)
    bins = defaultdict(list)
    for length in counts:
        runs = sorted((r, s, o) for x, r, s, o in plan if x == length)
        for (r, s, o), end in zip(runs, [*[x[0] for x in runs[1:]], counts[length]]):
            for k in range(end - r):
                bins[s + k].append((o, length))
    assert len(bins) == n
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *[x for _, x in sorted(b)][:-1]]).tolist()
    assert sorted(sorted(x for _, x in b) for b in bins.values()) == one_by_one(counts, 40)


def test_units_equal_the_tokenizer():
    codec, tokenizer = ByteLevel(*BYTE_BPE), Tokenizer.from_file(BYTE_BPE[0])
    rng = np.random.default_rng(5)
    alphabet = ["a", "b", " ", " ", "\n", "'s", ".", "1", "é", "\t", "Z", "\xa0", "—", "ſ", "!?"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 14)))
        assert np.frombuffer(codec.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
