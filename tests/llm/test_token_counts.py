import numpy as np
import sentencepiece

from tabulario.llm import token_counts, vocab
from tabulario.llm.queries import PIECE_MODEL
from llm.tables import read

TEXTS = ["", None, " ", "  ", "a", " a", "a ", "two  spaces   three", "line\n\nbreak\t x", "<s> </s> <unk> <0x0A>", "▁ mark▁", "日本語 😀 é", "a\x00b", "x" * 20_000, "word " * 5000]


def test_counts(documents, clashing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = {r.doc_id: r for r in token_counts.token_counts(clashing(documents(*enumerate(TEXTS))), PIECE_MODEL).collect()}
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), t


def test_whole_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    docs = read(spark, "documents")
    want = {r.doc_id: len(model.encode(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECE_MODEL).collect()} == want


def test_empty_and_null_ids(documents):
    assert token_counts.token_counts(documents(), PIECE_MODEL).count() == 0
    assert [r.n_tokens for r in token_counts.token_counts(documents((None, "a b"), (None, "a b")), PIECE_MODEL).collect()] == [2, 2]


def test_no_exchange_and_one_pass(documents):
    plan = token_counts.token_counts(documents((1, "a b")), PIECE_MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_first_tier_is_what_the_library_counts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    tier = vocab.whole_pieces(PIECE_MODEL)
    assert 1000 < len(tier) <= model.get_piece_size() and max(map(len, tier)) <= vocab.MOST_LETTERS
    assert all(tier[u] == len(model.encode(u)) for u in list(tier)[::50])


def test_texts_of_one_long_unit_are_not_kept():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    counts = vocab.PieceCounts(PIECE_MODEL, {})
    texts = ["日本" * 400, "a" * 65, "b" * 64, "x" * 5000 + " short", "日本" * 400]
    assert counts.counts(texts) == [len(x) for x in model.encode(texts)]
    assert set(counts.known) == {"", "b" * 64, "short"}


def test_full_tables_begin_anew(monkeypatch):
    monkeypatch.setattr(vocab, "MOST_UNITS", 5)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    counts = vocab.PieceCounts(PIECE_MODEL, {"the": 1})
    rng = np.random.default_rng(1)
    for _ in range(200):
        texts = ["".join(rng.choice([" ", "ab", "c", "the", "é", "\n", "ü"], rng.integers(0, 12))) for _ in range(3)]
        assert counts.counts(texts) == [len(x) for x in model.encode(texts)]
