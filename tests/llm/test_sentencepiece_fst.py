import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece

from llm.tables import read
from tabulario.llm import sentencepiece_fst as fst
from tabulario.llm.queries import PIECE_MODEL

TEXTS = ["", None, " ", "   ", "a", " a ", "two  spaces" + " " * 40 + "many", "line\n\nbreak\t x", "<s> </s> <unk> <0x0A>", "日本語 テキスト 😀 é ﬁ", "a\x00b", "x" * 3000, "word " * 5000, "def f(x):\n        return x + 1_000"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def transducer():
    return fst.Transducer(PIECE_MODEL)


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


def test_texts(model, transducer):
    for t in TEXTS:
        assert ids(transducer.encode(t or "")) == model.encode(t or ""), t
        assert transducer.decode(transducer.encode(t or "")) == (t or "") == model.decode(model.encode(t or ""))


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(model, transducer, seed):
    rng = np.random.default_rng(seed)
    alphabets = [list("ab c"), list("etaoin shrdlu"), ["the", "ing", " ", "tion", "s", "ed", "  "], [chr(c) for c in range(32, 0x250)], [chr(c) for c in range(0x3040, 0x3100)] + [" "], list("    \n\t▁x1")]
    for _ in range(300):
        text = "".join(rng.choice(alphabets[seed], rng.integers(0, 40)))
        assert ids(transducer.encode(text)) == model.encode(text), repr(text)


def test_pieces_of_the_model(model, transducer):
    rng = np.random.default_rng(9)
    pieces = [model.id_to_piece(int(i)) for i in rng.integers(259, 32000, 4000)]
    for a, b, c in zip(pieces[::3], pieces[1::3], pieces[2::3]):
        text = (a + b + c).replace("▁", " ")
        assert ids(transducer.encode(text)) == model.encode(text), repr(text)


def test_full_tables_begin_anew(model, monkeypatch):
    monkeypatch.setattr(fst, "MOST_WORDS", 3)
    monkeypatch.setattr(fst, "MOST_PAIRS", 5)
    own = fst.Transducer(PIECE_MODEL)
    text = "several different words of some length, again several different words"
    assert ids(own.encode(text)) == model.encode(text)


def test_whole_table(spark, model):
    docs = read(spark, "documents")
    got = {r.doc_id: r for r in fst.round_trip(docs, PIECE_MODEL).collect()}
    for r in docs.collect():
        want = np.array(model.encode(r.text), dtype="<u4")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_crc32, g.decoded_sha256, g.same) == (len(want), zlib.crc32(want.tobytes()), hashlib.sha256(r.text.encode()).hexdigest(), True)


def test_edge_rows(documents, clashing):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "▁"), (3, "▁")]
    got = fst.round_trip(clashing(documents(*rows)), PIECE_MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.same) for r in got) == [(0, 2, True), (1, 0, True), (2, 0, True), (3, 1, False), (3, 1, False)]
    assert fst.round_trip(documents(), PIECE_MODEL).count() == 0
