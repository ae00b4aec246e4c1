"""SentencePiece BPE encoding and decoding as a shortest path through a weighted transducer.

Three transducers are compiled from a model. The normaliser puts a mark before
the text and turns spaces into marks. The pieces are a trie whose paths read the
characters of a piece and write its id. The fallback reads any other character
and writes the ids of its bytes. Composed with a text they give a lattice of
pieces. An arc to a piece costs nothing if merging the two pieces' characters by
the model's priorities gives back just these two, else it costs infinitely much;
a sequence of pieces is the model's segmentation if and only if all neighbours
pass. So the shortest path in the tropical semiring is the segmentation, and one
predecessor a place is enough. Costs of pairs are worked out when first needed
and kept.

The lattice falls apart at words, since a mark only begins pieces; paths of
words are kept in a bounded table of the worker.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.texts import pieces
from tabulario.llm.vocab import MOST_LETTERS, piece_units

MARK = "▁"
# Entries kept of each table; a full one is begun anew.
MOST_WORDS = 500_000
MOST_PAIRS = 1_500_000
_END = ""
_MODELS: dict[str, Transducer] = {}


class Transducer:
    """Encoder and decoder of one model file (BPE, no character rewriting, with byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("a ﬁ  b", out_type=str) and model.decode(model.encode("a ﬁ  b")) != "a ﬁ  b":
            raise ValueError("the model rewrites characters")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [0] * 256
        self.written: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.written.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.written.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
            else:
                self.score[piece], self.id[piece] = model.get_score(i), i
                self.written.append(piece.replace(MARK, " ").encode())
        self.trie: dict = {}
        for piece in self.id:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[_END] = piece
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        """Neighbours merged by the highest score, the leftmost of equals, until none is a piece."""
        score = self.score.get
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _free(self, left: str, right: str) -> bool:
        """Whether the arc from one piece (or the start, as an empty one) to the next costs nothing."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merged(list(left + right)) == ([left, right] if left else [right])
        return known

    def path(self, text: str) -> list[str]:
        """Pieces on the shortest path of a normalised text; characters without a piece stand for themselves."""
        n = len(text)
        # The piece by which the one path of finite cost comes to each place; the start has an empty one.
        by: list[str | None] = ["", *[None] * n]
        known, free, trie = self.pairs.get, self._free, self.trie
        for a in range(n):
            before = by[a]
            if before is None:
                continue
            node = trie.get(text[a])
            b = a + 1
            if (node is None or _END not in node) and by[b] is None and free(before, text[a]):
                by[b] = text[a]
            while node is not None:
                piece = node.get(_END)
                if piece is not None and by[b] is None:
                    cheap = known((before, piece))
                    if cheap or (cheap is None and free(before, piece)):
                        by[b] = piece
                if b == n:
                    break
                node = node.get(text[b])
                b += 1
        out: list[str] = []
        while n:
            piece = by[n]
            if piece is None:
                raise ValueError("no path")
            out.append(piece)
            n -= len(piece)
        return out[::-1]

    def _ids(self, text: str) -> bytes:
        ids = array("I")
        for piece in self.path(text):
            known = self.id.get(piece)
            if known is None:
                ids.extend(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                ids.append(known)
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        units = piece_units(text)
        if units is None:
            return self._ids(MARK + text.replace(" ", MARK))
        get = self.words.get
        found = list(map(get, units))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    ids = self.words.get(units[i])
                    if ids is None:
                        ids = self._ids((MARK + units[i]).replace(" ", MARK))
                        if len(units[i]) <= MOST_LETTERS:  # so the table is bounded in bytes as well
                            if len(self.words) >= MOST_WORDS:
                                self.words.clear()
                            self.words[units[i]] = ids
                    found[i] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text that the ids write; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.written.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _model(path: str) -> Transducer:
    if path not in _MODELS:
        _MODELS[path] = Transducer(path)
    return _MODELS[path]


def _column(path: str, source: str, target: str, kind: pa.DataType, step: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for whole in batches:
            for batch in pieces(whole, source):
                made = pa.array([step(model, v) for v in batch.column(source).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, target])

    return run


def _encoded(model: Transducer, text: str | None) -> bytes:
    return model.encode(text or "")


def _decoded(model: Transducer, ids: bytes | None) -> str:
    return model.decode(ids or b"")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text, ids (little-endian unsigned 32-bit integers).

    `model` is the path of a model file on every machine. A null text counts as
    empty and has no ids. Texts are read whole; no documents give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_column(model, "text", "ids", pa.binary(), _encoded), "doc_id long, text string, ids binary")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """`rows` (doc_id, text, ids) with the text that the ids stand for as `decoded`; null ids stand for the empty text, other columns go."""
    return rows.select("doc_id", "text", "ids").mapInArrow(_column(model, "ids", "decoded", pa.string(), _decoded), "doc_id long, text string, ids binary, decoded string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_crc32, decoded_sha256, same (whether decoding gives the text back).

    A null text counts as empty, repeated rows come each time, no documents give no rows.
    """
    both = decode(encode(docs, model), model)
    return both.select(
        "doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same"),
    )
