"""Tokens of texts by public vocabularies, through tables of what was seen before.

A text is cut where no token can cross, at spaces, and the tokens of each unit
come from a table; only units that are not in it go to the tokenizer library.
The tables live in the Python worker, over tasks, and are bounded in entries and
in bytes: units that are longer than MOST_LETTERS are encoded each time.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable, Sequence

# Units kept by a worker; a full table is begun anew.
MOST_UNITS = 400_000
# Code points of a unit that a table keeps.
MOST_LETTERS = 64
# Texts with other characters than these, or with the special token, are left to the tokenizer as a whole. (Fixed values:
# characters whose class is the same in every version of Unicode.)
_PLAIN = re.compile(r"[^\t\n\r -~¡-ɏ–—‘’“”…]|<\|")
_GAPS = re.compile(r" [\t\n\r ]")


def joint_units(text: str) -> list[str] | None:
    """Units at whose spaces both kinds of vocabulary cut a text; None where they may differ."""
    if not text or text[0] == " " or text[-1] == " " or _PLAIN.search(text) or _GAPS.search(text):
        return None
    return text.split(" ")


class ByteLevel:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    A space before something that is no white space always begins a new unit of
    the vocabulary's split, so the words of a text with its spaces are encoded
    one by one. `ranks`, the same vocabulary as a rank file, speeds up words not
    seen before; without it the tokenizer does them all. Strings of special tokens
    in a text are those tokens, unless `literal` makes them plain text.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, literal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes() if self.fast else self._whole(text)

    def unit(self, word: str) -> bytes:
        """Ids of a space and a word of `joint_units`."""
        return self._plain(" " + word)

    def ids(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return self._whole(text)
        if _GAPS.search(text):
            return self._plain(text)
        words = text.split(" ")
        known = self.known
        rest = words[1:]
        got = list(map(known.get, rest))
        if None in got:
            for i, b in enumerate(got):
                if b is None:
                    b = known.get(rest[i])
                    if b is None:
                        b = self._plain(" " + rest[i])
                        if len(rest[i]) <= MOST_LETTERS:
                            if len(known) >= MOST_UNITS:
                                known.clear()
                            known[rest[i]] = b
                    got[i] = b
        return self._plain(words[0]) + b"".join(got)


_UNITS = re.compile(r" *[^ ]+| +$")


def piece_units(text: str) -> Sequence[str] | None:
    """Units of a text for a SentencePiece BPE model, without the space that begins each; None if it can't be cut.

    The model turns spaces into a mark that only begins pieces, and puts one
    before the text, so no piece goes from a word into the next space.
    """
    if "▁" in text or "\x00" in text:
        return None
    if not text:
        return ()
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in _UNITS.findall(" " + text)]
    return text.split(" ")


class PieceIds:
    """Ids of a SentencePiece BPE model, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, bytes] = {}

        # The model puts no space before an empty text, but an empty unit is a space.
        self.space = array("I", [self.model.piece_to_id("▁")]).tobytes()

    def encoded(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.model.encode(list(texts), num_threads=1)]

    def _learnt(self, units: list[str]) -> dict[str, bytes]:
        """Ids of the units, the shorter of which are kept for later texts."""
        new = dict(zip(units, self.encoded(units), strict=True))
        short = {u: b for u, b in new.items() if len(u) <= MOST_LETTERS}
        if len(self.known) + len(short) > MOST_UNITS:
            self.known = {}
        self.known.update(short)
        return new | {"": self.space}

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        units = [piece_units(t) for t in texts]
        get = self.known.get
        found = [None if u is None else list(map(get, u)) for u in units]
        open_ = [i for i, f in enumerate(found) if f is not None and None in f]
        if open_:
            missing = {u for i in open_ for u, b in zip(units[i], found[i], strict=True) if b is None}
            new = self._learnt([u for u in missing if u])
            for i in open_:
                found[i] = [new[u] if b is None else b for u, b in zip(units[i], found[i], strict=True)]
        return [self.encoded([t])[0] if f is None else b"".join(f) for t, f in zip(texts, found, strict=True)]


def whole_pieces(path: str) -> dict[str, int]:
    """Number of tokens of the units that are whole pieces of a SentencePiece model: the units that its vocabulary was made for.

    A table of at most as many entries as the model has pieces, of bounded length.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    units = [u for u in (name[1:] for name in names if name[:1] == "▁") if u and "▁" not in u and len(u) <= MOST_LETTERS]
    return dict(zip(units, map(len, model.encode(units, num_threads=1)), strict=True))


class PieceCounts:
    """Number of tokens by a SentencePiece model: a table of frequent units, a bounded table of others, then the library."""

    def __init__(self, path: str, frequent: dict[str, int]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent = frequent
        self.known = {"": 1, **frequent}

    def _learnt(self, units: Iterable[str]) -> dict[str, int]:
        """Counts of the units, the shorter of which are kept for later texts."""
        units = list(units)
        new = dict(zip(units, map(len, self.model.encode(units, num_threads=1)), strict=True))
        short = {u: n for u, n in new.items() if len(u) <= MOST_LETTERS}
        if len(self.known) + len(short) > MOST_UNITS + len(self.frequent):
            self.known = {"": 1, **self.frequent}
        self.known.update(short)
        return new

    def counts(self, texts: Sequence[str]) -> list[int]:
        units = [piece_units(t) for t in texts]
        get = self.known.get
        found = [None if u is None else list(map(get, u)) for u in units]
        open_ = [i for i, f in enumerate(found) if f is not None and None in f]
        missing: set[str] = set()
        for i in open_:
            missing.update(u for u, n in zip(units[i], found[i], strict=True) if n is None)
        if missing:
            new = self._learnt(missing)
            for i in open_:
                found[i] = [new[u] if n is None else n for u, n in zip(units[i], found[i], strict=True)]
        return [len(self.model.encode(t, num_threads=1)) if f is None else sum(f) for t, f in zip(texts, found, strict=True)]
