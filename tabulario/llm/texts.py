"""Words of many texts at once, as arrays.

A word is a run of bytes without white space (space and 9 to 13). Its hash is a
polynomial over its bytes modulo 2**64, scrambled; it depends on the bytes
alone, not on the place. Hashes of windows of words are polynomials over the
word hashes. Work goes in pieces of PIECE bytes cut between words, so a text of
any length needs a bounded number of arrays of PIECE entries beside its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

PIECE = 1 << 18
# Odd multipliers of the polynomials (any odd numbers do).
BASE = 0x9E3779B97F4A7C15
STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambled 64-bit values (the splitmix64 finaliser); one to one for a given seed."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, at least n of them."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, PIECE + 4096)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        held = (made[0], made[1])
        if size <= 8 * PIECE:
            _POWERS[base] = held
    return held


def window_hashes(h: np.ndarray, width: int, base: int = STEPS[0]) -> np.ndarray:
    """Hash of every `width` consecutive entries; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    step = max(PIECE, 4 * width)
    for lo in range(0, n, step):
        part = h[lo : lo + step + width - 1]
        up, down = _powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - width + 1
        out[lo : lo + m] = (total[width:] - total[:-width]) * down[:m]
    return mixed(out)


def _lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, cuts: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a separator; no run goes over a cut."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    inside = ~separator[data]
    fresh = np.empty(n, dtype=bool)
    fresh[0], fresh[1:] = True, ~inside[:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    fresh[cuts] = True
    last = np.empty(n, dtype=bool)
    last[-1], last[:-1] = True, ~inside[1:]
    last[cuts - 1] = True
    return np.flatnonzero(inside & fresh), np.flatnonzero(inside & last) + 1


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of every span; with `prefixes` a row for the spans and one for their first bytes, of so many at most."""
    out = np.empty((1 + len(prefixes), len(starts)), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        first = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        piece = data[first : ends[hi - 1]]
        if lower:
            piece = _lowered(piece)
        up, down = _powers(BASE, len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        a, b = starts[lo:hi] - first, ends[lo:hi] - first
        for row, most in enumerate((None, *prefixes)):
            out[row, lo:hi] = (total[b if most is None else np.minimum(b, a + most)] - total[a]) * down[a]
        lo = hi
    for row in range(len(out)):
        out[row] = mixed(out[row], (0, *prefixes)[row])
    return out if prefixes else out[0]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in a row and the n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[marks[0] : marks[-1]] if data is not None and len(marks) else np.empty(0, dtype=np.uint8)
    return raw, marks - marks[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes, or of one longer row."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths.astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """Words of the texts of a column: `hash` of all of them, text i has those from first[i] to first[i + 1]."""

    def __init__(self, column: pa.Array, lower: bool = False, separator: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
        self.data, self.marks = string_bytes(column)
        self.starts, self.ends = word_spans(self.data, self.marks, separator)
        self.hash = word_hashes(self.data, self.starts, self.ends, lower, prefixes)
        self.first = np.searchsorted(self.starts, self.marks, side="left")

    def windows(self, width: int, base: int = STEPS[0]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that starts at each word; whether it lies in one text."""
        h = np.zeros(len(self.hash), dtype=np.uint64)
        made = window_hashes(self.hash, width, base)
        h[: len(made)] = made
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return h, np.arange(len(self.hash)) + width <= self.first[1:][text]
