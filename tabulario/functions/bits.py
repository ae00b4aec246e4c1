"""Sets of small numbers as bits of a few longs, for presence over any number of periods.

A `Mask` stands for the columns `<name>0`, `<name>1`, ... of WORD bits each. One
aggregate makes it (`gather`), and patterns, gaps and first members are bit
operations, so a report's plan does not grow with the number of periods.
Members are numbered from 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of a word: all but the sign.
WORD = 63


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


@dataclass(frozen=True)
class Mask:
    """A subset of 1..n in the words given as columns."""

    words: tuple[Column, ...]
    n: int

    @classmethod
    def of(cls, name: str, n: int) -> Mask:
        return cls(tuple(F.col(f"{name}{w}") for w in range(-(-n // WORD))), n)

    @staticmethod
    def gather(number: Column, n: int, name: str) -> list[Column]:
        """Aggregates that make the mask `name` of the numbers of a group."""
        bit = F.call_function("shiftleft", _long(1), F.pmod(number - 1, F.lit(WORD)).cast("int"))
        return [F.bit_or(F.when(F.floor((number - 1) / WORD) == w, bit).otherwise(_long(0))).alias(f"{name}{w}") for w in range(-(-n // WORD))]

    def _width(self, w: int) -> int:
        return min(WORD, self.n - w * WORD)

    def _of(self, words) -> Mask:
        return Mask(tuple(words), self.n)

    def has(self, number: int) -> Column:
        return F.getbit(self.words[(number - 1) // WORD], F.lit((number - 1) % WORD)) == 1

    def empty(self) -> Column:
        return _all([w == 0 for w in self.words])

    def full(self) -> Column:
        return _all([w == _long((1 << self._width(i)) - 1) for i, w in enumerate(self.words)])

    def only(self, number: int) -> Column:
        return _all([w == _long(1 << (number - 1) % WORD if i == (number - 1) // WORD else 0) for i, w in enumerate(self.words)])

    def size(self) -> Column:
        total = F.bit_count(self.words[0])
        for w in self.words[1:]:
            total = total + F.bit_count(w)
        return total

    def without(self, other: Mask) -> Mask:
        return self._of(a.bitwiseAND(F.bitwise_not(b)) for a, b in zip(self.words, other.words, strict=True))

    def absent(self) -> Mask:
        return self._of(_long((1 << self._width(i)) - 1).bitwiseAND(F.bitwise_not(w)) for i, w in enumerate(self.words))

    def earlier(self) -> Mask:
        """Every member one number lower; 1 falls out."""
        shifted = []
        for i, w in enumerate(self.words):
            low = F.shiftright(w, 1)
            if i + 1 < len(self.words):
                low = low.bitwiseOR(F.shiftleft(self.words[i + 1].bitwiseAND(_long(1)), WORD - 1))
            shifted.append(low)
        return self._of(shifted)

    def first(self) -> Column:
        """The smallest member; NULL if there is none."""
        found = [F.when(w != 0, F.bit_count(w.bitwiseAND(-w) - 1) + 1 + i * WORD) for i, w in enumerate(self.words)]
        return found[0] if len(found) == 1 else F.coalesce(*found)

    def _members_of(self, i: int, word: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.lit(self._width(i) - 1)), lambda b: F.getbit(word, b) == 1)
        return F.transform(places, lambda b: b + (i * WORD + 1))

    def members(self) -> Column:
        """The members in order, as an array."""
        parts = [self._members_of(i, w) for i, w in enumerate(self.words)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def last(self) -> Column:
        return F.array_max(self.members())

    def text(self) -> Column:
        """'101' for {1, 3} of three."""
        return F.concat(*[F.reverse(F.lpad(F.bin(w), self._width(i), "0")) for i, w in enumerate(self.words)])

    def gapless(self) -> Column:
        """Whether the members follow each other: all but one have their successor's place taken."""
        return self.without(self.earlier()).size() <= 1
