"""Links between the tokens of two vocabularies over the same bytes, and how common each link is.

Both encodings of a text are turned into byte offsets at which their tokens end.
Where both end, a group of tokens closes. Stretches in which every token of one
is a token of the other lie on a diagonal: the places of the two arrays differ by
a constant shift. Such a stretch is run through in probes of doubling length
that compare the arrays at the shift, up to the first difference; there the
irregular group is closed by steps on the side that is behind, and the shift is
taken anew.

A document's links are kept as distinct id pairs with their number. Pairs are
counted over all documents on the executors; the most frequent ones, a bounded
table, go out to the workers, and links that are not in it meet their counts in a
join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.texts import pieces
from tabulario.llm.vocab import MOST_LETTERS, ByteLevel, PieceIds, joint_units
from tabulario.llm.workspace import Workspace

# Id pairs whose counts go out to the workers: 17 bytes each.
TABLE_PAIRS = 1 << 20
# Tokens of the first probe of a stretch.
PROBE = 8
# Units whose ids in both a worker keeps; a full table is begun anew.
MOST_UNITS = 400_000
# Links laid out at once, and pairs that a task holds before it sends their numbers on.
LINKS = 1 << 20
HELD = 1 << 21
_GROUPS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_HELD: dict[tuple, _Pair] = {}


def one_to_one(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches in which each token of one side is a token of the other: first places in both and length.

    `a` and `b` are the increasing offsets (unsigned 32-bit) at which tokens end,
    the last ones equal. Between two stretches lies one irregular group; a
    stretch may be empty. A probe compares both arrays as bytes; the lowest bit
    in which a failed one differs tells the first place that does.
    """
    i, j, n, m = 0, 0, len(a), len(b)
    x, y, p, q = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    starts_a, starts_b, lengths = [], [], []
    while True:
        first, probe = i, PROBE
        while i < n and j < m:
            step = min(probe, n - i, m - j)
            u, v = x[4 * i : 4 * (i + step)], y[4 * j : 4 * (j + step)]
            if u == v:
                i, j, probe = i + step, j + step, 2 * probe
                continue
            differ = int.from_bytes(u, "little") ^ int.from_bytes(v, "little")
            same = ((differ & -differ).bit_length() - 1) >> 5
            i, j = i + same, j + same
            break
        starts_a.append(first)
        starts_b.append(j - (i - first))
        lengths.append(i - first)
        if i == n:
            return np.array(starts_a, dtype=np.int64), np.array(starts_b, dtype=np.int64), np.array(lengths, dtype=np.int64)
        end_a, end_b = p[i], q[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = p[i]
            else:
                j += 1
                end_b = q[j]
        i, j = i + 1, j + 1


def borders(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where the groups of one side begin, and the end: those of the stretches one token each, the others between them."""
    # After each stretch but the last stands the end of the irregular group.
    size = lengths + 1
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(starts, size) + at


def byte_level_bytes() -> dict[str, int]:
    """The byte of each character of byte-level entries: printable ones stand for themselves, others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_level: tuple, piece_model: str):
        self.a, self.b = ByteLevel(*byte_level, literal=True), PieceIds(piece_model)
        of = byte_level_bytes()
        entries = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        model = self.b.model
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.b_bytes = [bytes([int(s[3:5], 16)]) if model.is_byte(k) else s.replace("▁", " ").encode() for k, s in enumerate(names)]
        self.a_length, self.b_length = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        self.known: dict[str, tuple[bytes, bytes] | tuple[None, None]] = {}

    def _same_bytes(self, text: str, a: bytes, b: bytes) -> bool:
        """Whether both sides give back a space and the text."""
        raw = (" " + text).encode()
        x, y = (np.frombuffer(ids, dtype=np.uint32).tolist() for ids in (a, b))
        return b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y))

    def _cut(self, ids: np.ndarray, length: np.ndarray, table: list[bytes], raw: bytes, ends: np.ndarray) -> list[bytes] | None:
        """The ids of each of the units that lie in a row in `raw`; None if they don't give it back unit by unit."""
        own = np.cumsum(length[ids])
        cut = np.searchsorted(own, ends, side="right")
        if not len(ids) or (own[cut - 1] != ends).any() or b"".join(map(table.__getitem__, ids.tolist())) != raw:
            return None
        flat = ids.astype(np.uint32).tobytes()
        at = [0, *(4 * cut).tolist()]
        return [flat[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def _learnt(self, units: list[str]) -> dict[str, tuple[bytes, bytes] | tuple[None, None]]:
        """Ids of the units in both, the shorter of which are kept; (None, None) for one whose bytes don't come back."""
        # All in one text, which is cut again where the units end; those that begin with white space could join the one before.
        units = [*(u for u in units if u[0] > " "), *(u for u in units if u[0] <= " ")]
        some = sum(u[0] > " " for u in units)
        new: dict[str, tuple[bytes, bytes] | tuple[None, None]] = {}
        if some and self.a.fast:
            raw = " " + " ".join(units[:some])
            ends = np.cumsum([len(u.encode()) + 1 for u in units[:some]])
            left = self._cut(np.array(self.a.fast.encode_ordinary(raw), dtype=np.int64), self.a_length, self.a_bytes, raw.encode(), ends)
            right = self._cut(np.array(self.b.model.encode(raw[1:], num_threads=1), dtype=np.int64), self.b_length, self.b_bytes, raw.encode(), ends)
            if left is not None and right is not None:
                new.update(zip(units, zip(left, right, strict=True)))
        rest = [u for u in units if u not in new]
        for u, b in zip(rest, self.b.encoded(rest), strict=True):
            ids = (self.a.unit(u), b)
            new[u] = ids if self._same_bytes(u, *ids) else (None, None)
        short = {u: ids for u, ids in new.items() if len(u) <= MOST_LETTERS}
        if len(self.known) + len(short) > MOST_UNITS:
            self.known = {}
        self.known.update(short)
        return new

    def _whole(self, text: str) -> tuple[bytes, bytes] | tuple[None, None]:
        ids = (self.a.ids(" " + text), self.b.ids([text])[0])
        return ids if self._same_bytes(text, *ids) else (None, None)

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none if it has none or its bytes don't come back."""
        units = [joint_units(t) if t else None for t in texts]
        get = self.known.get
        found = [None if u is None else list(map(get, u)) for u in units]
        open_ = [i for i, f in enumerate(found) if f is not None and None in f]
        if open_:
            new = self._learnt(list({u for i in open_ for u, ids in zip(units[i], found[i], strict=True) if ids is None}))
            for i in open_:
                found[i] = [new[u] if ids is None else ids for u, ids in zip(units[i], found[i], strict=True)]
        out = []
        for text, ids in zip(texts, found, strict=True):
            a = b = None
            if ids is not None:
                left, right = zip(*ids, strict=True)
                if None not in left:
                    a, b = b"".join(left), b"".join(right)
            elif text:
                a, b = self._whole(text)
            out.append((np.frombuffer(a or b"", dtype=np.uint32), np.frombuffer(b or b"", dtype=np.uint32)))
        return out

    def stretches(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return one_to_one(np.cumsum(self.a_length[a]).astype(np.uint32), np.cumsum(self.b_length[b]).astype(np.uint32))


def text_of(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> bytes:
    """a1,a2|b1;a3|b2,b3 for the groups with the given borders."""
    # Each token with the sign after it; tokens of B come after those of A of their group.
    numbers = np.empty(len(a) + len(b), dtype=np.int64)
    signs = np.full(len(numbers), ord(","), dtype=np.uint8)
    many, other = np.diff(left), np.diff(right)
    numbers[np.arange(len(a)) + np.repeat(right[:-1], many)] = a
    numbers[np.arange(len(b)) + np.repeat(left[1:], other)] = b
    signs[left[1:] + right[:-1] - 1] = ord("|")
    signs[left[1:] + right[1:] - 1] = ord(";")
    digits = np.ones(len(numbers), dtype=np.int64)
    power = 10
    while power <= numbers.max(initial=0):
        digits += numbers >= power
        power *= 10
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    out[ends - 1] = signs
    at, rest, left_over = ends - 2, numbers, digits
    while len(at):
        rest, digit = np.divmod(rest, 10)
        out[at] = digit + ord("0")
        more = np.flatnonzero(left_over > 1)
        at, rest, left_over = at[more] - 1, rest[more], left_over[more] - 1
    return out[:-1].tobytes()


def _added(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with their times added up."""
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), dtype=np.int64)
    np.add.at(total, place, np.concatenate(times))
    return code, total


def links(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links a * width + b of all groups and how often each occurs; `left` and `right` are the groups' borders.

    A group's links are all pairs of its tokens. They are laid out in bounded
    runs of groups; a larger group is taken by its distinct ids.
    """
    a, b = a.astype(np.int64) * width, b.astype(np.int64)
    many, other = np.diff(left), np.diff(right)
    size = many * other
    codes, times = [], []
    for g in np.flatnonzero(size > LINKS):
        (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a[left[g] : left[g + 1]], b[right[g] : right[g + 1]]))
        step = max(1, LINKS // len(y))
        for lo in range(0, len(x), step):
            codes.append((x[lo : lo + step, None] + y).ravel())
            times.append((n[lo : lo + step, None] * m).ravel())
    small = np.flatnonzero(size <= LINKS)
    cut = np.cumsum(size[small])
    lo = 0
    while lo < len(small):
        before = cut[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cut, before + LINKS, side="right")))
        g = np.repeat(small[lo:hi], size[small[lo:hi]])
        at = np.arange(len(g)) - np.repeat(np.r_[0, cut[lo : hi - 1] - before], size[small[lo:hi]])
        code, n = np.unique(a[left[g] + at // other[g]] + b[right[g] + at % other[g]], return_counts=True)
        codes.append(code)
        times.append(n)
        lo = hi
    return (codes[0], times[0].astype(np.int64)) if len(codes) == 1 and not (size > LINKS).any() else _added(codes, times)


def _held(byte_level: tuple, piece_model: str) -> _Pair:
    key = (byte_level, piece_model)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = _Pair(byte_level, piece_model)
    return _HELD[key]


def _aligned(byte_level: tuple, piece_model: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _held(byte_level, piece_model)
        width = len(both.b_bytes)
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for a, b in both.tokens(batch.column("text").to_pylist()):
                    if not len(a):
                        rows.append((0, 0, 0, 0, "", b"", b""))
                        continue
                    runs = both.stretches(a, b)
                    left, right = borders(runs[0], runs[2]), borders(runs[1], runs[2])
                    code, n = links(a, b, left, right, width)
                    sha = hashlib.sha256(text_of(a, b, left, right)).hexdigest()
                    rows.append((len(a), len(b), len(left) - 1, int(n.sum()), sha, code.astype(np.uint64).tobytes(), n.astype(np.uint64).tobytes()))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def _numbers(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64).view(np.int64) for x in blobs]


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each pair occurs."""

    def out(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pair", "n"])

    codes, times, size = [], [], 0
    for batch in batches:
        fresh = np.concatenate([np.empty(0, dtype=np.int64), *_numbers(batch.column(0).to_pylist())])
        codes.append(fresh)
        times.append(np.ones(len(fresh), dtype=np.int64))
        size += len(fresh)
        if size > HELD:
            code, n = _added(codes, times)
            if 2 * len(code) > HELD:
                yield out(code, n)
                codes, times, size = [], [], 0
            else:
                codes, times, size = [code], [n], len(code)
    if codes:
        yield out(*_added(codes, times))


_SUMS = "row long, n_best long, count_sum long, pairs binary, times binary"


def _looked_up(table: Broadcast) -> Callable:
    """What the table knows of each document's links, and the pairs that it doesn't know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            rows = []
            for code, n in zip(*(_numbers(batch.column(c).to_pylist()) for c in ("pairs", "times")), strict=True):
                at = np.searchsorted(known, code)
                met = at < len(known)
                met[met] = known[at[met]] == code[met]
                at, m = at[met], n[met]
                rows.append((int((m * best[at]).sum()), int((m * count[at]).sum()), code[~met].tobytes(), n[~met].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["row", "n_best", "count_sum", "pairs", "times"])

    return run


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, code, n in zip(batch.column("row").to_pylist(), *(_numbers(batch.column(c).to_pylist()) for c in ("pairs", "times")), strict=True):
            if len(code):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row)), pa.array(code), pa.array(n)], ["row", "pair", "times"])


def token_links(docs: DataFrame, byte_level: tuple[str, str, str], piece_model: str, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A are the tokens of a space and the text by a byte-level vocabulary (path of
    the tokenizer file, of the same vocabulary as ranks, its pattern), B those of
    the text by a SentencePiece BPE model, which adds the space. Groups, links
    and their counts are as in the module's text; a link is best if no other
    link of its A id is held by more documents. Null and empty texts, and those
    that one side doesn't give back byte for byte, have no tokens: all numbers
    are 0 and the hash is empty. Rows count as documents, repeated ones too; no
    documents give no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_aligned(byte_level, piece_model), _GROUPS)
    # Numbers of rows are as written, so a task that runs again changes none.
    rows = work.keep(rows.withColumn("row", F.monotonically_increasing_id()), "groups")
    width = len(_held(byte_level, piece_model).b_bytes)
    counts = rows.select("pairs").mapInArrow(_documents_of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = work.keep(counts.withColumn("a", F.expr(f"pair div {width}")), "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most as many rows as A has ids
    counts = work.keep(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(table_pairs).toArrow()  # at most `table_pairs` rows
    pair = top.column("pair").to_numpy()
    sort = np.argsort(pair)
    table = spark.sparkContext.broadcast((pair[sort], top.column("n").to_numpy()[sort], top.column("best").to_numpy()[sort]))
    sums = work.keep(rows.select("row", "pairs", "times").mapInArrow(_looked_up(table), _SUMS), "sums")
    rest = sums.where(F.octet_length("pairs") > 0).select("row", "pairs", "times").mapInArrow(_laid_out, "row long, pair long, times long")
    # Pairs outside the table are rarer than all in it, so no key of this join is frequent.
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    heads = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = heads.join(sums.select("row", "n_best", "count_sum"), "row").join(rest, "row", "left")
    none = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", none)).alias("count_sum"), "groups_sha256",
    )
