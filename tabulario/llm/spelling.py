"""Words that differ by one letter, grouped under the most frequent spelling, by search in FM-indexes.

Two words that differ by one inserted, deleted or replaced code point share the
first or the last m // 2 code points, m being the length of the shorter one. So
each word registers under its first and its last half, for m its own length
(the other word is as long or longer) and for one less (the other is shorter),
and all partners of a pair meet in one shard. Shards are dealt to buckets, and a
bucket indexes its delimited words: suffixes of the text in order, the symbol
before each, and ranks of symbols by binary search. A search matches the half
next to the delimiter exactly and extends over the other half, allowing one
error, by intervals of suffix ranks. Halves at the end are searched in an index
of the words, halves at the beginning in one of the reversed words; these are the
two directions of the index. A delimiter closes every pattern, so no search has
to change its direction.

A shard with more words than a bucket should have is cut into tiles of index
words and of queries, each pair of which is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.llm.workspace import Workspace

# Fixed values of the contract: letters, which occurrences lose a letter, and bounds on words.
GAP = "[^A-Za-zÀ-ÿ]+"
DELETE_EVERY = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Registered words of a bucket on average, and the most of a shard that is not cut into tiles.
BUCKET_WORDS = 1 << 15
# Queries searched at once.
QUERIES = 1 << 12
# Intervals of up to this many ranks are read row by row, longer ones symbol by symbol.
NARROW = 32
BEGINNING, END = 0, 1
_NEAR = "word string, n_near long, best struct<less:long,word:string>"


def runs_of(text: Column) -> Column:
    """Maximal runs of letters, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of `docs` (doc_id, text) after the deletions; a null id counts as empty text."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs_of(F.col("text"))).alias("run"))
    # A deletion only shortens a run.
    runs = runs.where(F.length("run") >= LEAST_LETTERS)
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Index:
    """FM-index of distinct words, given by their symbols (1 and above) in a row and their lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        words = len(lengths)
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths - 1
        text = np.zeros(int(ends[-1]), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends - 1] = False
        text[inside] = symbols
        self.n, self.words = len(text), words
        # Every delimiter is a symbol of its own, so no suffix is compared beyond its word.
        rank = text + (words - 1)
        rank[ends - 1] = np.arange(words)
        base, width = np.int64(self.n + words + int(text.max())), 1
        while True:
            ahead = np.zeros(self.n, dtype=np.int64)
            ahead[: max(0, self.n - width)] = rank[width:]
            key = rank * base + ahead
            self.suffix = np.argsort(key)
            ordered = key[self.suffix]
            rank = np.empty(self.n, dtype=np.int64)
            new = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            rank[self.suffix] = new
            width *= 2
            if new[-1] == self.n - 1:
                break
        # The symbol before a suffix; before a word stands a delimiter.
        self.before = np.where(self.suffix > 0, text[self.suffix - 1], 0)
        by_symbol = np.argsort(self.before, kind="stable")
        self.ranks = self.before[by_symbol] * np.int64(self.n) + by_symbol
        self.alphabet = np.unique(symbols)

    def step(self, symbol: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Interval bounds after a symbol is put before the pattern: smaller symbols and the earlier ranks of the same."""
        return np.searchsorted(self.ranks, symbol * np.int64(self.n) + bound)

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which intervals hold a whole word, its number); distinct words make it at most one."""
        a, b = np.searchsorted(self.ranks, lo), np.searchsorted(self.ranks, hi)
        found = np.flatnonzero(b > a)
        return found, np.searchsorted(self.starts, self.suffix[self.ranks[a[found]]])

    def extensions(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, lo, hi) of every symbol that stands before the intervals, ordered by interval."""
        size = hi - lo
        narrow, wide = np.flatnonzero(size <= NARROW), np.flatnonzero(size > NARROW)
        own = np.repeat(narrow, size[narrow])
        row = np.arange(len(own)) - np.repeat(np.cumsum(size[narrow]) - size[narrow], size[narrow]) + lo[own]
        pair = np.unique(own * np.int64(1 << 21) + self.before[row])
        which = np.r_[pair >> 21, np.repeat(wide, len(self.alphabet))]
        symbol = np.r_[pair & ((1 << 21) - 1), np.tile(self.alphabet, len(wide))]
        keep = symbol > 0
        which, symbol = which[keep], symbol[keep]
        low, high = self.step(symbol, lo[which]), self.step(symbol, hi[which])
        keep = np.flatnonzero(high > low)
        keep = keep[np.argsort(which[keep], kind="stable")]
        return which[keep], symbol[keep], low[keep], high[keep]


def _with_one_error(index: Index, text: np.ndarray, start: np.ndarray, length: np.ndarray, half: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, shared) for every way to reach a word with one error before the last `half` symbols of a query.

    `shorter` queries look for words with a symbol less, others for words as
    long or with one more; `shared` is how many symbols stand before the error.
    """
    q = np.arange(len(start))
    p, lo, hi = length.copy(), np.zeros(len(q), dtype=np.int64), np.full(len(q), index.words, dtype=np.int64)
    for t in range(int(half.max(initial=0))):
        on = np.flatnonzero(half > t)
        symbol = text[start[on] + length[on] - 1 - t]
        lo[on], hi[on] = index.step(symbol, lo[on]), index.step(symbol, hi[on])
        p[on] -= 1
    on = np.flatnonzero(hi > lo)
    q, p, lo, hi = q[on], p[on], lo[on], hi[on]
    erred = []
    while len(q):
        less = shorter[q]
        at = np.flatnonzero(less & (p > 0))
        erred.append((q[at], p[at] - 1, lo[at], hi[at], p[at] - 1))
        # Queries with the same half share their intervals; each is extended once.
        at = np.flatnonzero(~less)
        distinct, of = np.unique(lo[at] * np.int64(index.n + 1) + hi[at], return_inverse=True)
        which, symbol, low, high = index.extensions(distinct // (index.n + 1), distinct % (index.n + 1))
        first = np.searchsorted(which, np.arange(len(distinct) + 1))
        many = np.diff(first)[of]
        state = np.repeat(at, many)
        child = np.arange(len(state)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[of], many)
        sq, sp, sl, sh, ss = q[state], p[state], low[child], high[child], symbol[child]
        erred.append((sq, sp, sl, sh, sp))
        inner = np.flatnonzero(sp > 0)
        other = inner[text[start[sq[inner]] + sp[inner] - 1] != ss[inner]]
        erred.append((sq[other], sp[other] - 1, sl[other], sh[other], sp[other] - 1))
        on = np.flatnonzero(p > 0)
        q, p, lo, hi = q[on], p[on] - 1, lo[on], hi[on]
        symbol = text[start[q] + p]
        lo, hi = index.step(symbol, lo), index.step(symbol, hi)
        on = np.flatnonzero(hi > lo)
        q, p, lo, hi = q[on], p[on], lo[on], hi[on]
    found = []
    q, p, lo, hi, shared = map(np.concatenate, zip(*erred, strict=True)) if erred else [np.empty(0, dtype=np.int64)] * 5
    while len(q):
        done = np.flatnonzero(p == 0)
        hit, word = index.whole(lo[done], hi[done])
        found.append((q[done[hit]], word, shared[done[hit]]))
        on = np.flatnonzero(p > 0)
        q, p, lo, hi, shared = q[on], p[on] - 1, lo[on], hi[on], shared[on]
        symbol = text[start[q] + p]
        lo, hi = index.step(symbol, lo), index.step(symbol, hi)
        on = np.flatnonzero(hi > lo)
        q, p, lo, hi, shared = q[on], p[on], lo[on], hi[on], shared[on]
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, dtype=np.int64),) * 3


def _symbols(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return np.searchsorted(alphabet, points).astype(np.int64) + 1, np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def _near(table: pa.Table) -> pa.Table:
    """Rows (_NEAR) for the queries of a bucket that have near words in its index.

    A pair that shares both halves is reported from the beginning only.
    """
    side = table.column("side")[0].as_py()
    order = slice(None, None, -1 if side == BEGINNING else 1)
    words = table.column("word").to_pylist()
    roles = zip(words, table.column("n").to_pylist(), table.column("indexed").to_pylist(), strict=True)
    counts = dict(sorted((w, n) for w, n, indexed in roles if indexed))
    asked = [(w, m) for w, m, asks in zip(words, table.column("m").to_pylist(), table.column("asks").to_pylist(), strict=True) if asks]
    if not counts or not asked:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best": pa.array([], pa.struct([("less", pa.int64()), ("word", pa.string())]))})
    names, n = list(counts), np.array(list(counts.values()), dtype=np.int64)
    alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32))
    index = Index(*_symbols([w[order] for w in names], alphabet))
    # Neighbours in the index are searched side by side.
    asked.sort(key=lambda a: a[0][::-1] if side == END else a[0])
    out_word, out_near, out_less, out_best = [], [], [], []
    for at in range(0, len(asked), QUERIES):
        some = asked[at : at + QUERIES]
        text, length = _symbols([w[order] for w, _ in some], alphabet)
        m = np.array([m for _, m in some], dtype=np.int64)
        q, y, shared = _with_one_error(index, text, np.cumsum(length) - length, length, m // 2, m < length)
        sort = np.lexsort((-shared, y, q))
        q, y, shared = q[sort], y[sort], shared[sort]
        once = np.flatnonzero(np.r_[np.ones(min(1, len(q)), dtype=bool), (q[1:] != q[:-1]) | (y[1:] != y[:-1])])
        q, y, shared = q[once], y[once], shared[once]
        if side == END:
            once = np.flatnonzero(shared < m[q] // 2)
            q, y = q[once], y[once]
        # `names` are in order, so the smaller number is the smaller word.
        sort = np.lexsort((y, -n[y], q))
        q, y = q[sort], y[sort]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(q)), dtype=bool), q[1:] != q[:-1]])
        out_word += [some[i][0] for i in q[first]]
        out_near.append(np.diff(np.r_[first, len(q)]))
        out_less.append(-n[y[first]])
        out_best += [names[i] for i in y[first]]
    best = pa.StructArray.from_arrays([pa.array(np.concatenate(out_less), pa.int64()), pa.array(out_best, pa.string())], ["less", "word"])
    return pa.table({"word": pa.array(out_word, pa.string()), "n_near": pa.array(np.concatenate(out_near), pa.int64()), "best": best})


def _registered(words: DataFrame, bucket_words: int) -> tuple[DataFrame, int]:
    """(rows side, tile, bucket, word, n, m, indexed, asks; number of buckets) for (word, n)."""
    buckets = max(1, -(-4 * words.count() // bucket_words))
    length = F.length("word")
    places = F.array(*[F.struct(F.lit(side).alias("side"), m.alias("m")) for side in (BEGINNING, END) for m in (length, length - 1)])
    rows = words.select("word", "n", F.explode(places).alias("place")).select("word", "n", "place.side", "place.m").where(F.col("m") >= LEAST_LETTERS)
    half = F.floor(F.col("m") / 2).cast("int")
    rows = rows.withColumn("shard", F.xxhash64("side", "m", F.when(F.col("side") == BEGINNING, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", -half, half))))
    # Fewer shards than registered words over bucket_words are cut.
    large = rows.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > bucket_words)
    large = F.broadcast(large.select("shard", F.ceil(F.col("size") / bucket_words).cast("int").alias("tiles")))
    rows = rows.join(large, "shard", "left")
    one = F.array(F.struct(F.lit(0).alias("tile"), F.lit(True).alias("indexed"), F.lit(True).alias("asks")))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    mine, theirs = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"), F.pmod(F.xxhash64("word", F.lit(1)), F.col("tiles")).cast("int")
    as_index = F.transform(every, lambda j: F.struct((mine * F.col("tiles") + j + 1).alias("tile"), F.lit(True).alias("indexed"), F.lit(False).alias("asks")))
    as_query = F.transform(every, lambda i: F.struct((i * F.col("tiles") + theirs + 1).alias("tile"), F.lit(False).alias("indexed"), F.lit(True).alias("asks")))
    rows = rows.withColumn("role", F.explode(F.when(F.col("tiles").isNull(), one).otherwise(F.concat(as_index, as_query))))
    bucket = F.when(F.col("tiles").isNull(), F.pmod("shard", F.lit(buckets))).otherwise(F.col("shard"))
    return rows.select("side", "role.tile", bucket.alias("bucket"), "word", "n", F.col("m").cast("long").alias("m"), "role.indexed", "role.asks"), buckets


def _roots(work: Workspace, forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form, by pointer doubling; forms at least double the count, so chains are short."""
    known, turn = work.keep(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        turn += 1
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = work.keep(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{turn}")
        moved = not further.where("moved").isEmpty()
        known = further.drop("moved")
        if not moved:
            return known


def spelling_variants(docs: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row per word of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of letters, some occurrences of which lose a letter (see
    `vocabulary`), of LEAST_LETTERS code points or more that occur LEAST_COUNT
    times or more. `n_near` counts the words that differ by exactly one inserted,
    deleted or replaced code point; `form` is the most frequent of them, the
    smallest in code-point order of equally frequent ones, if it is RATIO times
    as frequent as the word; `root` is where forms lead in the end, the word
    itself if it has none. Null and empty texts have no words; repeated rows
    count each time; no documents give no rows.
    """
    work = Workspace(docs.sparkSession)
    words = work.keep(vocabulary(docs.select("doc_id", "text")), "words")
    rows, buckets = _registered(words, bucket_words)
    # A bucket is little data and much work, so the number of partitions is given and not merged by size.
    dealt = rows.repartition(2 * buckets, "side", "tile", "bucket")
    near = dealt.groupBy("side", "tile", "bucket").applyInArrow(_near, _NEAR)
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    fit = form_n >= RATIO * F.col("n")
    out = work.keep(joined.select(
        "word", F.when(fit, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, form_n).alias("form_n"),
    ), "forms")
    roots = _roots(work, out.where(F.col("form").isNotNull()))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
