"""Benchmark passages in documents, found by winnowed k-grams and confirmed window by window.

A window is WINDOW consecutive words of an item. Both sides are winnowed alike:
of the k-grams of every WINDOW consecutive words the one with the smallest hash
is the window's fingerprint, the leftmost of equal ones. Equal windows have
equal fingerprints, so every shared span of WINDOW words or more is met by one.
Items with fewer words are one window; of such a window the k-gram is the whole.

The distinct item windows are read in rounds of a bounded number, so that what a
round broadcasts is bounded whatever the benchmark's size: first the round's
fingerprints, which let few places of the documents through, then its windows,
to which the hits are extended. Everything is DataFrame work, and only hits are
shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulario.llm.skew import join_groups
from tabulario.llm.workspace import Workspace

WINDOW = 10
# Words of a k-gram, half a window; a window has WINDOW - GRAM + 1 of them.
GRAM = 5
# Distinct item windows in a round, on average: three longs each go out to the workers.
ROUND_WINDOWS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What stands between words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and whatever is beyond ASCII, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _hashed(text: Column) -> Column:
    return F.transform(words_of(text), lambda word: F.xxhash64(word))


def _grams(words: int) -> Column:
    """Hashes of all runs of so many words, from the word hashes `h`; null if there is none."""
    at_each = F.sequence(F.lit(0), F.size("h") - words)
    return F.when(F.size("h") >= words, F.transform(at_each, lambda i: F.xxhash64(F.lit(words), *[F.get("h", i + j) for j in range(words)])))


def _with_grams(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """`rows` with an array g<n> of gram hashes for each window length n instead of the word hashes `h`."""
    return rows.withColumns({f"g{n}": _grams(GRAM if n == WINDOW else n) for n in lengths}).withColumn("n_words", F.size("h").cast("long")).drop("h")


def _fingerprint(n: int) -> Column:
    """The smallest gram hash of the window of `n` words at `at`.

    The lowest four bits hold the gram's place in the window: that makes the
    leftmost of equal ones the smallest, and equal windows agree on it. A window
    of fewer than WINDOW words is its own gram.
    """
    if n != WINDOW:
        return F.get(f"g{n}", F.col("at"))
    return F.least(*[F.get(f"g{n}", F.col("at") + i).bitwiseAND(F.lit(-16)) + i for i in range(WINDOW - GRAM + 1)])


def _windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """`rows` (g<n>, n_words, ...) for every window: at, length and fingerprint `f`; the arrays stay, for the rest to be read off.

    A row without windows gives one row with `at` -1, and so does every other row.
    """
    # Place -1 keeps the row itself; places run to the start of the last window of the shortest length.
    last = F.col("n_words").cast("int") - min(lengths)
    placed = rows.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))).alias("at"))
    length = F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths)))
    placed = placed.select("*", length.alias("length"))
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.col("n_words"))
    return placed.withColumn("f", F.coalesce(*[F.when(fits & (F.col("length") == n), _fingerprint(n)) for n in lengths]))


def _identity(lengths: list[int]) -> list[Column]:
    """The hashes of both halves of the window at a row's place; of a short window its own hash twice."""
    at = F.col("at")
    halves = [(n, F.get(f"g{n}", at), F.get(f"g{n}", at + WINDOW - GRAM if n == WINDOW else at)) for n in lengths]
    return [F.coalesce(*[F.when(F.col("length") == h[0], h[k]) for h in halves]).alias(f"w{k}") for k in (1, 2)]


def _item_windows(work: Workspace, items: DataFrame) -> tuple[list[int], DataFrame]:
    """(lengths, windows of the items): w1, w2, f, item_id."""
    hashed = work.keep(items.select(F.col("item_id"), _hashed(F.col("text")).alias("h")).where(F.size("h") > 0), "items")
    lengths = sorted(r["n"] for r in hashed.select(F.least(F.size("h"), F.lit(WINDOW)).alias("n")).distinct().collect())  # at most WINDOW numbers
    if not lengths:
        return [], hashed
    own = _windows(_with_grams(hashed, lengths), lengths).where(F.col("f").isNotNull() & (F.col("length") == F.least("n_words", F.lit(WINDOW))))
    return lengths, work.keep(own.select(*_identity(lengths), "f", "item_id").distinct(), "windows")


def _hits(work: Workspace, docs: DataFrame, lengths: list[int], windows: DataFrame, round_windows: int) -> DataFrame:
    """(k1, k2, doc_id, n_words, at, length, w1, w2): one row with `at` -1 for each row of `docs`, and its hits."""
    key = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2")]
    hashed = docs.select(*key, F.col("doc_id").cast("long").alias("doc_id"), _hashed(F.col("text")).alias("h"))
    hashed = _with_grams(hashed, lengths)
    head = ["k1", "k2", "doc_id", "n_words", "at", "length"]
    nothing = [F.lit(None).cast("long").alias(c) for c in ("w1", "w2")]
    if not lengths:
        return hashed.select("k1", "k2", "doc_id", "n_words", F.lit(-1).alias("at"), F.lit(WINDOW).alias("length"), *nothing)
    distinct = work.keep(windows.select("w1", "w2", "f").distinct(), "distinct")
    rounds = max(1, -(-distinct.count() // round_windows))
    found = []
    for r in range(rounds):
        mine = distinct.where(F.pmod("w1", F.lit(rounds)) == r)
        marks = F.broadcast(mine.select("f", F.lit(1).alias("_met")).distinct())
        placed = _windows(hashed, lengths).join(marks, "f", "left")
        row = (F.col("at") == -1) & (F.col("length") == lengths[0]) if r == 0 else F.lit(False)
        placed = placed.where(F.col("_met").isNotNull() | row).select(*head, *_identity(lengths))
        known = F.broadcast(mine.select("w1", "w2", F.lit(1).alias("_known")))
        found.append(placed.join(known, ["w1", "w2"], "left").where(F.col("_known").isNotNull() | (F.col("at") == -1)).select(*head, "w1", "w2"))
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, items: DataFrame, round_windows: int = ROUND_WINDOWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    `items` has (item_id, text). A document's word is hit if it lies in an
    occurrence of a window of some item. `n_items` counts the different item ids
    with such a window, `items_sha256` is of their texts in order, joined by
    commas (of the empty text if there are none). Null and empty texts have no
    words and no windows; an item without id hits words but is not listed. Rows
    that repeat id and text get the same result each; no documents give no rows.
    Words and each half of a window are known by 64
    bits of hash, a window of fewer than WINDOW words by 64 in all.
    """
    work = Workspace(docs.sparkSession)
    lengths, windows = _item_windows(work, items.select("item_id", "text"))
    found = work.keep(_hits(work, docs.select("doc_id", "text"), lengths, windows, round_windows), "found")
    rows = found.where("at = -1").select("k1", "k2", "doc_id", "n_words")
    none = F.lit(0).cast("long")
    clean = F.sha2(F.lit(""), 256)
    if not lengths:
        return rows.select("doc_id", "n_words", none.alias("n_hit"), none.alias("n_items"), clean.alias("items_sha256"), F.lit(False).alias("contaminated"))
    hits = work.keep(found.where("at >= 0").select("k1", "k2", "at", "length", "w1", "w2").distinct(), "hits")
    # Words of a hit that no earlier hit of the document covers.
    before = Window.partitionBy("k1", "k2").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest("at", F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = hits.select("k1", "k2", fresh.alias("fresh")).groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"))
    # Windows with the same items are one set; documents with the same sets share one list of items.
    items_of = windows.where(F.col("item_id").isNotNull()).groupBy("w1", "w2").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    sets = work.keep(items_of.withColumn("set", F.xxhash64("ids")), "sets")
    met = hits.select("k1", "k2", "w1", "w2").distinct().join(sets.select("w1", "w2", "set"), ["w1", "w2"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("set")).alias("sets"))
    met = work.keep(met.withColumn("combination", F.xxhash64("sets")), "met")
    combinations = met.groupBy("combination").agg(F.any_value("sets").alias("sets"), F.count("*").alias("n"))
    ids = combinations.select("combination", "n", F.explode("sets").alias("set")).join(sets.dropDuplicates(["set"]).select("set", "ids"), "set")
    ids = ids.select("combination", "n", F.explode("ids").alias("id")).distinct().groupBy("combination", "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    lists = work.keep(ids.select("combination", "n", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256")), "lists")
    listed = join_groups(met.select("k1", "k2", "combination"), lists, "combination", "n", met.count()).select("k1", "k2", "n_items", "items_sha256")
    results = covered.join(listed, ["k1", "k2"], "left")
    return rows.join(results, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", clean).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
