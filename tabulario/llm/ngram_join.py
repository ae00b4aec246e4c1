"""Similarity join of documents on word shingles by prefixes under several token orders.

If two sets are alike enough, their prefixes under any common order of the
tokens share one: the first |x| - ceil(t |x|) + 1 tokens. Here ORDERS orders are
used, each by a hash of its own, with tokens that are frequent in the corpus
last. A pair is a candidate only if it shares a prefix token under every order;
only candidates are compared as a whole.

Documents with equal sets are one node. The nodes that share a prefix token under
the first order are a list, and lists with the same smallest node are put
together as one group, so that a group of near copies is one or two groups and
not one for each of its tokens. Prefixes are taken somewhat longer than needed
here: alike sets then share several tokens of theirs, a set that shares fewer with
all others together takes no part, and one that is in many groups leaves those
with the fewest of its tokens, up to less than half of what it needs. Groups are cut where sizes differ too
much. A group goes to one task with its sets, a large
one as pairs of tiles of at most TILE nodes on average. The task intersects the
filters of the other orders, compares the candidates, and gives the components
of the group's links, so neither candidates nor links become rows by the pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulario.llm.bloom import Filter, filters, split_repeated, where_state
from tabulario.llm.cells import CELLS, COUNTS, added_up, cell_of, counting
from tabulario.llm.components import components
from tabulario.llm.memory import giving_back, lean
from tabulario.llm.skew import join_groups
from tabulario.llm.texts import Words, mixed, pieces, window_hashes
from tabulario.llm.workspace import Workspace

SHINGLE = 4
PERCENT = 85
ORDERS = 3
ALL_ORDERS = (1 << ORDERS) - 1
# Nodes of a tile of a group on average, and of a part that holds smaller groups.
TILE = 1024
PART_NODES = 4096
# Prefixes for the lists are longer by one part in so many.
LENGTHENED = 2
# Nodes whose keys go out together (numbered in 16 bits), and nodes to a bucket of keys.
BLOCK_NODES, BUCKET_NODES = 4096, 4096
# Tokens of up to this many sets are counted by their pairs, others in matrices of so many columns.
FEW, COLUMNS = 8, 4096
# Bytes kept of a token's hash.
TOKEN = 6
# Odd, so multiplying by it is one to one on the hashes that are kept.
EVEN = 0x9E3779B97F4B
_SETS = "doc_id long, k long, n_shingles long, node long, tokens binary"


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // TOKEN
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :TOKEN] = np.frombuffer(blob, dtype=np.uint8).reshape(n, TOKEN)
    return out.view("<u8").ravel()


def _shingle_sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                words = Words(batch.column("text"), lower=True)
                every = window_hashes(words.hash, width)
                sizes, nodes, tokens = [], [], []
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    if b - a >= width:
                        h = every[a : b - width + 1]
                    else:  # all words as one shingle, apart from windows of the full width
                        h = mixed(window_hashes(words.hash[a:b], int(b - a)), 7) if b > a else every[:0]
                    h = np.unique(h)
                    sizes.append(len(h))
                    nodes.append(int(np.bitwise_xor.reduce(mixed(h, 11)) ^ mixed(np.array([len(h)], dtype=np.uint64), 12)[0]) if len(h) else 0)
                    tokens.append(_packed(h >> np.uint64(64 - 8 * TOKEN)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("k"), pa.array(sizes, pa.int64()), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(tokens, pa.binary())],
                    ["doc_id", "k", "n_shingles", "node", "tokens"],
                )

    return run


def _tokens_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield _unpacked(b"".join(batch.column("tokens").to_pylist()))


@dataclass(frozen=True)
class Nodes:
    """(node, n_shingles, tokens) of the different sets: those of `sets` that occur once, and `repeated` with one row each."""

    sets: DataFrame
    found: list[Filter]
    repeated: DataFrame

    def map(self, step: Callable, schema: str) -> DataFrame:
        """`step` over all of them, the filter being part of the same Python task."""
        parts = [self.sets.mapInArrow(giving_back(f.before("node", step)), schema) for f in self.found]
        return reduce(DataFrame.unionByName, parts, self.repeated.mapInArrow(giving_back(step), schema))

    def among(self, wanted: list[Filter]) -> DataFrame:
        """Nodes that may be among those of a filter."""
        parts = [where_state(self.repeated, wanted, "node", 1)]
        for f in self.found:
            for w in wanted:

                @F.pandas_udf("boolean")
                def both(node, f=f, w=w):
                    import pandas as pd

                    h = node.to_numpy().view(np.uint64)
                    return pd.Series((f.state(h) == 0) & (w.state(h) == 1))

                # Otherwise the test would be inferred for the other side of a later join as well.
                parts.append(self.sets.where(both.asNondeterministic()("node")))
        return reduce(DataFrame.unionByName, parts)


def frequency_classes(nodes: Nodes) -> np.ndarray:
    """For each counter 0 up to twice the mean load, then 1 for each further doubling; CELLS bytes at any size."""
    counts = added_up(nodes.map(counting(_tokens_of), COUNTS))
    mean = max(1.0, float(counts.sum()) / CELLS)
    return np.floor(np.log2(np.maximum(1.0, counts / mean))).astype(np.uint8)


def _prefix(n: int, percent: int) -> int:
    """Tokens of a prefix of n tokens: alike sets share one of theirs."""
    return n - -(-percent * n // 100) + 1


def _more(n: int, percent: int) -> int:
    """Tokens by which prefixes are lengthened for the lists: alike sets then share as many more."""
    return _prefix(n, percent) // LENGTHENED


def _needed(n: int, percent: int) -> int:
    """How many tokens of its lengthened prefix a set shares with any set that it is alike to, whose prefix may be shorter."""
    return _more(-(-percent * n // 100), percent) + 1


def _prefixes(tokens: np.ndarray, classes: np.ndarray, percent: int, more: int = 0) -> Iterator[np.ndarray]:
    """Keys (48 bits) of the prefix under each order, of `more` tokens above those that alike sets need to share one."""
    n = len(tokens)
    p = min(n, _prefix(n, percent) + more)
    rank = classes[cell_of(tokens)].astype(np.uint64) << np.uint64(48)
    for order in range(ORDERS):
        keys = mixed(tokens, 200 + order) >> np.uint64(16)
        if p < n:
            keys = keys[np.argpartition(rank | keys, p - 1)[:p]]
        yield keys


def _evenly(keys: np.ndarray) -> np.ndarray:
    """Other names of prefix keys, one to one: prefixes take the smallest keys, their names are spread over all 48 bits."""
    return keys * np.uint64(EVEN) & np.uint64((1 << 8 * TOKEN) - 1)


def _fits(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of such sizes can be alike enough."""
    return 100 * np.minimum(small, large) >= percent * np.maximum(small, large)


_PACKED = "keys binary, at binary, nodes binary, sizes binary"
_LOCAL = "bucket long, row long, keys binary, least binary, several binary"
_LEADERS = "row long, keys binary, leaders binary"
_MEMBERS = "leader long, node long, size long"


def _postings(classes: Broadcast, percent: int) -> Callable:
    """Blocks of up to BLOCK_NODES nodes: the keys of their prefixes under the first order in order, and whose they are."""

    def out(nodes: list[int], sizes: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(nodes)), [len(k) for k in keys])
        key = np.concatenate(keys)
        sort = np.argsort(key, kind="stable")
        columns = (_packed(key[sort]), at[sort].astype(np.uint16).tobytes(), np.array(nodes, dtype=np.int64).tobytes(), np.array(sizes, dtype=np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["keys", "at", "nodes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        sizes: list[int] = []
        keys: list[np.ndarray] = []
        for batch in batches:
            for node, blob in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = _unpacked(blob)
                nodes.append(node)
                sizes.append(len(tokens))
                keys.append(_evenly(next(_prefixes(tokens, classes.value, percent, _more(len(tokens), percent)))))
                if len(nodes) == BLOCK_NODES:
                    yield out(nodes, sizes, keys)
                    nodes, sizes, keys = [], [], []
        if nodes:
            yield out(nodes, sizes, keys)

    return run


def _entries(keys: bytes, at: bytes, nodes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places of their nodes, nodes, where each key's entries begin) of a block."""
    key, place = _unpacked(keys), np.frombuffer(at, dtype=np.uint16)
    return key, place, np.frombuffer(nodes, dtype=np.int64)[place], np.flatnonzero(np.r_[np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]])


def _sent(buckets: int) -> Callable:
    """What blocks tell of their keys, once each: the smallest node, and whether there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, *packed in zip(*(batch.column(c).to_pylist() for c in ("row", "keys", "at", "nodes")), strict=True):
                key, _, node, first = _entries(*packed)
                least = np.minimum.reduceat(node, first)
                several = np.diff(np.r_[first, len(key)]) > 1
                key = key[first]
                # Upper bits, in proportion: the keys of a bucket follow each other.
                cut = np.searchsorted((key >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                full = [(k, x, y) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                columns = (
                    pa.array([k for k, _, _ in full], pa.int64()), pa.array([row] * len(full), pa.int64()), pa.array([_packed(key[x:y]) for _, x, y in full], pa.binary()),
                    pa.array([least[x:y].tobytes() for _, x, y in full], pa.binary()), pa.array([np.packbits(several[x:y]).tobytes() for _, x, y in full], pa.binary()),
                )
                yield pa.RecordBatch.from_arrays(list(columns), ["bucket", "row", "keys", "least", "several"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a bucket its keys that several nodes have anywhere, with the smallest of them."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    keys = [_unpacked(r["keys"]) for r in rows]
    ends = np.cumsum([len(k) for k in keys])
    key = np.concatenate(keys)
    least = np.frombuffer(b"".join(r["least"] for r in rows), dtype=np.int64)
    several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], dtype=np.uint8), count=len(k)) for r, k in zip(rows, keys, strict=True)]).astype(bool)
    sort = np.argsort(key, kind="stable")
    key = key[sort]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    shared = np.empty(len(key), dtype=bool)
    leader = np.empty(len(key), dtype=np.int64)
    shared[sort] = np.repeat((size > 1) | np.logical_or.reduceat(several[sort], first), size)
    leader[sort] = np.repeat(np.minimum.reduceat(least[sort], first), size)
    out = [(r["row"], _packed(k[m]), lead[m].tobytes()) for r, k, m, lead in zip(rows, keys, np.split(shared, ends[:-1]), np.split(leader, ends[:-1]), strict=True) if m.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], ["row", "keys", "leaders"],
    )


def _members(percent: int) -> Callable:
    """(leader, node, size) of a block's nodes, once each, without nodes that share too few keys to be alike to any other.

    A node with many leaders also leaves those that it has few keys of.
    """

    def found(packed: pa.Table, answers: pa.Table) -> pa.Table:
        leaders = nodes = sizes = np.empty(0, dtype=np.int64)
        if packed.num_rows and answers.num_rows:
            key, place, node, _ = _entries(*(packed.column(c)[0].as_py() for c in ("keys", "at", "nodes")))
            size = np.frombuffer(packed.column("sizes")[0].as_py(), dtype=np.int64)
            known = np.concatenate([_unpacked(b) for b in answers.column("keys").to_pylist()])
            lead = np.frombuffer(b"".join(answers.column("leaders").to_pylist()), dtype=np.int64)
            sort = np.argsort(known, kind="stable")
            known, lead = known[sort], lead[sort]
            at = np.searchsorted(known, key)
            met = at < len(known)
            met[met] = known[at[met]] == key[met]
            needed = np.array([_needed(n, percent) for n in size.tolist()], dtype=np.int64)
            met &= (np.bincount(place[met], minlength=len(size)) >= needed)[place]
            leaders, place, count = _counted_rows(lead[at[met]], place[met].astype(np.int64))
            # Two alike sets share as many keys as either needs. If each leaves out groups with less than half of these keys in all,
            # its weakest ones, a group stays in which they meet.
            sort = np.lexsort((leaders, count, place))
            leaders, place, count = leaders[sort], place[sort], count[sort]
            running = np.cumsum(count)
            first = np.flatnonzero(np.r_[np.ones(min(1, len(place)), dtype=bool), place[1:] != place[:-1]])
            running -= np.repeat(running[first] - count[first], np.diff(np.r_[first, len(place)]))
            stay = running > (needed[place] - 1) // 2
            leaders, place = leaders[stay], place[stay]
            nodes, sizes = np.frombuffer(packed.column("nodes")[0].as_py(), dtype=np.int64)[place], size[place]
        return pa.table({"leader": pa.array(leaders, pa.int64()), "node": pa.array(nodes, pa.int64()), "size": pa.array(sizes, pa.int64())})

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        return lean(lambda: found(packed, answers))

    return run


def _counted_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of `a` and `b`, and how often each occurs."""
    sort = np.lexsort((b, a))
    a, b = a[sort], b[sort]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(a)), dtype=bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.diff(np.r_[first, len(a)])


def _shared(owner: np.ndarray, token: np.ndarray, m: int) -> np.ndarray:
    """How many tokens each two of `m` sets share, as an m x m matrix; (owner, token) are the distinct entries of the sets."""
    number = np.float32 if len(token) < 1 << 24 else np.float64  # whole numbers that the matrices keep exactly
    out = np.zeros((m, m), dtype=number)
    sort = np.argsort(token, kind="stable")
    token, owner = token[sort], owner[sort]
    start = np.flatnonzero(np.r_[np.ones(min(1, len(token)), dtype=bool), token[1:] != token[:-1]])
    count = np.diff(np.r_[start, len(token)])
    # Tokens of a few sets by their pairs, those of many as columns of matrices.
    few = np.repeat((count > 1) & (count <= FEW), count)
    o, t = owner[few], token[few]
    for step in range(1, FEW):
        i = np.flatnonzero(t[step:] == t[:-step])
        if not len(i):
            break
        np.add.at(out, (o[i], o[i + step]), 1)
    out += out.T
    many = np.flatnonzero(count > FEW)
    for lo in range(0, len(many), COLUMNS):
        some = many[lo : lo + COLUMNS]
        column = np.repeat(np.arange(len(some)), count[some])
        place = np.arange(len(column)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + np.repeat(start[some], count[some])
        held = np.zeros((m, len(some)), dtype=number)
        held[owner[place], column] = 1
        out += held @ held.T
    return out


def _spanning(links: np.ndarray) -> np.ndarray:
    """For each of the linked sets the smallest number that it is connected to."""
    label = np.arange(len(links))
    while True:
        least = np.minimum(label, np.where(links, label, len(label)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def linked(tokens: list[np.ndarray], sides: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of the sets are alike enough, as a matrix; with two tiles only pairs across them.

    A pair has to share a prefix token under each order before it is compared.
    """
    m = len(tokens)
    size = np.array([len(t) for t in tokens])
    able = _fits(size[:, None], size[None, :], percent)
    if sides.any() and not sides.all():
        able &= sides[:, None] != sides[None, :]
    np.fill_diagonal(able, False)
    prefixes = [list(_prefixes(t, classes, percent)) for t in tokens]
    for order in range(ORDERS):
        if not able.any():
            return able
        keys = [p[order] for p in prefixes]
        able &= _shared(np.repeat(np.arange(m), [len(k) for k in keys]), np.concatenate(keys), m) > 0
    rows = np.flatnonzero(able.any(axis=1))
    if len(rows):
        some = [tokens[i] for i in rows]
        both = _shared(np.repeat(np.arange(len(rows)), size[rows]), np.concatenate(some), len(rows))
        enough = 100 * both >= percent * (size[rows][:, None] + size[rows][None, :] - both)
        able[np.ix_(rows, rows)] &= enough
    return able


_EDGES = "a long, b long"


def _compared(classes: Broadcast, percent: int) -> Callable:
    """Edges that connect what the links of each group of a part connect: at most one for a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        group = table.column("leader").to_numpy()
        sort = np.argsort(group, kind="stable")
        cut = np.r_[0, np.flatnonzero(np.diff(group[sort])) + 1, len(sort)]
        node, side, blobs = table.column("node").to_numpy(), table.column("side").to_numpy(), table.column("tokens")
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            mine = sort[lo:hi]
            if hi - lo > 1:
                label = _spanning(linked([_unpacked(blobs[int(i)].as_py()) for i in mine], side[mine], classes.value, percent))
                away = np.flatnonzero(label != np.arange(len(label)))
                a.append(node[mine[away]])
                b.append(node[mine[label[away]]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _nodes(work: Workspace, sets: DataFrame, total: int) -> Nodes:
    """The different sets; only rows of sets that may occur again are shuffled."""
    full = sets.where(F.col("n_shingles") > 0).select("node", "n_shingles", "tokens")
    found = filters(full.select("node"), "node", total)
    return Nodes(full, found, work.keep(where_state(full, found, "node", 1).dropDuplicates(["node"]), "repeated"))


def _groups(work: Workspace, nodes: Nodes, classes: Broadcast, percent: int, total: int) -> DataFrame:
    """(leader, node, n) of groups that together hold every two nodes of a list; n is the size of the group.

    Blocks of nodes tell the smallest node of each of their keys and learn the
    smallest of all, so a key that very many nodes share costs a block one entry.
    A group all of whose nodes are in one other group is left out.
    """
    packed = work.keep(nodes.map(_postings(classes, percent), _PACKED).withColumn("row", F.monotonically_increasing_id()), "packed")
    buckets = max(1, -(-total // BUCKET_NODES))
    answers = packed.mapInArrow(giving_back(_sent(buckets)), _LOCAL).groupBy("bucket").applyInArrow(giving_back(_answered), _LEADERS)
    members = packed.groupBy("row").cogroup(answers.groupBy("row")).applyInArrow(_members(percent), _MEMBERS)
    # Sets of a group are in order of their sizes; where the next one is too large to be alike, a group of its own begins.
    by_size = Window.partitionBy("leader").orderBy("size", "node")
    before = F.lag("size").over(by_size)
    begins = F.when(before.isNull() | (before * 100 < F.col("size") * percent), F.col("node"))
    members = members.withColumn("first", F.last(begins, ignorenulls=True).over(by_size))
    members = work.keep(members.select(F.xxhash64("leader", "first").alias("leader"), "node"), "members")
    sizes = members.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # A group that has all its nodes in one other group, named by the smallest that any of them is in, is not needed.
    own = join_groups(members, sizes, "leader", "n", members.count())
    least = own.groupBy("node").agg(F.min("leader").alias("least"))
    groups = own.join(least, "node").groupBy("leader", "n").agg(F.min("least").alias("low"), F.max("least").alias("high"))
    needed = groups.where((F.col("low") != F.col("high")) | (F.col("low") == F.col("leader")))
    return join_groups(members, work.keep(needed.select("leader", "n"), "leaders"), "leader", "n", members.count())


def _dealt(groups: DataFrame, parts: int, tile: int) -> DataFrame:
    """Rows (part, leader, side, node): small groups many to a part, each pair of tiles of a large one a part of its own."""
    small = groups.where(F.col("n") <= tile).select(F.pmod(F.xxhash64("leader"), F.lit(parts)).alias("part"), F.lit(-1).alias("pair"), "leader", F.lit(0).alias("side"), "node")
    large = groups.where(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    large = large.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    large = large.withColumn("other", F.explode(other))
    pair = F.least("mine", "other") * F.col("tiles") + F.greatest("mine", "other")
    return small.unionByName(large.select(F.col("leader").alias("part"), pair.alias("pair"), "leader", (F.col("mine") > F.col("other")).cast("int").alias("side"), "node"))


def linked_nodes(work: Workspace, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all nodes with a link, from `sets` (_SETS)."""
    spark = sets.sparkSession
    total = sets.count()
    nodes = _nodes(work, sets, total)
    classes = spark.sparkContext.broadcast(frequency_classes(nodes))
    groups = work.keep(_groups(work, nodes, classes, percent, total), "grouped")
    work.drop("packed", "members")
    wanted = groups.select("node").distinct()
    # Each wanted node twice: the filter then tells what is among them.
    twice = wanted.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    needed = nodes.among(filters(twice, "node", twice.count())).select("node", "tokens")
    parts = max(1, -(-total // PART_NODES))
    dealt = _dealt(groups, parts, TILE).join(needed, "node")
    # Groups are little data and much work, so the number of partitions is given and not merged by size.
    dealt = dealt.repartition(parts, "part", "pair")
    edges = work.keep(dealt.groupBy("part", "pair").applyInArrow(giving_back(_compared(classes, percent)), _EDGES), "edges")
    return work.keep(components(edges), "labels")


def _sets(work: Workspace, docs: DataFrame, width: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k"), F.col("text"))
    return work.keep(rows.mapInArrow(giving_back(_shingle_sets(width)), _SETS), "sets")


def _grouped(work: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, component_id, label) of all sets that are not empty."""
    labels = linked_nodes(work, sets, percent)
    classes = sets.where(F.col("n_shingles") > 0).groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    classes = work.keep(classes.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "classes")
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return work.keep(join_groups(classes, least, "label", "n", classes.count()).select("node", "size", "component_id", "label"), "groups")


def join_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when their shingle sets have 100 |x & y| >= percent *
    |x | y|; a component is what links connect, named by its smallest doc_id
    (null ids aside). A null text counts as empty; an empty document links with
    nothing. No documents give no rows. A set is known by 64 bits of hash, a
    shingle by 48 bits in comparisons.
    """
    work = Workspace(docs.sparkSession)
    sets = _sets(work, docs, width)
    groups = _grouped(work, sets, percent)
    rows = sets.select("doc_id", "n_shingles", "node")
    full = join_groups(rows.where(F.col("n_shingles") > 0), groups, "node", "size", sets.count()).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` with one document of each component, that with the smallest doc_id.

    Documents without words, null texts included, all stay. Of rows that repeat id
    and text one stays; a null id comes after all others. Columns of any name are
    carried; no documents give no rows.
    """
    work = Workspace(docs.sparkSession)
    sets = _sets(work, docs, width)
    groups = _grouped(work, sets, percent)
    total = sets.count()
    rows = join_groups(sets.where(F.col("n_shingles") > 0).select("doc_id", "k", "node"), groups, "node", "size", total)
    # The null id comes after all others; of equal ids the row with the smallest hash.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k"))
    stay = work.keep(rows.groupBy("label").agg(first.alias("first"), F.count("*").alias("n")), "stay")
    several = stay.where(F.col("n") > 1)
    leave = work.keep(join_groups(rows.select("k", "label"), several, "label", "n", total).where(F.col("k") != F.col("first.k")).select("k").distinct(), "leave")
    again = work.keep(several.select(F.col("first.k").alias("k")), "again")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.struct(*docs.columns).alias("doc"))
    # Rows of components with several documents are told from the rest by a filter; the rest is not shuffled.
    asked = leave.unionByName(again)
    marked, rest = split_repeated(keyed, sets.select("k").unionByName(asked), "k", total + asked.count())
    kept = marked.join(leave, "k", "left_anti")
    single = kept.join(again, "k", "left_anti").unionByName(kept.join(again, "k", "left_semi").dropDuplicates(["k"]))
    return single.unionByName(rest).select("doc.*")
