"""Exact Jaccard join of word shingles with a count-vector R-tree.

Shingles are hashed into groups; a text is the point of its group counts. For two texts the shared shingles of a group
are at most the smaller count, so the sum of coordinate minima bounds the overlap, and the same sum over the upper
corners of two R-tree nodes bounds it for all their pairs. Larger sets have more groups; points are folded onto fewer groups to be
compared; nodes use the fewest of their run, NODE_GROUPS at most. Only pairs that the bound leaves are verified, on whole sets.

How it is spread over a cluster without losing a link:

1. Texts with equal sets become one class.
2. The classes' shingles are counted by hash range: blocks of texts send sorted 48-bit ids, ranges reply which are shared and how often.
   Under the order "rarer first" linked sets share one of their first n - ceil(3n/4) + 1 shingles, and the smaller set has it among its
   first n - ceil(6n/7) + 1 (Chaudhuri et al.'s prefix filter with the size-aware prefix of Bayardo et al.). Shingles of one class only
   come first and bring nobody together, so a text with enough of its own is done, and shared passages come last.
3. Texts that share such a shingle, one of them in its short prefix, form a run; runs with equal members are kept once. A run is the root
   of an R-tree.
4. In each of ROUNDS rounds every text is held against one pivot of its runs, the one it meets in most of them, if the bound allows. This
   links the members of large groups of copies with one comparison for each text.
5. Runs that still span several components are joined by their R-tree; pairs within one component are skipped, since
   they cannot change the result. Large runs are cut into blocks, and pairs of blocks with one and the same component are left out.
   Where the trees of a pair of blocks leave more pairs than texts, the texts are sent on instead of the pairs: their whole sets meet in
   one task (cut into units by their shingles), which verifies what the bound leaves there and returns only links that join two components.
   Of the other pairs that are left between two components one is verified, then 4, 16, ... more, until a link joins the two or no pair is left.

Edge cases: null and empty texts have size 0 and are linked with nothing; texts under five words are one shingle; equal
texts are always linked unless empty; repeated rows are copies; an id that is repeated with another text, or is null, is a text like any
other, and a component is named by its smallest id that is not null (null if it has none); an empty table gives no rows; other
columns are ignored. Words, shingles and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialise, ship
from ._words import hashed_rows, mix, releasing
from .graph import components

WIDTH = 5
GROUPS, MOST_GROUPS = 64, 1 << 11
NODE_GROUPS = 256
LEAF = 32
ROUNDS = 3
_SALTS = 8


class Sizes(NamedTuple):
    """How the work is cut; other sizes give the same result."""

    block_items: int = 1 << 20  # shingles of a block of texts
    range_items: int = 1 << 20  # shingles of a hash range
    tree_rows: int = 1024  # texts of a block of a run
    few: int = 2_000_000  # the longest list of keys that is broadcast


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    n = len(words)
    if n == 0:
        return words
    step = min(n, width)
    value = np.full(n - step + 1, step, np.uint64)
    for j in range(step):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[j : n - step + 1 + j])
    return np.unique(value)


def sets_of(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The shingle set of each row of a string column."""
    for low, high, hashes, offsets in hashed_rows(column):
        for k in range(high - low):
            yield shingles(hashes[offsets[k] : offsets[k + 1]], width)


def point_of(found: np.ndarray) -> np.ndarray:
    """Counts by group of hash bits: at most a shingle to a group on average, from GROUPS to MOST_GROUPS groups, a power of two.

    With few shingles to a group the bound is near the true overlap. Sets beyond 32 * MOST_GROUPS have more groups, which keeps
    counts far below what 8 bits hold.
    """
    groups = GROUPS
    while groups < len(found) and groups < MOST_GROUPS or 32 * groups < len(found):
        groups *= 2
    return np.bincount((found >> np.uint64(20) & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int8)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same counts over fewer groups."""
    return point if len(point) == groups else point.reshape(-1, groups).sum(axis=0)


def overlap_bound(p: np.ndarray, q: np.ndarray) -> int:
    """The sum of coordinate minima, over the groups that both points have."""
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum(dtype=np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def enough(bound: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether an overlap bound can reach 0.75 for sets of so many shingles in sum."""
    return 7 * bound >= 3 * total


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (4 * a >= 3 * b) & (4 * b >= 3 * a)


class Node:
    """Points below it, their upper corner, range of sizes, and their component if it is only one."""

    __slots__ = ("rows", "high", "small", "large", "only", "parts")

    def __init__(self, rows: np.ndarray, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        self.rows, self.high = rows, points[rows].max(axis=0)
        self.small, self.large = sizes[rows].min(), sizes[rows].max()
        self.only = comps[rows[0]] if (comps[rows] == comps[rows[0]]).all() else None
        self.parts: list[Node] = []
        if len(rows) > LEAF:
            below = points[rows]
            spread = below.max(axis=0).astype(np.int64) - below.min(axis=0)
            axis = int(np.argmax(below.var(axis=0))) if spread.any() else 0
            order = np.argsort(below[:, axis] if spread.any() else sizes[rows], kind="stable")
            half = len(rows) // 2
            self.parts = [Node(rows[order[:half]], points, sizes, comps), Node(rows[order[half:]], points, sizes, comps)]


def tree_join(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of different components that the bound leaves; with sides, only pairs of different sides."""
    left, right = [], []

    def root(rows: np.ndarray) -> Node | None:
        return Node(rows, points, sizes, comps) if len(rows) else None

    everything = np.arange(len(points))
    if sides is None:
        a = b = root(everything)
    else:
        a, b = root(everything[sides == 0]), root(everything[sides == 1])
    stack = [(a, b)] if a is not None and b is not None else []
    while stack:
        a, b = stack.pop()
        if a.only is not None and a.only == b.only:
            continue
        if 4 * a.large < 3 * b.small or 4 * b.large < 3 * a.small:
            continue
        if a is not b and 7 * int(np.minimum(a.high, b.high).sum(dtype=np.int64)) < 3 * int(a.small + b.small):
            continue
        if not a.parts and not b.parts:
            bound = np.minimum(points[a.rows][:, None, :], points[b.rows][None, :, :]).sum(axis=2, dtype=np.int64)
            keep = enough(bound, sizes[a.rows][:, None] + sizes[b.rows][None, :]) & similar_sizes(sizes[a.rows][:, None], sizes[b.rows][None, :]) & (comps[a.rows][:, None] != comps[b.rows][None, :])
            if a is b:
                keep = np.triu(keep, 1)
            i, j = np.nonzero(keep)
            left.append(a.rows[i])
            right.append(b.rows[j])
        elif a is b:
            stack += [(a.parts[0], a.parts[0]), (a.parts[1], a.parts[1]), (a.parts[0], a.parts[1])]
        elif not b.parts or a.parts and len(a.rows) >= len(b.rows):
            stack += [(p, b) for p in a.parts]
        else:
            stack += [(a, p) for p in b.parts]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def fingerprint(found: np.ndarray) -> int:
    """A 64-bit key of a shingle set."""
    sums = np.array([mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), len(found)], np.uint64)
    return int((mix(sums[:1] ^ mix(sums[1:2] + mix(sums[2:])))).view(np.int64)[0])


def prefix_sizes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of n shingles must hold a common one: with any linked set, and with one that is not smaller."""
    return n - (3 * n + 3) // 4 + 1, n - (6 * n + 6) // 7 + 1


def _keyed(rows: DataFrame) -> DataFrame:
    """(doc_id, n, key) of every row of (doc_id, text)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), fingerprint(s)) for s in sets_of(batch.column(1))]
            n, key = (pa.array([s[k] for s in sets], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, key], names=["doc_id", "n", "key"])

    return rows.mapInArrow(releasing(step), "doc_id long, n long, key long")


_MESSAGE = ["r", "block", "low", "high", "at", "times", "docs", "meta"]
_REPLY = ["r", "block", "at", "freq", "rank", "docs", "meta"]
_BIN, _LONG = pa.binary(), pa.int64()


def _table(names: list[str], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, _LONG if k < 2 else _BIN) for k, c in enumerate(columns)], names=names)


def _announced(rows: DataFrame, ranges: int, block_items: int) -> DataFrame:
    """Messages (r, block, ...) with the sorted shingles of each block, and one row about its texts under a negative r."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ordinal, size = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            block = (part << 24) | ordinal
            n = np.array([len(s) for s in held])
            ids = np.concatenate(held) >> np.uint64(16)
            order = np.argsort(ids, kind="stable")
            ids, docs = ids[order], np.repeat(np.arange(len(held), dtype=np.uint16), n)[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            times, ids = np.diff(np.append(first, len(ids))), ids[first]
            cut = np.searchsorted((ids >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
            low, high = (ids & np.uint64(0xFFFFFFFF)).astype("<u4"), (ids >> np.uint64(32)).astype("<u2")
            keys = np.array([fingerprint(s) for s in held], np.int64)
            out = [(-1 - block, block, None, None, None, times.astype("<u4").tobytes(), docs.tobytes(), np.concatenate([keys, n, cut]).astype(np.int64).tobytes())]
            for r in range(ranges):
                mine = slice(cut[r], cut[r + 1])
                if cut[r + 1] > cut[r]:
                    often = np.flatnonzero(times[mine] > 1)
                    out.append((r, block, low[mine].tobytes(), high[mine].tobytes(), often.astype("<u4").tobytes(), times[mine][often].astype("<u4").tobytes(), None, None))
            return _table(_MESSAGE, out).to_batches()[0]

        for batch in batches:
            for found in sets_of(batch.column(0)):
                if len(found):
                    held.append(found)
                    size += len(found)
                if size >= block_items or len(held) == 1 << 16:
                    yield flush()
                    held, size, ordinal = [], 0, ordinal + 1
        if held:
            yield flush()

    return rows.select("text").mapInArrow(releasing(step), "r long, block long, low binary, high binary, at binary, times binary, docs binary, meta binary")


def _counted(table: pa.Table) -> pa.Table:
    """The reply of one range to every block: which of its shingles other texts have, how often, and their rank in the range."""
    rows = table.to_pylist()
    if rows[0]["r"] < 0:
        return _table(_REPLY, [(r["r"], r["block"], None, r["times"], None, r["docs"], r["meta"]) for r in rows])
    ids = [np.frombuffer(r["high"], "<u2").astype(np.uint64) << np.uint64(32) | np.frombuffer(r["low"], "<u4").astype(np.uint64) for r in rows]
    times = []
    for r, found in zip(rows, ids, strict=True):
        n = np.ones(len(found), np.int64)
        n[np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["times"], "<u4")
        times.append(n)
    _, rank = np.unique(np.concatenate(ids), return_inverse=True)
    freq = np.bincount(rank, np.concatenate(times)).astype("<u4")[rank]
    out, low = [], 0
    for r, found in zip(rows, ids, strict=True):
        mine = slice(low, low + len(found))
        shared = np.flatnonzero(freq[mine] > 1)
        out.append((r["r"], r["block"], shared.astype("<u4").tobytes(), freq[mine][shared].tobytes(), rank[mine][shared].astype("<u4").tobytes(), None, None))
        low += len(found)
    return _table(_REPLY, out)


def _prefixes(table: pa.Table) -> pa.Table:
    """(run, key, short) of the shared shingles in the prefix of each text of one block."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["meta"] is not None)
    docs, times = np.frombuffer(head["docs"], np.uint16), np.frombuffer(head["freq"], "<u4").astype(np.int64)
    ranges = int(max((r["r"] for r in rows if r["meta"] is None), default=0)) + 1
    meta, texts = np.frombuffer(head["meta"], np.int64), int(docs.max()) + 1
    keys, n, cut = meta[:texts], meta[texts : 2 * texts], meta[2 * texts :]
    starts = np.concatenate([[0], np.cumsum(times)])
    at, freq, run = [], [], []
    for r in rows:
        if r["meta"] is None and r["r"] < ranges:
            at.append(np.frombuffer(r["at"], "<u4").astype(np.int64) + cut[r["r"]])
            freq.append(np.frombuffer(r["freq"], "<u4"))
            run.append(np.int64(r["r"] << 32) | np.frombuffer(r["rank"], "<u4").astype(np.int64))
    at, freq, run = (np.concatenate(v).astype(np.int64) for v in (at, freq, run))
    copies = times[at]
    first = np.repeat(starts[at], copies)
    place = np.arange(len(first)) - np.repeat(np.cumsum(copies) - copies, copies) + first
    doc, freq, run = docs[place].astype(np.int64), np.repeat(freq, copies), np.repeat(run, copies)
    order = np.lexsort((run, freq, doc))
    doc, run = doc[order], run[order]
    shared = np.bincount(doc, minlength=texts)
    long, short = prefix_sizes(n)
    position = np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc] + (n - shared)[doc]
    keep = position < long[doc]
    doc, run, position = doc[keep], run[keep], position[keep]
    return pa.table([pa.array(run), pa.array(keys[doc]), pa.array(position < short[doc])], names=["run", "key", "short"])


def prefixes(rows: DataFrame, items: int, sizes: Sizes) -> DataFrame:
    """(run, key, short): which texts share which of their rarest shingles; rows: (text), one for each class."""
    ranges = max(1, -(-items // sizes.range_items))
    sent = _announced(rows, ranges, sizes.block_items)
    replies = sent.groupBy("r").applyInArrow(_counted, "r long, block long, at binary, freq binary, rank binary, docs binary, meta binary")
    return replies.groupBy("block").applyInArrow(_prefixes, "run long, key long, short boolean")


def few(keys: DataFrame, most: int = Sizes().few) -> DataFrame:
    """A small table of keys with a hint to send it to all executors; a larger one as it is, for a shuffled join."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _of_runs(entries: DataFrame, runs: DataFrame, sizes: Sizes) -> DataFrame:
    """Entries joined to their runs; beyond a list that is broadcast, a run is dealt over several tasks."""
    if runs.count() <= sizes.few:
        return entries.join(F.broadcast(runs), "run")
    salted = runs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return entries.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int")).join(salted, ["run", "_salt"]).drop("_salt")


def _runs(entries: DataFrame, sizes: Sizes) -> DataFrame:
    """(run, key, members, weight) of runs of several texts with one in its short prefix; equal runs once, with their number as weight."""
    mark = F.sum(F.expr("xxhash64(key) % 1099511627776"))
    told = entries.groupBy("run").agg(F.count(F.lit(1)).alias("members"), mark.alias("mark"), F.min("key").alias("head"), F.max("short").alias("live")).filter("members > 1 AND live")
    kept = told.groupBy("members", "mark", "head").agg(F.min("run").alias("run"), F.count(F.lit(1)).alias("weight")).select("run", "members", "weight")
    return _of_runs(entries.select("run", "key"), materialise(kept, "jaccard-kept"), sizes)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points leave room for enough common shingles, and whose whole sets are linked."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([x.values.to_numpy() for x in batch.column(k)] for k in (3, 5))
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            keep = [7 * overlap_bound(p, q) >= 3 * t for p, q, t in zip(left, right, total.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(x, y) for x, y in zip(sets_of(batch.column(2)), sets_of(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(name: str, *columns: str) -> DataFrame:
        return texts.select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    near = pairs.select("a", "b").join(side("a", "n", "point"), "a").join(side("b", "n", "point"), "b")
    near = near.filter("4 * n_a >= 3 * n_b AND 4 * n_b >= 3 * n_a").select("a", "b", "n_a", "point_a", "n_b", "point_b").mapInArrow(releasing(bounded), "a long, b long")
    both = near.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(releasing(whole), "a long, b long")


def _described(rows: DataFrame) -> DataFrame:
    """(key, n, point, text) of rows of (text)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_of(batch.column(0)))
            points = [point_of(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int32)
            flat = np.concatenate(points) if points else np.zeros(0, np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(s) for s in sets], _LONG), pa.array([len(s) for s in sets], _LONG), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), batch.column(0)],
                names=["key", "n", "point", "text"],
            )

    return rows.select("text").mapInArrow(releasing(step), "key long, n long, point array<tinyint>, text string")


def _blocks(rows: DataFrame, tree_rows: int) -> DataFrame:
    """Rows of (run, key, n, point, comp, runs, members, least) dealt to pairs of blocks of their run: (run, i, j, side, ...).

    The texts of a run's first component have blocks of their own (numbers below zero); two such blocks need not be joined.
    """
    m = F.ceil(F.col("members") / tree_rows).cast("int")
    at = F.pmod(F.xxhash64("key"), F.col("_m")).cast("int")
    rows = rows.withColumn("_m", m).withColumn("_at", F.when((F.col("_m") > 1) & (F.col("comp") == F.col("least")), -1 - at).otherwise(at))
    others = F.sequence(F.lit(0), F.col("_m") - 1)
    own = F.transform(others, lambda k: -1 - k)
    rows = rows.withColumn("_other", F.explode(F.when(F.col("_at") < 0, others).when(F.col("_m") > 1, F.concat(others, own)).otherwise(others)))
    side = F.when(F.col("_at") <= F.col("_other"), 0).otherwise(1)
    return rows.select("run", F.least("_at", "_other").alias("i"), F.greatest("_at", "_other").alias("j"), side.alias("side"), "key", "n", "point", "comp", "runs")


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups of rows that come sorted by names, with the bounds of each group."""
    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if rest is None or not rest.num_rows:
            continue
        keys = [rest.column(k).to_numpy() for k in names]
        cut = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])).tolist()
        ends = [*cut[1:], rest.num_rows]
        whole = len(cut) if batch is None else len(cut) - 1
        if whole:
            yield rest.slice(0, ends[whole - 1]), list(zip(cut[:whole], ends[:whole], strict=True))
            rest = rest.slice(ends[whole - 1])


def _bounded(points: list[np.ndarray], n: np.ndarray, comp: np.ndarray, sides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The row pairs that the R-tree of these points leaves."""
    width = min(NODE_GROUPS, min(len(p) for p in points))
    return tree_join(np.stack([folded(p, width) for p in points]).astype(np.int16), n, comp, sides)


_LEFT = ["a", "b", "run", "i", "j", "u", "v", "side", "part"]
_UNIT = ["run", "i", "j", "u", "v"]


def _left(group: list[int], key: np.ndarray, n: np.ndarray, side: np.ndarray, a: np.ndarray, b: np.ndarray, items: int) -> np.ndarray:
    """Columns _LEFT of what the trees leave in one group: its pairs, with run -1, or, if those are more, its texts, a and b being the same.

    Texts are cut into parts of about `items` shingles; each two parts u, v between which pairs are left are a unit.
    """
    pairs = np.full((len(_LEFT), len(a)), -1, np.int64)
    pairs[0], pairs[1] = np.minimum(key[a], key[b]), np.maximum(key[a], key[b])
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(rows) >= len(a):
        return pairs
    part = np.unique(np.cumsum(n[rows]) // items, return_inverse=True)[1]
    one, other = part[at[: len(a)]], part[at[len(a) :]]
    unit = np.minimum(one, other) * len(rows) + np.maximum(one, other)
    unit, member = np.divmod(np.unique(np.tile(unit, 2) * len(rows) + at), len(rows))
    if len(member) >= len(a):
        return pairs
    u, v = np.divmod(unit, len(rows))
    own = rows[member]
    return np.stack([key[own], key[own], *(np.full(len(own), k, np.int64) for k in group), u, v, side[own], part[member]])


def _tree_pairs(rows: DataFrame, tree_rows: int, items: int = Sizes().block_items) -> DataFrame:
    """Rows _LEFT: pairs (a, b) that the R-trees of all runs leave, each from the first run of `runs` that both texts are in.

    A pair of blocks that leaves more pairs than texts gives its texts instead, so there are no more rows than texts in all pairs of blocks.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _grouped(batches, _UNIT[:3]):
            out = [np.zeros((len(_LEFT), 0), np.int64)]
            heads = [table.column(k).to_numpy() for k in _UNIT[:3]]
            key, n, comp, side = (table.column(k).to_numpy() for k in ("key", "n", "comp", "side"))
            points = [x.values.to_numpy() for x in table.column("point")]
            runs = [frozenset(x) for x in table.column("runs").to_pylist()]
            for low, high in groups:
                part, group = slice(low, high), [int(k[low]) for k in heads]
                a, b = _bounded(points[part], n[part], comp[part], None if group[1] == group[2] else side[part])
                first = np.array([min(runs[low + x] & runs[low + y]) == group[0] for x, y in zip(a, b, strict=True)], bool)
                a, b = a[first], b[first]
                fine = np.array([7 * overlap_bound(points[low + x], points[low + y]) >= 3 * (n[low + x] + n[low + y]) for x, y in zip(a, b, strict=True)], bool)
                out.append(_left(group, key[part], n[part], side[part], a[fine], b[fine], items))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=_LEFT)

    dealt = _blocks(rows, tree_rows).repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "key")
    return dealt.mapInArrow(releasing(step), ", ".join(f"{c} long" for c in _LEFT))


def joining_links(sets: list[np.ndarray], comps: np.ndarray, a: np.ndarray, b: np.ndarray, wanted: Callable[[int, int], bool] = lambda x, y: True) -> list[tuple[int, int]]:
    """Of the row pairs (a, b) that are wanted and linked, enough to join all components that they join; each joins two."""
    n = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, np.cumsum(n)[:-1])
    comp, held, links = np.unique(comps, return_inverse=True)[1], np.zeros(len(ids), np.int64), []
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    for x, others in zip(a[starts].tolist(), np.split(b, starts[1:]), strict=True):
        near = np.array([y for y in others[comp[others] != comp[x]].tolist() if wanted(x, y)], np.int64)
        if not len(near):
            continue
        held[own[x]] = 1
        common = np.add.reduceat(held[np.concatenate([own[y] for y in near])], np.cumsum(n[near]) - n[near])
        held[own[x]] = 0
        for y in near[100 * common >= 75 * (n[x] + n[near] - common)].tolist():
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                links.append((x, y))
    return links


def _linked_in_units(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the texts of each unit that join components; members: (key, comp, runs) and its unit, side and part."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _grouped(batches, _UNIT):
            left, right = [], []
            heads = [table.column(k).to_numpy() for k in _UNIT]
            key, comp, side, part = (table.column(k).to_numpy() for k in ("key", "comp", "side", "part"))
            for low, high in groups:
                run, i, j, u, v = (int(k[low]) for k in heads)
                inside = table.slice(low, high - low)
                sets = [s for c in inside.column("text").chunks for s in sets_of(c)]
                runs = [frozenset(x) for x in inside.column("runs").to_pylist()]
                a, b = _bounded([point_of(s) for s in sets], np.array([len(s) for s in sets]), comp[low:high], None if i == j else side[low:high])
                if u != v:
                    across = part[low + a] != part[low + b]
                    a, b = a[across], b[across]
                for x, y in joining_links(sets, comp[low:high], a, b, lambda x, y, runs=runs, run=run: min(runs[x] & runs[y]) == run):
                    left.append(key[low + x])
                    right.append(key[low + y])
            x, y = np.array(left, np.int64), np.array(right, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = members.join(texts.select("key", "text"), "key").select(*_UNIT, "side", "part", "key", "comp", "runs", "text")
    return rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "key").mapInArrow(releasing(step), "a long, b long")


def _open(runs: DataFrame, labels: DataFrame | None, sizes: Sizes) -> DataFrame:
    """(run, key, members, weight, comp, least) of the runs that still span several components; least: the first of them."""
    if labels is None:
        held = runs.withColumn("comp", F.col("key"))
    else:
        held = runs.join(labels, F.col("key") == F.col("node"), "left").select(*runs.columns, F.coalesce("label", "key").alias("comp"))
    several = held.groupBy("run").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("run", "least")
    return _of_runs(held, materialise(several, "jaccard-open"), sizes)


def _to_pivots(held: DataFrame, seed: int, sizes: Sizes) -> DataFrame:
    """(a, b): every text of an open run with the pivot of another component that it meets in most runs."""
    pivots = held.groupBy("run").agg(F.min(F.struct(F.xxhash64("key", F.lit(seed)).alias("h"), F.col("key").alias("pivot"), F.col("comp").alias("other"))).alias("p")).select("run", "p.pivot", "p.other")
    met = _of_runs(held, materialise(pivots, "jaccard-pivots"), sizes).filter("comp <> other").groupBy("key", "pivot").agg(F.sum("weight").alias("w"))
    best = met.groupBy("key").agg(F.max(F.struct("w", "pivot")).alias("best"))
    return best.select(F.least("key", "best.pivot").alias("a"), F.greatest("key", "best.pivot").alias("b")).distinct()


def _closed(pairs: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels after all links among pairs (a, b); pairs that other links have brought into one component are not verified."""
    near, most = Window.partitionBy("_ca", "_cb").orderBy(F.xxhash64("a", "b"), "a", "b"), 1
    while True:
        held = pairs.select("a", "b")
        for side in ("a", "b"):
            held = held.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_l{side}")), side, "left")
        ca, cb = F.coalesce("_la", "a"), F.coalesce("_lb", "b")
        apart = held.filter(ca != cb).select("a", "b", F.least(ca, cb).alias("_ca"), F.greatest(ca, cb).alias("_cb"))
        apart = materialise(apart.select("a", "b", F.row_number().over(near).alias("place")), "jaccard-apart")
        if not apart.limit(1).count():
            return labels
        labels = components(materialise(_verified(apart.filter(F.col("place") <= most), texts), "jaccard-links"), labels)
        pairs, most = apart.filter(F.col("place") > most), 4 * most


def _same(x: Column, y: Column) -> Column:
    return x.eqNullSafe(y)


def _classes(docs: DataFrame, id_col: str, text_col: str, sizes: Sizes) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n, key) of every row, and the labels (node, label) of the keys that are linked to another."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    every = materialise(_keyed(rows), "jaccard-keys")
    classes = materialise(every.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "jaccard-classes")
    items = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not items:
        return every, None
    repeated = bool(every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).count())

    def texts_of(ids: DataFrame) -> DataFrame:
        """One row of text for each class whose smallest id is among ids; of repeated ids also others."""
        ids = ids.select(F.col("rep").alias("_rep")).distinct()
        found = rows.join(few(ids, sizes.few), _same(rows["doc_id"], ids["_rep"]), "left_semi")
        return found.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]) if repeated else found

    entries = prefixes(texts_of(classes), items, sizes)
    entries = materialise(entries.groupBy("run", "key").agg(F.max("short").alias("short")) if repeated else entries, "jaccard-entries")
    runs = materialise(_runs(entries, sizes), "jaccard-runs")
    named = runs.select("key").distinct()
    texts = _described(texts_of(classes.join(named, "key", "left_semi")))
    texts = materialise(texts.dropDuplicates(["key"]) if repeated else texts, "jaccard-texts")

    labels = None
    for seed in range(ROUNDS):
        pairs = materialise(_to_pivots(materialise(_open(runs, labels, sizes), "jaccard-held"), seed, sizes), "jaccard-pairs")
        labels = components(materialise(_verified(pairs, texts), "jaccard-links"), labels)
    held = materialise(_open(runs, labels, sizes), "jaccard-held")
    own = held.groupBy("key").agg(F.collect_list("run").alias("runs"))
    whole = held.join(own.join(texts.select("key", "n", "point"), "key"), "key")
    left = materialise(_tree_pairs(whole, sizes.tree_rows, sizes.block_items), "jaccard-pairs")
    members = left.filter("run >= 0")
    if members.limit(1).count():
        own = held.groupBy("key").agg(F.first("comp").alias("comp"), F.collect_list("run").alias("runs"))
        members = members.select(F.col("a").alias("key"), *_UNIT, "side", "part").join(own, "key")
        labels = components(materialise(_linked_in_units(members, texts), "jaccard-links"), labels)
    return every, _closed(left.filter("run < 0"), texts, labels)


def _placed(every: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, n, key, comp) of every row; rows without shingles have no comp."""
    own = F.when(F.col("n") > 0, F.col("key"))
    if labels is None:
        return every.withColumn("comp", own)
    return every.join(labels, F.col("key") == F.col("node"), "left").select("doc_id", "n", "key", F.coalesce(F.when(F.col("n") > 0, F.col("label")), own).alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    placed = materialise(_placed(*_classes(docs, id_col, text_col, sizes)), "jaccard-places")
    names = placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("size"))
    large = few(materialise(names.filter("size > 1").select(F.col("comp").alias("_comp"), "name"), "jaccard-names"), sizes.few)
    out = placed.join(large, F.col("comp") == F.col("_comp"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_comp").isNotNull(), F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """One row, with all columns, of each component: that with the smallest id, of one id that with the smallest key.

    Rows without words all stay.
    """
    every, labels = _classes(docs, id_col, text_col, sizes)
    placed = _placed(every, labels).filter("comp IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = materialise(placed.groupBy("comp").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("_id"), F.col("o.key").alias("_key")), "jaccard-first")
    several = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    ids = few(kept.select("_id").distinct(), sizes.few)
    wordless = F.coalesce(docs[text_col], F.lit("")).rlike(r"^[ \t-\r]*$")
    full = docs.filter(~wordless).join(ids, _same(docs[id_col].cast("long"), F.col("_id")), "left_semi")
    if several.limit(1).count():
        full = _one_of_each(full, kept, id_col, text_col)
    return docs.filter(wordless).unionByName(full)


def _one_of_each(rows: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows with repeated ids, one for each (id, key) that is kept."""
    names, at = rows.columns, rows.columns.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_own_key", pa.array([fingerprint(s) for s in sets_of(batch.column(at))], _LONG))

    schema = StructType([*rows.schema.fields, StructField("_own_key", LongType())])
    keyed = rows.mapInArrow(releasing(step), schema).dropDuplicates([id_col, "_own_key"])
    return keyed.join(kept, _same(keyed[id_col].cast("long"), kept["_id"]) & (keyed["_own_key"] == kept["_key"]), "left_semi").select(*names)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
