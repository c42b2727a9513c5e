"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are reduced to lower-case letters and digits. Windows of an item (WINDOW characters, every STRIDE,
and one at its end; shorter items are one window) may occur in a text with at most 8 % of their length in edits (fewer for short
items, so that the bound below is never under LEAST).
By the q-gram lemma such an occurrence shares at least length - q + 1 - q * edits character q-grams with its window, and they all
lie within edits + 1 neighbouring diagonals. Shared q-grams are counted in diagonal bands twice as wide that overlap by half, so one
band holds them all. Windows that meet the count are verified by alignment within the band.

Benchmark items are sent to the executors in blocks of at most BLOCK_CHARS characters; a larger benchmark takes more passes.

Edge cases: null, empty and short texts have no leaks; items under MIN_CHARS letters and digits are ignored (so short a
run is found in clean texts as well), and items with a null id or text; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored (and kept by `drop_leaks`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._words import releasing

Q, WINDOW, STRIDE, MIN_CHARS, LEAST = 8, 80, 20, 40, 20
EDIT_SHARE = 0.08
BLOCK_CHARS = 8_000_000
_BITS = 22
_B, _B2, _B4 = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4))
_tables: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter or digit, or 0."""
    if "fold" not in _tables:
        _tables["fold"] = np.array([ord(chr(i).lower()[0]) if chr(i).isalnum() else 0 for i in range(0x10000)], np.uint32)
    return _tables["fold"]


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a text in lower case, and where each stands."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(points < 0x10000, _fold()[np.minimum(points, 0xFFFF)], points)
    kept = np.flatnonzero(folded)
    return folded[kept], kept


def _grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of Q = 8 characters."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    c = chars.astype(np.uint64)
    two = c[:-1] * _B + c[1:]
    four = two[:-2] * _B2 + two[2:]
    return four[:-4] * _B4 + four[4:]


def _budget(length: int) -> int:
    """Edits allowed in a window: 8 % of it, and few enough that LEAST q-grams must be shared."""
    return max(0, min(int(EDIT_SHARE * length), (length - Q + 1 - LEAST) // Q))


class Index:
    """Where each q-gram occurs in a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.chars = [], []
        for item, text in items:
            chars, _ = normalised(text)
            if len(chars) >= MIN_CHARS and item is not None:
                self.ids.append(item)
                self.chars.append(chars)
        grams = [_grams(c) for c in self.chars]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))
        self.owner, self.place = owner[order], place[order]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.keys * _B >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def windows(self, item: int) -> list[tuple[int, int]]:
        size = len(self.chars[item])
        if size <= WINDOW:
            return [(0, size)]
        return [(s, s + WINDOW) for s in sorted({*range(0, size - WINDOW + 1, STRIDE), size - WINDOW})]

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of verified occurrences, one per window; positions in the text."""
        chars, kept = normalised(text)
        grams = _grams(chars)
        if not len(grams) or not len(self.keys):
            return []
        at = np.flatnonzero(self.filter[(grams * _B >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        true = self.keys[key] == grams[at]
        at, key = at[true], key[true]
        least, reach = LEAST, WINDOW - Q + 1 + 2 * _budget(WINDOW)
        if len(at) < least:
            return []
        close = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= reach)
        if not len(close):
            return []
        dense = np.zeros(len(at) + 1, np.int64)
        np.add.at(dense, close, 1)
        np.add.at(dense, close + least, -1)
        inside = np.cumsum(dense[:-1]) > 0
        at, key = at[inside], key[inside]
        times = self.ends[key + 1] - self.ends[key]
        source = np.repeat(self.ends[key] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, j, i = self.owner[source], self.place[source], np.repeat(at, times)
        width = _budget(WINDOW) + 1
        band = (i - j) // width
        shift = len(chars) // width + WINDOW + max(map(len, self.chars)) + 2
        group = np.concatenate([item * (4 * shift) + band + shift, item * (4 * shift) + band - 1 + shift])
        order = np.argsort(group, kind="stable")
        groups, first, count = np.unique(group[order], return_index=True, return_counts=True)
        place, diagonal = np.concatenate([j, j])[order], np.concatenate([i - j, i - j])[order]
        found: dict[tuple[int, int, int], tuple[int, int, int, int]] = {}
        for g in np.flatnonzero(count >= least):
            it, low = int(groups[g] // (4 * shift)), int(groups[g] % (4 * shift) - shift) * width
            js, ds = place[first[g] : first[g] + count[g]], diagonal[first[g] : first[g] + count[g]]
            by = np.argsort(js, kind="stable")
            js, ds = js[by], ds[by]
            for start, stop in self.windows(it):
                length = stop - start
                left, right = np.searchsorted(js, start, "left"), np.searchsorted(js, stop - Q, "right")
                if right - left < _least(length) or any(k[:2] == (it, start) and abs(k[2] - low) <= 2 * width for k in found):
                    continue
                edits, at_best = _budget(length), start + int(np.sort(ds[left:right])[(right - left) // 2])
                pattern = self.chars[it][start:stop]
                if at_best >= 0 and np.array_equal(chars[at_best : at_best + length], pattern):
                    hit = (at_best, at_best + length, 0)
                else:
                    hit = banded(pattern, chars, start + low - edits, start + low + 2 * width + edits, edits)
                if hit:
                    begin, end, cost = hit
                    found[(it, start, low)] = (self.ids[it], int(kept[begin]), int(kept[end - 1]) + 1, cost)
        return sorted(found.values())


def _least(length: int) -> int:
    """Shared q-grams that an occurrence within the edit budget must have."""
    return max(1, length - Q + 1 - Q * _budget(length))


def banded(pattern: np.ndarray, chars: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(start, end, cost) of the best occurrence of a pattern that starts in [low, high), within the budget.

    Cell k of row r aligns the first r characters to text that ends at low + r + k; only these diagonals are computed.
    """
    size, n, far = high - low + 1, len(chars), edits + 1
    left = max(0, low)
    text = chars[left : max(left, high + len(pattern) + 1)].tolist()
    cost = [0 if 0 <= low + k <= n else far for k in range(size)]
    start = [low + k for k in range(size)]
    for r, c in enumerate(pattern.tolist()):
        row, origin = [far] * size, [0] * size
        for k in range(size):
            end = low + r + 1 + k
            if end < 0 or end > n:
                continue
            best, begin = far, 0
            if end > left and cost[k] + (text[end - 1 - left] != c) < best:
                best, begin = cost[k] + (text[end - 1 - left] != c), start[k]
            if k + 1 < size and cost[k + 1] + 1 < best:
                best, begin = cost[k + 1] + 1, start[k + 1]
            if k and row[k - 1] + 1 < best:
                best, begin = row[k - 1] + 1, origin[k - 1]
            row[k], origin[k] = best, begin
        cost, start = row, origin
        if min(cost) > edits:
            return None
    k = min(range(size), key=cost.__getitem__)
    end = low + len(pattern) + k
    return (start[k], end, cost[k]) if cost[k] <= edits and end > start[k] else None


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over blocks of items with a bounded number of characters."""
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, start, end, edits): each item that a text leaks, and where."""
    spark = ship(docs.sparkSession)
    out = None
    for index in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    by: dict[int, list] = {}
                    for item, start, end, cost in known.leaks(text):
                        by.setdefault(item, []).append((start, end, cost))
                    rows += [(doc, item, len(v), min(x[0] for x in v), max(x[1] for x in v), min(x[2] for x in v)) for item, v in sorted(by.items())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "windows", "start", "end", "edits"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(step), "doc_id long, item_id long, windows long, start long, end long, edits long")
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all columns, whose text leaks no item."""
    spark = ship(docs.sparkSession)
    at = docs.columns.index("text")
    for index in _indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not known.leaks(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(releasing(step), docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
