"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram model with Dirichlet smoothing over an add-one unigram model:
    p(w) = (c(w) + 1) / (N + V + 1),   p(w | v) = (c(v, w) + MASS p(w)) / (c(v) + MASS).
In logarithms it is the sum of log p(w), of log MASS / (c(v) + MASS) and, where the pair was seen in training, of a
gain log(1 + c(v, w) / (MASS p(w))). Texts start after an end token and end with one, so the words that
serve as contexts are those that are predicted, and everything about a word is known where its count is: the trie is split
by the predicted word, and one exchange there and back scores all texts.

1. Words of training texts are counted by hash range: N, V, and the words that are too frequent for one range.
2. Each block of texts sends its distinct (word, context) pairs, sorted, with the times they are learned from, to the words' ranges; the
   places of the pairs in its texts go to the block's own row. Frequent words are spread over ranges by context, with the count from step 1.
3. Each range merges the training counts, writes its trie levels, maps them and looks up all blocks' pairs.
4. Counts and quantised gains come back by block, which adds them up by text.

What is exchanged is in proportion to the pairs and words of blocks, and a word or pair that is in every text is sent once by each block. A
range's words and a block's texts have a bounded size; N, V and the words with over RANGE_TOKENS / 4 occurrences (fewer than four for each
range, 16 bytes each) reach the driver.

Precision: n_tokens, n_known, train_tokens and base_score are exact (to double rounding). A gain is kept in 16 bits between the least and the
greatest of its range, so score is off by at most n_tokens * 2^-17 * (greatest - least gain), under 1e-4 for each token. Words are told apart by 64-bit
hashes, contexts by 32 bits: of the k contexts of one word about k^2 / 2^33 are taken for another.

Edge cases: null and empty texts consist of the end token; unseen words have count 0; an empty training part gives N = V = 0; a null
id stays null; a null in held_out counts as false; repeated rows are scored (and learned) each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._words import hashed_rows, mix, releasing
from .elias_fano import Trie

MASS = 500.0
BLOCK_TEXTS = 60_000


class Sizes(NamedTuple):
    """How the work is cut; other sizes give the same result but for the rounding of gains."""

    block_tokens: int = 1 << 21
    range_tokens: int = 1 << 20


END = mix(np.array([0x1F2E3D4C5B6A7988], np.uint64))[0]
_BIN, _LONG = pa.binary(), pa.int64()


def _spread(values: np.ndarray, ranges: int) -> np.ndarray:
    """A range for each hash, in the order of the hashes."""
    return ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for low, high, hashes, offsets in hashed_rows(column):
        for k in range(high - low):
            yield low + k, hashes[offsets[k] : offsets[k + 1]]


def vocabulary(docs: DataFrame, ranges: int, sizes: Sizes) -> tuple[int, int, dict[int, int]]:
    """N, V and the counts of words with more than a quarter of a range's tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(_spread(words, ranges), np.arange(ranges + 1))
            some = [r for r in range(ranges) if cut[r + 1] > cut[r]]
            return pa.RecordBatch.from_arrays([pa.array(some, _LONG), pa.array([words[cut[r] : cut[r + 1]].tobytes() for r in some], _BIN), pa.array([n[cut[r] : cut[r + 1]].astype("<u4").tobytes() for r in some], _BIN)], names=["r", "words", "n"])

        for batch in batches:
            kept = batch.filter(pc.invert(batch.column(1)))
            for _, words in _texts(kept.column(0)):
                held += [words, np.array([END])]
                size += len(words) + 1
                if size >= sizes.block_tokens:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("words").to_pylist()])
        n = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("n").to_pylist()])
        known, at = np.unique(words, return_inverse=True)
        total = np.bincount(at, n, len(known)).astype(np.int64)
        often = np.flatnonzero(4 * total > sizes.range_tokens)
        return pa.table([pa.array([len(known)], _LONG), pa.array([int(total.sum())], _LONG), pa.array([known[often].view(np.int64).tolist()], pa.list_(_LONG)), pa.array([total[often].tolist()], pa.list_(_LONG))], names=["types", "tokens", "words", "n"])

    rows = docs.select("text", "held_out").mapInArrow(releasing(count), "r long, words binary, n binary").groupBy("r").applyInArrow(merge, "types long, tokens long, words array<long>, n array<long>").collect()
    frequent = {w: n for r in rows for w, n in zip(r["words"], r["n"], strict=True)}
    return sum(r["tokens"] for r in rows), sum(r["types"] for r in rows), frequent


_REQUEST = ["r", "block", "words", "spans", "contexts", "learned", "times", "docs", "meta"]
_REPLY = ["r", "block", "counts", "codes", "scale", "spans", "times", "docs", "meta"]


def _table(names: list[str], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, _LONG if k < 2 else _BIN) for k, c in enumerate(columns)], names=names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'long' if k < 2 else 'binary'}" for k, n in enumerate(names))


def _thin(values: np.ndarray) -> bytes:
    """Small counts: bytes, and those over 254 after them as 32 bits."""
    large = values > 254
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<u4").tobytes()


def _thick(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, n).astype(np.int64)
    small[small == 255] = np.frombuffer(data, np.uint8, offset=n).view("<u4") if len(data) > n else 0
    return small


def _requests(docs: DataFrame, ranges: int, frequent: np.ndarray, sizes: Sizes) -> DataFrame:
    """Rows (r, block, ...) of pairs by range, and one row of places and texts per block (under a negative r)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ordinal = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list = []
        train: list[bool] = []
        size = 0

        def flush() -> pa.RecordBatch:
            block = (part << 24) | ordinal
            lengths = np.array([len(w) for w in held])
            word = np.concatenate(held)
            before = np.empty_like(word)
            before[1:] = word[:-1]
            before[0] = END  # each text ends with END, so the word before a first one is END as well
            where = _spread(word, ranges)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, word), len(frequent) - 1)
                often = frequent[at] == word
                where[often] = _spread(mix(word[often] ^ mix(before[often])), ranges)
            context = (mix(before) >> np.uint64(32)).astype(np.uint32)
            del before
            order = np.lexsort((context, word, where))
            word, context, where = word[order], context[order], where[order]
            doc = np.repeat(np.arange(len(held), dtype=np.uint16), lengths)[order]
            learn = np.repeat(np.array(train), lengths)[order]
            first = np.ones(len(word), bool)
            first[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (where[1:] != where[:-1])
            gram = np.flatnonzero(first)
            times = np.diff(np.append(gram, len(word)))
            learned = np.add.reduceat(learn.astype(np.int64), gram)
            word, context, where = word[gram], context[gram], where[gram]
            top = np.ones(len(word), bool)
            top[1:] = (word[1:] != word[:-1]) | (where[1:] != where[:-1])
            head = np.flatnonzero(top)
            spans = np.diff(np.append(head, len(word)))
            word_cut = np.searchsorted(where[head], np.arange(ranges + 1))
            gram_cut = np.searchsorted(where, np.arange(ranges + 1))
            meta = np.concatenate([np.stack([lengths, ~np.array(train), [n is None for n in names], [n or 0 for n in names]]).astype(np.int64).ravel(), word_cut, gram_cut])
            out = [(-1 - block, block, None, _thin(spans), None, None, _thin(times), doc.tobytes(), meta.tobytes())]
            for r in np.flatnonzero(np.diff(word_cut)).tolist():
                w, g = (slice(c[r], c[r + 1]) for c in (word_cut, gram_cut))
                out.append((r, block, word[head[w]].tobytes(), _thin(spans[w]), context[g].tobytes(), _thin(learned[g]), None, None, None))
            return _table(_REQUEST, out).combine_chunks().to_batches()[0]

        for batch in batches:
            ids, outs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, words in _texts(batch.column(1)):
                held.append(np.append(words, END))
                names.append(ids[row])
                train.append(not outs[row])
                size += len(words) + 1
                if size >= sizes.block_tokens or len(held) >= BLOCK_TEXTS:
                    yield flush()
                    held, names, train, size, ordinal = [], [], [], 0, ordinal + 1
        if held:
            yield flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(releasing(step), _schema(_REQUEST))


def _serve(table: pa.Table, tokens: int, types: int, frequent: np.ndarray, counts: np.ndarray) -> pa.Table:
    """The counts of every block's words and the codes of its pairs in one range."""
    rows = table.to_pylist()
    if rows[0]["r"] < 0:
        return _table(_REPLY, [(r["r"], r["block"], None, None, None, r["spans"], r["times"], r["docs"], r["meta"]) for r in rows])
    rows.sort(key=lambda r: r["block"])
    words = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]))
    ranks, spans, contexts, learned = [], [], [], []
    for r in rows:
        ranks.append(np.searchsorted(words, np.frombuffer(r["words"], np.uint64)))
        spans.append(_thick(r["spans"], len(ranks[-1])))
        contexts.append(np.frombuffer(r["contexts"], "<u4"))
        learned.append(_thick(r["learned"], len(contexts[-1])))
    rank = np.repeat(np.concatenate(ranks), np.concatenate(spans)).astype(np.uint64)
    keys, at = np.unique((rank << np.uint64(32)) | np.concatenate(contexts).astype(np.uint64), return_inverse=True)
    pairs = np.bincount(at, np.concatenate(learned), len(keys))
    above, context = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
    count = np.bincount(above, pairs, len(words)).astype(np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        often = frequent[place] == words
        count[often] = counts[place[often]]
    seen = pairs > 0
    gains = np.log10(1 + pairs[seen] / (MASS * (count[above[seen]] + 1) / (tokens + types + 1)))
    with tempfile.TemporaryDirectory() as folder:
        Trie.write(folder, len(words), above[seen], context[seen], gains)
        trie = Trie(folder)
        codes, scale = trie.codes(above, context)[at], np.array([trie.low, trie.step]).tobytes()
        del trie
    cuts = np.cumsum([len(c) for c in contexts])[:-1]
    return _table(_REPLY, [(r["r"], r["block"], count[own].astype("<u4").tobytes(), found.tobytes(), scale, None, None, None, None) for r, own, found in zip(rows, ranks, np.split(codes, cuts), strict=True)])


def _finish(table: pa.Table, tokens: int, types: int) -> pa.Table:
    """Sums by text of one block."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["meta"] is not None)
    replies = sorted((r for r in rows if r["meta"] is None), key=lambda r: r["r"])
    counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in replies]).astype(np.int64)
    gains = []
    for r in replies:
        codes, (low, step) = np.frombuffer(r["codes"], "<u2"), np.frombuffer(r["scale"])
        gains.append(np.where(codes > 0, low + step * (codes - 1.0), 0.0))
    gains = np.concatenate(gains)
    docs = np.frombuffer(head["docs"], np.uint16)
    texts = int(docs.max()) + 1
    lengths, held, none, names = np.frombuffer(head["meta"], np.int64)[: 4 * texts].reshape(4, texts)
    times = _thick(head["times"], len(gains))
    word = np.repeat(np.repeat(np.arange(len(counts)), _thick(head["spans"], len(counts))), times)
    one = np.log10(counts + 1) - np.log10(tokens + types + 1)
    known = np.bincount(docs, (counts > 0)[word], texts).astype(np.int64)
    base = np.bincount(docs, one[word], texts)
    score = np.bincount(docs, (one + np.log10(MASS / (counts + MASS)))[word] + np.repeat(gains, times), texts)
    return pa.table([pa.array(names, mask=none.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(known), pa.array(np.full(texts, tokens)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """Scores of all rows by a model of the rows that are not held out."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, -(-int(size) // (6 * sizes.range_tokens)))
    tokens, types, found = vocabulary(rows, ranges, sizes)
    order = np.array(sorted(np.array(list(found), np.int64).view(np.uint64).tolist()), np.uint64)
    counts = np.array([found[int(w)] for w in order.view(np.int64)], np.int64)
    served = _requests(rows, ranges, order, sizes).groupBy("r").applyInArrow(lambda t: _serve(t, tokens, types, order, counts), _schema(_REPLY))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return served.groupBy("block").applyInArrow(lambda t: _finish(t, tokens, types), schema)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
