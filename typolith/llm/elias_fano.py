"""Elias-Fano sequences in memory-mapped files, and an n-gram trie on them."""

from __future__ import annotations

import os

import numpy as np

_STRIDE = 1 << 14


class EliasFano:
    """A non-decreasing sequence: byte-aligned low parts and a unary bit vector of high parts."""

    def __init__(self, path: str) -> None:
        head = np.fromfile(f"{path}.head", np.int64)
        self.n, self.shift = int(head[0]), int(head[1])
        self.firsts = np.fromfile(f"{path}.first", np.uint64)
        self.bits_at = np.fromfile(f"{path}.at", np.int64)
        self.high = np.memmap(f"{path}.high", np.uint8, "r") if self.n else np.zeros(0, np.uint8)
        self.low = np.memmap(f"{path}.low", np.uint8, "r", shape=(self.n, self.shift // 8)) if self.n and self.shift else None

    @staticmethod
    def write(path: str, values: np.ndarray) -> None:
        values = values.astype(np.uint64)
        n = len(values)
        room = int(values[-1]) // n if n else 0
        shift = min(56, (room.bit_length() // 8) * 8)
        np.array([n, shift], np.int64).tofile(f"{path}.head")
        top = (values >> np.uint64(shift)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(top[-1]) + 1 if n else 0, np.uint8)
        bits[top] = 1
        np.packbits(bits).tofile(f"{path}.high")
        if shift:
            planes = values.view(np.uint8).reshape(n, 8)[:, : shift // 8]
            np.ascontiguousarray(planes).tofile(f"{path}.low")
        values[::_STRIDE].tofile(f"{path}.first")
        top[::_STRIDE].astype(np.int64).tofile(f"{path}.at")

    def decode(self, chunk: int) -> np.ndarray:
        """The values of one stretch of _STRIDE elements."""
        begin, end = chunk * _STRIDE, min(self.n, (chunk + 1) * _STRIDE)
        at = int(self.bits_at[chunk])
        stop = int(self.bits_at[chunk + 1]) if chunk + 1 < len(self.bits_at) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at // 8 : -(-stop // 8)])[at % 8 :]
        ones = np.flatnonzero(bits)[: end - begin] + at
        value = (ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.shift)
        if self.low is not None:
            wide = np.zeros((end - begin, 8), np.uint8)
            wide[:, : self.shift // 8] = self.low[begin:end]
            value |= wide.view(np.uint64).reshape(-1)
        return value

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at sorted places; only the stretches that hold them are decoded."""
        out = np.zeros(len(places), np.uint64)
        cuts = np.searchsorted(places, np.arange(len(self.firsts) + 1) * _STRIDE)
        for chunk in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[chunk], cuts[chunk + 1])
            out[mine] = self.decode(int(chunk))[places[mine] - chunk * _STRIDE]
        return out

    def successor(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted queries: the position of the first element that is not smaller, and whether it is equal."""
        position, equal = np.full(len(queries), self.n, np.int64), np.zeros(len(queries), bool)
        cuts = np.append(np.searchsorted(queries, self.firsts[1:], "left") if self.n else [], len(queries)).astype(np.int64)
        at = 0
        for chunk, stop in enumerate(cuts if self.n else []):
            if stop > at:
                values = self.decode(chunk)
                found = np.searchsorted(values, queries[at:stop], "left")
                position[at:stop] = chunk * _STRIDE + found
                inside = found < len(values)
                equal[at:stop] = inside & (values[np.minimum(found, len(values) - 1)] == queries[at:stop])
            at = max(at, int(stop))
        return position, equal


class Trie:
    """Two levels, the predicted word above its contexts.

    Level 1 are words; a monotone pointer gives the place in level 2 where each word's contexts end. Level 2 are contexts as numbers of a
    vocabulary of their own, made monotone by adding the last value of the range before, with 16-bit codes of a quantised value. A search is
    relative to the word's range: the successor of (last value before the range) + 1 + number, which must lie within the range.
    """

    LEVELS = 0xFFFE

    @staticmethod
    def write(folder: str, n_words: int, words: np.ndarray, contexts: np.ndarray, values: np.ndarray) -> None:
        """words (ranks below n_words) and contexts of each pair, sorted; values: one for each pair."""
        known = np.unique(contexts)
        ends = np.searchsorted(words, np.arange(n_words), "right")
        steps = np.searchsorted(known, contexts).astype(np.int64)
        first = np.ones(len(words), bool)
        first[1:] = words[1:] != words[:-1]
        within = np.diff(steps, prepend=0)
        within[first] = steps[first] + 1
        EliasFano.write(os.path.join(folder, "vocabulary"), known)
        EliasFano.write(os.path.join(folder, "pointers"), ends)
        EliasFano.write(os.path.join(folder, "contexts"), np.cumsum(within))
        low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (high - low) / Trie.LEVELS or 1.0
        np.array([low, step]).tofile(os.path.join(folder, "scale"))
        (np.round((values - low) / step) + 1).astype("<u2").tofile(os.path.join(folder, "codes"))

    def __init__(self, folder: str) -> None:
        self.vocabulary, self.pointers, self.contexts = (EliasFano(os.path.join(folder, k)) for k in ("vocabulary", "pointers", "contexts"))
        self.low, self.step = np.fromfile(os.path.join(folder, "scale"))
        self.stored = np.memmap(os.path.join(folder, "codes"), "<u2", "r") if self.contexts.n else np.zeros(0, "<u2")

    def codes(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Codes of (word rank, context) pairs sorted by both; 0 for pairs that are not there, else 1 + (value - low) / step."""
        out = np.zeros(len(words), "<u2")
        if not self.contexts.n or not len(words):
            return out
        order = np.argsort(contexts, kind="stable")
        number, known = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        number[order], known[order] = self.vocabulary.successor(contexts[order].astype(np.uint64))
        ranks, of = np.unique(words, return_inverse=True)
        ends = self.pointers.at(ranks).astype(np.int64)
        begins = np.zeros(len(ranks), np.int64)
        begins[ranks > 0] = self.pointers.at(ranks[ranks > 0] - 1).astype(np.int64)
        before = np.zeros(len(ranks), np.uint64)
        before[begins > 0] = self.contexts.at(begins[begins > 0] - 1)
        some = known & (ends > begins)[of]
        position, equal = self.contexts.successor(before[of[some]] + np.uint64(1) + number[some].astype(np.uint64))
        found = equal & (position < ends[of[some]])
        out[np.flatnonzero(some)[found]] = self.stored[position[found]]
        return out
