"""Elias-Fano sequences in memory-mapped files, and a two-level n-gram trie over them."""

from __future__ import annotations

import os

import numpy as np


class EliasFano:
    """A non-decreasing sequence below ``universe``: low bits packed, high parts in unary, with counts of ones and
    zeros per 64-bit word for access and successor search. All queries are vectorised."""

    def __init__(self, folder: str, name: str):
        meta = np.load(os.path.join(folder, f"{name}.meta.npy"))
        self.n, self.bits = int(meta[0]), int(meta[1])
        self.low, self.high, self.ones = (np.load(os.path.join(folder, f"{name}.{x}.npy"), mmap_mode="r") for x in ("low", "high", "ones"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def write(values: np.ndarray, universe: int, folder: str, name: str) -> None:
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        high = (values >> np.uint64(bits)).astype(np.int64)
        top = int((universe >> bits) + 1)
        flags = np.zeros((n + top + 64) // 64 * 64 + 64, bool)
        flags[high + np.arange(n)] = True
        packed = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(packed).astype(np.int64)
        np.save(os.path.join(folder, f"{name}.meta.npy"), np.array([n, bits], np.int64))
        np.save(os.path.join(folder, f"{name}.low.npy"), low)
        np.save(os.path.join(folder, f"{name}.high.npy"), packed)
        np.save(os.path.join(folder, f"{name}.ones.npy"), np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)[:-1])))

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero in the unary part."""
        before = self.ones if ones else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(np.int64)
        bits = np.array(self.high[word])
        if not ones:
            bits = ~bits
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            inside = (bits >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)
            count = np.bitwise_count(inside).astype(np.int64)
            skip = left >= count
            left -= np.where(skip, count, 0)
            at += np.where(skip, half, 0)
        return word * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        more = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | more) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether that value is x); n and False beyond the end."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        end = self._select(high, False) - high
        want = x & np.uint64((1 << self.bits) - 1)
        a, b = first.copy(), end.copy()
        while True:
            live = np.flatnonzero(a < b)
            if not len(live):
                break
            mid = (a[live] + b[live]) // 2
            less = self._low(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
        found = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < end)
        found[inside] = self._low(a[inside]) == want[inside]
        return a, found


class Trie:
    """Words, and below each the words seen before it, with quantised values on both levels."""

    @staticmethod
    def write(folder: str, words: np.ndarray, word_values: np.ndarray, starts: np.ndarray, before: np.ndarray, values: np.ndarray, levels: int = 4096) -> None:
        """``words`` sorted hashes; ``before[starts[i]:starts[i + 1]]`` the sorted hashes before words[i]."""
        names = np.unique(before)
        width = max(1, len(names))
        owner = np.repeat(np.arange(len(words)), np.diff(starts))
        EliasFano.write(words >> np.uint64(1), 1 << 63, folder, "words")
        EliasFano.write(names >> np.uint64(1), 1 << 63, folder, "names")
        EliasFano.write(starts, int(starts[-1]) + 1, folder, "starts")
        EliasFano.write(owner * width + np.searchsorted(names, before), max(1, len(words)) * width, folder, "pairs")
        for name, v in (("word_values", word_values), ("values", values)):
            low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
            step = (high - low) / (levels - 1) or 1.0
            np.save(os.path.join(folder, f"{name}.npy"), np.rint((v - low) / step).astype(np.uint16))
            np.save(os.path.join(folder, f"{name}.scale.npy"), np.array([low, step]))

    def __init__(self, folder: str):
        self.words, self.names, self.starts, self.pairs = (EliasFano(folder, x) for x in ("words", "names", "starts", "pairs"))
        self.values = {x: (np.load(os.path.join(folder, f"{x}.npy"), mmap_mode="r"), *np.load(os.path.join(folder, f"{x}.scale.npy"))) for x in ("word_values", "values")}

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        codes, low, step = self.values[name]
        return low + step * codes[at].astype(np.float64)

    def score(self, word: np.ndarray, before: np.ndarray, unknown: float) -> np.ndarray:
        """The value of each (word, word before): of the pair where it is known, else of the word, else ``unknown``."""
        out = np.full(len(word), unknown)
        at, known = self.words.successor(word >> np.uint64(1))
        out[known] = self._value("word_values", at[known])
        rank, named = self.names.successor(before >> np.uint64(1))
        both = np.flatnonzero(known & named)
        if len(both):
            place, found = self.pairs.successor(at[both].astype(np.uint64) * np.uint64(max(1, self.names.n)) + rank[both].astype(np.uint64))
            # relative to its word: the place must lie between the word's pointers
            inside = found & (place >= self.starts.access(at[both]).astype(np.int64)) & (place < self.starts.access(at[both] + 1).astype(np.int64))
            out[both[inside]] = self._value("values", place[inside])
        return out
