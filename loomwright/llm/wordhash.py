"""Word hashes of whole Arrow batches with numpy.

A word's hash is a polynomial over its bytes modulo 2^64, read off prefix sums, then mixed; texts are taken in
runs of about ``CHUNK`` bytes, so that memory is bounded by the longest text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK = 1 << 20
#: The setting for the bytes of an Arrow batch, and what the operators use where a session does not set it: texts and sets
#: of shingles are large, and a batch is held by the JVM and by a worker at once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + 2)
        both = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS = both[0], both[1]
    return _POWERS


#: How to free what an operator keeps in this worker between tasks, by operator.
_KEPT: dict[str, Callable[[], object]] = {}


def claim(operator: str, free: Callable[[], object] | None = None) -> None:
    """At the beginning of a task: what other operators keep in this worker is freed, as workers live on."""
    others = [k for k in _KEPT if k != operator]
    for other in others:
        _KEPT.pop(other)()
    if others:
        trim()
    if free is not None:
        _KEPT[operator] = free


def trim() -> None:
    """Give freed memory back, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends batches of a bounded size from now on, unless it has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alnum_table() -> np.ndarray:
    """Bytes of words of letters, digits and everything beyond ASCII."""
    t = np.zeros(256, bool)
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        t[a : b + 1] = True
    return t


def nonspace_table() -> np.ndarray:
    """Bytes of words between ASCII white space."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64)
    t[0x41:0x5B] += 0x20
    return t + np.uint64(1)


LOWER = _lower_table()


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; null texts are empty."""
    claim("hashes")
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each row's end as offsets of len(rows) + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.concatenate(([False], table[data], [False]))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    power, inverse = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LOWER[data] * power[:n], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; one of all words where there are fewer."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(3) + words[i : i + len(out)] + np.uint64(i))
    return out
