"""Suffix and common-prefix arrays of one shard by external induced sorting.

Suffixes are L or S by whether they are larger or smaller than the next one; an S after an L (LMS) starts a new
piece. Two scans induce all others from the sorted LMS suffixes: upwards, each suffix in order sends its
predecessor, if that is L, to the place of its first symbol; downwards likewise for S. What is sent is a tuple (first
symbol, position, common prefix with the one sent to the same symbol before it). Tuples wait in a priority queue on
disk: symbols are cut into ranges, each with a queue that is a file with a buffer; tuples of one symbol arrive in
their final order. A symbol with many suffixes has a range of its own, which is a plain first-in-first-out queue and is
read in blocks; other ranges are loaded whole and worked off in batches, each as long as nothing that it sends must come
before its end. Of two tuples sent to one symbol, the common prefix is one more than the smallest common prefix
between their senders, of which one number a symbol is kept.

The LMS suffixes are sorted by recursion: the same two scans from LMS suffixes in any order sort the pieces; equal pieces
get equal names, and the string of names, shorter by half at least, is sorted in the same way. The recursion ends
where a string and its sort fit in the memory limit, or all names differ.

Text, types, LMS positions, names and sorted lists are files, mapped into memory where they are read; heap memory is
a few blocks, buffers of a bounded size and the counts of symbols. A shard that fits in the limit is sorted by the
same scans with all of this in memory, and its LMS suffixes by their first ``depth`` bytes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

TUPLE = np.dtype([("sym", "<u4"), ("pos", "<u4"), ("lcp", "u1")])
#: Heap bytes that sorting in memory needs for each symbol of a string.
IN_MEMORY = 48
#: Entries of a range that are looked at for one batch.
WINDOW = 1 << 16


class Store:
    """One list of tuples per range: a file and what is not written yet. All files together are the disk's share of the
    queue; ``limit`` bytes of buffers are held in memory."""

    def __init__(self, folder: str | None, name: str, limit: int):
        self.folder, self.name, self.limit, self.held = folder, name, limit, 0
        self.buffers: dict[int, list[np.ndarray]] = {}
        self.taken: dict[int, int] = {}

    def _path(self, r: int) -> str:
        return os.path.join(self.folder, f"{self.name}.{r}")

    def push(self, r: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        self.buffers.setdefault(r, []).append(rows)
        self.held += rows.nbytes
        if self.folder is not None and self.held > self.limit:
            for k, parts in self.buffers.items():
                with open(self._path(k), "ab") as f:
                    for part in parts:
                        part.tofile(f)
            self.buffers, self.held = {}, 0

    def rows(self, r: int) -> np.ndarray:
        """The whole list; what is on disk is mapped, not read."""
        parts = self.buffers.get(r, [])
        if len(parts) > 1:
            parts = self.buffers[r] = [np.concatenate(parts)]
        if self.folder is None or not os.path.exists(self._path(r)):
            return parts[0] if parts else np.zeros(0, TUPLE)
        if parts:
            with open(self._path(r), "ab") as f:
                parts[0].tofile(f)
            self.held -= parts[0].nbytes
            del self.buffers[r]
        return np.memmap(self._path(r), TUPLE, "r")

    def next(self, r: int, most: int) -> np.ndarray:
        """The next tuples of a range's queue, at most ``most``; none if it is empty now."""
        if r not in self.buffers and r not in self.taken and (self.folder is None or not os.path.exists(self._path(r))):
            return np.zeros(0, TUPLE)
        low = self.taken.get(r, 0)
        rows = self.rows(r)
        out = np.array(rows[low : low + most])
        self.taken[r] = low + len(out)
        return out

    def drop(self, r: int) -> None:
        self.held -= sum(x.nbytes for x in self.buffers.pop(r, []))
        self.taken.pop(r, None)
        if self.folder is not None and os.path.exists(self._path(r)):
            os.remove(self._path(r))


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low + 1 .. high]) for each pair low < high."""
    size = high - low
    level = np.floor(np.log2(size)).astype(np.int64)
    out = np.empty(len(low), np.uint8)
    table, k = values, 0
    top = int(level.max(initial=0))
    while True:
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at] + 1], table[high[at] + 1 - (1 << k)])
        if k == top:
            return out
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1


class _String:
    """A string of symbols with its types, ranges and, for the outermost string, common prefixes up to ``depth``."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, limit: int, folder: str | None, level: int = 0):
        self.text, self.n, self.symbols, self.depth, self.limit, self.folder, self.level = text, len(text), symbols, depth, limit, folder, level
        self.block = max(256, limit // 256)
        self._types()
        self._ranges()

    def _array(self, name: str, kind, size: int) -> np.ndarray:
        if self.folder is None or size == 0:
            return np.zeros(size, kind)
        return np.memmap(os.path.join(self.folder, f"{name}{self.level}"), kind, "w+", shape=(size,))

    def _types(self) -> None:
        """True for S-type suffixes; the end is smaller than everything, so the last suffix is L-type."""
        self.stype = self._array("types", bool, self.n)
        after = False
        step = self.n if self.folder is None else self.block * 4
        for low in range((self.n - 1) // step * step, -1, -step):
            high = min(self.n, low + step)
            x = np.asarray(self.text[low:high]).astype(np.int64)
            last = int(self.text[high]) if high < self.n else -1
            rise = np.sign(np.append(x[1:], last) - x)
            where = np.where(rise != 0, np.arange(len(x)), len(x))
            where = np.minimum.accumulate(where[::-1])[::-1]
            out = np.where(where < len(x), rise[np.minimum(where, len(x) - 1)] > 0, after)
            self.stype[low:high] = out
            after = bool(out[0])

    def _ranges(self) -> None:
        counts = np.zeros(self.symbols, np.int64)
        step = self.n if self.folder is None else self.block * 4
        for low in range(0, self.n, step):
            part = np.asarray(self.text[low : low + step])
            counts += np.bincount(part, minlength=self.symbols)
        most = max(1024, min(self.n // 600, self.block))
        heavy = counts > most
        group = (np.cumsum(counts) - counts) // most
        new = np.ones(self.symbols, bool)
        new[1:] = (group[1:] != group[:-1]) | heavy[1:] | heavy[:-1]
        self.starts = np.flatnonzero(new)
        self.single = heavy[self.starts] | (np.diff(np.append(self.starts, self.symbols)) == 1)

    def range_of(self, sym: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sym, "right") - 1

    def lms(self) -> np.ndarray:
        """Positions of LMS suffixes, in order."""
        out, step = [], self.n if self.folder is None else self.block * 4
        size = 0
        for low in range(0, self.n, step):
            high = min(self.n, low + step)
            s = np.asarray(self.stype[max(0, low - 1) : high])
            at = np.flatnonzero(s[1:] & ~s[:-1]) + max(0, low - 1) + 1
            out.append(at.astype(np.uint32))
            size += len(at)
            if self.folder is not None:
                with open(os.path.join(self.folder, f"lms{self.level}"), "ab") as f:
                    out.pop().tofile(f)
        if self.folder is None:
            return np.concatenate(out) if out else np.zeros(0, np.uint32)
        return np.memmap(os.path.join(self.folder, f"lms{self.level}"), np.uint32, "r") if size else np.zeros(0, np.uint32)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes, up to depth, of the suffixes at a and b of a string of bytes, eight bytes at a time."""
        word = np.ndarray((self.n,), ">u8", self.padded, strides=(1,))
        out, live = np.zeros(len(a), np.uint8), np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        for at in range(0, self.depth, 8):
            live = live[np.maximum(a[live], b[live]) + at < self.n]
            x = word[a[live] + at].astype(np.uint64) ^ word[b[live] + at].astype(np.uint64)
            same = np.zeros(len(x), np.uint8)
            for k in range(1, 9):
                same += (x >> np.uint64(64 - 8 * k)) == 0
            out[live] = np.minimum(at + same, self.depth)
            live = live[same == 8]
            if not len(live):
                break
        return np.minimum(out, self.n - np.maximum(a, b)).astype(np.uint8)

    # induction -------------------------------------------------------------------------------------------------

    def scan(self, fixed: Store, to_s: bool, name: str, lcps: bool) -> Store:
        """One scan, upwards for L-type suffixes, downwards (``to_s``) for S-type ones, over the lists of ``fixed`` (in
        the scan's order) and all that is sent on the way; gives the lists of what was sent, in the scan's order."""
        queue, done = (Store(self.folder, f"{x}{name}{self.level}.", self.limit // 8) for x in ("queue", "done"))
        self.lcps, self.want, self.sign = lcps, to_s, -1 if to_s else 1
        self.since = np.full(self.symbols if lcps else 0, 255, np.uint8)
        self.sent = np.zeros(self.symbols if lcps else 0, bool)
        self.before: tuple[int, int, bool] | None = None  # symbol, position and whether fixed of the last one scanned
        if not to_s:
            last = np.zeros(1, TUPLE)
            last["sym"], last["pos"] = self.text[self.n - 1], self.n - 1
            queue.push(int(self.range_of(last["sym"])[0]), last)
            if lcps:
                self.sent[int(last["sym"][0])] = True
                self.since[int(last["sym"][0])] = 0
        order = range(len(self.starts))
        for r in reversed(order) if to_s else order:
            if self.single[r]:
                while len(rows := queue.next(r, self.block)):
                    self.emit(rows, False, queue)
                    done.push(r, rows)
                while len(rows := fixed.next(r, self.block)):
                    self.emit(rows, True, queue)
            else:
                self._mixed(r, queue, fixed, done)
            queue.drop(r)
        return done

    def _mixed(self, r: int, queue: Store, fixed: Store, done: Store) -> None:
        sent, own = np.array(queue.rows(r)), np.array(fixed.rows(r))
        queue.drop(r)
        rows = np.concatenate((sent, own))
        kind = np.concatenate((np.zeros(len(sent), np.int64), np.ones(len(own), np.int64)))
        key = rows["sym"].astype(np.int64) * self.sign
        order = np.argsort(2 * key + kind, kind="stable")
        rows, kind, key = rows[order], kind[order], key[order]
        while len(rows):
            n = min(len(rows), WINDOW)
            pos = rows["pos"][:n].astype(np.int64) - 1
            target = np.full(n, np.iinfo(np.int64).max)
            at = np.flatnonzero(pos >= 0)
            at = at[self.stype[pos[at]] == self.want]
            symbol = self.text[pos[at]].astype(np.int64)
            inside = self.range_of(symbol) == r
            target[at[inside]] = symbol[inside] * self.sign
            least = np.minimum.accumulate(np.concatenate((target[:1] * 0 + np.iinfo(np.int64).max, target[:-1])))
            late = np.flatnonzero(np.where(kind[:n] == 0, key[:n] > least, key[:n] >= least))
            cut = int(late[0]) if len(late) else n
            batch, kinds = rows[:cut], kind[:cut]
            new = self.emit(batch, kinds == 1, queue, r)
            done.push(r, batch[kinds == 0])
            rows, kind, key = rows[cut:], kind[cut:], key[cut:]
            if len(new):
                rows, kind = np.concatenate((rows, new)), np.concatenate((kind, np.zeros(len(new), np.int64)))
                key = np.concatenate((key, new["sym"].astype(np.int64) * self.sign))
                order = np.argsort(2 * key + kind, kind="stable")
                rows, kind, key = rows[order], kind[order], key[order]

    def emit(self, rows: np.ndarray, is_fixed, queue: Store, own: int = -1) -> np.ndarray:
        """Scan tuples in order: note their common prefixes and send the predecessors; those that go to the range
        ``own`` are given back."""
        pos = rows["pos"].astype(np.int64)
        lcp = None
        if self.lcps:
            sym = rows["sym"].astype(np.int64)
            is_fixed = np.broadcast_to(is_fixed, len(rows))
            last_sym, last_pos, last_fixed = self.before or (-1, 0, False)
            sym0, pos0, fixed0 = np.append(last_sym, sym[:-1]), np.append(last_pos, pos[:-1]), np.append(last_fixed, is_fixed[:-1])
            lcp = np.where(sym0 != sym, 0, rows["lcp"]).astype(np.uint8)
            seam = np.flatnonzero((sym0 == sym) & is_fixed & ~fixed0)  # the first fixed one after those sent
            lcp[seam] = self.common(pos0[seam], pos[seam])
            rows["lcp"] = lcp
            self.before = int(sym[-1]), int(pos[-1]), bool(is_fixed[-1])
        at = np.flatnonzero(pos > 0)
        at = at[self.stype[pos[at] - 1] == self.want]
        new = np.zeros(len(at), TUPLE)
        new["pos"] = pos[at] - 1
        symbol = self.text[pos[at] - 1].astype(np.int64)
        new["sym"] = symbol
        if self.lcps:
            new["lcp"] = self._carried(lcp, at, symbol)
        if not len(at):
            return new
        r = self.range_of(symbol)
        order = np.argsort(r, kind="stable")
        new, r = new[order], r[order]
        cuts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        given = new[:0]
        for a, b in zip(cuts, np.append(cuts[1:], len(r)), strict=True):
            if r[a] == own:
                given = new[a:b]
            else:
                queue.push(int(r[a]), new[a:b])
        return given

    def _carried(self, lcp: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Common prefixes of what the entries ``at`` of a batch send with what was sent to the same symbol before."""
        n = len(lcp)
        out = np.zeros(len(at), np.uint8)
        so_far = np.minimum.accumulate(lcp)
        order = np.argsort(symbol, kind="stable")
        s, a = symbol[order], at[order]
        first = np.append(True, s[1:] != s[:-1])[: len(s)]
        since = np.minimum(self.since[s[first]], so_far[a[first]])
        value = np.zeros(len(s), np.int64)
        value[first] = np.where(self.sent[s[first]], np.minimum(since.astype(np.int64) + 1, self.depth), 0)
        rest = np.flatnonzero(~first)
        if len(rest):
            value[rest] = np.minimum(_range_minima(lcp, a[rest - 1], a[rest]).astype(np.int64) + 1, self.depth)
        out[order] = value
        np.minimum(self.since, so_far[-1], out=self.since)
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True)[: len(s)])
        self.since[s[ends]] = 255
        open_ = ends[a[ends] < n - 1]
        if len(open_):
            self.since[s[open_]] = _range_minima(lcp, a[open_], np.full(len(open_), n - 1))
        self.sent[s[ends]] = True
        return out

    def both(self, seeds: Iterator[tuple[np.ndarray, np.ndarray]], lcps: bool) -> tuple[Store, Store]:
        """The lists of L-type and of S-type suffixes from LMS ones in order (blocks of positions and common prefixes)."""
        fixed = Store(self.folder, f"seeds{lcps}{self.level}.", self.limit // 8)
        for pos, lcp in seeds:
            rows = np.zeros(len(pos), TUPLE)
            rows["pos"], rows["lcp"], rows["sym"] = pos, lcp, self.text[pos.astype(np.int64)]
            r = self.range_of(rows["sym"])
            order = np.argsort(r, kind="stable")
            rows, r = rows[order], r[order]
            cuts = np.flatnonzero(np.append(True, r[1:] != r[:-1])[: len(r)])
            for a, b in zip(cuts, np.append(cuts[1:], len(r)), strict=True):
                fixed.push(int(r[a]), rows[a:b])
        large = self.scan(fixed, False, f"l{lcps}", lcps)
        for r in range(len(self.starts)):
            fixed.drop(r)
        small = self.scan(_Reversed(large), True, f"s{lcps}", lcps)
        return large, small

    def ascending(self, large: Store, small: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in order with the common prefix with the one before, in blocks."""
        for r in range(len(self.starts)):
            low, high = large.rows(r), small.rows(r)
            if not self.single[r]:
                both = np.concatenate((low, _upwards(high, 0, len(high))))
                kind = np.append(np.zeros(len(low), np.int64), np.ones(len(high), np.int64))
                order = np.argsort(2 * both["sym"].astype(np.int64) + kind, kind="stable")
                both, kind = both[order], kind[order]
                parts = [both] if len(both) else []
            else:
                parts = [np.array(low[a : a + self.block]) for a in range(0, len(low), self.block)] if len(low) <= self.block else (np.array(low[a : a + self.block]) for a in range(0, len(low), self.block))
                tops = (_upwards(high, max(0, b - self.block), b) for b in range(len(high), 0, -self.block))
                parts = (x for some in (parts, tops) for x in some)
                kind = None
            before: tuple[int, int] | None = None
            seen = 0
            for part in parts:
                pos, lcp = part["pos"].astype(np.int64), part["lcp"].copy()
                if self.lcps:
                    sym = part["sym"].astype(np.int64)
                    sym0, pos0 = np.append(-1 if before is None else before[0], sym[:-1]), np.append(0 if before is None else before[1], pos[:-1])
                    lcp[sym0 != sym] = 0
                    if kind is None:
                        seam = np.array([0] if seen == len(low) and len(low) else [], np.int64)
                    else:
                        seam = np.flatnonzero((sym0 == sym) & (kind == 1) & (np.append(1, kind[:-1]) == 0))
                    lcp[seam] = self.common(pos0[seam], pos[seam])
                    before = int(sym[-1]), int(pos[-1])
                seen += len(part)
                yield pos, lcp

    # LMS suffixes ----------------------------------------------------------------------------------------------

    def lms_sorted(self) -> Iterator[np.ndarray]:
        """Positions of the LMS suffixes in their order, in blocks."""
        lms = self.lms()
        m = len(lms)
        if not m:
            return
        if self.folder is None:
            word = np.ndarray((self.n,), ">u8", self.padded, strides=(1,))
            at = lms.astype(np.int64)
            yield at[np.lexsort([_words(word, at + k, self.n) for k in range((self.depth - 1) // 8 * 8, -8, -8)])]
            return
        large, small = self.both(((np.asarray(lms[a : a + self.block]), np.zeros(1, np.uint8)) for a in range(0, m, self.block)), False)
        names = np.memmap(os.path.join(self.folder, f"names{self.level + 1}"), np.uint32, "w+", shape=(m,))
        name, before = -1, None
        for pos, _ in self.ascending(large, small):
            pos = pos[self.stype[pos] & (pos > 0)]
            pos = pos[~self.stype[pos - 1]]
            if not len(pos):
                continue
            new = ~self._same_piece(lms, pos[:-1], pos[1:])
            first = before is None or not self._same_piece(lms, np.array([before]), pos[:1])[0]
            number = name + np.cumsum(np.append(first, new))
            names[np.searchsorted(lms, pos)] = number
            name, before = int(number[-1]), int(pos[-1])
        for r in range(len(self.starts)):
            large.drop(r)
            small.drop(r)
        for order in _ordered(names, name + 1, self.limit, self.folder, self.level + 1):
            yield np.asarray(lms[order]).astype(np.int64)

    def _same_piece(self, lms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces at a and b (from one LMS place up to and with the next) are equal; the last piece, which
        ends with the string, is like no other."""
        out = np.zeros(len(a), bool)
        if not len(a):
            return out
        end = lambda x: np.append(lms, [0])[np.searchsorted(lms, x) + 1].astype(np.int64) if len(lms) < self.block else _after(lms, x)
        size_a, size_b = end(a) - a, end(b) - b
        live = np.flatnonzero((size_a == size_b) & (size_a > 0))
        out[live] = True
        at = 0
        while len(live):
            differ = self.text[a[live] + at] != self.text[b[live] + at]
            out[live[differ]] = False
            at += 1
            live = live[~differ & (at <= size_a[live])]
        return out


class _Reversed(Store):
    """The lists of a scan as the next scan's fixed ones, which goes the other way."""

    def __init__(self, of: Store):
        super().__init__(None, "", 0)
        self.of = of

    def rows(self, r: int) -> np.ndarray:
        rows = self.of.rows(r)
        return _upwards(rows, 0, len(rows))

    def next(self, r: int, most: int) -> np.ndarray:
        rows = self.of.rows(r)
        high = len(rows) - self.taken.get(r, 0)
        out = _upwards(rows, max(0, high - most), high)
        self.taken[r] = self.taken.get(r, 0) + len(out)
        return out


def _upwards(rows: np.ndarray, low: int, high: int) -> np.ndarray:
    """rows[low:high] in the opposite order, each with the common prefix with the one that then stands before it."""
    out = np.array(rows[low:high])[::-1].copy()
    after = np.array(rows["lcp"][low + 1 : high + 1])
    out["lcp"] = np.append(after, np.zeros(high - low - len(after), np.uint8))[::-1]
    return out


def _after(lms: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The LMS place after each of x; 0 for the last."""
    k = np.searchsorted(lms, x) + 1
    return np.where(k < len(lms), lms[np.minimum(k, len(lms) - 1)], 0).astype(np.int64)


def _words(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.where(at < n, word[np.minimum(at, n - 1)].astype(np.uint64), np.uint64(0))


def _ordered(names: np.ndarray, distinct: int, limit: int, folder: str, level: int) -> Iterator[np.ndarray]:
    """The suffixes of a string of names in order, in blocks."""
    n = len(names)
    step = max(256, limit // 256)
    if distinct == n:
        order = np.memmap(os.path.join(folder, f"order{level}"), np.uint32, "w+", shape=(n,))
        for a in range(0, n, step):
            order[names[a : a + step]] = np.arange(a, min(n, a + step))
        yield from (np.asarray(order[a : a + step]).astype(np.int64) for a in range(0, n, step))
    elif n * IN_MEMORY <= limit:
        rank = names.astype(np.int64)
        width = 1
        while True:  # ranks by the first width names, doubled until all differ
            after = np.append(rank[width:] + 1, np.zeros(min(width, n), np.int64))
            order = np.lexsort((after, rank))
            new = np.append(False, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1:
                break
            width *= 2
        yield order
    else:
        string = _String(names, distinct, 0, limit, folder, level)
        seeds = ((pos, np.zeros(1, np.uint8)) for pos in string.lms_sorted())
        yield from (pos for pos, _ in string.ascending(*string.both(seeds, False)))


def sorted_suffixes(text: np.ndarray, depth: int, limit: int = 400 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffixes in order, common prefix up to ``depth`` with the suffix before) of bytes without a zero byte,
    which may be a mapped file. Suffixes that agree in their first ``depth`` bytes stand together, in any order. About
    ``limit`` bytes of heap are used; strings are below 2^32 bytes."""
    n = len(text)
    if n == 0:
        return
    if n * IN_MEMORY <= limit:
        yield from _sorted(text, depth, limit, None)
        return
    with tempfile.TemporaryDirectory() as folder:
        yield from _sorted(text, depth, limit, folder)


def _sorted(text: np.ndarray, depth: int, limit: int, folder: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(text)
    string = _String.__new__(_String)
    string.folder, string.level = folder, 0
    string.padded = string._array("text", np.uint8, n + 8)
    for a in range(0, n, 1 << 20):
        string.padded[a : min(n, a + (1 << 20))] = text[a : a + (1 << 20)]
    string.__init__(string.padded[:n], 256, depth, limit, folder)

    def seeds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        before = None
        for whole in string.lms_sorted():
            for a in range(0, len(whole), max(string.block, 1 << 16)):
                pos = whole[a : a + max(string.block, 1 << 16)]
                lcp = np.zeros(len(pos), np.uint8)
                lcp[1:] = string.common(pos[:-1], pos[1:])
                if before is not None:
                    lcp[:1] = string.common(np.array([before]), pos[:1])
                before = int(pos[-1])
                yield pos, lcp

    yield from string.ascending(*string.both(seeds(), True))


def suffix_array(text: np.ndarray, depth: int, limit: int = 400 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of ``sorted_suffixes`` as two arrays."""
    parts = list(sorted_suffixes(text, depth, limit))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
