"""BPE encoding and decoding by speculation and verification.

Every new word is first cut by greedy longest match, all words of a batch in one pass of an automaton. A cut is the merges' own result if each token is what the
merges make of its own string and each pair of neighbours is compatible, that is, no merge across their border
would have come before the tokens were complete. Both checks are run for all tokens and pairs of a batch at once
with numpy: ranks rise from part to whole, so undoing the later of the two tokens at the border again and again
shows every pair of symbols that ever met there. Only words with a failing pair are merged one by one.

Works in Arrow batches inside the tasks: no shuffle, memory bounded by a batch and a cache of two generations of ``CACHE``
words, of which those that are used again live on.

Defined results: a null text is empty (no ids, empty decoded text); rows give one row each; very long texts and
words are handled whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.wordhash import claim, small_batches, trim

CACHE = 250_000
NUL = "\0"
# The code points with the property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def category_ranges(first: str) -> str:
    """A character class's inside: all code points whose category starts with ``first``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def byte_letters() -> list[str]:
    """The visible letter for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _ascii_part(m: re.Match) -> str:
    """The ASCII characters of a range in a character class."""
    if m[1] is None:
        return ""
    low, high = int(m[1], 16), min(int(m[2], 16), 127)
    return f"\\x{low:02x}-\\x{high:02x}" if low <= high else ""


class WordBpe:
    """A tokenizer file of kind BPE with word ends, NFC, lower case and a splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for name, inside in ((r"\p{L}", category_ranges("L")), (r"\p{N}", category_ranges("N")), (r"\s", SPACE)):
            split = split.replace(f"[{name}]", f"[{inside}]").replace(name, inside)
        # what cannot begin where another part does is tried first: most words are letters
        parts = split.split("|")
        plain = [x for x in parts if re.fullmatch(r"\[[^\]^][^\]]*\]\+?", x) and not re.match(x, "'")] if "(" not in split else []
        self.pattern = re.compile("|".join(plain + [x for x in parts if x not in plain]))
        # on ASCII the classes are small, and so is the work for each character
        small = [re.sub(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})|\\u2000-\\u200a|\\u[0-9a-f]{4}|\\x85|\\xa0", _ascii_part, x) for x in plain + [x for x in parts if x not in plain]]
        self.ascii_pattern = re.compile("|".join(small))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        #: all tokens, with a NUL for the end of a word, and how many characters of a marked word they take
        self.find, self.size = ahocorasick.Automaton(), np.zeros(max(self.ids.values()) + 1, np.int64)
        for t, i in self.ids.items():
            own = t.removesuffix(self.end) + NUL if t.endswith(self.end) else t
            if i not in self.special.values():
                self.find.add_word(own, i)
                self.size[i] = len(own)
        self.find.make_automaton()
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        n = max(self.ids.values()) + 1
        self.rank, self.left, self.right = (np.full(n, -1, np.int64) for _ in range(3))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged.setdefault((i, j), (r, k))
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        keys = np.array([i * n + j for i, j in self.merged], np.int64)
        ranks = np.array([r for r, _ in self.merged.values()], np.int64)
        order = np.argsort(keys)
        self.n, self.keys, self.key_ranks = n, keys[order], ranks[order]
        self.sound = self._sound()
        #: ids (as characters with these code points) of the words of this generation and of the one before
        self.ids_of: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.shown = [self.names.get(i, "") for i in range(max(self.names) + 1)]

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of merging x with y; very high if there is none."""
        key = x * self.n + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins what ever stands on both sides of the border of x and y, before ``until``."""
        x, y = x.astype(np.int64), y.astype(np.int64)
        top = np.full(len(x), np.iinfo(np.int64).max - 1) if until is None else until.astype(np.int64)
        gone_x, gone_y, good = top.copy(), top.copy(), np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            r = self._pair_rank(a, b)
            bad = (r < gone_x[live]) & (r <= gone_y[live]) & (r < top[live])
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            undo_x = on & (ra > rb)
            undo_y = on & ~undo_x
            gone_x[live[undo_x]], x[live[undo_x]] = ra[undo_x], self.right[a[undo_x]]
            gone_y[live[undo_y]], y[live[undo_y]] = rb[undo_y], self.left[b[undo_y]]
            live = live[on]
        return good

    def _sound(self) -> np.ndarray:
        """Tokens that the merges make of their own string: the last merge's parts are sound and meet undisturbed."""
        sound = np.ones(self.n, bool)
        made = np.flatnonzero(self.rank >= 0)
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        while True:
            now = sound.copy()
            now[made] &= sound[self.left[made]] & sound[self.right[made]]
            if (now == sound).all():
                return sound
            sound = now

    def _letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode())

    def propose(self, letters: str) -> list[int]:
        """Greedy longest match from the left."""
        ids, out, i, n = self.ids, [], 0, len(letters)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = ids.get(letters[i:] + self.end if j == n else letters[i:j])
                if t is not None:
                    out.append(t)
                    break
            i = j
        return out

    def merge(self, letters: str) -> list[int]:
        """Exact merging: the lowest rank first, from the left. Short words keep the ranks of their pairs in a list, long
        ones in a heap over linked places."""
        parts = [self.ids[c] for c in letters[:-1]] + [self.ids[letters[-1] + self.end]]
        return self._merge_short(parts) if len(parts) <= 32 else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        get, none = self.merged.get, (sys.maxsize, -1)
        pairs = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs))[1] >= 0:
            i = pairs.index(best)
            parts[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((parts[i - 1], best[1]), none)
            if i < len(pairs):
                pairs[i] = get((best[1], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        import heapq

        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merged[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.merged]
        heapq.heapify(heap)
        while heap:
            _, token, i, pair = heapq.heappop(heap)
            j = after[i] if i < n else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j], after[i] = token, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (parts[a], parts[b])) in self.merged:
                    heapq.heappush(heap, (*self.merged[p], a, p))
        return [p for p in parts if p >= 0]

    def proposals(self, letters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, word of each) of greedy cuts of all words, in order of words: one pass of an automaton over all of them.
        A word that it leaves a gap in (no token ends the word there) is cut by itself."""
        sizes = np.fromiter(map(len, letters), np.int64, len(letters)) + 1
        found = list(self.find.iter_long(NUL.join(letters) + NUL))
        ends, tokens = np.array(found, np.int64).reshape(-1, 2).T
        owner = np.searchsorted(np.cumsum(sizes), ends, "right")
        gaps = np.flatnonzero(np.bincount(owner, weights=self.size[tokens], minlength=len(letters)) != sizes)
        if len(gaps):
            keep = ~np.isin(owner, gaps)
            cuts = [self.propose(letters[k]) for k in gaps]
            tokens = np.append(tokens[keep], np.fromiter((t for c in cuts for t in c), np.int64))
            owner = np.append(owner[keep], np.repeat(gaps, [len(c) for c in cuts]))
            order = np.argsort(owner, kind="stable")
            tokens, owner = tokens[order], owner[order]
        return tokens, owner

    def learn(self, words: list[str]) -> None:
        """Encode new words into the cache: propose, check all pairs at once, merge what fails."""
        if not words:
            return
        letters = [self._letters(w) for w in words]
        flat, owner = self.proposals(letters)
        failed = np.zeros(len(words), bool)
        failed[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] * self.n + flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs // self.n, pairs % self.n)
        failed[owner[inside[~good[back]]]] = True
        every = "".join(map(chr, flat.tolist()))
        starts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        for w, own, bad, low, high in zip(words, letters, failed.tolist(), starts, starts[1:], strict=False):
            self.ids_of[w] = "".join(map(chr, self.merge(own))) if bad else every[low:high]

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens in it stand as themselves, marked by a leading NUL."""
        if "<|" not in text and not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.specials.split(text)):
            out += ["\0" + part] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """Per text: number of ids, ids as little-endian 32-bit integers, decoded text."""
        cut = [self.words(t) for t in texts]
        every = set().union(*cut)
        if len(self.ids_of) + len(every) > CACHE:
            self.older, self.ids_of = self.ids_of, {}
        new = every.difference(self.ids_of)
        for w in new & self.older.keys():
            self.ids_of[w] = self.older[w]
        new -= self.older.keys()
        for w in [w for w in new if w[0] == NUL and w[1:] in self.special]:
            self.ids_of[w] = chr(self.special[w[1:]])
            new.discard(w)
        self.learn(sorted(new))
        ids_of, shown = self.ids_of.__getitem__, self.shown.__getitem__
        out = []
        for words in cut:
            ids = "".join(map(ids_of, words)).encode("utf-32-le", "surrogatepass")
            out.append((len(ids) // 4, ids, " ".join(map(shown, memoryview(ids).cast("I")))))
        return out


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One tokenizer per worker and path."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def pieces(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters."""
    low = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: n_tokens, ids (array) and decoded text; or, with ``digest``, their SHA-256 sums."""
    kind = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _LOADED.clear)
        bpe = load(path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for low, high in pieces(texts):
                done = bpe.encode(texts[low:high])
                counts = pa.array([d[0] for d in done], pa.int64())
                if digest:
                    cols = [pa.array([hashlib.sha256(d[1]).hexdigest() for d in done]), pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done])]
                else:
                    cols = [pa.array([np.frombuffer(d[1], "<u4").astype("int32") for d in done], pa.list_(pa.int32())), pa.array([d[2] for d in done])]
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), counts, *cols], names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])
                del done, cols, counts
            del texts, ids
        trim()

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, {kind}")
