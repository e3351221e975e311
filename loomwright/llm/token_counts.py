"""Token counts by a dynamic program that only counts.

An Aho-Corasick automaton finds every vocabulary piece in a word; dynamic programming over the end places keeps
the score and the number of pieces, never the pieces. Which piece ends at a place depends on the file's kind:

* Unigram files (``Unigram``): the best sum of scores (Viterbi). Of equal scores the earliest start wins; a
  character that is no piece of its own costs the lowest score less 10; runs of such characters fuse.
* BPE files (``Merges``), whose scores are merge ranks and no log-probabilities: the merges' result of a prefix
  ends with the one piece that the merges make of its own string and that meets the last piece of the prefix
  before it undisturbed, that is, no merge across their border would have come before both were complete. So the
  counts are the tokenizer's own; the score is the sum of the pieces' scores.

Characters without a piece count as their bytes (byte fallback). Words begin at each space, as with the tokenizer's
space marker (BPE: at each run of them), so that a word is scored once per worker and cached (``CACHE`` words at most).

Runs in Arrow batches inside the tasks: no shuffle. Defined results: a null or empty text has 0 tokens and
score 0; rows give one row each; long texts and words without spaces are handled whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.wordhash import claim, small_batches, trim

CACHE = 300_000
UNKNOWN_PENALTY = 10.0
MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Pairs of pieces whose meeting is remembered, at most.
PAIRS = 1_000_000


class Unigram:
    """Pieces with scores, read from a sentencepiece file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        self.scores = dict(self.pieces)
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.find = ahocorasick.Automaton()
        for piece, score in self.pieces:
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.singles = {p for p in self.scores if len(p) == 1}
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Number of pieces and best score of one word."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count, run = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        matches = self.find.iter(word)
        end, piece = next(matches, (n, None))
        for e in range(n):
            top, start, known = None, e, False
            while end == e:
                size, score = piece
                s = e + 1 - size
                if top is None or best[s] + score > top:
                    top, start, known = best[s] + score, s, True
                end, piece = next(matches, (n, None))
            if word[e] not in self.singles and (top is None or best[e] + self.unknown > top):
                top, start, known = best[e] + self.unknown, e, False
            best[e + 1] = top
            if known:
                count[e + 1] = count[start] + self._run(word, run[start], start) + 1
            else:
                count[e + 1], run[e + 1] = count[start], run[start] if run[start] >= 0 else start
        return count[n] + self._run(word, run[n], n), best[n]

    def _run(self, word: str, start: int, end: int) -> int:
        """Tokens of a fused run of unknown characters."""
        if start < 0:
            return 0
        text = word[start:end]
        return 1 if text in self.scores else len(text.encode())

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        tokens, total, cache = 0, 0.0, self.cache
        for w in re.findall(f"{MARK}[^{MARK}]*", text if text[0] == MARK else MARK + text):
            found = cache.get(w)
            if found is None:
                if len(cache) > CACHE:
                    cache.clear()
                found = self.word(w)
                if len(w) <= 64:
                    cache[w] = found
            tokens += found[0]
            total += found[1]
        return tokens, total


class Merges:
    """A sentencepiece file of kind BPE with byte fallback and no normalisation but the space marker in front."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.byte_scores = [model.get_score(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        if not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError(f"{path}: no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError(f"{path}: pieces across words")
        order = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in self.scores.items()}
        #: made[p]: the rank of a piece's last merge and the two parts, for pieces that the merges make of their own string
        self.made: dict[str, tuple[int, str, str]] = {}
        self.find = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            parts = self._last_parts(piece)
            if parts:
                self.made[piece] = (self.rank[piece], *parts)
            if parts or len(piece) == 1:
                self.find.add_word(piece, (piece, score))
        self.find.make_automaton()
        self.met: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, tuple[int, float]] = {}

    def _last_parts(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge, None if the merges end otherwise."""
        parts, rank = list(piece), self.rank
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def compatible(self, x: str, y: str) -> bool:
        """Whether no merge joins what ever stands on both sides of the border of x and y."""
        made, rank, none = self.made, self.rank, (-1, "", "")
        gone_x = gone_y = len(rank)
        while True:
            r = rank.get(x + y)
            if r is not None and r < gone_x and r <= gone_y:
                return False
            of_x, of_y = made.get(x, none), made.get(y, none)
            if of_x[0] < 0 and of_y[0] < 0:
                return True
            if of_x[0] > of_y[0]:
                gone_x, x = of_x[0], of_x[2]
            else:
                gone_y, y = of_y[0], of_y[1]

    def word(self, word: str) -> tuple[int, float]:
        """Number of pieces of one word and the sum of their scores."""
        n, met = len(word), self.met
        last: list[str | None] = [""] + [None] * n  # the piece that ends here; "" after an unknown character
        count, total = [0] * (n + 1), [0.0] * (n + 1)
        at = 0
        for end, (piece, score) in self.find.iter(word):
            if end < at:
                continue  # its place has its piece
            while at < end:
                self._bytes(word, at, last, count, total)
                at += 1
            s = end + 1 - len(piece)
            before = last[s]
            if before:
                good = met.get((before, piece))
                if good is None:
                    if len(met) > PAIRS:
                        met.clear()
                    good = met[before, piece] = self.compatible(before, piece)
                if not good:
                    continue
            last[end + 1], count[end + 1], total[end + 1] = piece, count[s] + 1, total[s] + score
            at = end + 1
        while at < n:
            self._bytes(word, at, last, count, total)
            at += 1
        return count[n], total[n]

    def _bytes(self, word: str, at: int, last: list, count: list[int], total: list[float]) -> None:
        """The place of a character that is no piece."""
        raw = word[at].encode()
        last[at + 1], count[at + 1], total[at + 1] = "", count[at] + len(raw), total[at] + sum(self.byte_scores[b] for b in raw)

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        tokens, total, cache = 0, 0.0, self.cache
        for w in WORDS.findall(MARK + text.replace(" ", MARK)):
            found = cache.get(w)
            if found is None:
                if len(cache) > CACHE:
                    cache.clear()
                found = self.word(w)
                if len(w) <= 64:
                    cache[w] = found
            tokens += found[0]
            total += found[1]
        return tokens, total


_LOADED: dict[tuple[type, str], Unigram | Merges] = {}


def load(path: str, kind: type = Unigram) -> Unigram | Merges:
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kind: type = Unigram) -> DataFrame:
    """Per document: n_tokens and the score of its segmentation. ``kind`` is the file's: ``Unigram`` or ``Merges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token counts", _LOADED.clear)
        model = load(path, kind)
        for batch in batches:
            done = [model.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.float64())], names=[id_col, "n_tokens", "score"])
        trim()

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, score double")
