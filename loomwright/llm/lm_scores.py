"""Language-model scores from an Elias-Fano n-gram trie.

The model is a bigram model with Dirichlet smoothing: p(w | v) = (c(v, w) + MU q(w)) / (c(v) + MU), where q(w) is
c(w) / (N + 1), or 1 / (N + 1) for a word not seen. Its logarithm splits into a part of (v, w), which needs only
counts of w, and a part of v, which needs only its count; so one shuffle by word is enough, both to count and
to score, and no executor holds the whole model, which grows with the corpus.

1. Words are counted (hashes and counts, gathered per batch): N, V, and the hot words, those with more than a
   share of a shard. There are at most 4 x shards of them, and at most ``MOST_HOT`` are taken; their counts go to
   all tasks.
2. Tokens go, packed, to the shard of their word; hot words are spread over the shards by the word before.
3. Each shard builds its trie - words, and below each the words before it, in Elias-Fano levels with quantised
   values, as memory-mapped files in a temporary folder, one range of words after the other - and scores its
   tokens by successor search.
4. The parts of each batch's documents meet again, packed, and are added.

A word's hash has 64 bits, of which the trie keeps 63. Defined results: a null text is one end token;
repeated rows and rows with one id are rows of their own (told apart by task, batch and place); a null id counts as training; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import wordhash
from loomwright.llm.elias_fano import Trie
from loomwright.session import materialise

MU = 100.0
SHARD_TOKENS, SLICE_TOKENS = 4_000_000, 500_000
BATCH_BYTES = 6 << 20
#: Words that are spread over the shards, at most; any other word is less than a hundred-thousandth of all tokens.
MOST_HOT = 100_000
#: Stands for a null id on the way.
NO_ID = -(1 << 63)
END, BEGIN = np.uint64(2), np.uint64(4)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2, F.lit(False))


def _gathered(batches: Iterator[pa.RecordBatch], texts_at: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches in lists of about BATCH_BYTES and at most 60,000 rows."""
    held, size, rows = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            if held and (size > BATCH_BYTES or rows + part.num_rows > 60_000):
                yield held
                held, size, rows = [], 0, 0
            held.append(part)
            size += part.column(texts_at).nbytes
            rows += part.num_rows
    if held:
        yield held


def _tokens(parts: list[pa.RecordBatch], texts_at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, row) of all tokens of the slices; each row ends with END and begins after BEGIN."""
    table = wordhash.nonspace_table()
    words, rows, base = [], [], 0
    for part in parts:
        for first, data, offsets in wordhash.chunks(part.column(texts_at)):
            h, at = wordhash.hashes(data, offsets, table)
            n = len(offsets) - 1
            ends = at[1:] + np.arange(n)
            word = np.empty(len(h) + n, np.uint64)
            plain = np.ones(len(word), bool)
            plain[ends] = False
            word[plain], word[ends] = h | np.uint64(8), END
            words.append(word)
            rows.append(np.repeat(np.arange(n), np.diff(at) + 1) + base + first)
        base += part.num_rows
    word, row = np.concatenate(words), np.concatenate(rows)
    before = np.concatenate((np.array([BEGIN]), word[:-1]))
    before[before == END] = BEGIN
    return word, before, row


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in training rows; END's count is the number of their documents. Of
    ``rows`` (held, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _gathered(batches, 1):
            word, _, row = _tokens(parts, 1)
            train = ~np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in parts])
            h, n = np.unique(word[train[row]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])
            del word, row, train, h, n
            wordhash.trim()

    return rows.select("held", "text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


PACKED = "shard long, docs binary, held binary, batch long, rows binary, words binary, counts binary, names binary, before binary, owner binary"


def _pack(shards: int, hot: np.ndarray):
    """Arrow batches of (doc_id, held, text) to packed tokens by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, parts in enumerate(_gathered(batches, 2)):
            word, before, row = _tokens(parts, 2)
            docs = np.concatenate([p.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
            held = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts])
            batch = (task << 32) + number
            key = word.copy()
            spread = np.isin(word, hot)
            key[spread] = wordhash.mix(word[spread] + wordhash.mix(before[spread]))
            shard = (wordhash.mix(key) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((row, before, word, shard))
            word, before, row, shard = word[order], before[order], row[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                w, b, r = word[cuts[s] : cuts[s + 1]], before[cuts[s] : cuts[s + 1]], row[cuts[s] : cuts[s + 1]]
                words, counts = np.unique(w, return_counts=True)
                names, name_at = np.unique(b, return_inverse=True)
                used, owner = np.unique(r, return_inverse=True)
                small = np.uint16 if len(names) < 65536 else np.uint32
                out.append((int(s), docs[used].tobytes(), held[used].tobytes(), batch, used.astype(np.uint16).tobytes(), words.tobytes(), counts.astype(np.uint32).tobytes(), names.tobytes(), name_at.astype(small).tobytes(), owner.astype(np.uint16).tobytes()))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 6]
            del word, before, row, shard, key, order, out
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=PACKED.replace(" long", "").replace(" binary", "").split(", "))
            del cols
            wordhash.trim()

    return run


PARTS = "batch long, rows binary, tokens binary, known binary, base binary, score binary, ended binary, docs binary, held binary"
SCORED = "doc long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _slices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A shard's tokens (word, word before, row of the shard) in slices of about SLICE_TOKENS, by ranges of words."""
    blobs, total, base = [], 0, 0
    for r in table.select(["words", "counts", "names", "before", "owner", "docs"]).to_pylist():
        words, counts, names = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.uint32), np.frombuffer(r["names"], np.uint64)
        before = np.frombuffer(r["before"], np.uint16 if len(names) < 65536 else np.uint32)
        blobs.append((words, counts, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), names, before, np.frombuffer(r["owner"], np.uint16), base))
        total += len(before)
        base += len(r["docs"]) // 8
    n = max(1, -(-total // SLICE_TOKENS))
    cuts = [np.uint64(k * ((1 << 64) // n)) for k in range(n)] + [None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        word, before, owner = [], [], []
        for words, counts, offsets, names, name_at, own, first in blobs:
            i = np.searchsorted(words, low)
            j = len(words) if high is None else np.searchsorted(words, high)
            a, b = offsets[i], offsets[j]
            word.append(np.repeat(words[i:j], counts[i:j]))
            before.append(names[name_at[a:b]])
            owner.append(own[a:b].astype(np.int32) + np.int32(first))
        if word and sum(map(len, word)):
            yield np.concatenate(word), np.concatenate(before), np.concatenate(owner)


def _score(hot: np.ndarray, hot_counts: np.ndarray, total: int, documents: int, mu: float):
    """One shard's tokens to each row's parts, packed as they came, by batch; a row's id comes with its end token."""

    def run(table: pa.Table) -> pa.Table:
        heads = table.select(["docs", "held", "batch", "rows"]).to_pylist()
        doc = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in heads])
        held = np.concatenate([np.frombuffer(r["held"], bool) for r in heads])
        n_rows = len(doc)
        tokens, known, base, score, ended = (np.zeros(n_rows) for _ in range(5))
        for word, before, owner in _slices(table):
            order = np.lexsort((before, word))
            word, before, owner = word[order], before[order], owner[order]
            new_word = np.concatenate(([True], word[1:] != word[:-1]))
            new_pair = new_word | np.concatenate(([True], before[1:] != before[:-1]))
            word_at, pair_at = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
            train = ~held[owner]
            count = np.bincount(word_at, weights=train).astype(np.int64)
            names = word[new_word]
            if len(hot):
                place = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
                is_hot = hot[place] == names
                count[is_hot] = hot_counts[place[is_hot]]
            pairs = np.bincount(pair_at, weights=train)
            pair_word, pair_before, pair_count = word[new_pair], before[new_pair], count[word_at[new_pair]]
            seen = pairs > 0
            with tempfile.TemporaryDirectory() as folder:
                used = np.flatnonzero(count > 0)
                starts = np.append(np.searchsorted(pair_word[seen], names[used]), int(seen.sum()))
                Trie.write(folder, names[used], np.log10(mu * count[used] / (total + 1)), starts, pair_before[seen], np.log10(pairs[seen] + mu * pair_count[seen] / (total + 1)))
                trie = Trie(folder)
                value = trie.score(pair_word, pair_before, math.log10(mu / (total + 1)))[pair_at]
                del trie
            c = count[word_at]
            end = word == END
            # each word is also the word before the next token; the begin mark is before each first one
            value -= np.where(end, math.log10(documents + mu), np.log10(c + mu))
            for out, weights in ((tokens, None), (known, c > 0), (base, np.log10(c + 1.0)), (score, value), (ended, end)):
                out += np.bincount(owner, weights=weights, minlength=n_rows)
        del table
        wordhash.trim()
        cuts = np.cumsum([0, *(len(r["held"]) for r in heads)])
        out: list[list] = [[] for _ in range(9)]
        for r, i, j in zip(heads, cuts[:-1], cuts[1:], strict=True):
            end = ended[i:j] > 0
            row = (r["batch"], r["rows"], tokens[i:j].astype("<u4"), known[i:j].astype("<u4"), base[i:j], score[i:j], end, doc[i:j][end], held[i:j][end])
            for c, v in zip(out, row, strict=True):
                c.append(v.tobytes() if isinstance(v, np.ndarray) else v)
        names = [x.split(" ")[0] for x in PARTS.split(", ")]
        return pa.table({n: pa.array(c, pa.int64() if n == "batch" else pa.binary()) for n, c in zip(names, out, strict=True)})

    return run


def _add(table: pa.Table) -> pa.Table:
    """The parts of one batch's rows, added up."""
    parts = table.to_pylist()
    rows = [np.frombuffer(p["rows"], np.uint16) for p in parts]
    n = int(max(r.max() for r in rows)) + 1
    sums = {k: np.zeros(n) for k in ("tokens", "known", "base", "score")}
    doc, held = np.zeros(n, np.int64), np.zeros(n, bool)
    for p, r in zip(parts, rows, strict=True):
        for k, kind in (("tokens", "<u4"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")):
            sums[k][r] += np.frombuffer(p[k], kind)  # a row is in a part once
        end = r[np.frombuffer(p["ended"], bool)]
        doc[end], held[end] = np.frombuffer(p["docs"], np.int64), np.frombuffer(p["held"], bool)
    return pa.table({"doc": doc, "held_out": held, "n_tokens": sums["tokens"].astype(np.int64), "n_known": sums["known"].astype(np.int64), "base": sums["base"], "score": sums["score"]})


def lm_scores(docs: DataFrame, mu: float = MU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model)."""
    rows = wordhash.small_batches(docs).select(F.col(id_col).cast("long").alias("doc"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    counts = materialise(word_counts(rows), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    documents = (counts.where(F.col("word") == int(END)).first() or {"n": 0})["n"]
    shards = max(4, -(-int(total * 7 / 6) // SHARD_TOKENS))
    # at most 4 x shards rows, and at most MOST_HOT
    often = counts.where(F.col("n") > total / (4 * shards)).orderBy(F.desc("n"), "word").limit(MOST_HOT)
    hot_rows = sorted((r["word"] % (1 << 64), r["n"]) for r in often.collect())
    hot, hot_counts = np.array([h for h, _ in hot_rows], np.uint64), np.array([n for _, n in hot_rows], np.int64)
    packed = rows.mapInArrow(_pack(shards, hot), PACKED)
    parts = packed.groupBy("shard").applyInArrow(_score(hot, hot_counts, total, documents, mu), PARTS)
    summed = parts.groupBy("batch").applyInArrow(_add, SCORED)
    return summed.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), "score",
    )

