"""Suffix-array dedup: remove every byte inside a string of ``LENGTH`` bytes that also starts in a document with
a smaller id.

Sorting all suffixes of all documents at once would move many times the input, so suffixes that cannot matter
are ruled out first, exactly:

1. Documents with the same text are one; of each such group only the one with the smallest id goes on, the
   others lose everything (if they have ``LENGTH`` bytes).
2. Every window of ``LENGTH`` bytes has an anchor: the place of its smallest hash of ``GRAM`` bytes. Equal windows
   have equal anchors at equal places, so only windows whose anchor's hash occurs in two documents can matter.
   Anchors (one place in about 16) go, packed, to the shard of their hash with a hash of their context, the bytes
   that windows with this anchor can reach. An anchor whose whole context (equal by hash) is also in a document
   with a smaller id is covered at once; a task does this for its own batch before it sends, so a context that a
   third of all documents share is one entry per batch, not per document.
3. What is left - different contexts of one anchor hash - goes with its bytes to a shard. A context can only share a
   window with one that has the same anchor and agrees in the bytes that all windows of one of three kinds hold
   besides it (see ``KINDS``); contexts that agree with no other document's are dropped. All suffixes of
   the others are put in order by external induced sorting with common prefixes (see suffix_sort: queues, names and
   lists on disk, recursion on names, limited memory), whole anchors at a time, ``SORT_BYTES`` of text or one anchor more;
   neighbours that agree in ``LENGTH`` bytes are one string, and the smallest document of each decides.
4. An anchor with more than about ``HOT`` different contexts is hot: a line on many pages. Hot anchors are found in a
   sample of the documents (one in ``HOT_SAMPLE``; which are found changes only where work is done), and their entries
   are spread over the shards by context. Equal strings around an anchor agree in ``SIDE`` bytes before it or in
   ``SIDE`` bytes after it, so each hot context goes to two shards, that of either side's bytes, instead of its anchor's.
   Where even one side has more than ``HOT`` contexts, these are compared window by window (by 128 bits of hash), with the
   smallest document of each window found by partial aggregation.
5. The covered stretches of each document are joined and cut out of its text.

Texts are shuffled only for documents that have anything to check or to cut. Tables of ids are broadcast only
up to ``BROADCAST_ROWS`` rows, beyond that the joins shuffle. Every step is a written table in the shared folder.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; rows are told apart by id
and text, so repeated rows have equal results and never count as each other's smaller document; rows without an
id keep all bytes and remove none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import wordhash
from loomwright.llm.grouping import boundaries
from loomwright.llm.suffix_sort import suffix_array
from loomwright.session import Scratch, materialise, scratch

LENGTH, GRAM = 50, 20
SHARD_BYTES = 8 << 20
BROADCAST_ROWS = 1_000_000
#: Anchors with more different contexts than this are not sorted in one shard; at most so many are found beforehand,
#: from one document in so many.
HOT, MOST_HOT, HOT_SAMPLE = 20_000, 100_000, 64
BATCH_BYTES = 8 << 20
#: A context's bytes before and after its anchor.
BEFORE, AFTER = LENGTH - GRAM, LENGTH
#: Of two sides that together agree in LENGTH - GRAM bytes, one agrees in so many.
SIDE = (LENGTH - GRAM) // 2
#: A window has between 0 and LENGTH - GRAM bytes before its anchor and the rest after it. By that number there are three
#: kinds, in (bytes before, bytes after) that all windows of a kind have.
THIRD = (LENGTH - GRAM) // 3
KINDS = ((0, LENGTH - GRAM - THIRD + 1), (THIRD, LENGTH - GRAM - 2 * THIRD), (2 * THIRD + 1, 0))
#: Bytes of contexts that are sorted at once, and bytes of texts of which anchors are found at once.
SORT_BYTES, RUN_BYTES = 1 << 20, 1 << 18
ENTRY = np.dtype([("hash", "<u8"), ("context", "<u8"), ("pos", "<u4"), ("row", "<u2")])


def slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    span = 1
    while 2 * span <= n:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (n - span)], x[n - span :]) if span < n else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its row, hash, context hash) of every anchor of a run of rows."""
    n, windows = len(data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    power, inverse = wordhash._powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
    h = wordhash.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]) | np.uint64(1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    low = slide(h, windows, np.minimum)
    low[row[: n - LENGTH + 1] != row[LENGTH - 1 :]] = 0  # windows that cross rows have no anchor
    edge = np.zeros(windows - 1, np.uint64)
    at = np.flatnonzero(h == slide(np.concatenate((edge, low, edge)), windows, np.maximum))
    own = row[at]
    a, b = np.maximum(at - BEFORE, offsets[own]), np.minimum(at + AFTER, offsets[own + 1])
    place = (b - a).astype(np.uint64) * np.uint64(256) + (at - a).astype(np.uint64)
    context = wordhash.mix((sums[b] - sums[a]) * inverse[a] + place * np.uint64(0xD6E8FEB86659FD93))
    return own, at - offsets[own], h[at], context


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (text) to different (anchor, context) hashes."""
    for batch in batches:
        for _, data, offsets in wordhash.chunks(batch.column(0), RUN_BYTES):
            _, _, h, context = anchors(data, offsets)
            both = np.unique(np.rec.fromarrays([h, context], names="h,context"))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[c]).view(np.int64)) for c in ("h", "context")], names=["anchor", "context"])
    wordhash.trim()


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors that have many contexts in a sample of rows (doc, text_key, text)."""
    sample = rows.where(F.pmod(F.xxhash64("doc", "text_key"), F.lit(HOT_SAMPLE)) == 0).select("text")
    seen = sample.mapInArrow(_sampled, "anchor long, context long").distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    most = seen.where(F.col("n") > HOT / HOT_SAMPLE).orderBy(F.desc("n"), "anchor").limit(MOST_HOT)
    return np.sort(np.array([r["anchor"] for r in most.collect()], np.int64).view(np.uint64))


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def _send_anchors(shards: int, hot: np.ndarray):
    """Arrow batches of (doc, text_key, text) to packed entries: (shard, docs, keys, lengths, entries, covered)."""

    def pack(docs: np.ndarray, keys: np.ndarray, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[], [], [], []]
        base = 0
        sizes = []
        for part in texts:
            for first, data, offsets in wordhash.chunks(part, RUN_BYTES):
                for out, x in zip(found, anchors(data, offsets), strict=True):
                    out.append(x)
                found[0][-1] = found[0][-1] + base + first
                sizes.append(np.diff(offsets))
            base += len(part)
        row, pos, h, context = (np.concatenate(x) for x in found)
        found.clear()
        lengths = np.concatenate(sizes).astype(np.uint32)
        # equal contexts in this batch: only those of the smallest document go on
        order = np.lexsort((docs[row], context, h))
        row, pos, h, context = row[order], pos[order], h[order], context[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (context[1:] != context[:-1]))) if len(h) else np.zeros(0, bool)
        least = docs[row[new]][np.cumsum(new) - 1] if len(h) else docs[:0]
        covered = docs[row] > least
        entry = np.zeros(len(h), ENTRY)
        entry["hash"], entry["context"], entry["pos"], entry["row"] = h, context, pos, row
        del pos, row, new, least
        key = np.where(_is_hot(h, hot), wordhash.mix(h ^ context), h)
        shard = ((key >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        del h, context, key
        out = []
        order = np.argsort(shard, kind="stable")
        entry, shard, covered = entry[order], shard[order], covered[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            part, done = entry[cuts[s] : cuts[s + 1]], covered[cuts[s] : cuts[s + 1]]
            used, at = np.unique(part["row"], return_inverse=True)
            part = part.copy()
            part["row"] = at
            out.append((int(s), docs[used].tobytes(), keys[used].tobytes(), lengths[used].tobytes(), _columns(part[~done]), _columns(part[done])))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["shard", "docs", "keys", "lengths", "entries", "covered"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if held and (size > BATCH_BYTES or rows + part.num_rows > 60_000):
                    yield from pack(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [x[2] for x in held])
                    held, size, rows = [], 0, 0
                    wordhash.trim()
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), part.column(2)))
                size += part.column(2).nbytes
                rows += part.num_rows
        if held:
            yield from pack(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [x[2] for x in held])
        held = []
        wordhash.trim()

    return run


def _columns(entries: np.ndarray) -> bytes:
    """Entries field by field, which packs better."""
    return b"".join(entries[f].tobytes() for f in ENTRY.names)


def _entries(raw: bytes) -> np.ndarray:
    n = len(raw) // ENTRY.itemsize
    out, at = np.zeros(n, ENTRY), 0
    for f in ENTRY.names:
        size = ENTRY[f].itemsize * n
        out[f] = np.frombuffer(raw[at : at + size], ENTRY[f])
        at += size
    return out


FOUND = "doc long, text_key long, pos int, end int, anchor_hash long, hot boolean"
START = f"greatest(pos - {BEFORE}, 0) AS start"


def _match(table: pa.Table, hot: np.ndarray = np.zeros(0, np.uint64)) -> pa.Table:
    """One shard's anchors: covered contexts (anchor_hash 0), and contexts to be checked. Of a hot anchor a shard has
    only some contexts, all rows of each."""
    docs, keys, lengths, entries, done = [], [], [], [], []
    for r in table.select(["docs", "keys", "lengths", "entries", "covered"]).to_pylist():
        d, k, n = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["keys"], np.int64), np.frombuffer(r["lengths"], np.uint32)
        for raw, sure in ((r["entries"], False), (r["covered"], True)):
            e = _entries(raw)
            docs.append(d[e["row"]])
            keys.append(k[e["row"]])
            lengths.append(n[e["row"]])
            entries.append(e)
            done.append(np.full(len(e), sure))
    doc, key, length, e, sure = (np.concatenate(x) for x in (docs, keys, lengths, entries, done))
    order = np.lexsort((doc, e["context"], e["hash"]))
    doc, key, length, e, sure = doc[order], key[order], length[order], e[order], sure[order]
    h, context = e["hash"], e["context"]
    n = len(h)
    new_hash = np.concatenate(([True], h[1:] != h[:-1]))[:n]
    new = new_hash | np.concatenate(([True], context[1:] != context[:-1]))[:n]
    group = np.cumsum(new_hash) - 1
    least = doc[new][np.cumsum(new) - 1]
    covered = sure | (doc > least)
    contexts = np.bincount(group[new])  # different contexts of each hash
    first, last = np.minimum.reduceat(doc, np.flatnonzero(new_hash)), np.maximum.reduceat(doc, np.flatnonzero(new_hash))
    spread = _is_hot(h, hot)
    # of a context that its smallest document has at several places, every place: a smaller document may have part of it
    check = ~covered & (spread | ((contexts[group] > 1) & (first < last)[group]))
    pos = e["pos"].astype(np.int64)
    if (check & ~new).any():  # equal rows have equal places: one of each is checked
        some, own = np.flatnonzero(check), np.cumsum(new)
        some = some[np.lexsort((pos[some], key[some], own[some]))]
        a, b = some[:-1], some[1:]
        check[b[(own[a] == own[b]) & (key[a] == key[b]) & (pos[a] == pos[b])]] = False
    keep = covered | check
    end = np.minimum(pos + AFTER, length.astype(np.int64))
    group_hash = np.where(covered, np.uint64(0), h).view(np.int64)
    return pa.table({"doc": doc[keep], "text_key": key[keep], "pos": pos[keep].astype(np.int32), "end": end[keep].astype(np.int32), "anchor_hash": group_hash[keep], "hot": ((contexts > HOT)[group] | spread)[keep]})


def _freed(table: pa.Table) -> pa.Table:
    """A group's result; what was held for it is given back, as the worker lives on."""
    wordhash.trim()
    return table


def _check(table: pa.Table) -> pa.Table:
    """One shard's contexts: the stretches that smaller documents also have, by suffix order."""
    table = table.take(np.argsort(table["key"].to_numpy(), kind="stable")).combine_chunks()
    ends = np.cumsum(pc.binary_length(table["context"]).to_numpy().astype(np.int64) + 1)
    cuts = boundaries(table, ["key"])
    found, held = [], []
    low = size = 0
    # equal strings have equal anchors, so each key stands alone
    for b in cuts[1:]:
        if b < table.num_rows and ends[b - 1] - (ends[low - 1] if low else 0) < SORT_BYTES:
            continue
        part = table.slice(low, b - low)
        part = part.filter(pa.array(_agreeing(part)))
        low = b
        held.append(part)
        size += part["context"].nbytes
        if size > SORT_BYTES or b == table.num_rows:
            found.append(_sorted_spans(pa.concat_tables(held)))
            held, size = [], 0
    return pa.concat_tables(found)


def _bytes(contexts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of binary values."""
    if not len(contexts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pa.concat_arrays(contexts.chunks)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _agreeing(table: pa.Table) -> np.ndarray:
    """Whether a context agrees with one of another document and the same key in the bytes of some kind of windows."""
    keys, docs = table["key"].to_numpy(), table["doc"].to_numpy()
    data, offsets = _bytes(table["context"])
    power, inverse = wordhash._powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    anchor = offsets[:-1] + table["at"].to_numpy()
    out = np.zeros(len(keys), bool)
    for before, after in KINDS:
        first, last = anchor - before, anchor + GRAM + after
        some = np.flatnonzero((first >= offsets[:-1]) & (last <= offsets[1:]))
        h = wordhash.mix((sums[last[some]] - sums[first[some]]) * inverse[first[some]])
        order = np.lexsort((docs[some], h, keys[some]))
        some, h = some[order], h[order]
        n = len(some)
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (keys[some[1:]] != keys[some[:-1]])))[:n]
        at = np.flatnonzero(new)
        several = docs[some[at]] < docs[some[np.append(at[1:], n)[: len(at)] - 1]]
        out[some[several[np.cumsum(new) - 1]]] = True
    return out


def _sorted_spans(table: pa.Table) -> pa.Table:
    """The stretches of contexts that smaller documents also have. A context that a document has at several places is
    sorted once."""
    if not table.num_rows:
        return pa.table({c: pa.array([], kind) for c, kind in (("doc", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()))})
    every = table.select(["doc", "text_key", "start"])
    own = table["context"].combine_chunks().dictionary_encode()
    own = (own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).indices.to_numpy()
    copies = np.lexsort((own, every["text_key"].to_numpy(), every["doc"].to_numpy()))
    new = np.concatenate(([True], np.logical_or.reduce([x[copies[1:]] != x[copies[:-1]] for x in (own, every["text_key"].to_numpy(), every["doc"].to_numpy())])))
    begin_of = np.append(np.flatnonzero(new), len(copies))
    table = table.take(copies[new])
    docs, keys = table["doc"].to_numpy(), table["text_key"].to_numpy()
    raw, offsets = _bytes(table["context"])
    sizes = np.diff(offsets)
    # suffix_array takes no zero byte, and UTF-8 text has neither 254 nor 255: raise all by one, 255 separates
    first = offsets[:-1] + np.arange(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[: max(0, len(raw) + len(sizes) - 1)]
    shifted = np.full(len(owner), 255, np.uint8)
    shifted[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = raw + np.uint8(1)
    suffixes, common = suffix_array(shifted, LENGTH)
    at = suffixes - first[owner[suffixes]]
    whole = at + LENGTH <= sizes[owner[suffixes]]
    group = np.cumsum(common < LENGTH) - 1
    suffixes, group, at = suffixes[whole], group[whole], at[whole]
    who = owner[suffixes]
    least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[who])
    gone = docs[who] > least[group]
    who, at = who[gone], at[gone]
    order = np.lexsort((at, who))
    who, at = who[order], at[order]
    n = len(who)
    new = np.concatenate(([True], (who[1:] != who[:-1]) | (at[1:] > at[:-1] + LENGTH)))[:n]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)[: len(begin)] - 1
    times = np.diff(begin_of)[who[begin]]
    span = np.repeat(np.arange(len(begin)), times)
    place = copies[begin_of[who[begin]][span] + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)]
    base = every["start"].to_numpy().astype(np.int64)[place]
    start, stop = base + at[begin][span], base + at[end][span] + LENGTH
    return pa.table({"doc": docs[who[begin]][span], "text_key": keys[who[begin]][span], "start": start.astype(np.int32), "end": stop.astype(np.int32)})


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _by_windows(contexts: DataFrame) -> DataFrame:
    """As _check, for contexts (written) that may be too many for one task."""
    whole = contexts.where(F.octet_length("context") >= LENGTH)
    each = whole.select("doc", "text_key", "start", "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("at"))
    window = F.unhex(F.md5(F.substring(F.col("context"), F.col("at") + 1, F.lit(LENGTH))))
    windows = each.select("doc", "text_key", (F.col("start") + F.col("at")).alias("start"), window.alias("window"))
    least = windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    least = materialise(least, "least")  # a written side: a small one goes to every task, else Spark splits hot windows
    gone = windows.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "window").where("doc > least")
    return gone.select("doc", "text_key", "start", (F.col("start") + LENGTH).alias("end"))


def _sides(text: bytes, pos: int, anchor: int) -> list[int]:
    """Keys of the bytes on either side of an anchor, where there are enough."""
    after, seed = pos + GRAM, anchor % (1 << 64)
    out = []
    if pos >= SIDE:
        out.append(xxhash.xxh3_64_intdigest(text[pos - SIDE : pos], seed) >> 1)
    if after + SIDE <= len(text):
        out.append(xxhash.xxh3_64_intdigest(text[after : after + SIDE], seed ^ 1) >> 1)
    return out


def _ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows joined to a written table of (doc, text_key) by its counted size."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ["doc", "text_key"], how)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc, text_key, text; copies: doc, text_key of rows with an earlier equal text; spans: doc,
    text_key and the sorted list of (start, end) in bytes that go). All other tables on the way are removed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    with scratch(wordhash.small_batches(docs).sparkSession) as tables:
        copies, spans = _spans(rows, tables)
    return rows, copies, spans


def _spans(rows: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    keyed = materialise(rows.select("doc", "text_key", F.md5("text").alias("digest"), F.octet_length("text").alias("n_bytes")), "texts")
    total = keyed.agg(F.sum(F.col("n_bytes").cast("long"))).first()[0] or 0
    shards = max(8, -(-total // SHARD_BYTES))
    firsts = materialise(keyed.where("doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("least")), "firsts")
    copies = tables.keep(keyed.join(firsts, "digest").where((F.col("doc") > F.col("least")) & (F.col("n_bytes") >= LENGTH)).select("doc", "text_key").distinct(), "copies")
    long = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc", "text_key", "text")
    rest = _ids(long, copies, "left_anti")
    hot = hot_anchors(rest)
    packed = rest.mapInArrow(_send_anchors(shards, hot), "shard long, docs binary, keys binary, lengths binary, entries binary, covered binary")
    found = materialise(packed.groupBy("shard").applyInArrow(lambda table: _freed(_match(table, hot)), FOUND), "anchors", compact=False)
    sure = found.where("anchor_hash = 0").selectExpr("doc", "text_key", START, "end")
    open_ = found.where("anchor_hash <> 0")

    def cut(sides: bool):
        """Arrow batches of (doc, text_key, text, wanted) to contexts with the key of their shard, or of either side."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    text = batch.column(2)[i].as_py().encode()
                    want = batch.column(3)[i].values
                    pos, end, anchor = (want.field(c).to_numpy() for c in ("pos", "end", "anchor_hash"))
                    keys, at = (anchor.view(np.uint64) >> np.uint64(33)).astype(np.int64), np.arange(len(pos))
                    if sides:
                        both = [(k, side) for k in range(len(pos)) for side in _sides(text, int(pos[k]), int(anchor[k]))]
                        at, keys = np.array([k for k, _ in both], np.int64), np.array([x for _, x in both], np.int64)
                    place = pos[at].astype(np.int32)
                    start = np.maximum(place - BEFORE, 0)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(np.full(n, batch.column(0)[i].as_py(), np.int64)), pa.array(np.full(n, batch.column(1)[i].as_py(), np.int64)), pa.array(start), pa.array(place - start), pa.array([text[s:e] for s, e in zip(start, end[at], strict=True)], pa.binary())],
                        names=["key", "doc", "text_key", "start", "at", "context"],
                    )

        return run

    def contexts(some: DataFrame, sides: bool) -> DataFrame:
        doubtful = materialise(some.select("doc", "text_key").distinct(), "doubtful")
        texts = _ids(long, doubtful, "left_semi").dropDuplicates(["doc", "text_key"])
        wanted = some.groupBy("doc", "text_key").agg(F.collect_list(F.struct("pos", "end", "anchor_hash")).alias("wanted"))
        return texts.join(wanted, ["doc", "text_key"]).select("doc", "text_key", "text", "wanted").mapInArrow(cut(sides), "key long, doc long, text_key long, start int, at int, context binary")

    to_check = contexts(open_.where("NOT hot"), False)
    by_windows = None
    if not open_.where("hot").isEmpty():
        spread = materialise(contexts(open_.where("hot"), True), "hot")
        wide = materialise(spread.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "wide")
        if not wide.isEmpty():
            wide = F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide
            by_windows = _by_windows(spread.join(wide, "key", "left_semi"))
            spread = spread.join(wide, "key", "left_anti")
        to_check = to_check.unionByName(spread)
    checked = to_check.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(lambda table: _freed(_check(table)), "doc long, text_key long, start int, end int")
    if by_windows is not None:
        checked = checked.unionByName(by_windows)
    spans = sure.unionByName(checked).groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return copies, tables.keep(spans, "spans", compact=False)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""
    rows, copies, spans = repeated_spans(docs, id_col, text_col)
    touched = materialise(spans.select("doc", "text_key"), "touched")
    size = F.octet_length("text").cast("long")
    empty = F.sha2(F.lit(""), 256)
    changed = materialise(copies.unionByName(touched), "changed")
    plain = _ids(rows, changed, "left_anti").select("doc", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text"), 256).alias("kept_sha256"))
    whole = _ids(rows, copies, "left_semi").select("doc", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, runs = batch.column(1)[i].as_py().encode(), batch.column(2)[i].values
                spans = merge_spans(runs.field("start").to_numpy(), runs.field("end").to_numpy())
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    edited = _ids(rows, touched, "left_semi").join(spans, ["doc", "text_key"]).select("doc", "text", "spans")
    edited = edited.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return plain.unionByName(whole).unionByName(edited).withColumnRenamed("doc", id_col)
