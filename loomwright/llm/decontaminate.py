"""Benchmark decontamination by size-partitioned MinHash containment search, verified on all shingles.

Items and documents are sets of five-word shingles (lower-case words of letters and digits), hashed to 64 bits;
an item of fewer words is one shingle of all its words, and documents are shingled at that width too. Items are
partitioned by width and size (number of shingles, doubling). An item's sketch is the bottom k of its shingle
hashes, with k = floor((1 - t) * s) + 1 for s shingles: a document that holds a share t of the item misses at
most floor((1 - t) * s) of its shingles, so it holds at least one of the sketch - the search loses nothing. Each
partition is searched by itself: a document's sketch there is its shingles up to the largest sketch hash of the
partition, about 1 - t of them for large items and up to all of them for the smallest. Documents that share a
sketch hash with an item are candidates, verified on all shingles of the pair (by their 64-bit hashes).

The items' shingles go to every task while they take at most ``BROADCAST_BYTES`` (counted first); then one
pass over the texts finds and verifies, with no shuffle of texts or shingles. Beyond that every task gets a bit
map of the sketch hashes, of a fixed size, so that only shingles that can be in a sketch are moved; they meet the
sketches in a shuffled join, and only the candidates' texts are read again for the verification.

Defined results: rows are told apart by id and text; each text is judged by itself, and an id with several texts
has the largest number of common shingles of any of them; items without a word match nothing; a null or empty
text holds nothing; repeated rows give each pair once; the texts of a repeated item id are items of their own,
of which the pair shows the best match (the most common shingles, then the fewest shingles); rows without an id
hold nothing that could be reported and stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm import wordhash
from loomwright.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH, CONTAINED = 5, 0.8
BROADCAST_BYTES = 32 << 20
#: Bits of the map of sketch hashes, and of one of its blocks.
MAP_BITS, BLOCK_BITS = 1 << 27, 1 << 16
PAIRS = "doc long, text_key long, item long, n_shingles long, n_common long"


def _runs(texts: pa.Array, widths: list[int]) -> Iterator[tuple[int, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """Per run of rows: first row, words per row, and per width the rows and hashes of all shingles."""
    table = wordhash.alnum_table()
    for first, data, offsets in wordhash.chunks(texts):
        words, at = wordhash.hashes(data, offsets, table)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        out = {}
        for width in widths:
            n = len(words) - width + 1
            if n > 0:
                h = wordhash.shingles(words, width)
                inside = row[:n] == row[width - 1 :]
                out[width] = row[:n][inside], h[inside]
        yield first, np.diff(at), out


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _rows(ids: str, widths: list[int], own_width: bool, wanted: np.ndarray | None = None, tops: dict[int, list[tuple[int, int]]] | None = None):
    """Arrow batches of (id, text_key, text) to rows (id, text_key, width, h), each once: of an item its own width, of
    a document all widths. With ``wanted`` and ``tops``, only what can be in a sketch: hashes whose bit is set, with the
    size classes (as bits) whose largest sketch hash they do not exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, n_words, found in _runs(batch.column(2), widths):
                for width, (row, h) in found.items():
                    if own_width:
                        own = np.minimum(n_words, WIDTH)[row] == width
                        row, h = row[own], h[own]
                    if wanted is not None:
                        slot = (h % np.uint64(MAP_BITS)).astype(np.int64)
                        hit = (wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                        row, h = row[hit], h[hit]
                    pairs = np.unique(np.rec.fromarrays([first + row, h], names="row,h"))
                    row, h = np.ascontiguousarray(pairs["row"]), np.ascontiguousarray(pairs["h"])
                    cols = [pa.array(keys[row]), pa.array(texts[row]), pa.array(np.full(len(row), width, np.int32)), pa.array(h.view(np.int64))]
                    names = [ids, "text_key", "width", "h"]
                    if tops is not None:
                        classes = np.zeros(len(h), np.int64)
                        for size_class, most in tops[width]:
                            classes |= np.where(h <= np.uint64(most), np.int64(1 << size_class), np.int64(0))
                        cols.append(pa.array(classes))
                        names.append("classes")
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def item_sketches(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """item, item_key (its text's hash), width, h, s (shingles of the item), its size class and whether h is in the
    item's sketch. Hashes are ordered as unsigned numbers."""
    rows = items.select(F.col("item_id").cast("long").alias("item"), _text_key(F.col("text")).alias("text_key"), "text").where("item IS NOT NULL")
    rows = rows.mapInArrow(_rows("item", list(range(1, WIDTH + 1)), True), "item long, text_key long, width int, h long").distinct()
    by = Window.partitionBy("item", "text_key", "width")
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    ranked = rows.withColumn("s", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy(unsigned)))
    keep = F.floor((100 - round(100 * contained)) * F.col("s") / 100) + 1  # in whole percents, free of rounding errors
    size_class = F.floor(F.log2(F.col("s").cast("double"))).cast("int")
    return ranked.select("item", F.col("text_key").alias("item_key"), "width", "h", "s", size_class.alias("size_class"), (F.col("rank") <= keep).alias("sketched"))


def _partitions(rows: pa.Table) -> dict[int, list[dict[str, np.ndarray]]]:
    """Sketch rows as sorted arrays per width and size class."""
    item, key, width, h, size_class, sketched = (rows[c].to_numpy() for c in ("item", "item_key", "width", "h", "size_class", "sketched"))
    h = h.view(np.uint64)
    out: dict[int, list[dict[str, np.ndarray]]] = {}
    for w, c in sorted(set(zip(width.tolist(), size_class.tolist(), strict=True))):
        own = np.flatnonzero((width == w) & (size_class == c))
        own = own[np.lexsort((h[own], key[own], item[own]))]
        new = np.append(True, (item[own][1:] != item[own][:-1]) | (key[own][1:] != key[own][:-1]))
        number, drawn = np.cumsum(new) - 1, np.flatnonzero(sketched[own])
        drawn = drawn[np.argsort(h[own][drawn], kind="stable")]
        starts = np.append(np.flatnonzero(new), len(own))
        out.setdefault(w, []).append({"ids": item[own][new], "all": h[own], "item_start": starts, "sketch": h[own][drawn], "sketch_item": number[drawn], "most": h[own][drawn].max()})
    return out


def _search(partitions: dict[int, list[dict[str, np.ndarray]]], contained: float):
    """Arrow batches of (doc, text_key, text) to verified pairs, with all items at hand, partition by partition."""
    percent = round(100 * contained)

    def verified(x: dict[str, np.ndarray], row: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        low = np.flatnonzero(h <= x["most"])
        a, b = np.searchsorted(x["sketch"], h[low], "left"), np.searchsorted(x["sketch"], h[low], "right")
        hit = np.flatnonzero(b > a)
        pairs = {(int(row[low[i]]), int(item)) for i in hit for item in x["sketch_item"][a[i] : b[i]]}
        for r, item in sorted(pairs):
            own = x["all"][x["item_start"][item] : x["item_start"][item + 1]]
            held = h[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
            common = int(np.isin(own, held).sum())
            if 100 * common >= percent * len(own):
                yield r, int(x["ids"][item]), len(own), common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out: list[tuple[int, ...]] = []
            for first, _, found in _runs(batch.column(2), sorted(partitions)):
                for width, (row, h) in found.items():
                    for x in partitions[width]:
                        out += [(int(keys[first + r]), int(texts[first + r]), *rest) for r, *rest in verified(x, row, h)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "text_key", "item", "n_shingles", "n_common"])
        wordhash.trim()

    return run


def _bit_map(sketched: DataFrame) -> np.ndarray:
    """The map of all sketch hashes: MAP_BITS bits, whatever the number of hashes."""

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, np.uint8)
        bits[rows["slot"].to_numpy() % BLOCK_BITS] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slots = sketched.select(F.col("h").bitwiseAND(F.lit(MAP_BITS - 1)).alias("slot")).distinct()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in slots.withColumn("block", F.floor(F.col("slot") / BLOCK_BITS)).groupBy("block").applyInArrow(block, "block long, bits binary").toLocalIterator():
        out[r["block"] * (BLOCK_BITS // 8) :][: BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def matches(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, text_key, item, n_shingles, n_common) of every text with at least ``contained`` of an item."""
    every = materialise(item_sketches(items, contained), "benchmark")
    texts = wordhash.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc"), _text_key(F.col("text")).alias("text_key"), "text").where("doc IS NOT NULL")
    if every.count() * 37 <= broadcast_bytes:  # bytes of a row's numbers
        return texts.mapInArrow(_search(_partitions(every.toArrow()), contained), PAIRS).distinct()
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    tops: dict[int, list[tuple[int, int]]] = {}
    # a row per width and size class: sizes double, so there are at most 5 x 64
    for r in every.where("sketched").groupBy("width", "size_class").agg(F.max(unsigned).alias("most")).collect():
        tops.setdefault(r["width"], []).append((r["size_class"], (r["most"] ^ -(1 << 63)) % (1 << 64)))
    wanted = _bit_map(every.where("sketched"))
    low = texts.mapInArrow(_rows("doc", sorted(tops), False, wanted, tops), "doc long, text_key long, width int, h long, classes long")
    sketches = every.where("sketched").select("item", "item_key", "width", "h", "size_class")
    in_class = F.expr("shiftright(classes, size_class) & 1") == 1
    pairs = materialise(low.join(sketches, ["width", "h"]).where(in_class).select("doc", "text_key", "item", "item_key").distinct(), "candidates")
    again = texts.join(pairs.select("doc", "text_key").distinct(), ["doc", "text_key"], "left_semi")
    held = again.mapInArrow(_rows("doc", sorted(tops), False), "doc long, text_key long, width int, h long").distinct()
    common = held.join(every, ["width", "h"]).join(pairs, ["doc", "text_key", "item", "item_key"], "left_semi")
    found = common.groupBy("doc", "text_key", "item", "item_key", F.col("s").alias("n_shingles")).agg(F.count("*").alias("n_common"))
    return found.where(100 * F.col("n_common") >= round(100 * contained) * F.col("n_shingles")).drop("item_key")


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, item, n_shingles, n_common, containment) of every pair with at least ``contained`` of the item."""
    best = F.max(F.struct("n_common", (-F.col("n_shingles")).alias("less")))
    found = matches(docs, items, contained, broadcast_bytes).groupBy("doc", "item").agg(best.alias("x"))
    found = found.select("doc", "item", (-F.col("x.less")).alias("n_shingles"), F.col("x.n_common").alias("n_common"))
    return found.withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    bad = materialise(matches(docs, items, contained).select("doc", "text_key").distinct(), "leaks")
    same = (docs["doc_id"].cast("long") == bad["doc"]) & (_text_key(docs["text"]) == bad["text_key"])
    return docs.join(bad, same, "left_anti")


ORACLE = rf"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text,'{UPPER}','{LOWER}'),'{WORD}') AS w, row_number() OVER () AS ir FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(text,'{UPPER}','{LOWER}'),'{WORD}') AS w, row_number() OVER () AS dr FROM documents),
ia AS (SELECT item_id, ir, least(len(w),{WIDTH}) AS k, w, unnest(range(1, (len(w)-least(len(w),{WIDTH})+2)::BIGINT)) AS p FROM i WHERE len(w) > 0),
ib AS (SELECT DISTINCT item_id, ir, k, array_to_string(w[p:p+k-1],' ') AS g FROM ia),
s AS (SELECT ir, count(*) AS s FROM ib GROUP BY ir),
ks AS (SELECT DISTINCT k FROM ib),
da AS (SELECT doc_id, dr, k, w, unnest(range(1, (len(w)-k+2)::BIGINT)) AS p FROM d, ks WHERE len(w) >= k),
db AS (SELECT DISTINCT doc_id, dr, k, array_to_string(w[p:p+k-1],' ') AS g FROM da),
c AS (SELECT doc_id, dr, item_id, ir, count(*) AS n FROM db JOIN ib USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, s::BIGINT AS n_shingles, n::BIGINT AS n_common, n::DOUBLE/s AS containment FROM c JOIN s USING (ir)
WHERE 100*n >= {round(100 * CONTAINED)}*s
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, s) = 1"""
