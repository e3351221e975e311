"""N-gram Jaccard join by chosen paths, and near-duplicate classes.

Documents are sets of five-word shingles (words of letters and digits, A-Z in lower case). Documents with the
same words are one class from the start and take part once. Each class gets ``T`` minwise values, which turns
Jaccard similarity into the share of equal places. A run splits all sets again and again on a sampled place:
which place comes next depends only on the run and on the path so far, so similar sets that agree keep the same
path. A set's path ends (its bucket) at the first depth where the bucket has at most ``BUCKET`` sets, or where
the bucket is dense - two random members agree at the next place with probability ``DENSE`` or more, so that
splitting would only part similar sets - or at the last depth. Small buckets are compared set by set; large
ones in blocks of ``BLOCK`` sets, pair of blocks by pair of blocks, so no task holds more than two blocks.
Similarities are exact: each bucket counts common shingles of all its pairs by one matrix product over the
shingles that more than one of its sets has. A run whose bucket of a set lies at depth d finds a pair at the
threshold with sim^d. All sets take part in log(1 - recall) / log(1 - sim) runs, which is enough where buckets
lie at depth 1; sets with deeper ones go on, by other minwise values, until the product of 1 - sim^d over their own
runs is below 1 - recall. A pair with one set that is done is found as surely as that set's product says, so
only the others have to meet in further runs.

A pair may share buckets in many runs; it counts in the first one, which each bucket can tell from the two sets'
own lists of buckets. Sets whose sketches (a byte of each minwise value) are like no other's in a small bucket are
not compared there. So links are counted without writing pairs out; written are, per bucket, each set's number
of new links and the smallest set that it hangs together with. Classes are the connected components over
those, found by stars that hook onto smaller ones, with each round written to the shared folder.

Defined results: rows are told apart by id and text: repeated rows are copies, and different texts under one id
take part as documents of their own, with a row of the result each; documents without words are never near
duplicates of anything but texts without words, with which they are one class; documents of fewer than five words
are one shingle; null ids are not allowed as class ids, rows without an id are left out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import wordhash
from loomwright.llm.grouping import map_groups
from loomwright.session import materialise, scratch

WIDTH, SIMILAR = 5, 0.8
T = 64
DEPTH = 6
BUCKET, BLOCK, DENSE = 64, 256, 0.5
RECALL = 0.9999
#: Sketches that agree in a share this much below the threshold are likely similar; 4 standard deviations.
SLACK = 0.2
#: Tables of ids up to this many rows (counted) go to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets leave a task in batches of about so many bytes.
SENT_BYTES = 8 << 20
SEED = 20240607


def sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it is small."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def runs_for(recall: float = RECALL, similar: float = SIMILAR, depth: int = 1) -> int:
    """Runs for the target recall of pairs at the threshold, with all buckets at ``depth``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similar**depth)))


def _coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, T, dtype=np.uint64)


def signature(grams: np.ndarray, further: bool = False) -> np.ndarray:
    """T minwise values of a set of shingles, for the first runs or for further ones."""
    a, b = _COEFFICIENTS[further]
    out = np.full(T, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        h = part[None, :] * a[:, None]
        h += b[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(out, h.min(axis=1), out=out)
    return out


_COEFFICIENTS = _coefficients(SEED), _coefficients(SEED + 1)


def paths(sig: np.ndarray, runs: range, depth: int) -> np.ndarray:
    """(sets, runs, depth) path keys of signatures (sets, T): the place sampled next depends on run and path."""
    n = len(sig)
    out = np.zeros((n, len(runs), depth), np.uint64)
    rows = np.arange(n)
    for i, r in enumerate(runs):
        path = np.full(n, (SEED + 7919 * r) % (1 << 63), np.uint64)
        for d in range(depth):
            place = (wordhash.mix(path + np.uint64(d)) % np.uint64(T)).astype(np.int64)
            path = wordhash.mix(path * np.uint64(5) + sig[rows, place] + np.uint64(d))
            out[:, i, d] = path
    return out


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key (two hashes of the text's words)."""
    schema = "doc long, k1 long, k2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wordhash.alnum_table()
        for batch in batches:
            k1, k2 = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            for first, data, offsets in wordhash.chunks(batch.column(1)):
                h, at = wordhash.hashes(data, offsets, table)
                place = np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
                for k, salt in ((k1, 1), (k2, 0x632BE59BD9B4E019)):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wordhash.mix(h + place * np.uint64(0xA24BAED4963EE407) + np.uint64(salt)), dtype=np.uint64)))
                    k[first : first + len(offsets) - 1] = sums[at[1:]] - sums[at[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], names=["doc", "k1", "k2"])
        wordhash.trim()

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col)).where("doc IS NOT NULL").mapInArrow(run, schema)


def text_classes(keyed: DataFrame) -> DataFrame:
    """doc, rep: the smallest id with the same words, of (doc, k1, k2). The smallest is found with partial
    aggregation, so a hot class is one row per task; the join back splits hot classes."""
    reps = materialise(keyed.groupBy("k1", "k2").agg(F.min("doc").alias("rep")), "reps")
    return keyed.join(reps, ["k1", "k2"]).select("doc", "rep")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def several_texts(rows: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """doc, text_key, node: a number of its own for each text of ids that stand on texts with different words; None if
    there is no such id. Of rows (doc, text) and their word keys."""
    spans = [f(k).alias(f"{f.__name__}{k}") for k in ("k1", "k2") for f in (F.min, F.max)]
    mixed = materialise(keyed.groupBy("doc").agg(*spans).where("mink1 <> maxk1 OR mink2 <> maxk2").select("doc"), "mixed")
    if mixed.isEmpty():
        return None
    each = materialise(rows.join(sized(mixed), "doc").select("doc", _text_key(F.col("text")).alias("text_key")).distinct(), "each")
    salt = 0
    while True:  # a number that is nobody else's; the first try does but for one table in 10^9
        salt += 1
        own = materialise(each.withColumn("node", F.xxhash64(F.lit(salt), "doc", "text_key")), "numbers")
        twice = own.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty() and own.join(keyed.select(F.col("doc").alias("node")), "node", "left_semi").isEmpty():
            return own


def _grams_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    table = wordhash.alnum_table()
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for first, data, offsets in wordhash.chunks(batch.column(1)):
        h, at = wordhash.hashes(data, offsets, table)
        for i in range(len(offsets) - 1):
            yield int(ids[first + i]), np.unique(wordhash.shingles(h[at[i] : at[i + 1]], WIDTH))


def path_keys(texts: DataFrame, runs: int) -> DataFrame:
    """rep, keys (runs x DEPTH path keys) and sketch (a byte of each minwise value) of texts (rep, text) with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, sigs = [], []
            for rep, grams in _grams_of(batch):
                if len(grams):
                    reps.append(rep)
                    sigs.append(signature(grams))
            if reps:
                both = np.stack(sigs)
                sketch = [x.tobytes() for x in (both >> np.uint64(8)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), _lists(paths(both, range(runs), DEPTH)), pa.array(sketch, pa.binary())], names=["rep", "keys", "sketch"])
        wordhash.trim()

    return texts.mapInArrow(run, "rep long, keys array<long>, sketch binary")


def _lists(keys: np.ndarray) -> pa.ListArray:
    keys = keys.reshape(len(keys), -1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))


def signatures(texts: DataFrame) -> DataFrame:
    """rep, sig: the minwise values for further runs of texts (rep, text) with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(rep, signature(grams, True).tobytes()) for rep, grams in _grams_of(batch) if len(grams)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["rep", "sig"])
        wordhash.trim()

    return texts.mapInArrow(run, "rep long, sig binary")


def further_keys(signed: DataFrame, runs: range) -> DataFrame:
    """rep, keys (runs x DEPTH path keys) of signatures (rep, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, T)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(paths(sig, runs, DEPTH))], names=["rep", "keys"])

    return signed.mapInArrow(run, "rep long, keys array<long>")


def buckets(keyed: DataFrame, first_run: int = 0) -> DataFrame:
    """rep, run, bucket, n, levels: where each set's path ends in each run, and how many sampled places a set must
    share to be there; the bucket is null if the path ends alone. Paths alone from the start (level 1) are left out."""
    flat = keyed.select(F.posexplode("keys").alias("at", "key"))
    # written, as all sides that are joined to hot keys: a small one goes to every task, else Spark splits the hot rows
    first = materialise(flat.where(F.col("at") % DEPTH == 0).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "first")
    each = F.transform(F.sequence(F.lit(0), (F.size("keys") / DEPTH).cast("int") - 1), lambda r: F.struct((r + first_run).alias("run"), F.slice("keys", r * DEPTH + 1, DEPTH).alias("path")))
    shared = keyed.select("rep", F.explode(each).alias("x")).select("rep", "x.*")
    shared = materialise(shared.withColumn("key", F.get("path", F.lit(0))).join(sized(first), "key", "left_semi").drop("key"), "paths")
    parent = F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))
    nodes = shared.select("path", F.posexplode("path").alias("depth", "key")).select("depth", "key", parent.alias("parent"))
    counts = nodes.groupBy("depth", "key", "parent").agg(F.count("*").alias("n"))
    counts = materialise(counts.where("n > 1"), "nodes")
    inner = counts.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.sum(F.col("n") * F.col("n")).alias("agree"))
    is_end = (F.col("n") <= BUCKET) | (F.coalesce("agree", F.lit(0)) >= DENSE * F.col("n") * F.col("n")) | (F.col("depth") == DEPTH - 1)
    marked = materialise(counts.join(inner, "key", "left").select("key", "n", is_end.alias("is_end")), "marked")
    at = shared.select("rep", "run", F.posexplode("path").alias("depth", "key")).join(sized(marked), "key")
    top = at.groupBy("rep", "run").agg(F.min(F.when(F.col("is_end"), F.struct("depth", "key", "n"))).alias("x"), F.max("depth").alias("last"))
    return top.select("rep", "run", F.col("x.key").alias("bucket"), F.col("x.n").alias("n"), F.coalesce(F.col("x.depth") + 1, F.col("last") + 2).alias("levels"))


def unsure(ended: DataFrame, runs: int, similar: float, recall: float) -> DataFrame:
    """rep of the sets whose ``runs`` runs miss a pair at the threshold with more than 1 - recall."""
    one = math.log(1 - similar)
    more = F.sum(F.log(1 - F.pow(F.lit(similar), F.col("levels"))) - one)
    return ended.where("levels > 1").groupBy("rep").agg(more.alias("more")).where(F.col("more") + runs * one > math.log(1 - recall)).select("rep")


def all_buckets(texts: DataFrame, ended: DataFrame, runs: int, similar: float, recall: float) -> tuple[DataFrame, int]:
    """The first runs' buckets with those of the further runs that sets need, and the number of runs."""
    most, signed = runs_for(recall, similar, DEPTH), None
    while runs < most:
        open_ = materialise(unsure(ended, runs, similar, recall), "unsure")
        if open_.isEmpty():
            break
        signed = materialise(signatures(texts.join(sized(open_), "rep", "left_semi").select("rep", "text")), "signatures") if signed is None else signed.join(sized(open_), "rep", "left_semi")
        upto = min(most, 2 * runs)
        ended = ended.unionByName(materialise(buckets(materialise(further_keys(signed, range(runs, upto)), "keys"), runs), "buckets"))
        runs = upto
    return ended.where("bucket IS NOT NULL").drop("levels"), runs


def _compare(table: pa.Table, similar: float) -> pa.Table | None:
    """New links of the sets of one bucket's pair of blocks: rep, links, low."""
    between = table["a"][0].as_py() != table["b"][0].as_py()
    reps, at = np.unique(table["rep"].to_numpy(), return_index=True)  # repeated rows count once
    if len(reps) < 2:
        return None
    table = table.take(pa.array(at))
    sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return None
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
    columns, common = int(column[-1]) + 1, np.zeros((n, n), np.float32)
    step = min(columns, max(1, (1 << 22) // n))
    for low in range(0, columns, step):
        a, b = np.searchsorted(column, (low, low + step))
        matrix = np.zeros((n, step), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        common += matrix @ matrix.T
    linked = common >= similar * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    if between:
        part = table["part"].to_numpy()
        linked &= part[:, None] != part[None, :]
    if not linked.any():
        return None
    lists = np.stack([np.frombuffer(x, np.int64) for x in table["buckets"].to_pylist()])
    mine = linked.copy()
    for r in range(table["run"][0].as_py()):
        mine &= (lists[:, r][:, None] != lists[:, r][None, :]) | (lists[:, r] == 0)[:, None]
    low = reps.copy()
    none = np.iinfo(np.int64).max
    while True:  # smallest rep that each set hangs together with here
        now = np.minimum(low, np.where(linked, low[None, :], none).min(axis=1))
        if (now == low).all():
            break
        low = now
    keep = linked.any(axis=1)
    return pa.table({"rep": reps[keep], "links": mine.sum(axis=1).astype(np.int64)[keep], "low": low[keep]})


def _likely(table: pa.Table, similar: float) -> pa.Table | None:
    """The sets of a bucket that are likely similar to another one by their sketches: rep, run, bucket, n."""
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, T)
    n = len(sketch)
    if n == 2:
        agree = int((sketch[0] == sketch[1]).sum())
        return table.select(["rep", "run", "bucket", "n"]) if agree >= math.floor((similar - SLACK) * T) else None
    agree = np.zeros((n, n), np.uint8)
    for t in range(T):
        agree += sketch[:, t][:, None] == sketch[:, t][None, :]
    np.fill_diagonal(agree, 0)
    found = (agree >= math.floor((similar - SLACK) * T)).any(axis=1)
    return table.select(["rep", "run", "bucket", "n"]).filter(pa.array(found)) if found.any() else None


def links(texts: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """rep, links, low: parts to be summed per rep. Sets of small buckets whose sketches are like no other's there
    go no further; only the others' texts are read again, cut into shingles and sent to their buckets."""
    runs = runs_for(recall, similar)
    keyed = materialise(path_keys(texts, runs), "keys")
    ended, runs = all_buckets(texts, materialise(buckets(keyed.select("rep", "keys")), "buckets"), runs, similar, recall)
    small = ended.where(F.col("n") <= BLOCK).join(keyed.select("rep", "sketch"), "rep")
    likely = map_groups(small, ["bucket"], lambda rows: _likely(rows, similar), "rep long, run int, bucket long, n long")
    likely = materialise(likely.unionByName(ended.where(F.col("n") > BLOCK)), "likely")
    lists = ended.join(sized(likely.select("rep").distinct()), "rep", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("run", "bucket")).alias("ends"))
    sent = likely.groupBy("rep").agg(F.collect_list(F.struct("run", "bucket", "n")).alias("sent"))
    lists = materialise(lists.join(sent, "rep"), "lists")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, wanted = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cols: list[list] = [[], [], [], [], [], []]
            size = 0
            for i, (rep, grams) in enumerate(_grams_of(batch)):
                own = np.zeros(runs, np.int64)
                for e in ends[i]:
                    own[e["run"]] = e["bucket"]
                for e in wanted[i]:
                    for c, v in zip(cols, (rep, e["run"], e["bucket"], e["n"], grams.tobytes(), own.tobytes()), strict=True):
                        c.append(v)
                    size += grams.nbytes
                if size >= SENT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
                    cols, size = [[], [], [], [], [], []], 0

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["rep", "run", "bucket", "n", "grams", "buckets"]
    again = texts.join(sized(lists.select("rep")), "rep", "left_semi")
    members = again.join(lists, "rep").select("rep", "text", "ends", "sent").mapInArrow(sets, "rep long, run int, bucket long, n long, grams binary, buckets binary")
    # every bucket is met in pairs of blocks, each pair once, and each block with itself; small ones are one block
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("blocks", "other", "n")
    return map_groups(members, ["bucket", "a", "b"], lambda rows: _compare(rows, similar), "rep long, links long, low long")


def components(edges: DataFrame) -> DataFrame:
    """node, low: the smallest node of each node's component, for edges (a, b) without self loops.

    Each round, every node hooks onto the smallest node it sees; neighbours are then pointed at each other's
    smallest. Edge counts don't grow. Each step is a written table, so a lost executor costs one step, the smallest
    of a hub with many neighbours is found with partial aggregation, and the join back knows its sizes: a small
    side goes to every task, else Spark splits the hub's rows."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialise(both, "edges")
    while True:
        # large star: larger neighbours of a node hang on the smallest of its neighbourhood
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialise(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = sides.where("b > a").join(sized(lowest), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialise(large.distinct(), "large")
        # small star: smaller neighbours of a node, and the node, hang on the smallest of them
        lowest = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(sized(lowest), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = materialise(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        changed = after.exceptAll(now).limit(1).count() + now.exceptAll(after).limit(1).count()
        now = after
        if not changed:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))


def _classes(rows: DataFrame, similar: float, recall: float) -> tuple[DataFrame, DataFrame | None]:
    """(doc, node, class_id, top, n_links, n_copies; numbers of texts as from several_texts) of rows (doc, text) with
    ids. ``node`` is the id, or the number of a text whose id has several; ``top`` is the class's node of the smallest
    id. All other tables on the way are removed."""
    with scratch(wordhash.small_batches(rows).sparkSession) as tables:
        keyed = materialise(_words(rows, "doc", "text"), "words")
        own = several_texts(rows, keyed)
        if own is not None:
            own = tables.keep(own, "numbers")
            rows = numbered(rows, own).select(F.col("node").alias("doc"), "text")
            keyed = materialise(_words(rows, "doc", "text"), "words")
        classes = materialise(text_classes(keyed), "classes")
        copies = classes.groupBy("rep").agg(F.count("*").alias("n_copies"))
        copied = materialise(classes.where("doc <> rep").select(F.col("doc").alias("rep")).distinct(), "copied")
        texts = rows.withColumnRenamed("doc", "rep").join(sized(copied), "rep", "left_anti")
        if not classes.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            texts = materialise(texts.dropDuplicates(["rep"]), "texts", compact=False)
        found = materialise(links(texts, similar, recall), "links")
        joined = components(found.where("low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b")))
        per_rep = copies.join(found.groupBy("rep").agg(F.sum("links").alias("n_links")), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        per_rep = materialise(per_rep.select("rep", F.coalesce("low", "rep").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "per-class")
        out = classes.join(per_rep, "rep").select(F.col("doc").alias("node"), "group", "n_links", "n_copies")
        if own is None:
            return tables.keep(out.select(F.col("node").alias("doc"), "node", F.col("group").alias("class_id"), F.col("group").alias("top"), "n_links", "n_copies"), "found"), None
        out = materialise(out.join(own.select(F.col("node"), F.col("doc").alias("real")), "node", "left").withColumn("doc", F.coalesce("real", "node")), "found")
        tops = materialise(out.groupBy("group").agg(F.min(F.struct("doc", "node")).alias("x")), "tops")
        out = out.join(tops, "group").select("doc", "node", F.col("x.doc").alias("class_id"), F.col("x.node").alias("top"), "n_links", "n_copies")
        return tables.keep(out, "found"), own


def numbered(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (doc, text, ...) with their node."""
    keyed = rows.withColumn("text_key", _text_key(F.col("text")))
    return keyed.join(sized(own), ["doc", "text_key"], "left").withColumn("node", F.coalesce("node", "doc")).drop("text_key")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc, class_id (the smallest id that it hangs together with), n_links (different texts, by
    words, that are similar enough to it) and n_copies (documents with its words, itself included)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
    return _classes(rows, similar, recall)[0].select("doc", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest doc_id; of rows that repeat an id and its words
    any one. Rows without an id stay."""
    wrapped = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("text"))
    found, own = _classes(wrapped.select("doc", "text").where("doc IS NOT NULL"), similar, recall)
    wrapped = numbered(wrapped, own) if own is not None else wrapped.withColumn("node", F.col("doc"))
    gone = materialise(found.where("node <> top").select("node").distinct(), "copies")
    kept = wrapped.join(sized(gone), "node", "left_anti")
    twice = materialise(found.where("node = top").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "repeated")
    if not twice.isEmpty():
        again = kept.join(sized(twice), "node", "left_semi").dropDuplicates(["node"])
        kept = kept.join(sized(twice), "node", "left_anti").unionByName(again)
    return kept.select("row.*")
