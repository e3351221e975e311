"""The training-data operators against brute force, on small planted tables with awkward rows."""

from __future__ import annotations

import array
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import bpe, chosen_path, decontaminate, html_text, license_scan, line_dedup, lm_scores, quality_rules, suffix_dedup, token_counts
from loomwright.llm.queries import tokenizer_file
from loomwright.llm.suffix_sort import sorted_suffixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, h long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    """Random texts, copies, near copies, shared passages, null and empty and odd texts, a null host."""
    rng = random.Random(3)
    words = ["the", "of", "É", "naïve", "日本", "a", *["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(min(12, n - i))) + "." for i in range(0, n, 12))
    passage = text(60)
    texts = [text(rng.choice([3, 30, 80, 300])) for _ in range(40)]
    texts += [texts[5], texts[5], texts[7].upper(), texts[30] + " extra words here", texts[33].replace("the", "thee", 1)]
    texts += [f"{text(40)}\n{passage}\n{text(30)}" for _ in range(6)]
    texts += [None, "", " \n\t ", "x", "CC BY cc-by General Public License, all rights  reserved.", "a b c d e " * 200, "z" * 5000]
    texts += ["Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software"]
    texts += [f"Share this page\n{text(70)}" for _ in range(30)]
    rows = [(i, t, "en", None if i % 11 == 3 else f"h{i % 3}", len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(docs, empty):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t, *_ in corpus():
        w = ALNUM.findall((t or "").translate(FOLD))
        at = [(p, label) for label, phrase in license_scan.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any("mit" in r.labels.split(",") for r in got.values())
    assert license_scan.scan_licenses(empty).count() == 0


def test_quality_rules(docs, empty):
    rows = quality_rules.quality_report(docs).collect()
    assert len(rows) == len(corpus())
    got = {r.doc_id: r for r in rows}
    for i, t, *_ in corpus():
        w = PLAIN.findall(t or "")
        grams = collections.defaultdict(list)
        for p in range(len(w) - 2):
            grams[tuple(w[p : p + 3])].append(p)
        repeat = {q for ps in grams.values() if len(ps) > 1 for p in ps for q in (p, p + 1, p + 2)}
        lines = [x for x in (t or "").split("\n") if PLAIN.search(x)]
        want = (len(w), sum(map(len, w)), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert {i: r.kept for i, r in got.items()} == brute_verdicts(corpus())
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    assert quality_rules.apply_rules(empty).count() == 0 and quality_rules.quality_report(empty).count() == 0


def test_license_texts(spark):
    """Whole license texts are found with words changed, left out or added; other texts that share words are not."""
    rng = random.Random(31)
    noise = lambda n: " ".join(rng.choice(["the", "of", "software", "river", "license", "is", "and"]) for _ in range(n))
    rows = []
    for n, (label, text) in enumerate(license_scan.TEXTS):
        w = text.split()
        w[10:11] = ["changed", "twice"]
        del w[40]
        rows += [(2 * n, f"{noise(50)}. {' '.join(w).capitalize()}. {noise(30)}", label), (2 * n + 1, noise(200), "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    for i, _, want in rows:
        labels = set(got[i].labels.split(",")) - {""}
        assert want in labels if want else not labels, (i, got[i])
        assert got[i].score >= 0.9 if want else got[i].score == 0
    masks = license_scan.votes(table).where("tmpl >= 0").agg(F.max("part"), F.max(F.bit_count("mask"))).first()
    assert masks[0] >= 2 and masks[1] <= license_scan.MASK


def brute_verdicts(rows: list[tuple]) -> dict[int, bool]:
    """kept of each id of rows (id, text, lang, host, ...), from the rules' definition."""
    measured = {}
    for i, t, _, host, *_ in rows:
        w = PLAIN.findall(t or "")
        at = collections.defaultdict(list)
        for p in range(len(w) - 2):
            at[tuple(w[p : p + 3])].append(p)
        repeat = len({q for ps in at.values() if len(ps) > 1 for p in ps for q in (p, p + 1, p + 2)})
        lines = [x for x in (t or "").split("\n") if PLAIN.search(x)]
        chars, symbols = sum(map(len, w)), sum(map((t or "").count, "#*$%&|<>"))
        short, again = len(w) < 50, 100 * repeat > 50 * len(w)
        fails = [short or again, short, again, 10 * symbols > len(w), 100 * (len(lines) - len(set(lines))) > 30 * len(lines), chars < 3 * len(w) or chars > 10 * len(w)]
        measured.setdefault(host, []).append((i, fails))
    rejected = set()
    for rule in range(6):
        n = {h: len(x) for h, x in measured.items()}
        bad = {h: sum(f[rule] for _, f in x) for h, x in measured.items()}
        total = sum(n.values())
        m = sum(bad.values()) / total
        rest = total - sum(x * x for x in n.values()) / total
        spread = (sum(n[h] * (bad[h] / n[h] - m) ** 2 for h in n) - (len(n) - 1) * m * (1 - m)) / rest if rest else 0
        k = max(1.0, min(1000.0, m * (1 - m) / spread - 1)) if spread > 1e-15 else 1000.0
        for h in n:
            p = (bad[h] + k * m) / (n[h] + k)
            apart = p - 2 * math.sqrt(p * (1 - p) / (n[h] + k + 1)) > m + 2 * math.sqrt(m * (1 - m) / (k + 1))
            if p >= 0.9 or (p >= 0.5 and apart):
                rejected.add(h)
    return {i: not f[0] and h not in rejected for h, x in measured.items() for i, f in x}


def test_bad_host_goes_and_mixed_host_stays(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "short", "en", "bad", 1, "", 0) for i in range(400)]
    rows += [(1000 + i, good if i % 2 else "short", "en", "mixed", 1, "", 0) for i in range(400)]
    kept = collections.Counter(r.source for r in quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == {"mixed": 200}


def test_hosts_apart_from_the_rest_go_by_any_rule(spark):
    """A host goes whose documents pass the base rules but are mostly symbols, or repeated lines; others stay."""
    rng = random.Random(9)
    good = lambda: "\n".join(" ".join(f"word{rng.randrange(10**5)}" for _ in range(12)) for _ in range(6))
    marks = lambda: good() + " " + " ".join(rng.choice("#*|<>$") + str(rng.randrange(10**6)) for _ in range(30))
    doubled = lambda: good() + "\n" + "\n".join(["same"] * 8)
    rows = []
    for h in range(20):
        for _ in range(40):
            share = {3: marks, 5: doubled}.get(h)
            text = share() if share and rng.random() < 0.8 else "short" if rng.random() < 0.06 else good()
            rows.append((len(rows), text, "en", f"h{h}" if h != 7 else None, 0, "", 0))
    table = spark.createDataFrame(rows, SCHEMA)
    report = {r.doc_id: r for r in quality_rules.quality_report(table).collect()}
    want = brute_verdicts(rows)
    assert {i: r.kept for i, r in report.items()} == want
    assert {r.source for r in report.values() if r.host_rules} == {"h3", "h5"}
    assert {report[i].host_rules for i in report if report[i].source == "h3"} == {"symbols"}
    left = quality_rules.apply_rules(table)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, k in want.items() if k)


def test_line_dedup(docs, empty):
    clean = line_dedup.clean_pages(docs)
    assert clean.columns == docs.columns and clean.count() == len(corpus())
    key = lambda x: x.strip(" \t\n\v\f\r").translate(FOLD)
    pages, seen = collections.Counter(), collections.Counter()
    for _, t, _, s, *_ in corpus():
        pages[s] += 1
        seen.update((s, x) for x in {key(x) for x in (t or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= line_dedup.MIN_PAGES and pages[k[0]] >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    assert bad
    got = {r.doc_id: r for r in clean.collect()}
    for i, t, _, s, *_ in corpus():
        assert got[i].text == (None if t is None else "\n".join(x for x in t.split("\n") if (s, key(x)) not in bad))
        assert got[i].n_chars == len(got[i].text or "")
    assert line_dedup.clean_pages(empty).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_decontaminate(spark, docs, empty, broadcast_bytes):
    passage = corpus()[46][1].split("\n")
    items = [(1, " ".join(passage[4:8])), (2, "nothing of this occurs here at all"), (3, "cc by"), (4, None), (5, ""), (6, " ".join(passage[4:7]) + " and some more"), (1, " ".join(passage[4:8]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc, r.item): (r.n_shingles, r.n_common) for r in decontaminate.contaminated(docs, bench, broadcast_bytes=broadcast_bytes).collect()}
    want = {}
    for item, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        k = min(5, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for doc, x, *_ in corpus():
            v = ALNUM.findall((x or "").translate(FOLD))
            common = len(s & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)})
            if s and 100 * common >= 80 * len(s):
                want[doc, item] = len(s), common
    assert got == want and any(i == 1 for _, i in want) and any(i == 3 for _, i in want)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in corpus()} - {d for d, _ in want}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_paths_agree_on_repeated_ids(spark):
    """Several texts under one id: each is judged by itself, alike with and without broadcast, and only its own row goes."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(rng.randrange(30), text(rng.choice([1, 2, 4, 6, 9, 20, 40, 90]))) for _ in range(40)]
    rows = []
    for i in range(200):
        own = rng.choice(items)[1].split()
        cut = own[: rng.choice([len(own), len(own) // 2, len(own) - 1])]
        rows.append((rng.randrange(60), f"{text(rng.randrange(12))} {' '.join(cut)} {text(rng.randrange(12))}", "clash"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, doc string"), spark.createDataFrame(items, "item_id long, text string")

    def grams(t: str, k: int) -> set:
        w = t.split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want, leaks = {}, set()
    for d, t, _ in rows:
        for item, x in items:
            s = grams(x, min(5, len(x.split())))
            n = len(s & grams(t, min(5, len(x.split()))))
            if 100 * n >= 80 * len(s):
                want[d, item] = max(want.get((d, item), (0, 0)), (n, -len(s)))
                leaks.add((d, t))
    for size in (1 << 20, 0):
        got = {(r.doc, r.item): (r.n_common, -r.n_shingles) for r in decontaminate.contaminated(docs, bench, broadcast_bytes=size).collect()}
        assert got == want and len(want) > 100
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(r for r in rows if r[:2] not in leaks)


def checked_order(a: np.ndarray, depth: int, limit: int) -> None:
    order, common = suffix_array(a, depth, limit=limit)
    keys = [a.tobytes()[i : i + depth] for i in order]
    assert sorted(order) == list(range(len(a))) and keys == sorted(keys)
    for x, y, n in zip(keys, keys[1:], common[1:], strict=False):
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_suffix_array():
    rng = np.random.default_rng(1)
    for i in range(200):
        a = rng.integers(1, rng.integers(2, 6) if i % 2 else 200, rng.integers(1, 100 if i % 3 else 3000)).astype(np.uint8)
        checked_order(a, int(rng.choice([3, 8, 9, 50])), int(rng.choice([0, 100, 1 << 30])))
    for a in (np.ones(5000), np.tile([1, 2], 3000), np.tile([2, 1, 1], 2000), np.arange(5000) % 250 + 1):
        checked_order(a.astype(np.uint8), 50, 0)


def test_suffix_array_of_a_shard_larger_than_memory(tmp_path):
    """The heap stays near the limit, which is below the size of the text; text, names and queues are on disk."""
    import tracemalloc

    rng = np.random.default_rng(2)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8) for _ in range(3000)]
    passage = np.concatenate([np.append(words[k], 32) for k in rng.integers(0, 3000, 200)])
    parts = [np.concatenate([passage, *[np.append(words[k], 32) for k in rng.integers(0, 3000, 2000)]]) for _ in range(50)]
    text = np.concatenate(parts).astype(np.uint8)
    text.tofile(tmp_path / "text")
    limit = len(text) // 4
    whole = list(sorted_suffixes(text, 50))
    tracemalloc.start()
    found = prefix = at = 0
    last = b""
    for pos, lcp in sorted_suffixes(np.memmap(tmp_path / "text", np.uint8, "r"), 50, limit):
        found += len(pos)
        prefix += int(lcp.astype(np.int64).sum())
        now = text[pos[-1] : pos[-1] + 50].tobytes()
        assert last <= now
        last, at = now, at + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(text) and prefix == sum(int(b.astype(np.int64).sum()) for _, b in whole) and at > 20
    # counts of symbols and Python's own objects come on top
    assert peak < limit + (2 << 20), f"{peak} bytes of heap at a limit of {limit}, a text of {len(text)}"


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: r for r in suffix_dedup.dedup_digest(docs).collect()}
    assert suffix_dedup.dedup_digest(docs).count() == len(corpus())
    seen, removed = set(), 0
    for i, t, *_ in sorted({r[:2] for r in corpus()}):
        b = (t or "").encode()
        mark, own = bytearray(len(b)), set()
        for p in range(len(b) - 49):
            own.add(b[p : p + 50])
            if b[p : p + 50] in seen:
                mark[p : p + 50] = b"\1" * 50
        seen |= own
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(m and not (p and mark[p - 1]) for p, m in enumerate(mark))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
        removed += sum(mark)
    assert removed > 500
    assert suffix_dedup.dedup_digest(empty).count() == 0


def test_suffix_dedup_of_passages_repeated_in_one_document(spark):
    """A context that one document has twice, and a smaller one in part, goes at both places; also beside other texts of
    the same id, and beside equal rows."""
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghij \n") for _ in range(n))
    shared, before, after = text(60), text(100), text(100)
    whole = before + shared + after
    rows = [(1, text(80) + shared + text(80)), (2, whole + text(200) + whole), (2, whole + text(200) + whole[50:]), (2, whole), (2, whole), (3, text(90))]
    got = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.n_bytes, r.n_spans) for r in suffix_dedup.dedup_digest(got).collect() if r.n_removed and r.n_removed >= 60 * r.n_spans)
    assert got == sorted((len(t), t.count(shared)) for i, t in rows if i == 2)


def test_suffix_dedup_tells_contexts_apart():
    """Contexts of one anchor that agree in half of their hash are not one."""
    import pyarrow as pa

    entry = np.zeros(3, suffix_dedup.ENTRY)
    contexts = np.array([7 << 32, (7 << 32) + 1, 5 << 32], np.uint64)
    entry["hash"], entry["context"], entry["row"] = 9, contexts if entry["context"].itemsize == 8 else contexts >> np.uint64(32), range(3)
    packed = {"docs": [np.arange(3).tobytes()], "keys": [np.arange(3).tobytes()], "lengths": [np.full(3, 200, np.uint32).tobytes()], "entries": [suffix_dedup._columns(entry)], "covered": [b""]}
    got = suffix_dedup._match(pa.table(packed))
    assert sorted(got["doc"].to_pylist()) == [0, 1, 2] and got["anchor_hash"].to_pylist() == [9, 9, 9]


def test_suffix_dedup_splits_hot_anchors(spark, docs, monkeypatch):
    """No task sorts the contexts of an anchor that has more than a bound, and the result is the same."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    tails = [" ".join(word() for _ in range(8)) for _ in range(20)]
    hot = [(5000 + i, " ".join(word() for _ in range(8)) + " A LINE OF FORTY BYTES, ON EVERY PAGE " + (tails[i % 20] if i % 2 else tails[i % 20][:9] + word() + word())) for i in range(150)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(hot, "doc_id long, text string")).cache()
    rows = lambda: sorted(map(tuple, suffix_dedup.dedup_digest(more).collect()))
    want = rows()
    assert sum(r[2] for r in want if r[0] >= 5000) > 1000
    split = []
    whole = suffix_dedup._by_windows
    monkeypatch.setattr(suffix_dedup, "_by_windows", lambda contexts: split.append(contexts.count()) or whole(contexts))
    with monkeypatch.context() as m:  # hot anchors that only a shard has counted
        m.setattr(suffix_dedup, "_match", _with_hot(3))
        m.setattr(suffix_dedup, "HOT", 3)
        m.setattr(suffix_dedup, "HOT_SAMPLE", 10**9)
        assert rows() == want and split[0] > 20
    split.clear()
    monkeypatch.setattr(suffix_dedup, "HOT", 3)  # found beforehand, and spread over the shards
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
    assert len(suffix_dedup.hot_anchors(more.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_key"), "text"))) > 2
    assert rows() == want and split[0] > 20
    monkeypatch.setattr(suffix_dedup, "HOT", 40)  # some sides are hot, others are sorted in their shards
    few = len(split)
    assert rows() == want and len(split) <= few + 1


def _with_hot(bound: int):
    """_match with another bound, which the tasks' own modules get."""

    def run(table, hot):
        from loomwright.llm import suffix_dedup as module

        module.HOT = bound
        return module._match(table, hot)

    return run


def test_suffix_dedup_sorts_whole_anchors(monkeypatch):
    """A shard of any size is sorted a few anchors at a time, without contexts that agree with no other document's."""
    import pyarrow as pa

    rng = random.Random(6)
    word = lambda n: bytes(rng.choices(b"abcdefghij", k=n))
    rows = []
    for key in rng.sample(range(10**6), 60):
        anchor, before = word(20), rng.choice([30, 30, 12, 0])
        contexts: list[bytes] = []
        for doc in range(12):
            text = word(before) + anchor + word(50)
            if doc % 3 == 1:  # equal to another in a window of 50 bytes, or in one byte less
                at, n = rng.randrange(before + 1), rng.choice([50, 50, 49])
                text = word(at) + rng.choice(contexts)[at : at + n] + word(before + 70 - at - n)
            contexts.append(text)
            rows.append((key, doc, key * 100 + doc, before + 7, before, text))
    rng.shuffle(rows)
    want = {}
    for key, doc, text_key, start, _, text in rows:
        less = {t[i : i + 50] for k, d, _, _, _, t in rows if k == key and d < doc for i in range(len(t) - 49)}
        if gone := {start + i + j for i in range(len(text) - 49) if text[i : i + 50] in less for j in range(50)}:
            want[doc, text_key] = gone
    assert len(want) > 100
    sizes, whole = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda a, depth: sizes.append(len(a)) or whole(a, depth))
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 4000, raising=False)
    got = {}
    for r in suffix_dedup._check(pa.table(dict(zip(["key", "doc", "text_key", "start", "at", "context"], map(list, zip(*rows, strict=True)), strict=True)))).to_pylist():
        got.setdefault((r["doc"], r["text_key"]), set()).update(range(r["start"], r["end"]))
    assert got == want
    assert len(sizes) > 5 and max(sizes) < 10_000 and sum(sizes) < 0.8 * sum(len(r[-1]) for r in rows)
    lone = {"key": [1, 1], "doc": [1, 2], "text_key": [3, 4], "start": [0, 0], "at": [0, 0], "context": [b"a" * 70, b"a" * 20 + b"b" * 50]}
    assert suffix_dedup._check(pa.table(lone)).num_rows == 0


def test_suffix_dedup_gives_memory_back():
    """A worker that has sent its anchors holds no more than before."""
    import subprocess
    import sys

    code = """
import numpy as np, pyarrow as pa, psutil
from loomwright.llm import suffix_dedup, wordhash
def run(n):
    rng = np.random.default_rng(1)
    for _ in range(3):
        texts = [bytes(x).decode() for x in rng.integers(97, 123, (n, 2000), np.uint8)]
        ids = pa.array(np.arange(n))
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc", "text_key", "text"])
send = suffix_dedup._send_anchors(8, np.zeros(0, np.uint64))
held = lambda: psutil.Process().memory_info().rss >> 20
assert sum(b.num_rows for b in send(run(10)))
wordhash.trim()
before = held()
assert sum(b.num_rows for b in send(run(4000)))
print(held() - before)
"""
    more = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert more < 30, f"{more} MB held after the task"


def test_suffix_dedup_joins_documents_once(docs, monkeypatch):
    """Copies are joined away once for the anchors and once, with all other changed documents, for the result."""
    joins = {}

    def counted(df, label):
        joins[label] = df._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti")
        return df

    write, keep = suffix_dedup.materialise, suffix_dedup.Scratch.keep
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, label, **how: write(counted(df, label), label, **how))
    monkeypatch.setattr(suffix_dedup.Scratch, "keep", lambda self, df, label, **how: keep(self, counted(df, label), label, **how))
    counted(suffix_dedup.dedup_digest(docs), "result")
    assert {k: n for k, n in joins.items() if n} == {"anchors": 1, "result": 1}


def test_lm_scores(docs, empty):
    rows = lm_scores.lm_scores(docs).collect()
    assert len(rows) == len(corpus())
    got = {r.doc_id: r for r in rows}
    count, pairs = collections.Counter(), collections.Counter()
    tokens = lambda t: [*PLAIN.findall((t or "").translate(FOLD)), "\0end"]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, t, *_ in corpus():
        if not out(i):
            count.update(tokens(t))
            pairs.update(zip(["\0begin", *tokens(t)], tokens(t), strict=False))
    total, distinct, ends = sum(count.values()), len(count), count["\0end"]
    for i, t, *_ in corpus():
        w = tokens(t)
        base = sum(math.log10((count[x] + 1) / (total + 1 * (distinct + 1))) for x in w)
        model = sum(math.log10((pairs[v, x] + lm_scores.MU * max(1, count[x]) / (total + 1)) / ((ends if v == "\0begin" else count[v]) + lm_scores.MU)) for v, x in zip(["\0begin", *w], w, strict=False))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(model, abs=2e-3 * len(w))
    assert lm_scores.lm_scores(empty).count() == 0


ODD = ["", "Hello <|endoftext|> wörld <|startoftext|>x", "ΑΣ Σ it's we'll 'S 12345 ½ Ⅷ", "ﬁ İstanbul  \x1c\x1d a​b", "日本語 😀😀 👍🏽", "a" * 3000, "'s'll--'s ...'re", "\x00NUL \x00", "ab\x85cd　ef"]


def test_bpe_equals_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_file("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in more.collect()}
    plain = bpe.encode_decode(more, path).collect()
    assert len(plain) == len(corpus()) + len(ODD)
    digests = {r.doc_id: r for r in bpe.encode_decode(more, path, digest=True).collect()}
    for r in plain:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), text)
        d = digests[r.doc_id]
        assert (d.ids_sha256, d.decoded_sha256) == (hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_token_counts_equal_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_file("piece_bpe_32k.model")
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(token_counts.load(path).pieces, 0, True))
    model.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace("▁", "always", True)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in more.collect()}
    for r in token_counts.count_tokens(more, path).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id] or "").ids)


def test_token_counts_equal_sentencepiece(spark, docs, tmp_path):
    """op7 counts what the named tokenizer itself encodes."""
    from loomwright.llm.queries import op7_token_counts

    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    plain = ["The quick brown fox jumps over the lazy dog.", "Internationalization of understanding requires extraordinary collaboration.", "Die Zusammenarbeit zwischen den Abteilungen ist außerordentlich wichtig.", " x  y   z" + " " * 37 + "w ", "<s>hi<0x0A></s>", "▁x▁", "\t\n\n", "aaaaaaaaaaaa bananananana"]
    rng = random.Random(8)
    plain += ["".join(rng.choice("aeinorst  ▁h.\n") for _ in range(300)) for _ in range(100)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD + plain)], "doc_id long, text string"))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in more.collect()}
    rows = op7_token_counts(spark, str(tmp_path)).collect()
    assert len(rows) == len(corpus()) + len(ODD + plain)
    for r in rows:
        ids = model.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.score == pytest.approx(sum(map(model.get_score, ids)))


def test_html_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First&nbsp;paragraph, with   a
    <b>bold</b> word.<p>Second one; it isn't closed<br>and breaks.<!-- <p>no</p> --><script>var x = "<p>no</p>";</script><ul><li>item one<li>item two</ul></article>
    <aside>Related</aside><form>Search<input></form><div id="comments"><p>First comment!</p></div><footer>&copy; me</footer></body></html>"""
    want = "Head & line\nFirst paragraph, with a bold word.\nSecond one; it isn't closed\nand breaks.\nitem one\nitem two"
    rows = [(1, "u", page, "x"), (2, None, None, None), (3, "u", "", ""), (4, "u", "just text &lt; here", ""), (5, "u", "</p></div><<p", ""), (1, "u", page, "x")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == 6 and got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == "" and got[3].text == "" and got[4].text == "just text < here"


def test_html_text_of_sibling_blocks():
    """Without article or main, nothing of an article's sibling blocks is lost, and neither is a title outside them."""
    long = "This is a longer sentence of the article, with commas, and it goes on for a while. " * 6
    intro, body, last = "A short introduction, in one sentence.", long + "Body.", long + "Last."
    page = f"<html><body><div id=content><h1>Title</h1><div class=intro><p>{intro}</p></div><div class=body><p>{body}</p><p>{last}</p></div></div><div class=sidebar><p>{long}</p></div></body></html>"
    assert html_text.extract(page).split("\n") == ["Title", intro, body, last]
    sections = "".join(f"<section id=s{i}><h2>Part {i}</h2><p>{long}{i}.</p></section>" for i in range(3))
    links = "<div class=more><a href=/x>Read another one</a> <a href=/y>And one more</a></div>"
    got = html_text.extract(f"<html><body><h1>Title</h1>{sections}{links}<footer>(c) us</footer></body></html>").split("\n")
    assert got == ["Title", *[x for i in range(3) for x in (f"Part {i}", f"{long}{i}.")]]
    assert html_text.extract(f"<body><div class=title><h1>Title</h1></div><div class=text><p>{body}</p></div></body>").split("\n") == ["Title", body]


LONG = "A sentence of the article, with a comma, that goes on for quite a while. " * 5


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ('<article style="overflow:hidden"><p>{0}</p></article>', ["{0}"]),
        ('<article><p>{0}</p><svg class="i"/><p>{0}two</p><svg><text>x</text></svg><p>three.</p></article>', ["{0}", "{0}two", "three."]),
        ("<article><p>{0}</p><button>Share<p>{0}two</p><p>three.</p></article>", ["{0}", "{0}two", "three."]),
        ('<article><p data-id="comment-5">{0}</p><p>two.</p></article>', ["{0}", "two."]),
        ('<article><p>{0}</p><div class="legal-notice-text">By law.</div></article>', ["{0}", "By law."]),
        ("<article><p>{0}</p><p>If <math><mi>x</mi></math> is <object>three</object>.</p><noscript><p>A figure.</p></noscript></article>", ["{0}", "If x is three.", "A figure."]),
        ("<div class=post><header><h1>Title</h1><p>By me</p></header><p>{0}</p></div>", ["Title", "By me", "{0}"]),
        ("<div class=page><header><h1>Site</h1></header><div class=post><h1>Title</h1><p>{0}</p></div></div>", ["Title", "{0}"]),
        ("<article><p>{0}<a name=top>here</p><p>{0}two</p></article>", ["{0}here", "{0}two"]),
        ("<article><p>{0}</p><!-- never closed <p>{0}two</p></article>", ["{0}", "{0}two"]),
        ("<article><p>{0}</p><script>var x = 1;<p>{0}two</p></article>", ["{0}", "{0}two"]),
        ('<article><p title="a > b" class=x>{0}</p><div class="comment-list"><p>{0}no</p></div><div id=comments><p>{0}no</p></div></article>', ["{0}"]),
        ("<article><p>{0}</p><select><option>no<option>no</select><textarea>no</textarea><button>no</button><p>two &lt;p&gt; &amp;</p></article>", ["{0}", "two <p> &"]),
    ],
)
def test_html_text_of_broken_and_tricky_pages(inside, want):
    page = f"<html><head><title>no</title></head><body><nav><a href=/>no</a></nav>{inside.replace('{0}', LONG)}<footer>no</footer></body></html>"
    assert html_text.extract(page).split("\n") == [" ".join(x.replace("{0}", LONG).split()) for x in want]


@pytest.mark.parametrize("bit", ["<a ", "<!-- ", "<iframe>", "<p>", "<button>", '<p title="', "<", "<a href=x>", "&", "<div>", "</div>"])
def test_html_text_takes_time_in_proportion(bit):
    """No broken markup makes a long page take time with the square of its length."""
    import time

    began = time.process_time()
    html_text.extract(f"<p>{LONG}</p>" + bit * (200_000 // len(bit)))
    assert time.process_time() - began < 5


def test_html_text_is_decided_by_ratios(monkeypatch):
    """Without article, main or telling names, short blocks beside the article go; without the ratios they would stay."""
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["river", "stone,", "holds", "the", "old", "light.", "and", "again;"]) for _ in range(n)) + "."
    for _ in range(30):
        body = [prose(rng.randrange(40, 120)) for _ in range(rng.randrange(3, 9))]
        body.insert(1, prose(4))  # a short paragraph of the article
        side = [" ".join(rng.choice(["More", "Top", "Latest", "Shop"]) for _ in range(3)) for _ in range(6)]
        column = "".join(f"<div class=k{rng.randrange(3)}>{x}</div>" for x in side)
        main = f"<div class=c1><h2>Head</h2>{''.join(f'<p>{x}</p>' for x in body)}</div>"
        page = f"<body>{f'<div class=c2>{column}</div>'}{main}<div class=c3>{column}</div></body>"
        assert html_text.extract(page).split("\n") == ["Head", *body]
        with monkeypatch.context() as m:
            ratios = html_text.path_ratios
            m.setattr(html_text, "path_ratios", lambda found: (lambda fused, limit, linked: (dict.fromkeys(fused, 1.0), 0.0, linked))(*ratios(found)))
            assert html_text.extract(page).split("\n") != ["Head", *body]


def test_html_blocks_equal_the_parser():
    """On well-formed pages, the blocks' text is what the standard library's parser finds between block tags."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.off = [], [], 0

        def cut(self):
            if text := " ".join("".join(self.now).split()):
                self.out.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "button")
            if tag in html_text.BLOCK or tag == "br":
                self.cut()

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "button")
            if tag in html_text.BLOCK:
                self.cut()

        def handle_data(self, data):
            if not self.off:
                self.now.append(data)

    rng = random.Random(22)

    def node(depth: int) -> str:
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["plain words ", "a &lt; b &amp;c ", "x&nbsp;y ", "\n tab\t", "é日本 ", "<br>", "<!-- <p>no</p> -->", "<script>if (a<b) '</p>';</script>", "<style>p{}</style>", "<img src='a>b'>", "<button>no</button>"])
        tag = rng.choice(["div", "section", "ul", "b", "em", "span", "table", "blockquote", "h2", "pre"])
        inner = "".join(node(depth - 1) for _ in range(rng.randrange(1, 5)))
        return f"<{tag}{rng.choice(['', ' class=a', ' title=&quot;x&quot;', chr(32) + 'data-x=' + chr(34) + '<p>' + chr(34)])}>{inner}</{tag}>"

    for _ in range(300):
        page = "<html><body>" + "".join(node(5) for _ in range(4)) + "</body></html>"
        parser = Parser()
        parser.feed(page)
        parser.close()
        parser.cut()
        assert [b.text for b in html_text.blocks(page)] == parser.out, page


def test_html_text_of_awkward_tables(spark):
    page = f"<body><p>{LONG * 3000}</p></body>"
    rows = [(1, None, page, "clash", 1), (1, None, page, "clash", 1), (None, "u", "<p>a", None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = html_text.extract_text(table).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == [("1", len(LONG) * 3000 - 1)] * 2 + [("None", 1)]
    assert html_text.extract_text(table.limit(0)).count() == 0


def brute_classes(rows: list[tuple], similar: float = 0.8):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[tuple(ALNUM.findall((t or "").translate(FOLD)))].append(i)
    sets = {min(ids): {w[j : j + min(5, len(w))] for j in range(len(w) - min(5, len(w)) + 1)} if w else set() for w, ids in groups.items()}
    link = {a: {b for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])} for a in sets}
    low = {a: a for a in sets}
    while True:
        now = {a: min([low[a], *(low[b] for b in link[a])]) for a in sets}
        if now == low:
            break
        low = now
    return {i: (low[min(ids)], len(link[min(ids)])) for ids in groups.values() for i in ids}


@pytest.mark.parametrize("block", [chosen_path.BLOCK, 16])
def test_chosen_path(spark, empty, monkeypatch, block):
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "BUCKET", min(block, chosen_path.BUCKET))
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    near = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        near.append((1000 + i, " ".join(w), "en", "s", 0, "", 0))
    rows = [*corpus(), *near, (2000, "lone", "en", "s", 0, "", 0), (2001, "LONE!", "en", "s", 0, "", 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(table).collect()}
    assert got == brute_classes(rows)
    kept = chosen_path.keep_one(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {c for c, _ in got.values()}
    assert chosen_path.near_duplicates(empty).count() == 0


def test_chosen_path_in_a_large_template_group(spark, monkeypatch):
    """Pairs just over 0.8 among thousands of sets that share parts of a template. Small buckets make them lie as deep
    as with ten times the sets."""
    monkeypatch.setattr(chosen_path, "BUCKET", 6)
    rng = random.Random(6)
    template = [[f"t{b}.{i}" for i in range(20)] for b in range(16)]
    rows = []
    for i in range(1500):
        w = [x for b in rng.sample(template, 8) for x in b] + [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((2 * i, " ".join(w)))
        for p in (15, 65, 115, 185):
            w[p] = f"x{i}"
        rows.append((2 * i + 1, " ".join(w)))
    got = {r.doc: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [i for i in range(1500) if got[2 * i + 1] != (2 * i, 1) or got[2 * i] != (2 * i, 1)]
    assert not lost, f"{len(lost)} of 1500 pairs lost"


def test_chosen_path_keeps_rows_without_id(spark):
    rows = [(None, "a b c d e f", "", "", 0, "", 0), (None, "a b c d e f", "", "", 0, "", 0), (1, "a b c d e f", "", "", 0, "", 0), (2, "a b c d e f", "", "", 0, "", 0)]
    kept = chosen_path.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None"]


def test_chosen_path_with_several_texts_under_one_id(spark):
    """No text under a shared id is lost: links, classes and what stays are those of the same texts under own ids."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, own = [], []
    for i in range(40):
        w = [word() for _ in range(60)]
        near = [*w[:30], "changed", *w[31:]]
        for j, text in enumerate((w, near, [word() for _ in range(50)])):
            rows.append((rng.randrange(25), " ".join(text), f"{i}.{j}"))
    rows += [rows[0], rows[0], (rows[1][0], rows[1][1].upper() + "!", "again")]
    texts = sorted({(r[0], r[1]) for r in rows})
    number = {t: n for n, t in enumerate(texts)}  # in order of ids, so that smallest means the same
    alone = brute_classes([(number[r[:2]], r[1]) for r in rows])
    table = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((r.doc, r.class_id, r.n_links) for r in chosen_path.near_duplicates(table).collect())
    want = sorted((r[0], texts[alone[number[r[:2]]][0]][0], alone[number[r[:2]]][1]) for r in rows)
    assert got == want
    kept = chosen_path.keep_one(table)
    assert kept.columns == table.columns
    left = [number[r.doc_id, r.text] for r in kept.collect()]
    classes = [alone[n][0] for n in left]
    assert len(classes) == len(set(classes)) and set(classes) == {c for c, _ in alone.values()}
    assert [texts[n][0] for n in left] == [texts[c][0] for c in classes]


def brute_pipeline(rows: list[tuple], items: list[tuple], library) -> dict[int, tuple]:
    """doc_id to (ids, decoded) of what all stages leave, from their definitions."""
    verdict = brute_verdicts(rows)
    rows = [r for r in rows if verdict[r[0]]]
    key = lambda x: x.strip(" \t\n\v\f\r").translate(FOLD)
    pages, seen = collections.Counter(), collections.Counter()
    for _, t, _, host, *_ in rows:
        pages[host] += 1
        seen.update((host, x) for x in {key(x) for x in (t or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= 10 and pages[k[0]] >= 10 and n > 0.2 * pages[k[0]]}
    rows = [(i, "\n".join(x for x in t.split("\n") if (host, key(x)) not in bad)) for i, t, _, host, *_ in rows]
    classes = brute_classes(rows)
    left = {i: t for i, t in rows if classes[i][0] == i}
    for _, item in items:
        w = ALNUM.findall((item or "").translate(FOLD))
        k = min(5, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i, t in list(left.items()):
            v = ALNUM.findall(t.translate(FOLD))
            if grams and 100 * len(grams & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}) >= 80 * len(grams):
                del left[i]
    out = {}
    for i, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        out[i] = ids, library.decode(ids, skip_special_tokens=False)
    return out


def test_pipeline_equals_brute_force(spark, docs, empty, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    items = [(7, corpus()[46][1].split("\n")[5] + " " + corpus()[46][1].split("\n")[6]), (8, None), (9, "nothing of this occurs")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_pipeline(corpus(), items, library)
    assert len(rows) == len(want) > 20
    assert {r.doc_id: (r.ids, r.decoded) for r in rows} == want and all(r.n_tokens == len(r.ids) for r in rows)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_tokenizers_on_awkward_tables(spark, empty):
    """Empty tables, repeated rows, control pieces as plain text, scores of repeated rows, columns with clashing names."""
    bpe_file, piece_file = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")
    assert bpe.encode_decode(empty, bpe_file).count() == 0 and bpe.encode_decode(empty, bpe_file, digest=True).count() == 0
    assert token_counts.count_tokens(empty, piece_file, kind=token_counts.Merges).count() == 0
    rows = [(1, "<s> <unk> <0x0A> text", 5), (1, "<s> <unk> <0x0A> text", 5), (None, None, 5), (2, "word " * 20000, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("ids", F.lit(1)).withColumn("score", F.lit(2.0))
    ours = [(r.n_tokens, r.score) for r in token_counts.count_tokens(table, piece_file, kind=token_counts.Merges).where("doc_id = 1").collect()]
    assert len(ours) == 2 and ours[0] == ours[1] and ours[0][0] > 8  # as plain text, no control piece is one token
    got = bpe.encode_decode(table, bpe_file).collect()
    assert len(got) == 4 and next(r for r in got if r.doc_id == 2).n_tokens == 20000 and next(r for r in got if r.doc_id is None).ids == []


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item = corpus()[46][1].split("\n")[5] + " " + corpus()[46][1].split("\n")[6]
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {r.doc_id: r.n_tokens for r in out.collect()}
    assert set(left) == {r.doc_id for r in at.collect()} and all(left.values())
    assert not set(range(45, 51)) & set(left)
    assert out.agg(F.sum("n_tokens")).first()[0] > 0
