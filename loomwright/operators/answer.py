"""Answers from retrieved chunks: packing to a token budget, extraction with citations, markers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.chunking import sentences
from loomwright.functions.text import terms, token_estimate

# Sizes and weights of extraction, and what is said when nothing answers.
SHORTEST, LONGEST, RANK_WEIGHT, BALANCE, LEAST_RELEVANCE, MOST_SENTENCES = 30, 600, 0.25, 0.72, 0.25, 4
# List and table marks, dashes and colons that make no sentence.
NOISE = re.compile(r"^(?:[|#]|```|[-*] )|\|.*\|.*\|| - .* - |: -|:$")
REFUSAL = "The sources do not contain an answer to this question."
MARKER = re.compile(r"\[(\d+(?:\s*,\s*\d+)*)\]")
LIST_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")


def pack(ranked: DataFrame, budget: int = 6000, most: int | None = None) -> DataFrame:
    """query_id, id, marker, tokens: whole chunks by rank while the budget lasts. The first always goes in, chunks
    that do not fit are passed over, and the walk stops when the budget is used up. ``ranked`` has query_id, id,
    rank, text; it is folded per query, so cut it by rank first."""
    rows = ranked.select("query_id", F.struct("rank", "id", token_estimate(F.col("text")).alias("cost")).alias("c")).groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:bigint,cost:bigint>>").alias("picked"))

    def step(a: Column, c: Column) -> Column:
        full = (a["used"] >= budget) if most is None else (a["used"] >= budget) | (F.size(a["picked"]) >= most)
        skip = full | ((F.size(a["picked"]) > 0) & (a["used"] + c["cost"] > budget))
        added = F.concat(a["picked"], F.array(F.struct(c["id"].cast("long").alias("id"), c["cost"].alias("cost"))))
        return F.struct(F.when(skip, a["used"]).otherwise(a["used"] + c["cost"]).alias("used"), F.when(skip, a["picked"]).otherwise(added).alias("picked"))

    done = rows.select("query_id", F.aggregate("cs", start, step)["picked"].alias("picked"))
    return done.select("query_id", F.posexplode("picked").alias("pos", "p")).select("query_id", F.col("p.id").alias("id"), (F.col("pos") + 1).alias("marker"), F.col("p.cost").alias("tokens"))


def prompt(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: numbered sources and the question. ``packed`` has query_id, marker, label, text."""
    source = F.concat(F.format_string("[%d] %s\n", "marker", "label"), F.col("text"))
    joined = packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker", source.alias("s")))), lambda x: x["s"]), "\n\n").alias("sources"))
    return joined.join(queries, "query_id").select("query_id", F.concat(F.lit("Sources:\n\n"), "sources", F.lit("\n\n---\n\nQuestion: "), "query").alias("prompt"))


def markers(text: Column) -> Column:
    """The source numbers cited in a text, in order, each once."""
    inner = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inner, lambda m: F.transform(F.split(m, r"\s*,\s*"), lambda n: n.cast("int")))))


def without_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\d+(\s*,\s*\d+)*\]", ""), r"\s{2,}", " "))


def strip_invalid(text: str, most: int) -> str:
    """A text with only those cited numbers that there are; empty marks go."""

    def keep(m: re.Match) -> str:
        valid = [n for n in re.split(r"\s*,\s*", m[1]) if 1 <= int(n) <= most]
        return f"[{', '.join(valid)}]" if valid else ""

    return re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r" {2,}", " ", MARKER.sub(keep, text))).strip()


def spans(text: str) -> list[tuple[str, int, int, list[int]]]:
    """(sentence, start, end, markers) of an answer; marks after a full stop belong to the sentence before."""
    out: list[tuple[str, int, int, list[int]]] = []
    at = 0
    for s in sentences(text):
        start = max(at, text.find(s.split()[0], at) if s.split() else at)
        end = min(len(text), start + len(s))
        lead = re.match(r"(?:\[\d+(?:\s*,\s*\d+)*\]\s*)+", text[start:end])
        if lead and out:
            a, b, _, _ = out[-1]
            out[-1] = (text[b : start + lead.end()].strip(), b, start + lead.end(), [])
            start += lead.end()
        if text[start:end].strip():
            out.append((text[start:end].strip(), start, end, []))
        at = end
    return [(s, a, b, list(dict.fromkeys(int(n) for m in MARKER.findall(s) for n in re.split(r"\s*,\s*", m)))) for s, a, b, _ in out]


def _is_prose(block: str) -> bool:
    """Whether a block is no code and mostly no list."""
    rows = [bool(LIST_ITEM.match(r)) for r in block.splitlines() if r.strip()]
    return not block.startswith("```") and sum(rows) <= 0.4 * len(rows)


def usable_sentences(text: str, heading: str = "") -> Iterator[str]:
    """Sentences that can stand in an answer: no lists, code, tables, fragments or introductions."""
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text.removeprefix(heading).lstrip("\n ") if heading else text)]
    marks = [sum(r.lstrip().startswith("```") for r in b.splitlines()) % 2 for b in blocks]
    # after an odd number of fence marks what follows is code, and so is a block with an odd number of its own
    prose = [b for b, own, so_far in zip(blocks, marks, accumulate(marks), strict=True) if b and not own and so_far % 2 == 0 and _is_prose(b)]
    for s in (" ".join(s.split()) for b in prose for s in sentences(b)):
        if SHORTEST <= len(s) <= LONGEST and not NOISE.search(s):
            yield s


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def extract_answer(query_terms: list[str], chunks: list[tuple[int, str, str]], most: int = MOST_SENTENCES) -> tuple[str, bool]:
    """(answer, refused) from (marker, text, heading) chunks: relevant, diverse sentences with their sources."""
    pool = []
    for marker, text, heading in chunks:
        for s in usable_sentences(text, heading):
            tokens = re.findall(r"[a-z0-9_]+", s.lower())
            pool.append((marker, s, tokens, set(tokens)))
    has = lambda t, own: t in own or (len(t) >= 5 and any(x.startswith(t) for x in own))
    df = {t: sum(has(t, p[3]) for p in pool) for t in query_terms}
    idf = {t: math.log(1 + (len(pool) - n + 0.5) / (n + 0.5)) for t, n in df.items() if n}
    total = sum(idf.values()) or 1.0
    scored = []
    for marker, s, tokens, own in pool:
        relevance = sum(w for t, w in idf.items() if has(t, own)) / total
        if relevance >= LEAST_RELEVANCE:
            prior = 1.0 if len(chunks) <= 1 else max(0.0, 1 - (marker - 1) / len(chunks))
            scored.append((relevance + RANK_WEIGHT * prior, marker, s, tokens, own))
    rest = sorted(scored, key=lambda x: (-x[0], x[1]))
    picked: list = []
    while rest and len(picked) < most:
        near = [max((_jaccard(x[4], p[4]) for p in picked), default=0.0) for x in rest]
        i = max(range(len(rest)), key=lambda k: (BALANCE * rest[k][0] - (1 - BALANCE) * near[k], -k))
        x = rest.pop(i)
        if near[i] <= 0.8:
            picked.append(x)
    if not picked:
        return REFUSAL, True
    return " ".join(f"{s} [{m}]" for _, m, s, _, _ in sorted(picked, key=lambda x: (x[1], x[3]))), False


def extractive_answers(packed: DataFrame, queries: DataFrame, most: int = MOST_SENTENCES) -> DataFrame:
    """query_id, answer, refused for every query. ``packed`` has query_id, marker, text, heading_context and is
    bounded by the packing budget; queries without chunks are declined."""
    rows = queries.select("query_id", terms(F.col("query")).alias("terms")).join(packed, "query_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["marker"].notna()].sort_values("marker")
        text, refused = extract_answer(list(pdf["terms"].iloc[0]), list(zip(own["marker"].astype(int), own["text"], own["heading_context"].fillna(""), strict=True)), most)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]], "answer": [text], "refused": [refused]})

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, answer string, refused boolean")
