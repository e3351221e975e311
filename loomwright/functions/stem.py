"""English stemming after Porter's published algorithm (1980), and the index tokenizer that uses it."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The suffix rules of steps 2, 3 and 4 of the published algorithm.
STEP2 = "ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log"
STEP3 = "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES = {2: [r.split(">") for r in STEP2.split()], 3: [r.split(">") for r in STEP3.split()], 4: [[s, ""] for s in STEP4.split()]}


def _shape(word: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, step: int, least: int) -> str:
    rules = [(s, r) for s, r in _RULES[step] if word.endswith(s)]
    if not rules:
        return word
    suffix, new = max(rules, key=lambda x: len(x[0]))
    stem = word[: -len(suffix)]
    if _measure(stem) <= least - 1 or (suffix == "ion" and stem[-1:] not in ("s", "t")):
        return word
    return stem + new


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(_replace(word, 2, 1), 3, 1), 4, 2)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


RUNS, BEYOND_ASCII = re.compile(r"[^\W_]+"), re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=100_000)
def _plain(run: str) -> str:
    """Characters beyond ASCII in their compatible forms, without the marks that combine with others."""
    return "".join(x for x in unicodedata.normalize("NFKD", run) if not unicodedata.combining(x))


def index_tokens(text: str | None, stemmed: bool = True) -> list[str]:
    """Runs of letters and digits, lower case, without accents; stems of the ASCII ones."""
    low = (text or "").lower()
    if not low.isascii():
        low = BEYOND_ASCII.sub(lambda m: _plain(m[0]), low)
    return [stem(t) if stemmed and t.isascii() else t for t in RUNS.findall(low)]
