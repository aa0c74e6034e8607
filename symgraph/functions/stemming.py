"""Porter's stemmer (1980), as a function on words, and counts of stems as an expression on columns of text."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _shape(stem: str) -> str:
    """The stem's letters as c (consonant) and v (vowel)."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, table: str, least: int) -> str:
    for pair in sorted(table.split(), key=lambda p: -len(p.split(":")[0])):
        suffix, _, new = pair.partition(":")
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


@functools.lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    stem += "e"
                elif len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
                    stem = stem[:-1]
                elif _measure(stem) == 1 and _ends_cvc(stem):
                    stem += "e"
                word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2, 0), _STEP3, 0)
    for suffix in sorted(_STEP4.split(), key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


#: A stem has all of its word's beginning but for so many of its last letters at most.
CHANGED = 3


def stem_counts(text: str, phrases: list[list[str]]) -> Column:
    """(size, n0, n1, ...): how many words a text has, and how often each phrase of stems stands in it; the last stem of a phrase may go on.

    Only words that begin as a stem of the phrases does are stemmed.
    """
    starts = tuple({t[: max(0, len(t) - CHANGED)] for p in phrases for t in p})
    word, places = re.compile(r"[^\W_]+"), range(len(phrases))

    def of(content: str) -> list[int]:
        words = word.findall(content.lower())
        at = {i: porter(w) for i, w in enumerate(words) if w.startswith(starts)}
        out = [len(words)]
        for *first, last in phrases:
            n = len(first)
            out.append(sum(s.startswith(last) and all(at.get(i - n + k) == f for k, f in enumerate(first)) for i, s in at.items() if i >= n))
        return out

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([[0] * (1 + len(phrases)) if t is None else of(t) for t in batch], columns=["size", *(f"n{k}" for k in places)], dtype="int32")

    return F.pandas_udf(counts, "size int, " + ", ".join(f"n{k} int" for k in places))(F.col(text))
