"""The Porter stemmer, after the published description of 1980."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(stem: str) -> int:
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


def _replaced(w: str, rules: str, least: int) -> str:
    for rule in rules.split():
        old, _, new = rule.partition(":")
        if w.endswith(old):
            return w[: len(w) - len(old)] + new if _measure(w[: len(w) - len(old)]) > least else w
    return w


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, _STEP2, 0)
    w = _replaced(w, _STEP3, 0)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _cvc(stem):
            w = stem
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def _stems(words: pd.Series) -> pd.Series:
    known = {w: porter(w) for w in words.dropna().unique()}
    return words.map(known)


def stem(word: Column) -> Column:
    """Stems of words; apply it to distinct words and join them back."""
    return F.pandas_udf(_stems, "string")(word)
