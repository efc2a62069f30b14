"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping" (1980).

Tokens shorter than three or longer than 64 letters pass unchanged.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
          "ion", "al", "er", "ic", "ou"]
_MEMO_LIMIT = 1_000_000


def _vowels(word: str) -> list[bool]:
    out: list[bool] = []
    for i, ch in enumerate(word):
        out.append(ch in "aeiou" or (ch == "y" and i > 0 and not out[i - 1]))
    return out


def _measure(word: str) -> int:
    v = _vowels(word)
    return sum(1 for a, b in zip(v, v[1:]) if a and not b)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1]


def _cvc(word: str) -> bool:
    v = _vowels(word)
    return len(word) > 2 and not v[-1] and v[-2] and not v[-3] and word[-1] not in "wxy"


def _swap(word: str, table, least: int) -> str:
    for suffix, new in sorted(table, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and any(_vowels(word[: -len(suffix)])):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break

    if word.endswith("y") and any(_vowels(word[:-1])):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    for suffix in _STEP4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stem_lists(tokens: pd.Series) -> pd.Series:
    memo = _MEMO
    if len(memo) > _MEMO_LIMIT:
        memo.clear()
    out = []
    for row in tokens:
        stems = []
        for t in row:
            s = memo.get(t)
            if s is None:
                s = memo[t] = stem(t)
            stems.append(s)
        out.append(stems)
    return pd.Series(out)


_MEMO: dict[str, str] = {}


def stem_tokens(tokens: Column) -> Column:
    """Stems of an array of tokens. Each worker stems a distinct token once; no join, no shuffle."""
    return F.pandas_udf(_stem_lists, "array<string>")(tokens)
