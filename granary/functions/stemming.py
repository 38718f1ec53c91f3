"""Porter's suffix-stripping algorithm (Program 14:3, 1980), as an Arrow function over arrays of lower-case words.

A word's stem is worked out once for each batch of rows, whatever the times it stands in them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from granary.session import keep_batches_small

# The suffix rules of the published algorithm's steps 2, 3 and 4, in its order.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y."""
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _replaced(w: str, rules: list[tuple[str, str]]) -> str:
    """By the longest suffix of the rules that a word has, where the stem before it has a measure above 0."""
    found = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found is None:
        return w
    stem = w[: len(w) - len(found[0])]
    return stem + found[1] if _measure(stem) > 0 else w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e)), None)
        if cut is not None and _has_vowel(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2), STEP3)
    last = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if last is not None:
        rest = w[: len(w) - len(last)] + (last[0] if last in ("sion", "tion") else "")
        if _measure(rest) > 1:
            w = rest
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words, in order; null stays null."""
    keep_batches_small()

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        coded = column.flatten().dictionary_encode()
        new = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        out = new.take(coded.indices)
        return pa.ListArray.from_arrays(_offsets(column), out, mask=column.is_null() if column.null_count else None)

    return run(words)


def _offsets(column):
    """Offsets from 0 of an Arrow array of arrays."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
