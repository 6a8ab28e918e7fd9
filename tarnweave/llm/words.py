"""Word splitting shared by the text operators.

Words: split at white space, reduced to letters and digits, lower-cased, dropped if empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_NOT_ALNUM = re.compile(r"[\W_]+")

#: Odd multipliers for combining word hashes into n-gram hashes.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def split_words(text: str | None) -> list[str]:
    """The words of a text; a null text has none."""
    if not text:
        return []
    out = []
    for raw in text.split():
        word = raw if raw.isalnum() else _NOT_ALNUM.sub("", raw)
        if word:
            out.append(word.lower())
    return out


def slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list whose texts have about ``most`` characters, so that arrays over them stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class WordHasher:
    """Stable 64-bit word hashes, remembered for the words seen lately."""

    def __init__(self, keep: int = 400_000):
        self._known: dict[str, int] = {}
        self._keep = keep

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self._keep:
            known.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


class TextHasher:
    """Stable 64-bit hashes of the words of a text, by its tokens between white space, which are remembered.

    The words are those of ``split_words``; 0 stands for a token without letters and digits.
    """

    def __init__(self, keep: int = 400_000):
        self._known: dict[str, int] = {}
        self._keep = keep

    def __call__(self, text: str) -> np.ndarray:
        known, tokens = self._known, text.split()
        if len(known) > self._keep:
            known.clear()
        for t in tokens:
            if t not in known:
                word = t if t.isalnum() else _NOT_ALNUM.sub("", t)
                known[t] = (xxhash.xxh3_64_intdigest(word.lower()) or 1) if word else 0
        out = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        return out[out != 0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in text order; order within a run matters."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    count = len(words) - n + 1
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out ^ (words[i : i + count] * _MULTIPLIERS[i % len(_MULTIPLIERS)])) + np.uint64(i)
    return out
