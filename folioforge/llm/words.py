"""Words and shingles as numpy arrays, for Arrow batches of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a run of letters or numerals (\w without the underscore).
WORD = re.compile(r"[^\W_]+")

_MEMO_ROWS = 400_000
_memo: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; the worker keeps the hashes of words seen before, up to a fixed number of rows."""
    memo = _memo
    if len(memo) > _MEMO_ROWS:
        memo.clear()
    try:
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order, given the words' hashes; empty if there are fewer than n words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ hashes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out
