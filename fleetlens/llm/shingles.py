"""Word shingles as 64-bit numbers, for many texts at once.

Words are the runs of characters other than ASCII white space; A-Z are lower-cased. A text of fewer words than a shingle
takes is one shingle, its whole sequence; a text without words (or null) has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

_MULTIPLY, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []


def _mix(state: np.ndarray, value: np.ndarray | np.uint64) -> np.ndarray:
    state = (state ^ (state >> np.uint64(29)) ^ value) * _SPREAD
    return state ^ (state >> np.uint64(32))


def shingle_hashes(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The shingles of each text in the order of its words, repeats included."""
    found = [words(text) for text in texts]
    flat = [word for each in found for word in each]
    if not flat:
        return [np.empty(0, np.uint64) for _ in texts]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=True).astype(np.uint64)
    last = max(1, len(hashes) - size + 1)
    with np.errstate(over="ignore"):
        state = hashes[:last] * _MULTIPLY
        if len(hashes) >= size:
            for k in range(1, size):
                state = _mix(state, hashes[k : k + last])
        out, begin = [], 0
        for each in found:
            n = len(each)
            if n >= size:
                out.append(state[begin : begin + n - size + 1])
            elif n:
                own = hashes[begin : begin + 1] * _MULTIPLY
                for k in range(1, n):
                    own = _mix(own, hashes[begin + k : begin + k + 1])
                out.append(_mix(own, np.uint64(size - n)))
            else:
                out.append(np.empty(0, np.uint64))
            begin += n
    return out


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    return [np.unique(each) for each in shingle_hashes(texts, size)]
