"""Pre-tokens of texts, numbered by a dictionary of those met so far, and the rank file of a byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct pre-tokens that a task remembers; beyond it the dictionary starts anew, so that memory is bounded.
REMEMBER = 1_000_000


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Numbers(dict):
    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        return number


class Pretokens:
    """Numbers the matches of a pattern; `fresh` lists those numbered since it was last taken."""

    def __init__(self, pattern: str) -> None:
        self.findall = regex.compile(pattern).findall
        self.numbers, self.known = _Numbers(), 0

    def full(self) -> bool:
        return len(self.numbers) > REMEMBER

    def number(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all matches, end to end, and where each text's begin (with a last entry: their count); a null has none."""
        numbers = self.numbers
        rows = [np.array([numbers[t] for t in self.findall(text.as_py() or "")], np.int64) for text in texts]
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def fresh(self) -> list[bytes]:
        words = list(self.numbers)[self.known :] if self.known < len(self.numbers) else []
        self.known = len(self.numbers)
        return [w.encode() for w in words]


def slices(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Runs of rows of about `limit` bytes of text each."""
    out, lo, size = [], 0, 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if size and size + n > limit:
            out.append((lo, i))
            lo, size = i, 0
        size += n
    return [*out, (lo, len(column))] if lo < len(column) else out
