"""Token counts of a unigram model by dynamic programming over a trie of distinct pre-tokens.

The model: a byte-level vocabulary whose tokens follow Zipf's law by rank, log p = -ln(rank + 1) up to a constant factor per token.
A pre-token's segmentation is the one of the highest score, of equals the one of fewest tokens. In a task the distinct pre-tokens are
walked in sorted order, which is a walk of their trie: the forward scores of a shared prefix are computed once, and each end of a word
stores its token count.

Defined results: a null or empty text has no tokens; rows are independent; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.pretokens import Pretokens, ranks, slices

COUNTS = "doc_id long, n_pretokens long, n_tokens long"
_TEXT = 3_000_000


def scores(path: str) -> dict[bytes, float]:
    """Log-probability of each token, with the normaliser of the Zipf law."""
    token = ranks(path)
    whole = log(sum(1 / (r + 1) for r in token.values()))
    return {t: -log(r + 1) - whole for t, r in token.items()}


@lru_cache(2)
def _backward(path: str) -> dict:
    """A trie of the reversed tokens: a node maps a byte to a node, and None to the token's score."""
    root: dict = {}
    for token, score in scores(path).items():
        node = root
        for byte in reversed(token):
            node = node.setdefault(byte, {})
        node[None] = score
    return root


def count_words(path: str, words: list[bytes]) -> np.ndarray:
    """The token count of every word."""
    root, counts = _backward(path), np.zeros(len(words), np.int64)
    best, used, before = [0.0], [0], b""
    for i in sorted(range(len(words)), key=words.__getitem__):
        word = words[i]
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], used[shared + 1 :]
        for end in range(shared, len(word)):
            node, at, top, fewest = root, end, -float("inf"), 0
            while at >= 0 and (node := node.get(word[at])) is not None:
                score = node.get(None)
                if score is not None and (score + best[at], -used[at] - 1) > (top, -fewest):
                    top, fewest = score + best[at], used[at] + 1
                at -= 1
            best.append(top)
            used.append(fewest)
        counts[i], before = used[-1], word
    return counts


def _counter(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Pretokens(pattern), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts, _TEXT):
                if words.full():
                    words, counts = Pretokens(pattern), np.zeros(0, np.int64)
                numbers, bounds = words.number(texts.slice(lo, hi - lo))
                counts = np.concatenate([counts, count_words(path, words.fresh())])
                sums = np.concatenate([[0], np.cumsum(counts[numbers])])[bounds]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(np.diff(sums))], [c.split()[0] for c in COUNTS.split(", ")])

    return run


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_counter(path, pattern), COUNTS)
