"""Byte-level BPE by recursive DuckDB queries inside each partition: encoding to ids and decoding of ids.

Within a task, distinct pre-tokens become (word, position, token) rows. A recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of the lowest rank until none is left. Pre-tokens that are tokens themselves need no merges, as in
the tiktoken library. Words of over 192 bytes are contracted in overlapping blocks, which are joined at tokens that both have, so that
time and memory grow with a word's length, not its square. Ordered aggregation of token bytes decodes.

Defined results: a null or empty text has no ids and decodes to no bytes; rows are independent, so repeated rows repeat; other columns
of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.pretokens import Pretokens, ranks, slices

IDS = "doc_id long, ids array<int>"
DECODED = IDS + ", decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of text that a task handles at once, and squares of word lengths in one recursive query, which bound its rows.
_TEXT, _SQUARES = 3_000_000, 4_000_000
#: Longer words are contracted in blocks of so many bytes, which begin so many bytes apart.
BLOCK, STEP = 192, 128

#: A row is (word, position) packed as `place`, and its token. A pair is packed as rank and place of its left token, so that the least is the leftmost of the lowest rank; its right token is the row whose neighbour before it is that place.
_CONTRACT = """
WITH RECURSIVE step(place, tok, live) AS (
    SELECT place, tok, true FROM tokens
    UNION ALL
    (WITH pairs AS (
        SELECT s.place, s.tok, s.before, CASE WHEN s.place >> 23 = s.after >> 23 THEN m.top + s.place END AS pair
        FROM (SELECT place, tok, lag(place) OVER w AS before, lead(place) OVER w AS after, (tok::BIGINT << 20) + lead(tok) OVER w AS two FROM step WHERE live WINDOW w AS (ORDER BY place)) s
        LEFT JOIN merges m USING (two)),
    least AS (SELECT place >> 23 AS word, min(pair) AS best FROM pairs GROUP BY ALL)
    SELECT place, CASE WHEN place = best & 17592186044415 THEN (best >> 44)::INT ELSE tok END, best IS NOT NULL
    FROM pairs JOIN least ON word = place >> 23
    WHERE best IS NULL OR before IS DISTINCT FROM best & 17592186044415)
)
SELECT list(tok ORDER BY place) AS ids FROM step WHERE NOT live GROUP BY place >> 23 ORDER BY place >> 23
"""
_DECODE = "SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS decoded FROM ids JOIN vocabulary USING (id) GROUP BY doc"


@lru_cache(2)
def _session(path: str) -> tuple[duckdb.DuckDBPyConnection, dict[bytes, int], np.ndarray, np.ndarray]:
    """A connection with the tables vocabulary(id, hex) and merges(two, top), two ids and the rank packed; the ranks; the ids of single bytes; the bytes in each token. Queries are small and don't spill."""
    token = ranks(path)
    pairs = [((token[t[:k]] << 20) + token[t[k:]], i << 44) for t, i in token.items() for k in range(1, len(t)) if t[:k] in token and t[k:] in token]
    if max(token.values()) >= 1 << 19:
        raise ValueError("ids of 2**19 and more can't be packed")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '400MB'")
    con.execute("SET temp_directory = ''")
    merges = pa.table(dict(zip(("two", "top"), (pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)), strict=True)))
    words = pa.table({"id": pa.array(list(token.values()), pa.int32()), "hex": [t.hex() for t in token]})
    for name, table in (("merges", merges), ("vocabulary", words)):
        con.register("given", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        con.unregister("given")
    sizes = np.zeros(max(token.values()) + 1, np.int64)
    sizes[list(token.values())] = [len(t) for t in token]
    return con, token, np.array([token[bytes([b])] for b in range(256)], np.int32), sizes


def _contracted(path: str, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word, contracted from its bytes."""
    con, _, single, _ = _session(path)
    if max(map(len, words), default=0) >= 1 << 23:
        raise ValueError("blocks of 2**23 bytes and more can't be packed")
    out, squares = [], np.cumsum([len(w) ** 2 for w in words])
    while len(out) < len(words):
        lo = len(out)
        n = max(1, int(np.searchsorted(squares, (squares[lo - 1] if lo else 0) + _SQUARES, "right")) - lo)
        sizes = np.array([len(w) for w in words[lo : lo + n]])
        data = np.frombuffer(b"".join(words[lo : lo + n]), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (np.repeat(np.arange(n), sizes) << 23)
        con.register("tokens", pa.table({"place": place, "tok": single[data]}))
        lists = con.sql(_CONTRACT).to_arrow_table()["ids"].combine_chunks()
        con.unregister("tokens")
        ends = np.array(lists.offsets)
        out += np.split(np.array(lists.values, np.int32), ends[1:-1] - ends[0])
    return out


def _stitched(path: str, parts: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, list[int]]:
    """The ids of a word from those of overlapping blocks (begin, end, ids), and which blocks have no token in common with the one before. Two blocks are joined at a token of both: a sequence is what contraction gives if every two neighbours are, and these are neighbours in a block."""
    sizes, out, apart = _session(path)[3], [], []
    ids, place = np.zeros(0, np.int32), np.zeros(1, np.int64)
    for k, (lo, _, more) in enumerate(parts):
        at = lo + np.concatenate([[0], np.cumsum(sizes[more])])
        _, left, right = np.intersect1d((place[:-1] << 32) + place[1:], (at[:-1] << 32) + at[1:], return_indices=True)
        if k and not len(left):
            apart.append(k)
        out.append(ids[: left[0] if len(left) else 0])
        ids, place = (more[right[0] :], at[right[0] :]) if len(left) else (more, at)
    return np.concatenate([*out, ids]), apart


def _long_words(path: str, words: list[bytes]) -> list[np.ndarray]:
    """Ids of words of more than a block, all words' blocks at once; what is left open is contracted in larger blocks, at last the whole word."""
    spans = [[(lo, min(lo + BLOCK, len(w))) for lo in range(0, len(w) - BLOCK + STEP, STEP)] for w in words]
    known: dict = {}
    out: list = [None] * len(words)
    todo = list(range(len(words)))
    while todo:
        new = [(i, *span) for i in todo for span in spans[i] if (i, *span) not in known]
        known |= zip(new, _contracted(path, [words[i][lo:hi] for i, lo, hi in new]), strict=True)
        for i in todo:
            ids, apart = _stitched(path, [(*span, known[i, *span]) for span in spans[i]])
            if not apart:
                out[i] = ids
            for k in reversed(apart):
                if k < len(spans[i]):
                    spans[i][k - 1 :] = [(spans[i][k - 1][0], spans[i][k][1]), *spans[i][k + 1 :]]
        todo = [i for i in todo if out[i] is None]
    return out


def encode_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and the number of ids of each."""
    token = _session(path)[1]
    found: list = [np.array([token[w]], np.int32) if w in token else None for w in words]
    for contract, of in ((_contracted, range(BLOCK + 1)), (_long_words, range(BLOCK + 1, 2**40))):
        todo = [i for i, f in enumerate(found) if f is None and len(words[i]) in of]
        for i, ids in zip(todo, contract(path, [words[i] for i in todo]), strict=True):
            found[i] = ids
    return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(f) for f in found], np.int64)


class _Memory:
    """Ids of the pre-tokens that a worker has met, in this task or in those before it; it starts anew when full or after an error."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.sizes = Pretokens(self.pattern), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> pa.Array:
        if self.words.full():
            self.forget()
        try:
            numbers, bounds = self.words.number(texts)
            new, new_sizes = encode_words(self.path, self.words.fresh())
        except BaseException:
            self.forget()
            raise
        self.flat, self.sizes = np.concatenate([self.flat, new]), np.concatenate([self.sizes, new_sizes])
        begins, n = np.cumsum(self.sizes) - self.sizes, self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(begins[numbers] - ends[:-1], n) + np.arange(ends[-1])]
        return pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(ids))


@lru_cache(1)
def _memory(path: str, pattern: str) -> _Memory:
    return _Memory(path, pattern)


def _encoder(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts, _TEXT):
                ids = _memory(path, pattern).encode(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), ids], ["doc_id", "ids"])

    return run


def _decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _session(path)[0]
        for batch in batches:
            lists = batch.column("ids")
            ids, sizes = lists.flatten(), np.array(pc.list_value_length(lists).fill_null(0))
            con.register("ids", pa.table({"doc": np.repeat(np.arange(len(sizes)), sizes), "pos": np.arange(len(ids)), "id": ids}))
            out = con.sql(_DECODE).to_arrow_table()
            con.unregister("ids")
            decoded = [b""] * len(sizes)
            for doc, text in zip(out["doc"].to_pylist(), out["decoded"].to_pylist(), strict=True):
                decoded[doc] = text
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.array(x.values, np.dtype("<u4")).tobytes() for x in batch.column("ids")]
        text = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
        columns = [batch.column("doc_id"), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in ids]), pa.array(text)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text): each match of pattern by itself, with the ranks of the file at path, on every machine."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, pattern), IDS)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of tokens(doc_id, ids): the bytes of the ids, in order."""
    return tokens.select("doc_id", "ids").mapInArrow(_decoder(path), DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and digest both within a task: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    encoder, decoder = _encoder(path, pattern), _decoder(path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _digests(decoder(encoder(batches))), DIGESTS)
