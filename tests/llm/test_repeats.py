"""Removal of repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import registry, repeats

SCHEMA = "doc_id long, text string, lang string, spans string, row string, found string"


def plain(texts, least):
    """(n_removed, spans, kept bytes) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 2, int)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                covered[i + 1] += 1
                covered[i + least + 1] -= 1
        hit = np.cumsum(covered)[1 : len(d) + 1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((spans, bytes(b for b, h in zip(d, hit, strict=True) if not h)))
    return out


def run(spark, texts, least, anchor, parts=4, ids=None, **more):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(parts)
    rows = repeats.without_repeats(df, least, anchor, **more).collect()
    return sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows), key=str)


def expected(texts, least, ids=None):
    ids = ids or list(range(len(texts)))
    return sorted(((i, t, s, k) for i, t, (s, k) in zip(ids, texts, plain(texts, least), strict=True)), key=str)


def passage_texts(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)] + ["é", "日本", "ß\x00", "🙂"]
    prose = lambda k: " ".join(words[i] for i in rng.integers(0, len(words), k))
    shared = [prose(60) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [prose(rng.integers(0, 50))]
        for _ in range(rng.integers(0, 3)):
            p = shared[rng.integers(0, 5)]
            a = rng.integers(0, len(p) // 2)
            parts += [p[a : a + rng.integers(20, len(p))], prose(rng.integers(0, 30))]
        out.append(" ".join(parts))
    # copies, near copies, runs, periods and what overlaps itself
    out += [out[0], out[0], out[1][:300] + "!" + out[1][300:], "a" * 900, "a" * 450, "ab" * 300, "abcabcd" * 120, shared[0] + shared[0], "z" * 199, "", None, " ", shared[1][:200], shared[1][1:201]]
    return out


@pytest.mark.parametrize(("least", "anchor"), [(200, 64), (50, 16), (50, 50), (24, 5)])
def test_equals_brute_force(spark, least, anchor):
    texts = passage_texts(least)
    assert run(spark, texts, least, anchor) == expected(texts, least)


def test_large_buckets_are_cut_anew(spark):
    rng = np.random.default_rng(4)
    line = "".join(chr(97 + c) for c in rng.integers(0, 26, 44))
    # the same line, with other words around it: one bucket for most windows
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 4, 30)) + line + str(i % 37) * 2 + "".join(chr(97 + c) for c in rng.integers(0, 3, 9)) + "tail" for i in range(300)] + ["a" * 400, "a" * 300]
    assert run(spark, texts, 60, 20, large=500) == expected(texts, 60)
    assert run(spark, texts, 60, 20, large=0) == expected(texts, 60)


def test_rows_that_repeat_ids_or_have_none(spark):
    texts = passage_texts(3, 8)[:8]
    texts += [texts[2], texts[2], texts[3], texts[4]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 2, None, None, 5]
    assert run(spark, texts, 200, 64, ids=ids) == expected(texts, 200, ids)
    assert run(spark, ["x" * 300], 200, 64) == expected(["x" * 300], 200)


def test_empty_table_and_rows(spark):
    assert run(spark, [], 200, 64) == []
    assert run(spark, [None, "", "short"], 200, 64) == expected([None, "", "short"], 200)


def test_long_texts_come_in_slices(spark):
    rng = np.random.default_rng(8)
    make = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    own = make(2_500_000)
    edge = own[repeats.SLICE - 150 : repeats.SLICE + 150]
    texts = [own, "begin " + edge + " end", own[2_000_000 : 2_000_400] + make(50)]
    got = {r[0]: r for r in run(spark, texts, 200, 64)}
    # 400 bytes of its own text and 300 around the edge
    assert got[0][2] == [(repeats.SLICE - 150, repeats.SLICE + 150), (2_000_000, 2_000_400)]
    assert got[1][2] == [(6, 306)] and got[2][2] == [(0, 400)]


def test_intervals_give_what_the_suffixes_say():
    rng = np.random.default_rng(6)
    for symbols in (2, 3, 20):
        parts = [rng.integers(1, symbols + 1, rng.integers(1, 60)) for _ in range(12)] + [np.full(40, 1)]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int64)
        for least in (1, 2, 5, 9):
            windows = Counter(tuple(text[i : i + least]) for i in range(len(text) - least + 1) if 0 not in text[i : i + least])
            got = repeats.repeated_starts(text, least)
            for i in range(len(text) - least + 1):
                w = tuple(text[i : i + least])
                assert 0 in w or got[i] == (windows[w] > 1)


def test_query_equals_brute_force(spark, tmp_path):
    texts = passage_texts(12)
    spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.op13_suffix_array_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == [(i, len((t or "").encode()), len((t or "").encode()) - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, (t, (s, k)) in enumerate(zip(texts, plain(texts, 200), strict=True))]
    assert sum(x[2] for x in got) > 5000
