"""Mixing, URL filters, images and the pipeline, with edge cases."""

import datetime
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import image_copies, mixing, url_filters


def mix_docs(spark, n=900):
    rng = np.random.default_rng(2)
    sources = ["a", "b", "c", None, "hot"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", "hot" if i % 3 == 0 else sources[i % 5]) for i in range(n)]
    rows += [(n, None, None, "a"), (n + 1, "", None, None), (n + 2, "w " * 5000, None, "b"), (5, rows[5][1], "en", rows[5][3]), (None, "w w w", None, "a"), (None, "w w", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"key": F.lit("clash"), "shard": F.lit(1)})


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_are_reshared(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 1, "b": 1, "c": 500, "d": 0}, {"x": 0}, {"x": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    docs = mix_docs(spark)
    out = mixing.mix_plan(docs).collect()
    assert len(out) == docs.count()
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    goal = brute_targets(dict(sizes))
    taken, source = Counter(), {r.doc_id: r.source for r in rows}
    largest = {s: max(len((r.text or "").split()) for r in rows if r.source == s) for s in sizes}
    for r in out:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
            taken[s] += r.taken
    for s in goal:
        assert taken[s] == pytest.approx(goal[s], abs=0.005 * goal[s] + largest[s] / 2), s
    assert Counter(map(str, out)) == Counter(map(str, mixing.mix_plan(docs.repartition(13)).collect()))


def test_mixed_rows(spark):
    docs = mix_docs(spark)
    plan = Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[r.doc_id] += len(r.shards)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +plan


def test_shards_follow_the_size(spark):
    assert [mixing.shard_count(n) for n in (0, 1, 32 << 25, (32 << 25) + 1, 10**13)] == [32, 32, 32, 64, 1 << 19]
    docs = mix_docs(spark)
    a, b = (Counter((r.doc_id, r.taken > 0) for r in mixing.mix_plan(docs, shards=n).collect()) for n in (8, 64))
    assert sum((a - b).values()) < 0.2 * sum(a.values())
    mixed = mixing.mixed(docs, shards=64)
    assert mixed.rdd.getNumPartitions() == 64
    per = [r["n"] for r in mixed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per) > 32 and max(per) < 0.2 * sum(per)


def test_split_is_exact(spark):
    units = spark.createDataFrame([(s, i + 1) for s, n in (("a", 37), ("b", 64), (None, 11)) for i in range(n)], "source string, rank int")
    rows = mixing.split_quotas(units, 1, 8).collect()
    assert sorted((r.source or "", r.rank) for r in rows) == sorted((r.source or "", r.rank) for r in units.collect())
    per = Counter(r.shard for r in rows)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 3
    for s in ("a", "b", None):
        shards = [r.shard for r in sorted((r for r in rows if r.source == s), key=lambda r: r.rank)]
        assert shards == sorted(shards)


def test_split_follows_the_hypergeometric_law(spark):
    """The mean share of a source in a half over seeds."""
    units = spark.createDataFrame([("a", i + 1) for i in range(30)] + [("b", i + 1) for i in range(10)], "source string, rank int")
    shares = [mixing.split_quotas(units, seed, 2).where("source = 'b' AND shard = 0").count() for seed in range(40)]
    assert 4.2 < np.mean(shares) < 5.8 and 0.5 < np.var(shares) < 4


def test_empty_mix(spark):
    docs = mix_docs(spark).limit(0)
    assert mixing.mix_plan(docs).collect() == [] and mixing.mixed(docs).collect() == []


D = datetime.date


def test_url_verdicts(spark):
    entries = [("bad.org", "block", D(2024, 1, 1)), ("bad.org", "allow", D(2024, 3, 1)), ("bad.org", "block", D(2024, 3, 1)), ("bad.org", "allow", D(2024, 6, 1)), ("bad.org/ok", "allow", D(2024, 1, 15)), ("sub.bad.org", "allow", D(2024, 2, 1)), (None, "block", D(2024, 1, 1)), ("x.org", None, D(2024, 1, 1)), ("host", "block", D(2024, 1, 1)), ("y.org", "block", None)]
    cases = [
        ("http://bad.org/a", D(2023, 12, 31), None, False), ("http://bad.org/a", D(2024, 1, 1), "bad.org", True), ("https://user@WWW.Bad.org.:8080/a?q#f", D(2024, 4, 1), "bad.org", True), ("http://bad.org", D(2024, 6, 1), "bad.org", False),
        ("http://bad.org/ok/deep//x", D(2024, 1, 20), "bad.org/ok", False), ("http://bad.org/okay", D(2024, 1, 20), "bad.org", True), ("http://a.sub.bad.org/", D(2024, 2, 1), "sub.bad.org", False), ("http://a.sub.bad.org/", D(2024, 1, 31), "bad.org", True),
        ("http://notbad.org", D(2024, 2, 1), None, False), (None, D(2024, 2, 1), None, False), ("", D(2024, 2, 1), None, False), ("http://bad.org/", None, None, False), ("http://x.org/", D(2024, 2, 1), None, False), ("http://host/p", D(2024, 2, 1), "host", True), ("http://y.org", D(2025, 1, 1), None, False),
    ]
    captures = spark.createDataFrame([(i, u, d, "clash", "mine", "x", 1) for i, (u, d, _, _) in enumerate(cases)] * 2, "page_id long, url string, fetched_on date, key string, action string, _url string, _best int")
    judged = url_filters.verdicts(captures, spark.createDataFrame(entries, "key string, action string, listed_on date").withColumn("until", F.lit("clash")))
    assert judged.columns == ["page_id", "url", "fetched_on", "key", "_url", "_best", "matched_key", "action", "listed_on", "blocked"]
    out = judged.collect()
    assert all((r.key, r._url, r._best) == ("clash", "x", 1) and r.action != "mine" for r in out)
    assert len(out) == 2 * len(cases)
    for r in out:
        assert (r.matched_key, r.blocked) == cases[r.page_id][2:], cases[r.page_id]
    long = spark.createDataFrame([(1, "http://a.b.org/" + "p/" * 2000 + "x" * 100_000, D(2024, 1, 1))], "page_id long, url string, fetched_on date")
    assert url_filters.verdicts(long, spark.createDataFrame([("b.org/p", "block", D(2023, 1, 1)), ("a.b.org/p/p", "block", D(2023, 1, 1))], "key string, action string, listed_on date")).first().matched_key == "a.b.org/p/p"
    none = url_filters.verdicts(captures.limit(0), spark.createDataFrame(entries, "key string, action string, listed_on date"))
    assert none.collect() == [] and url_filters.verdicts(captures, spark.createDataFrame([], "key string, action string, listed_on date")).where("blocked").count() == 0


def photo(seed, side=80):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:side, 0:side] / side
    out = sum(np.cos(2 * np.pi * (f * (np.cos(t) * x + np.sin(t) * y)) + p) for f, t, p in zip(rng.uniform(2, 9, 40), rng.uniform(0, 3.1, 40), rng.uniform(0, 6.2, 40), strict=True))
    return (127 + 100 * np.tanh(out / out.std())).astype(np.uint8)


def shrunk(image, ratio):
    return image_copies._scaled(image.astype(float), ratio).astype(np.uint8)


def test_image_copies(spark):
    images, expected = [], {}
    for k in range(20):
        p = photo(k, 80 + 60 * (k % 4 == 0))
        n = len(p)
        edits = [p, p.copy(), p[8:, 5 : n - 10], np.rot90(p)[4:], (p * 0.7 + 20).astype(np.uint8)]
        edits += [p[n // 4 : -n // 8, n // 8 : -n // 4], shrunk(p, 0.7)] if k % 4 == 0 else []
        for j, e in enumerate(edits if k % 2 == 0 else edits[:1]):
            images.append((k * 10 + j, e.shape[0], e.shape[1], bytearray(np.ascontiguousarray(e).tobytes())))
            expected[k * 10 + j] = k * 10
    odd = [(901, 5, 5, bytearray(b"x" * 25)), (902, None, 3, None), (903, 4, 4, bytearray(b"short")), (904, 80, 80, bytearray(b"\x07" * 6400)), (None, 2, 2, bytearray(b"abcd")), images[0]]
    df = spark.createDataFrame(images + odd, image_copies.IMAGE).withColumns({"words": F.lit("clash"), "component": F.lit(1), "corners": F.lit(b"x")}).repartition(3)
    out = {r.image_id: r for r in image_copies.image_copies(df).collect()}
    assert set(out) == set(expected) | {901, 902, 903, 904}
    assert {i: out[i].component_id for i in expected} == expected
    assert all(out[i].component_id == i and out[i].n_links == 0 for i in (901, 902, 903, 904))
    assert all(out[i].n_corners == len(image_copies.corners(np.frombuffer(bytes(b), np.uint8).reshape(h, w))) for i, h, w, b in images)
    assert image_copies.image_copies(df.limit(0)).collect() == []


def test_image_classes_match_brute_force(spark):
    """Unrelated images that share a small patch, and so buckets, each with a cropped copy: the classes are those of all pairs checked."""
    mark = photo(99)[20:52, 20:52]
    pictures = []
    for k in range(24):
        p = photo(k, 110)
        at = 5 * (k % 12)
        p[at : at + 32, 40:72] = mark
        pictures += [p, p[6:, 3:]]
    images = [(k, *p.shape, bytearray(np.ascontiguousarray(p).tobytes())) for k, p in enumerate(pictures)]
    df = spark.createDataFrame(images, image_copies.IMAGE)
    out = {r.image_id: r.component_id for r in image_copies.image_copies(df).collect()}
    described = [image_copies.corners(p) for p in pictures]
    root = list(range(len(pictures)))
    for a in range(len(pictures)):
        for b in range(a):
            if image_copies.votes(described[b], described[a]) >= image_copies.VOTES:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert out == dict(enumerate(root)) and all(root[k] == root[k - k % 2] for k in range(len(pictures)))
    met = image_copies.buckets(df.withColumn("sha", F.lit("")).mapInArrow(image_copies._describe, image_copies._DESCRIBED))
    assert max(r["n"] for r in met.groupBy("key").agg(F.count_distinct("image_id").alias("n")).collect()) >= 12


def test_rendered_copies_are_found(spark):
    """Recall by kind of edit on the smallest tables: crops, edits and turned crops of the images whose ids end in 0."""
    images = image_copies.rendered(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    of = {r.image_id: r.component_id for r in image_copies.image_copies(images).collect()}
    for kind in (1, 2, 3):
        copies = [i for i in of if i % 10 == kind and i - kind in of]
        assert sum(of[i] == of[i - kind] for i in copies) >= 0.95 * len(copies) > 0
    assert len(set(of.values())) >= 0.69 * len(of)
