"""The pipeline against brute-force versions of its stages, each on the rows that the stage before it left."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from quern.llm import mixing, near_dedup, quality_classifier, secret_scan
from quern.llm.pretokens import ranks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(4)
    words = [a + b for a in ("ta", "mo", "ri", "sel", "ka", "von", "pe") for b in ("n", "lo", "rit", "s", "mer")]
    rows = []
    for i in range(400):
        text = ". ".join(" ".join(rng.choice(words, 10)).capitalize() for _ in range(5)) + "."
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in rng.choice(words, 50))
        if i % 25 == 1:
            text = rows[-1][1] + " end" if i % 50 == 1 else text + " password=abcdef123456"
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"file://{root}/labels.parquet")
    return f"file://{root}"


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(P.VOCABULARY), special_tokens={})
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{k}")
        after_df = spark.read.parquet(f"file://{tmp_path}/{k}")
        after = after_df.collect()
        ids = [r.doc_id for r in after]
        if k < 4:
            assert after_df.columns == docs.columns
        if name == "quality classifier":
            good = {r.doc_id for r in quality_classifier.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
            assert set(ids) == good and sum(i % 4 > 0 for i in ids) >= 0.97 * 300 and sum(i % 4 == 0 for i in ids) <= 5
        elif name == "MinHash near-dedup":
            assert set(ids) == {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()} and len(ids) == len(set(ids))
        elif name == "secret scans":
            assert sorted(ids) == sorted(r.doc_id for r in before)
            found = {r.doc_id for r in secret_scan.scan(docs).where("spans <> ''").collect()}
            assert found and all(("password=" in b.text) == (b.doc_id in found) for b in before) and not any("password=" in r.text for r in after)
        elif name == "mixing sources":
            plan = {r.doc_id: len(r.shards) for r in mixing.mix_plan(docs).collect()}
            assert Counter(ids) == +Counter(plan)
        else:
            text = Counter(r.text for r in before)
            expected = Counter()
            for r in before:
                e = enc.encode_ordinary(r.text)
                expected[r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
            assert text and Counter(map(tuple, after)) == expected
        docs = after_df
    assert Counter(map(tuple, P.run(spark, folder).collect())) == Counter(map(tuple, docs.collect()))


ODD = "key long, shard long, row string, score double, kept boolean, component_id long, at long, spans string, place string, label string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named as the operators name theirs."""
    rng = np.random.default_rng(8)
    words = [a + b for a in ("ta", "mo", "ri", "sel", "ka", "von", "pe") for b in ("n", "lo", "rit", "s", "mer")]
    prose = lambda n: ". ".join(" ".join(rng.choice(words, 10)).capitalize() for _ in range(n)) + "."
    rows = [(i, prose(4), "en", f"s{i % 4}") for i in range(80)]
    long = prose(3000)
    rows += [(80, long, "en", "s1"), (81, long + " the end", "en", "s2"), (82, None, None, None), (83, "", "en", "s0"), (84, " \n ", None, "s1"), (None, rows[0][1], "en", "s1"), (None, None, None, None), (85, "one two", "en", None), (86, "one two", "en", None)]
    rows += [rows[3], rows[3], (3, rows[3][1], None, "s0"), (87, rows[5][1] + " password=abcdef123456", "en", "s3"), (88, "token: zyxwvut98765 " + prose(3), "en", "s3")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) if i % 2 else F.lit("1").cast(c.split()[1]) for i, c in enumerate(ODD.split(", "))}).repartition(5)


def test_odd_rows(spark, odd_docs):
    from test_other_operators import brute_targets
    from test_text_operators import BRUTE, brute_components, shingles

    rows = odd_docs.collect()
    plain = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    kept = P.drop_near_duplicates(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    component = brute_components({r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None})
    assert plain(kept) == Counter((r.doc_id, r.text, r.source) for r in rows if r.doc_id is None or component[r.doc_id] == r.doc_id)
    assert {81, 86, 87} <= {i for i, c in component.items() if i != c}
    clean = P.redact_secrets(spark, odd_docs, "")
    assert clean.columns == odd_docs.columns
    hidden = lambda t: t and BRUTE["assign"][0].sub(lambda m: "[SECRET]" if len(m.group(2)) >= 6 else m.group(0), t)
    assert plain(clean) == Counter((r.doc_id, hidden(r.text), r.source) for r in rows)
    assert all(r.n_chars == len(r.text) for r in clean.where("text LIKE '%SECRET%'").collect())
    mixed = P.mix_sources(spark, odd_docs, "")
    assert mixed.columns == odd_docs.columns
    size, taken, source_of = Counter(), Counter(), {(r.doc_id, r.text, r.source): len((r.text or "").split()) for r in rows}
    for r in rows:
        size[r.source] += len((r.text or "").split())
    for (i, text, source), n in plain(mixed).items():
        assert (i, text, source) in source_of
        taken[source] += n * len((text or "").split())
    for source, goal in brute_targets(dict(size)).items():
        largest = max(len((r.text or "").split()) for r in rows if r.source == source)
        assert abs(taken[source] - goal) <= largest / 2 + 60, (source, taken[source], goal)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(P.VOCABULARY), special_tokens={})
    out = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in P.encode_and_decode(spark, odd_docs, "").collect())
    assert out == Counter((r.doc_id, len(enc.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)


def test_run_of_odd_and_empty_tables(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80)] + [(None, None, None), (84, 0, 1), (83, 0, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("empty", odd_docs.limit(0))):
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        out = P.run(spark, f"file://{tmp_path}/{name}")
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (out.count() > 0) == (name == "odd")
