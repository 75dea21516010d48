import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.chunking import chunk_documents, fixed_split, split_text
from quern.operators.tagging import normalize_verdict


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("o")).first().o


@pytest.mark.parametrize(("dirty", "clean"), [("﻿hola", "hola"), ("a   b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("a\x00\x01b", "ab"), ("  a  \n  b ", "a\nb"), ("", ""), ("   ", ""), (None, None)])
def test_clean_text(spark, dirty, clean):
    assert one(spark, dirty, T.clean_text) == clean


@pytest.mark.parametrize("cell", ["1", " 1 000,5", "1e5", "1_000", "-inf", "nan", ".5", "5."])
def test_numbers(spark, cell):
    assert one(spark, cell, T.looks_numeric)


@pytest.mark.parametrize("cell", ["", "1d", "1__0", "e5", "a", "1-2", None])
def test_not_numbers(spark, cell):
    assert not one(spark, cell, T.looks_numeric)


def test_authority_takes_the_first_hit(spark):
    assert one(spark, "Normativa_precios.pdf", T.authority) == 1.0
    assert one(spark, "AGENDA.csv", T.authority) == 0.6
    assert one(spark, None, T.authority) == 0.7


@pytest.mark.parametrize(
    ("answer", "expected"),
    [("nothing", ("instalaciones", "", 0.5)), ('{"categoria": "agenda", "tags": ["abono", "x"], "relevancia": 0.9}', ("agenda", "abono", 0.9)), ('{"categoria": "tarifas"}', ("tarifas", "", 0.0)), ('{"categoria": "z", "relevancia": "high"}', ("instalaciones", "", 0.0)), ("{broken", ("instalaciones", "", 0.5)), ("{}", ("instalaciones", "", 0.0)), ('{"note": 1}', ("instalaciones", "", 0.0)), (None, ("instalaciones", "", 0.5))],
)
def test_verdict(spark, answer, expected):
    v = one(spark, answer, normalize_verdict)
    assert (v.doc_category, v.tags, v.relevancia_llm) == expected


def test_split_short_text_is_one_chunk():
    assert split_text("hola mundo") == ["hola mundo"]
    assert split_text("") == []
    assert split_text("   ") == []


def test_split_goldens():
    assert split_text("aaa bbb ccc ddd", 7, 0) == ["aaa bbb", "ccc", "ddd"]
    assert split_text("aaa bbb ccc ddd", 8, 0) == ["aaa bbb", "ccc ddd"]
    assert split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert split_text("uno\n\ndos tres cuatro", 10, 0) == ["uno", "dos tres", "cuatro"]
    assert split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]


@pytest.mark.parametrize(("size", "overlap"), [(50, 0), (100, 20), (1000, 150)])
def test_split_keeps_words_and_bounds(size, overlap):
    text = "\n\n".join(f"Párrafo {i}. Frase con varias palabras y {i} números. Otra frase." for i in range(60))
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    words = "".join(chunks) if not overlap else " ".join(chunks)
    assert all(w in words for w in text.split())


def test_chunk_hints(spark):
    rows = [("a", "no_chunk", "x " * 2000), ("b", "light_chunk", "short"), ("c", "light_chunk", "y " * 2000), ("d", None, "z " * 2000), ("e", None, None)]
    df = spark.createDataFrame(rows, "source string, chunking_hint string, page_content string")
    out = {}
    for r in chunk_documents(df).collect():
        out.setdefault(r.source, []).append((r.chunk_index, r.chunk_size))
    assert out["a"] == [(0, 4000)] and out["b"] == [(0, 5)] and len(out["c"]) > 3 and len(out["d"]) > 3 and "e" not in out
    assert [i for i, _ in sorted(out["d"])] == list(range(len(out["d"])))


def test_fixed_split(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), (None,)], "page_content string")
    assert [r.page_content for r in fixed_split(df, 4, 1).collect()] == ["abcd", "defg", "ghij"]
