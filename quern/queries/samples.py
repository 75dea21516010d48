"""Queries of samples and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.operators import sampling as S
from quern.queries.base import Tables, query

_DOCS = "docs AS (SELECT doc_id AS pos, source, text AS page_content, lang, md5(source) AS file_hash FROM documents)"


def docs(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("pos"), "source", F.col("text").alias("page_content"), "lang", F.md5(F.col("source").cast("binary")).alias("file_hash"))


_BALANCED = "picked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || pos), pos) AS round FROM docs WHERE trim(page_content) <> ''), sample AS (SELECT * FROM picked ORDER BY round, md5('s|' || source), source LIMIT 50)"


@query("w4_balanced_sample", f"WITH {_DOCS}, {_BALANCED} SELECT pos, source, round::INT AS round FROM sample")
def _(t: Tables) -> DataFrame:
    return S.balanced_sample(docs(t), 50, "s").select("pos", "source", "round")


_SLOTS = ", ".join(f"('{kind}', {n})" for kind, n in S.QUESTION_TYPES.items())


@query("w4_question_types", f"""WITH {_DOCS}, {_BALANCED}, kinds(question_type, n) AS (VALUES {_SLOTS}), slots AS (SELECT question_type, row_number() OVER (ORDER BY md5('s|' || question_type || '|' || nth)) AS place FROM (SELECT question_type, unnest(range(0, n)) AS nth FROM kinds)),
placed AS (SELECT pos, row_number() OVER (ORDER BY md5('s|' || pos), pos) AS place FROM sample) SELECT pos, question_type FROM placed JOIN slots USING (place)""")
def _(t: Tables) -> DataFrame:
    return S.with_question_types(S.balanced_sample(docs(t), 50, "s"), "s").select("pos", "question_type")


@query("w5_coverage_sample", f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY md5('c|' || pos), pos) = 1 AS first FROM docs) SELECT pos, file_hash FROM r ORDER BY first DESC, md5('c|' || pos), pos LIMIT 60")
def _(t: Tables) -> DataFrame:
    return S.coverage_sample(docs(t), 60, "c").select("pos", "file_hash")


@query("j6_exclude_sources", f"WITH {_DOCS} SELECT pos FROM docs WHERE NOT (contains(source, 'src1') OR contains(source, '7'))")
def _(t: Tables) -> DataFrame:
    return S.exclude_sources(docs(t), ["src1", "7"], "source").select("pos")


@query("w6_head_after_exclude", f"WITH {_DOCS} SELECT pos FROM docs WHERE NOT contains(source, 'src1') ORDER BY pos LIMIT 25")
def _(t: Tables) -> DataFrame:
    return S.head_after_exclude(docs(t), ["src1"], 25, "source").select("pos")


@query("j7_pending_texts", f"WITH {_DOCS} SELECT pos FROM docs WHERE sha1(page_content) NOT IN (SELECT sha1(page_content) FROM docs WHERE pos % 3 = 0)")
def _(t: Tables) -> DataFrame:
    done = docs(t).where("pos % 3 = 0").select(F.sha1(F.col("page_content").cast("binary")).alias("text_sha"))
    return S.pending_texts(docs(t), done).select("pos")


@query("j7_pending_stale", f"WITH {_DOCS} SELECT pos FROM docs")
def _(t: Tables) -> DataFrame:
    done = docs(t).select(F.when(F.col("pos") % 3 == 0, F.sha1(F.col("page_content").cast("binary"))).alias("text_sha"))
    return S.pending_texts(docs(t), done).select("pos")


def _raw(t: Tables) -> DataFrame:
    """Answers of a model: an array of three with an odd item, an object in no array, an empty array, and no JSON."""
    q = F.concat(F.lit('"¿'), "source", F.lit('?"'))
    three = F.concat(F.lit('x [{"pregunta": '), q, F.lit(', "respuesta_posible": "a"}, 5, {"pregunta": "p2", "respuesta_posible": "NO GENERADA"}, {"pregunta": "p3", "respuesta_posible": "c"}] y'))
    one = F.concat(F.lit('{"pregunta": '), q, F.lit(', "respuesta_posible": "b"}'))
    raw = F.element_at(F.array(three, one, F.lit("[]"), F.lit("none")), (F.col("pos") % 4 + 1).cast("int"))
    return docs(t).withColumns({"raw": raw, "doc_category": F.col("lang")})


_PAIRS = """SELECT pos, '¿' || source || '?' AS question, 'a' AS answer FROM docs WHERE pos % 4 = 0 UNION ALL SELECT pos, 'p2', '' FROM docs WHERE pos % 4 = 0
UNION ALL SELECT pos, '', '' FROM docs WHERE pos % 4 = 2"""


@query("g4_parse_question_array", f"WITH {_DOCS} {_PAIRS} UNION ALL SELECT pos, NULL, NULL FROM docs WHERE pos % 4 IN (1, 3)")
def _(t: Tables) -> DataFrame:
    pairs = _raw(t).select("pos", S.parse_question_array(F.col("raw"), 2).alias("p"))
    return pairs.select("pos", F.explode_outer("p").alias("p")).select("pos", "p.question", "p.answer")


@query("x5_question_records", f"WITH {_DOCS}, p AS ({_PAIRS}) SELECT source, file_hash, lang AS category, sha1(page_content) AS text_sha, question, answer FROM p JOIN docs USING (pos)")
def _(t: Tables) -> DataFrame:
    return S.question_records(_raw(t), 2)
