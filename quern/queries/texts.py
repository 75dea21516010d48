"""Queries of text functions, splitting, tagging and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.functions import text as T
from quern.operators import tagging
from quern.operators.chunking import chunk_documents, fixed_split, recursive_chunks
from quern.queries.base import CHUNKS, Tables, chunks, query
from quern.sources import files

_DIRTY = "chr(65279) || '  ' || replace(replace(text, '. ', '.' || chr(10) || '  ' || chr(10) || chr(10)), ', ', ',   ' || chr(9)) || chr(1) || chr(10)"


@query("t1_clean_text", f"""
WITH dirty AS (SELECT doc_id, {_DIRTY} AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n\\s*\\n\\s*', chr(10) || chr(10), 'g') AS t FROM dirty),
b AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)) AS t FROM a)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '^\\x{{FEFF}}', ''), '^\\s+|\\s+$', '', 'g') AS clean FROM b""")
def _(t: Tables) -> DataFrame:
    dirty = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n  \n\n")), F.lit(", "), F.lit(",   \t"))
    return t.documents.select("doc_id", T.clean_text(F.concat(F.lit("﻿  "), dirty, F.lit("\x01\n"))).alias("clean"))


@query("t2_compact_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS compact FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.compact_ws(F.col("text")).alias("compact"))


@query("t3_row_to_text", "SELECT c_custkey, 'c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey || CASE WHEN c_custkey % 3 > 0 THEN ' | segment: ' || c_mktsegment ELSE '' END AS line FROM customer")
def _(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("segment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    return rows.select("c_custkey", T.row_to_text(["c_name", "c_nationkey", "segment"]).alias("line"))


_SOURCE_NAMES = ("Normativa_", "PRECIOS_", "agenda_", "otros_tarifas_", "x_Reglamento_agenda_", "otros_")
_AUTHORITY = " ".join(f"WHEN contains(lower(name), '{token}') THEN {value}::DOUBLE" for token, value in T.AUTHORITY.items())


@query("t4_authority", f"SELECT doc_id, CASE {_AUTHORITY} ELSE {T.AUTHORITY_ELSE} END AS authority FROM (SELECT doc_id, {list(_SOURCE_NAMES)}[doc_id % 6 + 1] || source AS name FROM documents)")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, _SOURCE_NAMES)), (F.col("doc_id") % 6 + 1).cast("int")), "source")
    return t.documents.select("doc_id", T.authority(name).alias("authority"))


#: Cells of which some are numbers to Python and some are not; {} is a quantity.
_NUMBERS = (" 1 0,5", "1_000", "1e5", "1d", "-inf", ".5", "{}", "{}_", "_{}", "{}.", "+{},5e-3", "0x{}", "nan", "{},{}", "1.2.{}", "")


@query("t6_looks_numeric", rf"""
SELECT l_orderkey, l_linenumber, regexp_full_match(replace(replace(cell, ' ', ''), ',', '.'), '(?i)[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)') AS number
FROM (SELECT *, replace({list(_NUMBERS)}[(l_orderkey + l_linenumber) % {len(_NUMBERS)} + 1], '{{}}', l_quantity::INT::VARCHAR) AS cell FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, _NUMBERS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_NUMBERS) + 1).cast("int"))
    cell = F.replace(shape, F.lit("{}"), F.col("l_quantity").cast("int").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", T.looks_numeric(cell).alias("number"))


@query("t9_snippet", "SELECT doc_id, substring(replace(trim(text), chr(10), ' '), 1, 120) AS snip FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.snippet(F.col("text")).alias("snip"))


_ANSWER = """CASE doc_id % 5 WHEN 0 THEN 'no json here' WHEN 1 THEN '```json {"categoria": "agenda", "tags": ["piscina", "otra", "abono"], "relevancia": 0.8} ```'
    WHEN 2 THEN 'x {"categoria": "otra", "tags": [], "relevancia": 1} y' WHEN 3 THEN '{"categoria": "tarifas", "tags": ["precio"]}' ELSE CASE WHEN doc_id % 2 = 0 THEN '{"note": "' || lang || '"}' ELSE '{"categoria": "abonos", broken' END END"""


def _answers(t: Tables) -> DataFrame:
    other = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"note": "'), "lang", F.lit('"}'))).otherwise('{"categoria": "abonos", broken')
    said = ["no json here", '```json {"categoria": "agenda", "tags": ["piscina", "otra", "abono"], "relevancia": 0.8} ```', 'x {"categoria": "otra", "tags": [], "relevancia": 1} y', '{"categoria": "tarifas", "tags": ["precio"]}']
    return t.documents.select("doc_id", "source", F.element_at(F.array(*map(F.lit, said), other), (F.col("doc_id") % 5 + 1).cast("int")).alias("answer"))


@query("t10_extract_json_object", f"SELECT doc_id, nullif(regexp_extract({_ANSWER}, '(?s)\\{{.*\\}}', 0), '') AS object FROM documents")
def _(t: Tables) -> DataFrame:
    return _answers(t).select("doc_id", T.extract_json_object(F.col("answer")).alias("object"))


@query("t11_normalize_verdict", f"""
WITH answers AS (SELECT doc_id, regexp_extract({_ANSWER}, '(?s)\\{{.*\\}}', 0) AS o FROM documents),
said AS (SELECT doc_id, CASE WHEN json_valid(o) AND o <> '' THEN o END AS o FROM answers),
parts AS (SELECT doc_id, o, o->>'$.categoria' AS category, list_filter(coalesce(from_json(o->'$.tags', '["VARCHAR"]'), []), lambda t: t IN ('abono', 'piscina', 'reserva', 'tarifa', 'precio')) AS tags, (o->>'$.relevancia')::DOUBLE AS relevance FROM said)
SELECT doc_id, CASE WHEN category IN ('tarifas', 'normativa', 'reservas', 'abonos', 'instalaciones', 'agenda') THEN category ELSE 'instalaciones' END AS doc_category, coalesce(array_to_string(tags, ';'), '') AS tags,
    CASE WHEN o IS NULL THEN 0.5 ELSE coalesce(relevance, 0) END AS relevancia_llm, coalesce(len(list_distinct(tags)), 0)::INT AS n_flags FROM parts""")
def _(t: Tables) -> DataFrame:
    v = _answers(t).select("doc_id", tagging.normalize_verdict(F.col("answer")).alias("v"))
    return v.select("doc_id", "v.doc_category", "v.tags", "v.relevancia_llm", F.size("v.tag_flags").alias("n_flags"))


@query("t12_context_block", """
SELECT conv_id, string_agg('--- Fragmento ' || n || ' (fuente: ' || role || ') ---' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY n) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id""")
def _(t: Tables) -> DataFrame:
    hits = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("source"), "text")))
    return t.conversations.groupBy("conv_id").agg(hits.alias("hits")).select("conv_id", T.context_block(F.col("hits")).alias("context"))


@query("t12_prompts", """
SELECT doc_id, 'Etiqueta.' || chr(10) || chr(10) || substring(text, 1, 8000) AS tag_prompt, 'Haz 3 preguntas: ' || substring(text, 1, 2500) AS question_prompt,
    'S' || chr(10) || chr(10) || '=== CONTEXTO ===' || chr(10) || source || chr(10) || chr(10) || '=== PREGUNTA ===' || chr(10) || lang || chr(10) || chr(10) || '=== RESPUESTA ===' AS rag_prompt FROM documents""")
def _(t: Tables) -> DataFrame:
    question = T.filled("Haz {max_q} preguntas: {text}", max_q=F.lit(3), text=F.substring("text", 1, 2500))
    return t.documents.select("doc_id", T.tag_prompt("Etiqueta.", F.col("text")).alias("tag_prompt"), question.alias("question_prompt"), T.rag_prompt("S", F.col("source"), F.col("lang")).alias("rag_prompt"))


@query("t13_sanitize_metadata", """
SELECT doc_id, coalesce(quality::VARCHAR, 'null') AS quality, '["' || source || '","' || lang || '"]' AS pair FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", F.array("source", "lang").alias("pair"))
    clean = files.sanitized(rows.select("quality", "pair", F.col("doc_id").cast("string").alias("id")))
    return clean.select(F.col("id").cast("long").alias("doc_id"), "quality", "pair")


@query("t14_validate_question", "SELECT conv_id, turn, role, CASE WHEN trim(t) = '' THEN 'empty' WHEN length(t) > 2000 THEN 'too long' END AS error FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN '  ' WHEN turn % 3 = 1 THEN text || repeat('x', 2000) ELSE text END AS t FROM conversations)")
def _(t: Tables) -> DataFrame:
    q = F.when(F.col("turn") % 3 == 0, "  ").when(F.col("turn") % 3 == 1, F.concat("text", F.repeat(F.lit("x"), 2000))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", "role", T.question_error(q).alias("error"))


@query("t15_is_abstention", "SELECT conv_id, turn, role, turn % 2 = 1 AS abstains FROM conversations")
def _(t: Tables) -> DataFrame:
    answer = F.when(F.col("turn") % 2 == 1, F.concat("text", F.upper(F.lit(T.ABSTENTION)))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", "role", T.is_abstention(answer).alias("abstains"))


@query("t16_text_sha1", "SELECT doc_id, sha1(text) AS text_sha FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.text_sha1(F.col("text")).alias("text_sha"))


@query("t18_tag_filter", f"WITH {CHUNKS} SELECT pos FROM chunks WHERE doc_category = 'tarifas' AND list_contains(tags, 'piscina') AND list_contains(tags, 'reserva')")
def _(t: Tables) -> DataFrame:
    return tagging.tag_filter(chunks(t), "tarifas", ("piscina", "reserva")).select("pos")


@query("g1_recursive_split")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(recursive_chunks(F.col("text"))).alias("chunk_index", "chunk"))


@query("g2_chunk_documents")
def _(t: Tables) -> DataFrame:
    rows = chunks(t).select("pos", "page_content", "chunking_hint")
    return chunk_documents(rows).select("pos", "chunk_index", "page_content", F.col("chunk_size").cast("long").alias("chunk_size"))


@query("g2_chunk_passed", f"""
WITH {CHUNKS} SELECT pos, coalesce(chunking_hint = 'no_chunk', false) OR length(page_content) <= 1000 AS whole FROM chunks""")
def _(t: Tables) -> DataFrame:
    """Which rows stay as they are: those not to be cut, and those that one chunk holds."""
    rows = chunks(t).select("pos", F.col("page_content").alias("all"), "chunking_hint")
    cut = chunk_documents(rows.withColumn("page_content", F.col("all"))).groupBy("pos").agg(F.count("*").alias("n"), F.max(F.col("page_content") == F.col("all")).alias("same"), F.max(F.length("all")).alias("size"))
    return cut.select("pos", ((F.col("n") == 1) & (F.col("same") | (F.col("size") <= 1000))).alias("whole"))


@query("g2_chunk_routing", rf"""
WITH {CHUNKS} SELECT pos, length(regexp_replace(page_content, '\s+', '', 'g'))::BIGINT AS n_chars, chunking_hint IS NOT NULL OR length(page_content) <= 1000 AS single, chunking_hint IS NULL AS bounded FROM chunks""")
def _(t: Tables) -> DataFrame:
    """Without an overlap the chunks hold all characters but space; texts that fit or are not to be cut make one, the others chunks of at most the size."""
    rows = chunks(t).select("pos", "page_content", "chunking_hint")
    cut = chunk_documents(rows, 1000, 0).groupBy("pos", "chunking_hint").agg(F.sum(F.length(F.regexp_replace("page_content", r"(?U)\s+", ""))).alias("n_chars"), F.count("*").alias("n"), F.max("chunk_size").alias("most"))
    return cut.select("pos", "n_chars", (F.col("n") == 1).alias("single"), (F.col("chunking_hint").isNull() & (F.col("most") <= 1000)).alias("bounded"))


@query("g3_fixed_split", """
SELECT doc_id, k AS chunk_index, substring(text, k * 400 + 1, 500) AS page_content FROM (SELECT doc_id, text, unnest(range(0, (greatest(0, length(text) - 101) // 400 + 1)::INT)) AS k FROM documents)""")
def _(t: Tables) -> DataFrame:
    return fixed_split(t.documents.select("doc_id", F.col("text").alias("page_content")), 500, 100).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "page_content")


def keyword_tagger(prompts: list[str]) -> list[str]:
    """A stand-in for a model: the category follows from the text's length, the tags from letters."""
    return [f'{{"categoria": "{tagging.CATEGORIES[len(p) % 6]}", "tags": ["abono", "nada"], "relevancia": 0.{len(p) % 10}}}' for p in prompts]


_FIRST = """first AS (SELECT source, arg_min(page_content, pos) AS t FROM chunks GROUP BY source),
verdicts AS (SELECT source, (length(substring(t, 1, 8000)) + 2) AS n FROM first)"""
_CATEGORY = "['tarifas', 'normativa', 'reservas', 'abonos', 'instalaciones', 'agenda'][n % 6 + 1]"


@query("u2_tag_sources", f"WITH {CHUNKS}, {_FIRST} SELECT pos, {_CATEGORY} AS doc_category, 'abono' AS tags, ('0.' || (n % 10))::DOUBLE AS relevancia_llm FROM chunks JOIN verdicts USING (source)")
def _(t: Tables) -> DataFrame:
    rows = chunks(t).select("pos", "source", "page_content")
    return tagging.tag_sources(rows, keyword_tagger).select("pos", "doc_category", "tags", "relevancia_llm")


@query("j1_propagate_tags", f"WITH {CHUNKS}, {_FIRST} SELECT pos, {_CATEGORY} AS doc_category FROM chunks LEFT JOIN verdicts USING (source)")
def _(t: Tables) -> DataFrame:
    rows = chunks(t).select("pos", "source", "page_content")
    first = tagging.first_doc_per_source(rows, "page_content")
    n = F.length(F.substring("page_content", 1, 8000)) + 2
    verdicts = first.select("source", F.element_at(F.array(*map(F.lit, tagging.CATEGORIES)), n % 6 + 1).alias("doc_category"))
    return tagging.propagate_tags(rows, verdicts).select("pos", "doc_category")


@query("w1_first_doc_per_source", "SELECT source, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    return tagging.first_doc_per_source(t.documents.withColumn("pos", F.col("doc_id")), "doc_id", "text")


@query("u3_generate", "SELECT doc_id, upper(source) AS answer FROM documents")
def _(t: Tables) -> DataFrame:
    return tagging.answered(t.documents.select("doc_id", F.col("source").alias("prompt")), lambda prompts: [p.upper() for p in prompts]).select("doc_id", "answer")


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: 16 counts of words by their length, and their norm is 1."""
    import numpy as np

    out = np.zeros((len(texts), 16))
    for row, text in zip(out, texts, strict=True):
        for word in text.split():
            row[len(word) % 16] += 1
    return list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))


@query("u1_embed", """
WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(text), '\\s+')) AS w FROM documents),
c AS (SELECT doc_id, length(w) % 16 AS at, count(*) AS n FROM w WHERE w <> '' AND length(w) % 16 < 8 GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)
SELECT d.doc_id, 8 AS dim, round(coalesce(max(c.n) FILTER (c.at = 5) / any_value(n.norm), 0), 6) AS v5 FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def _(t: Tables) -> DataFrame:
    rows = tagging.embed(t.documents.select("doc_id", F.col("text").alias("page_content")), hash_embedder, 8)
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(F.col("embedding")[5], 6).alias("v5"))
