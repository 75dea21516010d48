"""Column functions over text. White space is Unicode's, as in `(?U)\\s`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

#: The first token found in the lower-cased source gives its authority.
AUTHORITY = {"reglamento": 1.0, "normativa": 1.0, "precios": 0.9, "tarifas": 0.9, "agenda": 0.6}
AUTHORITY_ELSE = 0.7
#: Fixed value: the answer that says there is no evidence.
ABSTENTION = "No dispongo de esa información en los documentos proporcionados."
QUESTION_CHARS, TAG_CHARS = 2000, 8000

_NUMBER = r"(?i)^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(inf|infinity|nan)$"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def clean_text(col: Column) -> Column:
    """Squeeze blank lines and spaces, strip each line, drop control characters and a leading byte-order mark, strip."""
    col = F.regexp_replace(col, r"\n{3,}", "\n\n")
    col = F.regexp_replace(col, r"[ \t]{2,}", " ")
    col = F.regexp_replace(col, r"(?U)\n\s*\n\s*", "\n\n")
    col = F.array_join(F.transform(F.split(col, "\n"), strip), "\n")
    col = F.regexp_replace(col, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(col, "^﻿", ""))


def compact_ws(col: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(col, r"(?U)\s+", " ")), F.lit(""))


def row_to_text(columns: Sequence[str]) -> Column:
    """`name: value | name: value` over the columns that are not empty, in their order."""
    cells = {c: compact_ws(F.col(f"`{c}`").cast("string")) for c in columns}
    return F.concat_ws(" | ", *(F.when(v != "", F.concat(F.lit(f"{c}: "), v)) for c, v in cells.items()))


def authority(source: Column, table: Mapping[str, float] = AUTHORITY, otherwise: float = AUTHORITY_ELSE) -> Column:
    low = F.lower(source)
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in table.items()), F.lit(otherwise))


def looks_numeric(col: Column) -> Column:
    """Whether the cell, without spaces and with a comma for a point, is a number to Python's float()."""
    return F.coalesce(F.regexp_like(F.replace(F.replace(col, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), F.lit(_NUMBER)), F.lit(False))


def snippet(col: Column, size: int = 120) -> Column:
    return F.substring(F.replace(strip(col), F.lit("\n"), F.lit(" ")), 1, size)


def extract_json_object(col: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(col, r"(?s)\{.*\}", 0), F.lit(""))


def text_sha1(col: Column) -> Column:
    return F.sha1(col.cast("binary"))


def sanitize(col: Column, data_type: str) -> Column:
    """A metadata value that any store takes: null becomes 'null', arrays and maps their JSON."""
    if data_type.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(col), F.lit("null"))
    return F.coalesce(col, F.lit("null")) if data_type == "string" else F.coalesce(col.cast("string"), F.lit("null"))


def question_error(col: Column, most: int = QUESTION_CHARS) -> Column:
    """What is wrong with a question; null if nothing."""
    return F.when(F.coalesce(strip(col), F.lit("")) == "", "empty").when(F.length(col) > most, "too long")


def is_abstention(answer: Column, message: str = ABSTENTION) -> Column:
    return F.coalesce(F.contains(F.lower(answer), F.lit(message.lower())), F.lit(False))


def tag_prompt(instruction: str, text: Column) -> Column:
    return F.concat(F.lit(instruction), F.lit("\n\n"), F.substring(text, 1, TAG_CHARS))


#: The headings of fragments and of a prompt's parts.
FRAGMENT, CONTEXT, QUESTION, ANSWER = "--- Fragmento {} (fuente: {}) ---\n", "=== CONTEXTO ===\n", "=== PREGUNTA ===\n", "=== RESPUESTA ==="


def context_block(hits: Column, empty: str = "(sin fragmentos recuperados)") -> Column:
    """Numbered fragments with their source from an ordered array of (source, text)."""
    before, between, after = FRAGMENT.split("{}")
    item = lambda h, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(between), h["source"], F.lit(after), strip(F.coalesce(h["text"], F.lit(""))))
    return F.when(F.coalesce(F.size(hits), F.lit(0)) <= 0, empty).otherwise(F.array_join(F.transform(hits, item), "\n\n"))


def rag_prompt(system: str, context: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{system}\n\n{CONTEXT}"), strip(context), F.lit(f"\n\n{QUESTION}"), strip(question), F.lit(f"\n\n{ANSWER}"))


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by a column."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), values.items(), F.lit(template))


#: How much of a seed's and of a candidate's text an evaluation prompt shows, and the head of a candidate.
SEED_CHARS, CANDIDATE_CHARS, CANDIDATE = 5000, 2500, "ID: {} | cosine: {}\n"


def candidate_contexts(candidates: Column) -> Column:
    """The texts of an ordered array of (id, score, text), each under its id and cosine and cut to CANDIDATE_CHARS."""
    before, between, after = CANDIDATE.split("{}")
    item = lambda c: F.concat(F.lit(before), c["id"].cast("string"), F.lit(between), F.format_string("%.4f", c["score"]), F.lit(after), F.substring(F.coalesce(c["text"], F.lit("")), 1, CANDIDATE_CHARS))
    return F.array_join(F.transform(candidates, item), "\n\n")


def eval_prompt(template: str, seed_id: Column, seed_text: Column, question_type: Column, candidates: Column) -> Column:
    """A template with {chunk_id}, {context}, {question_type} and {candidates} filled in: the seed's text cut to SEED_CHARS, and its neighbours'."""
    context = F.substring(F.coalesce(seed_text, F.lit("")), 1, SEED_CHARS)
    return filled(template, chunk_id=seed_id, question_type=question_type, context=context, candidates=candidate_contexts(candidates))
