"""Files to documents: delimited files by their advice, text files that are tables by rows, other text files whole."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions.text import compact_ws, looks_numeric
from quern.operators.delimited import DISTRICT, KINDS, NEIGHBORHOOD, advise, profile_of
from quern.sources import files
from quern.sources.tables import materialize, with_ordinals

#: Columns of a loaded document; those that a kind of file doesn't have are null.
DOCUMENT = (
    "source string, file_hash string, doc_id int, row int, page_content string, csv_kind string, dedup_policy string, chunking_hint string, "
    "entity_key string, group_key string, group_size int, is_aggregated boolean, district string, neighborhood string"
)
TABULAR_TEXT = "tabular_txt"
_NAMES = [c.split() for c in DOCUMENT.split(", ")]


def _as_documents(df: DataFrame) -> DataFrame:
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _NAMES))


def cells_text(cells: Column) -> Column:
    """`name: value | name: value` over the cells that are not empty, in the header's order."""
    filled = F.filter(F.transform(F.map_entries(cells), lambda e: F.struct(e["key"].alias("name"), compact_ws(e["value"]).alias("value"))), lambda e: e["value"] != "")
    return F.array_join(F.transform(filled, lambda e: F.concat(e["name"], F.lit(": "), e["value"])), " | ")


def tabular_documents(found: DataFrame) -> DataFrame:
    """A document for each row of text files that are tables; no advice is asked, since a repeated value would pass for a key."""
    _, policy, hint = KINDS[TABULAR_TEXT]
    rows = files.read_delimited(found)
    return rows.select("source", "file_hash", "row", cells_text(F.col("cells")).alias("page_content"), F.lit(TABULAR_TEXT).alias("csv_kind"), F.lit(policy).alias("dedup_policy"), F.lit(hint).alias("chunking_hint"))


def _advice(rows: DataFrame, sample: int = 2000, ratio_sample: int = 1000) -> DataFrame:
    """(source, file_hash, names, csv_kind, treatment, policy, hint, ids, keys) of each file: all files are profiled by one grouped aggregate over their first rows, and advised in the tasks, a row for each."""
    file = ["source", "file_hash"]
    names = rows.where("row = 0").select(*file, F.array_distinct("header").alias("names"))
    head = rows.where(F.col("row") < sample).select(*file, "row", "cells").join(names, file)
    line = F.concat_ws("|", F.transform("names", lambda c: F.col("cells")[c]))
    whole = head.groupBy(*file, "names").agg(F.count("*").alias("n_rows"), F.count_distinct(F.md5(line.cast("binary"))).alias("n_distinct"), F.sum(F.length(line)).alias("n_chars"))
    cells = head.where(F.col("row") < ratio_sample).select(*file, F.explode(F.transform("names", lambda c: F.struct(c.alias("name"), F.nullif(F.col("cells")[c], F.lit("")).alias("value")))).alias("c")).select(*file, "c.*")
    counts = cells.groupBy(*file, "name").agg(F.count("value").alias("filled"), F.count_if(looks_numeric(F.col("value"))).alias("numeric"), F.count_distinct("value").alias("distinct"))
    counts = counts.groupBy(*file).agg(F.collect_list(F.struct("name", "filled", "numeric", "distinct")).alias("counts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                told = advise(profile_of(r.source, list(r.names), r.n_rows, r.n_distinct, r.n_chars, {c["name"]: (c["filled"], c["numeric"], c["distinct"]) for c in r.counts}))
                treatment, policy, hint = KINDS[told.csv_kind]
                grouped = treatment == "grouped_doc" and told.grouping_keys
                out.append((r.source, r.file_hash, list(r.names), told.csv_kind, "row_as_doc" if treatment == "grouped_doc" and not grouped else treatment, policy, hint, told.id_columns, told.grouping_keys))
            yield pd.DataFrame(out, columns=["source", "file_hash", "names", "csv_kind", "treatment", "dedup_policy", "chunking_hint", "ids", "keys"])

    return whole.join(counts, file).mapInPandas(run, "source string, file_hash string, names array<string>, csv_kind string, treatment string, dedup_policy string, chunking_hint string, ids array<string>, keys array<string>")


def _filled_text(names: Column) -> Column:
    """`name: value | name: value` over those of the names whose cells are not empty."""
    filled = F.filter(F.transform(names, lambda c: F.struct(c.alias("name"), compact_ws(F.col("cells")[c]).alias("value"))), lambda e: e["value"] != "")
    return F.array_join(F.transform(filled, lambda e: F.concat(e["name"], F.lit(": "), e["value"])), " | ")


def _first_filled(names: Column) -> Column:
    values = F.filter(F.transform(names, lambda c: compact_ws(F.col("cells")[c])), lambda v: v != "")
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def delimited_documents(found: DataFrame) -> DataFrame:
    """The documents of delimited files, each by its own advice: one plan for all files, in which a row goes the way of its file."""
    rows = materialize(files.read_delimited(found), "cells")
    told = materialize(_advice(rows), "advice")
    rows = rows.drop("header").join(told, ["source", "file_hash"])
    about = ["source", "file_hash", "csv_kind", "dedup_policy", "chunking_hint"]
    own = lambda names: _first_filled(F.array(*map(F.lit, names)))
    entity = rows.where("treatment = 'entity_doc'").select(*about, "row", _filled_text(F.col("names")).alias("page_content"), _first_filled(F.col("ids")).alias("entity_key"), own(DISTRICT).alias("district"), own(NEIGHBORHOOD).alias("neighborhood"))
    plain = rows.where("treatment = 'row_as_doc'").select(*about, "row", _filled_text(F.col("names")).alias("page_content"))
    keyed = rows.where("treatment = 'grouped_doc'").select(*about, "keys", "row", F.transform("keys", lambda k: compact_ws(F.col("cells")[k])).alias("values"), F.nullif(_filled_text(F.array_except("names", "keys")), F.lit("")).alias("line"))
    groups = keyed.groupBy(*about, "keys", "values").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"), F.count("*").cast("int").alias("group_size"), F.min("row").alias("row"))
    shown = F.filter(F.arrays_zip("keys", "values"), lambda e: e["values"] != "")
    heading = F.concat_ws("\n", F.concat(F.lit("Resumen del dataset "), "source", F.lit(".")), F.transform(shown, lambda e: F.concat(e["keys"], F.lit(": "), e["values"])))
    text = F.concat(heading, F.lit("\n"), F.array_join(F.transform("lines", lambda e: F.concat(F.lit("\n- "), e["line"])), ""))
    grouped = groups.select(*about, "row", text.alias("page_content"), F.array_join(F.filter("values", lambda v: v != ""), "|").alias("group_key"), "group_size", F.lit(True).alias("is_aggregated"))
    return reduce(DataFrame.unionByName, map(_as_documents, (entity, plain, grouped)))


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """DOCUMENT's columns of all text and delimited files under a folder; doc_id is the document's place in its file, files of equal name and content are one. A file without rows gives none. The number of jobs doesn't depend on the number of files."""
    found, _ = files.scan_files(spark, path, (".txt", ".md", ".csv"))
    paths = materialize(found.select("path", "source", "file_hash"), "paths").groupBy("source", "file_hash").agg(F.min("path").alias("path"))
    found = found.join(paths.select("path"), "path", "left_semi")
    suffix = files.extension(F.col("path"))
    text = materialize(found.where(suffix != ".csv").withColumn("page_content", files.decode_text(F.col("content"))).withColumn("tabular", files.is_tabular(F.col("page_content"))), "texts")
    whole = text.where("NOT tabular").select("source", "file_hash", F.lit(0).alias("row"), "page_content")
    out = reduce(DataFrame.unionByName, map(_as_documents, (whole, tabular_documents(text.where("tabular").select("source", "file_hash", "content")), delimited_documents(found.where(suffix == ".csv")))))
    placed = with_ordinals(out.drop("doc_id").withColumn("_file", F.concat_ws("/", "file_hash", "source")), "_file", "row", name="doc_id")
    return placed.select(*(c for c, _ in _NAMES))
