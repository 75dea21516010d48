"""Readers of mixed files and writers of a job's results."""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions.text import sanitize
from quern.sources import digests
from quern.sources.delimited_text import file_chunks, folder_chunks, parsed, records, sniff_delimiter
from quern.sources.tables import materialize, with_global_index, with_ordinals

EXTENSIONS = (".pdf", ".txt", ".md", ".csv")
#: A text file is a table with at least so many columns and rows among its first ones.
TABLE_COLUMNS, TABLE_ROWS = 2, 50
#: Lines that are looked at to tell.
HEAD_LINES = 200
#: Keys of record files that mean the same, the first that isn't null wins.
TEXT_KEYS = ("text", "document", "page_content", "content", "texto")
VECTOR_KEYS = ("embedding", "vector", "values", "embedding_vector")
ID_KEYS = ("id", "chunk_id", "document_id", "uid")
LIST_KEYS = ("chunks", "documents", "records", "data", "items")
SOURCE_KEYS, DOCUMENT_KEYS, CATEGORY_KEYS = ("source", "fuente"), ("document_id", "doc_id"), ("doc_category", "category", "categoria")


#: The bytes from 80 to 9F that cp1252 has a character for, as latin-1 and as cp1252 read them.
_HIGH = bytes(b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_CP1252 = (_HIGH.decode("latin-1"), _HIGH.decode("cp1252"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(files, ignored): path, source, content and file_hash of the files with these extensions, and the paths of the others. The hash of a large file is found in parts, so a task reads it whole only where its content is asked for."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = lambda name: extension(name).isin(*extensions)
    # by metadata, so that Spark opens no file that isn't asked for
    file, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    ignored, large = listed.where(~known(F.col("path"))).select("path"), digests.is_large(file, size)
    if not digests.can_go_on() or listed.where(known(file) & large).select("path").isEmpty():
        return with_file_hash(listed.where(known(file)).select("path", "content")), ignored
    small = with_file_hash(listed.where(known(file) & ~large).select("path", "content"))
    found = digests.large_digests(spark, path, known(F.col("file")) & digests.is_large(F.col("file"), F.col("size")))
    whole = listed.where(known(file) & large).select("path", "content", file.alias("file")).join(F.broadcast(found), "file", "left")
    return small.unionByName(whole.withColumn("source", _name()).select(*small.columns)), ignored


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def with_file_hash(df: DataFrame) -> DataFrame:
    """df(path, content) with source, the file's name, and file_hash, SHA-256 of its bytes."""
    return df.withColumns({"source": _name(), "file_hash": F.sha2("content", 256)})


def decode_text(content: Column) -> Column:
    """UTF-8, its byte-order mark eaten; else cp1252; else latin-1. The five bytes that cp1252 has no character for tell the last two apart."""
    text, latin = content.cast("string"), F.decode(content, "ISO-8859-1")
    undefined = F.regexp_like(latin, F.lit(r"[\x81\x8D\x8F\x90\x9D]"))
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).otherwise(F.when(undefined, latin).otherwise(F.translate(latin, *_CP1252)))


def read_plain_text(files: DataFrame) -> DataFrame:
    """A document for each .txt or .md file that isn't a table."""
    text = files.where(extension(F.col("path")).isin(".txt", ".md")).withColumn("page_content", decode_text(F.col("content")))
    return text.where(~is_tabular(F.col("page_content"))).select("path", "source", "file_hash", "page_content")


def _is_table(text: str | None) -> bool:
    rows = list(islice(parsed(text or "", sniff_delimiter(text or "")), TABLE_ROWS + 1))
    return len(rows) > TABLE_ROWS and len(rows[0]) >= TABLE_COLUMNS


def is_tabular(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(_is_table)

    return check(F.substring_index(text, "\n", HEAD_LINES))


def read_delimited(files: DataFrame) -> DataFrame:
    """(source, file_hash, row, header, cells) for each row of delimited files(source, file_hash, content): cells is a map of normalised header to trimmed text, in the header's order; the header itself is with row 0. Of equal headers the last counts, missing cells are empty, a longer row has its first extra cell under 'col'. A file is parsed in chunks, in as many tasks."""
    return records(file_chunks(files), ["source", "file_hash"])


def read_delimited_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, header, cells) for each row of the .csv files under a folder, as read_delimited() has them, without a file being whole anywhere."""
    return records(folder_chunks(spark, path), ["path"])


def cells_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of one file as a table of text columns, ordered by `row`."""
    return rows.select("row", *(F.coalesce(F.col("cells")[c], F.lit("")).alias(c) for c in columns))


def with_doc_ordinal(df: DataFrame, order: str) -> DataFrame:
    """doc_id: the row's 0-based place in its source; a source may be spread over tasks."""
    return with_ordinals(df.drop("doc_id"), "source", order, name="doc_id")


def export_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_audit(events: DataFrame, path: str) -> None:
    """A JSON line for each event; a run overwrites the one before."""
    events.write.mode("overwrite").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def chunk_id(source: Column, index: Column) -> Column:
    """source::i, i being the place after dedup."""
    return F.concat(source, F.lit("::"), index.cast("string"))


def sanitized(df: DataFrame) -> DataFrame:
    return df.select(*(sanitize(F.col(f"`{c}`"), kind).alias(c) for c, kind in df.dtypes))


def index_table(df: DataFrame, name: str, recreate: bool = True) -> tuple[int, int]:
    """Write rows(id, embedding, document, metadata columns) to a table; (how many of these rows it holds afterwards, how many rows it has). Ids must be unique, and a row that the table doesn't hold is an error."""
    df = materialize(df, "rows-to-index")
    if not df.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids are not unique")
    spark, kept = df.sparkSession, [c for c in df.columns if c not in ("id", "embedding", "document")]
    kinds = dict(df.dtypes)
    clean = df.select("id", "embedding", "document", *(sanitize(F.col(c), kinds[c]).alias(c) for c in kept))
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    clean.write.mode("overwrite" if recreate else "append").saveAsTable(name)
    alive, given = spark.table(name).join(df.select("id"), "id", "left_semi").select("id").distinct().count(), df.count()
    if alive != given:
        raise ValueError(f"{name} holds {alive} of {given} rows")
    return alive, spark.table(name).count()


def _metadata(df: DataFrame) -> Column:
    """A record's metadata, or meta, as a map of texts; what is no object is kept under metadata_raw."""
    kinds, none = dict(df.dtypes), F.create_map().cast("map<string,string>")

    def of(name: str) -> Column:
        value = F.col(name)
        if kinds[name].startswith("map"):
            return value.cast("map<string,string>")
        if kinds[name].startswith("struct"):
            pairs = [F.struct(F.lit(f.name), value[f.name].cast("string")) for f in df.schema[name].dataType]
            return F.when(value.isNotNull(), F.map_filter(F.map_from_entries(F.array(*pairs)), lambda _, v: v.isNotNull())) if pairs else none
        return F.when(value.isNotNull(), F.create_map(F.lit("metadata_raw"), value.cast("string")))

    return F.coalesce(*(of(c) for c in ("metadata", "meta") if c in kinds), none)


def load_records(df: DataFrame) -> DataFrame:
    """(pos, id, text, embedding, metadata, source, document_id, category) from raw records: of aliases the first that isn't null counts, of a record's own before its metadata's; an id falls back to the row's number. df has pos and any of the aliases; vectors may lie in data."""
    kinds, metadata = dict(df.dtypes), _metadata(df)
    own = lambda names: [F.col(n).cast("string") for n in names if n in kinds and not kinds[n].startswith(("struct", "array", "map"))]
    held = lambda names: [F.col("_meta")[n] for n in names]
    vectors = [F.col(n).cast("array<double>") for n in VECTOR_KEYS if kinds.get(n, "").startswith("array")]
    if kinds.get("data", "").startswith("struct"):
        vectors += [F.col("data")[f.name].cast("array<double>") for n in VECTOR_KEYS for f in df.schema["data"].dataType if f.name == n]
    first = lambda parts, other, kind="string": F.coalesce(*parts, F.lit(other).cast(kind))
    return df.withColumn("_meta", metadata).select(
        "pos", F.coalesce(*own(ID_KEYS), *held(ID_KEYS), F.format_string("row_%08d", "pos")).alias("id"), first(own(TEXT_KEYS), "").alias("text"), first(vectors, None, "array<double>").alias("embedding"),
        F.col("_meta").alias("metadata"), first(held(SOURCE_KEYS), "").alias("source"), first(held(DOCUMENT_KEYS), "").alias("document_id"), first(held(CATEGORY_KEYS), "").alias("category"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of a .jsonl file (or a folder of such), a line for each; of another, a JSON list, an object that wraps one, or a single object. pos is the place in the file."""
    lines = not path.rstrip("/").lower().endswith(".json")
    raw = spark.read.json(path, multiLine=not lines)
    wrapped = None if lines else next((k for k in LIST_KEYS if dict(raw.dtypes).get(k, "").startswith("array<struct")), None)
    at = {"_file": F.col("_metadata.file_path"), "_begin": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    rows = raw.withColumns(at)
    if wrapped:
        rows = rows.select(*at, F.posexplode(wrapped).alias("_at", "_record")).select(*at, "_at", "_record.*")
    order = (*at, *(["_at"] if wrapped else []))
    return with_global_index(rows, *order, name="pos").drop(*order)


def long_form(df: DataFrame, section: str) -> DataFrame:
    """(section, metric, value) for each column of a one-row table of numbers."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns))
    return df.select(F.lit(section).alias("section"), F.inline(pairs))


def write_eval_outputs(path: str, chunks: DataFrame, neighbors: DataFrame, sample: DataFrame, summary: DataFrame) -> None:
    for name, df in (("chunks", chunks), ("neighbors", neighbors), ("summary", summary)):
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)
    sample.write.mode("overwrite").json(f"{path}/sample")


def write_question_set(records: DataFrame, path: str, append: bool = False) -> None:
    records.write.mode("append" if append else "overwrite").json(path)
