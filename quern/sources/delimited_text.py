"""Delimited files read in many tasks, whatever their size: quoted cells may hold line ends, also where a file is cut.

A file becomes chunks of whole lines. Whether a line begins inside quotes depends on all before it, so each chunk tells first in which state it is left
when it is entered outside quotes and when inside; a running composition of these over a file's chunks, a few numbers each, gives the state in
which every chunk is entered. Lines up to the end of a record that began before go to the chunk where it began, and then chunks are parsed apart from each other.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.sources.tables import materialize

#: Bytes of a chunk, about, and lines of a file's head by which its delimiter is told.
CHUNK_BYTES, HEAD = 1 << 20, 20


def sniff_delimiter(text: str) -> str:
    """The delimiter that cuts the first five lines that aren't blank into one number of fields above 1; of several the one with most fields, of equals the later."""
    lines = [line for line in text.splitlines() if line.strip()][:5]
    best, most = ";", 1
    for delimiter in (";", ",", "\t"):
        widths = Counter(len(r) for r in csv.reader(lines, delimiter=delimiter))
        width = next(iter(widths), 0)
        if len(widths) == 1 and width > 1 and width >= most:
            best, most = delimiter, width
    return best


def parsed(text: str, delimiter: str) -> Iterator[list[str]]:
    """The records of a text: lines end at CR and LF only."""
    return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)


def column_name(raw: str) -> str:
    return raw.split(",")[0].strip().lower().replace("§", "º")


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open after the line, as the csv module reads it: a quote opens a cell only at its start."""
    if '"' not in line:
        return inside
    at, start = 0, not inside
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside, start, at = False, False, at + 1
        elif start and line[at : at + 1] == '"':
            inside, at = True, at + 1
        else:
            ends = [n for n in (line.find(c, at) for c in (delimiter, "\r", "\n")) if n >= 0]
            if not ends:
                return False
            at, start = min(ends) + 1, True


def file_chunks(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(source, file_hash, chunk, blob) of files(source, file_hash, content): runs of whole lines of about `size` bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, digest, content in frame.itertuples(index=False):
                content, at, n = bytes(content or b""), 0, 0
                while at < len(content):
                    end = content.find(b"\n", at + size - 1) + 1 or len(content)
                    yield pd.DataFrame({"source": [source], "file_hash": [digest], "chunk": [n], "blob": [content[at:end]]})
                    at, n = end, n + 1

    return files.select("source", "file_hash", "content").mapInPandas(run, "source string, file_hash string, chunk long, blob binary")


def folder_chunks(spark: SparkSession, path: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(path, chunk, blob) of the .csv files under a folder, read in Spark's splits: no file need fit anywhere."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").text(path, lineSep="\n")
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        last, n, length = None, 0, 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                if held and ((row.path, row.begin) != last or length >= size):
                    yield pd.DataFrame({"path": [last[0]], "chunk": [last[1] + n], "blob": [b"".join(held)]})
                    held, length, n = [], 0, n + 1 if (row.path, row.begin) == last else 0
                last = row.path, row.begin
                held.append(bytes(row.line) + b"\n")
                length += len(held[-1])
        if held:
            yield pd.DataFrame({"path": [last[0]], "chunk": [last[1] + n], "blob": [b"".join(held)]})

    return lines.mapInPandas(run, "path string, chunk long, blob binary")


def _decoded(blob: bytes, encoding: str) -> str:
    return blob.decode(encoding)


def _formats(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, encoding, delimiter, first): how each file is to be read, and its first chunk."""
    text, latin = F.col("blob").cast("string"), F.decode("blob", "ISO-8859-1")
    kinds = chunks.groupBy(*keys).agg(F.bool_and(F.is_valid_utf8(text)).alias("utf8"), F.bool_or(F.regexp_like(latin, F.lit(r"[\x81\x8D\x8F\x90\x9D]"))).alias("latin"), F.min("chunk").alias("first"))
    kinds = kinds.withColumn("encoding", F.when(F.col("utf8"), "utf-8-sig").when(F.col("latin"), "latin-1").otherwise("cp1252")).drop("utf8", "latin")
    full = chunks.where(F.regexp_like(latin, F.lit(r"[^\s]"))).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk"))).where("n <= 5")
    heads = full.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "blob"))), lambda x: x["blob"]).alias("blobs"))

    @F.pandas_udf("string")
    def delimiter(blobs: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([";" if b is None else sniff_delimiter("\n".join(_decoded(bytes(x), e) for x in b)) for b, e in zip(blobs, encodings, strict=True)])

    return kinds.join(heads, keys, "left").select(*keys, "first", "encoding", delimiter("blobs", "encoding").alias("delimiter"))


def _states(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, inside, owner): whether a chunk is entered inside quotes, and the last chunk before it in which a record begins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for blob, delimiter in zip(frame["blob"], frame["delimiter"], strict=True):
                after, begins = [False, True], False
                for line in io.StringIO(bytes(blob).decode("latin-1"), newline="\n"):
                    begins |= not after[1]
                    after = [ends_inside(line, state, delimiter) for state in after]
                out.append((*after, begins))
            yield frame[[*keys, "chunk"]].assign(**{name: [o[i] for o in out] for i, name in enumerate(("out", "in", "begins"))})

    kinds = ", ".join(f"{k} string" for k in keys)
    left = chunks.mapInPandas(run, f"{kinds}, chunk long, out boolean, in boolean, begins boolean")
    left = materialize(left, "states")
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    # a chunk leaves both states as they are, or swaps them, or leads to one whatever was before
    swaps = F.sum((F.col("out") & ~F.col("in")).cast("int")).over(upto)
    known = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").cast("int").alias("state"), F.col("swaps").alias("at")))
    left = left.withColumn("swaps", swaps).withColumn("known", F.last(known, ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.max("swaps").over(before), F.lit(0)))
    state = F.coalesce(F.col("known.state"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("known.at"), F.lit(0))
    left = left.withColumn("inside", F.pmod(state, F.lit(2)) == 1)
    owner = F.last(F.when(~F.col("inside") | F.col("begins"), F.col("chunk")), ignorenulls=True).over(before)
    return left.select(*keys, "chunk", "inside", owner.alias("owner"))


def records(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, header, cells) of chunks(keys, chunk, blob): see read_delimited()."""
    kinds = ", ".join(f"{k} string" for k in keys)
    chunks = materialize(chunks, "chunks")
    formats = materialize(_formats(chunks, keys), "formats")
    known = materialize(_states(chunks.join(formats.drop("first"), keys), keys), "chunk-states")

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The lines up to the first record of a chunk go to its owner."""
        for frame in frames:
            for _, r in frame.iterrows():
                blob, cut, inside = bytes(r["blob"]), 0, r["inside"]
                if inside:
                    for line in io.StringIO(blob.decode("latin-1"), newline="\n"):
                        cut, inside = cut + len(line), ends_inside(line, inside, r["delimiter"])
                        if not inside:
                            break
                parts = [(o, b) for o, b in ((r["owner"], blob[:cut]), (r["chunk"], blob[cut:])) if b]
                yield pd.DataFrame({**{k: r[k] for k in keys}, "owner": [int(o) for o, _ in parts], "chunk": r["chunk"], "blob": [b for _, b in parts]})

    whole = chunks.join(known, [*keys, "chunk"]).join(formats.drop("first", "encoding"), keys).mapInPandas(moved, f"{kinds}, owner long, chunk long, blob binary")

    def parse(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        head = frame.iloc[0]
        rows = parsed(_decoded(b"".join(map(bytes, frame["blob"])), head["encoding"] if head["owner"] == head["first"] else head["encoding"].removesuffix("-sig")), head["delimiter"])
        out, n = [], 0
        if head["owner"] == head["first"]:
            out.append((-1, [column_name(c) for c in next(rows, [])]))
        for cells in rows:
            if cells:
                out.append((n, [c.strip() for c in cells]))
                n += 1
        return pd.DataFrame({**{k: head[k] for k in keys}, "owner": head["owner"], "n": pd.Series([n for n, _ in out], dtype="int64"), "values": pd.Series([c for _, c in out], dtype=object)})

    rows = whole.join(formats, keys).groupBy(*keys, "owner").applyInPandas(parse, f"{kinds}, owner long, n long, values array<string>")
    rows = materialize(rows, "records")
    counts = rows.where("n >= 0").groupBy(*keys, "owner").agg(F.count("*").alias("count"))
    before = Window.partitionBy(*keys).orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    headers = rows.where("n = -1").select(*keys, F.col("values").alias("names"))
    out = rows.where("n >= 0").join(counts, [*keys, "owner"]).join(headers, keys).withColumn("row", (F.col("offset") + F.col("n")).cast("int"))
    return out.select(*keys, "row", F.when(F.col("row") == 0, F.col("names")).alias("header"), _cells(F.col("names"), F.col("values")).alias("cells"))


def _cells(names: Column, values: Column) -> Column:
    """A map of each name to the value at its last place; values that are missing are empty, the first that is too many is called col."""
    longer = F.when(F.size(values) > F.size(names), F.concat(names, F.array(F.lit("col")))).otherwise(names)
    last = lambda name: F.size(longer) - F.array_position(F.reverse(longer), name).cast("int")
    return F.map_from_entries(F.transform(F.array_distinct(longer), lambda name: F.struct(name, F.coalesce(F.get(values, last(name)), F.lit("")))))
