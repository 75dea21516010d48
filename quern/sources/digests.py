"""SHA-256 of files of any size, the state of a digest passed from task to task, so that no task reads a whole file."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.sources.tables import materialize, shared_path

#: A file of more bytes is read in parts, and bytes of a file, about, that one task adds to its digest.
LARGE, STEP = 128 << 20, 128 << 20
#: Bytes of a piece of a file.
PIECE = 1 << 20
#: Spark's reader of lines would unpack files with these ends, and drops a byte-order mark.
PACKED, MARK = r"(?i)\.(gz|gzip|bz2|deflate|zst|zstd|lz4|snappy|lzo|passthrough)$", b"\xef\xbb\xbf"


class _State(ctypes.Structure):
    """OpenSSL's SHA256_CTX."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("n", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


class Digest:
    """A SHA-256 whose state can be kept as bytes and gone on with elsewhere, which hashlib's can't."""

    def __init__(self, state: bytes | None = None) -> None:
        self.state = _State.from_buffer_copy(state) if state else _State()
        if not state:
            _library().SHA256_Init(ctypes.byref(self.state))

    def update(self, blob: pa.Buffer) -> None:
        _library().SHA256_Update(ctypes.byref(self.state), ctypes.c_void_p(blob.address), ctypes.c_size_t(blob.size))

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), _State.from_buffer_copy(bytes(self.state))
        _library().SHA256_Final(out, ctypes.byref(last))
        return out.raw.hex()


@cache
def _library() -> ctypes.CDLL:
    """The library that hashlib itself is linked to."""
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)


@cache
def can_go_on() -> bool:
    """Whether digests can be gone on with here: Python has OpenSSL, and its state is what Digest takes it for."""
    text = bytes(range(256)) * 3
    try:
        first = Digest()
        first.update(pa.py_buffer(text[:100]))
        second = Digest(bytes(first.state))
        second.update(pa.py_buffer(text[100:]))
        return second.hexdigest() == hashlib.sha256(text).hexdigest()
    except (ImportError, AttributeError, OSError):
        return False


def is_large(name: Column, size: Column) -> Column:
    return (size > LARGE) & ~F.regexp_like(name, F.lit(PACKED))


def _pieces(spark: SparkSession, path: str, wanted: Column, step: int) -> DataFrame:
    """(file, size, begin, n, n_bytes, blob, round) of the wanted files, read in Spark's splits: pieces by begin and n are the file, but for what a reader of lines adds or drops."""
    lines = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("begin"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line")).where(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            file, begin, line = (batch.column(c) for c in ("file", "begin", "line"))
            new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(begin[1:], begin[:-1])).to_numpy(zero_copy_only=False).nonzero()[0] + 1
            for lo, hi in zip([0, *new], [*new, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                at = (file[lo].as_py(), begin[lo].as_py())
                last, n = at, n if at == last else 0
                blob = b"".join(line[lo:hi].to_pylist())
                for cut in range(0, len(blob), PIECE):
                    piece = blob[cut : cut + PIECE]
                    yield pa.RecordBatch.from_pylist([{"file": at[0], "size": batch.column("size")[lo].as_py(), "begin": at[1], "n": n, "n_bytes": len(piece), "blob": piece, "round": at[1] // step}], kinds)
                    n += 1

    kinds = pa.schema([("file", pa.string()), ("size", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("n_bytes", pa.int64()), ("blob", pa.binary()), ("round", pa.int64())])
    return lines.mapInArrow(run, "file string, size long, begin long, n long, n_bytes long, blob binary, round long")


def _gone_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, state) after pieces(file, state, blob) in order, the state of a file's first piece being that before it."""
    file = digest = None
    for batch in batches:
        for of, state, blob in zip(*(batch.column(c) for c in ("file", "state", "blob")), strict=True):
            if of.as_py() != file:
                if file is not None:
                    yield pa.RecordBatch.from_pydict({"file": [file], "state": [bytes(digest.state)]})
                file, digest = of.as_py(), Digest(state.as_py())
            digest.update(blob.as_buffer())
    if file is not None:
        yield pa.RecordBatch.from_pydict({"file": [file], "state": [bytes(digest.state)]})


def large_digests(spark: SparkSession, path: str, wanted: Column, step: int | None = None) -> DataFrame:
    """(file, file_hash) of the files under a path that are wanted, by file and size.

    Pieces are written to the shared folder by rounds. In a round a task adds about `step` bytes of a file to its digest, whose state, some hundred bytes, goes to the next round.
    A digest goes over a file in order, so rounds are as many as the largest file has steps, and files go through a round side by side.
    """
    where = shared_path(spark, "pieces-" + uuid.uuid4().hex)
    pieces = _pieces(spark, path, wanted, STEP if step is None else step)
    pieces.write.partitionBy("round").parquet(where)
    pieces = spark.read.schema(pieces.schema).parquet(where)
    place = F.struct("begin", "n")
    files = materialize(pieces.groupBy("file").agg(F.first("size").alias("size"), F.min(place).alias("first"), F.max(place).alias("last"), F.sum("n_bytes").alias("n_bytes"), F.max("round").alias("rounds")), "files")
    # the last line has got an end that the file may not have, and a mark at the file's head is missing
    more = F.col("n_bytes") - F.col("size")
    files = files.select("file", "first", "last", "rounds", more.alias("more"), more.isin(-3, -2).alias("marked"), more.isin(1, -2).alias("longer"))
    if files.where("NOT (marked OR longer OR more = 0)").count():
        raise ValueError("a file changed while it was read")
    pieces = pieces.join(F.broadcast(files), "file")
    cut = F.when(F.col("longer") & (place == F.col("last")), F.substring("blob", F.lit(1), F.length("blob") - 1)).otherwise(F.col("blob"))
    pieces = pieces.select("file", "begin", "n", "round", F.concat(F.when(F.col("marked") & (place == F.col("first")), F.lit(MARK)).otherwise(F.lit(b"")), cut).alias("blob"))
    states = files.select("file", F.lit(None).cast("binary").alias("state"))
    for n in range((files.agg(F.max("rounds")).first()[0] or 0) + 1):
        rows = pieces.where(F.col("round") == n).join(F.broadcast(states), "file").repartition("file").sortWithinPartitions("file", "begin", "n")
        after = rows.select("file", "state", "blob").mapInArrow(_gone_on, "file string, state binary").withColumnRenamed("state", "after")
        states = materialize(states.join(after, "file", "left").select("file", F.coalesce("after", "state").alias("state")), "digest-states")

    @F.pandas_udf("string")
    def hexdigest(found: pd.Series) -> pd.Series:
        return found.map(lambda state: Digest(state).hexdigest())

    return states.select("file", hexdigest("state").alias("file_hash"))
