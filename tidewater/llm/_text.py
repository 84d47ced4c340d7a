"""Small helpers that the corpus operators share.

Words are maximal runs of characters other than space and \\t \\n \\v \\f \\r; for UTF-8 bytes that is
exactly ``bytes.split()``.  Lower-casing touches A-Z only, which is exactly ``bytes.lower()``.
A null text counts as the empty text everywhere.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK = b"\n"
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG_WORD = 64
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(c, UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names; extra columns cannot clash with its own."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def placed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text): rows are numbered by their place, which holds as long as ``df`` reads the same each time."""
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fields_of(df: DataFrame) -> DataFrame:
    """(row, fields): the same numbers of rows, and whole rows as one struct, so that no name of theirs can clash."""
    return df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("fields"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_digests(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of ``data`` starts, its 64-bit digest (A-Z lowered), and where the line breaks are.

    Words are read eight bytes at a time; those over 64 bytes are digested by XXH64.
    """
    raw = np.empty(len(data) + 10, np.uint8)
    raw[0], raw[len(data) + 1 :] = 10, 10
    np.take(LOWER, np.frombuffer(data, np.uint8), out=raw[1 : len(data) + 1])
    gap = np.take(SPACE, raw)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    size = end - start
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    digest = mix((eight[start] & KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        digest[more] = mix(digest[more] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[more] + done] & KEEP[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        digest[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes())
    return start - 1, digest, np.flatnonzero(raw[1 : len(data) + 1] == 10)


def tidy() -> None:
    """Gives freed memory back to the system: Python workers wait for later tasks, and what they keep adds up in an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], budget: int = 4_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches re-cut so that each holds about ``budget`` bytes of text, or one row: it bounds a task's memory."""
    for batch in batches:
        start = size = 0
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > budget:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    tidy()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder, so that a lost executor costs no recompute.

    The folder is the session's spark.checkpoint.dir; where that is unset on a local master (tests, a laptop) one is made.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    kept = {name: spark.conf.get(name) for name in (RELEASE, BATCH)}
    spark.conf.set(RELEASE, "true")  # what was shuffled for it has no further use; if asked for again, Spark makes it anew
    spark.conf.set(BATCH, str(min(int(kept[BATCH]), BATCH_ROWS) if int(kept[BATCH]) > 0 else BATCH_ROWS))  # texts are long, and a batch stands in both processes
    try:
        return df.select("*").checkpoint()  # the settings hold for frames made under them
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset a temporary one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
