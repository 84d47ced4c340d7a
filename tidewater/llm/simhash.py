"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has bit i set where more than half of the text's shingle hashes have it set.  Two fingerprints that
differ in at most 2r bits share a point that is within r bits of both; so every distinct fingerprint
emits all variants within r, variants are shuffled together, and fingerprints that meet are verified and linked.
All fingerprints that meet in one variant are mutually within 2r, so linking each to the next one in order keeps the
same components without emitting all pairs; at most sum C(64, i), i <= r, distinct fingerprints meet in one variant.

Defined results: null text is empty; a text without words has fingerprint zero and is linked like any other; with
fewer words than a shingle the whole sequence is the only shingle; exact copies share a fingerprint and
so a component; rows with a null id get their group's component; repeated rows give repeated results; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._text import as_bytes, cut, fields_of, id_text, pieces, placed_rows
from .components import components

BLOCK = 1 << 15  # hashes whose bits are unpacked at a time


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    words = text.lower().split()
    if 0 < len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle)))]
    return np.array(hashes, "<u8")


def fold(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    return fold(shingle_hashes(text, shingle, seed))


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in pieces(batches):
            fps = [fingerprint(t, shingle, seed) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def links(fps: DataFrame, half_radius: int = 1) -> DataFrame:
    """(u, v): enough verified links between the distinct ``fp`` of ``fps`` for the components at 2 * half_radius bits."""
    if half_radius not in (0, 1, 2):
        raise ValueError("half_radius is 0, 1 or 2: the variants of one fingerprint are 1, 65 or 2081")
    distinct = fps.select("fp").distinct()
    flips = ["array(0L)", "transform(sequence(0, 63), i -> shiftleft(1L, i))", "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"]
    masks = F.expr(f"concat({', '.join(flips[: half_radius + 1])})")
    variants = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("other")).filter("other is not null")
    return met.distinct().filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2 * half_radius).select(F.col("other").alias("u"), F.col("fp").alias("v"))


def near_duplicates(df: DataFrame, shingle: int = 3, half_radius: int = 1, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    fps = cut(fingerprints(df, shingle, seed, id_col, text_col))
    return groups(fps, half_radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def groups(fps: DataFrame, half_radius: int) -> DataFrame:
    """``fps`` plus component_id, the smallest doc_id of the component."""
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    group = components(links(fps, half_radius))
    named = firsts.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return fps.join(ids, "fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id, and of rows that repeat it the first.

    Rows are told apart by their place in the input, so ``docs`` must be a table that reads the same twice, as
    files do.  A row without an id stays only if its whole group has none, and then the first.
    """
    rows = placed_rows(docs).select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row").alias("key"), "text")
    fps = cut(fingerprints(rows, id_col="key", **{k: v for k, v in options.items() if k != "half_radius"}))
    named = groups(fps, options.get("half_radius", 1))
    gone = named.filter("doc_id <> component_id").select("doc_id.row")
    return fields_of(docs).join(gone, "row", "left_anti").select("fields.*")
