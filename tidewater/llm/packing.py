"""Best-two-fit packing of token sequences.

Documents are tokenised and only those longer than a sequence are cut, into full pieces after a first piece that takes
the rest.  How pieces can be combined depends on their lengths alone, so the packing is planned on the histogram of
lengths, which has at most ``capacity`` entries whatever the input: a bin is filled greedily with the longest piece that
still fits, then its smallest piece gives way to two unpacked pieces that fill the enlarged gap further, and the bin is
repeated for as many pieces as there are.  Each bin kind uses up a length or nearly so, so the plan is short.

Pieces then take their places: a piece's rank among those of its length, found with one counter per (length,
bucket), picks its bin and offset in the plan.  Buckets grow in number with the pieces, so no group is ever gathered in one task;
only rows that repeat an id with one and the same text share a bucket however many they are.

Defined results: null text is empty and gives one piece with the end token alone; repeated rows are packed once
each; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import as_bytes, cut, id_text, pieces
from .token_counts import byte_letters


class Encoder:
    """Token ids as the tokenizers library gives them.

    The tiktoken library reads the same vocabulary and merges several times faster.  It gets the texts in which every blank is a single space or
    line break between two words and no special string occurs; all others go through tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        by_id = [t for t, i in sorted(spec["model"]["vocab"].items(), key=lambda x: x[1]) if t not in self.special]
        if by_id[len(by_id) - len(merges) :] != [a + b for a, b in merges]:
            raise ValueError("the vocabulary is not numbered in the order of its merges, so tokens cannot be looked up by rank")
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def regular(self, text: str) -> bool:
        return " ".join(text.split()) == text.replace("\n", " ") and not any(x in text for x in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        odd = []
        for i, t in enumerate(texts):
            regular = self.regular(t)
            out.append(array("I", self.fast(t)).tobytes() if regular else b"")
            if not regular:
                odd.append(i)
        for i, got in zip(odd, self.ids([texts[i] for i in odd])):
            out[i] = got
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a process: its tables take a second to build, and workers run many tasks."""
    return Encoder(path)


def tokenised(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every row."""

    def run(batches):
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches):
            docs = batch.column("doc_id")
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode([b.decode() for b in as_bytes(batch.column("text"))])):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many such bins), from length -> count."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    bins = []
    lengths = list(np.flatnonzero(left))
    while lengths:
        taken: dict[int, int] = {}
        held, gap = [], capacity
        while gap > 0:
            here = np.asarray(lengths)
            at = int(np.searchsorted(here, gap, side="right")) - 1
            while at >= 0 and left[here[at]] <= taken.get(int(here[at]), 0):
                at -= 1
            if at < 0:
                break
            length = int(here[at])
            n = min(gap // length, int(left[length]) - taken.get(length, 0))
            taken[length] = taken.get(length, 0) + n
            held += [length] * n
            gap -= length * n
        smallest = held[-1]
        if gap > 0 and (two := tighter(lengths, left, taken, smallest, gap + smallest)):
            held.pop()
            taken[smallest] -= 1
            for length in two:
                held.append(length)
                taken[length] = taken.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in taken.items() if n)
        for length, n in taken.items():
            left[length] -= n * times
        bins.append((held, times))
        lengths = [x for x in lengths if left[x] > 0]
    return bins


def tighter(lengths: list[int], left: np.ndarray, taken: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is over ``smallest`` and at most ``room``, as large as can be."""
    free = [int(x) for x in lengths if x < room and left[x] > taken.get(int(x), 0)]
    best, i, j = smallest, 0, len(free) - 1
    two = None
    while i <= j:
        total = free[i] + free[j]
        if total > room or (i == j and left[free[i]] - taken.get(free[i], 0) < 2):
            j -= 1
            continue
        if total > best:
            best, two = total, (free[j], free[i])
        i += 1
    return two


def places(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Runs of places (length, first rank, first bin, offset), in order of length and rank."""
    rank: dict[int, int] = {}
    runs, first = [], 0
    for held, times in bins:
        offset = 0
        for length in held:
            runs.append((length, rank.get(length, 0), first, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        first += times
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, bucket_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = cut(tokenised(df, tokenizer, capacity, end_id, id_col, text_col))
    buckets = made.count() // bucket_rows + 1  # even if all pieces had one length, a bucket would hold about ``bucket_rows``
    made = made.withColumn("bucket", F.pmod(F.xxhash64(*made.columns), F.lit(buckets)))  # rows that are alike in all of them keep no order
    counts = made.groupBy("length", "bucket").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    runs = places(plan(histogram, capacity))
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).select("length", "bucket", "before")
    ranked = (
        made.withColumn("within", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("within")).drop("before", "within", "bucket")
    )
    shared = made.sparkSession.sparkContext.broadcast(runs)  # as long as the plan, which the histogram bounds

    def place(batches):
        runs = shared.value
        keys = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence = runs[at, 2] + rank - runs[at, 1]
            out = batch.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(runs[at, 3])).select(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
